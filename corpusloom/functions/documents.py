"""Pages and e-mails as structs: parsing needs Python, so it runs in Arrow batches."""

from __future__ import annotations

import datetime
import email.utils
import gc
import html
import json
import re
from email.message import EmailMessage
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import urls as U
from .markup import main_elements, read_text
from .nested import article_object, ld_objects, ld_text, pick

PAGE_SCHEMA = "title_tag string, html_lang string, canonical string, meta map<string,string>, og map<string,string>, ld_headline string, ld_publisher string, ld_published string, ld_lang string, ld_authors array<string>, text string, body_html string, page_chars int, link_chars int"
_SKIP = {"script", "style", "noscript", "template", "svg", "head", "title"}
_CHROME = {"nav", "footer", "header", "aside", "form", "menu"}
_BREAK = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "blockquote", "pre", "ul", "ol", "table"}
_VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "track", "param"}
# Confidences by where a value came from.
CONFIDENCE = {"json-ld": 0.95, "og": 0.9, "meta": 0.7, "rel-author": 0.7, "domain": 0.5, "heuristic": 0.5}
MAIL_CONFIDENCE = {"json-ld": 0.95, "newsletter-html": 0.8, "sender-header": 0.55}
MAX_PARTS, MAX_DEPTH = 100, 5


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta, self.og, self.scripts = {}, {}, []
        self.title = self.lang = self.canonical = None
        self.stack: list[str] = []
        self.main: list[str] = []
        self.all_text: list[str] = []
        self.links = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            if "name" in a:
                self.meta[a["name"]] = a.get("content", "")
            if "property" in a:
                self.og[a["property"]] = a.get("content", "")
        elif tag == "html" and a.get("lang", "").strip():
            self.lang = self.lang or a["lang"].strip()
        elif tag == "link" and a.get("rel", "").lower() == "canonical":
            self.canonical = self.canonical or a.get("href", "").strip() or None
        elif tag == "script" and a.get("type") == "application/ld+json":
            self.scripts.append("")
            tag = "ld"
        if tag in _BREAK:
            self.main.append(" ")
            self.all_text.append(" ")
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        tag = "ld" if tag == "script" and self.stack[-1:] == ["ld"] else tag
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]
        if tag in _BREAK:
            self.main.append(" ")
            self.all_text.append(" ")

    def handle_data(self, data):
        if self.stack[-1:] == ["ld"]:
            self.scripts[-1] += data
        elif self.stack[-1:] == ["title"]:
            self.title = (self.title or "") + data
        if not _SKIP.intersection(self.stack) and "ld" not in self.stack:
            self.all_text.append(data)
            if not _CHROME.intersection(self.stack):
                self.main.append(data)
                if "a" in self.stack:
                    self.links += len(" ".join(data.split()))


def _page(source: str | None) -> dict:
    p = _Page()
    p.feed(source or "")
    p.close()
    a = article_object(ld_objects(p.scripts))
    authors = a.get("author") or []
    names = [n for n in map(ld_text, authors if isinstance(authors, list) else [authors]) if n]
    flat = lambda parts: " ".join("".join(parts).split())
    blank = lambda s: (s or "").strip() or None
    main = main_elements(source or "")
    text, body, links = flat(p.main), None, p.links
    if main:
        text, body = " ".join(filter(None, map(read_text, main))), "".join(clean_html((source or "")[n.start : n.end]) for n in main) or None
        links = sum(len(read_text(n)) for part in main for n in part.walk() if n.tag == "a")
    return {
        "title_tag": blank(flat([p.title or ""])), "html_lang": p.lang, "canonical": p.canonical, "meta": p.meta, "og": p.og,
        "ld_headline": ld_text(a.get("headline")) or ld_text(a.get("name")), "ld_publisher": ld_text(a.get("publisher")),
        "ld_published": a.get("datePublished") if isinstance(a.get("datePublished"), str) else None,
        "ld_lang": a.get("inLanguage") if isinstance(a.get("inLanguage"), str) else None, "ld_authors": names[: T.MAX_AUTHORS],
        "text": text, "body_html": body, "page_chars": len(flat(p.all_text)), "link_chars": links,
    }


#: Pages whose parts are Python objects at a time.
PAGES_AT_ONCE = 64


def _signals(pages: pa.Array) -> pa.Array:
    """``_page`` of each page as Arrow structs; no more than some pages at a time are held as objects."""
    kinds = {"string": pa.string(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}
    kind = pa.struct([(name, kinds[k]) for name, k in (part.split() for part in PAGE_SCHEMA.split(", "))])
    done = [pa.array([], kind)]
    for k in range(0, len(pages), PAGES_AT_ONCE):
        some = [_page(x) for x in pages.slice(k, PAGES_AT_ONCE).to_pylist()]
        done.append(pa.array([p | {"meta": list(p["meta"].items()), "og": list(p["og"].items())} for p in some], kind))
        gc.collect()  # trees of elements refer to themselves
    return pa.concat_arrays(done)


def page_signals(source: Column) -> Column:
    """What a page declares and its main text, as a struct."""
    return F.arrow_udf(_signals, PAGE_SCHEMA)(source)


def body_confidence(words: Column, link_density: Column, page_ratio: Column) -> Column:
    return F.when(words < 50, 0.2).when(link_density > 0.5, 0.3).when((page_ratio < 0.05) | (page_ratio > 0.98), 0.4).when(words < 120, 0.6).otherwise(0.85)


def extract_pages(pages: DataFrame, source: str = "html", url: str = "url") -> DataFrame:
    """Adds resolved fields with where they came from, authors, affiliation and body figures to a table of pages."""
    s = lambda name: F.col(f"signals.{name}")
    og, meta = lambda k: s("og")[k], lambda k: s("meta")[k]
    out = pages.withColumn("signals", page_signals(F.col(source)))
    declared = [("json-ld", s("ld_published")), ("og", og("article:published_time")), ("meta", F.coalesce(meta("article:published_time"), meta("date"), meta("dc.date"), meta("dcterms.date")))]
    published = F.coalesce(*[U.parse_temporal(v) for _, v in declared])
    published_source = F.coalesce(*[F.when(U.parse_temporal(v).isNotNull(), F.lit(n)) for n, v in declared])
    out = out.select(
        *[F.col(c) for c in pages.columns],
        pick(("json-ld", s("ld_headline")), ("og", og("og:title")), ("title-tag", s("title_tag"))).alias("title"),
        F.struct(published.alias("value"), published_source.alias("source")).alias("published"),
        pick(("html-lang", s("html_lang")), ("json-ld", s("ld_lang")), ("og", og("og:locale"))).alias("language"),
        pick(("canonical", s("canonical")), ("og", og("og:url")), ("url", F.col(url))).alias("canonical_url"),
        pick(("og", og("og:site_name")), ("json-ld", s("ld_publisher")), ("domain", U.display_host(F.col(url)))).alias("site"),
        F.when(F.size(s("ld_authors")) > 0, "json-ld").when(T.blank_to_null(meta("author")).isNotNull(), "meta").when(T.blank_to_null(og("article:author")).isNotNull() & ~og("article:author").rlike("(?i)^https?://"), "og").alias("author_source"),
        s("ld_authors").alias("ld_authors"), meta("author").alias("meta_author"), og("article:author").alias("og_author"),
        s("text").alias("text"), s("body_html").alias("body_html"), T.count_words(s("text")).alias("word_count"),
        (s("link_chars") / F.greatest(F.lit(1), F.length(s("text")))).alias("link_density"),
        (F.length(s("text")) / F.greatest(F.lit(1), s("page_chars"))).alias("page_ratio"),
    )
    names = F.when(F.col("author_source") == "json-ld", F.col("ld_authors")).when(F.col("author_source") == "meta", T.split_byline(F.col("meta_author"))).when(F.col("author_source") == "og", T.split_byline(F.col("og_author"))).otherwise(F.array().cast("array<string>"))
    weight = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    affiliation = F.when(F.col("site.value").isNotNull(), F.struct(F.col("site.value").alias("name"), U.origin(F.col(url)).alias("url"), F.coalesce(weight[F.col("site.source")], F.lit(0.5)).alias("confidence")))
    return (
        out.withColumn("authors", F.transform(F.slice(names, 1, T.MAX_AUTHORS), lambda n: F.struct(n.alias("name"), F.coalesce(weight[F.col("author_source")], F.lit(0.5)).alias("confidence"))))
        .withColumn("affiliation", affiliation)
        .withColumn("reading_seconds", T.reading_seconds(F.col("word_count")))
        .withColumn("body_confidence", body_confidence(F.col("word_count"), F.col("link_density"), F.col("page_ratio")))
        .drop("ld_authors", "meta_author", "og_author")
    )


_ALLOWED = set("a b blockquote br caption cite code col colgroup dd div dl dt em h1 h2 h3 h4 h5 h6 i img li ol p pre q small span strike strong sub sup table tbody td tfoot th thead tr u ul math mrow mi mo mn msup msub mfrac msqrt mtext semantics annotation".split())
_TRACKING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\D|$)")


class _Cleaner(HTMLParser):
    """Keeps allowed tags, safe links and visible images; drops scripts, styles and tracking pixels."""

    def __init__(self, base: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.base = base.split("#")[0]

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style", "noscript", "head", "template"):
            self.skip += 1
        elif self.skip or tag not in _ALLOWED:
            return
        elif tag == "img":
            pixel = any(re.match(r"[01](?!\d)", a.get(k, "999").strip()) for k in ("width", "height"))
            if re.match(r"(?i)https?://", a.get("src", "")) and not pixel and not _TRACKING.search(a.get("style", "").lower()):
                self.out.append(f'<img src="{html.escape(a["src"])}" alt="{html.escape(a.get("alt", ""))}" loading="lazy" decoding="async" referrerpolicy="no-referrer">')
        elif tag == "a":
            target = a.get("href", "")
            if self.base and target.startswith(self.base + "#"):
                target = target[len(self.base) :]
            safe = re.match(r"(?i)(?:https?://|mailto:|#)", target)
            self.out.append(f'<a href="{html.escape(target)}" target="_blank" rel="noopener noreferrer" referrerpolicy="no-referrer">' if safe and target[0] != "#" else f'<a href="{html.escape(target)}">' if safe else "<a>")
        else:
            self.out.append(f"<{tag}>")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "head", "template"):
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in _ALLOWED and tag not in _VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(html.escape(data, quote=False))


def clean_html(source: str | None, base: str = "") -> str:
    c = _Cleaner(base)
    c.feed(source or "")
    c.close()
    return "".join(c.out).strip()


def clean_html_column(source: Column, base: Column | None = None) -> Column:
    return F.pandas_udf(lambda s, b: pd.Series([None if x is None else clean_html(x, y or "") for x, y in zip(s, b, strict=True)]), "string")(source, base if base is not None else F.lit(""))


def unsubscribe_url(header: str | None) -> str | None:
    found = [u.strip() for u in re.findall(r"<([^>]+)>", header or "")]
    return next((u for scheme in ("https:", "http:", "mailto:") for u in found if u.lower().startswith(scheme)), None)


def message_parts(m: EmailMessage) -> tuple[str | None, str | None, list[bytes]]:
    """The first html and plain parts that are no attachments, and all attached messages. What an attached message holds is its own."""
    rich = plain = None
    inner: list[bytes] = []
    todo, seen = [(m, 0)], 0
    while todo and seen < MAX_PARTS:
        part, depth = todo.pop()
        seen += 1
        kind = part.get_content_type()
        if kind == "message/rfc822":
            payload = part.get_payload()
            inner += [payload[0].as_bytes()] if isinstance(payload, list) and payload else []
        elif part.is_multipart():
            todo += [(p, depth + 1) for p in reversed(part.get_payload())] if depth < MAX_DEPTH else []
        elif part.get_content_disposition() != "attachment" and kind in ("text/html", "text/plain"):
            raw = part.get_payload(decode=True) or b""
            s = raw.decode(part.get_content_charset() or "utf-8", "replace") if _known(part.get_content_charset()) else raw.decode("utf-8", "replace")
            if kind == "text/html":
                rich = rich or (s if s.strip() else None)
            else:
                plain = plain or (s if s.strip() else None)
    return rich, plain, inner


def _known(charset: str | None) -> bool:
    try:
        return bool("".encode(charset or "utf-8") == b"")
    except LookupError:
        return False


def _plain_html(s: str) -> str:
    return "".join("<p>" + re.sub(r"\r?\n", "<br>", html.escape(p, quote=False)) + "</p>" for p in re.split(r"(?:\r?\n){2,}", s.strip()) if p)


def when_sent(s: str | None):
    try:
        when = email.utils.parsedate_to_datetime(s) if s else None
    except (ValueError, TypeError):
        return None
    if when is None:
        return None
    return (when if when.tzinfo else when.replace(tzinfo=datetime.timezone.utc)).astimezone(datetime.timezone.utc)


def parse_mails(mails: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """``mail.parse_mails``: mails are documents too."""
    from .mail import parse_mails as parse

    return parse(mails, raw, keep)


def provenance(**parts: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)
