"""JSON, arrays and maps."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MAX_AUTHORS, MAX_TAGS, blank_to_null, clamp_confidence, clamp_label, clamp_name

WORK_SCHEMA = (
    "id string, title string, display_name string, publication_date string, abstract_inverted_index map<string,array<int>>, "
    "primary_location struct<source: struct<id: string, display_name: string, type: string>>, "
    "authorships array<struct<author: struct<id: string, display_name: string, orcid: string>, institutions: array<struct<id: string, display_name: string, ror: string, country_code: string>>>>"
)
# They must be these for right results.
ARTICLE_TYPES = ["Article", "NewsArticle", "BlogPosting", "Report", "TechArticle", "ScholarlyArticle", "ReportageNewsArticle"]


def ld_text(x) -> str | None:
    """A text from a JSON-LD value: a string, an object with a value or a name, or the first of a list that has one."""
    if isinstance(x, str):
        return x.strip() or None
    if isinstance(x, list):
        return next((t for t in map(ld_text, x) if t), None)
    if isinstance(x, dict):
        return ld_text(x.get("@value")) or ld_text(x.get("name"))
    return None


def ld_objects(scripts: list[str]) -> list[dict]:
    """The objects of JSON-LD scripts, lists and graphs flattened, malformed scripts left out."""
    found: list = []
    for s in scripts:
        try:
            d = json.loads(s)
        except ValueError:
            continue
        if isinstance(d, dict):
            d = d["@graph"] if isinstance(d.get("@graph"), list) else [d]
        found += d if isinstance(d, list) else []
    return [x for x in found if isinstance(x, dict)]


def article_object(objects: list[dict]) -> dict:
    kinds = lambda o: o.get("@type") if isinstance(o.get("@type"), list) else [o.get("@type")]
    typed = next((o for o in objects if any(isinstance(t, str) and t in ARTICLE_TYPES for t in kinds(o))), None)
    return typed or next((o for o in objects if o.get("headline") or o.get("author")), {})


def ld_text_column(x: Column) -> Column:
    """``ld_text`` of a JSON string."""

    def run(s: pd.Series) -> pd.Series:
        def one(v):
            try:
                return ld_text(json.loads(v)) if v is not None else None
            except ValueError:
                return None

        return s.map(one)

    return F.pandas_udf(run, "string")(x)


def pick(*pairs: tuple[str, Column]) -> Column:
    """struct(value, source) of the first pair with a value that isn't blank."""
    value = F.coalesce(*[blank_to_null(v) for _, v in pairs])
    source = F.lit(None).cast("string")
    for name, v in reversed(pairs):
        source = F.when(blank_to_null(v).isNotNull(), F.lit(name)).otherwise(source)
    return F.struct(value.alias("value"), source.alias("source"))


def abstract_text(index: Column) -> Column:
    """A text from its inverted index {word: places}."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("place"), e["key"].alias("word")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(placed), lambda x: x["word"]), " "), F.lit(""))


def _tail(url: Column) -> Column:
    return F.nullif(F.element_at(F.split(url, "/"), -1), F.lit(""))


def work_graph(raw: Column) -> Column:
    """A scholarly work's JSON as struct(title, abstract, published, venue, authors); null without an id."""
    w = F.from_json(raw, WORK_SCHEMA)
    institutions = lambda a: F.transform(F.coalesce(a["institutions"], F.array()), lambda i: F.struct(i["display_name"].alias("name"), i["ror"].alias("ror"), _tail(i["id"]).alias("openalex_id")))
    authors = F.transform(
        F.filter(F.coalesce(w["authorships"], F.from_json(F.lit("[]"), "array<struct<author: struct<id: string, display_name: string, orcid: string>, institutions: array<struct<id: string, display_name: string, ror: string, country_code: string>>>>")), lambda a: a["author"]["display_name"].isNotNull()),
        lambda a: F.struct(a["author"]["display_name"].alias("name"), _tail(a["author"]["orcid"]).alias("orcid"), _tail(a["author"]["id"]).alias("openalex_id"), institutions(a).alias("institutions")),
    )
    source = w["primary_location"]["source"]
    return F.when(
        w["id"].isNotNull(),
        F.struct(F.coalesce(w["title"], w["display_name"]).alias("title"), abstract_text(w["abstract_inverted_index"]).alias("abstract"), w["publication_date"].try_cast("date").alias("published"), F.struct(source["display_name"].alias("name"), source["type"].alias("type")).alias("venue"), authors.alias("authors")),
    )


_ATOM = "entry array<struct<title: string, summary: string, published: string, author: array<struct<name: string>>>>"


def atom_graph(xml: Column) -> Column:
    """The first entry of an Atom feed as struct(title, abstract, published, authors): names only; null without an entry or a title."""
    clean = lambda x: blank_to_null(F.regexp_replace(x, r"\s+", " "))

    def graph(e: Column) -> Column:
        names = F.filter(F.transform(F.coalesce(e["author"], F.array().cast("array<struct<name: string>>")), lambda a: clean(a["name"])), lambda n: n.isNotNull())
        return F.when(clean(e["title"]).isNotNull(), F.struct(clean(e["title"]).alias("title"), clean(e["summary"]).alias("abstract"), F.left(F.trim(e["published"]), F.lit(10)).try_cast("date").alias("published"), names.alias("authors")))

    return F.get(F.transform(F.slice(F.from_xml(xml, _ATOM)["entry"], 1, 1), graph), F.lit(0))


def model_tags(reply: Column) -> Column:
    """Tags of a model's reply, the text between its first and last brace; null (not none) without a list of tags."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    tags = F.from_json(body, "tags array<struct<label: string, confidence: string>>")["tags"]
    made = F.transform(tags, lambda t: F.struct(clamp_label(t["label"]).alias("label"), clamp_confidence(t["confidence"].try_cast("double")).alias("confidence")))
    return F.slice(F.filter(made, lambda t: t["label"].isNotNull()), 1, MAX_TAGS)


def coerce_authors(authors: Column) -> Column:
    """array<struct(name, confidence)>: clamped, blanks dropped before the cut."""
    made = F.transform(authors, lambda a: F.struct(clamp_name(a["name"]).alias("name"), clamp_confidence(a["confidence"]).alias("confidence")))
    return F.slice(F.filter(made, lambda a: a["name"].isNotNull()), 1, MAX_AUTHORS)


def contract_errors(authors: Column, confidence: Column) -> Column:
    """What breaks the entity contract, as an array of names; empty for a valid row."""
    bad = F.array(
        F.when(F.size(authors) > MAX_AUTHORS, "too-many-authors"),
        F.when(F.exists(authors, lambda a: F.length(a["name"]) > 200), "name-too-long"),
        F.when((confidence < 0) | (confidence > 1), "confidence-out-of-range"),
    )
    return F.filter(bad, lambda x: x.isNotNull())


def mean_confidence(affiliation: Column, authors: Column) -> Column:
    """The mean of an affiliation's and the authors' confidences that are there; 0 if none is."""
    all_ = F.filter(F.concat(F.array(affiliation.cast("double")), F.coalesce(authors, F.array().cast("array<double>"))), lambda x: x.isNotNull())
    return F.when(F.size(all_) > 0, F.aggregate(all_, F.lit(0.0), lambda s, x: s + x) / F.size(all_)).otherwise(0.0)


def header_block(text: Column) -> Column:
    """An embedded mail header block as a map with English lower-case keys."""
    # Labels of header lines in English, French, German and Italian.
    names = {"from": "from", "de": "from", "von": "from", "da": "from", "date": "date", "sent": "date", "envoyé": "date", "datum": "date", "gesendet": "date", "data": "date", "inviato": "date", "subject": "subject", "objet": "subject", "betreff": "subject", "oggetto": "subject", "to": "to", "à": "to", "an": "to", "a": "to", "cc": "cc"}
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^\s*>?\s*\*?[^\s:*]{1,10}\s*:\*?\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(label[F.lower(F.regexp_extract(x, r"^\s*>?\s*\*?([^\s:*]{1,10})\s*:", 1))].alias("k"), F.trim(F.regexp_extract(x, r":\*?\s*(.*)$", 1)).alias("v")))
    known = F.filter(pairs, lambda p: p["k"].isNotNull())
    first = F.filter(known, lambda p, i: F.array_position(F.transform(known, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)
