import hashlib
import hmac
import json
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import documents as D
from corpusloom.functions import nested as N
from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.functions import vectors as V


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.sort("i").select(f(F.col("x"))).collect()]


def test_names_and_labels(spark):
    assert values(spark, T.slugify, ["Rust & Go!", None, "--A--", "Éa b"]) == ["rust-go", "", "a", "a-b"]
    assert values(spark, T.sort_name, ["Ada Lovelace", "The Atlantic", "Van Halen", "Smith Jr", "Ada", "ada lovelace", "A B C", None, " Ada  Lovelace "]) == ["Lovelace, Ada", None, None, None, None, None, None, None, "Lovelace, Ada"]
    assert values(spark, T.split_byline, ["By Ann Lee, Bo Ray & Cy Poe", "Sandy Land and Bo; Cy", None, " "]) == [["Ann Lee", "Bo Ray", "Cy Poe"], ["Sandy Land", "Bo", "Cy"], [], []]
    assert values(spark, T.person_like, ["Ann Lee", "Ann", "The Daily News", None, "A B C D E"]) == [True, False, False, False, False]
    assert values(spark, T.strip_html, ["<p>a\n<b>b</b></p>", "<br>", None]) == ["a b", None, None]
    assert values(spark, lambda x: T.reading_seconds(T.count_words(x)), ["a " * 238, "", None]) == [60, 0, 0]
    assert values(spark, T.strip_forward, ["Fwd: FW: TR: hi", "wg:x", "fwd:", "hi"]) == ["hi", "x", None, "hi"]
    assert values(spark, T.site_name, ["a@mail.GOOD.org", "a@local", "none"]) == ["Good", "Local", None]
    assert values(spark, T.plain_to_html, ["a\nb\n\nc<d", None]) == ["<p>a<br>b</p><p>c&lt;d</p>", None]
    assert values(spark, T.csv_set, ["a, b,,a", None]) == [["a", "b"], []]
    assert values(spark, T.title_tags, ["How the Rust borrow-checker works", None]) == [["rust", "borrow"], []]
    assert values(spark, T.venue_type, ["repository", "novel", None]) == ["preprint", "other", "other"]
    assert values(spark, T.clamp_confidence, [2.0, -1.0, None, 0.5], "double") == [1.0, 0.0, 1.0, 0.5]


def test_urls(spark):
    assert values(spark, U.canonicalize, ["HTTP://Ex.COM:80/a?b#c", "https://x.org", "ftp://x", None, "https://x.org:8443/p", "not a url"]) == ["http://ex.com/a?b", "https://x.org/", None, None, "https://x.org:8443/p", None]
    assert values(spark, U.display_host, ["https://www.a.b/x"]) == ["a.b"]
    got = values(spark, U.detect_paper, ["https://arxiv.org/abs/2401.01234v2", "arXiv:hep-th/9901001", "doi:10.1000/ABC.d", "hello", "2401.01234", None])
    assert [tuple(x) if x else None for x in got] == [("arxiv", "2401.01234"), ("arxiv", "hep-th/9901001"), ("doi", "10.1000/abc.d"), None, ("arxiv", "2401.01234"), None]
    days = values(spark, lambda x: U.parse_temporal(x).cast("string"), ["2026-05-14T09:30:00+02:00", "2026-03-02", "not a date", "09:30:00", None])
    assert days == ["2026-05-14 07:30:00", "2026-03-02 00:00:00", None, None, None]
    assert values(spark, U.backoff_seconds, [1, 2, 5], "int") == [10, 20, 160]
    addresses = {"10.1.2.3": True, "8.8.8.8": False, "::1": True, "::ffff:192.168.0.1": True, "64:ff9b::a00:1": True, "2002:7f00:1::": True, "fd00::1": True, "2606:4700::1": False, "100.64.0.1": True, "169.254.1.1": True, "224.0.0.1": True, "x": None}
    assert values(spark, U.is_private_address, list(addresses)) == list(addresses.values())
    sign = hmac.new(b"k", b"m", hashlib.sha256).hexdigest()
    assert values(spark, lambda x: U.signature_valid(F.lit("k"), F.lit("m"), x), [sign, sign.upper(), "0", None]) == [True, True, False, False]
    row = spark.range(1).select(U.fetch_class(F.lit(404), F.lit("text/html"), F.lit(0), F.lit(False)), U.fetch_class(F.lit(200), F.lit("image/png"), F.lit(0), F.lit(False)), U.fetch_class(F.lit(200), F.lit("text/html; x"), F.lit(0), F.lit(False)), U.fetch_class(F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(6), F.lit(False))).first()
    assert tuple(row) == ("http-status", "not-html", None, "too-many-redirects")


def test_nested(spark):
    assert [N.ld_text(x) for x in (" a ", {"@value": "b"}, [{"x": 1}, {"name": "c"}], 3, "")] == ["a", "b", "c", None, None]
    work = {"id": "https://openalex.org/W1", "title": None, "display_name": "T", "publication_date": "2020-01-02", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "primary_location": {"source": {"display_name": "J", "type": "journal"}}, "authorships": [{"author": {"id": "https://openalex.org/A5", "display_name": "Ann", "orcid": "https://orcid.org/0-1"}, "institutions": [{"display_name": "U", "ror": "r"}]}]}
    got = values(spark, N.work_graph, [json.dumps(work), json.dumps({"title": "x"}), "broken"])
    assert (got[0]["title"], got[0]["abstract"], str(got[0]["published"]), got[0]["venue"]["name"], got[0]["authors"][0]["orcid"], got[0]["authors"][0]["openalex_id"]) == ("T", "a b a", "2020-01-02", "J", "0-1", "A5")
    assert got[1] is None and got[2] is None
    tags = values(spark, N.model_tags, ['text {"tags": [{"label": " Rust ", "confidence": 3}, {"label": " "}, {"label": "Go"}]} end', "none", '{"tags": []}', '{"x": 1}'])
    assert [[tuple(t) for t in x] if x is not None else None for x in tags] == [[("rust", 1.0), ("go", 1.0)], None, [], None]
    atom = "<feed><title>q</title><entry><title> A\n b</title><summary>s</summary><published>2021-02-03T00:00:00Z</published><author><name>Ann</name></author><author><name>Bo</name></author></entry></feed>"
    x = values(spark, N.atom_graph, [atom])[0]
    assert (x["title"], x["abstract"], str(x["published"]), x["authors"]) == ("A b", "s", "2021-02-03", ["Ann", "Bo"])
    hard = '<feed xmlns="http://www.w3.org/2005/Atom"><author><name>The feed</name></author><entry><title type="html">A &amp;amp; B &lt;x&gt;</title><published>no date</published><author><name>Zo&#233; &amp; Co</name></author><author><name> </name></author></entry><entry><title>2</title><author><name>Other</name></author></entry></feed>'
    x, *none = values(spark, N.atom_graph, [hard, "<feed></feed>", "nope <", None, "<feed><entry><title> </title></entry></feed>"])
    assert (x["title"], x["abstract"], x["published"], x["authors"]) == ("A &amp; B <x>", None, None, ["Zoé & Co"]) and none == [None] * 4
    assert values(spark, N.header_block, ["De : Ann <a@b>\nObjet : Hi\nnothing"]) == [{"from": "Ann <a@b>", "subject": "Hi"}]
    assert values(spark, lambda x: N.mean_confidence(x, F.array(F.lit(0.5), F.lit(None).cast("double"))), [0.9, None], "double") == [0.7, 0.5]


def test_cosine(spark):
    rows = [([1.0, 0.0, 0.0], [2.0, 0.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [-1.0], -1.0), ([], [], 0.0), ([0.0], [1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), (None, [1.0], 0.0)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a array<double>, b array<double>").sort("i").select(V.cosine(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [x[2] for x in rows]
    vectors = values(spark, V.hashed_embedding, ["a b, A-c9!", "", None])
    assert [sum(v) for v in vectors] == [4.0, 0.0, 0.0] and max(vectors[0]) >= 2.0 and {len(v) for v in vectors} == {64}
    assert all(vectors[0][zlib.crc32(w.encode()) % 64] >= 1 for w in ("a", "b", "c9"))


PAGE = """<html lang="en"><head><title>Tag title</title><link rel="canonical" href="https://n.example/a"><meta property="og:site_name" content="News"><meta property="og:url" content="https://n.example/og">
<script type="application/ld+json">{"@graph": [{"@type": "WebSite", "name": "S"}, {"@type": "NewsArticle", "headline": "LD title", "datePublished": "2026-05-14T09:30:00Z", "author": [{"name": "Ann Lee"}, "Bo Ray"]}]}</script>
<script type="application/ld+json">{broken</script></head><body><nav>Menu menu</nav><article><p>%s</p><a href="x">link</a></article><footer>foot</footer></body></html>""" % ("word " * 130)


def test_pages(spark):
    rows = [(1, PAGE, "https://www.n.example/x"), (2, "<title>untitled</title>", "http://h.example/p"), (3, None, None)]
    got = D.extract_pages(spark.createDataFrame(rows, "page_id int, html string, url string")).sort("page_id").collect()
    a, b, c = got
    assert tuple(a["title"]) == ("LD title", "json-ld") and str(a["published"]["value"]) == "2026-05-14 09:30:00" and tuple(a["language"]) == ("en", "html-lang")
    assert tuple(a["canonical_url"]) == ("https://n.example/a", "canonical") and tuple(a["site"]) == ("News", "og")
    assert [x["name"] for x in a["authors"]] == ["Ann Lee", "Bo Ray"] and a["authors"][0]["confidence"] == 0.95
    assert a["word_count"] == 131 and a["body_confidence"] == 0.85 and "Menu" not in a["text"] and "foot" not in a["text"]
    assert tuple(b["title"]) == ("untitled", "title-tag") and tuple(b["site"]) == ("h.example", "domain") and b["body_confidence"] == 0.2 and b["published"]["value"] is None
    assert c["title"]["value"] is None and c["authors"] == []


def mail(subject, body, kind="text/plain", extra=""):
    return f"From: Ann Lee <Ann@News.example>\r\nSubject: {subject}\r\nDate: Tue, 5 May 2026 10:00:00 +0200\r\nMessage-ID: <m1@x>\r\n{extra}Content-Type: {kind}; charset=utf-8\r\n\r\n{body}".encode()


def test_mail(spark):
    forwarded = "---------- Forwarded message ---------\nFrom: Bo Ray <bo@letters.example>\nDate: Mon, 4 May 2026 08:00:00 +0000\nSubject: Real subject\nTo: me@x\n\nThe body."
    rich = '<p onclick="x()">Hi <script>bad()</script><a href="javascript:x">l</a><img src="https://t/x.gif" width="1" height="1"><img src="https://t/y.png"></p>'
    attached = b'From: a@b.example\r\nSubject: Fwd: x\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nsee\r\n--B\r\nContent-Type: message/rfc822\r\n\r\nFrom: Cy Poe <cy@c.example>\r\nSubject: Inner\r\nContent-Type: text/plain\r\n\r\ninner body\r\n--B--\r\n'
    rows = [(1, mail("Fwd: Real subject", forwarded)), (2, mail("Hello", rich, "text/html", "List-Unsubscribe: <mailto:u@x>, <https://x/u>\r\n")), (3, mail("Re: Fwd not", forwarded)), (4, attached), (5, None)]
    got = {r["i"]: r for r in D.parse_mails(spark.createDataFrame(rows, "i int, raw binary"), keep=("i",)).collect()}
    assert (got[1]["forwarded"], got[1]["subject"], got[1]["from_email"], got[1]["body_html"], got[1]["message_id"]) == (True, "Real subject", "bo@letters.example", "<p>The body.</p>", "<m1@x>")
    assert got[2]["unsubscribe_url"] == "https://x/u" and "bad" not in got[2]["body_html"] and "x.gif" not in got[2]["body_html"] and "y.png" in got[2]["body_html"] and "javascript" not in got[2]["body_html"]
    assert got[2]["authors"][0]["name"] == "Ann Lee" and got[2]["authors"][0]["source"] == "sender-header" and str(got[2]["sent_at"]) == "2026-05-05 08:00:00"
    assert not got[3]["forwarded"] and got[3]["from_email"] == "ann@news.example"
    assert (got[4]["subject"], got[4]["from_name"], got[4]["forward_kind"]) == ("Inner", "Cy Poe", "rfc822")
    assert got[5]["subject"] is None
    assert D.clean_html('<math><mi>x</mi></math><a href="https://p/a#s">s</a>', "https://p/a") == '<math><mi>x</mi></math><a href="#s">s</a>'


def test_fresh_to_fractions_of_a_second(spark):
    now = F.lit("2024-01-15").cast("timestamp")
    times = ["2024-01-14 23:55:00", "2024-01-14 23:54:59.5", "2024-01-14 23:55:00.5", "2024-01-15 00:04:59.999999", "2024-01-15 00:05:00", "2024-01-15 00:05:00.000001", None]
    fresh = lambda **how: values(spark, lambda x: U.is_fresh(now, x.cast("timestamp"), 300, **how), times)
    assert fresh() == [True, False, True, True, True, False, False]
    assert fresh(whole=False) == [False, False, True, True, False, False, False]


def test_few_pages_are_objects_at_a_time(monkeypatch):
    class Page(dict):
        live = most = 0

        def __init__(self, fields):
            super().__init__(fields)
            Page.live += 1
            Page.most = max(Page.most, Page.live)

        def __del__(self):
            Page.live -= 1

    plain = D._page
    monkeypatch.setattr(D, "_page", lambda source: Page(plain(source)))
    source = '<html lang="en"><head><title>T</title><meta name="a" content="b"></head><body><p>one</p></body></html>'
    got = D._signals(pa.array([source, None] * 500)).to_pylist()
    assert len(got) == 1000 and Page.most <= 2 * D.PAGES_AT_ONCE
    assert (got[0]["title_tag"], got[0]["html_lang"], got[0]["meta"], got[998]["text"], got[999]["text"], got[999]["meta"]) == ("T", "en", [("a", "b")], "one", "", [])
