"""Every query of the library beside its SQL, on the smallest tables."""

import os

import pytest

from corpusloom.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") and hasattr(v, "hour") else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(str(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())
    else:
        assert got


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_pages_by_a_plain_reading(spark):
    """What the page queries say of each page beside regular expressions over its source."""
    import html
    import math
    import re

    pages = {r["page_id"]: (r["url"], r["html"] or "") for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = QUERIES["x1_extract_pages"](spark, FOLDER).collect()
    events = QUERIES["x13_extraction_event"](spark, FOLDER)
    assert sorted(r["page_id"] for r in rows) == sorted(pages) and events.count() == len(pages)
    for r in rows:
        url, source = pages[r["page_id"]]
        lang = re.search(r'(?i)<html[^>]*\blang="([^"]+)"', source)
        assert r["language"] == (lang[1] if lang else None)
        assert r["site"] == re.sub(r"^www\.", "", url.split("//")[1].split("/")[0].lower()) and r["site_url"].startswith(url.split("//")[0])
        if r["title_source"] == "title-tag":
            title = re.search(r"(?is)<title>(.*?)</title>", source)
            assert r["title"] == " ".join(html.unescape(title[1]).split())
        assert r["reading_seconds"] == math.ceil(r["word_count"] / 238 * 60) and 0 <= r["link_density"] <= 1
        n, density, ratio = r["word_count"], r["link_density"], r["page_ratio"]
        assert r["body_confidence"] == (0.2 if n < 50 else 0.3 if density > 0.5 else 0.4 if ratio < 0.05 or ratio > 0.98 else 0.6 if n < 120 else 0.85)
        words = " ".join(html.unescape(re.sub(r"(?s)<[^>]+>", " ", re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", source))).split()).split()
        assert n <= len(words)
