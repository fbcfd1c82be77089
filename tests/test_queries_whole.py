"""Queries over whole tables beside their SQL, on tables where left-out rows and empty joins would tell."""

import os

import pytest

from corpusloom.plans.queries import ORACLE_SQL, QUERIES

from .test_queries import TABLES, plain

FOLDER = "/root/testdata/sf0.01"
#: Queries whose proxies once never met, or read a part of their tables; no column of theirs may be one value throughout.
TELLING = {
    "u2_effective_tags": ["labels"], "p7_with_tag": ["item_id"], "u5_distinct_tags": ["slug", "label"], "o1_title_order": ["title", "type"], "o2_author_order": ["name"], "o4_queue_of_user": ["title"], "f2_sort_name": ["sort_name"],
    "j16_titles": ["title"], "o6_tagging_queue": ["avg_confidence"], "u1_catalog": ["byline", "n_authors"], "j4_baseline": ["labels"], "u5_contributors": ["name"], "v3_resolve_tags": ["tag_id"], "v8_resolve_entity": ["id"], "t9_queue_state": ["state"], "v5_set_embedding": ["vec_id"],
}


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(TELLING))
def test_whole_query(spark, duck, name):
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    rows = QUERIES[name](spark, FOLDER).select(*names).collect()
    assert sorted(str(tuple(map(plain, r))) for r in rows) == sorted(str(tuple(map(plain, r))) for r in cur.fetchall())
    for c in TELLING[name]:
        assert len({r[c] for r in rows} - {None}) > 1
    if name == "u2_effective_tags":
        assert len(rows) == duck.execute("SELECT count(*) FROM orders WHERE o_orderstatus <> 'P'").fetchone()[0]
        assert "" in {r["labels"] for r in rows} and any("," in r["labels"] for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_scores_are_not_trivial(spark):
    for name in ("a16_tagging_score", "a16_extraction_score", "a14_set_scores"):
        r = QUERIES[name](spark, FOLDER).first()
        assert 0 < r["precision"] < 1 and 0 < r["recall"] < 1 and r["n"] > 100
    assert QUERIES["a11_tagging_progress"](spark, FOLDER).first()["low_confidence"] > 0
