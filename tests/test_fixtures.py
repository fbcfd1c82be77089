"""The seeded tables fit together, and the operators give on them what one can count by hand."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import analytics as A
from corpusloom.operators import catalog as C
from corpusloom.operators import tags as G
from corpusloom.sources.fixtures import _rows, seed_all
from corpusloom.sources.schemas import TABLES


@pytest.fixture(scope="module")
def seeded(spark):
    return seed_all(spark)


def test_keys_and_columns(seeded):
    assert set(seeded) == set(TABLES)
    for name, rows in _rows().items():
        assert {c for r in rows for c in r} <= set(seeded[name].columns)
        for key in TABLES[name].keys:
            found = [tuple(r.get(k) for k in key) for r in rows]
            whole = found if TABLES[name].nulls_equal else [k for k in found if None not in k]
            assert len(set(map(str, whole))) == len(whole), (name, key)


def test_catalogue_and_queue(seeded):
    t = seeded
    items = C.catalog(t["articles"], t["papers"], t["newsletter_issues"], t["affiliations"], t["authorships"], t["authors"])
    got = {r["id"]: (r["source"]["name"] if r["source"] else None, [a["name"] for a in r["authors"]]) for r in items.collect()}
    assert got["a1"] == ("The Magazine", ["Ann Lee", "Bo Ray"]) and got["a3"] == (None, []) and got["p1"] == ("Journal of Things", ["Ann Lee"]) and len(got) == 7
    assert {r["item_id"] for r in C.reading_queue(t["queue_items"], items).collect()} == {"q0", "q1", "q2", "q4", "q5", "q6"}
    assert [r["id"] for r in C.orphans(t["queue_items"], items).collect()] == ["q7"]
    assert [r["name"] for r in C.source_list(t["affiliations"]).orderBy(*C.by_name()).collect()] == ["A Letter", "Journal of Things", "The Magazine"]
    base = G.baseline(t["readable_tags"], t["tags"])
    mine = t["queue_items"].select(F.col("id").alias("item_id"), "readable_type", "readable_id")
    tags = {r["item_id"]: [x["slug"] for x in r["tags"]] for r in G.effective(mine, base, t["queue_item_tags"], t["tags"]).collect()}
    assert tags["q0"] == ["rivers", "stones"] and tags["q3"] == ["rivers", "travel"] and tags["q2"] == []


def test_figures(seeded):
    t = seeded
    o = A.overview(t["extraction_events"]).first()
    assert (o["total"], o["done"], o["failed"], o["low_confidence"]) == (5, 3, 2, 1)
    r = A.recovery(t["extraction_events"], t["articles"]).first()
    assert (r["failed_urls"], r["recovered"]) == (2, 1)
    s = A.tagging_score(t["eval_labels"], t["readable_tags"], t["tags"]).first()
    assert (s["tp"], s["fp"], s["fn"], s["labeled"]) == (1, 1, 1, 1)
    s = A.extraction_score(t["eval_labels"], t["articles"], t["authorships"], t["authors"], t["affiliations"]).first()
    assert (s["tp"], s["fp"], s["fn"], s["source_accuracy"]) == (2, 1, 1, 0.5)
    assert A.tagging_progress(t["tagging_events"], t["eval_labels"], t["readable_tags"]).first().asDict() == {"total": 7, "labeled": 1, "failed": 1, "low_confidence": 0}
