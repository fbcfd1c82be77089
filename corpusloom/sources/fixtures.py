"""A small coherent set of all logical tables: what one table refers to is in another, but for the gaps that queries have to bear."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as K

from .schemas import TABLES


def _at(day: int, hour: int = 8) -> datetime.datetime:
    return datetime.datetime(2026, 3, day, hour)


def _rows() -> dict[str, list[dict]]:
    """Rows by table; columns that are not named are null."""
    authors = [("ann", "Ann Lee", "0001"), ("bo", "Bo Ray", "0002"), ("cy", "Cy Poe", None), ("di", "Di Van Os", None)]
    sources = [("mag", "The Magazine", "magazine"), ("let", "A Letter", "newsletter"), ("jou", "Journal of Things", "journal"), ("uni", "A University", "institution")]
    articles = [("a1", "On rivers", "mag", "https://mag.example/1", 0.85), ("a2", "On stones", "mag", "https://mag.example/2", 0.4), ("a3", "Without a source", None, "https://other.example/3", 0.85)]
    papers = [("p1", "Rivers, measured", "jou", "10.1/rivers", None), ("p2", "Stones, weighed", None, None, "2601.00001")]
    issues = [("n1", "Issue 1", "let", "<n1@let>"), ("n2", "Issue 2", "let", "<n2@let>")]
    readables = [("article", a[0]) for a in articles] + [("paper", p[0]) for p in papers] + [("newsletter", n[0]) for n in issues]
    tags = [("t1", "rivers", [1.0, 0.0]), ("t2", "stones", [0.0, 1.0]), ("t3", "travel", None)]
    tagged = [("t1", "article", "a1", 0.9), ("t3", "article", "a1", 0.5), ("t2", "article", "a2", 0.7), ("t1", "paper", "p1", 0.8), ("t1", "newsletter", "n1", 0.6)]
    queue = [(f"q{k}", ("u1", "u2")[k % 2], *r, ("unread", "reading", "read", "archived")[k % 4], _at(1 + k)) for k, r in enumerate([*readables, ("article", "gone")])]
    events = [("https://mag.example/1", "done", None, 300, 0.85, 1), ("https://mag.example/2", "failed", "network", None, None, 1), ("https://mag.example/2", "done", None, 80, 0.4, 2), ("https://other.example/3", "done", None, 200, 0.85, 2), ("https://lost.example/4", "failed", "http-status", None, None, 3)]
    row = lambda names, values: dict(zip(names.split(), values, strict=True))
    return {
        "users": [row("id email hanko_id", x) for x in (("u1", "one@home.example", "h1"), ("u2", "two@home.example", None))],
        "email_inboxes": [row("alias user_id created_at", x) for x in (("brown-river", "u1", _at(1)), ("green-stone", "u2", _at(2)))],
        "authors": [row("id name slug orcid", (i, n, n.lower().replace(" ", "-"), o)) for i, n, o in authors],
        "affiliations": [row("id name slug type", (i, n, n.lower().replace(" ", "-"), t)) for i, n, t in sources],
        "author_affiliations": [row("author_id affiliation_id is_primary", x) for x in (("ann", "uni", True), ("bo", "uni", False))],
        "newsletter_sources": [row("affiliation_id sender", ("let", "editor@let.example"))],
        "newsletter_source_aliases": [row("alias affiliation_id", x) for x in (("editor@let.example", "let"), ("@let.example", "let"))],
        "articles": [row("id title affiliation_id canonical_url body_confidence", x) | {"fetched_on": _at(1).date(), "body_html": f"<p>{x[1]}</p>", "word_count": 300, "extraction_version": 3} for x in articles],
        "papers": [row("id title affiliation_id doi arxiv_id", x) | {"abstract": f"About {x[1].lower()}."} for x in papers],
        "newsletter_issues": [row("id subject affiliation_id message_id", x) | {"body_html": f"<p>{x[1]}</p>", "extraction_version": 3, "is_forwarded": x[0] == "n2"} for x in issues],
        "authorships": [row("readable_type readable_id author_id ordinal", x) for x in (("article", "a1", "bo", 1), ("article", "a1", "ann", 0), ("article", "a2", "cy", 0), ("paper", "p1", "ann", 0), ("paper", "p1", "gone", 1), ("newsletter", "n1", "di", 0))],
        "queue_items": [row("id user_id readable_type readable_id state added_at", x) for x in queue],
        "jobs": [row("id queue_name payload state attempts run_at created_at", (f"j{k}", ("import", "tag")[k % 2], '{"id": "%s"}' % i, ("pending", "done", "failed")[k % 3], k % 3, _at(1 + k), _at(1 + k))) for k, (_, i) in enumerate(readables)],
        "extraction_events": [row("url outcome error_class word_count body_confidence", x[:5]) | {"domain": x[0].split("/")[2], "fetch_ms": 10 * k, "extract_ms": 20 * k, "title_source": "og" if x[1] == "done" else None, "created_at": _at(x[5], 8 + k)} for k, x in enumerate(events)],
        "tags": [row("id slug label embedding", (i, s, s.capitalize(), e)) for i, s, e in tags],
        "readable_tags": [row("tag_id readable_type readable_id confidence", x) for x in tagged],
        "queue_item_tags": [row("queue_item_id tag_id op", x) for x in (("q0", "t3", "suppress"), ("q0", "t2", "add"), ("q3", "t3", "add"))],
        "readable_embeddings": [row("readable_type readable_id embedding", (*r, [float(k), 1.0])) for k, r in enumerate(readables)],
        "tagging_events": [row("readable_type readable_id outcome created_at", (*r, "failed" if k == 2 else "done", _at(4, 8 + k))) | {"tag_count": 0 if k == 2 else 2, "duration_ms": 100 + k, "model": "m"} for k, r in enumerate(readables)],
        "eval_labels": [
            {"id": "l1", "feature": "tagging", "readable_type": "article", "readable_id": "a1", "label": '{"tags": ["rivers", "stones"]}', "labeled_by": "u1"},
            {"id": "l2", "feature": "extraction", "subject_url": "https://mag.example/1", "label": '{"authors": ["ann-lee", "bo-ray"], "source": "the-magazine"}', "labeled_by": "u1"},
            {"id": "l3", "feature": "extraction", "subject_url": "https://mag.example/2", "label": '{"authors": ["ann-lee"], "source": null}', "labeled_by": "u2"},
        ],
        "eval_runs": [row("id feature status tp fp fn n", ("r1", "tagging", "done", 1, 1, 1, 1))],
        "eval_run_results": [row("run_id readable_type readable_id proposed", ("r1", "article", "a1", ["rivers", "travel"]))],
    }


def seed_all(spark: SparkSession) -> dict[str, DataFrame]:
    """Every logical table by name, with its declared columns and types."""
    rows = _rows()
    out = {}
    for name, table in TABLES.items():
        schema = K.StructType.fromDDL(table.ddl)
        out[name] = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows[name]], schema)
    return out
