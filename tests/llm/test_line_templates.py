import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import line_templates

from . import brute
from .test_operators import HARD, hard, none, prose  # noqa: F401


#: Lines of three tokens and more, fields counted among a template's tokens, as the plain version has it.
COUNTED = {"min_tokens": 3, "words_only": False}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    passage = prose(rng, 70)
    out = []
    for i in range(80):
        lines = [prose(rng, rng.randrange(1, 12)) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            lines.append(f"user login from host{i} at 10.0.{i}.1 by session {rng.choice(['alpha', 'beta', prose(rng, 1)])}")
        if i % 5 == 0:
            lines.insert(0, "  ".join(passage.split()))
        if i % 7 == 0:
            lines.append("Read  more\there please")
        if i % 40 == 1:
            lines.append("twice only in all this corpus")
        out.append((i, "\n".join(lines)))
    return out + [out[0], (500, None), (501, "")]


def test_matches_brute_force(spark, rows):
    gone, mask = brute.templates(rows)
    assert any("user login" in m for m in gone) and any(len(m.split()) == 70 for m in gone) and not any("twice" in m for m in gone)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for d, text in rows:
        lines = (text or "").split("\n")
        out = [x for x in lines if mask(x) in gone]
        n = len(text or "")
        want.append((d, sum(bool(mask(x)) for x in lines), len(out), n, max(0, n - sum(len(x) + 1 for x in out))))
    assert sorted(map(tuple, line_templates.line_templates(docs, **COUNTED).collect())) == sorted(want)
    kept = {r["doc_id"]: r["text"] for r in line_templates.without_templates(docs, **COUNTED).collect()}
    assert all(kept[d] == (None if text is None else "\n".join(x for x in text.split("\n") if mask(x) not in gone)) for d, text in rows)


def test_hard_rows(hard, none):  # noqa: F811
    got = {tuple(r) for r in line_templates.line_templates(hard).collect()}
    assert {(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 0, 0, 4, 4), (4, 1, 0, 4, 4), (None, 1, 0, 21, 21), (5, 1, 0, 60000, 60000)} == got
    assert line_templates.without_templates(hard).columns == hard.columns and line_templates.without_templates(hard).count() == len(HARD)
    assert line_templates.line_templates(none).count() == 0 and line_templates.without_templates(none).count() == 0


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def wanted(rows, gone, mask):
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        drop = [x for x in lines if mask(x) in gone]
        n = len(text or "")
        out.append((d, sum(bool(mask(x)) for x in lines), len(drop), n, max(0, n - sum(len(x) + 1 for x in drop))))
    return sorted(out)


def test_query_drops_short_lines(spark, tmp_path):
    rng = random.Random(22)
    rows = [(i, "\n".join([prose(rng, 9), "Read more", "Menu", "ab cd" if i < 2 else prose(rng, 8)])) for i in range(12)]
    gone, mask = brute.templates(rows, min_tokens=1)
    assert {"Read more", "Menu"} <= gone and "ab cd" not in gone
    got = line_templates.op6_line_templates(spark, documents(spark, tmp_path, rows))
    assert sorted(map(tuple, got.collect())) == wanted(rows, gone, mask)


def test_query_drops_templates_of_fields(spark, tmp_path):
    rng = random.Random(23)
    fields = lambda i: [f"Page {i} of 12", f"Posted {i} March 2024", "Call 555 1234 now", f"Updated: 2024-01-{i} 10:33", "2024-01-02 10:33", f"{i}-7 {i}", f"by {prose(rng, 1)}{i} {'xyz'[i % 3] * (i + 2)} {'abc'[i % 3] * (i + 2)}"]
    prose_lines = [prose(rng, 20) for _ in range(12)]
    rows = [(i, "\n".join([*fields(i), prose_lines[i]])) for i in range(12)]
    got = {r["doc_id"]: r for r in line_templates.op6_line_templates(spark, documents(spark, tmp_path, rows)).collect()}
    assert all(got[i]["n_lines"] == 8 and got[i]["n_dropped"] == 5 for i in range(12))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in line_templates.without_templates(docs).collect()}
    assert all(left[i].split("\n") == [rows[i][1].split("\n")[k] for k in (5, 6, 7)] for i in range(12))


def test_sql_agrees(spark, tmp_path, rows):
    import duckdb

    rng = random.Random(24)
    more = [(900 + i, "\n".join([f"Page {i} of 12", "2024-01-02 10:33", f"{i}-7 {i}", "Menu", f"at {i}@x.org by {prose(rng, 2)}", "<*>", " \t ", prose(rng, 12)])) for i in range(9)]
    folder = documents(spark, tmp_path, [*dict(rows).items(), *more])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = line_templates.op6_line_templates(spark, folder)
    want = con.execute(line_templates.OP6_SQL)
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_marks_that_let_all_lines_pass_change_nothing(spark, rows, monkeypatch):
    from corpusloom.llm import common

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, line_templates.line_templates(docs).collect()))
    monkeypatch.setattr(common.Marks.__init__, "__defaults__", (64,))
    assert sorted(map(str, line_templates.line_templates(docs).collect())) == want


def test_repeated_rows_count_as_one_document(spark, tmp_path):
    """Three rows alike make no word constant and no template recur; with the others' copies the result is that without copies."""
    line = "alpha beta gamma delta"
    once = [(1, f"{line} red"), (2, f"{line} blue"), (3, f"{line} green"), (4, "only in one row"), (5, None)]
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    dropped = lambda rows: sorted({(r["doc_id"], r["n_dropped"]) for r in line_templates.line_templates(docs(rows)).collect()})
    assert dropped(once) == [(1, 1), (2, 1), (3, 1), (4, 0), (5, 0)]
    assert dropped([*once, once[0], once[0], once[3], once[3], once[4]]) == dropped(once)
    left = line_templates.without_templates(docs([*once, once[0], once[3]]).withColumn("key", F.lit(1)))
    assert sorted((r["doc_id"], r["text"], r["key"]) for r in left.where("doc_id < 5").collect()) == [(1, "", 1), (1, "", 1), (2, "", 1), (3, "", 1), (4, "only in one row", 1), (4, "only in one row", 1)]
