"""The mix with many rows of one id or none, many sources, and its SQL on a small table."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing

from . import brute

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(rng, n, ids):
    return [(ids(i), " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 40))), "en", rng.choice("aaabbcd") if rng.random() < 0.9 else None, 0) for i in range(n)]


def check(docs, **options):
    got = mixing.mix(docs, **options).collect()
    taken, target, most = {}, {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = most.get(r["source"], 0) + 1
    assert len(got) == docs.count()
    return taken, target


@pytest.mark.parametrize("ids", ["none", "one", "few"])
def test_rows_that_share_an_id(spark, ids):
    rng = random.Random(3)
    rows = rows_of(rng, 900, {"none": lambda i: None, "one": lambda i: 7, "few": lambda i: i % 40}[ids])
    docs = spark.createDataFrame(rows, DDL)
    taken, target = check(docs, bucket_rows=30)
    sizes = {}
    for r in rows:
        sizes.setdefault(r[3], {}).setdefault((r[0], len(brute.words(r[1])) if ids != "none" else r[1]), []).append(r)
    for s in taken:
        assert int(target[s]) - max(map(len, sizes[s].values())) < taken[s] <= int(target[s])
    have = sum(len(brute.words(r["text"])) for r in mixing.mixed_documents(docs, bucket_rows=30).collect())
    assert have == sum(taken.values())
    again = mixing.mix(docs.repartition(5), bucket_rows=500)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.mix(docs, bucket_rows=30).collect()))


def test_rows_of_no_id_are_spread(spark):
    docs = spark.createDataFrame(rows_of(random.Random(4), 600, lambda i: None), DDL)
    assert docs.select(mixing._key(docs).alias("k")).distinct().count() > 300


def test_many_sources(spark):
    rng = random.Random(5)
    sizes = {f"host{k}.net": rng.choice([0, 1, 5, 80, 2000]) for k in range(3000)} | {None: 7}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(6)).collect()}
    want = brute.fixpoint_targets(sizes)
    assert len(got) == 3001 and all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_sql_agrees(spark, tmp_path):
    rows = rows_of(random.Random(6), 500, lambda i: None if i % 50 == 0 else i) + [(900, None, "en", "a", 0), (901, "x y", None, "empty", 3)]
    docs = spark.createDataFrame(rows, DDL)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(mixing.OP8_SQL).fetchall()
    got = mixing.op8_mixing(spark, str(tmp_path)).collect()
    line = lambda r: str((r[0], r[1], int(r[2]), round(r[3], 6), r[4]))
    assert sorted(map(line, got)) == sorted(map(line, want))


def test_texts_are_not_shuffled(spark, tmp_path):
    docs = spark.createDataFrame(rows_of(random.Random(7), 300, lambda i: i), DDL)
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]
    clash = docs.withColumns({c: F.lit("q") for c in ("m_source", "cut_key", "cut_size", "cut_words", "range", "inside", "rank", "epochs", "target", "source_size")})
    assert mixing.mixed_documents(clash).columns == clash.columns and mixing.mix(clash).count() == 300
