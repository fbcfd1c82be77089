import pytest
from pyspark.sql import functions as F

from corpusloom.operators import analytics as A
from corpusloom.operators import catalog as C
from corpusloom.operators import entities as E
from corpusloom.operators import tags as G
from corpusloom.sources import reads as R
from corpusloom.sources import sinks as K
from corpusloom.sources.schemas import TABLES
from corpusloom.streaming import jobs as J


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=str)


def test_reads(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, x string")
    assert R.find_one(df, {"x": "zz"}) is None and R.find_one(df, {"x": None})["id"] == 3
    with pytest.raises(R.NotOne):
        R.find_one(df.union(df), {"id": 1})
    assert R.find_in(df, "id", list(range(2, 2000))).count() == 2 and R.find_in(df, "id", []).count() == 0
    assert R.find_many(df).count() == 3 and all(R.empty(spark, t).count() == 0 for t in TABLES)
    (tmp_path / "k1.html").write_bytes(b"hi")
    got = R.with_blobs(spark.createDataFrame([("k1.html",), ("k2",)], "key string"), "key", R.blobs(spark, str(tmp_path))).collect()
    assert {r["key"]: r["content"] for r in got} == {"k1.html": bytearray(b"hi"), "k2": None}


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "k")], "id int, name string, orcid string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", "k"), (4, "d", None), (4, "e", None)], "id int, name string, orcid string")
    assert rows(K.create_ignore(old, new, (("id",), ("orcid",)), order="name")) == [(1, "a", None), (2, "b", "k"), (4, "d", None)]
    assert rows(K.upsert(old, new.where("id <> 4"), ("id",))) == [(1, "a", None), (2, "B", None), (3, "c", "k")]
    nulls = spark.createDataFrame([(None, "x", None)], old.schema)
    assert K.upsert(old.union(nulls), nulls, ("id",)).count() == 4 and K.upsert(old.union(nulls), nulls, ("id",), nulls_equal=True).count() == 3
    assert rows(K.upsert(old, new.where("id = 2"), ("id",), {"name": F.concat("e.name", "n.name")})) == [(1, "a", None), (2, "bB", "k")]
    assert rows(K.replace_by_key(old, new.where("id = 2"), ("id",)), "id", "name") == [(1, "a"), (2, "B")]
    good, bad = K.check_enum(old, "name", ("a",))
    assert good.count() == 1 and bad.count() == 1


def test_catalog(spark):
    articles = spark.createDataFrame([("a1", "banana", "s1", "u")], "id string, title string, affiliation_id string, canonical_url string")
    papers = spark.createDataFrame([("p1", "Apple", None, "10.1/x")], "id string, title string, affiliation_id string, doi string")
    issues = spark.createDataFrame([("n1", "cherry", "gone")], "id string, subject string, affiliation_id string")
    sources = spark.createDataFrame([("s1", "Mag", "mag")], "id string, name string, slug string")
    authors = spark.createDataFrame([("x", "Ann"), ("y", "Bo")], "id string, name string")
    ships = spark.createDataFrame([("article", "a1", "y", 1), ("article", "a1", "x", 0), ("article", "a1", "zz", 2), ("paper", "a1", "x", 0)], "readable_type string, readable_id string, author_id string, ordinal int")
    items = C.catalog(articles, papers, issues, sources, ships, authors)
    got = items.orderBy(*C.by_title()).collect()
    assert [(r["title"], r["source"]["name"] if r["source"] else None, [a["name"] for a in r["authors"]]) for r in got] == [("Apple", None, []), ("banana", "Mag", ["Ann", "Bo"]), ("cherry", None, [])]
    assert got[0]["url"] == "https://doi.org/10.1/x"
    assert rows(C.of_author(items, ships, "x"), "id") == [("a1",)] and rows(C.contributors(items), "name") == [("Ann",), ("Bo",)]


def test_scores(spark):
    case = lambda *r: spark.createDataFrame(list(r), "golden array<string>, predicted array<string>")
    one = A.set_scores(case((["a", "b", "c"], ["a", "b", "d"]))).first()
    assert (one["tp"], one["fp"], one["fn"]) == (2, 1, 1) and abs(one["f1"] - 2 / 3) < 1e-12
    none = A.set_scores(case((["a"], []))).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    assert A.set_scores(case((["a"], ["a"])).limit(0)).first()["f1"] == 0.0 and A.settle_run(case((["a"], ["a"])).limit(0)).first()["status"] == "failed"
    pairs = spark.createDataFrame([("a", "a"), (None, None), ("a", "b")], "golden string, predicted string")
    assert abs(A.accuracy(pairs).first()["accuracy"] - 2 / 3) < 1e-12 and A.accuracy(pairs.limit(0)).first()["accuracy"] == 0.0


def test_tags(spark):
    vocabulary = spark.createDataFrame([("t1", "rust", [1.0, 0.0, 0.0]), ("t2", "go", [0.0, 1.0, 0.0]), ("t3", "none", None)], "id string, slug string, embedding array<double>")
    asked = spark.createDataFrame([("Rust", None), ("Oxidised", [0.99, 0.14, 0.0]), ("New", [0.0, 0.0, 1.0]), ("Short", [1.0])], "label string, embedding array<double>")
    assert rows(G.resolve_tags(asked, vocabulary), "label", "tag_id", "how") == [("New", "new", "new"), ("Oxidised", "t1", "similar"), ("Rust", "t1", "slug"), ("Short", "short", "new")]
    folded = spark.createDataFrame([("d", 1, "Rust", [1.0, 0.0]), ("d", 2, "rust", None), ("d", 3, "Oxide", [0.99, 0.1]), ("d", 4, "Go", [0.0, 1.0])], "doc string, n int, label string, embedding array<double>")
    assert rows(G.fold_tags(folded, "n"), "label", "tag_id") == [("Go", "go"), ("Oxide", "rust"), ("Rust", "rust"), ("rust", "rust")]
    tags = spark.createDataFrame([("1", "ml", "ML"), ("2", "news", "News"), ("3", "mine", "Mine")], "id string, slug string, label string")
    base = G.baseline(spark.createDataFrame([("1", "article", "a"), ("2", "article", "a")], "tag_id string, readable_type string, readable_id string"), tags)
    items = spark.createDataFrame([("i", "article", "a"), ("j", "article", "b")], "item_id string, readable_type string, readable_id string")
    over = spark.createDataFrame([("i", "2", "suppress"), ("i", "3", "add")], "queue_item_id string, tag_id string, op string")
    got = {r["item_id"]: [t["label"] for t in r["tags"]] for r in G.effective(items, base, over, tags).collect()}
    assert got == {"i": ["ML", "Mine"], "j": []}


def test_entities(spark):
    old = spark.createDataFrame([("ann-lee", "Ann Lee", "ann-lee", "o1", None), ("bo", "Bo", "bo", None, None)], "id string, name string, slug string, orcid string, url string")
    new = spark.createDataFrame([(1, "A. Lee", "o1", "u1"), (2, "Ann Lee", "o2", None), (3, "Bo", "o3", "u3"), (4, "Cy", None, None), (5, "cy", None, "u5"), (6, "Ann Lee", None, None)], "row int, name string, orcid string, url string")
    links, entities = E.resolve(new, old, ("orcid",), ("url",))
    assert rows(links) == [(1, "ann-lee"), (2, "ann-lee-2"), (3, "bo"), (4, "cy"), (5, "cy"), (6, "ann-lee")]
    assert rows(entities, "id", "orcid", "url") == [("ann-lee", "o1", "u1"), ("ann-lee-2", "o2", None), ("bo", "o3", "u3"), ("cy", None, "u5")]


def test_jobs(spark):
    t = lambda s: F.lit(f"2026-01-01 00:{s}").cast("timestamp")
    ddl = "id string, queue_name string, state string, attempts int, run_at string, locked_until string, created_at string"
    raw = [("a", "q", "pending", 0, "00:00", None, "00:00"), ("b", "q", "pending", 0, "30:00", None, "00:00"), ("c", "q", "running", 5, "00:00", "05:00", "00:01"), ("d", "r", "running", 1, "00:00", "50:00", "00:00")]
    jobs = spark.createDataFrame(raw, ddl).withColumns({c: F.to_timestamp(F.concat(F.lit("2026-01-01 00:"), c)) for c in ("run_at", "locked_until", "created_at")}).withColumn("error_class", F.lit(None).cast("string"))
    assert rows(J.claimable(jobs, t("10:00"), 5), "id") == [("a",), ("c",)]
    claimed = J.claim(jobs, t("10:00")).cache()
    a = claimed.where("id = 'a'").first()
    assert (a["state"], a["attempts"]) == ("running", 1)
    outcomes = spark.createDataFrame([("a", 1, False, False, "network"), ("d", 0, True, False, None), ("c", 5, False, False, "x")], "id string, attempts int, ok boolean, fatal boolean, error_class string")
    done = {r["id"]: (r["state"], r["error_class"]) for r in J.settle(claimed, outcomes, t("11:00")).collect()}
    assert done == {"a": ("pending", "network"), "b": ("pending", None), "c": ("failed", "x"), "d": ("running", None)}
    assert str(J.settle(claimed, outcomes, t("11:00")).where("id = 'a'").first()["run_at"]) == "2026-01-01 00:11:10"


ACTIONS = [(1, 1, "enqueue"), (1, 2, "start"), (1, 3, "archive"), (1, 4, "finish"), (2, 1, "enqueue"), (2, 2, "finish"), (2, 3, "enqueue-if-absent"), (3, 1, "enqueue"), (3, 2, "archive"), (3, 3, "enqueue"), (4, 1, "finish")]
STATES = {1: "archived", 2: "read", 3: "unread", 4: None}


def test_item_states(spark):
    df = spark.createDataFrame(ACTIONS, "id int, at int, action string")
    assert {r["id"]: r["state"] for r in J.item_states(df).collect()} == STATES


def test_streams(spark, tmp_path):
    mails = str(tmp_path / "mails")
    spark.createDataFrame([("m", "2026-01-01 00:00:00"), ("m", "2026-01-01 00:01:00"), ("n", "2026-01-01 00:00:00")], "message_id string, t string").select("message_id", F.to_timestamp("t").alias("received_at")).write.parquet(mails)
    q = J.stream_once(spark.readStream.schema("message_id string, received_at timestamp").parquet(mails)).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "a.eml").write_bytes(b"Subject: x\r\n\r\ny")
    J.drain(J.landing(spark, str(tmp_path / "land")), lambda b: b.select("key"), str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
