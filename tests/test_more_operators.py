"""Entities, upserts, workers, model calls and streams where round numbers and nulls mislead."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import models, nested, urls
from corpusloom.operators import analytics as A
from corpusloom.operators import catalog as C
from corpusloom.operators import content as B
from corpusloom.operators import entities as E
from corpusloom.sources import reads as R
from corpusloom.sources import sinks as K
from corpusloom.streaming import jobs as J

from .test_operators import rows

OLD = "id string, name string, slug string, orcid string, alex string, url string"
NEW = "row int, name string, orcid string, alex string, url string"


def resolved(spark, new, old=()):
    links, entities = E.resolve(spark.createDataFrame(list(new), NEW), spark.createDataFrame(list(old), OLD), ("orcid", "alex"), ("url",))
    got = rows(entities, "id", "slug", "orcid", "alex", "url")
    assert len({r[1] for r in got}) == len(got) == len({r[0] for r in got})
    return dict(rows(links)), {r[0]: r[2:] for r in got}


def test_first_free_number(spark):
    old = [("x", "X", "x", "o1", None, None), ("x-3", "X 3", "x-3", None, None, None), ("area-51", "Area 51", "area-51", "o2", None, None)]
    new = [(1, "X", "o9", None, None), (2, "X", "o8", None, None), (3, "Area 51", "o7", None, None), (4, "X", "o1", None, "u"), (5, "x", None, None, None)]
    links, entities = resolved(spark, new, old)
    assert links == {1: "x-2", 2: "x-4", 3: "area-51-2", 4: "x", 5: "x"} and entities["x"] == ("o1", None, "u")


def test_rows_of_a_batch_meet(spark):
    new = [(1, "Dana", None, None, None), (2, "Dana", "o1", None, "u"), (3, "Dana", "o2", None, None), (4, "D. Ana", "o1", "a1", None), (5, "Other", None, "a1", None), (6, "dana", None, None, None), (7, "Dana 2", None, None, None)]
    links, entities = resolved(spark, new)
    assert links == {1: "dana", 2: "dana", 3: "dana-3", 4: "dana", 5: "dana", 6: "dana", 7: "dana-2"}
    assert entities["dana"] == ("o1", "a1", "u") and entities["dana-3"] == ("o2", None, None)
    links, entities = resolved(spark, [(1, "Ann", "o1", None, None), (2, "Ann", None, "a2", None), (3, "Ann", "o3", None, None), (4, "Ann", None, "a4", None)])
    assert links == {1: "ann", 2: "ann", 3: "ann-2", 4: "ann-3"} and entities["ann"] == ("o1", "a2", None)


def test_upserts_of_one_key(spark):
    old = spark.createDataFrame([(1, "a", 1)], "id int, name string, n int")
    new = spark.createDataFrame([(1, "z", 1), (1, "b", 2), (2, "c", 1), (2, "d", 0), (None, "e", 1), (None, "e", 1)], old.schema)
    assert rows(K.upsert(old, new, ("id",), order="n")) == [(1, "b", 2), (2, "c", 1), (None, "e", 1), (None, "e", 1)]
    assert rows(K.upsert(old, new, ("id",), nulls_equal=True), "id", "name") == [(1, "z"), (2, "d"), (None, "e")]
    assert rows(K.create_ignore(old, new.where("id = 2").repartition(3), (("id",),)), "name") == [("a",), ("c",)]


def test_json_equality(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": [1, 2]}'), (2, '{"b":[1,2],"a":1}'), (3, '{"a":1,"b":[2,1]}'), (4, "no json"), (5, None)], "id int, payload string")
    assert rows(R.find_many(df, {"payload": {"b": [1, 2], "a": 1}}), "id") == [(1,), (2,)]


NOW = datetime.datetime(2026, 1, 1, 1)


def jobs_of(spark, *pairs):
    late = NOW - datetime.timedelta(hours=1)
    new = spark.createDataFrame([(i, q, p, late) for i, q, p in pairs], "id string, queue_name string, payload string, run_at timestamp")
    none = spark.createDataFrame([], "id string, queue_name string, payload string, state string, attempts int, run_at timestamp, locked_until timestamp, error_class string, created_at timestamp")
    return J.enqueue(none, new, F.lit(late))


def handle(payload):
    if payload == "bad":
        raise J.Fatal("no", "not-html")
    if payload == "flaky":
        raise ValueError("later")


def test_worker_passes(spark, tmp_path):
    jobs = jobs_of(spark, ("a1", "a", "ok"), ("a2", "a", "bad"), ("b1", "b", "flaky"), ("c1", "c", "ok"))
    states = []
    for k in range(2):
        jobs = J.run_pass(jobs, {"a": handle, "b": handle}, F.lit(NOW), str(tmp_path / str(k)))
        states.append({r["id"]: (r["state"], r["attempts"], r["error_class"]) for r in jobs.collect()})
    assert states[0] == {"a1": ("done", 1, None), "a2": ("pending", 0, None), "b1": ("pending", 1, "ValueError"), "c1": ("pending", 0, None)}
    assert states[1]["a2"] == ("failed", 1, "not-html") and states[1]["b1"] == states[0]["b1"]  # still waits
    late = J.run_pass(jobs, {"b": lambda p: None}, F.lit(NOW + datetime.timedelta(days=1)), str(tmp_path / "late"))
    assert {r["id"]: r["state"] for r in late.collect()} == {"a1": "done", "a2": "failed", "b1": "done", "c1": "pending"}


def test_a_pass_on_a_moving_clock_runs_what_it_claimed(spark, tmp_path):
    """A job that falls due while the pass goes on is neither run nor counted."""
    jobs = jobs_of(spark, ("a", "a", "ok"), ("b", "b", "bad"))
    soon = F.when(F.col("id") == "b", F.lit(datetime.datetime.now(datetime.UTC) + datetime.timedelta(seconds=6))).otherwise(F.col("run_at"))
    jobs = jobs.withColumn("run_at", soon)
    slow = lambda p: time.sleep(8)
    out = J.run_pass(jobs, {"a": slow, "b": handle}, F.current_timestamp(), str(tmp_path / "pass"), 5)
    assert {r["id"]: (r["state"], r["attempts"]) for r in out.collect()} == {"a": ("done", 1), "b": ("pending", 0)}
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "pass/outcomes")).collect()] == ["a"]


def test_postponed_and_stale(spark):
    jobs = J.claim(jobs_of(spark, ("a", "q", "x")), F.lit(NOW))
    back = J.postpone(jobs, F.col("id") == "a", F.lit(NOW)).first()
    assert (back["state"], back["attempts"], back["run_at"]) == ("pending", 0, NOW + datetime.timedelta(seconds=300))
    results, current = spark.createDataFrame([("r", 1), ("s", 2)], "id string, version int"), spark.createDataFrame([("r", 2), ("s", 2)], "id string, version int")
    assert rows(J.drop_stale(results, current, "id"), "id") == [("s",)]


def test_model_calls(spark):
    def call(prompts):
        if "refused" in prompts:
            raise models.failure_of(401)
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "refused")], "id int, prompt string").coalesce(1)
    got = {r["id"]: (r["reply"], r["error_class"], r["fatal"]) for r in models.complete(df, "prompt", call, batch=1).collect()}
    assert got == {1: ("A", None, None), 2: (None, None, None), 3: ("B", None, None), 4: (None, "model-auth", True)}
    got = models.embed(df.where("id < 4"), "prompt", lambda texts: [[len(t), 1] for t in texts]).collect()
    assert [r["embedding"] for r in got] == [[1.0, 1.0], None, [1.0, 1.0]]
    short = models.complete(df.where("id = 1"), "prompt", lambda p: []).first()
    assert short["error_class"] == "model-reply" and models.complete(df.limit(0), "prompt", call).count() == 0
    assert [getattr(models.failure_of(s), "error_class", None) for s in (None, 200, 403, 500)] == ["model-transport", None, "model-auth", "model-status"]


def test_production_scores(spark):
    labels = spark.createDataFrame([("tagging", "article", "1", None, '{"tags": ["a", "b"]}'), ("tagging", "article", "2", None, '{"tags": []}'), ("tagging", "paper", "9", None, "broken"), ("extraction", None, None, "u1", '{"authors": ["ann", "bo"], "source": "mag"}'), ("extraction", None, None, "u2", '{"authors": [], "source": null}')], "feature string, readable_type string, readable_id string, subject_url string, label string")
    tags = spark.createDataFrame([("t1", "a"), ("t2", "c")], "id string, slug string")
    now = spark.createDataFrame([("t1", "article", "1"), ("t2", "article", "1"), ("t2", "article", "2")], "tag_id string, readable_type string, readable_id string")
    r = A.tagging_score(labels, now, tags).first()
    assert (r["tp"], r["fp"], r["fn"], r["labeled"]) == (1, 2, 1, 3)
    articles = spark.createDataFrame([("a1", "u1", "s1")], "id string, canonical_url string, affiliation_id string")
    ships = spark.createDataFrame([("article", "a1", "x"), ("article", "a1", "y"), ("paper", "a1", "z")], "readable_type string, readable_id string, author_id string")
    authors = spark.createDataFrame([("x", "ann"), ("y", "cy"), ("z", "zed")], "id string, slug string")
    r = A.extraction_score(labels, articles, ships, authors, spark.createDataFrame([("s1", "mag")], "id string, slug string")).first()
    assert (r["tp"], r["fp"], r["fn"], r["labeled"], r["source_accuracy"]) == (1, 1, 1, 2, 1.0)
    assert A.tagging_score(labels.limit(0), now, tags).first()["labeled"] == 0


def test_sources_and_addresses(spark):
    kinds = spark.createDataFrame([("1", "beta", "blog"), ("2", "Alpha", "journal"), ("3", "Uni", "institution")], "id string, name string, type string")
    assert [r["name"] for r in C.source_list(kinds).orderBy(*C.by_name()).collect()] == ["Alpha", "beta"]
    private = ["127.0.0.1", "10.1.2.3", "::1", "::ffff:10.0.0.1", "64:ff9b::a00:1", "2002:a00:1::", "fd00::1", "fec0::1", "fe80::1", "224.0.0.1", "0.0.0.0", "[::1]", "100.64.0.1"]
    public = ["8.8.8.8", "2001:4860:4860::8888", "::ffff:8.8.8.8", "2002:808:808::", "172.32.0.1"]
    df = spark.createDataFrame([(a, True) for a in private] + [(a, False) for a in public] + [("x", None), (None, None)], "a string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", urls.is_private_address(F.col("a"))).collect())


def test_small_functions(spark, tmp_path):
    one = spark.range(1)
    authors = F.array(F.struct(F.lit("  Ann  ").alias("name"), F.lit(7.0).alias("confidence")), F.struct(F.lit(" ").alias("name"), F.lit(0.5).alias("confidence")))
    assert [tuple(a) for a in one.select(nested.coerce_authors(authors)).first()[0]] == [("Ann", 1.0)]
    assert one.select(nested.contract_errors(F.transform(F.sequence(F.lit(1), F.lit(51)), lambda i: F.struct(F.repeat(F.lit("x"), 201).alias("name"))), F.lit(1.5))).first()[0] == ["too-many-authors", "name-too-long", "confidence-out-of-range"]
    assert [one.select(E.enrich_name(F.lit(a), F.lit("Mail"), F.lit(b).cast("string"))).first()[0] for a, b in (("Mail", "The Mag"), ("Mail", None), ("Mine", "The Mag"))] == ["The Mag", "Mail", "Mine"]
    df = spark.createDataFrame([("k", b"1")], "key string, content binary")
    for _ in range(2):
        K.put_blobs(df, str(tmp_path / "blobs"))
        K.append_events(df.select("key"), str(tmp_path / "events"))
    assert K.stored_blobs(spark, str(tmp_path / "blobs")).count() == spark.read.parquet(str(tmp_path / "events")).count() == 2
    page = spark.createDataFrame([("u", "body", 60, 0.6)], "url string, text string, word_count int, body_confidence double")
    field = lambda v: F.struct(F.lit(v).cast("string").alias("value"), F.lit("og").alias("source"))
    page = page.withColumns({"title": field(None), "canonical_url": field("c"), "language": field("en"), "published": F.struct(F.lit(None).cast("timestamp").alias("value"), F.lit("og").alias("source"))})
    made = B.finalise_articles(page, 4).first()
    assert (made["title"], made["canonical_url"], made["reading_seconds"], made["extraction_version"]) == ("u", "c", 16, 4)


def test_streams_of_mails_without_ids(spark, tmp_path):
    src = str(tmp_path / "mails")
    spark.createDataFrame([(None, "00"), (None, "01"), (None, "01"), ("m", "00"), ("m", "02")], "message_id string, t string").select("message_id", F.to_timestamp(F.concat(F.lit("2026-01-01 00:00:"), "t")).alias("received_at")).write.parquet(src)
    q = J.stream_once(spark.readStream.schema("message_id string, received_at timestamp").parquet(src)).writeStream.format("memory").queryName("mails_once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("mails_once"), "message_id") == [("m",), (None,), (None,), (None,)]


def test_latency_stream(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.createDataFrame([("done", 10, "00:10"), ("done", 30, "00:20"), ("failed", 5, "05:00")], "outcome string, fetch_ms int, t string").select("outcome", "fetch_ms", F.to_timestamp(F.concat(F.lit("2026-01-01 "), "t", F.lit(":00"))).alias("created_at")).write.parquet(src)
    stream = J.stream_latency(spark.readStream.schema("outcome string, fetch_ms int, created_at timestamp").parquet(src))
    q = stream.writeStream.format("memory").queryName("latency").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("latency"), "outcome", "n", "mean_fetch_ms") == [("done", 2, 20.0), ("failed", 1, 5.0)]


@pytest.mark.parametrize("n", [1, 3000])
def test_nearest_in_batches(spark, n):
    from corpusloom.operators import tags as G

    vocabulary = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 0.0, 0.0]), ("z", None)], "id string, embedding array<double>")
    asked = spark.createDataFrame([(k, v) for k, v in enumerate([[3.0, 0.1], [0.1, 5.0], [0.0, 0.0], [], None, [1.0], [0.9, 0.1, 0.0], [-1.0, -1.0]] * n)], "k int, embedding array<double>")
    got = {r["k"] % 8: (r["nearest_id"], r["similarity"] and round(r["similarity"], 3)) for r in G.nearest(asked, vocabulary).collect()}
    assert got == {0: ("a", 0.999), 1: ("b", 1.0), 2: ("a", 0.0), 3: ("a", 0.0), 4: (None, None), 5: ("a", 0.0), 6: ("c", 0.994), 7: ("c", 0.0)}


def test_signed_notifications(spark):
    files = spark.createDataFrame([("k1", b"From: Ann <Ann@x.example>\r\nTo: Brown-River@in.example\r\nSubject: Hi\r\nMessage-ID: <m@x>\r\n\r\nbody"), ("k2", b"To: nobody@in.example\r\n\r\nx"), ("k3", b"")], "key string, raw binary")
    secret = F.lit("s3")
    notes = J.notifications(files, secret, F.lit(NOW))
    first = notes.where("key = 'k1'").first()
    assert '"alias":"brown-river@in.example"' in first["body"] and '"message-id":"<m@x>"' in first["body"] and notes.where("key = 'k3' and body like '%gen-k3%'").count() == 1
    boxes = spark.createDataFrame([("Brown-River", "u1")], "alias string, user_id string")
    soon, late = F.lit(NOW + datetime.timedelta(seconds=60)), F.lit(NOW + datetime.timedelta(hours=1))
    assert rows(J.accepted(notes, boxes, secret, soon), "key", "user_id") == [("k1", "u1")]
    assert J.accepted(notes, boxes, secret, late).count() == 0 and J.accepted(notes, boxes, F.lit("other"), soon).count() == 0
    assert J.accepted(notes.withColumn("body", F.replace("body", F.lit("Hi"), F.lit("Ho"))), boxes, secret, soon).count() == 0


def test_contract_quarantine(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 2.0), (3, None)], "id int, confidence double")
    good, bad = K.check_contract(df, nested.contract_errors(F.array(F.struct(F.lit("Ann").alias("name"))), F.col("confidence")))
    assert rows(good, "id") == [(1,), (3,)] and good.columns == df.columns and bad.first()["contract_errors"] == ["confidence-out-of-range"]
