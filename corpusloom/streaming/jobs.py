"""Durable jobs, reading-queue items and idempotent ingestion."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import backoff_seconds, gives_up, hmac_hex, signature_valid

# They must be these for right results.
LEASE_SECONDS, RETRY_WITHOUT_MODEL_SECONDS = 60, 300


def enqueue(jobs: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Adds pending jobs; ``run_at`` may lie ahead."""
    run_at = F.coalesce(F.col("run_at"), now) if "run_at" in new.columns else now
    rows = new.select("id", "queue_name", "payload", F.lit("pending").alias("state"), F.lit(0).alias("attempts"), run_at.alias("run_at"), F.lit(None).cast("timestamp").alias("locked_until"), F.lit(None).cast("string").alias("error_class"), now.alias("created_at"))
    return jobs.unionByName(rows, allowMissingColumns=True)


def claimable(jobs: DataFrame, now: Column, per_queue: int = 1) -> DataFrame:
    """The next due jobs of each queue: pending ones, and running ones whose lease has ended."""
    due = jobs.where((F.col("run_at") <= now) & ((F.col("state") == "pending") | ((F.col("state") == "running") & (F.col("locked_until") <= now))))
    order = Window.partitionBy("queue_name").orderBy("run_at", "created_at", "id")
    return due.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_queue).drop("_n")


def claim(jobs: DataFrame, now: Column, per_queue: int = 1) -> DataFrame:
    """All jobs after a claim: taken ones run, with one attempt more and a new lease."""
    return _claimed(jobs, claimable(jobs, now, per_queue).select(F.col("id").alias("_taken")), now)


def _claimed(jobs: DataFrame, taken: DataFrame, now: Column) -> DataFrame:
    out = jobs.join(taken, F.col("id") == F.col("_taken"), "left")
    mine = F.col("_taken").isNotNull()
    return out.withColumns(
        {"state": F.when(mine, "running").otherwise(F.col("state")), "attempts": F.col("attempts") + mine.cast("int"), "locked_until": F.when(mine, now + F.make_dt_interval(secs=F.lit(LEASE_SECONDS))).otherwise(F.col("locked_until"))}
    ).drop("_taken")


def settle(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Applies outcomes (id, attempts, ok, fatal, error_class). One of another attempt than the job's is stale and ignored.

    A failed job waits longer each time, and fails for good when fatal or after its last attempt.
    """
    o = outcomes.select(F.col("id").alias("_id"), F.col("attempts").alias("_attempts"), "ok", "fatal", F.col("error_class").alias("_error"))
    out = jobs.join(o, (F.col("id") == F.col("_id")) & (F.col("attempts") == F.col("_attempts")) & (F.col("state") == "running"), "left")
    hit, over = F.col("_id").isNotNull(), F.col("fatal") | gives_up(F.col("attempts"))
    state = F.when(~hit, F.col("state")).when(F.col("ok"), "done").when(over, "failed").otherwise("pending")
    again = hit & ~F.col("ok") & ~over
    wait = F.make_dt_interval(secs=backoff_seconds(F.col("attempts")))
    return out.withColumns(
        {"state": state, "run_at": F.when(again, now + wait).otherwise(F.col("run_at")), "error_class": F.when(hit & ~F.col("ok"), F.col("_error")).otherwise(F.col("error_class")), "locked_until": F.when(~hit, F.col("locked_until"))}
    ).select(*jobs.columns)


def postpone(jobs: DataFrame, waiting: Column, now: Column, seconds: int = RETRY_WITHOUT_MODEL_SECONDS) -> DataFrame:
    """Jobs that cannot run yet go back, their attempt not counted."""
    return jobs.withColumns(
        {"state": F.when(waiting, "pending").otherwise(F.col("state")), "attempts": F.col("attempts") - waiting.cast("int"), "run_at": F.when(waiting, now + F.make_dt_interval(secs=F.lit(seconds))).otherwise(F.col("run_at"))}
    )


def _next_state(state: Column, action: Column) -> Column:
    open_ = state.isNotNull() & (state != "archived")
    return (
        F.when(action == "enqueue", "unread")
        .when((action == "enqueue-if-absent") & state.isNull(), "unread")
        .when((action == "archive") & state.isNotNull(), "archived")
        .when((action == "start") & (state == "unread"), "reading")
        .when((action == "finish") & open_, "read")
        .when((action == "unread") & open_, "unread")
        .otherwise(state)
    )


def item_states(actions: DataFrame) -> DataFrame:
    """id, state of queue items after their actions (at, action), in order. Archived items ignore all but a new enqueue."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "action")))
    return actions.groupBy("id").agg(F.aggregate(ordered, F.lit(None).cast("string"), lambda s, x: _next_state(s, x["action"])).alias("state"))


def once_by_message(mails: DataFrame, order: str) -> DataFrame:
    """The first mail of each message id; mails without one are never repeats."""
    named = mails.where("message_id is not null")
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("message_id").orderBy(order))).where("_n = 1").drop("_n")
    return first.unionByName(mails.where("message_id is null"))


def newest_version(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the highest extraction_version of each key, the last by ``order`` among equal ones."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("extraction_version", order)).alias("r")).select(key, "r.*")


def applies(version: Column, current: Column, forced: Column) -> Column:
    """Whether a reprocessing may replace what is there: a newer version, or the same if forced."""
    return current.isNull() | (version > current) | (forced & (version == current))


def drop_stale(results: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Results that were made from the version that is current."""
    return results.join(current.select(F.col(key).alias("_k"), F.col("version").alias("_v")), (F.col(key) == F.col("_k")) & (F.col("version") == F.col("_v")), "left_semi")


def ingest_status(urls: DataFrame, jobs: DataFrame) -> DataFrame:
    """url, status by its newest job: importing, done, failed, or not-indexed without any."""
    newest = jobs.groupBy(F.col("url").alias("_u")).agg(F.max_by("state", F.struct("created_at", "id")).alias("_s"))
    s = F.col("_s")
    status = F.when(s.isNull(), "not-indexed").when(s.isin("done", "failed"), s).otherwise("importing")
    return urls.join(newest, F.col("url") == F.col("_u"), "left").select("url", status.alias("status"))


def stale_work(stale: DataFrame, jobs: DataFrame, limit: int) -> DataFrame:
    """The oldest stale rows without a live job for them, at most ``limit`` (1 to 1000)."""
    live = jobs.where(F.col("state").isin("pending", "running")).select(F.get_json_object("payload", "$.id").alias("_id"))
    return stale.join(live, F.col("id").cast("string") == F.col("_id"), "left_anti").orderBy("age", "id").limit(max(1, min(1000, limit)))


# Structured Streaming.


def stream_once(mails: DataFrame, watermark: str = "30 days") -> DataFrame:
    """A stream of mails (message_id, received_at, ...) without repeats within the watermark; mails without an id are never repeats."""
    named = mails.where("message_id is not null").withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(["message_id"])
    return named.unionByName(mails.where("message_id is null").withWatermark("received_at", watermark))


def stream_latency(events: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """A stream of extraction events to counts and mean times a window and outcome."""
    return events.withWatermark("created_at", watermark).groupBy(F.window("created_at", window), "outcome").agg(F.count("*").alias("n"), F.avg("fetch_ms").alias("mean_fetch_ms"))


def landing(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files that land in a folder: key, raw, received_at."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("key"), F.col("content").alias("raw"), F.col("modificationTime").alias("received_at"))


def notifications(files: DataFrame, secret: Column, at: Column) -> DataFrame:
    """key, body, timestamp, signature of landed mails (key, raw): what the landing tells of each, signed over time and body."""
    head = F.substring(F.col("raw").cast("string"), 1, 100_000)
    line = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))
    address = lambda c: F.lower(F.coalesce(F.nullif(F.regexp_extract(c, r"<([^>]*)>", 1), F.lit("")), c))
    body = F.to_json(
        F.struct(
            address(line("To")).alias("alias"), F.col("key").alias("blob-key"), F.coalesce(line("Message-ID"), F.concat(F.lit("gen-"), "key")).alias("message-id"),
            address(line("From")).alias("from"), F.coalesce(line("Subject"), F.lit("")).alias("subject"), F.octet_length("raw").alias("size"),
        )
    )
    seconds = F.unix_timestamp(at).cast("string")
    return files.select("key", body.alias("body"), seconds.alias("timestamp")).withColumn("signature", hmac_hex(secret, F.concat_ws(".", "timestamp", "body")))


def accepted(notes: DataFrame, inboxes: DataFrame, secret: Column, now: Column, seconds: int = 300) -> DataFrame:
    """Notifications with a right and fresh signature whose alias is an inbox, with that inbox's user_id; the others go."""
    age = F.abs(F.unix_timestamp(now) - F.col("timestamp").cast("long"))
    true = notes.where(signature_valid(secret, F.concat_ws(".", "timestamp", "body"), F.col("signature")) & (age <= seconds))
    boxes = inboxes.select(F.lower("alias").alias("_alias"), "user_id")
    return true.join(boxes, F.split(F.get_json_object("body", "$.alias"), "@")[0] == F.col("_alias"))


class Fatal(Exception):
    """Raised by a handler for what no later attempt can mend."""

    def __init__(self, message: str, error_class: str | None = None) -> None:
        super().__init__(message)
        self.error_class = error_class


def work(claimed: DataFrame, handlers: dict[str, Callable[[str], None]]) -> DataFrame:
    """Outcomes (id, attempts, ok, fatal, error_class) of claimed jobs: each queue's handler is called with a job's payload.

    What a handler raises settles that job alone: ``Fatal`` for good, anything else until its attempts are used up. An
    ``error_class`` attribute of the exception is kept. Jobs of a queue without a handler have no outcome.
    """

    def run(batches):
        for batch in batches:
            out = []
            for job, queue, payload, attempts in zip(*(batch[c].tolist() for c in ("id", "queue_name", "payload", "attempts")), strict=True):
                if (handler := handlers.get(queue)) is None:
                    continue
                try:
                    handler(payload)
                    out.append((job, attempts, True, False, None))
                except Exception as e:  # a job's failure is its outcome
                    out.append((job, attempts, False, isinstance(e, Fatal), getattr(e, "error_class", None) or ("error" if isinstance(e, Fatal) else type(e).__name__)))
            yield pd.DataFrame(out, columns=["id", "attempts", "ok", "fatal", "error_class"])

    kind = dict(claimed.dtypes)["id"]
    return claimed.select("id", "queue_name", "payload", "attempts").mapInPandas(run, f"id {kind}, attempts int, ok boolean, fatal boolean, error_class string")


def run_pass(jobs: DataFrame, handlers: dict[str, Callable[[str], None]], now: Column, folder: str, per_queue: int = 1) -> DataFrame:
    """All jobs after one pass over the queues that have a handler: the next due job of each is claimed, run and settled.

    What is taken, the claim and the outcomes are written to ``folder`` (shared by all executors) before they are used, each once. So a lost task
    does not claim anew, a clock that goes on claims nothing more, and a handler runs again only where its own task was lost.
    """
    mine = jobs.where(F.col("queue_name").isin(list(handlers)))
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}") or jobs.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    taken = write(claimable(mine, now, per_queue).select(F.col("id").alias("_taken")), "taken")
    claimed = write(_claimed(mine, taken, now), "claimed")
    done = write(work(claimed.join(taken, F.col("id") == F.col("_taken"), "left_semi"), handlers), "outcomes")
    return settle(claimed, done, now).unionByName(jobs.where(~F.coalesce(F.col("queue_name").isin(list(handlers)), F.lit(False))))


def drain(jobs: DataFrame, work, path: str, checkpoint: str):
    """Runs ``work`` (a function of a table of claimed jobs to a table) on each micro-batch; batches are written by id, so a repeat replaces itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
