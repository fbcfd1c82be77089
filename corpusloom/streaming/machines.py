"""Streams of messages that keyed state machines with timers take in: jobs with leases, queue items, versions.

Messages in event time wait in list state until the watermark has passed them, and are then taken in order, so the result is the
same however they are split into micro-batches; rows later than the watermark are dropped by Spark. In processing time they
are taken as they come. A stream that has these machines needs the RocksDB state store (``rocksdb``).

Each call to Spark's state costs Python a round trip, so keys are dealt into buckets by their hash, and the state of a bucket is read and
written as a whole, in chunks. A checkpoint is bound to its number of buckets.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass
from functools import lru_cache
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import BACKOFF_SECONDS, MAX_ATTEMPTS
from .jobs import LEASE_SECONDS, RETRY_WITHOUT_MODEL_SECONDS, Fatal

#: Groups that the keys of a stream are dealt into, and entries of a chunk of their state or output.
BUCKETS, CHUNK = 4_096, 5_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _order(message: tuple) -> tuple:
    """By time, then by the other fields in turn, nulls first."""
    return tuple((x is not None, x) for x in message)


def _chunks(entries: Iterable) -> Iterator[list]:
    entries = iter(entries)
    while chunk := list(islice(entries, CHUNK)):
        yield chunk


class Machine(StatefulProcessor):
    """Takes the messages of each key of a bucket in order. A subclass has ``message`` (DDL, ``at`` first: microseconds), ``out`` (DDL) and ``fold``.

    ``fold`` gets a key, what is kept of it (or None), its next messages in order and the time until which nothing more comes, and
    returns what is kept now, rows to send on as tuples (times as microseconds), and when it wants to be called next without a message (microseconds, or None).
    """

    message = out = ""

    def __init__(self, event_time: bool) -> None:
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "chunk binary")  # (key, at, the rest of the message as JSON)
        self.kept = handle.getListState("kept", "chunk binary")  # (key, what is kept of it, when fold wants to be called)
        self.next = handle.getValueState("next", "at long")  # the bucket's timer
        names = _names(self.message)[1:]

        @lru_cache(CHUNK)
        def rest(text: str) -> tuple:
            fields = json.loads(text)
            return tuple(fields.get(n) for n in names)

        self._rest = rest

    def fold(self, key, kept: tuple | None, messages: list[tuple], until: int) -> tuple[tuple | None, list[tuple], int | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        given = (entry for frame in rows for entry in zip(*(frame[c].tolist() for c in ("id", "at", "message")), strict=True))
        if not self.event_time:
            now = timerValues.getCurrentProcessingTimeInMs() * 1000
            yield from self._step([(id_, now, text) for id_, _, text in given], now, None)
            return
        first = None
        for chunk in _chunks(given):
            same: dict[str, str] = {}  # equal texts are stored once
            self._append(self.waiting, [(id_, at, same.setdefault(text, text)) for id_, at, text in chunk])
            least = min(at for _, at, _ in chunk)
            first = least if first is None else min(first, least)
        self._wake(-(-first // 1000), later=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.next.get() != (expiredTimerInfo.getExpiryTimeInMs(),):
            return  # another one has taken its place
        if not self.event_time:
            yield from self._step([], timerValues.getCurrentProcessingTimeInMs() * 1000, None)
            return
        until = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = [], []
        for m in self._all(self.waiting):
            (ready if m[1] <= until else rest).append(m)
        self._replace(self.waiting, rest)
        yield from self._step(ready, until, min((m[1] for m in rest), default=None))

    def _step(self, messages: list[tuple], until: int, waits: int | None) -> Iterator[pd.DataFrame]:
        of: dict = {}
        for id_, at, text in messages:
            of.setdefault(id_, []).append((at, *self._rest(text)))
        kept = {id_: (own, due) for id_, own, due in self._all(self.kept)}
        for id_, (_, due) in kept.items():
            if due is not None and due <= until:
                of.setdefault(id_, [])
        rows = []
        for id_, mine in of.items():
            own, more, due = self.fold(id_, kept.get(id_, (None, None))[0], sorted(mine, key=_order) if len(mine) > 1 else mine, until)
            if own is not None:
                kept[id_] = own, due
            rows += more
            if len(rows) >= CHUNK:
                yield self._frame(rows)
                rows = []
        if rows:
            yield self._frame(rows)
        if of:
            self._replace(self.kept, ((id_, own, due) for id_, (own, due) in kept.items()))
        at = min((x for x in (waits, *(due for _, due in kept.values())) if x is not None), default=None)
        self._wake(None if at is None else -(-at // 1000), later=True)

    def _wake(self, at: int | None, later: bool) -> None:
        """The bucket's timer goes to ``at``, and away from an earlier time only if ``later``."""
        timer = self.next.get()
        if timer is not None and (timer[0] == at or not later and timer[0] < at):
            return
        if timer is not None:
            self.handle.deleteTimer(timer[0])
        if at is None:
            self.next.clear()
            return
        self.handle.registerTimer(at)
        self.next.update((at,))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        kinds = {"long": "Int64", "int": "Int32"}
        columns = zip(("id", *_names(self.out)), ("", *(p.split()[1] for p in self.out.split(", "))), zip(*rows, strict=True), strict=True)
        return pd.DataFrame({name: pd.array(values, kinds[kind]) if kind in kinds else pd.Series(values, dtype=object if kind else None) for name, kind, values in columns})

    @staticmethod
    def _append(state, entries: list) -> None:
        state.appendList([(pickle.dumps(entries, 5),)])

    @staticmethod
    def _replace(state, entries: Iterable) -> None:
        packed = [(pickle.dumps(chunk, 5),) for chunk in _chunks(entries)]
        state.put(packed) if packed else state.clear()

    @staticmethod
    def _all(state) -> Iterator[tuple]:
        return (entry for (chunk,) in state.get() for entry in pickle.loads(bytes(chunk)))

    def close(self) -> None:
        pass


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


#: What jobs are told: ``what`` is enqueue (with queue_name, payload, run_at or null for now), settle (attempts, ok, fatal, error_class) or wait (attempts).
JOB_MESSAGE = "at long, what string, queue_name string, payload string, run_at long, attempts int, ok boolean, fatal boolean, error_class string"
_MICROS = "at long, state string, attempts int, queue_name string, payload string, run_at long, locked_until long, error_class string"
_CHANGE = "at timestamp, state string, attempts int, queue_name string, payload string, run_at timestamp, locked_until timestamp, error_class string"


@dataclass
class Job:
    """A job between messages; times are microseconds."""

    state: str
    attempts: int
    queue_name: str | None
    payload: str | None
    run_at: int
    locked_until: int | None
    error_class: str | None

    def due(self) -> int | None:
        return {"pending": self.run_at, "running": self.locked_until}.get(self.state)

    def claim(self, at: int, lease: int) -> None:
        self.state, self.attempts, self.locked_until = "running", self.attempts + 1, at + lease * 1_000_000

    def told(self, at: int, what: str, attempts: int | None, ok: bool | None, fatal: bool | None, error_class: str | None) -> bool:
        """Takes an outcome in; false for one of another attempt than the running one, which changes nothing."""
        if self.state != "running" or attempts != self.attempts or what not in ("settle", "wait"):
            return False
        self.locked_until = None
        if what == "wait":
            self.state, self.attempts, self.run_at = "pending", self.attempts - 1, at + RETRY_WITHOUT_MODEL_SECONDS * 1_000_000
        elif ok:
            self.state = "done"
        else:
            self.error_class = error_class
            if fatal or self.attempts >= MAX_ATTEMPTS:
                self.state = "failed"
            else:
                self.state, self.run_at = "pending", at + BACKOFF_SECONDS * 2 ** (self.attempts - 1) * 1_000_000
        return True


def run_job(job: Job | None, messages: list[tuple], until: int, lease: int, exact: bool) -> tuple[Job | None, list[tuple]]:
    """A job after its messages (as ``JOB_MESSAGE``) and all claims that are due until then, and its changes (at, *job).

    With ``exact`` a claim happens when it is due, else now. A job is enqueued once; whatever comes before is nothing.
    """
    changes: list[tuple] = []

    def note(at: int) -> None:
        changes.append((at, job.state, job.attempts, job.queue_name, job.payload, job.run_at, job.locked_until, job.error_class))

    def claims(now: int) -> None:
        while job and (due := job.due()) is not None and due <= now:
            job.claim(due if exact else now, lease)
            note(due if exact else now)

    for at, what, queue, payload, run_at, attempts, ok, fatal, error in messages:
        claims(at)
        if what == "enqueue":
            if job is None:
                job = Job("pending", 0, queue, payload, at if run_at is None else max(at, run_at), None, None)
                note(at)
        elif job and job.told(at, what, attempts, ok, fatal, error):
            note(at)
    claims(until)
    return job, changes


class JobMachine(Machine):
    message, out = JOB_MESSAGE, _MICROS

    def __init__(self, event_time: bool, lease: int) -> None:
        super().__init__(event_time)
        self.lease = lease

    def fold(self, key, kept, messages, until):
        job, changes = run_job(Job(*kept) if kept else None, messages, until, self.lease, self.event_time)
        return (astuple(job), [(key, *c) for c in changes], job.due()) if job else (None, [], None)


def _messages(stream: DataFrame, ddl: str, at: str) -> DataFrame:
    """The stream's columns as a machine wants them, ``at`` as microseconds beside the event-time column ``_time``."""
    names = [p.split() for p in ddl.split(", ")]
    have = {c.lower() for c in stream.columns}
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kinds = dict(stream.dtypes)
    column = lambda n, k: F.lit(None).cast(k) if n not in have else micros(n) if kinds[n].startswith("timestamp") and k == "long" else F.col(n).cast(k)
    return stream.select("id", F.col(at).cast("timestamp").alias("_time"), *[column(n, k).alias(n) for n, k in names])


def _run(given: DataFrame, machine: Machine, watermark: str | None, buckets: int) -> DataFrame:
    """The stream of ``_messages`` through a machine: id and its ``out``."""
    rest = F.to_json(F.struct(*[F.col(n) for n in _names(machine.message)[1:]]))
    dealt = given.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), "id", "at", rest.alias("message"), "_time")
    keyed = (dealt.withWatermark("_time", watermark) if watermark else dealt.drop("_time")).groupBy("bucket")
    return keyed.transformWithStateInPandas(machine, f"id {dict(given.dtypes)['id']}, {machine.out}", "Update", "eventTime" if watermark else "processingTime")


def stream_jobs(messages: DataFrame, lease_seconds: int = LEASE_SECONDS, watermark: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stream of messages (id, at, what, ...) to changes of jobs: id, at, state, attempts, queue_name, payload, run_at, locked_until, error_class.

    ``what`` is enqueue (queue_name, payload, run_at; a job is enqueued once), settle (attempts, ok, fatal, error_class), or wait
    (attempts: nothing was there to run it with). A job is claimed when it is due, with one attempt more and a lease, and again
    when its lease ends without an outcome, with no message needed. A failed one is due after a wait that doubles, or fails for good; one that
    waits is due 300 s later, its attempt not counted. An outcome of an attempt that is not the running one is ignored. Changes to
    running are what a worker has to do. Messages without an id or time are dropped.

    With ``watermark`` time is that of the messages, without it the clock's. All timers and leases are state of the stream, so a restart from its
    checkpoint goes on where it was.
    """
    given = _messages(messages.where("id is not null and at is not null"), JOB_MESSAGE, "at")
    changes = _run(given, JobMachine(bool(watermark), lease_seconds), watermark, buckets)
    return changes.withColumns({c: F.timestamp_micros(c) for c in ("at", "run_at", "locked_until")})


def job_history(messages: DataFrame, until: Column, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """What ``stream_jobs`` gives in event time once its watermark is ``until``, of a table of messages.

    Messages are sorted by job and time and taken one by one, so a task holds one job and a batch, however many messages a job has.
    """
    given = _messages(messages.where("id is not null and at is not null"), JOB_MESSAGE, "at").withColumn("_until", F.unix_micros(until.cast("timestamp"))).where("at <= _until")
    names = [p.split()[0] for p in JOB_MESSAGE.split(", ")]

    def run(batches):
        key = job = kind = None
        end = 0

        def batch_of(changes):
            ids, at, state, attempts, queue, payload, run_at, locked, error = zip(*changes, strict=True) if changes else [()] * 9
            time_of = lambda x: pa.array(x, pa.int64()).cast(pa.timestamp("us", "UTC"))
            text = lambda x: pa.array(x, pa.string())
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), time_of(at), text(state), pa.array(attempts, pa.int32()), text(queue), text(payload), time_of(run_at), time_of(locked), text(error)], names=["id", "at", "state", "attempts", "queue_name", "payload", "run_at", "locked_until", "error_class"])

        def more(message, until):
            nonlocal job
            job, changes = run_job(job, [message] if message else [], until, lease_seconds, True)
            return [(key, *c) for c in changes]

        for batch in batches:
            out, kind = [], batch.schema.field("id").type
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "_until", *names)]
            for id_, until_, *message in zip(*columns, strict=True):
                if key is not None and id_ != key:
                    out += more(None, end)
                    job = None
                key, end = id_, until_
                out += more(tuple(message), message[0])
            yield batch_of(out)
        if key is not None:
            yield batch_of(more(None, end))

    kind = dict(messages.dtypes)["id"]
    ready = given.repartition("id").sortWithinPartitions("id", *names).select("id", "_until", *names)
    return ready.mapInArrow(run, f"id {kind}, {_CHANGE}")


def last_states(changes: DataFrame) -> DataFrame:
    """id, state, attempts: each job after its changes. Of changes of one time the one of more attempts is later, and a claim comes before its outcome."""
    last = F.max_by(F.struct("state", "attempts"), F.struct("at", "attempts", F.col("state") != "running"))
    return changes.groupBy("id").agg(last.alias("s")).select("id", "s.state", "s.attempts")


class Waiting(Exception):
    """Raised by a handler that has nothing to run with now, such as a model; the job comes again later, its attempt not counted."""


def outcomes(claims: DataFrame, handlers: dict[str, Callable[[str], None]]) -> DataFrame:
    """Messages to ``stream_jobs`` of what became of claims (changes to running): each queue's handler is called with a job's payload.

    What a handler raises settles its own job alone: ``Waiting``, ``Fatal``, or anything else, which is tried again.
    """

    def run(batches):
        for batch in batches:
            out = []
            for job, queue, payload, attempts in zip(*(batch[c].tolist() for c in ("id", "queue_name", "payload", "attempts")), strict=True):
                if queue not in handlers:
                    continue
                try:
                    handlers[queue](payload)
                    out.append((job, "settle", attempts, True, False, None))
                except Waiting:
                    out.append((job, "wait", attempts, None, None, None))
                except Exception as e:  # a job's failure is its outcome
                    out.append((job, "settle", attempts, False, isinstance(e, Fatal), getattr(e, "error_class", None) or type(e).__name__))
            yield pd.DataFrame(out, columns=["id", "what", "attempts", "ok", "fatal", "error_class"])

    kind = dict(claims.dtypes)["id"]
    made = claims.where("state = 'running'").select("id", "queue_name", "payload", "attempts").mapInPandas(run, f"id {kind}, what string, attempts int, ok boolean, fatal boolean, error_class string")
    return made.withColumn("at", F.current_timestamp())


def start_worker(spark: SparkSession, inbox: str, changes: str, checkpoint: str, handlers: dict[str, Callable[[str], None]], schema: str, lease_seconds: int = LEASE_SECONDS, poll: str = "1 second"):
    """Starts a worker: messages that land as Parquet in ``inbox`` run as jobs on the clock, until it is stopped.

    Each micro-batch writes its changes of jobs to ``changes``, a folder a batch, then runs what was claimed and puts the outcomes into
    ``inbox`` for a later batch, so the folder's messages are the source of truth. A repeated batch replaces its own files. An outcome
    that comes twice is of an attempt that no longer runs, and so changes nothing.
    """
    messages = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(inbox)

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")
        done = batch.sparkSession.read.schema(batch.schema).parquet(f"{changes}/batch={number}")
        if not done.where("state = 'running'").isEmpty():
            outcomes(done, handlers).write.mode("overwrite").parquet(f"{inbox}/outcomes-{number}")

    with rocksdb(spark):
        return stream_jobs(messages, lease_seconds).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=poll).start()


_NEXT = {"enqueue": lambda s: "unread", "enqueue-if-absent": lambda s: s or "unread", "archive": lambda s: s and "archived", "start": lambda s: "reading" if s == "unread" else s, "finish": lambda s: "read" if s not in (None, "archived") else s, "unread": lambda s: "unread" if s not in (None, "archived") else s}


class ItemMachine(Machine):
    message, out = "at long, action string", "state string"

    def fold(self, key, kept, messages, until):
        state = kept[0] if kept else None
        for _, action in messages:
            state = _NEXT.get(action, lambda s: s)(state)
        return (state,), [(key, state)] if messages else [], None


def stream_item_states(actions: DataFrame, watermark: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """A stream of (id, at, action) to updates (id, state): the fold of ``jobs.item_states`` over all actions up to the watermark.

    Late actions within the watermark take their place; actions are never folded before the watermark has passed them.
    """
    given = _messages(actions.where("id is not null and at is not null"), ItemMachine.message, "at")
    return _run(given, ItemMachine(True), watermark, buckets)


class VersionMachine(Machine):
    message, out = "at long, version long, forced boolean, row string", "version long, row string"

    def fold(self, key, kept, messages, until):
        version, out = (kept[0] if kept else None), []
        for _, new, forced, row in messages:
            if new is not None and (version is None or new > version or forced and new == version):
                version = new
                out = [(key, new, row)]
        return None if version is None else (version,), out, None


def stream_newest(rows: DataFrame, watermark: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """A stream of (id, at, version, forced, row) to (id, version, row): what is to replace the row of an id.

    In order of ``at``, a row applies if its version is newer than what its id has, or the same and forced; of what applies at once only the last
    one is sent on. Rows that come again, or in another order within the watermark, change nothing.
    """
    given = _messages(rows.where("id is not null and at is not null"), VersionMachine.message, "at")
    return _run(given, VersionMachine(True), watermark, buckets)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there now and returns what it gave, with the number of the micro-batch as ``batch``.

    Micro-batches are written by number, so one that is repeated replaces itself; a later call goes on from the checkpoint in ``folder``.
    """

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    with rocksdb(stream.sparkSession):
        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{folder}/rows")
