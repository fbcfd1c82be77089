"""Streams of jobs, items and versions: any split into micro-batches, restarts, leases that end without a message."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import jobs as J
from corpusloom.streaming import machines as M

T0 = dt.datetime(2024, 1, 1)
MESSAGES = "id string, at timestamp, what string, queue_name string, payload string, run_at timestamp, attempts int, ok boolean, fatal boolean, error_class string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def enqueue(job, t, run_at=None):
    return (job, at(t), "enqueue", "q", "p" + job, run_at and at(run_at), None, None, None, None)


def settle(job, t, attempts, ok=True, fatal=False, error=None, what="settle"):
    return (job, at(t), what, None, None, None, attempts, ok, fatal, error)


SCRIPT = [
    enqueue("ok", 0), settle("ok", 5, 1), settle("ok", 6, 1, False),  # the second outcome is stale
    enqueue("later", 0, 40), settle("later", 30, 1), settle("later", 50, 1),  # one before its claim is none
    enqueue("lost", 0), settle("lost", 61, 1), settle("lost", 70, 2),  # its lease ended, so attempt 1 is stale
    enqueue("flaky", 0), settle("flaky", 1, 1, False, False, "net"), settle("flaky", 20, 2, False, False, "net"), settle("flaky", 45, 3),
    enqueue("fatal", 0), settle("fatal", 1, 1, False, True, "gone"),
    enqueue("model", 0), settle("model", 1, 1, what="wait"), settle("model", 302, 1),
    settle("unknown", 3, 1), enqueue("twice", 0), enqueue("twice", 10),
    *[(m := enqueue("worn", 0)), *[settle("worn", t, k, False) for k, t in enumerate((1, 15, 40, 90, 180), 1)]],
    ("end", at(1000), "tick", *[None] * 7),
]


def stream(spark, tmp_path, rows, ddl, batches, make):
    """The rows that a stream gives over several starts on one checkpoint, a file of messages each."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    got = None
    for part in batches:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(source)
        got = M.drained(make(spark.readStream.schema(ddl).parquet(source)), folder)
    return got.collect()


@pytest.mark.parametrize("splits", [1, 4])
def test_jobs_in_event_time(spark, tmp_path, splits):
    rows = list(SCRIPT)
    random.Random(splits).shuffle(rows)
    rows = [r for r in rows if r[0] != "end"] + [SCRIPT[-1]]
    batches = [rows[k::splits] for k in range(splits)]
    if splits > 1:
        batches = [[r for r in rows if lo <= (r[1] - T0).seconds < hi] for lo, hi in ((0, 30), (20, 61), (61, 2000))]  # 20 to 30 come again
    got = stream(spark, tmp_path, rows, MESSAGES, batches, lambda s: M.stream_jobs(s, watermark="30 seconds"))
    last, claims = {}, {}
    for r in sorted(got, key=lambda r: (r.at, r.batch)):
        last[r.id] = (r.state, r.attempts, r.error_class)
        claims.setdefault(r.id, []).append((r.at - T0).seconds) if r.state == "running" else None
    assert claims["ok"] == [0] and last["ok"] == ("done", 1, None)
    assert claims["later"] == [40] and last["later"] == ("done", 1, None)
    assert claims["lost"] == [0, 60] and last["lost"] == ("done", 2, None)
    assert claims["flaky"] == [0, 11, 40] and last["flaky"] == ("done", 3, "net")
    assert last["fatal"] == ("failed", 1, "gone")
    assert claims["model"] == [0, 301] and last["model"] == ("done", 1, None)
    assert claims["twice"] == list(range(0, 970, 60)) and last["twice"][:2] == ("running", 17)
    assert claims["worn"] == [0, 11, 35, 80, 170] and last["worn"][:2] == ("failed", 5)
    assert not {"unknown", "end"} & set(last)
    keys = [(r.id, r.at, r.state, r.attempts) for r in got]
    assert len(keys) == len(set(keys))  # restarts repeat nothing
    assert {r.id: (r.state, r.attempts) for r in M.last_states(spark.createDataFrame(got)).collect()} == {k: v[:2] for k, v in last.items()}
    table = M.job_history(spark.createDataFrame(rows, MESSAGES), F.lit(at(970)))
    assert sorted((r.id, r.at, r.state, r.attempts, r.run_at, r.locked_until) for r in table.collect()) == sorted((r.id, r.at, r.state, r.attempts, r.run_at, r.locked_until) for r in got)


def test_a_worker_on_the_clock(spark, tmp_path):
    """A job whose worker dies without an outcome runs again when its lease ends; others run once, over a restart too."""
    inbox, changes, marks = (str(tmp_path / x) for x in ("inbox", "changes", "ck"))

    def handle(payload):
        if payload == "bad":
            raise J.Fatal("no", "broken")
        if payload == "no model":
            raise M.Waiting
        if payload == "dead":
            raise KeyError  # tried again after a wait

    ddl = MESSAGES
    rows = [(p, at(0), "enqueue", "q" if p != "nobody" else "other", p, None, None, None, None, None) for p in ("good", "bad", "dead", "no model", "nobody")]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{inbox}/first")

    def run(until, seconds=200):
        query = M.start_worker(spark, inbox, changes, marks, {"q": handle}, ddl, lease_seconds=6)
        end = time.time() + seconds
        try:
            while time.time() < end:
                time.sleep(1)
                assert query.exception() is None
                try:
                    got = spark.read.parquet(changes).collect()
                except Exception:  # nothing is written yet
                    continue
                seen = {(r.id, r.state, r.attempts) for r in got}
                if until <= seen:
                    return got
        finally:
            query.stop()
        raise AssertionError(seen)

    run({("good", "done", 1), ("bad", "failed", 1), ("dead", "pending", 1), ("no model", "pending", 0), ("nobody", "running", 1)})
    got = run({("dead", "running", 2), ("nobody", "running", 2)})  # a new start on the same checkpoint: no message came
    assert sum(r.id == "good" and r.state == "running" for r in got) == 1
    assert next(r for r in got if r.id == "bad" and r.state == "failed").error_class == "broken"


ACTIONS = ["enqueue", "enqueue-if-absent", "archive", "start", "finish", "unread", "other"]


def test_items_are_the_table_s_fold_however_they_come(spark, tmp_path):
    some = random.Random(4)
    rows = [(f"i{some.randrange(6)}", at(k * 20 + some.randrange(200)), some.choice(ACTIONS)) for k in range(120)]
    rows += [("end", at(100_000), "enqueue")]
    ddl = "id string, at timestamp, action string"
    got = stream(spark, tmp_path, rows, ddl, [rows[:40], rows[40:41], rows[41:90], rows[90:]], lambda s: M.stream_item_states(s, "1 hour"))
    want = {r.id: r.state for r in J.item_states(spark.createDataFrame(rows, ddl)).collect() if r.id != "end"}
    last = {}
    for r in sorted(got, key=lambda r: r.batch):
        last[r.id] = r.state
    assert last == want


def test_versions(spark, tmp_path):
    ddl = "id string, at timestamp, version int, forced boolean, row string"
    rows = [("a", at(1), 1, False, "a1"), ("a", at(9), 3, False, "a3"), ("a", at(5), 2, False, "a2"), ("a", at(12), 3, False, "a3 again"), ("b", at(1), 2, False, "b2"), ("b", at(2), 2, True, "b2 forced"), ("b", at(3), 1, True, "b1"), ("c", at(1), None, True, "c"), ("end", at(9999), 1, False, "")]
    got = stream(spark, tmp_path, rows, ddl, [rows[:2], rows[:3], rows[3:]], lambda s: M.stream_newest(s, "1 minute"))
    last = {}
    for r in sorted(got, key=lambda r: r.batch):
        last[r.id] = (r.version, r.row)
    assert last == {"a": (3, "a3"), "b": (2, "b2 forced")}


class Counted:
    """The state of one bucket, which counts the round trips to it."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getListState(self, name, ddl):  # noqa: N802
        return self._State(self, list)

    def getValueState(self, name, ddl):  # noqa: N802
        return self._State(self, lambda: None)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)

    class _State:
        def __init__(self, owner, empty):
            self.owner, self.empty, self.value = owner, empty, empty()

        def _set(self, value):
            self.owner.calls += 1
            self.value = value

        def get(self):
            self.owner.calls += 1
            return self.value

        update = put = _set

        def appendList(self, values):  # noqa: N802
            self._set([*self.value, *values])

        def clear(self):
            self._set(self.empty())


def test_a_bucket_of_many_keys_takes_few_round_trips():
    """Also: what lies behind the watermark is taken, in order, the rest waits, and each key is folded by itself."""
    pd = pytest.importorskip("pandas")
    state, machine = Counted(), M.ItemMachine(True)
    machine.init(state)
    n = 3_000
    rows = [(k, 1_000_000 * t, f'{{"action":"{a}"}}') for t, a in ((9, "archive"), (2, "start"), (1, "enqueue")) for k in range(n)]
    clock = lambda ms: type("T", (), {"getCurrentWatermarkInMs": lambda self: ms, "getExpiryTimeInMs": lambda self: min(state.timers)})()
    out = []
    list(machine.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["id", "at", "message"])]), clock(0)))
    for watermark in (5_000, 9_000):
        at = clock(watermark)
        out.append({r.id: r.state for f in machine.handleExpiredTimer((0,), at, at) for r in f.itertuples()})
    assert out == [dict.fromkeys(range(n), "reading"), dict.fromkeys(range(n), "archived")]
    assert state.calls < 40


def test_items_in_one_bucket(spark, tmp_path):
    rows = [(k % 50, at(k), ACTIONS[k * k % 7]) for k in range(600)] + [(None, at(3), "enqueue"), (99, at(100_000), "enqueue")]
    ddl = "id long, at timestamp, action string"
    got = stream(spark, tmp_path, rows, ddl, [rows[:300], rows[300:]], lambda s: M.stream_item_states(s, "1 hour", buckets=1))
    last = {r.id: r.state for r in sorted(got, key=lambda r: r.batch)}
    assert last == {r.id: r.state for r in J.item_states(spark.createDataFrame(rows, ddl)).where("id <> 99").collect()}
