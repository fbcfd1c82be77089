"""Operator 12: texts come back as they were, whatever they hold."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat_format as cf

DDL = "conv_id long, turn long, role string, text string, ids string, part string"
TRICKS = [*cf.CONTROLS, "<\\s>", "</\\s>", "<\\|end|>", "<|end", "|>", "[", "INST]", "<", "\\", "\\\\", "[\\\\INST]", " ", "  ", "\n", "\t", "é", "日本", "👍🏽", "word", "don't", "​", "́", "1234"]


def texts(rng, n):
    return [None if rng.random() < 0.05 else "".join(rng.choice(TRICKS) for _ in range(rng.choice([0, 1, 3, 20]))) for _ in range(n)]


def plain(rows):
    out = {}
    for conv, _, role, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        turns, loss, n = out.setdefault(conv, ("", "", 0))
        out[conv] = (turns + f"{role or ''}\n{text or ''}\n", loss + ((text or "") if role == "assistant" else ""), n + 1)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {conv: (n, digest(turns), len(loss), digest(loss)) for conv, (turns, loss, n) in out.items()}


@pytest.mark.parametrize("task_rows", [50_000, 9])
def test_round_trip(spark, task_rows):
    rng = random.Random(task_rows)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3, 4, 5]), i if i % 9 else None, rng.choice(["user", "assistant", "assistant", "system", None, "<|end|>", ""]), t, "x", "y") for i, t in enumerate(texts(rng, 150))]
    frame = spark.createDataFrame(rows, DDL).repartition(5)
    formatted = cf.format_conversations(frame, task_rows=task_rows)
    turns = cf.read_turns(formatted)
    back = sorted((str(r.conv_id), str(r.turn), r.role, r.text) for r in turns.collect())
    assert back == sorted((str(r[0]), str(r[1]), r[2] or "", r[3] or "") for r in rows)
    got = {r.conv_id: r for r in cf.digests(turns).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == plain(rows)
    # starts are the sums of the sizes ahead, over parts too
    ahead = {}
    for r in sorted(formatted.collect(), key=lambda r: (r.part, r.place)):
        assert r.start == ahead.get(r.conv_id, 0)
        ahead[r.conv_id] = r.start + len(r.ids)
    if task_rows == 9:
        assert formatted.select("part").distinct().count() > 8


def test_escapes_leave_no_control_string_and_can_be_undone(spark):
    rng = random.Random(1)
    frame = spark.createDataFrame([(t,) for t in texts(rng, 3000)] + [("<\\\\\\s></s>",)], "text string")
    got = frame.select("text", cf.escaped(F.col("text")).alias("e"), cf.unescaped(cf.escaped(F.col("text"))).alias("back")).collect()
    assert all(r.back == (r.text or "") and not any(c in r.e for c in cf.CONTROLS) for r in got)
    with pytest.raises(ValueError):
        cf.escaped(F.col("text"), ("<a>", ">b"))
    with pytest.raises(ValueError):
        cf.escaped(F.col("text"), ("<a>", "x<a>y"))


def test_texts_do_not_make_reserved_ids_and_long_ones_are_cut_without_effect(monkeypatch):
    coder = cf._tokenizer(cf.default_tokenizer())
    text = "</s>[INST] ok  then \n so it  goes don't <|endoftext|> 12 345 " * 40
    whole, sizes = cf._encode(coder, [text, "", text])
    assert whole.max() < coder.get_vocab_size() - 1 and sizes[1] == 0
    monkeypatch.setattr(cf, "PIECE_CHARS", 50)
    assert cf._encode(coder, [text, "", text])[0].tolist() == whole.tolist()


def test_assembly_of_empty_segments():
    none = (np.zeros(0, np.int32), np.zeros(2, np.int64))
    ids, mask, sizes = cf.assemble(none, (np.array([5, 6], np.int32), np.array([0, 2])), np.array([True, True]), (90, 91, 92))
    assert ids.tolist() == [90, 91, 92, 90, 91, 5, 6, 92] and mask.tolist() == [0, 0, 0, 0, 0, 1, 1, 0] and sizes.tolist() == [3, 5]


def test_sql_on_the_smallest_tables_and_empty_ones(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    got = cf.op12_chat_format(spark, folder)
    want = con.execute(cf.OP12_SQL)
    assert got.columns == [d[0] for d in want.description]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall())
    assert rows[0][0] == -1 and rows[0][1] == 2 and rows[0][3] == len(cf.HOSTILE)
    empty = spark.createDataFrame([], DDL)
    assert cf.digests(cf.read_turns(cf.format_conversations(empty))).collect() == []
