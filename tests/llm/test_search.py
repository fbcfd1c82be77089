"""Operator 11: every document scored by plain Python, and the index by what it packs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusloom.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(ls._UPPER, ls._LOWER)
DDL = "doc_id long, text string, term string, shard string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item in {i for i, _ in items}:
        own = {t for i, text in items if i == item for t in terms(text) if t in df}
        scored = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def made(rng, n):
    words = ["The", "the", "É", "été", "1984", "x-y", "naïve", "zz", " a", "日本", "don't", "A_b", "q", "w", "e", "r"]
    return [None if rng.random() < 0.05 else rng.choice([" ", "\n", "  ", "."]).join(rng.choice(words[: rng.choice([4, 16])]) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(n)]


@pytest.mark.parametrize("shard_bytes, block_terms", [(16_000_000, 200_000), (300, 10)])
def test_against_every_document(spark, shard_bytes, block_terms):
    rng = random.Random(5)
    docs = [(None if i % 40 == 7 else i % 90, t) for i, t in enumerate(made(rng, 150))]
    items = [(None if i == 3 else i % 9, t) for i, t in enumerate(made(rng, 12))]
    frame = spark.createDataFrame([(i, t, "own", "own") for i, t in docs], DDL).repartition(3)
    index = ls.materialize(ls.build_index(frame, shard_bytes), "search-index")
    got = ls.search(index, spark.createDataFrame(items, "item_id long, text string"), 10, block_terms)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 10)


def test_equal_documents_rank_by_id_and_empty_tables_have_no_result(spark):
    docs = spark.createDataFrame([(i, "Same words here", "", "") for i in (5, 3, 9, 3)] + [(1, "other", "", "")], DDL)
    items = spark.createDataFrame([(1, "same"), (2, "absent"), (3, ""), (4, None)], "item_id long, text string")
    index = ls.materialize(ls.build_index(docs), "search-index")
    got = ls.search(index, items, 3).collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in sorted(got)] == [(1, 1, 3), (1, 2, 3), (1, 3, 5)]
    assert ls.search(index, items.limit(0)).collect() == []
    none = ls.materialize(ls.build_index(docs.limit(0)), "search-index")
    assert ls.search(none, items).collect() == []


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    values = np.concatenate([[0, 127, 128, 16383, 16384, (1 << 31) - 1], rng.integers(0, 1 << 31, 1000) >> rng.integers(0, 31, 1000)])
    data, ends = ls.pack(values)
    assert ls.unpack(data).tolist() == values.tolist() and len(data) == ends[-1]
    assert ls.unpack(ls.pack(np.zeros(0, np.int64))[0]).tolist() == []


def test_a_merge_in_windows_is_a_merge_of_all():
    rng = np.random.default_rng(2)
    lists = []
    for n in (1, 5, 300, 700, 0):
        docs = np.sort(rng.choice(1000, n, replace=False))
        lists.append((docs, rng.integers(1, 4, n)))
    sums = np.zeros(1000, np.int64)
    for docs, adds in lists:
        sums[docs] += adds
    want = sorted(((int(s), d) for d, s in enumerate(sums) if s), key=lambda x: (-x[0], x[1]))
    for window in (1, 7, 5000):
        assert ls.merge(lists, 25, window) == want[:25]


def test_sql_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = ls.op11_lexical_search(spark, folder)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ls.OP11_SQL).fetchall())
