"""Decontamination against plain Python over every document and item, in one block and in many."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate as D

from . import brute

WORDS = [a + b + c for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "st", "")]


def grams(words):
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def plain_leaks(docs, items, min_score=0.5):
    """The definition: seeds by document frequency, windows where two of them are near, Smith-Waterman there."""
    texts = [(d, (t or "").lower().replace(",", " ").split()) for d, t in docs]
    found = set()
    for i, item in {(i, t) for i, t in items if i is not None and t}:
        w = item.lower().split()
        df = {g: sum(g in {tuple(t[k : k + len(g)]) for k in range(len(t) - len(g) + 1)} for _, t in texts) for g in grams(w)}
        median = sorted(df.values())[len(df) // 2]
        seeds = {g for g in df if df[g] <= max(4 * median, 0.001 * len(docs))}
        need, reach = min(2, len(seeds)), 2 * len(w) + 8
        for row, (d, t) in enumerate(texts):
            places = [(k, g) for k in range(len(t)) for g in [tuple(t[k : k + min(3, len(w))])] if g in seeds]
            near = [any(len({g for p, g in places if 0 <= q - p <= reach}) >= need for q in [p0]) for p0, _ in places]
            if any(near) and brute.smith_waterman(w, t) >= min_score * 2 * len(w):
                found.add((row, d, i))
    return found


@pytest.fixture(scope="module")
def made():
    rng = random.Random(21)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 30])))) for k in range(24)]
    items += [(50, items[5][1]), (51, items[6][1] + " " + items[7][1]), (None, "a b c"), (60, None), (61, ""), (62, " , ")]
    docs = []
    for d in range(150):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            copy = rng.choice(items[:24])[1].split()
            for _ in range(rng.randrange(0, len(copy) // 4 + 1)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [copy[k], rng.choice(WORDS)]])
            at = rng.randrange(len(w) + 1)
            w[at:at] = copy
        docs.append((d, " ".join(w)))
    return [*docs, (None, docs[3][1]), docs[4], (500, None), (501, "")], items


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_all_leaks(spark, made, block_words):
    docs, items = made
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, items[2]], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in D.leaks(table, bench, block_words=block_words).collect())
    assert got == Counter((d, i) for _, d, i in plain_leaks(docs, items))
    left = [r["doc_id"] for r in D.clean_documents(table.withColumn("gram", F.lit(1)), bench, block_words=block_words).collect()]
    leaking = {row for row, _, _ in plain_leaks(docs, items)}
    assert sorted(map(str, left)) == sorted(str(d) for k, (d, _) in enumerate(docs) if k not in leaking)


def test_full_filters_change_nothing(spark, made, monkeypatch):
    docs, items = made
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, D.leaks(table, bench).collect()))
    full = lambda self, values: np.ones(len(values), bool)
    monkeypatch.setattr(D.Filter, "holds", full)
    assert sorted(map(str, D.leaks(table, bench).collect())) == want


def test_filter():
    rng = np.random.default_rng(1)
    values, others = rng.integers(-(1 << 62), 1 << 62, 5000), rng.integers(-(1 << 62), 1 << 62, 5000)
    wide, narrow = D.Filter(5000), D.Filter(5000, 1 << 12)
    for f in (wide, narrow):
        f.add(values)
        assert f.holds(values).all()
    assert wide.holds(others).mean() < 0.05 and len(narrow.ones) == 1 << 9


def test_owners_share_a_bit_with_their_items():
    rng = np.random.default_rng(2)
    grams, items = rng.integers(-(1 << 62), 1 << 62, 4000), rng.integers(-(1 << 62), 1 << 62, 200)[np.arange(4000) // 20]
    for bits in (1 << 27, 1 << 12):
        owners = D.Owners(4000, bits)
        owners.add(grams, items)
        of = owners.of(grams).reshape(200, 20)
        assert (np.bitwise_and.reduce(of, axis=1) != 0).all()
    assert len(owners.bits) == 64
