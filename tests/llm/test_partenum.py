"""Two-level signatures, very common signatures and filters that let everything pass, against all pairs."""

import itertools
import random

import numpy as np
import pytest

from corpusloom.llm import common, partenum

from . import brute
from .test_operators import prose


def test_small_sets_take_two_levels():
    bands = partenum.Bands.of(3000, 75)
    plans = [partenum.two_levels(int(bands.low[i]), int(bands.high[i + 1]), int(bands.differ(bands.high[i], bands.high[i + 1]))) for i in range(len(bands.low) - 1)]
    assert any(plans) and not all(plans)
    for i, plan in enumerate(plans):
        if plan:
            n1, n2, k2 = plan
            assert n1 * (k2 + 1) > bands.differ(bands.high[i], bands.high[i + 1]) and 0 < k2 < n2


@pytest.mark.parametrize("plan", [(1, 3, 1), (2, 3, 1), (1, 5, 3), (3, 4, 2)])
def test_subsets_meet_where_few_elements_differ(plan):
    n1, n2, k2 = plan
    k = n1 * (k2 + 1) - 1
    rng = np.random.default_rng(sum(plan))
    met = 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 40))).astype(np.uint64))
        gone = int(rng.integers(0, min(k, len(a) - 1) + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 62, k - gone).astype(np.uint64)]))
        values, of = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        sig, owner, enough = partenum._subset_signatures(values, of, np.arange(2), np.uint64(99), plan)
        shared = set(sig[owner == 0]) & set(sig[owner == 1])
        assert shared or not enough.any()
        met += bool(enough.any())
    assert met > 20


def test_equal_contents_in_other_cells_do_not_meet():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 1 << 62, 12).astype(np.uint64)) for _ in range(2))
    sig, owner, _ = partenum._subset_signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.arange(2), np.uint64(7), (2, 3, 1))
    assert not set(sig[owner == 0]) & set(sig[owner == 1])


def rows_of(rng):
    rows = []
    for size in (1, 2, 5, 7, 8, 9, 11, 14, 18, 25, 35, 60):
        for _ in range(6):
            base = prose(rng, size).split()
            for _ in range(rng.randrange(1, 5)):
                w = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2])):
                    w[rng.choice([0, -1, rng.randrange(len(w))])] = prose(rng, 1)
                rows.append((len(rows), " ".join(w + ([prose(rng, 1)] if rng.random() < 0.3 else []))))
    base = prose(rng, 120).split()  # a third of all rows: near copies of one text, whose shingles are frequent
    for _ in range(len(rows) // 2):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("full", [False, True])
def test_components_of_hot_and_small_sets(spark, monkeypatch, full):
    if full:  # a filter that is too small marks all rows
        monkeypatch.setattr(common.Marks.__init__, "__defaults__", (64,))
    rows = rows_of(random.Random(31))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, partenum.near_duplicates(docs).collect()))
    assert got == sorted(brute.near(rows))
    kept = sorted(r["doc_id"] for r in partenum.one_of_each(docs).collect())
    assert kept == sorted({c for _, _, c in got})


def test_marks_split(spark):
    values = spark.createDataFrame([(k,) for k in range(0, 3000, 3)], "v long")
    rows = spark.createDataFrame([(k,) for k in [*range(3000), None]], "x long")
    for bits in (64, common.MARK_BITS):
        maybe, others = common.Marks(values, bits).split(rows, "x")
        m, o = [r[0] for r in maybe.collect()], [r[0] for r in others.collect()]
        assert sorted(map(str, itertools.chain(m, o))) == sorted(map(str, [*range(3000), None])) and set(range(0, 3000, 3)) <= set(m) and None in o
    assert len(m) < 1100
    empty = common.Marks(values.limit(0)).split(rows, "x")
    assert empty[0].count() == 0 and empty[1].count() == 3001


def test_a_row_without_id_links_others(spark):
    words = [f"w{k}" for k in range(40)]
    b = list(words)
    a, c = ["x", "y", "z", *b[3:]], [*b[:-3], "u", "v", "t"]  # each like b, not like each other
    rows = [(1, " ".join(a)), (None, " ".join(b)), (3, " ".join(c)), (7, "alone in here"), (None, "no one is like this one")]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], "doc_id long, text string, lang string, source string, key long")
    got = sorted(map(tuple, partenum.near_duplicates(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (3, 1), (7, 7), (None, None)], key=str)
    assert sorted((r["doc_id"] for r in partenum.one_of_each(docs).collect()), key=str) == [1, 7, None]
    assert sorted(map(tuple, partenum.near_links(docs).collect())) == [(1, None), (3, None)]
    assert sorted(r["n_links"] for r in partenum.link_counts(docs).collect()) == [0, 0, 1, 1, 2]


def test_of_near_copies_without_any_id_one_stays(spark):
    base = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(None, " ".join(base)), (None, " ".join(base[1:])), (None, " ".join(base[2:])), (None, " ".join(base))], "doc_id long, text string")
    got = [r["text"] for r in partenum.one_of_each(docs).collect()]
    assert len(set(got)) == 1
    assert {r["component_id"] for r in partenum.near_duplicates(docs).collect()} == {None}


def test_sets_of_nothing_but_frequent_shingles_share_a_signature():
    rng = np.random.default_rng(3)
    bands = partenum.Bands.of(400, 75)
    for n in (3, 8, 30, 36, 60, 90, 300):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = a[max(1, n // 20) :]
        sig, owner, _ = partenum.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), bands, a)
        assert 100 * len(b) < 75 * len(a) or set(sig[owner == 0]) & set(sig[owner == 1]), n
