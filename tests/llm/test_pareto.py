"""Operator 13: layers against plain peeling, at every way a group's size asks for."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from corpusloom.llm import pareto
from corpusloom.llm.pareto import offers, pareto_layers

SCHEMA = "id long, kind string, a long, b long, c long, d long"


def dominates(x: tuple, y: tuple) -> bool:
    """Tuples of which low values are better; None is worst."""
    key = lambda t: [(v is None, v or 0) for v in t]
    return key(x) != key(y) and all(p <= q for p, q in zip(key(x), key(y), strict=True))


def peeled(vectors: list[tuple], depth: int) -> dict[tuple, int]:
    left, out = set(vectors), dict.fromkeys(vectors, 0)
    for n in range(1, depth + 1):
        front = {x for x in left if not any(dominates(y, x) for y in left)}
        out |= dict.fromkeys(front, n)
        left -= front
    return out


def low(r: tuple) -> tuple:
    return (r[2], r[3], None if r[4] is None else -r[4], None if r[5] is None else -r[5])


def check(spark, rows: list[tuple], part_rows: int, depth: int = 4) -> None:
    got = pareto_layers(spark.createDataFrame(rows, SCHEMA).repartition(3), ["a", "b"], ["c", "d"], {"own": ["kind"], "whole": []}, depth, "n", part_rows).collect()
    whole = peeled([low(r) for r in rows], depth)
    own = {k: peeled([low(r) for r in rows if r[1] == k], depth) for k in {r[1] for r in rows}}
    want = sorted((r[0], own[r[1]][low(r)], whole[low(r)], sum(low(r) == low(s) for s in rows)) for r in rows)
    assert sorted((r.id, r.own, r.whole, r.n) for r in got) == want


@pytest.mark.parametrize("part_rows", [10_000, 40, 6])
def test_random_rows_with_nulls_and_ties(spark, part_rows):
    some = random.Random(part_rows)
    value = lambda n: some.choice([None, *range(n)]) if some.random() < 0.3 else some.randrange(n)
    check(spark, [(i, some.choice(["x", "x", "y", None]), value(9), value(5), value(7), value(6)) for i in range(250)], part_rows)


def test_rows_that_never_dominate_each_other_go_through_blocks(spark, monkeypatch):
    seen = []
    settle = pareto._blocks_settle
    monkeypatch.setattr(pareto, "_blocks_settle", lambda *a: seen.append(1) or settle(*a))
    check(spark, [(i, "x", i, 300 - i, 0, 0) for i in range(300)], 20)
    check(spark, [(i, "x", i % 60, 60 - i % 60, i // 60, 0) for i in range(300)], 20)  # five layers of 60
    assert len(seen) == 2


def test_a_chain_ends_at_the_depth(spark):
    check(spark, [(i, None, i, i, -i, -i) for i in range(40)], 5, 7)


def test_repeated_rows_extra_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 5, 1), (1, 5, 1), (2, 6, 1)], "own long, _p long, v0 long")
    got = pareto_layers(rows, ["_p"], ["v0"], {"layer": []}, n_equal="n")
    assert sorted(map(tuple, got.collect())) == [(1, 5, 1, 1, 2), (1, 5, 1, 1, 2), (2, 6, 1, 2, 1)]
    assert pareto_layers(rows.limit(0), ["_p"], [], {"layer": ["own"]}).collect() == []


def test_offers(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    lines = [
        (1, 10, 7, 2, 18.0, 0.1, day(4)), (1, 10, 7, 2, 18.0, 0.1, day(4)), (2, 10, 7, 1, None, 0.05, None), (9, 10, 7, None, 5.0, 0.0, day(9)),
        (1, 11, 7, 1, 1.0, float("nan"), day(1)), (1, 12, 7, 1, 1.0, 0.0, day(1)), (1, None, 7, 1, 1.0, 0.0, day(1)), (1, 10, None, 1, 1.0, 0.0, day(1)), (None, 13, 8, -2, 3.0, 0.0, day(1)),
    ]
    lines = spark.createDataFrame(lines, "sale_id long, item_id long, vendor_id long, quantity int, amount double, discount double, shipped_at timestamp_ntz")
    sales = spark.createDataFrame([(1, day(2)), (1, day(2)), (2, None)], "sale_id long, sold_at timestamp_ntz")
    items = spark.createDataFrame([(10, "toys", 10.0), (11, None, 1.0), (12, "home", 0.001), (13, "home", 1.0)], "item_id long, kind string, price double")
    got = sorted(map(tuple, offers(lines, sales, items).collect()))
    # 10: 2 * 1800 * 90 over 1000 * 4; means of 10, 10, 5, 0 and of 2, 2. 13: 300 * 100 over 100 * -2
    assert got == [(10, 7, "toys", 81, 6, 2, 2), (11, 7, None, None, None, -1, 1), (12, 7, "home", None, 0, -1, 1), (13, 8, "home", -150, 0, None, -2)]
    assert offers(lines.limit(0), sales, items).collect() == []
