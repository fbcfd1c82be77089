"""The fold of tags against one proposal after another, and the nearest vector with and without cells against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import tags as G
from corpusloom.operators.nearest import nearest


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not len(a):
        return 0.0
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n > 0 else 0.0


def folded(proposals, vocabulary, threshold):
    tags = [(str(i), s, e) for i, s, e in vocabulary]
    out = {}
    for at, label, e in sorted(proposals):
        slug = "-".join((label or "").lower().split())
        same = sorted(t[0] for t in tags if t[1] == slug)
        alike = [(cosine(e, t[2]), t[0]) for t in tags if t[2] is not None] if e is not None else []
        top = max((c for c, _ in alike), default=0.0)
        if same:
            out[at] = (same[0], "slug")
        elif alike and top >= threshold:
            out[at] = (min(i for c, i in alike if c >= top - 1e-12), "similar")
        else:
            out[at] = (slug, "new")
            tags.append((slug, slug, e))
    return out


@pytest.mark.parametrize("batch, options", [(2_000, {}), (7, {}), (7, {"broadcast_numbers": 0, "pivots": 5, "block_rows": 9})])
def test_fold_is_the_sequential_one(spark, batch, options):
    some = random.Random(batch)
    centres = [[some.gauss(0, 1) for _ in range(3)] for _ in range(14)]

    def vector():
        if some.random() < 0.08:
            return some.choice([None, [], [0.0, 0.0, 0.0], [1.0, 2.0]])
        return [x + some.gauss(0, 0.25) for x in some.choice(centres)]

    orders = some.sample(range(1000), 150)
    proposals = [(at, f"Tag {some.randrange(60)}", vector()) for at in orders]
    vocabulary = [(i, f"tag-{some.randrange(60)}", vector()) for i in range(12)]
    got = G.fold_tags(
        spark.createDataFrame(proposals, "n long, label string, embedding array<double>").repartition(3), "n",
        spark.createDataFrame(vocabulary, "id long, slug string, embedding array<double>"), 0.9, batch, **options,
    ).collect()
    assert {r["n"]: (r["tag_id"], r["how"]) for r in got} == folded(proposals, vocabulary, 0.9) and len(got) == len(proposals)


def test_the_slug_of_one_that_took_another_tag_stays_free(spark):
    rows = [(1, "Red", [1.0, 0.0]), (2, "Crimson", [0.99, 0.01]), (3, "Crimson", [0.0, 1.0]), (4, "crimson", [1.0, 0.0])]
    got = G.fold_tags(spark.createDataFrame(rows, "n int, label string, embedding array<double>"), "n").collect()
    assert {r["n"]: (r["tag_id"], r["how"]) for r in got} == {1: ("red", "new"), 2: ("red", "similar"), 3: ("crimson", "new"), 4: ("crimson", "slug")}
    none = spark.createDataFrame([], "n int, label string, embedding array<double>")
    assert G.fold_tags(none, "n").collect() == []


@pytest.mark.parametrize("options", [{}, {"broadcast_numbers": 0, "pivots": 6, "block_rows": 8}, {"broadcast_numbers": 0, "pivots": 1, "block_rows": 4096}])
def test_nearest_is_exact_with_ties_and_lengths(spark, options):
    some = random.Random(9)
    grid = [[float(x), float(y), float(z)] for x in (-1, 0, 1, 2) for y in (-1, 0, 1) for z in (0, 3)]
    odd = [None, [], [0.0, 0.0, 0.0], [1.0], [-1.0], [2.0, 1.0], [float("nan"), 1.0, 1.0]]
    vectors = [some.choice(grid if some.random() < 0.85 else odd) for _ in range(160)]
    vocabulary, asked = list(enumerate(vectors[:80])), list(enumerate(vectors[80:]))
    clean = lambda v: None if v is None else [0.0 if x != x else x for x in v]
    v = spark.createDataFrame(vocabulary, "id long, embedding array<double>").repartition(3)
    got = nearest(spark.createDataFrame(asked, "id long, embedding array<double>").repartition(2), v, compared="n", **options).collect()
    for r in got:
        if r["embedding"] is None:
            assert r["nearest_id"] is None and r["similarity"] is None
            continue
        scored = [(cosine(clean(asked[r["id"]][1]), clean(e)), i) for i, e in vocabulary if e is not None]
        top = max(s for s, _ in scored)
        assert abs(r["similarity"] - top) < 1e-9 and r["nearest_id"] == min(i for s, i in scored if s >= top - 1e-9)
    assert len(got) == len(asked)
    assert nearest(v, v.limit(0), **options).where("nearest_id is not null").count() == 0


def test_cells_spare_comparisons(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    make = lambda n: [(i, (centres[i % 20] + rng.normal(size=8) * 0.02).tolist()) for i in range(n)]
    v, q = (spark.createDataFrame(make(n), "id long, embedding array<double>") for n in (600, 200))
    got = nearest(q, v, compared="n", broadcast_numbers=0, pivots=40, block_rows=50)
    plain = nearest(q, v, compared="n")
    both = got.select("id", "nearest_id", "n").join(plain.select("id", F.col("nearest_id").alias("other"), F.col("n").alias("all")), "id").collect()
    assert all(r["nearest_id"] == r["other"] for r in both)
    assert sum(r["n"] for r in both) < 0.2 * sum(r["all"] for r in both)


def test_a_long_chain_of_shared_ids_is_one_entity_in_few_steps(spark, monkeypatch):
    from corpusloom.operators import entities, groups

    steps = []
    plain = groups.written
    monkeypatch.setattr(groups, "written", lambda df, name: steps.append(name) or plain(df, name))
    n = 10_000  # row k shares one id with the row before and another with the row behind
    rows = [(k, f"a{k // 2}", f"b{(k + 1) // 2}") for k in range(n)] + [(n + 1, None, None), (n + 2, "a-1", None), (n + 3, "a-1", "b-1")]
    got = {r["row"]: r["first"] for r in entities._same_ids(spark.createDataFrame(rows, "row long, x string, y string"), ("x", "y")).collect()}
    assert {got[k] for k in range(n)} == {0} and [got[n + k] for k in (1, 2, 3)] == [n + 1, n + 2, n + 2]
    assert steps.count("group-parents") <= 24


def test_a_vector_is_sent_once_to_a_block_of_many_cells(spark, monkeypatch):
    from corpusloom.operators import nearest as module

    sent, plain = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: (lambda out: sent.append(out.count()) or out if name == "nearest-visits" else out)(plain(df, name)))
    rng = np.random.default_rng(5)  # without clusters bounds rule out nothing
    make = lambda n: [(i, rng.normal(size=30).tolist()) for i in range(n)]
    v, q = (spark.createDataFrame(make(n), "id long, embedding array<double>") for n in (400, 100))
    got = nearest(q, v, compared="n", broadcast_numbers=0, pivots=40, block_rows=200)
    found, plainly = ({r["id"]: (r["nearest_id"], r["n"]) for r in x.collect()} for x in (got, nearest(q, v, compared="n")))
    assert {k: x[0] for k, x in found.items()} == {k: x[0] for k, x in plainly.items()} and sum(n for _, n in found.values()) > 0.9 * 400 * 100
    assert sent[0] == 100 and sent[1] <= 100 * 4
