"""The quality classifier's site layer against plain Python, on sites that decide and on hot, null and tied rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality_classifier as Q

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def strength(n, groups, squares, between, within, mean):
    spread = n - squares / max(n, 1)
    if groups < 2 or spread <= 0 or n <= groups:
        return 1e6
    variance = (between - (groups - 1) * within / (n - groups)) / spread
    return 1e6 if variance <= 0 else min(1e6, max(1.0, mean * (1 - mean) / variance - 1))


def plain(rows):
    """(host, path, p) of all documents -> score of each, by the definition."""
    n, mean = len(rows), sum(p for *_, p in rows) / len(rows)
    hosts, paths = {}, {}
    for h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    square = sum(p * p for *_, p in rows)
    host_sq, path_sq = (sum(sum(v) ** 2 / len(v) for v in x.values()) for x in (hosts, paths))
    host_k = strength(n, len(hosts), sum(len(v) ** 2 for v in hosts.values()), host_sq - n * mean * mean, square - host_sq, mean)
    path_k = strength(n, len(paths) - len(hosts) + 1, sum(len(v) ** 2 / len(hosts[k[0]]) for k, v in paths.items()), path_sq - host_sq, square - path_sq, mean)
    logit = lambda x: math.log(min(1 - 1e-9, max(1e-9, x)) / (1 - min(1 - 1e-9, max(1e-9, x))))
    out = []
    for h, q, p in rows:
        host = (sum(hosts[h]) - p + host_k * mean) / (len(hosts[h]) - 1 + host_k)
        path = (sum(paths[h, q]) - p + path_k * host) / (len(paths[h, q]) - 1 + path_k)
        out.append(1 / (1 + math.exp(-(logit(p) + logit(path) - logit(mean)))))
    return out


@pytest.fixture(scope="module")
def made(spark):
    """A site of junk, one of good text, and in both and elsewhere texts that tell little."""
    rng = random.Random(5)
    good, bad = ["river", "stone", "green", "house", "light", "about"], ["junkily", "junkest", "spammy"]
    rows, labels = [], []
    for i in range(900):
        site = ("junk", "fine", "rest")[i % 3]
        share = {"junk": 0.9, "fine": 0.05, "rest": 0.4}[site]
        kind = rng.random()
        is_bad = rng.random() < share
        n = rng.randrange(30, 50)
        words = [rng.choice(good) for _ in range(n)]
        if is_bad and kind < 0.7:
            words = [w + "###" if rng.random() < 0.5 else rng.choice(bad) for w in words]
        elif kind > 0.7:
            words = [w + "#" if rng.random() < 0.24 else w for w in words]  # about as common in good as in bad texts
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), site if site != "rest" else None, 0))
        labels.append((i, int(not is_bad), 0))
    docs = spark.createDataFrame(rows, DDL)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return rows, dict((i, q) for i, q, _ in labels), docs, marks, Q.train(docs, marks)


def test_scores_equal_the_definition(made):
    rows, _, docs, marks, model = made
    got = {r["doc_id"]: r for r in Q.classify(docs, marks, keep=["doc_id"], model=model).collect()}
    p = [min(1 - 1e-9, max(1e-9, got[i]["p_quality"] * (1 - got[i]["p_toxic"]))) for i in range(len(rows))]
    want = plain([(r[3], r[2], x) for r, x in zip(rows, p, strict=True)])
    assert all(abs(got[i]["score"] - want[i]) < 1e-9 and got[i]["kept"] == (got[i]["score"] >= 0.5) for i in got)


def test_sites_decide_what_texts_leave_open(made):
    rows, quality, docs, marks, model = made
    got = {r["doc_id"]: r for r in Q.classify(docs, marks, keep=["doc_id"], model=model).collect()}
    alone = {i: r["p_quality"] * (1 - r["p_toxic"]) >= 0.5 for i, r in got.items()}
    changed = [i for i, r in got.items() if r["kept"] != alone[i]]
    right = lambda verdict: sum(verdict[i] == bool(quality[i]) for i in quality) / len(quality)
    assert len(changed) > 20 and right({i: r["kept"] for i, r in got.items()}) > right(alone) + 0.02
    assert all(r["kept"] for i, r in got.items() if rows[i][3] == "fine" and "#" not in rows[i][1] and quality[i])


def test_pipeline_form_keeps_the_same_rows(spark, made, monkeypatch):
    rows, _, docs, marks, model = made
    want = sorted(r["doc_id"] for r in Q.classify(docs, marks, keep=["doc_id"], model=model).where("kept").collect())
    assert sorted(r["doc_id"] for r in Q.good_documents(docs, marks, model=model).collect()) == want
    twice = docs.unionByName(docs)
    left = Q.good_documents(twice.withColumns({c: F.lit(1) for c in ("_row_a", "_gone_a", "gone", "_evidence", "_marks")}), marks, model=model)
    assert left.count() == 2 * len(Q.classify(twice, marks, keep=["doc_id"], model=model).where("kept").select("doc_id").distinct().collect())
    assert left.columns[-5:] == ["_row_a", "_gone_a", "gone", "_evidence", "_marks"]


def test_ties_and_repeated_labels(spark):
    docs = spark.createDataFrame([(i % 5, f"word {'###' if i % 2 else 'fine'} {i % 5}", "en", "a", 0) for i in range(200)], DDL)
    marks = spark.createDataFrame([(i % 5, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert Q.classify(docs, marks).count() == 200
    flat = Q.Model(Q.Lexicon([], np.zeros(0)), np.zeros(11), np.ones(11), np.zeros(12), np.append(np.zeros(11), -30.0))  # every document at one half
    assert Q.classify(docs, marks, keep=["doc_id"], model=flat).where("kept").count() in (0, 200)
