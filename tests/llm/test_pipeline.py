import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from corpusloom.llm.common import n_words

from . import brute
from .test_operators import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    item = prose(rng, 30)
    docs, labels = [], []
    for i in range(300):
        w = prose(rng, rng.randrange(30, 90)).split()
        if i % 10 == 0:
            w = [x + "%%%" for x in w]
        elif i % 10 == 1:
            for _ in range(5):
                w[rng.randrange(len(w))] = "vilest"
        labels.append((i, int(i % 10 != 0), int(i % 10 == 1)))
        docs.append((i, " ".join(w), "en", rng.choice("abc"), 0))
    docs += [(1000 + k, docs[5][1] + (" end" if k % 2 else ""), "en", "a", 0) for k in range(10)]
    docs += [(2000 + k, f"{prose(rng, 40)} {item} {prose(rng, 20)}", "en", "b", 0) for k in range(5)]
    docs += [(3000, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_plain_versions(spark, folder):
    from corpusloom.llm.token_output import default_tokenizer
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    classify, join, decontaminate, mix, write = (f for _, f in corpus_pipeline.STAGES)
    judged = classify(spark, docs, folder).cache()
    kept = {r["doc_id"] for r in judged.collect()}
    assert {i for i in range(300) if i % 10 > 1} <= kept and not {i for i in range(300) if i % 10 < 2} & kept
    joined = join(spark, judged, folder).cache()
    rows = [(r["doc_id"], r["text"]) for r in judged.collect()]
    assert {r["doc_id"] for r in joined.collect()} == {c for _, _, c in brute.near(rows)}
    clean = decontaminate(spark, joined, folder).cache()
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in joined.collect()} - set(range(2000, 2005))
    mixed = mix(spark, clean, folder).cache()
    sizes = {}
    for r in clean.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    want = brute.fixpoint_targets(sizes)
    got = {r["source"]: r["n"] for r in mixed.groupBy("source").agg({"n": "sum"}).collect()} if "n" in mixed.columns else {r[0]: r[1] for r in mixed.withColumn("n", n_words(mixed["text"])).groupBy("source").sum("n").collect()}
    assert all(got.get(s, 0) == int(t) for s, t in want.items())
    for f in (judged, joined, clean, mixed):
        assert f.columns == columns
    library = Tokenizer.from_file(default_tokenizer())
    ids = sorted((r["doc_id"], zlib.crc32(np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in mixed.collect())
    out = write(spark, mixed, folder).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in out) == ids
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in out)
    assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(starts, starts[1:], strict=False))


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 100
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
