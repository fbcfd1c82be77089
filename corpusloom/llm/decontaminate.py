"""Benchmark decontamination: rare n-grams as seeds, Smith-Waterman alignment for the verdict.

The n-grams of all test items are counted over all documents. Each item's rarer ones become its seeds.
Documents that hold seeds of an item near each other are aligned with it there; the local alignment's score,
as a share of the item's perfect score, tells copies, also edited and paraphrased ones, from chance.

The corpus is scanned twice, whatever the size of the benchmark: once to count, once to write the documents that hold
seeds near each other at all. Both scans carry filters of bounded size, and what these let pass without need is told
apart by joins and alignment. Only the documents written are then held against the test items, a block of bounded size at a time.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_slices

SEED_WORDS = 3
#: An item's n-gram is a seed if it is in no more documents than this many times its median one, or than this share of all.
RARE_TIMES = 4.0
RARE_SHARE = 0.001
#: Distinct seeds that must lie near each other, where the item has as many.
MIN_SEEDS = 2
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
#: Test items are taken in blocks of at most so many words, so what is broadcast is bounded.
BLOCK_WORDS = 2_000_000
#: Bits of a filter of n-grams at most: 16 MB.
FILTER_BITS = 1 << 27
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SPLIT = r"[^\p{L}\p{M}\p{N}]+"


def tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of lower-cased texts, letters and digits only, and the ends of each text's."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(text, "").cast(pa.large_string())), pattern=_SPLIT)
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy().astype(np.int64)[1:] - lists.offsets[0].as_py()]
    return flat.filter(pa.array(full)), ends


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    return pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), object), categorize=False)[coded.indices.to_numpy(zero_copy_only=False)]


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One integer for each n-gram of words; n-grams of different lengths differ."""
    out = np.full(max(0, len(hashes) - n + 1), n, np.uint64) if n else np.zeros(0, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + len(out)] * _ODD[k]) * _ODD[0]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _grams_of(hashes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The different n-grams of each text: of SEED_WORDS words, or of all where a text has fewer."""
    return [np.unique(ngrams(h, min(SEED_WORDS, len(h)))) for h in np.split(hashes, ends[:-1])] if len(ends) else []


class Filter:
    """A Bloom filter of 64-bit integers, of 16 bits each up to a bound; beyond it, more integers pass that are not of them."""

    def __init__(self, n: int, max_bits: int = FILTER_BITS) -> None:
        bits = min(max_bits.bit_length() - 1, max(16, (16 * n).bit_length()))
        self.shift, self.ones = np.uint64(64 - bits), np.zeros(1 << (bits - 3), np.uint8)

    def _places(self, values: np.ndarray):
        for odd in _ODD:
            yield (values * odd >> self.shift).astype(np.int64)

    def add(self, values: np.ndarray) -> None:
        for place in self._places(values.view(np.uint64)):
            np.bitwise_or.at(self.ones, place >> 3, (1 << (place & 7)).astype(np.uint8))

    def holds(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for place in self._places(values.view(np.uint64)):
            rest = np.flatnonzero(out)
            at = place[rest]
            out[rest] = (self.ones.take(at >> 3) >> (at & 7)) & 1 != 0
        return out


class Owners:
    """For each n-gram 64 bits, one for every 64th of the items it is a seed of; in a table of bounded size, where n-grams may share an entry."""

    def __init__(self, n: int, max_bits: int = FILTER_BITS) -> None:
        bits = min(max_bits.bit_length() - 1 - 6, max(10, (4 * n).bit_length()))
        self.shift, self.bits = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64)

    def _at(self, grams: np.ndarray) -> np.ndarray:
        return (grams.view(np.uint64) * _ODD[1] >> self.shift).astype(np.int64)

    def add(self, grams: np.ndarray, items: np.ndarray) -> None:
        np.bitwise_or.at(self.bits, self._at(grams), np.uint64(1) << (items.view(np.uint64) * _ODD[0] >> np.uint64(58)))

    def of(self, grams: np.ndarray) -> np.ndarray:
        return self.bits.take(self._at(grams))


def _in_parts(rows: DataFrame):
    """Rows with a column gram, as Arrow tables of about a million rows."""
    parts = rows.count() // 1_000_000 + 1
    for k in range(parts):
        yield rows.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k).toArrow()


def _filter_of(grams: DataFrame) -> Filter:
    """The filter of a column of n-grams."""
    out = Filter(grams.count())
    for part in _in_parts(grams):
        out.add(part.column("gram").to_numpy())
    return out


@dataclass
class Items:
    """A block of test items as codes of their words, and their seeds: all different ones, and each item's."""

    ids: list
    words: pa.Array
    codes: list[np.ndarray]
    keys: np.ndarray
    owners: np.ndarray
    owner_keys: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], seeds: np.ndarray) -> Items:
        """From (item_id, text) rows and all seeds of the block as mixes of item and n-gram."""
        flat, ends = tokens(pa.array([r[1] for r in rows], pa.string()))
        coded = flat.dictionary_encode()
        codes = np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends[:-1])
        grams = _grams_of(word_hashes(flat), ends)
        owners, owner_keys = np.repeat(np.arange(len(rows)), [len(g) for g in grams]), np.concatenate([*grams, np.zeros(0, np.int64)])
        names = np.repeat(item_names(flat, ends), [len(g) for g in grams])
        seed = np.isin(_seed_name(names, owner_keys), seeds)
        owners, owner_keys = owners[seed], owner_keys[seed]
        order = np.argsort(owner_keys, kind="stable")
        return cls([r[0] for r in rows], coded.dictionary, codes, np.unique(owner_keys), owners[order], owner_keys[order])

    def code(self, words: pa.Array) -> np.ndarray:
        """The codes of words, -1 for those of no item."""
        coded = words.dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, self.words), -1).to_numpy(zero_copy_only=False)
        return at[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64) if len(words) else np.zeros(0, np.int64)


def item_names(flat: pa.Array, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each item, from all its words in turn: items of the same words have the same seeds."""
    out = np.zeros(len(ends), np.uint64)
    for k, h in enumerate(np.split(word_hashes(flat), ends[:-1]) if len(ends) else ()):
        out[k] = (h * (np.arange(len(h), dtype=np.uint64) * _ODD[1] + _ODD[0])).sum(dtype=np.uint64) ^ np.uint64(len(h))
    return out.view(np.int64)


def _seed_name(names: np.ndarray, grams: np.ndarray) -> np.ndarray:
    x = (names.view(np.uint64) ^ grams.view(np.uint64) * _ODD[2]) * _ODD[0]
    return (x ^ x >> np.uint64(31)).view(np.int64)


def _hits(lengths: set[int], hashes: np.ndarray, ends: np.ndarray, known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, n-gram) of the n-grams that ``known`` lets pass, in texts that follow each other in ``hashes``."""
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    out = [np.zeros((0, 3), np.int64)]
    for n in sorted(lengths):
        grams = ngrams(hashes, n)
        at = np.flatnonzero(of[: len(grams)] == of[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
        at = at[known(grams[at])]
        out.append(np.column_stack([of[at], at, grams[at]]))
    return tuple(np.concatenate(out).T)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """The best Smith-Waterman score of two code sequences and where it ends in the window. Unknown words match nothing."""
    steps = -GAP * np.arange(len(window) + 1)
    last = np.zeros(len(window) + 1, np.int64)
    best, at = 0, 0
    for word in item:
        here = np.zeros(len(window) + 1, np.int64)
        here[1:] = np.maximum(0, last[:-1] + np.where(window == word, MATCH, MISMATCH))
        here = np.maximum(here, last + GAP)
        here = np.maximum(0, np.maximum.accumulate(here + steps) - steps)  # gaps along the window
        k = int(here.argmax())
        if here[k] > best:
            best, at = int(here[k]), k
        last = here
    return best, at


def _windows(places: np.ndarray, keys: np.ndarray, length: int, needed: int) -> list[tuple[int, int]]:
    """Spans with ``needed`` distinct seeds within twice the item's length, each widened by that length."""
    reach = 2 * length + 8
    spans: list[tuple[int, int]] = []
    first = 0
    for k in range(len(places)):
        while places[k] - places[first] > reach:
            first += 1
        if k - first + 1 >= needed and len(set(keys[first : k + 1])) >= needed:
            lo, hi = max(0, int(places[first]) - reach), int(places[k]) + reach
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], hi)
            else:
                spans.append((lo, hi))
    return spans


def leaks_of(items: Items, text: pa.Array, min_score: float = MIN_SCORE) -> list[tuple[int, int, float, int]]:
    """(text, item, score, first word behind the passage) for each item that a text holds."""
    flat, ends = tokens(text)
    codes = items.code(flat)
    lengths = {min(SEED_WORDS, len(c)) for c in items.codes} - {0}
    hits = np.column_stack(_hits(lengths, word_hashes(flat), ends, lambda g: items.keys[np.minimum(np.searchsorted(items.keys, g), len(items.keys) - 1)] == g))
    lo = np.searchsorted(items.owner_keys, hits[:, 2], "left")
    hi = np.searchsorted(items.owner_keys, hits[:, 2], "right")
    reps = hi - lo
    rows = np.repeat(np.arange(len(hits)), reps)
    owner_at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(lo, reps)
    of, place, owner = hits[rows, 0], hits[rows, 1], items.owners[owner_at]
    order = np.lexsort((place, owner, of))
    of, place, owner, key = of[order], place[order], owner[order], owner_at[order]
    starts = ends - np.diff(ends, prepend=0)
    cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(owner) != 0)) + 1 if len(of) else np.zeros(0, np.int64)
    found = []
    seeds_of = np.bincount(items.owners, minlength=len(items.codes))
    for a, b in zip(np.concatenate([[0], cuts]), np.append(cuts, len(of)), strict=True) if len(of) else ():
        t, i = int(of[a]), int(owner[a])
        item = items.codes[i]
        best, end = 0, 0
        for x, y in _windows(place[a:b] - starts[t], key[a:b], len(item), min(MIN_SEEDS, int(seeds_of[i]))):
            score, at = align(item, codes[starts[t] + x : min(ends[t], starts[t] + y)])
            if score > best:
                best, end = score, x + at
        if best >= min_score * MATCH * len(item):
            found.append((t, i, best / (MATCH * len(item)), end))
    return found


def _blocks(benchmark: DataFrame, block_words: int):
    """Test items, a block at a time, each of bounded size."""
    block, size = [], 0
    for r in benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct().sort("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += r["text"].count(" ") + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _item_grams(benchmark: DataFrame) -> DataFrame:
    """item, gram, length: the different n-grams of each test item, by the name of its words."""

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                flat, ends = tokens(piece.column("text"))
                grams = _grams_of(word_hashes(flat), ends)
                sizes = [len(g) for g in grams]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(item_names(flat, ends), sizes)), pa.array(np.concatenate([*grams, np.zeros(0, np.int64)])), pa.array(np.repeat(np.diff(ends, prepend=0), sizes))], names=["item", "gram", "length"])

    return materialize(benchmark.where(F.col("item_id").isNotNull()).select("text").mapInArrow(run, "item long, gram long, length long").distinct(), "leak-grams")


def _seeds(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item, gram, length, n: the seeds of each test item, and how many it has.

    A scan of all documents counts in how many of them each n-gram is; a task gives one row for each n-gram and batch.
    """
    grams = _item_grams(benchmark)
    lengths = {min(SEED_WORDS, r[0]) for r in grams.select(F.least("length", F.lit(SEED_WORDS))).distinct().collect()}
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(grams.select("gram").distinct()))

    def count(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                flat, ends = tokens(piece.column("text"))
                of, _, gram = _hits(lengths, word_hashes(flat), ends, shared.value.holds)
                order = np.lexsort((of, gram))
                gram, of = gram[order], of[order]
                new = np.ones(len(gram), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
                gram, n = np.unique(gram[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], names=["of_gram", "n"])

    counted = docs.select("text").mapInArrow(count, "of_gram long, n long").groupBy("of_gram").agg(F.sum("n").alias("df"))
    own = grams.join(counted, F.col("gram") == F.col("of_gram"), "left").select("item", "gram", "length", F.coalesce("df", F.lit(0)).alias("df"))
    item = Window.partitionBy("item")
    ranked = own.withColumn("rank", F.row_number().over(item.orderBy("df", "gram"))).withColumn("all", F.count("*").over(item))
    ranked = ranked.withColumn("median", F.max(F.when(F.col("rank") == F.floor(F.col("all") / 2) + 1, F.col("df"))).over(item))
    rare = ranked.where(F.col("df") <= F.greatest(RARE_TIMES * F.col("median"), F.lit(RARE_SHARE * docs.count())))
    return materialize(rare.select("item", "gram", "length", F.count("*").over(item).alias("n")), "leak-seeds")


def _near_seeds(docs: DataFrame, seeds: DataFrame):
    """A function from texts to whether each holds the seeds that an alignment asks for, near each other, or may do so."""
    bounds = seeds.agg(F.max("length").alias("longest"), F.collect_set(F.least("length", F.lit(SEED_WORDS))).alias("lengths")).first()
    lengths, reach = set(bounds["lengths"]), 2 * bounds["longest"] + 8
    alone = _filter_of(seeds.where(F.col("n") < MIN_SEEDS).select("gram").distinct())
    several = _filter_of(seeds.select("gram").distinct())
    owners = Owners(seeds.count())
    for part in _in_parts(seeds.select("gram", "item")):
        owners.add(part.column("gram").to_numpy(), part.column("item").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((alone, several, owners))

    def near(text: pa.Array) -> np.ndarray:
        one, many, owned = shared.value
        flat, ends = tokens(text)
        of, place, gram = _hits(lengths, word_hashes(flat), ends, many.holds)
        out = np.zeros(len(text), bool)
        out[of[one.holds(gram)]] = True
        order = np.lexsort((place, of))
        of, place, owner = of[order], place[order], owned.of(gram[order])
        left = np.arange(len(of))
        for lag in itertools.count(1):  # pairs of hits, the nearest first, until no two are near enough
            left = left[~out[of[left]]]
            left = left[left + lag < len(of)]
            left = left[(of[left + lag] == of[left]) & (place[left + lag] - place[left] <= reach)]
            if not len(left):
                return out
            out[of[left[(owner[left] & owner[left + lag]) != 0]]] = True

    return near


def _scan(docs: DataFrame, near, wanted: bool) -> DataFrame:
    """The rows of ``docs`` whose texts hold seeds near each other, or the others."""
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                yield piece.filter(pa.array(near(piece.column(place)) == wanted))

    return docs.mapInArrow(run, docs.schema)


def _block_items(spark: SparkSession, benchmark: DataFrame, seeds: DataFrame, block_words: int):
    """Test items with their seeds, a block of bounded size at a time."""
    for block in _blocks(benchmark, block_words):
        flat, ends = tokens(pa.array([r[1] for r in block], pa.string()))
        names = spark.createDataFrame(pa.table({"of_item": np.unique(item_names(flat, ends))}))
        own = seeds.join(F.broadcast(names), F.col("item") == F.col("of_item")).select("item", "gram").toArrow()  # no more rows than the block has words
        items = Items.of(block, _seed_name(own.column("item").to_numpy(), own.column("gram").to_numpy()))
        if len(items.keys):
            yield items


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, text, ...) and (item_id, text) -> doc_id, item_id, score, end: a row for each item that a document holds.

    score is the alignment's share of the item's perfect score, at least ``min_score``; end is the number of the
    document's words up to the passage's end. Null texts and ids of items, and items without words, hold nothing;
    null, empty and short documents hold nothing; a null doc_id passes through. Repeated documents give repeated
    rows, repeated items one. N-grams of an item that are equally rare are all seeds or none is. Extra columns are not
    looked at; an empty table gives an empty result. Documents are never shuffled. What a block of items finds is written
    before the next one is read, so the driver and each task hold one block, however large the benchmark.
    """
    spark, kinds = docs.sparkSession, (dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"])
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, end long"
    out = spark.createDataFrame([], schema)
    seeds = _seeds(docs, benchmark)
    if seeds.isEmpty():
        return out
    held = materialize(_scan(docs.select("doc_id", "text"), _near_seeds(docs, seeds), True), "leak-documents")
    kind = benchmark.schema["item_id"].dataType
    for items in _block_items(spark, benchmark, seeds, block_words):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            from pyspark.sql.pandas.types import to_arrow_type

            known = shared.value
            for batch in batches:
                for piece in text_slices(batch, "text"):
                    found = leaks_of(known, piece.column("text"), min_score)
                    at = pa.array([f[0] for f in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("doc_id").take(at), pa.array([known.ids[f[1]] for f in found], to_arrow_type(kind)), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())],
                        names=["doc_id", "item_id", "score", "end"],
                    )

        out = out.unionByName(materialize(held.mapInArrow(run, schema), "leaks"))
        shared.destroy()
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns. Each block's survivors are written before the next."""
    seeds = _seeds(docs, benchmark)
    if seeds.isEmpty():
        return docs
    near = _near_seeds(docs, seeds)
    held = materialize(_scan(docs, near, True), "leak-documents")
    place = docs.columns.index("text")
    for items in _block_items(docs.sparkSession, benchmark, seeds, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in batches:
                for piece in text_slices(batch, "text"):
                    keep = np.ones(piece.num_rows, bool)
                    keep[[f[0] for f in leaks_of(shared.value, piece.column(place), min_score)]] = False
                    yield piece.filter(pa.array(keep))

        held = materialize(held.mapInArrow(run, docs.schema), "leak-survivors")
    return _scan(docs, near, False).unionByName(held)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
