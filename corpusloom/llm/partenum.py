"""N-gram Jaccard join by PartEnum signatures.

Sets are banded by size, each band's largest size 1/0.75 of its smallest, so two similar sets are in one band
or in neighbouring ones. In a band instance similar sets differ in at most k elements. The feature domain is cut
into parts by a hash, in one of two ways that a cost for each instance chooses between:

Two levels. n1 * (k2 + 1) > k first-level parts, each cut into n2 second-level parts. One first-level part has at
most k2 differences, so at most k2 of its second-level parts differ; every subset of n2 - k2 of them that is not empty
gives a signature. Where more than k2 second-level parts of each first-level part of a set hold something, some
subset that agrees with a similar set does too. Sets that are not so well filled also take the second way.

One level, n2 = 1. Of any parts at most k can differ, so of the k + 1 first non-empty parts of a set, one holds the very
same elements in the other set, and is among its k + 1 first as well.

A signature is the hash of its parts' elements. Exactness: shingles that are frequent in a sample are left out of the
first signatures, since leaving out the same features everywhere lets no two sets differ in more. A set that then has
too few non-empty parts also takes part in a second round of signatures with all of its shingles and more parts, and
if need be in a third with one shingle a part, which suffices for every set. Whatever shares a signature is compared exactly.

Texts are never shuffled. Signatures, sketches and the sets of candidate pairs are; the scans that make those sets
pass only documents that a filter of bounded size marks.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Marks, discard, free_name, materialize, settle, table, text_slices
from .components import components

WORDS = 5
#: Two sets are linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Documents that frequent shingles are looked for in, at most about, and in how many of those a frequent one is.
SAMPLE_DOCS, SAMPLE_TIMES = 5_000, 3
#: Signatures of one bucket on average.
BUCKET_SIGNATURES = 1_000_000
#: Nodes of a group that are compared in one task at a time.
GROUP_NODES = 500
#: Rows of groups that one call works on, on average.
BUCKET_NODES = 20_000
#: In the first comparison inside groups, so many of a node's nearest are compared; the second compares what is still open.
NEAREST = 3
#: Of the cost of a signature: what a comparison that comes to nothing costs, and how often an element more is shared by chance.
_COMPARED, _BY_CHANCE = 100.0, 0.3
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed shuffle of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(text: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles as sorted 64-bit hashes, one text after the other, and how many each has.

    Words are lower-cased from A to Z. A text with fewer words is one shingle, one without words none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(text, "").cast(pa.large_string()))
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    raw_ends = lists.offsets.to_numpy().astype(np.int64)[1:] - lists.offsets[0].as_py()
    ends = np.concatenate([[0], np.cumsum(full)])[raw_ends]
    starts = np.concatenate([[0], ends[:-1]])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    codes = pd.util.hash_array(np.asarray(pc.ascii_lower(coded.dictionary).to_pylist(), object), categorize=False)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(codes) - words + 1), np.uint64)
    for k in range(words):
        rolled += codes[k : k + len(rolled)] * _ODD[k % 5] + np.uint64(k // 5)
    rolled = _mix(rolled)
    windows = np.maximum(0, ends - starts - words + 1)
    tails = np.cumsum(windows)
    values = rolled[np.arange(tails[-1] if len(tails) else 0) + np.repeat(starts - (tails - windows), windows)]
    for a, b in zip((tails - windows).tolist(), tails.tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    of = np.repeat(np.arange(len(starts)), windows)
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[new], of[new]
    if len(short := np.flatnonzero((ends > starts) & (windows == 0))):
        whole = []
        for a, b in zip(starts[short].tolist(), ends[short].tolist(), strict=True):
            at = np.arange(b - a)
            whole.append((codes[a:b] * _ODD[at % 5] + np.uint64(b - a) + (at // 5).astype(np.uint64)).sum(dtype=np.uint64) ^ _ODD[(b - a) % 5])
        place = np.searchsorted(of, short)
        values, of = np.insert(values, place, _mix(np.array(whole, np.uint64))), np.insert(of, place, short)
    return values, np.bincount(of, minlength=len(starts))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each set's values, 0 for empty ones."""
    out = np.zeros(len(sizes), np.uint64)
    if len(values):
        full = sizes > 0
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


def nodes_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A name for each set, the same for equal sets."""
    return _mix(_sums(_mix(values ^ _ODD[1]), sizes) + sizes.astype(np.uint64)).view(np.int64)


@dataclass(frozen=True)
class Bands:
    """Size bands for a threshold: band i holds sizes low[i] to high[i]."""

    low: np.ndarray
    high: np.ndarray
    percent: int

    @classmethod
    def of(cls, largest: int, percent: int) -> Bands:
        low, high, at = [], [], 1
        while at <= largest or len(high) < 2:
            low.append(at)
            high.append(100 * at // percent)
            at = high[-1] + 1
        low.append(at)
        high.append(100 * at // percent)
        return cls(np.array(low), np.array(high), percent)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most elements in which similar sets of sizes a and b can differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)


def _load(top, level: int):
    """Elements of a part on average, for one level of parts."""
    if level:
        return np.where(top >= 16, 0.7, 0.25)
    return np.where(top >= 200, 2.8, np.where(top >= 64, 2.0, np.where(top >= 16, 1.0, 0.25)))


def two_levels(size: int, top: int, k: int) -> tuple[int, int, int] | None:
    """(n1, n2, k2) for an instance of sets of about ``size`` to ``top`` elements that differ in ``k``, or None where one level costs less.

    A cost is the number of signatures, each with the chance that sets that are not similar share it; and of two
    levels also the share of sets that are too sparse for them and need the signatures of one level besides.
    """
    single = lambda elements: 1 + _COMPARED * _BY_CHANCE**elements
    load = float(_load(top, 0))
    one = (k + 1) * single(load / (1 - math.exp(-load)))
    best, least = None, one
    for k2 in (1, 2, 3):
        for n2 in range(k2 + 1, k2 + 5):
            n1 = k // (k2 + 1) + 1
            many = n1 * math.comb(n2, k2)
            if k <= k2 - 1 or n1 * n2 > 256:
                continue
            filled = 1 - (1 - 1 / (n1 * n2)) ** size
            enough = sum(math.comb(n2, c) * filled**c * (1 - filled) ** (n2 - c) for c in range(k2 + 1, n2 + 1)) ** n1
            cost = many * single(size / n1 * (n2 - k2) / n2) + (1 - enough) * one
            if cost < least:
                best, least = (n1, n2, k2), cost
    return best


def _subset_signatures(values: np.ndarray, of: np.ndarray, sets: np.ndarray, salt: np.uint64, plan: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set) of the subsets of second-level parts of ``sets``, and which of these are filled well enough."""
    n1, n2, k2 = plan
    cells, m = n1 * n2, len(sets)
    place = (_mix(values ^ salt) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)
    at = np.searchsorted(sets, of) * cells + place.astype(np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    content, there = np.zeros(m * cells, np.uint64), np.zeros(m * cells, bool)
    if len(at):
        content[at[first]] = np.add.reduceat(_mix(values + _ODD[2]), first) if (order[:-1] < order[1:]).all() else np.add.reduceat(_mix(values[order] + _ODD[2]), first)
    there[at[first]] = True
    content = _mix(content + _ODD[3] * (np.arange(m * cells, dtype=np.uint64) % np.uint64(cells) + np.uint64(1))) * there
    content, there = content.reshape(m, n1, n2), there.reshape(m, n1, n2)
    out, owner = [], []
    for number, subset in enumerate(itertools.combinations(range(n2), n2 - k2)):
        some = there[:, :, subset].any(axis=2)
        name = _mix(np.arange(n1, dtype=np.uint64) * np.uint64(1024) + np.uint64(number) ^ salt ^ _ODD[0])
        out.append(_mix(content[:, :, subset].sum(axis=2, dtype=np.uint64) ^ name)[some])
        owner.append(np.broadcast_to(sets[:, None], some.shape)[some])
    return np.concatenate(out), np.concatenate(owner), (there.sum(axis=2) > k2).all(axis=1)


def signatures(values: np.ndarray, sizes: np.ndarray, bands: Bands, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, index of the set, whether it is of the instance's lower band) of all sets."""
    return _signatures(values, sizes, bands, frequent)[:3]


def _signatures(values: np.ndarray, sizes: np.ndarray, bands: Bands, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``signatures``, and whether frequent shingles may be part of one, so that very many sets may share it."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        rare = frequent[at] != values
    else:
        rare = np.ones(len(values), bool)
    band = np.searchsorted(bands.high, sizes)
    out = []
    for lower in (True, False):
        instance = band if lower else band - 1
        part = (sizes > 0) & (instance >= 0)
        top = bands.high[np.minimum(instance + 1, len(bands.high) - 1)]
        partner = np.minimum(100 * sizes // bands.percent, top) if lower else bands.high[np.maximum(instance, 0)]
        most = bands.differ(sizes, partner)
        going = part
        for i in np.unique(instance[part]).tolist():
            high = int(bands.high[min(i + 1, len(bands.high) - 1)])
            plan = two_levels(int(bands.low[i]), high, int(bands.differ(bands.high[i], high)))
            if plan:
                sets = np.flatnonzero(part & (instance == i))
                mine = rare & (part & (instance == i))[of]
                sig, owner, enough = _subset_signatures(values[mine], of[mine], sets, _mix(np.array([8 * i + 1], np.uint64))[0], plan)
                out.append((sig, owner, np.full(len(owner), lower), np.zeros(len(owner), bool)))
                going = going.copy()
                going[sets[enough]] = False
        for level in range(3):
            going_here = going[of] & (rare if level == 0 else True)
            if not going_here.any():  # no rare shingle here: all of them, at the next level
                continue
            parts = np.maximum(1, np.ceil(top / _load(top, level))).astype(np.uint64)
            v, d = values[going_here], of[going_here]
            salt = _mix(np.arange(len(bands.high) + 1, dtype=np.uint64) * np.uint64(8) + np.uint64(2 * level))[np.maximum(instance, 0)]
            place = _mix(v ^ salt[d])
            where = (place >> np.uint64(32)) * parts[d] >> np.uint64(32) if level < 2 else place >> np.uint64(1)
            if level < 2:
                order = np.argsort((d.astype(np.uint64) << np.uint64(32)) | where, kind="stable")
            else:
                order = np.lexsort((where, d))
            v, d, where = v[order], d[order], where[order]
            first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (where[1:] != where[:-1])]))
            content = np.add.reduceat(_mix(v + _ODD[2]), first)
            owner = d[first]
            opens = np.searchsorted(owner, np.arange(len(sizes)))
            rank = np.arange(len(owner)) - opens[owner]
            take = rank <= most[owner]
            owner, content, where = owner[take], content[take], where[first][take]
            out.append((_mix(content ^ _mix(where ^ salt[owner])), owner, np.full(len(owner), lower), np.full(len(owner), level > 0)))
            filled = np.bincount(d[first], minlength=len(sizes))
            going = going & (filled <= most)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _key() -> Column:
    """What names a row: its id, which may be null, and its text."""
    return F.xxhash64("doc_id", "text")


def _profile(batches):
    for batch in batches:
        for piece in text_slices(batch, "text"):
            values, sizes = shingle_sets(piece.column("text"))
            ends = np.cumsum(sizes)
            cells = [sketch(values[e - n : e]).tobytes() if n else None for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), pa.array(sizes), pa.array(nodes_of(values, sizes), mask=sizes == 0), pa.array(cells, pa.binary())], names=["doc_id", "key", "n_shingles", "node", "sketch"])


def _profiled(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, node, sketch of each row: its set's size, name and sketch, the last two null for an empty one."""
    return materialize(docs.select("doc_id", _key().alias("key"), "text").mapInArrow(_profile, f"doc_id {dict(docs.dtypes)['doc_id']}, key long, n_shingles long, node long, sketch binary"), "near-profile")


def _frequent_shingles(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Shingles of at least SAMPLE_TIMES different texts of a sample that a hash of the row picks; bounded by the sample."""
    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))

    def shingles(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                values, sizes = shingle_sets(piece.column("text"))
                node = nodes_of(values, sizes)
                keep = np.zeros(len(sizes), bool)
                keep[np.unique(node, return_index=True)[1]] = True
                own, n = np.unique(values[np.repeat(keep, sizes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    sample = docs.where(F.pmod(_key(), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")
    counted = sample.mapInArrow(shingles, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    # at least SAMPLE_TIMES of the sample's shingles stand behind each row, so these are few
    got = counted.where(F.col("n") >= SAMPLE_TIMES).select("shingle").toArrow()
    return np.sort(got.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _groups(docs: DataFrame, largest: int, total: int, frequent: np.ndarray, percent: int) -> DataFrame:
    """g, node: the sets of different nodes that share a signature, equal ones once.

    Rows of a signature without frequent shingles meet in one bucket. Of the others a third of all sets may share one:
    these are dealt by signature and node, and grouped by sums, so that no task holds all rows of a signature.
    """
    bands = Bands.of(largest, percent)
    buckets = max(64, int(total * 0.7) // BUCKET_SIGNATURES)
    shared = docs.sparkSession.sparkContext.broadcast((bands, frequent))

    def deal(batches):
        limits, often = shared.value
        for batch in batches:
            for piece in text_slices(batch, "text"):
                values, sizes = shingle_sets(piece.column("text"))
                node = nodes_of(values, sizes)
                once = np.zeros(len(sizes), bool)  # copies in a piece go as one
                once[np.unique(node, return_index=True)[1]] = True
                values, node, sizes = values[np.repeat(once, sizes)], node[once], sizes[once]
                sig, owner, lower, hot = _signatures(values, sizes, limits, often)
                bucket = np.where(hot, np.uint64(buckets) + (_mix(sig ^ node[owner].view(np.uint64)) >> np.uint64(33)) % np.uint64(buckets), (sig >> np.uint64(33)) % np.uint64(buckets))
                order = np.argsort(bucket.astype(np.int32), kind="stable")
                sig, who, lower, bucket = sig[order], node[owner[order]], lower[order], bucket[order]
                cuts = np.searchsorted(bucket, np.arange(2 * buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                cell = lambda x: pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), cell(sig), cell(who), cell(lower)], names=["bucket", "sig", "node", "lower"])

    def meet(t: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in t.column(name)), kind)
        sig, node, lower = whole("sig", np.uint64), whole("node", np.int64), whole("lower", bool)
        if t.column("bucket")[0].as_py() >= buckets:  # pairs of signature and node, each once
            order = np.lexsort((node, sig))
            sig, node, lower = sig[order], node[order], lower[order]
            first = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]))
            return pa.table({"g": sig[first].view(np.int64), "node": node[first], "lower": np.logical_or.reduceat(lower, first), "met": np.zeros(len(first), bool)})
        order = np.argsort(sig, kind="stable")
        same = sig[order]
        first = np.concatenate([[True], same[1:] != same[:-1]])
        many = ~first
        many[:-1] |= ~first[1:]
        order = order[many]
        order = order[np.lexsort((node[order], sig[order]))]
        sig, node, lower = sig[order], node[order], lower[order]
        if not len(sig):
            return pa.table({"g": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "lower": pa.array([], pa.bool_()), "met": pa.array([], pa.bool_())})
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        lowest = np.logical_or.reduceat(lower, np.flatnonzero(new))
        sig, node = sig[new], node[new]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(starts, len(sig)))
        useful = (size > 1) & np.logical_or.reduceat(lowest, starts)
        name = np.add.reduceat(_mix(node.view(np.uint64) + _ODD[3]), starts).view(np.int64)
        distinct = np.zeros(len(starts), bool)
        usable = np.flatnonzero(useful)
        distinct[usable[np.unique(name[usable], return_index=True)[1]]] = True
        keep = np.repeat(distinct, size)
        return pa.table({"g": np.repeat(name, size)[keep], "node": node[keep], "lower": np.ones(keep.sum(), bool), "met": np.ones(keep.sum(), bool)})

    dealt = docs.select("text").mapInArrow(deal, "bucket int, sig binary, node binary, lower binary")
    rows = materialize(dealt.groupBy("bucket").applyInArrow(meet, "g long, node long, lower boolean, met boolean"), "near-signatures")
    hot = rows.where("not met").select(F.col("g").alias("sig"), "node", "lower")
    shared_by = hot.groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.max("lower").alias("lower")).where("n > 1 and lower")
    named = shared_by.groupBy(F.xxhash64("x", "n").alias("g")).agg(F.min("sig").alias("of_sig"))  # signatures of the very same sets go as one
    groups = rows.where("met").select("g", "node").unionByName(hot.join(named, F.col("sig") == F.col("of_sig")).select("g", "node"))
    return groups.distinct()


def sketch(values: np.ndarray) -> np.ndarray:
    """An odd sketch: the parity of how many elements fall on each bit, 64 bits a word, at least four bits an element.

    Two sketches differ in no more bits than the sets do in elements, also after ``_folded`` made them equally long.
    """
    bits = min(1 << 17, max(256, 1 << int(4 * len(values) - 1).bit_length()))
    return np.packbits(np.bincount((_mix(values ^ _ODD[4]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").view(np.uint64)


def _folded(words: np.ndarray, length: int) -> np.ndarray:
    return np.bitwise_xor.reduce(words.reshape(-1, length), axis=0)


def _sketches(profile: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, sketch of the given nodes."""
    rows = profile.join(nodes.withColumnRenamed("node", "of_node"), F.col("node") == F.col("of_node"), "left_semi").select("node", F.col("n_shingles").alias("n"), "sketch")
    return materialize(rows.dropDuplicates(["node"]), "near-sketch")


def _sets(docs: DataFrame, profile: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, shingles of the given nodes, made again from one document of each; and of some more nodes, which the filter lets pass."""
    chosen = materialize(profile.join(nodes.withColumnRenamed("node", "of_node"), F.col("node") == F.col("of_node"), "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key"), "near-documents")

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                values, sizes = shingle_sets(piece.column("text"))
                node, ends = nodes_of(values, sizes), np.cumsum(sizes)
                once = np.intersect1d(np.unique(node, return_index=True)[1], np.flatnonzero(sizes))
                cells = [values[ends[k] - sizes[k] : ends[k]].tobytes() for k in once.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(node[once]), pa.array(sizes[once]), pa.array(cells, pa.binary())], names=["node", "n", "shingles"])

    marked, _ = Marks(chosen).split(docs.select(_key().alias("key"), "text"), "key")
    rows = materialize(marked.select("text").mapInArrow(run, "node long, n long, shingles binary").dropDuplicates(["node"]), "near-shingles")
    discard(chosen)
    return rows


def _filtered(pairs: DataFrame, of_nodes: DataFrame, test) -> DataFrame:
    """The pairs (a, b) that pass ``test`` on sizes and bytes that ``of_nodes`` has of both. Rows of hot nodes are split by the skew join."""
    name = of_nodes.columns[-1]
    one = of_nodes.select(F.col("node").alias("node_a"), F.col("n").alias("p"), F.col(name).alias("x"))
    two = of_nodes.select(F.col("node").alias("node_b"), F.col("n").alias("q"), F.col(name).alias("y"))

    def run(batches):
        for batch in batches:
            p, q = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                keep[k] = test(int(p[k]), int(q[k]), np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
            yield batch.select([0, 1]).filter(pa.array(keep))

    rows = pairs.join(two, F.col("b") == F.col("node_b")).join(one, F.col("a") == F.col("node_a")).select("a", "b", "p", "q", "x", "y")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _maybe_similar(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches do not tell apart."""

    def near(p: int, q: int, x: np.ndarray, y: np.ndarray) -> bool:
        short = min(len(x), len(y))
        return 100 * min(p, q) >= percent * max(p, q) and int(np.bitwise_count(_folded(x, short) ^ _folded(y, short)).sum(dtype=np.int64)) <= (100 - percent) * (p + q) // (100 + percent)

    return _filtered(pairs, sketches, near)


def _verified(docs: DataFrame, profile: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Only the sets of their nodes are made again and shuffled."""

    def similar(p: int, q: int, x: np.ndarray, y: np.ndarray) -> bool:
        common = int((y[np.minimum(np.searchsorted(y, x), q - 1)] == x).sum())
        return 100 * common >= percent * (p + q - common)

    pairs = materialize(pairs.distinct(), "near-pairs")
    if pairs.isEmpty():
        return pairs
    sets = _sets(docs, profile, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = materialize(_filtered(pairs, sets, similar), "near-links")
    for t in (sets, pairs):
        discard(t)
    settle(docs.sparkSession)
    return links


def _near_pairs(x: np.ndarray, labels: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of pairs with different labels that sizes and sketches do not tell apart, and in how many bits the sketches differ."""
    found = []
    m = len(x)
    step = m if m <= 64 else 1  # small groups at once, large ones a row at a time
    for at in range(0, m, step):
        i, j = np.triu_indices(m, 1) if step == m else (np.full(m - at - 1, at), np.arange(at + 1, m))
        open_ = (labels[i] != labels[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[open_], j[open_]
        apart = np.bitwise_count(x[i] ^ x[j]).sum(axis=1, dtype=np.int64)
        near = apart <= (100 - percent) * (n[i] + n[j]) // (100 + percent)
        found.append((i[near], j[near], apart[near]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _pairs_in_bucket(t: pa.Table, percent: int, nearest: int | None) -> pa.Table:
    """Pairs of nodes to compare in the blocks (g, i, j) of a table.

    With ``nearest``, only of nodes whose ``own`` group it is, and of each the pairs with so many whose sketches differ least.
    """
    t = t.combine_chunks()
    col = lambda name: t.column(name).to_numpy()
    order = np.lexsort((col("node"), col("j"), col("i"), col("g")))
    g, bi, bj, node, label, n, own = (col(c)[order] for c in ("g", "i", "j", "node", "label", "n", "own"))
    sketches = t.column("sketch").chunk(0)
    offsets = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset : sketches.offset + len(sketches) + 1].astype(np.int64)
    words = np.frombuffer(sketches.buffers()[2], np.uint64, offsets[-1] // 8)
    starts, lengths = offsets[:-1][order] // 8, np.diff(offsets)[order] // 8
    block = np.ones(len(g), bool)
    block[1:] = (g[1:] != g[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
    cuts = np.append(np.flatnonzero(block), len(g))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a < 2 or (label[a:b] == label[a]).all():
            continue
        short = int(lengths[a:b].min())
        if (lengths[a:b] == short).all():
            x = words[starts[a:b, None] + np.arange(short)]
        else:
            x = np.stack([_folded(words[s : s + k], short) for s, k in zip(starts[a:b], lengths[a:b], strict=True)])
        i, j, apart = _near_pairs(x, label[a:b], n[a:b], percent)
        if nearest:
            source, other, apart = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([apart, apart])
            mine = own[a + source]
            source, other, apart = source[mine], other[mine], apart[mine]
            by = np.lexsort((other, apart, source))
            source, other = source[by], other[by]
            rank = np.arange(len(source)) - np.searchsorted(source, source)
            i, j = source[rank < nearest], other[rank < nearest]
        left.append(node[a + i])
        right.append(node[a + j])
    one, two = np.concatenate(left), np.concatenate(right)
    both = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)]), axis=1) if len(one) else np.zeros((2, 0), np.int64)
    return pa.table({"a": both[0], "b": both[1]})


def _open_pairs(groups: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """Pairs (a, b) to compare in groups that still have several labels; groups are cut into blocks, and each two blocks meet in one task."""
    labelled = groups.join(labels.withColumnRenamed("node", "of_node"), F.col("node") == F.col("of_node"), "left").select("g", "node", F.coalesce("label", "node").alias("label"))
    open_ = labelled.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x <> y").select(F.col("g").alias("of_g"), F.col("n").alias("size"), F.ceil(F.col("n") / GROUP_NODES).cast("int").alias("blocks"))
    members = labelled.join(open_, F.col("g") == F.col("of_g")).select("g", "node", "label", "blocks", "size")
    if nearest:  # a node's largest group is its own
        largest = members.groupBy("node").agg(F.max(F.struct("size", "g")).alias("first")).select(F.col("node").alias("of_node"), F.col("first.g").alias("own_g"))
        members = members.join(largest, F.col("node") == F.col("of_node")).withColumn("own", F.col("g") == F.col("own_g"))
    else:
        members = members.withColumn("own", F.lit(True))
    blocked = members.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocked = blocked.select("g", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", "label", "own")
    sketched = blocked.join(sketches.select(F.col("node").alias("of_node"), F.col("n").alias("size"), "sketch"), F.col("node") == F.col("of_node")).select("g", "i", "j", "node", "label", "own", F.col("size").alias("n"), "sketch")
    replicated = open_.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0
    buckets = max(16, replicated // BUCKET_NODES)
    bucket = F.pmod(F.xxhash64("g", "i", "j"), F.lit(buckets)).alias("bucket")
    return sketched.groupBy(bucket).applyInArrow(lambda t: _pairs_in_bucket(t, percent, nearest), "a long, b long").distinct()


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, key, n_shingles, label of each row: equal labels for all that links connect, null for an empty set.

    Equal sets are one node, so copies cost nothing further. Each node goes first to the node it shares most
    groups with; then, in groups with several labels, to the nearest of other labels; then all that still have
    different labels in a group are compared, but for pairs that sizes or sketches prove too different. Groups are
    worked on in blocks of about GROUP_NODES nodes.
    """
    spark = docs.sparkSession
    profile = _profiled(docs)
    size = profile.agg(F.count("*").alias("n"), F.max("n_shingles").alias("largest"), F.sum("n_shingles").alias("total")).first()
    if not size["largest"]:
        return profile.select("doc_id", "key", "n_shingles", F.lit(None).cast("long").alias("label"))
    frequent = _frequent_shingles(docs, size["n"])
    groups = materialize(_groups(docs, size["largest"], size["total"], frequent, percent), "near-groups")
    settle(spark)
    sketches = _sketches(profile, groups.select("node").distinct())

    hubs = groups.groupBy("g").agg(F.min("node").alias("a")).withColumnRenamed("g", "of_g")
    stars = groups.join(hubs, F.col("g") == F.col("of_g")).where("a <> node").groupBy(F.col("node").alias("b"), "a").agg(F.count("*").alias("n"))
    best = stars.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = _verified(docs, profile, _maybe_similar(best, sketches, percent), percent)
    labels = components(links)
    for nearest in (NEAREST, None):
        more = _verified(docs, profile, _open_pairs(groups, labels, sketches, percent, nearest), percent)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    for t in (sketches, groups):
        discard(t)

    return profile.join(labels.withColumnRenamed("node", "of_node"), F.col("node") == F.col("of_node"), "left").select("doc_id", "key", "n_shingles", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_shingles, component_id, a row for each row.

    n_shingles is the size of the set; component_id the smallest id that links reach. Null and empty texts and
    texts without words have no shingle and their own id. Rows with a null id link others as any row; null
    is a component's id only where all of it are null. Repeated rows have equal results. Extra columns are not
    looked at; an empty table gives an empty result.
    """
    named = _labelled(docs, percent)
    smallest = named.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least")).withColumnRenamed("label", "of_label")
    return named.join(smallest, F.col("label") == F.col("of_label"), "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _node_links(docs: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of nodes whose sets are similar, each once."""
    spark = docs.sparkSession
    profile = _profiled(docs)
    size = profile.agg(F.count("*").alias("n"), F.max("n_shingles").alias("largest"), F.sum("n_shingles").alias("total")).first()
    if not size["largest"]:
        return spark.createDataFrame([], "a long, b long")
    groups = materialize(_groups(docs, size["largest"], size["total"], _frequent_shingles(docs, size["n"]), percent), "near-groups")
    settle(spark)
    sketches = _sketches(profile, groups.select("node").distinct())
    apart = spark.createDataFrame([], "node long, label long")  # every node a label of its own, so no pair is passed over
    links = _verified(docs, profile, _open_pairs(groups, apart, sketches, percent, None), percent)
    for t in (sketches, groups):
        discard(t)
    return links


def near_links(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text, ...) -> class_a, class_b: every link between different sets, each once.

    A class is the documents of one set, named by its smallest id, or null without any; of a link class_a is not above
    class_b, nulls last, and they are equal only where an id is repeated with other texts. Texts without words have no class.
    All pairs in a group are compared, but for those that sizes or sketches prove too different, so m sets that
    are all similar cost m * m / 2 rows, as many as their links.
    """
    profile = _profiled(docs)
    least = materialize(profile.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least")), "near-classes")
    named = lambda end: least.select(F.col("node").alias(f"node_{end}"), F.col("least").alias(f"least_{end}"))
    both = _node_links(docs, percent).join(named("a"), F.col("a") == F.col("node_a")).join(named("b"), F.col("b") == F.col("node_b"))
    return both.select(F.least("least_a", "least_b").alias("class_a"), F.when(F.col("least_a").isNotNull() & F.col("least_b").isNotNull(), F.greatest("least_a", "least_b")).alias("class_b"))


def link_counts(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_links, a row for each row: how many rows of the table, copies among them, its set is similar to, without itself.

    Rows with a null id count as any; texts without words have no link and count for none.
    """
    profile = _profiled(docs)
    sizes = materialize(profile.where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("rows")), "near-classes")
    links = _node_links(docs, percent)
    ends = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    others = ends.join(sizes, F.col("y") == F.col("node")).groupBy("x").agg(F.sum("rows").alias("others"))
    counted = sizes.join(others, F.col("node") == F.col("x"), "left").select(F.col("node").alias("of_node"), (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    return profile.join(counted, F.col("node") == F.col("of_node"), "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with their columns.

    Of a component without any id the text of the smallest hash stays. Of repeated rows, of equal id and text, all stay. Only rows that a filter
    of bounded size marks are shuffled, to be held against the exact keys; the others stay where they are.
    """
    named = _labelled(docs, PERCENT)
    smallest = named.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least"), F.min("key").alias("least_key")).withColumnRenamed("label", "of_label")
    held = named.select("doc_id", "key", "label").join(smallest, F.col("label") == F.col("of_label"))
    later = F.when(F.col("least").isNull(), F.col("key") > F.col("least_key")).otherwise(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    name, gone_name = free_name(docs, "_key"), free_name(docs, "_gone")
    gone = materialize(held.where(later).select(F.col("key").alias(gone_name)).distinct(), "near-gone")
    maybe, others = Marks(gone).split(docs.withColumn(name, _key()), name)
    left = others.unionByName(maybe.join(gone, F.col(name) == F.col(gone_name), "left_anti").select(*[F.col(f"`{c}`") for c in maybe.columns]))
    return left.drop(name)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, g FROM (
  SELECT rid, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT rid, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS rid, y AS other FROM e UNION SELECT r.rid, e.y FROM r JOIN e ON r.other = e.x),
m AS (SELECT rid, min(doc_id) AS least FROM (SELECT rid, other FROM r UNION ALL SELECT rid, rid FROM d) t JOIN (SELECT rid AS q, doc_id FROM d) u ON other = q GROUP BY rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least AS component_id FROM d JOIN m USING (rid) LEFT JOIN n USING (rid)
"""
