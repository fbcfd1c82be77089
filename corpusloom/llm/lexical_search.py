"""Ranked lexical search over an inverted index in shards.

An index row is the posting list of a term in a shard: the shard's documents that hold it, in ascending order of doc_id,
as gaps in variable-length bytes, with the term's frequency in each. A shard's first row has its documents' ids and
sizes instead. A search merges the lists of an item's terms document at a time: a heap has each list's next document, what
stands first is taken from all lists that hold it, for a window of documents at once, and summed, and a bounded heap keyed
by score and then doc_id keeps the best ones. The shards' best are merged for all items by a ranking that is cut in each task first.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_slices

BEST = 10
#: A term is a longest run of these: digits, letters, and everything beyond ASCII.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text of a shard, about; a longer document is a shard of its own.
SHARD_BYTES = 16_000_000
#: Pairs of an item and a term that are searched at a time: what is broadcast and what the driver holds of the items.
BLOCK_TERMS = 200_000
#: Documents that are merged at a time.
WINDOW = 4_096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_byte = np.arange(256)
_IN_TERM = (_byte >= 128) | (_byte >= 48) & (_byte <= 57) | (_byte >= 65) & (_byte <= 90) | (_byte >= 97) & (_byte <= 122)
_FOLD = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)


def terms(text: Column) -> Column:
    """The terms of a text in turn, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM_PATTERN), 0)


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of an array of texts in turn, and of each the text's number: ``terms`` for what a shard holds."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    inside = _IN_TERM.take(data)
    edge = inside.copy()
    cuts = (offsets - offsets[0])[:-1]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[cuts[cuts < len(data)]] = False  # a term ends with its text
    edge &= ~before
    starts = np.flatnonzero(edge)
    kept = np.cumsum(inside)
    places = kept[starts] - 1
    bounds = np.append(places, kept[-1] if len(kept) else 0).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(_FOLD.take(data[inside])))
    return found, np.searchsorted(offsets[1:] - offsets[0], starts, side="right")


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers in bytes of seven bits, low ones first, the last below 128; and where each one ends."""
    sizes = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(5):
        some = sizes > k
        more = sizes[some] > k + 1
        out[ends[some] - sizes[some] + k] = values[some] >> 7 * k & 127 | more << 7
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.append(0, ends[:-1] + 1)
    shift = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * shift, starts)


def _slices(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _shard(number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The rows of a shard: its documents that hold a term, and each term's postings."""
    order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end")
    found, of = _terms(texts.take(order))
    coded = found.dictionary_encode()
    sizes = np.bincount(of, minlength=len(ids))
    held = np.cumsum(sizes > 0) - 1  # documents without a term are in no list
    keys, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + held[of], return_counts=True)
    term, doc = keys // max(1, len(ids)), keys % max(1, len(ids))
    first = np.flatnonzero(np.diff(term, prepend=-1))
    gaps = np.diff(doc, prepend=0)
    gaps[first] = doc[first]
    last = np.append(first[1:], len(term))[: len(first)] - 1
    packed = [_slices(data, ends[last]) for data, ends in (pack(gaps), pack(tf))]
    n = len(first)
    ids = ids.take(order).filter(pa.array(sizes > 0))
    head = pa.ListArray.from_arrays(pa.array([0, len(ids), *[len(ids)] * n], pa.int32()), ids, mask=pa.array([False, *[True] * n]))
    own = pack(sizes[sizes > 0])[0].tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, number), pa.int64()), pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.take(pa.array(term[first])).cast(pa.string())]), pa.array(np.append(len(ids), last - first + 1), pa.int64()), head,
            pa.concat_arrays([pa.nulls(1, pa.binary()), packed[0]]), pa.concat_arrays([pa.array([own], pa.binary()), packed[1]]),
        ],
        names=["shard", "term", "df", "doc_ids", "gaps", "counts"],
    )


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, text, ...) -> the index of all documents: shard, term, df, doc_ids, gaps, counts; a term is null in a shard's first row.

    A row of ``docs`` is a document: repeated rows and ids all count, a null id is an id that comes last, a null text has no term, and
    other columns are not looked at. Each task makes shards of about ``shard_bytes`` of its own rows, so nothing is shuffled.
    """

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for piece in text_slices(batch, "text", max(1, shard_bytes // 4)):
                ids.append(piece.column("doc_id"))
                texts.append(piece.column("text"))
                size += pc.sum(pc.binary_length(texts[-1])).as_py() or 0
                if size >= shard_bytes:
                    yield _shard(number, pa.concat_arrays(ids), pa.concat_arrays([t.cast(pa.large_string()) for t in texts]))
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield _shard(number, pa.concat_arrays(ids), pa.concat_arrays([t.cast(pa.large_string()) for t in texts]))

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"shard long, term string, df long, doc_ids array<{kind}>, gaps binary, counts binary")


def merge(lists: list[tuple[np.ndarray, np.ndarray]], k: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """The k best (score, document) of posting lists (ascending documents, what each adds), best first, ties to the smaller document.

    Documents are merged a window at a time: a list whose next one, the least of the heap, is in the window gives all that it has there.
    """
    ahead = [(int(docs[0]), i) for i, (docs, _) in enumerate(lists) if len(docs)]
    heapq.heapify(ahead)
    at = [0] * len(lists)
    best: list[tuple[int, int]] = []  # of score and -document, the worst first
    sums = np.zeros(window, np.int64)
    while ahead:
        base = ahead[0][0]
        while ahead and ahead[0][0] < base + window:
            i = ahead[0][1]
            docs, adds = lists[i]
            to = at[i] + int(np.searchsorted(docs[at[i] :], base + window))
            sums[docs[at[i] : to] - base] += adds[at[i] : to]
            at[i] = to
            if to < len(docs):
                heapq.heapreplace(ahead, (int(docs[to]), i))
            else:
                heapq.heappop(ahead)
        found = np.flatnonzero(sums > (best[0][0] if len(best) == k else 0))  # a later document of an equal score is no better
        if len(found) > k:
            found = found[np.lexsort((found, -sums[found]))[:k]]
        for j in found.tolist():
            (heapq.heappushpop if len(best) == k else heapq.heappush)(best, (int(sums[j]), -(base + j)))
        sums[:] = 0
    return [(s, -d) for s, d in sorted(best, key=lambda x: (-x[0], -x[1]))]


def _searched(items: list, weights: dict[str, int], n_docs: int, n_terms: int, k: int, kind: str):
    """A shard's rows -> number of item, doc_id, score of its best documents for each item (a list of terms)."""

    def run(shard: pa.Table) -> pa.Table:
        got: tuple[list, list, list] = ([], [], [])
        ids, lists = None, {}
        rows = shard.combine_chunks()
        if rows.num_rows:
            names = rows.column("term").to_pylist()
            head = names.index(None)
            ids = rows.column("doc_ids")[head].values
            sizes, which = np.unique(unpack(np.frombuffer(rows.column("counts")[head].as_py(), np.uint8)), return_inverse=True)
            m = np.array([10 + 90 * n * n_docs // n_terms for n in sizes.tolist()], np.int64)[which]
            for j, term in enumerate(names):
                if j != head:
                    docs, tf = np.cumsum(unpack(np.frombuffer(rows.column("gaps")[j].as_py(), np.uint8))), unpack(np.frombuffer(rows.column("counts")[j].as_py(), np.uint8))
                    lists[term] = docs, weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
        for i, own in enumerate(items):
            for score, doc in merge([lists[t] for t in own if t in lists], k):
                got[0].append(i)
                got[1].append(doc)
                got[2].append(score)
        docs = ids.take(pa.array(got[1], pa.int64())) if ids is not None else pa.nulls(0, pa.int64())
        return pa.table({"item": pa.array(got[0], pa.int32()), "doc_id": docs, "score": pa.array(got[2], pa.int64())})

    return run


def _blocks(pairs: DataFrame, most: int):
    """Lists of (item_id, terms with weight), cut between items, of about ``most`` pairs; one at a time is held."""
    block, size = [], 0
    for r in pairs.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms")).toLocalIterator():
        block.append((r["item_id"], [(t["term"], t["weight"]) for t in r["terms"]]))
        size += len(r["terms"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, text, ...) -> item_id, rank, doc_id, score: the k documents of ``index`` with the highest scores above 0 for each item.

    Equal scores are ranked by doc_id, null last; rows of one item_id (null is one) are one item with the terms of all; an item
    without a term, and an empty table, have no result. A term in df of N documents weighs floor(1000 ln((2 N + 2) / (2 df + 1))); of L terms
    in all documents, n are in one of m = 10 + 90 n N div L, and tf of a term add weight * (10^9 tf div (1000 tf + 8 m)).

    ``index`` should be a written table. Items go to the shards in blocks of about ``block_terms`` terms, and each block reads the postings of
    its terms alone; what a shard holds of them meets in one task, which is bounded by the shard's size.
    """
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    item_kind = dict(items.dtypes)["item_id"]
    total = index.where("term is null").select(F.size("doc_ids").alias("n"), "counts")
    sums = total.mapInArrow(_n_terms, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    wanted = materialize(items.select("item_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct(), "search-terms")
    n_docs = sums["n"] or 0
    df = index.where("term is not null").join(wanted.select(F.col("term").alias("_t")).distinct(), F.col("term") == F.col("_t"), "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = df.select(F.col("term").alias("_t"), weight.alias("weight")).where("weight > 0")
    pairs = materialize(wanted.join(weighed, F.col("term") == F.col("_t")).select("item_id", "term", "weight"), "search-weights")
    found = items.sparkSession.createDataFrame([], f"item_id {item_kind}, doc_id {kind}, score long")
    schema = f"item int, doc_id {kind}, score long"
    for block in _blocks(pairs, block_terms):
        weights = {t: w for _, own in block for t, w in own}
        used = F.broadcast(items.sparkSession.createDataFrame([(t,) for t in weights], "_t string"))
        named = F.broadcast(items.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"_item int, item_id {item_kind}"))
        rows = index.where("term is null").unionAll(index.join(used, F.col("term") == F.col("_t"), "left_semi"))
        hits = rows.groupBy("shard").applyInArrow(_searched([[t for t, _ in own] for _, own in block], weights, n_docs, sums["l"] or 0, k, kind), schema)
        found = found.unionAll(materialize(hits.join(named, F.col("item") == F.col("_item")).select("item_id", "doc_id", "score"), "search-hits"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _n_terms(batches):
    for batch in batches:
        sums = [int(unpack(np.frombuffer(x.as_py(), np.uint8)).sum()) for x in batch.column("counts")]
        yield pa.RecordBatch.from_arrays([batch.column("n").cast(pa.int64()), pa.array(sums, pa.int64())], names=["n", "l"])


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialize(build_index(table(spark, sf_dir, "documents")), "search-index")
    return search(index, table(spark, sf_dir, "benchmark"))


_SQL_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{40}}\x{{5B}}-\x{{60}}\x{{7B}}-\x{{7F}}]+')"
OP11_SQL = f"""WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, {_SQL_TERMS} AS terms FROM documents WHERE text IS NOT NULL
), total AS (
    SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM docs WHERE len(terms) > 0
), wanted AS MATERIALIZED (
    SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark)
), postings AS MATERIALIZED (
    SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM postings, total GROUP BY term, n_docs
), adds AS (
    SELECT p.row, p.term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms) * n_docs) // n_terms))) AS score
    FROM postings p JOIN weights w ON p.term = w.term JOIN docs d ON p.row = d.row, total
), scores AS (
    SELECT item_id, row, CAST(sum(score) AS BIGINT) AS score FROM wanted JOIN adds ON wanted.term = adds.term GROUP BY 1, 2
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scores JOIN docs ON scores.row = docs.row WHERE score > 0
) WHERE rank <= {BEST}"""
