"""The most similar vector of a vocabulary, exactly.

A vocabulary of bounded size is broadcast and compared by matrix products. A larger one is cut into cells around pivots,
a bounded sample of it. The angles between a vector and a pivot, and between the pivot and the rim of its cell, bound the
angle to anything in the cell: a vector is first compared with the cell that may be nearest, and then with those alone
that could hold something as near. Small cells share a block and large ones have several; a vector is sent once to each block that
has a cell for it, with the set of its cells, so what is sent grows with the number of blocks and not of cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, written

#: Numbers of a vocabulary that is broadcast as it is: 16 MB.
BROADCAST_NUMBERS = 2_000_000
#: Cells of a larger one, and vectors of a block, which has no more numbers than a vocabulary that is broadcast.
PIVOTS, BLOCK_ROWS = 256, 32_768
#: Similarities that are held at a time, and what they may differ by to be taken for equal.
_SCORES, _SAME = 4_000_000, 1e-12
#: What a bound may be off by.
_SLACK = 1e-6


def _unit(vectors: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of a list array, all of one width, scaled to length 1; zero and undefined ones stay 0."""
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float)
    m = np.nan_to_num(flat).reshape(len(rows), width)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _widths(vectors: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)


def _column(t, name: str) -> pa.Array:
    c = t.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _best(queries, ids: pa.Array, of: dict, since: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query row the place and similarity of its best vector (-1 for none) and how many it was compared with.

    ``of`` has the places and unit vectors of each width, in ascending order of id; only vectors whose ``since`` is below the query's ``at`` count.
    """
    vectors, at = _column(queries, "vector"), _column(queries, "at").to_numpy(zero_copy_only=False)
    widths = _widths(vectors)
    place, score, compared = np.full(len(widths), -1), np.full(len(widths), -np.inf), np.zeros(len(widths), np.int64)
    for width in np.unique(widths[widths > 0]).tolist():
        if width not in of:
            continue
        places, matrix = of[width]
        rows = np.flatnonzero(widths == width)
        step = max(1, _SCORES // len(places))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            q = _unit(vectors, some, width)
            s = q @ matrix.T
            s[since[places][None, :] >= at[some, None]] = -np.inf
            s[~q.any(axis=1)] = -np.inf
            top = s.max(axis=1)
            first = (s >= top[:, None] - _SAME).argmax(axis=1)
            good = np.isfinite(top)
            place[some[good]], score[some[good]] = places[first[good]], top[good]
            compared[some] = len(places)
    return place, score, compared


def _by_width(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    widths, out = _widths(vectors), {}
    for width in np.unique(widths[widths > 0]).tolist():
        places = np.flatnonzero(widths == width)
        m = _unit(vectors, places, width)
        some = m.any(axis=1)
        if some.any():
            out[width] = places[some], m[some]
    return out


def _sorted_by_id(t: pa.Table) -> pa.Table:
    return t.take(pc.sort_indices(t, sort_keys=[("id", "ascending")]))


def _broadcast_search(queries: DataFrame, vocabulary: DataFrame, schema: str) -> DataFrame:
    t = _sorted_by_id(vocabulary.toArrow())
    ids, since = _column(t, "id"), _column(t, "since").to_numpy(zero_copy_only=False)
    shared = queries.sparkSession.sparkContext.broadcast((ids, _by_width(_column(t, "vector")), since))

    def run(batches):
        ids, of, since = shared.value
        for batch in batches:
            place, score, compared = _best(batch, ids, of, since)
            found = np.flatnonzero(place >= 0)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(found)), ids.take(pa.array(place[found])), pa.array(score[found]), pa.array(compared[found])], names=["row", "id", "score", "compared"])

    return queries.mapInArrow(run, schema)


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


def _packed(sizes: dict[int, int], block_rows: int) -> dict[int, tuple[int, int]]:
    """The first block of each cell and how many it has: one that small cells share, or several of its own."""
    out, at, room = {}, 0, block_rows
    for c, n in sorted(sizes.items()):
        times = math.ceil(n / block_rows)
        if n > room and room < block_rows:
            at, room = at + 1, block_rows
        out[c] = at, times
        if times > 1:
            at, room = at + times, block_rows
        else:
            room -= n
    return out


def _cell_search(queries: DataFrame, vocabulary: DataFrame, schema: str, pivots: int, block_rows: int) -> DataFrame:
    spark = queries.sparkSession
    id_kind = dict(vocabulary.dtypes)["id"]
    sample = vocabulary.orderBy(F.xxhash64("id", "vector")).limit(pivots).toArrow()  # of bounded size
    centres = spark.sparkContext.broadcast(_by_width(_column(sample, "vector")))
    lost = pivots  # the cell of vectors of a width without a pivot, which bounds nothing

    def placed(batches):
        for batch in batches:
            vectors = batch.column("vector")
            widths = _widths(vectors)
            cell, angle = np.full(batch.num_rows, lost), np.zeros(batch.num_rows)
            for width in np.unique(widths[widths > 0]).tolist():
                if width in centres.value:
                    rows = np.flatnonzero(widths == width)
                    m = _unit(vectors, rows, width)
                    a = _angles(m, centres.value[width][1])
                    near = a.argmin(axis=1)
                    cell[rows], angle[rows] = centres.value[width][0][near], a[np.arange(len(rows)), near]
            yield pa.RecordBatch.from_arrays([batch.column("id"), vectors, batch.column("since"), pa.array(cell, pa.int32()), pa.array(angle)], names=["id", "vector", "since", "cell", "angle"])

    vector_kind = dict(vocabulary.dtypes)["vector"]
    cells = written(vocabulary.mapInArrow(placed, f"id {id_kind}, vector {vector_kind}, since long, cell int, angle double"), "nearest-cells")
    stats = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()  # a row a cell at most
    rims, dealt_cells = {r["cell"]: (r["low"], r["high"]) for r in stats}, _packed({r["cell"]: r["n"] for r in stats}, block_rows)
    shared = spark.sparkContext.broadcast(rims)
    cells_of: dict[int, list[int]] = {}
    for c, (start, n) in dealt_cells.items():
        for block in range(start, start + n):
            cells_of.setdefault(block, []).append(c)

    def visits(first: bool):
        """(row, vector, at, best) -> the blocks with cells that a row is to be compared with, as a set of bits: its first cell, or all others that may hold something as near."""

        def run(batches):
            for batch in batches:
                vectors, best = batch.column("vector"), batch.column("best").to_numpy(zero_copy_only=False)
                widths = _widths(vectors)
                wanted = np.zeros((batch.num_rows, lost + 1), bool)
                for width in np.unique(widths[widths > 0]).tolist():
                    rows = np.flatnonzero(widths == width)
                    m = _unit(vectors, rows, width)
                    if width in centres.value:
                        names, pivot = centres.value[width]
                        full = np.array([int(c) in shared.value for c in names])  # a pivot's equal may have taken all of its cell
                        names, pivot = names[full], pivot[full]
                        a = _angles(m, pivot)
                        low, high = (np.array([shared.value[int(c)][k] for c in names]) for k in (0, 1))
                        bound = np.maximum(np.maximum(a - high, low - a), 0.0)
                    else:
                        names, bound = np.zeros(0, int), np.zeros((len(rows), 0))
                    if lost in shared.value:
                        names, bound = np.append(names, lost), np.column_stack([bound, np.zeros(len(rows))])
                    if not len(names):
                        continue
                    own = bound.argmin(axis=1)
                    if first:
                        pick = np.arange(len(names))[None, :] == own[:, None]
                    else:
                        limit = np.where(np.isnan(best[rows]), np.pi, np.arccos(np.clip(best[rows], -1, 1))) + _SLACK
                        pick = (bound <= limit[:, None]) & (np.arange(len(names))[None, :] != own[:, None])
                    wanted[np.ix_(rows, names)] = pick
                bits = np.packbits(wanted, axis=1)
                for block, of in cells_of.items():
                    at = np.flatnonzero(wanted[:, of].any(axis=1))
                    for k in range(0, len(at), 20_000):
                        some = at[k : k + 20_000]
                        took = pa.array(some)
                        yield pa.RecordBatch.from_arrays([batch.column("row").take(took), vectors.take(took), batch.column("at").take(took), pa.array(np.full(len(some), block), pa.int32()), pa.array([x.tobytes() for x in bits[some]], pa.binary())], names=["row", "vector", "at", "block", "cells"])

        return run

    start, times = (F.create_map(*[F.lit(x) for c, at in dealt_cells.items() for x in (c, at[k])]) for k in (0, 1))
    blocked = cells.withColumn("block", (start[F.col("cell")] + F.pmod(F.xxhash64("id"), times[F.col("cell")])).cast("int"))
    part_rows = max(1, block_rows // 2)
    query_kind = dict(queries.dtypes)["vector"]

    def compare(given: DataFrame, first: bool) -> DataFrame:
        going = written(given.mapInArrow(visits(first), f"row long, vector {query_kind}, at long, block int, cells binary"), "nearest-visits")
        # where many rows visit a block, it comes once for each so many of them
        parts = going.groupBy("block").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
        of, on = F.broadcast(parts.select(F.col("block").alias("_b"), "parts")), F.col("block") == F.col("_b")  # a row a block
        dealt = going.join(of, on).select("row", "vector", "at", "cells", "block", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"))
        copies = blocked.join(of, on).select("id", "vector", "since", "cell", F.col("block").alias("block2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part2"))

        def meet(q: pa.Table, v: pa.Table) -> pa.Table:
            v = _sorted_by_id(v)
            ids, since, cell = _column(v, "id"), _column(v, "since").to_numpy(zero_copy_only=False), _column(v, "cell").to_numpy(zero_copy_only=False)
            bits = np.frombuffer(b"".join(q.column("cells").to_pylist()), np.uint8).reshape(q.num_rows, (lost + 8) // 8)
            place, score, compared = np.full(q.num_rows, -1), np.full(q.num_rows, -np.inf), np.zeros(q.num_rows, np.int64)
            for c in np.unique(cell).tolist():
                rows, own = np.flatnonzero(bits[:, c >> 3] >> (7 - (c & 7)) & 1), np.flatnonzero(cell == c)
                if not len(rows):
                    continue
                at, top, n = _best(q.take(pa.array(rows)), ids, _by_width(_column(v.take(pa.array(own)), "vector")), since[own])
                compared[rows] += n
                rows, at, top = rows[at >= 0], own[at[at >= 0]], top[at >= 0]
                same = np.abs(top - score[rows]) <= _SAME
                place[rows] = np.where(same, np.minimum(at, place[rows]), np.where(top > score[rows], at, place[rows]))
                score[rows] = np.maximum(score[rows], top)
            score[place < 0] = np.nan
            return pa.table({"row": q.column("row"), "id": ids.take(pa.array(np.maximum(place, 0), mask=place < 0)), "score": pa.array(score, from_pandas=True), "compared": pa.array(compared)})

        met = dealt.groupBy("block", "part").cogroup(copies.groupBy("block2", "part2")).applyInArrow(meet, schema)
        found = written(met, "nearest-met")
        drop(going)
        return found

    one = compare(queries.withColumn("best", F.lit(None).cast("double")), True)
    best = one.groupBy(F.col("row").alias("_row")).agg(F.max("score").alias("best"))
    two = compare(queries.join(best, F.col("row") == F.col("_row"), "left").drop("_row"), False)
    return one.unionAll(two)


def nearest(proposals: DataFrame, vocabulary: DataFrame, id_: str = "id", vector: str = "embedding", since: str | None = None, at: str | None = None, compared: str | None = None, broadcast_numbers: int = BROADCAST_NUMBERS, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds nearest_id and similarity, the vocabulary's row of the largest cosine; ties (within 1e-12) to the smallest id.

    Null vectors of the vocabulary are skipped; empty and zero vectors, and those of another length, have similarity 0 to
    all; a null proposal has no nearest. With ``since`` and ``at``, integral columns of the vocabulary and of the proposals, only rows
    with ``since`` below ``at`` count for a proposal, and what has similarity 0 by its length is none. ``compared`` names a column for the number of vectors that each was compared with.

    A vocabulary of up to ``broadcast_numbers`` numbers is broadcast. A larger one stays on the executors, in cells around ``pivots`` of its vectors.
    """
    v = vocabulary.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("vector"), (F.col(since).cast("long") if since else F.lit(-(1 << 63))).alias("since"))
    own = [F.col(f"`{c}`") for c in proposals.columns]
    keyed = written(proposals.select(*own, F.monotonically_increasing_id().alias("_row"), (F.col(at).cast("long") if at else F.lit((1 << 63) - 1)).alias("_at")), "nearest-queries")
    queries = keyed.where(F.size(vector) > 0).select(F.col("_row").alias("row"), F.col(vector).alias("vector"), F.col("_at").alias("at"))
    schema = f"row long, id {dict(v.dtypes)['id']}, score double, compared long"
    numbers, rows = v.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)), F.count("*")).first()
    block_rows = min(block_rows, max(1, BROADCAST_NUMBERS * rows // max(1, numbers)))
    found = _broadcast_search(queries, v, schema) if numbers <= broadcast_numbers else _cell_search(queries, v, schema, pivots, block_rows)
    best = found.groupBy("row").agg(F.max("score").alias("_best"), F.sum("compared").alias("_n"), F.collect_list(F.when(F.col("score").isNotNull(), F.struct("score", "id"))).alias("_all"))
    smallest = F.array_min(F.transform(F.filter("_all", lambda x: x["score"] >= F.col("_best") - _SAME), lambda x: x["id"]))
    joined = keyed.join(best.select(F.col("row").alias("_of"), "_best", "_n", smallest.alias("_id")), F.col("_row") == F.col("_of"), "left")
    here, id_found, score = F.col(vector).isNotNull(), F.col("_id"), F.col("_best")
    if not since:
        # what cannot be compared has similarity 0; of those of any other length the smallest id is one of the first two lengths'
        zero = lambda c: F.forall(c, lambda x: F.coalesce(x, F.lit(0.0)) == 0)
        others = v.groupBy(F.when(zero("vector"), 0).otherwise(F.size("vector")).alias("w")).agg(F.min("id").alias("id")).orderBy("id").limit(2)
        joined = joined.crossJoin(F.broadcast(others.agg(F.collect_list(F.struct("id", "w")).alias("_others"))))
        width = F.when(zero(vector), -1).otherwise(F.size(vector))
        other = F.array_min(F.transform(F.filter("_others", lambda o: o["w"] != width), lambda o: o["id"]))
        instead = other.isNotNull() & (score.isNull() | (score < -_SAME) | (F.abs(score) <= _SAME) & (other < id_found))
        id_found, score = F.when(instead, other).otherwise(id_found), F.when(instead, 0.0).otherwise(score)
    out = joined.select(*own, F.when(here, id_found).alias("nearest_id"), F.when(here, score).alias("similarity"), *([F.coalesce("_n", F.lit(0)).alias(compared)] if compared else []))
    return out
