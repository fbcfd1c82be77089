"""Layers of the Pareto frontier: efficient non-dominated sorting over partitions.

Vectors come in lexicographic order, so whatever dominates one stands before it. A scan keeps a front for each layer and
puts a vector into the first front without a dominator, found by bisection; one that all fronts dominate goes. Each
partition scans its own rows: a chain of dominators there is one in the whole, so what it drops is beyond the last layer
everywhere. What is left of a group is dealt anew to fewer parts and scanned again, until a group fits one bounded part
and its scan is exact. Where a group's frontier stays larger than that (vectors that hardly dominate each other), blocks
along a space-filling curve raise each other's layers until none changes. So no task, no broadcast and nothing that the
driver holds grows with the input.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, materialize, table

DEPTH = 12
#: Vectors that one part holds at most when its scan is to be exact, and those that any scan keeps before it starts anew.
PART_ROWS = 20_000
_WORST = (1 << 63) - 1
#: Comparisons that are held at a time.
_CELLS = 2_000_000
_BITS = 10


class Fronts:
    """The fronts of one group, to which vectors are added in lexicographic order."""

    def __init__(self, width: int, depth: int) -> None:
        self.points, self.sizes = [np.empty((16, width - 1), np.int64) for _ in range(depth)], [0] * depth

    def __len__(self) -> int:
        return sum(self.sizes)

    def _dominated(self, layer: int, vectors: np.ndarray) -> np.ndarray:
        """Which vectors (without their first measure, which is no better than that of any point) the front dominates."""
        front = self.points[layer][: self.sizes[layer]]
        step = max(1, _CELLS // max(1, len(front)))
        parts = [(front[None] <= vectors[k : k + step, None]).all(2).any(1) for k in range(0, len(vectors), step)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def add(self, vectors: np.ndarray) -> np.ndarray:
        """The layers of more vectors, no two equal; 0 for one beyond the last front."""
        out = np.zeros(len(vectors), np.int32)
        rest = vectors[:, 1:]
        for k in range(0, len(vectors), 1024):
            some = rest[k : k + 1024]
            for i in np.flatnonzero(~self._dominated(-1, some)).tolist():
                x, low, high = some[i : i + 1], 0, len(self.sizes)
                while low < high:
                    middle = (low + high) // 2
                    if self._dominated(middle, x)[0]:
                        low = middle + 1
                    else:
                        high = middle
                if low < len(self.sizes):
                    self._put(low, x[0])
                    out[k + i] = low + 1
        return out

    def _put(self, layer: int, x: np.ndarray) -> None:
        points, n = self.points[layer], self.sizes[layer]
        if n == len(points):
            points = self.points[layer] = np.concatenate([points, np.empty_like(points)])
        points[n], self.sizes[layer] = x, n + 1


def _matrix(batch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names], 1).astype(np.int64)


def _scan(measures: list[str], groups: list[str], depth: int, most: int):
    """Rows sorted by group and measures -> those within the first layers of their group here, with that layer."""

    def run(batches):
        fronts, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for g in groups:
                c = batch.column(batch.schema.get_field_index(g))
                change[1:] |= pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            vectors, layers = _matrix(batch, measures), np.zeros(batch.num_rows, np.int32)
            for a, b in zip(cuts, cuts[1:], strict=False):
                group = [batch.column(batch.schema.get_field_index(g))[a].as_py() for g in groups]
                if group != last or len(fronts) > most:
                    fronts, last = Fronts(len(measures), depth), group
                layers[a:b] = fronts.add(vectors[a:b])
            kept = batch.append_column("layer", pa.array(layers)) if "layer" not in batch.schema.names else batch.set_column(batch.schema.get_field_index("layer"), "layer", pa.array(layers))
            yield kept.filter(pa.array(layers > 0))

    return run


def _raised(measures: list[str], depth: int):
    """Sources and targets of a pair of blocks -> targets whose layer the sources raise."""

    def run(sources: pa.Table, targets: pa.Table) -> pa.Table:
        s, t = _matrix(sources.combine_chunks(), measures), _matrix(targets.combine_chunks(), measures)
        of, own = sources.column("layer").to_numpy(), targets.column("layer").to_numpy().copy()
        before = own.copy()
        for layer in sorted(set(of.tolist())):
            front = s[of == layer]
            rows = np.flatnonzero(own <= layer)
            step = max(1, _CELLS // len(front))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                x = t[some, None]
                own[some[((front[None] <= x).all(2) & (front[None] != x).any(2)).any(1)]] = layer + 1
        hit = own > before
        return pa.table({"row": targets.column("row").filter(pa.array(hit)), "raised": pa.array(np.minimum(own[hit], depth + 1), pa.int32())})

    return run


def _curve(measures: list[str]) -> Column:
    """A place on a curve along which no vector comes before one that dominates it: the bits of the measures, scaled to ``_lo`` .. ``_hi``, in turn."""
    out = F.lit(0).cast("long")
    for k, m in enumerate(measures):
        low, high = F.col(f"_lo{k}").cast("double"), F.col(f"_hi{k}").cast("double")
        scaled = F.coalesce(F.floor(F.least(F.lit(1.0), (F.col(m).cast("double") - low) / F.nullif(high - low, F.lit(0.0))) * ((1 << _BITS) - 1)), F.lit(0)).cast("long")
        for b in range(_BITS):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(scaled, b).bitwiseAND(F.lit(1).cast("long")), b * len(measures) + len(measures) - 1 - k))
    return out


def _blocks_settle(vectors: DataFrame, measures: list[str], depth: int, part_rows: int) -> DataFrame:
    """Exact layers of vectors (scope, key, measures, layer: a lower bound) of any number, by blocks that raise each other's layers.

    A block is a range of the curve; it is compared with those before it whose best corner is no worse than its worst one in
    any measure. In the first round all vectors raise others, later those that rose. A vector's layer is right after as many
    rounds as its layer at most, so ``depth`` rounds and one more suffice.
    """
    spans = vectors.groupBy("scope", "key").agg(*[f for k, m in enumerate(measures) for f in (F.min(m).alias(f"_lo{k}"), F.max(F.when(F.col(m) < _WORST, F.col(m))).alias(f"_hi{k}"))])
    own = spans.select(F.col("scope").alias("_s"), F.col("key").alias("_k"), *[f"_{x}{k}" for k in range(len(measures)) for x in ("lo", "hi")])
    placed = vectors.join(own, (F.col("scope") == F.col("_s")) & (F.col("key") == F.col("_k"))).select("scope", "key", *measures, "layer", _curve(measures).alias("_z"))
    n = max(1, -(-vectors.count() // part_rows))
    dealt = placed.repartitionByRange(n, "scope", "key", "_z", *measures)
    rows = materialize(dealt.select("scope", "key", *measures, "layer", F.spark_partition_id().alias("block"), F.xxhash64("scope", "key", *measures).alias("row")), "pareto-blocks")
    corners = rows.groupBy("scope", "key", "block").agg(*[f(m).alias(f"{x}_{m}") for m in measures for f, x in ((F.min, "lo"), (F.max, "hi"))])
    first, second = corners.select("scope", "key", F.col("block").alias("source"), *[f"lo_{m}" for m in measures]), corners.select(F.col("scope").alias("_s"), F.col("key").alias("_k"), F.col("block").alias("target"), *[f"hi_{m}" for m in measures])
    near = reduce(lambda a, b: a & b, [F.col(f"lo_{m}") <= F.col(f"hi_{m}") for m in measures])
    pairs = materialize(first.join(second, (F.col("scope") == F.col("_s")) & (F.col("key") == F.col("_k")) & (F.col("source") <= F.col("target")) & near).select("_s", "_k", "source", "target", F.monotonically_increasing_id().alias("pair")), "pareto-pairs")
    layers, risen = rows.select("row", "layer"), None
    for step in range(depth + 2):
        now = materialize(rows.drop("layer").join(layers, "row").where(F.col("layer") <= depth), f"pareto-layers-{step}")
        moving = now if risen is None else now.join(risen.select("row"), "row", "left_semi")
        side = lambda df, end, name: df.join(pairs, (F.col("scope") == F.col("_s")) & (F.col("key") == F.col("_k")) & (F.col("block") == F.col(end))).select(F.col("pair").alias(name), *[F.col(c).alias(c) for c in ("row", "layer", *measures)])
        raised = side(moving, "source", "of").groupBy("of").cogroup(side(now, "target", "to").groupBy("to")).applyInArrow(_raised(measures, depth), "row long, raised int")
        risen = materialize(raised.groupBy("row").agg(F.max("raised").alias("raised")), f"pareto-risen-{step}")
        if risen.isEmpty():
            return now.select("scope", "key", *measures, "layer")
        layers = now.select("row", "layer").join(risen, "row", "left").select("row", F.coalesce("raised", "layer").alias("layer"))
    raise RuntimeError("layers did not settle")


def _layers(vectors: DataFrame, measures: list[str], depth: int, part_rows: int) -> DataFrame:
    """Distinct (scope, key, measures) -> those within the first layers of their scope and key, with the layer."""
    kinds = dict(vectors.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ("scope", "key", *measures)), "layer int"])

    def scan(rows: DataFrame, groups: list[str], most: int) -> DataFrame:
        extra = "".join(f", {g} long" for g in groups if g not in ("scope", "key"))
        ready = rows.select("scope", "key", *measures, F.lit(0).alias("layer"), *[g for g in groups if g not in ("scope", "key")]).sortWithinPartitions(*groups, *measures)
        return ready.mapInArrow(_scan(measures, groups, depth, most), schema + extra).select("scope", "key", *measures, "layer")

    left = materialize(scan(vectors, ["scope", "key"], 4 * part_rows), "pareto-0")
    before, step = None, 0
    while True:
        sizes = left.groupBy("scope", "key").count()
        most, rows = sizes.agg(F.max("count"), F.sum("count")).first()
        step += 1
        if (most or 0) <= part_rows:
            return scan(left.repartition("scope", "key"), ["scope", "key"], 4 * part_rows)
        if before is not None and rows > 0.8 * before:
            return _blocks_settle(left, measures, depth, part_rows)
        of = sizes.select(F.col("scope").alias("_s"), F.col("key").alias("_k"), F.ceil(F.col("count") / part_rows).alias("parts"))
        dealt = left.join(of, (F.col("scope") == F.col("_s")) & (F.col("key") == F.col("_k"))).withColumn("part", F.pmod(F.xxhash64(*measures, F.lit(step)), F.col("parts")))
        fewer = materialize(scan(dealt.repartition("scope", "key", "part"), ["scope", "key", "part"], 4 * part_rows), f"pareto-{step}")
        discard(left)
        left, before = fewer, rows


def pareto_layers(rows: DataFrame, low: list[str], high: list[str], scopes: dict[str, list[str]], depth: int = DEPTH, n_equal: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds to each row a column for each of ``scopes``: the row's layer among the rows that agree in that scope's columns.

    Low values of the integral columns ``low`` and high ones of ``high`` are better. A row dominates another if none of
    these is worse and some is better; null is worse than any number and equal to null. Rows that none dominates form layer 1, the
    next ones of what is left layer 2, and so on; layers beyond ``depth`` are 0. Nulls of a scope's columns are one value of
    their own; a scope of no columns is all rows. Equal rows share a layer, repeated ones all stay; an empty table stays
    empty; other columns pass through. ``n_equal`` names a column for the number of all rows with the same measures.

    ``rows`` is read twice. Only distinct vectors are compared, and only they and their layers are shuffled with the rows' keys.
    """
    tag = "_p"
    while any(c.lower().startswith(tag) for c in rows.columns):
        tag += "_"
    measures = [f"v{k}" for k in range(len(low) + len(high))]
    values = [*(F.col(f"`{c}`").cast("long") for c in low), *(-F.col(f"`{c}`").cast("long") for c in high)]
    places = {f"{tag}{m}": F.coalesce(v, F.lit(_WORST)) for m, v in zip(measures, values, strict=True)}
    keys = {f"{tag}k{i}": F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(columns)])) if columns else F.lit("") for i, columns in enumerate(scopes.values())}
    keyed = rows.withColumns(places | keys)
    distinct = materialize(keyed.groupBy(*keys, *places).agg(F.count("*").alias("n")), "pareto-vectors")
    vectors = [distinct.select(F.lit(i).alias("scope"), F.col(k).alias("key"), *[F.col(p).alias(m) for p, m in zip(places, measures, strict=True)]) for i, k in enumerate(keys)]
    found = _layers(reduce(DataFrame.unionAll, vectors).distinct(), measures, depth, part_rows)
    found = materialize(found, "pareto-found")

    out = distinct
    for i, (k, name) in enumerate(zip(keys, scopes, strict=True)):
        mine = found.where(F.col("scope") == i).select(F.col("key").alias("_k"), *[F.col(m).alias(f"_{m}") for m in measures], F.col("layer").cast("long").alias(f"{tag}layer{i}"))
        on = [F.col(k) == F.col("_k"), *[F.col(p) == F.col(f"_{m}") for p, m in zip(places, measures, strict=True)]]
        out = out.join(mine, reduce(lambda a, b: a & b, on), "left").drop("_k", *[f"_{m}" for m in measures])
    if n_equal:
        same = distinct.groupBy(*[F.col(p).alias(f"_{p}") for p in places]).agg(F.sum("n").alias(f"{tag}n"))
        out = out.join(same, reduce(lambda a, b: a & b, [F.col(p) == F.col(f"_{p}") for p in places])).drop(*[f"_{p}" for p in places])
    facts = out.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *places)], *[f"{tag}layer{i}" for i in range(len(scopes))], *([f"{tag}n"] if n_equal else []))
    joined = keyed.join(facts, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in (*keys, *places)]))
    layers = [F.coalesce(f"{tag}layer{i}", F.lit(0)).cast("long").alias(name) for i, name in enumerate(scopes)]
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *layers, *([F.col(f"{tag}n").alias(n_equal)] if n_equal else []))


def _hundredths(x: Column) -> Column:
    """floor(100 * x + 0.5) in doubles; null where that is no number a long can hold exactly."""
    y = F.floor(x.cast("double") * 100 + 0.5)
    return F.when(F.abs(x.cast("double")) < 9e12, y)


def _floor_div(a: str, b: str) -> str:
    """The floor of a / b for exact numbers; null where b is 0."""
    return f"(CASE WHEN {b} <> 0 THEN {a} div {b} - CASE WHEN {a} % {b} <> 0 AND ({a} < 0) <> ({b} < 0) THEN 1 ELSE 0 END END)"


def offers(lines: DataFrame, sales: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, vendor_id, part_type, price, discount, delay, quantity of each distinct pair of item and vendor in ``lines``.

    Lines without an item or a vendor are no offer; repeated lines all count; a measure skips lines that lack an input of it
    and is null without any left. Of repeated sales the earliest date counts, of repeated items the smallest kind and price. An
    item or sale that is not there is as one of nulls. Sums are exact decimals. One sale, item or vendor may have any
    share of the lines: they are joined as they are (Spark splits a skewed side) and summed before they are shuffled by pair.
    """
    once = materialize(sales.where("sale_id is not null").groupBy(F.col("sale_id").alias("_sale")).agg(F.min(F.to_date("sold_at")).alias("_sold")), "pareto-sales")
    known = materialize(items.where("item_id is not null").groupBy(F.col("item_id").alias("_item")).agg(F.min("kind").alias("part_type"), F.min(_hundredths(F.col("price"))).alias("_p")), "pareto-items")
    used = lines.where("item_id is not null and vendor_id is not null").select("sale_id", "item_id", "vendor_id", F.col("quantity").cast("long").alias("q"), _hundredths(F.col("amount")).alias("c"), _hundredths(F.col("discount")).alias("d"), F.to_date("shipped_at").alias("shipped"))
    dated = used.join(once, F.col("sale_id") == F.col("_sale"), "left").withColumn("days", F.date_diff("shipped", "_sold"))
    whole = F.col("q").isNotNull() & F.col("c").isNotNull() & F.col("d").isNotNull()
    paid = F.col("c").cast("decimal(18,0)") * (F.lit(100) - F.col("d")).cast("decimal(18,0)")
    sums = dated.groupBy("item_id", "vendor_id").agg(
        F.sum(F.when(whole, paid)).alias("paid"), F.sum(F.when(whole, F.col("q"))).cast("decimal(20,0)").alias("sold"), F.sum("d").cast("decimal(20,0)").alias("d"), F.count("d").cast("decimal(20,0)").alias("n_d"),
        F.sum("days").cast("decimal(20,0)").alias("days"), F.count("days").cast("decimal(20,0)").alias("n_days"), F.max("q").alias("quantity"),
    )
    priced = sums.join(known, F.col("item_id") == F.col("_item"), "left").withColumn("base", F.when(F.col("_p") >= 1, F.col("_p").cast("decimal(18,0)") * F.col("sold")))
    return priced.select("item_id", "vendor_id", "part_type", F.expr(_floor_div("paid", "base")).alias("price"), F.expr(_floor_div("d", "n_d")).alias("discount"), F.expr(_floor_div("days", "n_days")).alias("delay"), "quantity")


def op13_pareto_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = materialize(offers(*[table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items")]), "pareto-offers")
    return pareto_layers(made, ["price", "delay"], ["discount", "quantity"], {"type_layer": ["part_type"], "global_layer": []}, n_equal="n_equal")


def _sql() -> str:
    hundredths = lambda x: f"CASE WHEN abs(CAST({x} AS DOUBLE)) < 9e12 THEN CAST(floor({x} * 100 + 0.5) AS HUGEINT) END"
    floor_div = lambda a, b: f"CASE WHEN {b} <> 0 THEN CAST({a} // {b} - CASE WHEN {a} % {b} <> 0 AND ({a} < 0) <> ({b} < 0) THEN 1 ELSE 0 END AS BIGINT) END"
    parts = [f"""WITH lines AS (
        SELECT item_id, vendor_id, CAST(quantity AS HUGEINT) AS q, {hundredths("amount")} AS c, {hundredths("discount")} AS d, date_diff('day', sold, CAST(shipped_at AS DATE)) AS days
        FROM sale_lines l LEFT JOIN (SELECT sale_id, min(CAST(sold_at AS DATE)) AS sold FROM sales WHERE sale_id IS NOT NULL GROUP BY 1) s ON l.sale_id = s.sale_id WHERE item_id IS NOT NULL AND vendor_id IS NOT NULL
    ), sums AS (
        SELECT item_id, vendor_id, sum(c * (100 - d)) FILTER (q IS NOT NULL) AS paid, sum(q) FILTER (c IS NOT NULL AND d IS NOT NULL) AS sold,
            sum(d) AS d, count(d) AS n_d, sum(days) AS days, count(days) AS n_days, max(q) AS quantity FROM lines GROUP BY 1, 2
    ), priced AS (
        SELECT s.*, kind, CASE WHEN p >= 1 THEN p * sold END AS base FROM sums s
        LEFT JOIN (SELECT item_id, min(kind) AS kind, min({hundredths("price")}) AS p FROM items WHERE item_id IS NOT NULL GROUP BY 1) i ON s.item_id = i.item_id
    ), made AS (
        SELECT item_id, vendor_id, kind AS part_type, {floor_div("CAST(paid AS HUGEINT)", "CAST(base AS HUGEINT)")} AS price, {floor_div("CAST(d AS HUGEINT)", "n_d")} AS discount,
            {floor_div("CAST(days AS HUGEINT)", "n_days")} AS delay, CAST(quantity AS BIGINT) AS quantity FROM priced
    ), offers AS MATERIALIZED (
        SELECT *, coalesce(price, {_WORST}) AS v0, coalesce(delay, {_WORST}) AS v1, coalesce(-discount, {_WORST}) AS v2, coalesce(-quantity, {_WORST}) AS v3, coalesce('t' || part_type, 'none') AS kind FROM made
    )"""]  # fmt: skip
    for scope, key in (("t", "kind"), ("g", "''")):
        rest = f"SELECT DISTINCT {key} AS key, v0, v1, v2, v3 FROM offers"
        for n in range(1, DEPTH + 1):
            parts.append(f"{scope}r{n} AS MATERIALIZED ({rest})")
            parts.append(f"{scope}l{n} AS MATERIALIZED (SELECT * FROM {scope}r{n} a WHERE NOT EXISTS (SELECT 1 FROM {scope}r{n} b WHERE b.key = a.key AND b.v0 <= a.v0 AND b.v1 <= a.v1 AND b.v2 <= a.v2 AND b.v3 <= a.v3 AND (b.v0 < a.v0 OR b.v1 < a.v1 OR b.v2 < a.v2 OR b.v3 < a.v3)))")
            rest = f"SELECT * FROM {scope}r{n} EXCEPT SELECT * FROM {scope}l{n}"
        parts.append(f"{scope}_layers AS (" + " UNION ALL ".join(f"SELECT *, {n} AS layer FROM {scope}l{n}" for n in range(1, DEPTH + 1)) + ")")
    on = lambda t, key: f"{t}.key = {key} AND {t}.v0 = o.v0 AND {t}.v1 = o.v1 AND {t}.v2 = o.v2 AND {t}.v3 = o.v3"
    return ",\n".join(parts) + f"""
    SELECT item_id, vendor_id, part_type, price, discount, delay, quantity, CAST(coalesce(t.layer, 0) AS BIGINT) AS type_layer, CAST(coalesce(g.layer, 0) AS BIGINT) AS global_layer,
        count(*) OVER (PARTITION BY o.v0, o.v1, o.v2, o.v3) AS n_equal
    FROM offers o LEFT JOIN t_layers t ON {on("t", "o.kind")} LEFT JOIN g_layers g ON {on("g", "''")}"""  # fmt: skip


OP13_SQL = _sql()
