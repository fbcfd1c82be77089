"""Mixing sources to target weights.

Documents get hash-random keys and are range-sorted by them within each source; distributed prefix sums
of sizes then cut each source at its exact budget, after as many whole epochs as the budget holds.

The key is the MD5 of the id, so its range is cut into equal buckets of nearly equal size beforehand: a hot source is
spread over all buckets. Prefix sums over the buckets tell in which one a source's budget ends, and only that
bucket's keys are sorted for the row of the cut. What every document takes then follows from one row a source:
its epochs and its cut. So no plan of the documents is made, and texts are never shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP_PATTERN, WORD_SEPARATORS, materialize, n_words, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows of one bucket of the key range, over all sources, on average.
BUCKET_ROWS = 2_000


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with the rank of each source by code point, null last, from 0: sorted by ranges, numbered within each."""
    order = F.col("source").asc_nulls_last()
    dealt = sizes.repartitionByRange(order).sortWithinPartitions(order)
    dealt = materialize(dealt.withColumn("range", F.spark_partition_id()).withColumn("inside", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "mix-sources")
    before = Window.orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = dealt.groupBy(F.col("range").alias("of_range")).agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return dealt.join(ranges, F.col("range") == F.col("of_range")).withColumn("rank", F.col("first") + F.col("inside")).select(*sizes.columns, "rank")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same and target, a double.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all sizes. No target
    exceeds ``max_epochs`` times its source's size; the excess is shared by weight among the others until
    none is above. That fixpoint is ``least(cap, level * weight)``; the level rises from step to step, each one a sum
    over all sources, until no further source is above its cap. So there may be as many sources as there are hosts.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(_ranked(sizes).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap")), "mix-caps")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, n_capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.col("cap")
        got = ranked.agg(F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("capped"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"), F.sum(above.cast("int")).alias("n")).first()
        if not got["open"] or got["n"] == n_capped:
            break
        level, n_capped = (total - got["capped"]) / got["open"], got["n"]
    cap = F.col("cap").cast("double")
    # without an open source, the whole of every cap is taken
    return ranked.select("source", "source_size", (cap if level is None or not got["open"] else F.least(cap, F.lit(level) * F.col("weight"))).alias("target"))


def _key(docs: DataFrame) -> Column:
    """The sort key of a row; rows without an id have their text's."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce("text", F.lit("")))).cast("binary"))


def _cuts(docs: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int, bucket_rows: int) -> DataFrame:
    """One row a source: m_source, source_size, target, epochs, and of the cut the key, the size of its rows and the words each of them takes."""
    sized = materialize(docs.select("source", n_words(F.col("text")).alias("size"), _key(docs).alias("key")), "mix-sizes")
    buckets = max(1, sized.count() // bucket_rows)
    sized = sized.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * buckets / (1 << 28)))
    by_bucket = materialize(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    goal = targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    budget = F.floor("target").cast("long")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    goal = materialize(goal.withColumn("rest", budget - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "m_source"), "mix-goals")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        by_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
        .join(goal, F.col("source").eqNullSafe(F.col("m_source")))
        .where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("bucket_size")))
        .select(F.col("source").alias("end_source"), F.col("bucket").alias("end_bucket"), (F.col("rest") - F.col("before")).alias("left"))
    )
    last = sized.join(ends, F.col("source").eqNullSafe(F.col("end_source")) & (F.col("bucket") == F.col("end_bucket")))
    keys = last.groupBy("end_source", "key", "size").agg(F.count("*").alias("rows"), F.first("left").alias("left"))  # copies are one row of the sort
    running = Window.partitionBy("end_source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = keys.withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(running), F.lit(0)))
    at = inside.where((F.col("inner") < F.col("left")) & (F.col("left") <= F.col("inner") + F.col("size") * F.col("rows")))
    at = at.select("end_source", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.floor((F.col("left") - F.col("inner")) / F.col("rows")).cast("long").alias("cut_words"))
    return materialize(goal.join(at, F.col("m_source").eqNullSafe(F.col("end_source")), "left").drop("end_source", "rest"), "mix-cuts")


def _part(key: Column, size: Column) -> Column:
    """How many words a row takes besides its source's whole epochs."""
    earlier = (key < F.col("cut_key")) | (key == F.col("cut_key")) & (size < F.col("cut_size"))
    same = (key == F.col("cut_key")) & (size == F.col("cut_size"))
    return F.when(earlier, size).when(same, F.col("cut_words")).otherwise(0).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, source, ...) -> (doc_id, source, size, source_size, target, taken, epochs, part), a row for each row.

    size is the number of words. The mix takes ``epochs`` whole copies and then the first ``part`` words;
    taken = epochs * size + part. Within a source the taken words sum to floor(target); only where the cut falls on rows
    of one id and size, which share it evenly, may fewer words than there are such rows be missing.
    A null or empty text has size 0 and takes 0. A null source is a source of its own, the last one. Rows without an
    id are sorted by their text. Other columns are not looked at. An empty table gives an empty result.
    """
    cuts = _cuts(docs, weights, share, max_epochs, bucket_rows)
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _key(docs).alias("key"))
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("m_source"))).withColumn("part", _part(F.col("key"), F.col("size")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part")


def _first_words(text: Column, n: Column) -> Column:
    gap = GAP_PATTERN[:-1]
    pieces = F.split(F.ltrim(text, F.lit(WORD_SEPARATORS)), rf"(?<={gap})(?!{gap})")
    return F.rtrim(F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), ""), F.lit(WORD_SEPARATORS))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The mix itself: the rows of ``docs``, one for each epoch, the row at a source's cut shortened to its first words.

    Rows that the mix takes nothing of go. Columns stay as they are, but for ``text`` of shortened rows
    and ``n_chars`` where there is such a column. Rows that share id, source and size share what the mix takes
    of them evenly. Texts are read twice; they are joined to one row a source.
    """
    cuts = _cuts(docs, weights, share, max_epochs, bucket_rows)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("of"), n_words(F.col("text")).alias("words"), _key(docs).alias("key"))
    planned = rows.join(cuts, F.col("of").eqNullSafe(F.col("m_source"))).withColumn("part", _part(F.col("key"), F.col("words")))
    planned = planned.where((F.col("epochs") + F.col("part")) * F.col("words") > 0)  # one condition on both sides, so words are counted once
    copies = planned.select("row", "epochs", "part", "words", F.explode(F.sequence(F.lit(1), F.col("epochs") + F.lit(1))).alias("epoch"))
    whole = F.col("epoch") <= F.col("epochs")
    text = F.col("row.text")
    cut = F.when(whole | (F.col("part") == F.col("words")), text).otherwise(_first_words(text, F.col("part")))
    copies = copies.where(whole | (F.col("part") > 0)).withColumn("cut", cut)
    changed = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return copies.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, ''))) AS key FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM g),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap,
             CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM r),
c AS (SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
             CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open FROM w),
l AS (SELECT *, max(CASE WHEN (total - capped) / open * weight <= cap THEN (total - capped) / open END) OVER () AS level FROM c),
t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), level * weight), CAST(cap AS DOUBLE)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS epochs,
             CAST(floor(target) AS BIGINT) AS budget FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT p.doc_id, p.size, b.source_size, b.target,
       CAST(b.epochs * p.size + greatest(0, least(p.size, b.budget - b.epochs * b.source_size - p.before)) AS BIGINT) AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""
