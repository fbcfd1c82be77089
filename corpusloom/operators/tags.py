"""Tags: effective sets, overrides, vocabulary lookup by slug and by cosine similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..sources.scratch import drop, scratch, written
from .nearest import nearest

FOLD = 0.90
#: Open proposals that are folded one by one at a time.
BATCH = 2_000


def resolve_tags(proposals: DataFrame, vocabulary: DataFrame, threshold: float = FOLD) -> DataFrame:
    """(label, embedding) -> label, slug, tag_id, how: slug, similar, or new, in which case the slug is the id.

    Each proposal is looked up in the vocabulary as it is; ``fold_tags`` has the order-dependent form.
    """
    p = proposals.withColumn("slug", slugify(F.col("label")))
    known = vocabulary.select(F.col("slug").alias("known_slug"), F.col("id").alias("known_id"))
    p = nearest(p.join(known, F.col("slug") == F.col("known_slug"), "left").drop("known_slug"), vocabulary)
    near = F.when(F.col("similarity") >= threshold, F.col("nearest_id"))
    how = F.when(F.col("known_id").isNotNull(), "slug").when(near.isNotNull(), "similar").otherwise("new")
    return p.select("label", "slug", F.coalesce(F.col("known_id").cast("string"), near.cast("string"), "slug").alias("tag_id"), how.alias("how"))


def fold_tags(proposals: DataFrame, order: str, vocabulary: DataFrame | None = None, threshold: float = FOLD, batch: int = BATCH, **search) -> DataFrame:
    """Adds slug, tag_id and how (slug, similar, new): each proposal (label, embedding) in order takes the tag of its slug, else the most similar tag, else founds one.

    Tags are those of ``vocabulary`` (id, slug, embedding) and those that earlier proposals founded, whose id is their slug; of
    tags alike the one of the smallest id, as a string, is taken. Only tags are looked up: the slug of a proposal that took another tag
    is free. ``order`` is an integral column without repeats; rows where it is null are left out.

    What a proposal founds depends only on earlier ones of its slug or like it. So in rounds the first ``batch`` open proposals are folded one by one,
    and all the others are compared with the few tags that these founded: whatever has such a slug or embedding founds none. Then each
    proposal is looked up once among the tags that were there before it. ``search`` goes to ``nearest``.
    """
    spark = proposals.sparkSession
    kind = dict(proposals.dtypes)["embedding"]
    rows = written(proposals.where(F.col(order).isNotNull()).withColumn("slug", slugify(F.col("label"))), "fold-rows")
    if vocabulary is None:
        vocabulary = spark.createDataFrame([], f"id string, slug string, embedding {kind}")
    stored = vocabulary.select(F.col("id").cast("string").alias("id"), "slug", F.col("embedding").cast(kind).alias("embedding"))
    by_slug = stored.where("slug is not null").groupBy(F.col("slug").alias("_slug")).agg(F.min("id").alias("_stored"))
    unknown = rows.join(by_slug, F.col("slug") == F.col("_slug"), "left_anti").select(F.col(order).cast("long").alias("at"), "slug", "embedding")
    near = nearest(unknown, stored, **search)
    going = written(near.where(~F.coalesce(F.col("similarity") >= threshold, F.lit(False))).select("at", "slug", "embedding"), "fold-open")
    path = scratch(spark, "fold-founded")
    spark.createDataFrame([], going.schema).write.parquet(path)
    while first := going.orderBy("at").limit(batch).collect():  # of bounded size
        new = _founders(first, threshold)
        mine = spark.createDataFrame(new, going.schema).coalesce(1)
        mine.write.mode("append").parquet(path)
        last = first[-1]["at"]
        slugs = F.broadcast(mine.select(F.col("slug").alias("_slug")))
        later = going.where(F.col("at") > last).join(slugs, F.col("slug") == F.col("_slug"), "left_anti")
        alike = nearest(later, mine.select(F.col("slug").alias("id"), "embedding"))
        left = written(alike.where(~F.coalesce(F.col("similarity") >= threshold, F.lit(False))).select("at", "slug", "embedding"), "fold-open")
        drop(going)
        going = left
    founded = spark.read.schema(going.schema).parquet(path)

    names = founded.select(F.col("slug").alias("_new"), F.col("at").alias("_since"))
    known = rows.join(by_slug, F.col("slug") == F.col("_slug"), "left").join(names, (F.col("slug") == F.col("_new")) & (F.col(order) >= F.col("_since")), "left")
    known = written(known.select(*rows.columns, F.coalesce("_stored", "_new").alias("_tag"), (F.col(order) == F.col("_since")).alias("_own")), "fold-known")
    tags = stored.select("id", "embedding", F.lit(-(1 << 63)).alias("since")).unionAll(founded.select(F.col("slug").alias("id"), "embedding", F.col("at").alias("since")))
    own = [F.col(f"`{c}`") for c in rows.columns]
    by_name = known.where("_tag is not null").select(*own, F.col("_tag").alias("tag_id"), F.when(F.col("_own"), "new").otherwise("slug").alias("how"))
    by_likeness = nearest(known.where("_tag is null").select(*own), tags, since="since", at=order, **search)
    return by_name.unionByName(by_likeness.select(*own, F.col("nearest_id").alias("tag_id"), F.lit("similar").alias("how")))


def _founders(rows: list, threshold: float) -> list:
    """Those of some open proposals, in order, that found a tag: none before them has their slug or is like them."""
    slugs: set[str] = set()
    units: dict[int, list[np.ndarray]] = {}
    out = []
    for r in rows:
        if r["slug"] in slugs:
            continue
        v = np.nan_to_num(np.asarray(r["embedding"] if r["embedding"] is not None else [], float))
        n = np.linalg.norm(v) if len(v) else 0.0
        alike = units.setdefault(len(v), [])
        if n > 0:
            if alike and (np.asarray(alike) @ (v / n)).max() >= threshold:
                continue
            alike.append(v / n)
        slugs.add(r["slug"])
        out.append(r)
    return out


def baseline(readable_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """readable_type, readable_id, baseline: array<struct(slug, id)>, each tag once."""
    t = tags.select(F.col("id").alias("t"), "slug", "label")
    return readable_tags.join(t, F.col("tag_id") == F.col("t")).groupBy("readable_type", "readable_id").agg(F.array_sort(F.collect_set(F.struct("label", "slug", F.col("t").alias("id")))).alias("baseline"))


def assigned(readable_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """readable_type, readable_id, slug, label, confidence of every assignment whose tag is there."""
    t = tags.select(F.col("id").alias("t"), "slug", "label")
    return readable_tags.join(t, F.col("tag_id") == F.col("t")).select("readable_type", "readable_id", "slug", "label", "confidence")


def effective(items: DataFrame, base: DataFrame, overrides: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds tags: the baseline without what the item's overrides suppress, with what they add; sorted by label."""
    t = tags.select(F.col("id").alias("t"), F.struct("label", "slug", "id").alias("tag"))
    mine = (
        overrides.join(t, F.col("tag_id") == F.col("t"))
        .groupBy("queue_item_id")
        .agg(F.collect_set(F.when(F.col("op") == "suppress", F.col("tag_id"))).alias("gone"), F.collect_set(F.when(F.col("op") == "add", F.col("tag"))).alias("more"))
    )
    joined = items.join(base, ["readable_type", "readable_id"], "left").join(mine, F.col("item_id") == F.col("queue_item_id"), "left").drop("queue_item_id")
    none = F.array().cast(base.schema["baseline"].dataType)
    left = F.filter(F.coalesce("baseline", none), lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), x["id"].cast("string")))
    return joined.withColumn("tags", F.array_sort(F.array_union(left, F.coalesce("more", none)))).drop("baseline", "gone", "more")


def with_tag(items: DataFrame, slug: str | None) -> DataFrame:
    return items if slug is None else items.where(F.exists("tags", lambda t: t["slug"] == slug))


def distinct_tags(items: DataFrame) -> DataFrame:
    return items.select(F.explode("tags").alias("t")).select("t.slug", "t.label").distinct()


def override_after(op: Column, in_baseline: Column) -> Column:
    """What an override of a tag is after an action: add of a baseline tag and removal of another leave none."""
    return F.when((op == "add") & ~in_baseline, "add").when((op == "remove") & in_baseline, "suppress")


def settle_overrides(actions: DataFrame, base: DataFrame) -> DataFrame:
    """queue_item_id, tag_id, op after all actions (op: add, remove, clear) by ``at``: the last one of each tag counts."""
    last = actions.groupBy("queue_item_id", "tag_id", "readable_type", "readable_id").agg(F.max_by("op", F.struct("at", "op")).alias("last"))
    has = base.select(F.col("readable_type").alias("bt"), F.col("readable_id").alias("bi"), F.explode("baseline").alias("b")).select("bt", "bi", F.col("b.id").cast("string").alias("btag"))
    on = (F.col("readable_type") == F.col("bt")) & (F.col("readable_id") == F.col("bi")) & (F.col("tag_id").cast("string") == F.col("btag"))
    return last.join(has, on, "left").select("queue_item_id", "tag_id", override_after(F.col("last"), F.col("btag").isNotNull()).alias("op")).where("op is not null")


def dedupe_assignments(assigned: DataFrame) -> DataFrame:
    """Two proposals that fold into one tag are one assignment, of the larger confidence."""
    return assigned.groupBy("tag_id", "readable_type", "readable_id").agg(F.max("confidence").alias("confidence"))
