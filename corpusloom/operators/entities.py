"""Entity resolution: authors, institutions, sources, users."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import domain_alias, site_name, slugify
from ..sources.scratch import written
from .groups import components


def _conflict(a, b, id_keys: tuple[str, ...]):
    return reduce(lambda x, y: x | y, (F.coalesce(F.col(f"{a}.{k}") != F.col(f"{b}.{k}"), F.lit(False)) for k in id_keys))


def _same_ids(rows: DataFrame, id_keys: tuple[str, ...]) -> DataFrame:
    """row, first: the smallest row that shared ids lead to."""
    links = None
    for k in id_keys:
        hubs = rows.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min("row").alias("b"))
        mine = rows.where(F.col(k).isNotNull()).join(hubs, F.col(k) == F.col("_k")).select(F.col("row").alias("a"), "b")
        links = mine if links is None else links.unionAll(mine)
    if links is None:
        return rows.select("row", F.col("row").alias("first"))
    if len(id_keys) == 1:  # the smallest row of an id is all there is to it
        label = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    else:
        label = components(links)
    least = label.groupBy(F.col("label").alias("_l")).agg(F.min("node").alias("first"))
    named = label.join(least, F.col("label") == F.col("_l")).select("node", "first")
    return rows.select("row").join(named, F.col("row") == F.col("node"), "left").select("row", F.coalesce("first", "row").alias("first"))


def _founders(groups: DataFrame, id_keys: tuple[str, ...]) -> DataFrame:
    """first, founder, place: in the order of a slug's groups, each joins the slug's first entity where no id differs, else is one of its own.

    One task folds the groups of one slug, people of one name in a batch; a slug of one group needs none.
    """

    def fold(t: pa.Table) -> pa.Table:
        held: dict = {}
        place, out = 0, []
        for r in sorted(t.to_pylist(), key=lambda r: r["first"]):
            if out and not any(r[k] is not None and held.get(k) not in (None, r[k]) for k in id_keys):
                out.append((r["first"], out[0][1], 1))
            else:
                place += 1
                out.append((r["first"], r["first"], place))
                if place > 1:
                    continue
            held |= {k: r[k] for k in id_keys if r[k] is not None}
        return pa.table({"first": [o[0] for o in out], "founder": [o[1] for o in out], "place": pa.array([o[2] for o in out], pa.int32())}).cast(schema)

    kind = groups.schema["first"].dataType.simpleString()
    schema = to_arrow_schema(groups.select("first", F.col("first").alias("founder"), F.lit(1).alias("place")).schema)
    sizes = groups.groupBy(F.col("slug").alias("_slug")).agg(F.count("*").alias("_n"))
    sized = groups.join(sizes, F.col("slug") == F.col("_slug"))
    alone = sized.where("_n = 1").select("first", F.col("first").alias("founder"), F.lit(1).alias("place"))
    return alone.unionByName(sized.where("_n > 1").select(*groups.columns).groupBy("slug").applyInArrow(fold, f"first {kind}, founder {kind}, place int"))


def resolve(incoming: DataFrame, existing: DataFrame, id_keys: tuple[str, ...], fill: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(links, entities). incoming: row, name, id_keys and fill; existing: id, name, slug, id_keys and fill.

    A row matches by the first of ``id_keys`` that both have; else by slug, unless an id is known of both and
    differs. Matched entities get values only where they have none. What is left is new: rows that share an id are one
    entity, and so are rows of one slug, unless ids differ. New ids are the slug or, where that is taken, the slug with
    the first free number from 2 on. Within a batch the row of the smallest ``row`` decides.
    """
    rows = incoming.withColumn("slug", slugify(F.col("name")))
    found = rows.select("row", F.lit(None).cast("string").alias("id"))
    for key in id_keys:
        known = existing.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("hit")).withColumnRenamed(key, "k")
        hits = rows.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("k")).select(F.col("row").alias("r"), "hit")
        found = found.join(hits, F.col("row") == F.col("r"), "left").select("row", F.coalesce("id", "hit").alias("id"))
    open_ = rows.join(found.where("id is null").select("row"), "row", "left_semi")
    by_slug = open_.alias("n").join(existing.alias("e"), F.col("n.slug") == F.col("e.slug")).where(~_conflict("n", "e", id_keys))
    by_slug = by_slug.groupBy(F.col("n.row").alias("r")).agg(F.min("e.id").alias("hit"))
    found = found.join(by_slug, F.col("row") == F.col("r"), "left").select("row", F.coalesce("id", "hit").alias("id"))

    found = written(found, "entity-found")  # read by several of the steps below
    new = written(rows.join(found.where("id is null").select("row"), "row", "left_semi"), "entity-new")
    first = _same_ids(new, id_keys)
    by_row = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row")))
    first = written(first, "entity-first")
    groups = new.join(first, "row").groupBy("first").agg(F.min_by("slug", "row").alias("slug"), *[by_row(k).alias(k) for k in id_keys])
    members = written(first.join(_founders(groups, id_keys), "first").select("row", "founder", "place"), "entity-members")
    made = new.join(members, "row").groupBy("founder", "place").agg(F.min_by("slug", "row").alias("slug"), F.min_by("name", "row").alias("name"), *[by_row(c).alias(c) for c in (*id_keys, *fill)])
    # numbers that are taken: by what is there, and by slugs of the batch as they are
    used = existing.select("slug").unionByName(made.select("slug")).distinct()
    numbers = used.select(F.regexp_extract("slug", r"^(.*)-([0-9]{1,9})$", 1).alias("stem"), F.regexp_extract("slug", r"^(.*)-([0-9]{1,9})$", 2).alias("n"), "slug").where("stem <> '' and slug = concat(stem, '-', cast(cast(n as int) as string))")
    numbers = numbers.groupBy("stem").agg(F.collect_set(F.col("n").cast("int")).alias("used"))
    there = existing.select(F.col("slug").alias("there")).distinct()
    made = made.join(there, F.col("slug") == F.col("there"), "left").join(numbers, F.col("slug") == F.col("stem"), "left")
    rank = F.col("place") - F.when(F.col("there").isNull(), 1).otherwise(0)  # 0 takes the slug itself, k the k-th free number
    taken = F.coalesce("used", F.array().cast("array<int>"))
    free = F.get(F.array_except(F.sequence(F.lit(2), F.lit(2) + rank + F.size(taken)), taken), rank - 1)
    made = made.withColumn("new_id", F.when(rank == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", free.cast("string"))))
    links = found.join(members, "row", "left").join(made.select(F.col("founder").alias("of"), "new_id"), F.col("founder") == F.col("of"), "left").select("row", F.coalesce("id", "new_id").alias("id"))
    made = made.select(F.col("new_id").alias("id"), "name", F.col("new_id").alias("slug"), *id_keys, *fill)
    values = rows.join(links, "row").groupBy("id").agg(*[by_row(c).alias(f"in_{c}") for c in (*id_keys, *fill)]).withColumnRenamed("id", "lid")
    filled = existing.join(values, F.col("id") == F.col("lid"), "left").select("id", "name", "slug", *[F.coalesce(F.col(c), F.col(f"in_{c}")).alias(c) for c in (*id_keys, *fill)])
    return links, filled.unionByName(made)


def find_or_create(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """existing (slug, name, url) and one new row for each slug that is not there, the first row's."""
    first = incoming.withColumn("slug", slugify(F.col("name"))).groupBy("slug").agg(F.min(F.struct("row", "name", "url")).alias("f")).select("slug", "f.name", "f.url")
    return existing.select("slug", "name", "url").unionByName(first.join(existing.select("slug"), "slug", "left_anti"))


def resolve_senders(mails: DataFrame, sources: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds source_id by the sender's address, else by its domain, and the name a new source would get."""
    a = aliases.select(F.lower("alias").alias("alias"), F.col("affiliation_id"))
    by_address = mails.join(a, F.lower("from_email") == F.col("alias"), "left").withColumnRenamed("affiliation_id", "by_address").drop("alias")
    both = by_address.join(a, domain_alias(F.lower("from_email")) == F.col("alias"), "left").drop("alias")
    out = both.withColumn("source_id", F.coalesce("by_address", "affiliation_id")).drop("by_address", "affiliation_id").withColumn("default_name", site_name(F.col("from_email")))
    return out.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left")


def enrich_name(current, placeholder, declared):
    """A declared name replaces a placeholder only."""
    return F.when(current.isNull() | (current == placeholder), F.coalesce(declared, current)).otherwise(current)


def dated_versions(fetched: DataFrame) -> DataFrame:
    """One row for each url and day, the day's last fetch."""
    day = fetched.withColumn("fetched_on", F.to_date("fetched_at"))
    return day.groupBy("canonical_url", "fetched_on").agg(F.max_by("title", F.struct("fetched_at", "title")).alias("title"), F.count("*").alias("fetches"))


def reconcile_users(logins: DataFrame, users: DataFrame) -> DataFrame:
    """Adds user_id to (hanko_id, email): by hanko_id, else by e-mail in any case of letters where no other id is set."""
    by_hanko = users.where("hanko_id is not null").select(F.col("hanko_id").alias("h"), F.col("id").alias("one"))
    by_mail = users.where("hanko_id is null").select(F.lower("email").alias("m"), F.col("id").alias("two"))
    return logins.join(by_hanko, F.col("hanko_id") == F.col("h"), "left").join(by_mail, F.lower("email") == F.col("m"), "left").select(*logins.columns, F.coalesce("one", "two").alias("user_id"))


def link_once(links: DataFrame, existing: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Edges that are not there yet, each once."""
    return links.select(*key).distinct().join(existing.select(*key), list(key), "left_anti")
