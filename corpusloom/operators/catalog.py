"""The catalogue of readables: one shape for articles, papers and issues, joined to sources, authors and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

BROWSABLE = ("article", "paper")


def normalise(articles: DataFrame, papers: DataFrame, issues: DataFrame) -> DataFrame:
    """type, id, title, url, source_id of all readables; an issue's title is its subject."""
    one = lambda df, kind, title, url: df.select(F.lit(kind).alias("type"), F.col("id").cast("string").alias("id"), F.col(title).alias("title"), url.alias("url"), F.col("affiliation_id").cast("string").alias("source_id"))
    missing = F.lit(None).cast("string")
    has = lambda df, c: F.col(c) if c in df.columns else missing
    paper_url = F.coalesce(F.concat(F.lit("https://arxiv.org/abs/"), has(papers, "arxiv_id")), F.concat(F.lit("https://doi.org/"), has(papers, "doi")))
    return one(articles, "article", "title", has(articles, "canonical_url")).unionByName(one(papers, "paper", "title", paper_url)).unionByName(one(issues, "newsletter", "subject", missing))


def with_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds source: struct(id, name, slug), null where there is none."""
    s = sources.select(F.struct(F.col("id").cast("string").alias("id"), "name", "slug").alias("source"))
    return items.join(s, F.col("source_id") == F.col("source.id"), "left")


def with_authors(items: DataFrame, authorships: DataFrame, authors: DataFrame) -> DataFrame:
    """Adds authors: array<struct(ordinal, id, name)> in byline order; authors that are gone are left out, none gives an empty array."""
    a = authors.select(F.col("id").cast("string").alias("author_key"), F.col("name").alias("author_name"))
    lines = (
        authorships.join(a, F.col("author_id").cast("string") == F.col("author_key"))
        .groupBy(F.col("readable_type").alias("at"), F.col("readable_id").cast("string").alias("ai"))
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", F.col("author_key").alias("id"), F.col("author_name").alias("name")))).alias("authors"))
    )
    empty = F.array().cast(lines.schema["authors"].dataType)
    return items.join(lines, (F.col("type") == F.col("at")) & (F.col("id") == F.col("ai")), "left").withColumn("authors", F.coalesce("authors", empty)).drop("at", "ai")


def catalog(articles: DataFrame, papers: DataFrame, issues: DataFrame, sources: DataFrame, authorships: DataFrame, authors: DataFrame) -> DataFrame:
    return with_authors(with_source(normalise(articles, papers, issues), sources), authorships, authors)


def by_title() -> list[Column]:
    return [F.lower("title").asc_nulls_first(), F.col("type").asc(), F.col("id").asc()]


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds rank, from 1 in an order without ties: rows are dealt by ranges of it, and what stands before a range is a sum over ranges."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ahead = placed.groupBy("_part").count().select(F.col("_part").alias("_of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return placed.withColumn("_n", inside).join(ahead, F.col("_part") == F.col("_of")).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_n") + F.col("_ahead")).cast("long").alias("rank"))


def browsable(items: DataFrame) -> DataFrame:
    """What any user may browse: newsletters are private."""
    return items.where(F.col("type").isin(*BROWSABLE))


def of_author(items: DataFrame, authorships: DataFrame, author_id) -> DataFrame:
    mine = authorships.where(F.col("author_id") == author_id).select(F.col("readable_type").alias("at"), F.col("readable_id").cast("string").alias("ai"))
    return browsable(items).join(mine, (F.col("type") == F.col("at")) & (F.col("id") == F.col("ai")), "left_semi")


def of_source(items: DataFrame, source_id) -> DataFrame:
    return browsable(items).where(F.col("source_id") == F.lit(str(source_id)))


def contributors(items: DataFrame) -> DataFrame:
    """Distinct authors across items."""
    return items.select(F.explode("authors").alias("a")).select("a.id", "a.name").distinct()


def distinct_sources(items: DataFrame) -> DataFrame:
    return items.where("source is not null").select("source.*").distinct()


def institutions_of(links: DataFrame, affiliations: DataFrame) -> DataFrame:
    """author_id, institutions in order: primary first, then by name."""
    inst = affiliations.where("type = 'institution'").select(F.col("id").alias("inst_id"), "name", "slug")
    rows = links.join(inst, F.col("affiliation_id") == F.col("inst_id"))
    return rows.groupBy("author_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((~F.col("is_primary")).alias("second"), "name", "slug"))), lambda x: F.struct(x["name"].alias("name"), x["slug"].alias("slug"))).alias("institutions"))


def author_order() -> list[Column]:
    return [F.coalesce("sort_name", "name").asc(), F.col("id").asc()]


def bylines(authorships: DataFrame, authors: DataFrame) -> DataFrame:
    """readable_type, readable_id, ordinal, name, slug: a row an author, of authors that are there."""
    a = authors.select(F.col("id").cast("string").alias("_author"), "name", "slug")
    return authorships.join(a, F.col("author_id").cast("string") == F.col("_author")).select("readable_type", "readable_id", "ordinal", "name", "slug")


def article_sources(articles: DataFrame, affiliations: DataFrame) -> DataFrame:
    """canonical_url, name, slug of the source of each article that has one."""
    s = affiliations.select(F.col("id").alias("_source"), "name", "slug")
    return articles.join(s, F.col("affiliation_id") == F.col("_source")).select("canonical_url", "name", "slug")


def source_list(affiliations: DataFrame) -> DataFrame:
    """What is read from: all affiliations but institutions, to be sorted by ``by_name``."""
    return affiliations.where(F.col("type") != "institution")


def by_name() -> list[Column]:
    return [F.lower("name").asc(), F.col("id").asc()]


def reading_queue(queue: DataFrame, items: DataFrame, user_id=None) -> DataFrame:
    """A user's items that are not archived and whose readable is there; newest first is ``queue_order``."""
    q = queue.where(F.col("state") != "archived")
    q = q if user_id is None else q.where(F.col("user_id") == user_id)
    q = q.select(F.col("id").alias("item_id"), "user_id", "readable_type", F.col("readable_id").cast("string").alias("readable_id"), "state", "added_at")
    return q.join(items, (F.col("readable_type") == F.col("type")) & (F.col("readable_id") == F.col("id")))


def queue_order() -> list[Column]:
    return [F.col("added_at").desc(), F.col("item_id").desc()]


def titles(articles: DataFrame, papers: DataFrame, issues: DataFrame) -> DataFrame:
    return normalise(articles, papers, issues).select(F.col("type").alias("readable_type"), F.col("id").alias("readable_id"), "title")


def orphans(refs: DataFrame, items: DataFrame) -> DataFrame:
    """References whose readable is gone."""
    return refs.join(items.select(F.col("type").alias("t"), F.col("id").alias("i")), (F.col("readable_type") == F.col("t")) & (F.col("readable_id").cast("string") == F.col("i")), "left_anti")


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which has to be total."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_first = 1").drop("_first")


def byline(df: DataFrame, names: str) -> DataFrame:
    """One row a name, with its ordinal from 0."""
    return df.select(*[c for c in df.columns if c != names], F.posexplode(names).alias("ordinal", "name"))
