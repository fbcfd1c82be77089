"""The logical tables as projections of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..sources.reads import read

COVERAGE = {"title": "title_source", "author": "author_source", "affiliation": "affiliation_source", "published": "published_source"}


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)

    def extraction_events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        failed = F.col("event_type") == "error"
        site = F.concat(F.lit("site"), (F.col("user_id") % 17).cast("string"))
        return self.raw("events").select(
            "event_id",
            F.concat(F.lit("https://"), site, F.lit(".example/"), F.col("user_id").cast("string")).alias("url"),
            F.concat(site, F.lit(".example")).alias("domain"),
            F.when(failed, "failed").otherwise("done").alias("outcome"),
            F.when(failed & (k % 4 != 0), F.concat(F.lit("class"), (k % 4).cast("string"))).alias("error_class"),
            (F.col("value") / 500).alias("body_confidence"),
            F.when(F.col("event_type") != "view", F.col("value") / 1000).alias("entity_confidence"),
            F.floor("value").cast("int").alias("word_count"),
            F.nullif(F.col("event_type"), F.lit("view")).alias("title_source"),
            F.when(k % 3 != 0, "meta").alias("author_source"),
            F.when(k % 2 == 0, "og").when(k % 5 != 0, "domain").alias("affiliation_source"),
            F.when(k % 7 == 0, "json-ld").alias("published_source"),
            F.col("value").alias("fetch_ms"),
            (F.col("value") * 2).alias("extract_ms"),
            F.col("ts").alias("created_at"),
        )

    def tagging_events(self) -> DataFrame:
        return self.extraction_events().select("event_id", F.lit("article").alias("readable_type"), (F.col("event_id") % 1400 + 1).cast("string").alias("readable_id"), "outcome", "created_at")

    def labels(self) -> DataFrame:
        e = self.extraction_events().where("event_id % 50 = 0").select("url").distinct().select(F.lit("extraction").alias("feature"), F.lit(None).cast("string").alias("readable_type"), F.lit(None).cast("string").alias("readable_id"), F.col("url").alias("subject_url"))
        t = self.tagging_events().where("event_id % 40 in (1, 2, 3)").select("readable_type", "readable_id").distinct().select(F.lit("tagging").alias("feature"), "readable_type", "readable_id", F.lit(None).cast("string").alias("subject_url"))
        return e.unionByName(t)

    def golden(self) -> DataFrame:
        """Labels with their JSON: tags of every third readable, bylines and sources of every fifth article."""
        part = self.raw("part")
        tag = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "-"))
        tags = part.where("p_partkey % 3 = 0").groupBy((F.col("p_partkey") % 700).cast("string").alias("readable_id")).agg(F.to_json(F.struct(F.sort_array(F.collect_set(F.when(F.col("p_size") < 40, tag).otherwise("other"))).alias("tags"))).alias("label"))
        tags = tags.select(F.lit("tagging").alias("feature"), F.lit("article").alias("readable_type"), "readable_id", F.lit(None).cast("string").alias("subject_url"), "label")
        who = F.array(F.concat(F.lit("supplier-"), F.lpad((F.col("p_partkey") % 10 + 1).cast("string"), 9, "0")))
        pages = self.articles().join(part.select(F.col("p_partkey").alias("id"), "p_size"), "id").where("id % 5 = 0").withColumn("p_partkey", F.col("id"))
        nation = F.when(F.col("p_size") < 30, F.concat(F.lit("n"), F.col("affiliation_id").cast("string")))
        pages = pages.select(F.lit("extraction").alias("feature"), F.lit(None).cast("string").alias("readable_type"), F.lit(None).cast("string").alias("readable_id"), F.col("canonical_url").alias("subject_url"), F.to_json(F.struct(who.alias("authors"), nation.alias("source"))).alias("label"))
        return tags.unionByName(pages)

    def articles(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_partkey") % 30).alias("affiliation_id"), F.concat(F.lit("https://site"), (F.col("p_partkey") % 17).cast("string"), F.lit(".example/"), F.col("p_partkey").cast("string")).alias("canonical_url"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("body_html"))

    def papers(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("affiliation_id"), F.concat(F.lit("10.1000/"), F.col("s_suppkey").cast("string")).alias("doi"))

    def issues(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("subject"), F.col("c_nationkey").alias("affiliation_id"))

    def sources(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"))

    def authors(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), slugify(F.col("s_name")).alias("slug"))

    def authorships(self) -> DataFrame:
        gone = F.when(F.col("l_linenumber") == 7, -F.col("l_suppkey")).otherwise(F.col("l_suppkey"))  # some authors are gone
        rows = self.raw("lineitem").select(F.lit("article").alias("readable_type"), F.col("l_partkey").alias("readable_id"), gone.alias("author_id"))
        return rows.groupBy("readable_type", "readable_id", "author_id").agg(F.count("*").alias("n")).select("readable_type", "readable_id", "author_id", (F.col("author_id") % 1000).cast("int").alias("ordinal"))

    def catalog(self) -> DataFrame:
        from ..operators import catalog as C

        return C.catalog(self.articles(), self.papers(), self.issues(), self.sources(), self.authorships(), self.authors())

    def queue_items(self) -> DataFrame:
        state = F.when(F.col("o_orderstatus") == "O", "unread").when(F.col("o_orderstatus") == "F", "read").otherwise("archived")
        return self.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.lit("article").alias("readable_type"), (F.col("o_orderkey") % 3000).alias("readable_id"), state.alias("state"), F.col("o_orderdate").alias("added_at"))

    def tags(self) -> DataFrame:
        return self.raw("part").select(F.col("p_brand").alias("label")).distinct().select(F.lower(F.regexp_replace("label", "[^A-Za-z0-9]+", "-")).alias("id"), F.lower(F.regexp_replace("label", "[^A-Za-z0-9]+", "-")).alias("slug"), "label")

    def readable_tags(self) -> DataFrame:
        tag = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "-"))
        return self.raw("part").select(tag.alias("tag_id"), F.lit("article").alias("readable_type"), (F.col("p_partkey") % 700).cast("string").alias("readable_id"), (F.col("p_size") / 50).alias("confidence"))

    def overrides(self) -> DataFrame:
        p = self.raw("part").select("p_partkey", F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "-")).alias("tag_id"))
        rows = self.raw("lineitem").where("l_returnflag in ('A', 'R')").join(p, F.col("l_partkey") == F.col("p_partkey"))
        return rows.groupBy(F.col("l_orderkey").alias("queue_item_id"), "tag_id").agg(F.when(F.max("l_returnflag") == "R", "suppress").otherwise("add").alias("op"))


_SLUG = "lower(regexp_replace({0}, '[^A-Za-z0-9]+', '-', 'g'))"
#: Common table expressions of the same names for the SQL side.
SQL = {
    "ee": """ee AS (SELECT event_id, 'https://site' || (user_id % 17) || '.example/' || user_id AS url, 'site' || (user_id % 17) || '.example' AS domain,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS outcome, CASE WHEN event_type = 'error' AND k % 4 <> 0 THEN 'class' || (k % 4) END AS error_class,
  value / 500 AS body_confidence, CASE WHEN event_type <> 'view' THEN value / 1000 END AS entity_confidence, CAST(floor(value) AS INT) AS word_count,
  nullif(event_type, 'view') AS title_source, CASE WHEN k % 3 <> 0 THEN 'meta' END AS author_source, CASE WHEN k % 2 = 0 THEN 'og' WHEN k % 5 <> 0 THEN 'domain' END AS affiliation_source,
  CASE WHEN k % 7 = 0 THEN 'json-ld' END AS published_source, value AS fetch_ms, value * 2 AS extract_ms, ts AS created_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))""",
    "te": "te AS (SELECT event_id, 'article' AS readable_type, CAST(event_id % 1400 + 1 AS VARCHAR) AS readable_id, outcome, created_at FROM ee)",
    "el": """el AS (SELECT DISTINCT 'extraction' AS feature, NULL::VARCHAR AS readable_type, NULL::VARCHAR AS readable_id, url AS subject_url FROM ee WHERE event_id % 50 = 0
  UNION ALL SELECT DISTINCT 'tagging', readable_type, readable_id, NULL FROM te WHERE event_id % 40 IN (1, 2, 3))""",
    "articles": "articles AS (SELECT p_partkey AS id, p_name AS title, p_partkey % 30 AS affiliation_id, 'https://site' || (p_partkey % 17) || '.example/' || p_partkey AS canonical_url, CASE WHEN p_size > 10 THEN p_type END AS body_html FROM part)",
    "items": """items AS (SELECT 'article' AS type, CAST(id AS VARCHAR) AS id, title, canonical_url AS url, CAST(affiliation_id AS VARCHAR) AS source_id FROM articles
  UNION ALL SELECT 'paper', CAST(s_suppkey AS VARCHAR), s_name, 'https://doi.org/10.1000/' || s_suppkey, CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'newsletter', CAST(c_custkey AS VARCHAR), c_name, NULL, CAST(c_nationkey AS VARCHAR) FROM customer)""",
    "au": "au AS (SELECT DISTINCT 'article' AS readable_type, l_partkey AS readable_id, CASE WHEN l_linenumber = 7 THEN -l_suppkey ELSE l_suppkey END AS author_id, CASE WHEN l_linenumber = 7 THEN -l_suppkey ELSE l_suppkey END % 1000 AS ordinal FROM lineitem)",
    "lines": """lines AS (SELECT readable_type AS of_type, CAST(readable_id AS VARCHAR) AS of_id, string_agg(s_name, '; ' ORDER BY ordinal, CAST(author_id AS VARCHAR)) AS byline, count(*) AS n
  FROM au JOIN supplier ON s_suppkey = author_id GROUP BY ALL)""",
    "queue": """queue AS (SELECT o_orderkey AS id, o_custkey AS user_id, 'article' AS readable_type, o_orderkey % 3000 AS readable_id,
  CASE o_orderstatus WHEN 'O' THEN 'unread' WHEN 'F' THEN 'read' ELSE 'archived' END AS state, o_orderdate AS added_at FROM orders)""",
    "tags": f"tags AS (SELECT DISTINCT {_SLUG.format('p_brand')} AS id, {_SLUG.format('p_brand')} AS slug, p_brand AS label FROM part)",
    "rt": f"rt AS (SELECT {_SLUG.format('p_brand')} AS tag_id, 'article' AS readable_type, CAST(p_partkey % 700 AS VARCHAR) AS readable_id, p_size / 50 AS confidence FROM part)",
    "ov": f"ov AS (SELECT l_orderkey AS queue_item_id, {_SLUG.format('p_brand')} AS tag_id, CASE WHEN max(l_returnflag) = 'R' THEN 'suppress' ELSE 'add' END AS op FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R') GROUP BY ALL)",
}
_NEEDS = {"te": ("ee",), "el": ("ee", "te"), "items": ("articles",), "lines": ("au",)}


def with_sql(names: str, body: str) -> str:
    """``WITH`` the named expressions and those that they need, then ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(SQL[n] for n in order) + ("" if body.startswith(",") else "\n") + body
