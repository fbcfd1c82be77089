"""One query an operator over the driver's tables. Names follow the inventory's identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import nested as N
from ..functions import text as T
from ..functions import urls as U
from ..functions import vectors as V
from ..operators import analytics as A
from ..operators import catalog as C
from ..operators import content as B
from ..operators import entities as E
from ..operators import fetches as H
from ..operators import tags as G
from ..sources import reads as R
from ..sources import sinks as K
from ..sources.scratch import scratch
from ..streaming import jobs as J
from ..streaming import machines as M
from .proxies import COVERAGE, Tables, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# Scans, look-ups and predicates.


@query("s1_find_many", "SELECT * FROM nation")
def _(t):
    return R.find_many(t.raw("nation"))


@query("s2_by_id", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def _(t):
    return R.by_id(t.raw("customer"), 7, "c_custkey").select("c_custkey", "c_name")


@query("s3_find_many_where", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def _(t):
    return R.find_many(t.raw("customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 3}).select("c_custkey", "c_mktsegment")


@query("s4_find_in", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8)")
def _(t):
    return R.find_in(t.raw("orders"), "o_custkey", [1, 2, 3, 5, 8, 8, None]).select("o_orderkey", "o_totalprice")


@query("s4_find_in_none", "SELECT o_orderkey FROM orders WHERE false")
def _(t):
    return R.find_in(t.raw("orders"), "o_custkey", []).select("o_orderkey")


@query("p2_predicates", "SELECT event_id FROM events WHERE (event_type IN ('view', 'click') AND value < 100) OR (event_type <> 'view' AND NOT value <= 400) OR props IS NULL")
def _(t):
    c = F.col
    return t.raw("events").where((c("event_type").isin("view", "click") & (c("value") < 100)) | ((c("event_type") != "view") & ~(c("value") <= 400)) | c("props").isNull()).select("event_id")


@query("p3_json_path", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def _(t):
    return t.raw("events").where(R.payload_equals("props", "k", "7")).select("event_id")


@query("s6_json_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return R.decode_json(t.raw("events"), "props", "k bigint").select("event_id", "props.k")


# Writes as functions from tables to tables.


@query("w2_create_ignore", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT DISTINCT c_nationkey + 20, 'new' || (c_nationkey + 20) FROM customer WHERE c_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)")
def _(t):
    old = t.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    new = t.raw("customer").select((F.col("c_nationkey") + 20).alias("id"), F.concat(F.lit("new"), (F.col("c_nationkey") + 20).cast("string")).alias("name"))
    return K.create_ignore(old, new, (("id",),), order="name")


@query("w3_upsert", "SELECT coalesce(n.n_nationkey, s.k) AS id, CASE WHEN s.k IS NULL THEN n.n_name ELSE 'sum' || s.c END AS name FROM nation n FULL JOIN (SELECT s_nationkey + 10 AS k, count(*) AS c FROM supplier GROUP BY 1) s ON n.n_nationkey = s.k")
def _(t):
    old = t.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    new = t.raw("supplier").groupBy((F.col("s_nationkey") + 10).alias("id")).agg(F.concat(F.lit("sum"), F.count("*").cast("string")).alias("name"))
    return K.upsert(old, new, ("id",))


@query("v5_set_embedding", "SELECT 'article' AS readable_type, CAST(CASE WHEN n.k IS NULL THEN o.k ELSE n.k END AS VARCHAR) AS readable_id, coalesce(n.v, o.v) AS vec_id FROM (SELECT label AS k, max(vec_id) AS v FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1) o FULL JOIN (SELECT label + 3 AS k, max(vec_id) AS v FROM embeddings WHERE vec_id % 2 = 1 GROUP BY 1) n ON o.k = n.k")
def _(t):
    e = t.raw("embeddings")
    rows = lambda df, k: df.select(F.lit("article").alias("readable_type"), k.cast("string").alias("readable_id"), "vec_id", "embedding")
    old = K.set_embedding(rows(e.limit(0), F.col("label")), rows(e.where("vec_id % 2 = 0"), F.col("label")), "vec_id")
    return K.set_embedding(old, rows(e.where("vec_id % 2 = 1"), F.col("label") + 3), "vec_id").select("readable_type", "readable_id", "vec_id")


@query("w4_update_where", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t):
    return K.update_where(t.raw("customer"), F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("debt")}).select("c_custkey", "c_mktsegment")


@query("w5_delete_where", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    return K.delete_where(t.raw("orders"), F.col("o_orderstatus") == "F").select("o_orderkey")


@query("w6_replace_by_key", with_sql("rt", "SELECT * FROM rt WHERE readable_id NOT IN ('1', '2') UNION ALL SELECT 'x', 'article', '1', 1.0"))
def _(t):
    new = t.spark.createDataFrame([("x", "article", "1", 1.0)], "tag_id string, readable_type string, readable_id string, confidence double")
    drop2 = K.delete_where(t.readable_tags(), F.col("readable_id") == "2")
    return K.replace_by_key(drop2, new, ("readable_type", "readable_id"))


# The catalogue.


@query("u1_catalog", with_sql("items lines", "SELECT type, i.id, title, url, n_name AS source, coalesce(byline, '') AS byline, coalesce(n, 0) AS n_authors FROM items i LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = source_id LEFT JOIN lines ON of_type = type AND of_id = i.id"))
def _(t):
    return t.catalog().select("type", "id", "title", "url", F.col("source.name").alias("source"), F.array_join(F.transform("authors", lambda a: a["name"]), "; ").alias("byline"), F.size("authors").cast("bigint").alias("n_authors"))


@query("o1_title_order", with_sql("items", "SELECT type, id, title, row_number() OVER (ORDER BY lower(title) NULLS FIRST, type, id) AS rank FROM items"))
def _(t):
    return C.ranked(C.normalise(t.articles(), t.papers(), t.issues()), *C.by_title()).select("type", "id", "title", "rank")


@query("o3_sources", "SELECT n_nationkey AS id, n_name AS name, row_number() OVER (ORDER BY lower(n_name), n_nationkey) AS rank FROM nation WHERE n_nationkey % 4 <> 0")
def _(t):
    kinds = t.sources().withColumn("type", F.when(F.col("id") % 4 == 0, "institution").otherwise("magazine"))
    return C.ranked(C.source_list(kinds), *C.by_name()).select("id", "name", "rank")


@query("j8_by_author", with_sql("items au", "SELECT type, id, title FROM items WHERE type = 'article' AND id IN (SELECT CAST(readable_id AS VARCHAR) FROM au WHERE author_id = 5)"))
def _(t):
    return C.of_author(C.normalise(t.articles(), t.papers(), t.issues()), t.authorships(), 5).select("type", "id", "title")


@query("j9_by_source", with_sql("items", "SELECT type, id, title FROM items WHERE type IN ('article', 'paper') AND source_id = '4'"))
def _(t):
    return C.of_source(C.normalise(t.articles(), t.papers(), t.issues()), 4).select("type", "id", "title")


@query("u5_contributors", with_sql("au", "SELECT DISTINCT CAST(author_id AS VARCHAR) AS id, s_name AS name FROM au JOIN supplier ON s_suppkey = author_id JOIN part ON p_partkey = readable_id"))
def _(t):
    return C.contributors(t.catalog())


@query("u5_sources", with_sql("items", "SELECT DISTINCT n_name AS name FROM items JOIN nation ON CAST(n_nationkey AS VARCHAR) = source_id"))
def _(t):
    return C.distinct_sources(t.catalog()).select("name")


@query("j3_reading_queue", with_sql("queue items", "SELECT q.id AS item_id, user_id, state, added_at, title FROM queue q JOIN items i ON readable_type = type AND CAST(readable_id AS VARCHAR) = i.id WHERE state <> 'archived'"))
def _(t):
    return C.reading_queue(t.queue_items(), C.normalise(t.articles(), t.papers(), t.issues())).select("item_id", "user_id", "state", "added_at", "title")


@query("o4_queue_of_user", with_sql("queue items", "SELECT q.id AS item_id, state, added_at, title, row_number() OVER (ORDER BY added_at DESC, q.id DESC) AS rank FROM queue q JOIN items i ON readable_type = type AND CAST(readable_id AS VARCHAR) = i.id WHERE state <> 'archived' AND user_id = 11"))
def _(t):
    mine = C.reading_queue(t.queue_items(), C.normalise(t.articles(), t.papers(), t.issues()), 11)
    return C.ranked(mine, *C.queue_order()).select("item_id", "state", "added_at", "title", "rank")


@query("v14_orphans", with_sql("queue items", "SELECT id FROM queue WHERE CAST(readable_id AS VARCHAR) NOT IN (SELECT id FROM items WHERE type = 'article')"))
def _(t):
    return C.orphans(t.queue_items(), C.normalise(t.articles(), t.papers(), t.issues())).select("id")


@query("j7_institutions", "SELECT s_suppkey AS author_id, string_agg(r_name, '; ' ORDER BY s_nationkey % 5 <> r_regionkey, r_name) AS institutions FROM supplier JOIN region ON r_regionkey <= s_nationkey % 5 GROUP BY 1")
def _(t):
    r = t.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lower("r_name").alias("slug"), F.lit("institution").alias("type"))
    links = t.raw("supplier").join(t.raw("region"), F.col("r_regionkey") <= F.col("s_nationkey") % 5).select(F.col("s_suppkey").alias("author_id"), F.col("r_regionkey").alias("affiliation_id"), (F.col("s_nationkey") % 5 == F.col("r_regionkey")).alias("is_primary"))
    return C.institutions_of(links, r).select("author_id", F.array_join(F.transform("institutions", lambda x: x["name"]), "; ").alias("institutions"))


@query("o2_author_order", "SELECT s_suppkey AS id, s_name AS name, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 2 = 0 THEN 'A' || s_name ELSE s_name END, s_suppkey) AS rank FROM supplier")
def _(t):
    a = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("A"), "s_name")).alias("sort_name"))
    return C.ranked(a, *C.author_order()).select("id", "name", "rank")


@query("wn1_latest_event", with_sql("ee", "SELECT url, event_id, outcome FROM ee QUALIFY row_number() OVER (PARTITION BY url ORDER BY created_at DESC, event_id DESC) = 1"))
def _(t):
    return C.latest(t.extraction_events(), ["url"], F.desc("created_at"), F.desc("event_id")).select("url", "event_id", "outcome")


@query("wn2_first_inbox", "SELECT o_custkey AS user_id, o_orderkey AS alias FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def _(t):
    return C.latest(t.raw("orders"), ["o_custkey"], F.asc("o_orderdate"), F.asc("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("alias"))


@query("wn3_byline", "SELECT p_partkey, CAST(i - 1 AS INT) AS ordinal, w[i] AS name FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))")
def _(t):
    return C.byline(t.raw("part").select("p_partkey", F.split("p_name", " ").alias("names")), "names")


# Analytics.


@query("a1_overview", with_sql("ee", "SELECT count(*) AS total, count(*) FILTER (outcome = 'done') AS done, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (body_confidence < 0.5) AS low_confidence, round(avg(body_confidence), 2) AS avg_body_confidence, round(avg(entity_confidence), 2) AS avg_entity_confidence FROM ee"))
def _(t):
    return A.overview(t.extraction_events())


@query("a2_coverage", with_sql("ee", " UNION ALL ".join(f"SELECT '{k}' AS field, {c} AS source, count(*) AS n FROM ee GROUP BY 2" for k, c in COVERAGE.items())))
def _(t):
    return A.coverage(t.extraction_events(), COVERAGE)


@query("a3_by_domain", with_sql("ee", "SELECT domain, count(*) AS n, count(*) FILTER (outcome = 'done') AS done, round(avg(body_confidence), 2) AS avg_confidence FROM ee GROUP BY domain ORDER BY n DESC, domain LIMIT 15"))
def _(t):
    return A.by_domain(t.extraction_events())


@query("a4_errors", with_sql("ee", "SELECT error_class, count(*) AS n FROM ee WHERE outcome = 'failed' GROUP BY error_class"))
def _(t):
    return A.errors(t.extraction_events())


@query("a5_latency", with_sql("ee", "SELECT " + ", ".join(f"CAST(round(quantile_cont({c}, {p})) AS BIGINT) AS p{round(100 * p)}_{c}" for c in ("fetch_ms", "extract_ms") for p in (0.5, 0.95)) + " FROM ee WHERE outcome = 'done'"))
def _(t):
    return A.latency(t.extraction_events())


@query("a6_recovery", with_sql("ee articles", "SELECT count(DISTINCT url) AS failed_urls, count(DISTINCT url) FILTER (body_html IS NOT NULL) AS recovered FROM ee LEFT JOIN articles ON canonical_url = url WHERE outcome = 'failed'"))
def _(t):
    return A.recovery(t.extraction_events(), t.articles())


@query("o5_recent_failures", with_sql("ee", "SELECT event_id, url, error_class, created_at FROM ee WHERE outcome = 'failed' ORDER BY created_at DESC, event_id DESC LIMIT 10"))
def _(t):
    return A.recent_failures(t.extraction_events())


@query("a7_tagging_overview", with_sql("te rt tags", "SELECT (SELECT count(*) FROM te) AS attempts, (SELECT count(*) FROM te WHERE outcome = 'done') AS done, (SELECT count(*) FROM te WHERE outcome = 'failed') AS failed, (SELECT count(DISTINCT (readable_type, readable_id)) FROM te) AS readables, (SELECT count(DISTINCT (readable_type, readable_id)) FROM rt) AS tagged, (SELECT count(*) FROM rt) AS assigned, (SELECT round(avg(confidence), 2) FROM rt) AS avg_confidence, (SELECT count(*) FROM tags) AS vocabulary"))
def _(t):
    return A.tagging_overview(t.tagging_events(), t.readable_tags(), t.tags())


@query("j11_top_tags", with_sql("rt tags", "SELECT label, n, greatest(1, max(n) OVER ()) AS scale FROM (SELECT label, count(*) AS n FROM rt JOIN tags ON id = tag_id GROUP BY label ORDER BY n DESC, label LIMIT 6)"))
def _(t):
    return A.top_tags(t.readable_tags(), t.tags())


@query("a8_extraction_overview", with_sql("ee", "SELECT count(*) AS total, round(100 * count(*) FILTER (outcome = 'done') / count(*)) AS success_rate, round(avg(body_confidence), 2) AS avg_confidence, round(avg(word_count), 1) AS avg_words, " + ", ".join(f"round(100 * count({c}) / count(*)) AS {k}_coverage" for k, c in COVERAGE.items()) + " FROM ee"))
def _(t):
    return A.extraction_overview(t.extraction_events(), COVERAGE)


_OPEN = """rc AS (SELECT readable_type, readable_id, avg(confidence) AS avg_confidence FROM rt GROUP BY ALL),
o AS (SELECT te.readable_type, te.readable_id, bool_or(outcome = 'failed') AS any_failed, max(created_at) AS newest, min(avg_confidence) AS avg_confidence FROM te
LEFT JOIN el ON feature = 'tagging' AND el.readable_type = te.readable_type AND el.readable_id = te.readable_id LEFT JOIN rc ON rc.readable_type = te.readable_type AND rc.readable_id = te.readable_id
WHERE feature IS NULL GROUP BY 1, 2)"""


@query("a11_tagging_progress", with_sql("te el rt", "," + _OPEN + " SELECT (SELECT count(DISTINCT (readable_type, readable_id)) FROM te) AS total, (SELECT count(*) FROM el WHERE feature = 'tagging') AS labeled, (SELECT count(*) FROM o WHERE any_failed) AS failed, (SELECT count(*) FROM o WHERE NOT any_failed AND avg_confidence < 0.6) AS low_confidence").replace("\n,rc", ",\nrc"))
def _(t):
    return A.tagging_progress(t.tagging_events(), t.labels(), t.readable_tags())


@query("o6_tagging_queue", with_sql("te el rt", "," + _OPEN + " SELECT readable_type, readable_id, any_failed, round(avg_confidence, 6) AS avg_confidence, newest FROM o ORDER BY any_failed DESC, coalesce(o.avg_confidence, 1), newest DESC, 1, 2 LIMIT 25").replace("\n,rc", ",\nrc"))
def _(t):
    return A.tagging_queue(t.tagging_events(), t.labels(), t.readable_tags(), k=25).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("a11_extraction_progress", with_sql("ee el", ", o AS (SELECT url, bool_or(outcome = 'failed') AS any_failed, min(body_confidence) AS least FROM ee WHERE url NOT IN (SELECT subject_url FROM el WHERE feature = 'extraction') GROUP BY url) SELECT (SELECT count(DISTINCT url) FROM ee) AS total, (SELECT count(*) FROM el WHERE feature = 'extraction') AS labeled, (SELECT count(*) FROM o WHERE any_failed) AS failed, (SELECT count(*) FROM o WHERE NOT any_failed AND least < 0.6) AS low_confidence"))
def _(t):
    return A.extraction_progress(t.extraction_events(), t.labels())


@query("p8_extraction_queue", with_sql("ee el", "SELECT url, bool_or(outcome = 'failed') AS any_failed, min(body_confidence) AS least, max(created_at) AS newest FROM ee WHERE url NOT IN (SELECT subject_url FROM el WHERE feature = 'extraction') AND url NOT IN ('https://site1.example/1', 'https://site2.example/2') GROUP BY url ORDER BY any_failed DESC, least, newest DESC, url LIMIT 20"))
def _(t):
    return A.extraction_queue(t.extraction_events(), t.labels(), ["https://site1.example/1", "https://site2.example/2"], 20)


@query("a13_mean_confidence", with_sql("rt", "SELECT readable_type, readable_id, avg(confidence) AS avg_confidence FROM rt GROUP BY ALL"))
def _(t):
    return A.mean_tag_confidence(t.readable_tags())


_CASES = "cases AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN ['good'] WHEN quality = 1 THEN ['good', 'toxic'] ELSE [] END AS golden, CASE WHEN n_chars > 500 THEN ['good'] ELSE ['short', 'toxic'] END AS predicted FROM labels JOIN documents USING (doc_id))"


def _cases(t):
    q, x = F.col("quality") == 1, F.col("toxic") == 0
    strings = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    golden = F.when(q & x, strings("good")).when(q, strings("good", "toxic")).otherwise(strings())
    return t.raw("labels").join(t.raw("documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", golden.alias("golden"), F.when(F.col("n_chars") > 500, strings("good")).otherwise(strings("short", "toxic")).alias("predicted"))


@query("a14_set_scores", f"WITH {_CASES}, s AS (SELECT sum(len(list_intersect(golden, predicted))) AS tp, sum(len(list_filter(predicted, lambda x: NOT list_contains(golden, x)))) AS fp, sum(len(list_filter(golden, lambda x: NOT list_contains(predicted, x)))) AS fn, count(*) AS n FROM cases) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, n, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM s")
def _(t):
    return A.set_scores(_cases(t))


@query("a15_accuracy", "SELECT avg(CASE WHEN nullif(lang, 'en') IS NOT DISTINCT FROM CASE WHEN n_chars > 1000 THEN 'de' END THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM documents")
def _(t):
    d = t.raw("documents").select(F.nullif(F.col("lang"), F.lit("en")).alias("golden"), F.when(F.col("n_chars") > 1000, "de").alias("predicted"))
    return A.accuracy(d)


@query("a17_settle_run", f"WITH {_CASES} SELECT 'done' AS status, CAST(sum(len(list_intersect(golden, predicted))) AS BIGINT) AS tp, CAST(sum(len(list_filter(predicted, lambda x: NOT list_contains(golden, x)))) AS BIGINT) AS fp, CAST(sum(len(list_filter(golden, lambda x: NOT list_contains(predicted, x)))) AS BIGINT) AS fn, count(*) AS n FROM cases")
def _(t):
    c = _cases(t)
    return A.settle_run(A.run_results(c.select("doc_id", "golden"), c.select("doc_id", "predicted"), ["doc_id"]))


@query("a16_tagging_score", with_sql("rt tags", """, golden AS (SELECT CAST(p_partkey % 700 AS VARCHAR) AS rid, list_distinct(list(CASE WHEN p_size < 40 THEN lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g')) ELSE 'other' END)) AS g FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
now AS (SELECT readable_id AS rid, list_distinct(list(slug)) AS p FROM rt JOIN tags ON id = tag_id GROUP BY 1),
s AS (SELECT sum(len(list_intersect(g, coalesce(p, [])))) AS tp, sum(len(list_filter(coalesce(p, []), lambda x: NOT list_contains(g, x)))) AS fp, sum(len(list_filter(g, lambda x: NOT list_contains(coalesce(p, []), x)))) AS fn, count(*) AS n FROM golden LEFT JOIN now USING (rid))
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, n, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, n AS labeled FROM s"""))
def _(t):
    return A.tagging_score(t.golden(), t.readable_tags(), t.tags())


@query("a16_extraction_score", with_sql("articles au", """, golden AS (SELECT canonical_url AS url, 'supplier-' || lpad(CAST(id % 10 + 1 AS VARCHAR), 9, '0') AS g, CASE WHEN p_size < 30 THEN 'n' || affiliation_id END AS gs, id, affiliation_id FROM articles JOIN part ON p_partkey = id WHERE id % 5 = 0),
now AS (SELECT readable_id AS id, list_distinct(list(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-'))) AS p FROM au JOIN supplier ON s_suppkey = author_id GROUP BY 1),
c AS (SELECT g, coalesce(p, []) AS p, gs, 'n' || n_nationkey AS ps FROM golden LEFT JOIN now USING (id) LEFT JOIN nation ON n_nationkey = affiliation_id),
s AS (SELECT count(*) FILTER (list_contains(p, g)) AS tp, sum(len(p)) - count(*) FILTER (list_contains(p, g)) AS fp, count(*) FILTER (NOT list_contains(p, g)) AS fn, count(*) AS n, avg(CASE WHEN gs IS NOT DISTINCT FROM ps THEN 1.0 ELSE 0.0 END) AS source_accuracy FROM c)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, n, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, n AS labeled, source_accuracy FROM s"""))
def _(t):
    sources = t.raw("nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("slug"))
    return A.extraction_score(t.golden(), t.articles(), t.authorships(), t.authors(), sources)


@query("j15_assigned_tags", with_sql("rt tags", "SELECT readable_id, slug, confidence FROM rt JOIN tags ON id = tag_id"))
def _(t):
    return G.assigned(t.readable_tags(), t.tags()).select("readable_id", "slug", "confidence")


@query("j15_bylines", with_sql("au", "SELECT readable_id, ordinal, s_name AS name FROM au JOIN supplier ON s_suppkey = author_id"))
def _(t):
    return C.bylines(t.authorships(), t.authors()).select("readable_id", "ordinal", "name")


@query("j15_sources", with_sql("articles", "SELECT canonical_url, n_name AS name FROM articles JOIN nation ON n_nationkey = affiliation_id"))
def _(t):
    return C.article_sources(t.articles(), t.sources()).select("canonical_url", "name")


@query("f49_contract", "SELECT p_partkey, p_size > 40 AS wrong FROM part")
def _(t):
    one = F.array(F.struct(F.col("p_name").alias("name")))
    good, bad = K.check_contract(t.raw("part"), N.contract_errors(one, F.col("p_size") / 40))
    return good.select("p_partkey", F.lit(False).alias("wrong")).unionByName(bad.select("p_partkey", F.lit(True).alias("wrong")))


@query("u3_corrections", f"WITH {_CASES} SELECT doc_id, list_aggregate(list_sort(list_distinct(list_concat(list_filter(predicted, lambda x: NOT list_contains(['short'], x)), golden))), 'string_agg', ',') AS corrected FROM cases")
def _(t):
    return _cases(t).select("doc_id", F.nullif(F.array_join(F.array_sort(A.corrections(F.col("predicted"), F.array(F.lit("short")), F.col("golden"))), ","), F.lit("")).alias("corrected"))


# Tags.


@query("j4_baseline", with_sql("rt tags", "SELECT readable_type, readable_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM rt JOIN tags ON id = tag_id GROUP BY ALL"))
def _(t):
    return G.baseline(t.readable_tags(), t.tags()).select("readable_type", "readable_id", F.array_join(F.transform("baseline", lambda b: b["label"]), ",").alias("labels"))


_EFFECTIVE = """, q AS (SELECT * FROM queue WHERE state <> 'archived'),
eff AS (SELECT q.id AS item_id, tag_id FROM q JOIN rt ON rt.readable_id = CAST(q.readable_id AS VARCHAR) WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.queue_item_id = q.id AND ov.tag_id = rt.tag_id AND op = 'suppress')
UNION SELECT q.id, tag_id FROM q JOIN ov ON ov.queue_item_id = q.id WHERE op = 'add')
"""


def _effective(t):
    items = t.queue_items().where("state <> 'archived'").select(F.col("id").alias("item_id"), "readable_type", F.col("readable_id").cast("string").alias("readable_id"))
    return G.effective(items, G.baseline(t.readable_tags(), t.tags()), t.overrides(), t.tags())


@query("u2_effective_tags", with_sql("queue rt ov tags", _EFFECTIVE + "SELECT q.id AS item_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels FROM q LEFT JOIN eff ON eff.item_id = q.id LEFT JOIN tags ON tags.id = tag_id GROUP BY 1"))
def _(t):
    return _effective(t).select("item_id", F.array_join(F.transform("tags", lambda x: x["label"]), ",").alias("labels"))


@query("p7_with_tag", with_sql("queue rt ov tags", _EFFECTIVE + "SELECT DISTINCT item_id FROM eff WHERE tag_id = 'brand-11'"))
def _(t):
    return G.with_tag(_effective(t), "brand-11").select("item_id")


@query("u5_distinct_tags", with_sql("queue rt ov tags", _EFFECTIVE + "SELECT DISTINCT slug, label FROM eff JOIN tags ON id = tag_id"))
def _(t):
    return G.distinct_tags(_effective(t))


@query(
    "v6_override_state",
    with_sql(
        "rt",
        """, acts AS (SELECT l_orderkey, lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g')) AS tag_id, CAST(l_orderkey % 700 AS VARCHAR) AS rid, CASE l_returnflag WHEN 'A' THEN 'add' WHEN 'R' THEN 'remove' ELSE 'clear' END AS op, l_shipdate AS t FROM lineitem JOIN part ON l_partkey = p_partkey),
newest AS (SELECT l_orderkey, tag_id, rid, arg_max(op, (t, op)) AS op FROM acts GROUP BY 1, 2, 3), b AS (SELECT DISTINCT readable_id, tag_id AS btag FROM rt)
SELECT l_orderkey AS queue_item_id, tag_id, CASE WHEN op = 'add' THEN 'add' ELSE 'suppress' END AS op FROM newest LEFT JOIN b ON readable_id = rid AND btag = tag_id WHERE (op = 'add' AND btag IS NULL) OR (op = 'remove' AND btag IS NOT NULL)""",
    ),
)
def _(t):
    p = t.raw("part").select("p_partkey", F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "-")).alias("tag_id"))
    acts = t.raw("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("queue_item_id"), "tag_id", F.lit("article").alias("readable_type"), (F.col("l_orderkey") % 700).cast("string").alias("readable_id"), F.when(F.col("l_returnflag") == "A", "add").when(F.col("l_returnflag") == "R", "remove").otherwise("clear").alias("op"), F.col("l_shipdate").alias("at"))
    return G.settle_overrides(acts, G.baseline(t.readable_tags(), t.tags()))


@query("q2_dedupe_assignments", with_sql("rt", "SELECT tag_id, readable_type, readable_id, max(confidence) AS confidence FROM rt GROUP BY ALL"))
def _(t):
    return G.dedupe_assignments(t.readable_tags())


_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


@query("v1_cosine", f"SELECT a.vec_id, round({_COS}, 6) AS similarity FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 0) b")
def _(t):
    e = t.raw("embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("other"))
    return e.join(first).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("j17_nearest", f"SELECT a.vec_id, arg_max(b.vec_id, {_COS}) AS nearest_id, round(max({_COS}), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 5 <> 0 AND b.vec_id % 5 = 0 GROUP BY a.vec_id")
def _(t):
    e = t.raw("embeddings")
    return G.nearest(e.where("vec_id % 5 <> 0").select("vec_id", "embedding"), e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("id"), "embedding")).select("vec_id", "nearest_id", F.round("similarity", 6).alias("similarity"))


@query("v3_resolve_tags", f"WITH e AS (SELECT vec_id, label, embedding FROM embeddings), n AS (SELECT a.vec_id, arg_max(b.vec_id, {_COS}) AS near, max({_COS}) AS sim FROM e a, e b WHERE a.vec_id % 5 <> 0 AND b.vec_id % 5 = 0 GROUP BY a.vec_id) SELECT 'Tag ' || e.label AS label, 'tag-' || e.label AS slug, CASE WHEN e.label % 5 = 0 AND k.vec_id IS NOT NULL THEN CAST(e.label AS VARCHAR) WHEN sim >= 0.9 THEN CAST(near AS VARCHAR) ELSE 'tag-' || e.label END AS tag_id, CASE WHEN e.label % 5 = 0 AND k.vec_id IS NOT NULL THEN 'slug' WHEN sim >= 0.9 THEN 'similar' ELSE 'new' END AS how FROM e JOIN n USING (vec_id) LEFT JOIN embeddings k ON k.vec_id = e.label WHERE e.vec_id % 5 <> 0")
def _(t):
    e = t.raw("embeddings").select("vec_id", F.concat(F.lit("Tag "), F.col("label").cast("string")).alias("label"), "embedding")
    vocabulary = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("id"), F.concat(F.lit("tag-"), F.col("vec_id").cast("string")).alias("slug"), "embedding")
    return G.resolve_tags(e.where("vec_id % 5 <> 0").select("label", "embedding"), vocabulary)


#: Similarity from which vectors of the given table are one tag here: about half of them have one as near.
_ALIKE = 0.35
#: The plain fold: one proposal after another, with the founded tags in a list.
_FOLD = f"""WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, 'tag-' || (vec_id % 150) AS slug, v FROM e WHERE vec_id % 4 <> 0),
s AS (SELECT CAST(vec_id AS VARCHAR) AS id, 'tag-' || (vec_id % 450) AS slug, v FROM e WHERE vec_id % 4 = 0),
b AS (SELECT slug AS s_slug, min(id) AS stored FROM s GROUP BY slug),
n AS (SELECT k, max(c) AS near_c, arg_min(id, (-round(c, 12), id)) AS near_id FROM (SELECT k, s.id, list_cosine_similarity(p.v, s.v) AS c FROM p, s) GROUP BY k),
q AS MATERIALIZED (SELECT p.*, stored, near_c, near_id FROM p LEFT JOIN b ON slug = s_slug LEFT JOIN n USING (k)),
f AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(slug VARCHAR, v DOUBLE[])[]) AS made, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS VARCHAR) AS slug, CAST(NULL AS VARCHAR) AS tag_id, CAST(NULL AS VARCHAR) AS how
  UNION ALL
  SELECT k, CASE WHEN how = 'new' THEN list_append(made, {{'slug': slug, 'v': v}}) ELSE made END, vec_id, slug, CASE how WHEN 'slug' THEN coalesce(stored, slug) WHEN 'new' THEN slug ELSE alike END, how FROM (
    SELECT *, CASE WHEN stored IS NOT NULL OR list_contains(list_transform(made, lambda m: m.slug), slug) THEN 'slug' WHEN greatest(near_c, best.c) >= {_ALIKE} THEN 'similar' ELSE 'new' END AS how,
      CASE WHEN best.c IS NULL OR near_c >= best.c THEN near_id ELSE best.slug END AS alike
    FROM (SELECT q.*, made, list_sort(list_transform(made, lambda m: {{'c': list_cosine_similarity(m.v, q.v), 'slug': m.slug}}), 'DESC')[1] AS best FROM f JOIN q ON q.k = f.k + 1)))
SELECT vec_id, slug, tag_id, how FROM f WHERE k > 0"""


@query("v4_fold_tags", _FOLD)
def _(t):
    e = t.raw("embeddings")
    stored = e.where("vec_id % 4 = 0").select(F.col("vec_id").alias("id"), F.concat(F.lit("tag-"), (F.col("vec_id") % 450).cast("string")).alias("slug"), "embedding")
    proposals = e.where("vec_id % 4 <> 0").select("vec_id", F.concat(F.lit("Tag "), (F.col("vec_id") % 150).cast("string")).alias("label"), "embedding")
    return G.fold_tags(proposals, "vec_id", stored, _ALIKE).select("vec_id", "slug", "tag_id", "how")


# Entities.


#: New entities by name alone, by an id, and names whose slugs are taken by others: rows of one name and another id get the next free number.
@query("v8_resolve_entity", """WITH n AS (SELECT c_custkey AS row, n_name || ' ' || CAST(c_custkey % 3 AS VARCHAR) AS name, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey * 10 + c_custkey % 3 + 1000 * (c_custkey % 5 % 2) AS VARCHAR) END AS ror, c_nationkey AS k, c_custkey % 3 AS m
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, m = 0 AND k % 2 = 0 AS there FROM n),
g AS (SELECT slug, ror, min(row) AS first FROM s WHERE ror IS NOT NULL AND NOT (there AND ror = CAST(k * 10 AS VARCHAR)) GROUP BY slug, ror),
f AS (SELECT slug, min(row) AS lone FROM s WHERE ror IS NULL AND NOT there GROUP BY slug),
p AS (SELECT g.*, row_number() OVER (PARTITION BY slug ORDER BY first) AS place FROM g),
t AS (SELECT slug, bool_or(there) AS there FROM s GROUP BY slug)
SELECT s.row, CASE WHEN s.ror IS NULL OR (s.there AND s.ror = CAST(k * 10 AS VARCHAR)) THEN s.slug WHEN place = 1 AND NOT s.there THEN s.slug ELSE s.slug || '-' || CAST(place + CASE WHEN s.there THEN 1 ELSE 0 END AS VARCHAR) END AS id
FROM s LEFT JOIN p ON s.slug = p.slug AND s.ror = p.ror""")
def _(t):
    slug = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    name = F.concat("n_name", F.lit(" "))
    old = t.raw("nation").where("n_nationkey % 2 = 0").select(slug(F.concat(name, F.lit("0"))).alias("id"), F.concat(name, F.lit("0")).alias("name"), slug(F.concat(name, F.lit("0"))).alias("slug"), (F.col("n_nationkey") * 10).cast("string").alias("ror"))
    id_ = F.col("c_nationkey") * 10 + F.col("c_custkey") % 3 + 1000 * (F.col("c_custkey") % 5 % 2)
    new = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("row"), F.concat(name, (F.col("c_custkey") % 3).cast("string")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, id_.cast("string")).alias("ror"))
    return E.resolve(new, old, ("ror",))[0]


@query("v9_find_or_create", "WITH n AS (SELECT n_nationkey, replace(lower(n_name), '_', '-') AS slug, n_name AS name FROM nation) SELECT slug, name FROM n WHERE n_nationkey < 10 OR n_nationkey IN (SELECT c_nationkey FROM customer)")
def _(t):
    n = t.raw("nation").select("n_nationkey", T.slugify(F.col("n_name")).alias("slug"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("url"))
    rows = t.raw("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("row"), "name", "url")
    return E.find_or_create(rows, n.where("n_nationkey < 10")).select("slug", "name")


@query("v11_dated_versions", with_sql("ee", "SELECT url AS canonical_url, CAST(created_at AS DATE) AS fetched_on, arg_max(outcome, (created_at, outcome)) AS title, count(*) AS fetches FROM ee GROUP BY 1, 2"))
def _(t):
    return E.dated_versions(t.extraction_events().select(F.col("url").alias("canonical_url"), F.col("created_at").alias("fetched_at"), F.col("outcome").alias("title")))


@query("v12_reconcile_users", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 2 = 0 THEN o_custkey WHEN o_custkey % 2 = 1 THEN o_custkey END AS user_id FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t):
    users = t.raw("customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("@Mail.example")).alias("email"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("h"), F.col("c_custkey").cast("string"))).alias("hanko_id"))
    logins = t.raw("orders").join(t.raw("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("h"), F.col("o_custkey").cast("string"))).alias("hanko_id"), F.lower(F.concat("c_name", F.lit("@mail.example"))).alias("email"))
    return E.reconcile_users(logins, users).select("o_orderkey", "user_id")


@query("v13_link_once", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_linenumber = 1)")
def _(t):
    li = t.raw("lineitem")
    return E.link_once(li, li.where("l_linenumber = 1"), ("l_partkey", "l_suppkey"))


# Scalar functions over whole columns.


@query("f1_slugify", "SELECT p_partkey, trim(regexp_replace(lower(p_type || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def _(t):
    return t.raw("part").select("p_partkey", T.slugify(F.concat_ws(" / ", "p_type", "p_name")).alias("slug"))


_PERSON = "CASE c_custkey % 6 WHEN 0 THEN 'Van ' || m WHEN 1 THEN m || ' Jr' WHEN 2 THEN 'ann ' || m WHEN 3 THEN m ELSE '  Ann  ' || m END"


@query("f2_sort_name", f"SELECT c_custkey, CASE WHEN c_custkey % 6 > 3 THEN m || ', Ann' END AS sort_name FROM (SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || c_custkey AS m, {_PERSON} AS name FROM customer)")
def _(t):
    m = F.concat(F.initcap(F.lower("c_mktsegment")), F.col("c_custkey").cast("string"))
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind = F.col("c_custkey") % 6
    name = F.when(kind == 0, of("Van ", m)).when(kind == 1, of(m, " Jr")).when(kind == 2, of("ann ", m)).when(kind == 3, m).otherwise(of("  Ann  ", m))
    return t.raw("customer").select("c_custkey", T.sort_name(name).alias("sort_name"))


@query("f5_strip_html", r"SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'gs'), '\s+', ' ', 'g')), '') AS text FROM pages")
def _(t):
    return t.raw("pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("f6_count_words", r"SELECT doc_id, n AS words, CAST(ceil(n * 60 / 238) AS BIGINT) AS seconds FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\s\x0B]+')) AS n FROM documents)")
def _(t):
    n = T.count_words(F.col("text")).cast("bigint")
    return t.raw("documents").select("doc_id", n.alias("words"), T.reading_seconds(n).alias("seconds"))


@query("f9_title_tags", "SELECT p_partkey, list_aggregate(list_slice(list_distinct_ordered, 1, 2), 'string_agg', ',') AS tags FROM (SELECT p_partkey, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: len(x) > 2 AND x NOT IN ('the', 'and', 'for', 'with', 'how', 'why', 'what', 'are', 'your', 'you', 'this', 'that', 'from')) AS w FROM part))")
def _(t):
    return t.raw("part").select("p_partkey", F.nullif(F.array_join(T.title_tags(F.col("p_name")), ","), F.lit("")).alias("tags"))


@query("f20_canonicalize", r"SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?]+)$', '\1/') AS url, regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www\.', '') AS host, regexp_extract(url, '^https?://[^/?#]+') AS origin FROM pages")
def _(t):
    u = F.col("url")
    return t.raw("pages").select("page_id", U.canonicalize(u).alias("url"), U.display_host(u).alias("host"), U.origin(u).alias("origin"))


@query("f29_backoff", "SELECT l_orderkey, l_linenumber, CAST(10 * power(2, l_linenumber - 1) AS BIGINT) AS wait, l_linenumber >= 5 AS gives_up FROM lineitem")
def _(t):
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", U.backoff_seconds(F.col("l_linenumber")).alias("wait"), U.gives_up(F.col("l_linenumber")).alias("gives_up"))


@query("f44_abstract", "SELECT p_partkey, p_name AS abstract FROM part")
def _(t):
    placed = t.raw("part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "word")).groupBy("p_partkey", "word").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return placed.groupBy("p_partkey").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("i")).select("p_partkey", N.abstract_text(F.col("i")).alias("abstract"))


@query("f43_pick", with_sql("ee", "SELECT event_id, coalesce(title_source, author_source, 'x') AS value, CASE WHEN title_source IS NOT NULL THEN 'a' WHEN author_source IS NOT NULL THEN 'b' ELSE 'c' END AS source FROM ee"))
def _(t):
    return t.extraction_events().select("event_id", N.pick(("a", F.col("title_source")), ("b", F.col("author_source")), ("c", F.lit("x"))).alias("p")).select("event_id", "p.value", "p.source")


# Pages.


@query("x1_extract_pages")
def _(t):
    out = D.extract_pages(t.raw("pages"))
    return out.select("page_id", F.col("title.value").alias("title"), F.col("title.source").alias("title_source"), F.col("language.value").alias("language"), F.col("site.value").alias("site"), F.col("affiliation.url").alias("site_url"), "word_count", "reading_seconds", F.round("link_density", 6).alias("link_density"), F.round("page_ratio", 6).alias("page_ratio"), "body_confidence")


# Jobs and queue items.


@query("t2_claimable", with_sql("ee", ", j AS (SELECT event_id, event_type AS queue_name, ts AS run_at, user_id % 3 AS s, ts + INTERVAL (user_id % 90) MINUTE AS locked_until FROM events) SELECT event_id AS id, queue_name FROM j WHERE run_at <= TIMESTAMP '2024-01-15' AND (s = 0 OR (s = 1 AND locked_until <= TIMESTAMP '2024-01-15')) QUALIFY row_number() OVER (PARTITION BY queue_name ORDER BY run_at, event_id) <= 5"))
def _(t):
    jobs = t.raw("events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("queue_name"), F.when(F.col("user_id") % 3 == 0, "pending").when(F.col("user_id") % 3 == 1, "running").otherwise("done").alias("state"),
        F.lit(0).alias("attempts"), F.col("ts").alias("run_at"), (F.col("ts") + F.make_dt_interval(mins=(F.col("user_id") % 90).cast("int"))).alias("locked_until"), F.col("ts").alias("created_at"),
    )
    return J.claimable(jobs, F.lit("2024-01-15").cast("timestamp_ntz"), per_queue=5).select("id", "queue_name")


_HOP_URL = "CASE WHEN {0} % 97 = 0 THEN concat('http://10.0.0.', CAST({0} % 250 AS VARCHAR), '/', CAST({0} AS VARCHAR)) ELSE concat('http://h', CAST({0} % 17 AS VARCHAR), '.example/', CAST({0} AS VARCHAR)) END"


@query("s8_redirects", f"""WITH RECURSIVE r AS (SELECT event_id AS n, CASE event_type WHEN 'click' THEN 302 WHEN 'purchase' THEN 301 WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 404 ELSE 503 END ELSE 200 END AS status,
  CASE WHEN event_type IN ('click', 'purchase') THEN (event_id * 31 + 7) % 12000 END AS nxt, CASE WHEN user_id % 5 = 0 THEN 'image/png' ELSE 'text/html' END AS kind FROM events),
c AS (SELECT n AS n0, n AS cur, 0 AS redirects FROM r UNION ALL SELECT n0, nxt, redirects + 1 FROM c JOIN r ON cur = n WHERE nxt IS NOT NULL AND redirects <= 5 AND cur % 97 <> 0),
l AS (SELECT n0, max(redirects) AS redirects, arg_max(cur, redirects) AS cur FROM c GROUP BY n0),
e AS (SELECT l.*, status, CASE WHEN redirects > 5 THEN 'too-many-redirects' WHEN cur % 97 = 0 THEN 'blocked-url' WHEN status IS NULL THEN 'network' WHEN status >= 300 THEN 'http-status' WHEN kind <> 'text/html' THEN 'not-html' END AS error_class FROM l LEFT JOIN r ON cur = n)
SELECT {_HOP_URL.format("n0")} AS url, CASE WHEN redirects <= 5 THEN {_HOP_URL.format("cur")} END AS final_url, redirects, CASE WHEN error_class IS NULL OR error_class IN ('http-status', 'not-html') THEN status END AS status, error_class,
  coalesce(error_class = 'network' OR (error_class = 'http-status' AND status >= 500), false) AS retryable FROM e""")
def _(t):
    named = lambda n: F.expr(_HOP_URL.format(n).replace("VARCHAR", "STRING"))
    e = t.raw("events").withColumn("to", (F.col("event_id") * 31 + 7) % 12000)
    on = F.col("event_type").isin("click", "purchase")
    status = F.when(F.col("event_type") == "click", 302).when(F.col("event_type") == "purchase", 301).when(F.col("event_type") == "error", F.when(F.col("user_id") % 2 == 0, 404).otherwise(503)).otherwise(200)
    path = F.when(F.col("to") % 97 == 0, named("to")).when(F.col("to") % 17 == F.col("event_id") % 17, F.when(F.col("event_id") % 97 == 0, named("to")).otherwise(F.concat(F.lit("./x/../"), "to"))).otherwise(named("to"))
    replies = e.select(named("event_id").alias("url"), status.alias("status"), F.when(on, path).alias("location"), F.when(F.col("user_id") % 5 == 0, "image/png").otherwise("text/html").alias("content_type"))
    return H.follow(replies.select("url"), replies)


_LEASE_DAYS = 30
#: The end of each job of ``_sale_messages`` in closed form: claims come every lease, and an outcome counts if it is of the attempt that runs.
_SALE_JOBS = f"""WITH m AS (SELECT sale_id AS id, epoch_us(sold_at) AS s, CASE WHEN status IN ('done', 'held') THEN epoch_us(arrived_at) + 3600000000 END AS a, CASE WHEN priority = 5 THEN 2 ELSE 1 END AS attempt, status = 'done' AS ok, coalesce(priority = 1, false) AS fatal, {_LEASE_DAYS} * 86400000000 AS lease FROM sales WHERE sale_id IS NOT NULL),
h AS (SELECT greatest(max(s), max(a)) // 1000 * 1000 AS h FROM m),
e AS (SELECT *, coalesce(a >= s AND a <= h AND attempt = (a - s) // lease + 1, false) AS hit, a + 10000000 * CAST(pow(2, attempt - 1) AS BIGINT) AS again FROM m, h WHERE s <= h)
SELECT id, CASE WHEN hit AND ok THEN 'done' WHEN hit AND fatal THEN 'failed' WHEN hit AND again > h THEN 'pending' ELSE 'running' END AS state,
  CAST(CASE WHEN hit AND (ok OR fatal OR again > h) THEN attempt WHEN hit THEN attempt + (h - again) // lease + 1 ELSE (h - s) // lease + 1 END AS INT) AS attempts FROM e"""


def _sale_messages(t):
    """A job for each sale, due when it is sold; of closed and held ones an outcome comes an hour after the sale's row, of some for an attempt that is not there."""
    sales = t.raw("sales").where("sale_id is not null")
    none = lambda kind: F.lit(None).cast(kind)
    new = sales.select(F.col("sale_id").alias("id"), F.col("sold_at").alias("at"), F.lit("enqueue").alias("what"), F.lit("sales").alias("queue_name"), F.col("status").alias("payload"), none("int").alias("attempts"), none("boolean").alias("ok"), none("boolean").alias("fatal"), none("string").alias("error_class"))
    told = sales.where("status in ('done', 'held')").select(
        F.col("sale_id").alias("id"), (F.col("arrived_at") + F.make_dt_interval(hours=F.lit(1))).alias("at"), F.lit("settle").alias("what"), none("string").alias("queue_name"), none("string").alias("payload"),
        F.when(F.col("priority") == 5, 2).otherwise(1).alias("attempts"), (F.col("status") == "done").alias("ok"), F.coalesce(F.col("priority") == 1, F.lit(False)).alias("fatal"), F.lit("held").alias("error_class"),
    )
    return new.unionByName(told)


@query("t2_job_history", _SALE_JOBS)
def _(t):
    messages = _sale_messages(t)
    end = messages.agg(F.date_trunc("millisecond", F.max("at"))).first()[0]
    return M.last_states(M.job_history(messages, F.lit(end), _LEASE_DAYS * 86400))


@query("t3_job_stream", _SALE_JOBS)
def _(t):
    folder = scratch(t.spark, "job-stream")
    t = Tables(t.spark, t.folder)
    t.raw = lambda name: R.read_stream(t.spark, t.folder, name)
    return M.last_states(M.drained(M.stream_jobs(_sale_messages(t), _LEASE_DAYS * 86400, "0 seconds"), folder))


@query("t9_queue_state", """SELECT id, nullif(list_reduce(list_prepend('none', list(a ORDER BY event_id)), lambda s, a: CASE WHEN a = 'enqueue' THEN 'unread' WHEN a = 'archive' AND s <> 'none' THEN 'archived' WHEN a = 'start' AND s = 'unread' THEN 'reading' WHEN a = 'finish' AND s NOT IN ('none', 'archived') THEN 'read' WHEN a = 'unread' AND s NOT IN ('none', 'archived') THEN 'unread' ELSE s END), 'none') AS state
FROM (SELECT user_id AS id, event_id, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'archive' ELSE 'unread' END AS a FROM events) GROUP BY id""")
def _(t):
    actions = t.raw("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "archive").otherwise("unread").alias("action"))
    return J.item_states(actions)


@query("t9_item_stream", """SELECT id, nullif(list_reduce(list_prepend('none', list(a ORDER BY ts, a)), lambda s, a: CASE WHEN a = 'enqueue' THEN 'unread' WHEN a = 'archive' AND s <> 'none' THEN 'archived' WHEN a = 'start' AND s = 'unread' THEN 'reading' WHEN a = 'finish' AND s NOT IN ('none', 'archived') THEN 'read' WHEN a = 'unread' AND s NOT IN ('none', 'archived') THEN 'unread' ELSE s END), 'none') AS state
FROM (SELECT user_id AS id, ts, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'archive' ELSE 'unread' END AS a FROM events WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) FROM events)) GROUP BY id""")
def _(t):
    e = R.read_stream(t.spark, t.folder, "events")
    actions = e.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "archive").otherwise("unread").alias("action"))
    updates = M.drained(M.stream_item_states(actions, "0 seconds"), scratch(t.spark, "item-stream"))
    return updates.groupBy("id").agg(F.max_by("state", "batch").alias("state"))


@query("t5_idempotent_ingest", "SELECT user_id AS message_id, min(event_id) AS event_id FROM events WHERE user_id % 10 <> 0 GROUP BY user_id UNION ALL SELECT NULL, event_id FROM events WHERE user_id % 10 = 0")
def _(t):
    mails = t.raw("events").select(F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("message_id"), "event_id")
    return J.once_by_message(mails, "event_id")


@query("t6_newest_version", with_sql("ee", "SELECT url, arg_max(event_id, (word_count, event_id)) AS event_id, max(word_count) AS extraction_version FROM ee GROUP BY url"))
def _(t):
    e = t.extraction_events().select("url", "event_id", F.col("word_count").alias("extraction_version"))
    return J.newest_version(e, "url", "event_id")


@query("t10_ingest_status", with_sql("ee", "SELECT url, CASE arg_max(outcome, (created_at, event_id)) WHEN 'failed' THEN 'failed' ELSE 'done' END AS status FROM ee GROUP BY url"))
def _(t):
    e = t.extraction_events()
    jobs = e.select("url", F.col("outcome").alias("state"), "created_at", F.col("event_id").alias("id"))
    return J.ingest_status(e.select("url").distinct(), jobs)


@query("t11_stale_work", with_sql("articles", "SELECT id FROM articles WHERE id % 3 <> 0 AND id % 2 <> 0 ORDER BY id LIMIT 40"))
def _(t):
    stale = t.articles().where("id % 3 <> 0").select("id", F.col("id").alias("age"))
    live = t.articles().where("id % 2 = 0").select(F.to_json(F.struct("id")).alias("payload"), F.lit("pending").alias("state"))
    return J.stale_work(stale, live, 40).select("id")


@query("t12_fresh", with_sql("ee", "SELECT event_id FROM ee WHERE abs(epoch(TIMESTAMP '2024-01-15') - epoch(created_at)) < 3600 * 12"))
def _(t):
    e = t.extraction_events().withColumn("at", F.col("created_at").cast("timestamp"))
    return e.where(U.is_fresh(F.lit("2024-01-15").cast("timestamp"), F.col("at"), 3600 * 12, whole=False)).select("event_id")


@query("p1_projection", "SELECT c_custkey AS id, c_name AS name FROM customer")
def _(t):
    return t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("p4_owner_scope", with_sql("queue", "SELECT id, state FROM queue WHERE user_id = 7"))
def _(t):
    return B.owned_by(t.queue_items(), 7).select("id", "state")


@query("p5_not_archived", with_sql("queue", "SELECT id, state FROM queue WHERE state <> 'archived'"))
def _(t):
    return B.not_archived(t.queue_items()).select("id", "state")


@query("p6_browsable", with_sql("items", "SELECT type, id FROM items WHERE type IN ('article', 'paper')"))
def _(t):
    return C.browsable(C.normalise(t.articles(), t.papers(), t.issues())).select("type", "id")


@query("p10_venue_type", "SELECT doc_id, CASE source WHEN 'src1' THEN 'other' ELSE CASE lang WHEN 'en' THEN 'preprint' WHEN 'de' THEN 'journal' ELSE 'other' END END AS venue FROM documents")
def _(t):
    kind = F.when(F.col("source") == "src1", "ebook platform").when(F.col("lang") == "en", "repository").when(F.col("lang") == "de", "book series").otherwise("novel")
    return t.raw("documents").select("doc_id", T.venue_type(kind).alias("venue"))


@query("j1_source", with_sql("items", "SELECT type, id, n_name AS source FROM items LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = source_id"))
def _(t):
    return C.with_source(C.normalise(t.articles(), t.papers(), t.issues()), t.sources()).select("type", "id", F.col("source.name").alias("source"))


@query("j16_titles", with_sql("te articles", "SELECT te.event_id, title FROM te LEFT JOIN articles ON CAST(id AS VARCHAR) = te.readable_id"))
def _(t):
    names = C.titles(t.articles(), t.papers(), t.issues())
    return t.tagging_events().join(names, ["readable_type", "readable_id"], "left").select("event_id", "title")


@query("j5_overrides", with_sql("ov tags", "SELECT queue_item_id, string_agg(op || ':' || label, ',' ORDER BY label) AS overrides FROM ov JOIN tags ON id = tag_id GROUP BY 1"))
def _(t):
    rows = t.overrides().join(t.tags(), F.col("tag_id") == F.col("id"))
    return rows.groupBy("queue_item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "op"))), lambda x: F.concat(x["op"], F.lit(":"), x["label"])), ",").alias("overrides"))


@query("j12_unlabelled", with_sql("te el", "SELECT DISTINCT te.readable_id FROM te LEFT JOIN el ON feature = 'tagging' AND el.readable_id = te.readable_id WHERE feature IS NULL"))
def _(t):
    return t.tagging_events().join(t.labels().where("feature = 'tagging'").select("readable_type", "readable_id"), ["readable_type", "readable_id"], "left_anti").select("readable_id").distinct()


@query("w1_create", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def _(t):
    return K.create(t.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), t.raw("region").select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name")))


@query("a9_percentage", with_sql("ee", "SELECT domain, round(100 * count(*) FILTER (outcome = 'failed') / count(*)) AS failed_percent FROM ee GROUP BY domain"))
def _(t):
    return t.extraction_events().groupBy("domain").agg(A.percentage(F.count_if(F.col("outcome") == "failed"), F.count("*")).alias("failed_percent"))


@query("a19_mean_confidence", "SELECT event_id, CASE WHEN event_type = 'view' THEN 0.5 ELSE (0.9 + 0.5) / 2 END AS overall FROM events")
def _(t):
    return t.raw("events").select("event_id", N.mean_confidence(F.when(F.col("event_type") != "view", 0.9), F.array(F.lit(0.5), F.lit(None).cast("double"))).alias("overall"))


@query("f3_byline", "SELECT o_orderkey, unnest(['Ann' || o_custkey, 'Bo', 'Cy Poe']) AS name FROM orders")
def _(t):
    return t.raw("orders").select("o_orderkey", F.explode(T.split_byline(F.concat(F.lit("By Ann"), F.col("o_custkey").cast("string"), F.lit(", Bo & Cy Poe")))).alias("name"))


@query("f7_clamp", "SELECT p_partkey, left(lower(trim(p_name)), 60) AS label, greatest(0.0, least(1.0, p_size / 25)) AS confidence FROM part")
def _(t):
    return t.raw("part").select("p_partkey", T.clamp_label(F.col("p_name")).alias("label"), T.clamp_confidence(F.col("p_size") / 25).alias("confidence"))


@query("f8_document_text", "SELECT p_partkey, left(concat_ws(chr(10) || chr(10), p_name, CASE WHEN p_size > 10 THEN p_type END), 2000) AS text FROM part")
def _(t):
    return t.raw("part").select("p_partkey", T.document_text(F.col("p_name"), F.lit(None).cast("string"), F.when(F.col("p_size") > 10, F.col("p_type"))).alias("text"))


@query("f10_forward_subject", "SELECT p_partkey, p_size % 2 = 0 AS is_forward, p_name AS subject FROM part")
def _(t):
    subject = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Fwd: TR : "), "p_name")).otherwise(F.col("p_name"))
    return t.raw("part").select("p_partkey", T.is_forward_subject(subject).alias("is_forward"), T.strip_forward(subject).alias("subject"))


@query("f11_mail_names", "SELECT c_custkey, '@mail.' || lower(c_mktsegment) || '.org' AS alias, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS site FROM customer")
def _(t):
    address = F.concat(F.lit("x@mail."), F.lower("c_mktsegment"), F.lit(".org"))
    return t.raw("customer").select("c_custkey", T.domain_alias(address).alias("alias"), T.site_name(address).alias("site"))


@query("f13_plain_html", "SELECT p_partkey, '<p>' || p_name || '</p><p>' || p_type || '<br>&lt;' || p_size || '</p>' AS html FROM part")
def _(t):
    return t.raw("part").select("p_partkey", T.plain_to_html(F.concat("p_name", F.lit("\n\n"), "p_type", F.lit("\n<"), F.col("p_size").cast("string"))).alias("html"))


@query("f15_csv_set", "SELECT r_regionkey, unnest([lower(r_name), 'x']) AS member FROM region")
def _(t):
    return t.raw("region").select("r_regionkey", F.explode(T.csv_set(F.concat(F.lower("r_name"), F.lit(" , x,,"), F.lower("r_name")))).alias("member"))


@query("f23_detect_paper", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'arxiv' ELSE 'doi' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN '2401.' || lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') ELSE '10.1234/ab' || o_custkey END AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'https://arxiv.org/abs/2401.' || lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') ELSE 'https://doi.org/10.1234/ab' || o_custkey END AS url FROM orders")
def _(t):
    number = F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("https://arxiv.org/abs/2401."), number, F.lit("v3"))).otherwise(F.concat(F.lit("see DOI:10.1234/AB"), F.col("o_custkey").cast("string")))
    found = t.raw("orders").select("o_orderkey", U.detect_paper(raw).alias("p"))
    return found.select("o_orderkey", "p.kind", "p.id", U.paper_url(F.col("p.kind"), F.col("p.id")).alias("url"))


@query("f24_work_url", "SELECT o_orderkey, 'https://api.openalex.org/works/doi:' || CASE WHEN o_orderkey % 2 = 0 THEN '10.48550/arxiv.2401.' || lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') ELSE '10.1234/a%20b%3F' || o_custkey || '(x)' END AS url FROM orders")
def _(t):
    even = F.col("o_orderkey") % 2 == 0
    id_ = F.when(even, F.concat(F.lit("2401."), F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0"))).otherwise(F.concat(F.lit("10.1234/a b?"), F.col("o_custkey").cast("string"), F.lit("(x)")))
    return t.raw("orders").select("o_orderkey", U.work_url(F.when(even, "arxiv").otherwise("doi"), id_).alias("url"))


@query("f25_parse_temporal", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def _(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T23:30:00Z"))).otherwise(F.concat(F.lit("on "), day))
    return t.raw("orders").select("o_orderkey", F.to_date(U.parse_temporal(raw)).alias("day"))


@query("f27_iso_day", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(t):
    return t.raw("orders").select("o_orderkey", U.iso_day(F.col("o_orderdate")).alias("day"))


@query("f47_model_tags", "SELECT p_partkey, unnest([lower(p_brand), 'x']) AS label, unnest([least(1.0, p_size / 25), 1.0]) AS confidence FROM part")
def _(t):
    reply = F.concat(F.lit('Sure: {"tags": [{"label": " '), F.col("p_brand"), F.lit('", "confidence": '), (F.col("p_size") / 25).cast("string"), F.lit('}, {"label": "X"}, {"label": ""}]} done'))
    return t.raw("part").select("p_partkey", F.explode(N.model_tags(reply)).alias("t")).select("p_partkey", "t.label", "t.confidence")


@query("f51_json", "SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS payload FROM region")
def _(t):
    return t.raw("region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("payload"))


@query("x5_body_confidence", "SELECT doc_id, CAST(CASE WHEN n < 50 THEN 0.2 WHEN n % 10 > 5 THEN 0.3 WHEN n % 7 = 0 THEN 0.4 WHEN n < 120 THEN 0.6 ELSE 0.85 END AS DOUBLE) AS confidence FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM documents)")
def _(t):
    n = T.count_words(F.col("text"))
    return t.raw("documents").select("doc_id", D.body_confidence(n, F.when(n % 10 > 5, 0.6).otherwise(0.1), F.when(n % 7 == 0, 0.99).otherwise(0.5)).alias("confidence"))


@query("x14_content_for", with_sql("articles", "SELECT 'article' AS readable_type, CAST(id AS VARCHAR) AS readable_id, title, left(concat_ws(chr(10) || chr(10), title, body_html), 2000) AS text FROM articles UNION ALL SELECT 'paper', CAST(s_suppkey AS VARCHAR), s_name, s_name FROM supplier UNION ALL SELECT 'newsletter', CAST(c_custkey AS VARCHAR), c_name, c_name FROM customer"))
def _(t):
    return B.content_for(t.articles(), t.papers(), t.issues()).select("readable_type", "readable_id", "title", "text")


@query("x11_content_view", with_sql("articles", "SELECT id, title, canonical_url AS link, '2024-01-02' AS day, coalesce(body_html, '<p>No text is available here.</p>') AS body FROM articles"))
def _(t):
    return B.content_view(t.articles().select(F.lit("article").alias("type"), "id", "title", F.col("canonical_url").alias("url"), F.lit("2024-01-02").cast("timestamp").alias("published"), "body_html")).select("id", "title", "link", "day", "body")


@query("x13_extraction_event")
def _(t):
    now = F.lit("2024-01-02 00:00:01").cast("timestamp")
    return B.extraction_event(D.extract_pages(t.raw("pages")), F.lit("2024-01-02").cast("timestamp"), now, now)


@query("v10_resolve_senders", "SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN c_nationkey END AS source_id FROM customer")
def _(t):
    host = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".example"))
    mails = t.raw("customer").select("c_custkey", F.concat(F.lit("X@"), host).alias("from_email"))
    sources = t.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    aliases = t.raw("nation").where("n_nationkey < 10").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "x@").otherwise("@"), F.lit("N"), F.col("n_nationkey").cast("string"), F.lit(".example")).alias("alias"), F.col("n_nationkey").alias("affiliation_id"))
    return E.resolve_senders(mails, sources, aliases).select("c_custkey", "source_id")


@query("flagship", with_sql("items lines rt tags", ", b AS (SELECT readable_type, readable_id, avg(confidence) AS c, count(*) AS k FROM rt JOIN tags ON id = tag_id GROUP BY ALL) SELECT n_name AS source, count(*) AS readables, CAST(sum(coalesce(n, 0)) AS BIGINT) AS bylines, CAST(sum(coalesce(k, 0)) AS BIGINT) AS tags, round(avg(c), 6) AS confidence FROM items i LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = source_id LEFT JOIN lines ON of_type = type AND of_id = i.id LEFT JOIN b ON b.readable_type = type AND b.readable_id = i.id GROUP BY 1"))
def flagship(t):
    """Per source: readables, authors in their bylines, tags and their confidence."""
    b = t.readable_tags().groupBy("readable_type", "readable_id").agg(F.avg("confidence").alias("c"), F.count("*").alias("k"))
    rows = t.catalog().join(b, (F.col("type") == F.col("readable_type")) & (F.col("id") == F.col("readable_id")), "left")
    return rows.groupBy(F.col("source.name").alias("source")).agg(F.count("*").alias("readables"), F.sum(F.size("authors")).alias("bylines"), F.sum(F.coalesce("k", F.lit(0))).alias("tags"), F.round(F.avg("c"), 6).alias("confidence"))


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return flagship(Tables(spark, folder))


