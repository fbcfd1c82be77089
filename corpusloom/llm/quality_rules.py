"""Quality rules from line frequency across documents, in DataFrame functions alone.

Each document's lines are normalised and hashed; a line is too frequent in a host when it occurs in more
distinct documents of the host than the limit allows, whatever the size of the host. Such lines are removed, and a document that they
leave too little of is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP_PATTERN, WORD_SEPARATORS, materialize, table, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A line goes when more documents of its host have it than this number.
LINE_DOCS = 10
#: A document is depleted when less than this percentage of its words is left.
LEAST_LEFT = 30


def _windows(name: str) -> Column:
    """From the column ``name`` of word hashes: (hash, place) of each 3-word window, sorted by hash.

    What a lambda reads has to be a column, not an expression, or Spark computes it anew for each element.
    """
    at = lambda i: F.get(F.col(name), i)
    last = F.size(name) - 3
    return F.when(
        last >= 1,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i")))),
    )


def _covered(name: str) -> Column:
    """From the column ``name`` of sorted (hash, place) windows: the places of repeated ones, in order."""
    return F.expr(f"sort_array(transform(filter({name}, (x, k) -> x.h = get({name}, k - 1).h OR x.h = get({name}, k + 1).h), x -> x.i))")


def _plain(line: Column) -> Column:
    """A line in lower case, trimmed, with single spaces; most lines have no other white space, which a search tells."""
    trimmed = F.btrim(line, F.lit(WORD_SEPARATORS))
    return F.lower(F.when(line.contains("  ") | line.rlike(r"[\x09-\x0D]"), F.regexp_replace(trimmed, GAP_PATTERN, " ")).otherwise(trimmed))


def line_profile(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source, ...) -> doc_id, source, the base counts, and lines: array of (h, n), n words in a line with hash h."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", F.col("source").alias("host"), text.alias("body"), words(F.col("text")).alias("tokens"))
    out = out.withColumn("hashes", F.transform("tokens", lambda w: F.xxhash64(w))).withColumn("windows", _windows("hashes")).withColumn("places", F.coalesce(_covered("windows"), F.array().cast("array<int>")))
    out = out.withColumn("with_words", F.filter(F.split("body", "\n"), lambda x: F.translate(x, WORD_SEPARATORS, "") != ""))
    with_words = F.col("with_words")
    return out.select(
        "doc_id",
        "host",
        F.xxhash64("body").alias("text_hash"),
        F.size("tokens").cast("long").alias("n_words"),
        F.length(F.translate("body", WORD_SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(with_words) - F.size(F.array_distinct(with_words))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(places) = 0 THEN 0L ELSE 3L + aggregate(sequence(1, size(places)), 0L, (a, k) -> a + if(k = size(places), 0, least(3, get(places, k) - get(places, k - 1)))) END").alias("n_repeat_words"),
        F.transform(F.transform(with_words, _plain), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))).alias("lines"),
    )


def _frequent_lines(profile: DataFrame, line_docs: int, line_share: int | None) -> DataFrame:
    """row, h, n: the lines of each row that are too frequent in its host."""
    seen = profile.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x.h))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("line_docs")).where(F.col("line_docs") > line_docs)
    if line_share:
        hosts = profile.groupBy("host").agg(F.count("*").alias("host_docs")).withColumnRenamed("host", "of_host")
        seen = seen.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).where(F.col("line_docs") * line_share > F.col("host_docs"))
    frequent = materialize(seen.select(F.col("host").alias("of_host"), F.col("h").alias("of_h")), "frequent-lines")
    lines = profile.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.n")
    return lines.join(frequent, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("h") == F.col("of_h"))).select("row", "h", "n")


def _base_failed(min_words: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _words_left() -> Column:
    return F.col("n_words") - F.coalesce("n_frequent_words", F.lit(0))


def _kept(min_words: int, least_left: int) -> Column:
    return ~_base_failed(min_words) & (100 * _words_left() >= least_left * F.col("n_words"))


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, line_docs: int = LINE_DOCS, line_share: int | None = None, least_left: int = LEAST_LEFT) -> DataFrame:
    """(doc_id, text, source, ...) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_frequent_lines, n_words_left, kept; a row for each row.

    A null text counts as empty and fails by its number of words. A null source is a host of its own.
    Repeated rows are documents of their own, each with its place in the counts. Extra columns are not
    looked at. An empty table gives an empty result. Equal lines after trimming, joining white space and
    lower-casing count as one line. A ``line_share`` asks besides that more than one in so many documents of the
    host have the line.

    A hot host is many lines, each counted by partial sums; a line that a third of all documents have costs
    each map task one row of counts. Frequent lines are joined, broadcast only where their measured size allows.
    """
    profile = materialize(line_profile(docs).withColumn("row", F.monotonically_increasing_id()), "line-profile")
    removed = _frequent_lines(profile, line_docs, line_share).groupBy("row").agg(F.count("*").alias("n_frequent_lines"), F.sum("n").alias("n_frequent_words"))
    return (
        profile.drop("lines")
        .join(removed, "row", "left")
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            _base_failed(min_words).alias("base_failed"),
            F.coalesce("n_frequent_lines", F.lit(0)).cast("long").alias("n_frequent_lines"),
            _words_left().cast("long").alias("n_words_left"),
            _kept(min_words, least_left).alias("kept"),
        )
    )


def without_frequent_lines(docs: DataFrame, min_words: int = MIN_WORDS, line_docs: int = LINE_DOCS, line_share: int | None = None, least_left: int = LEAST_LEFT) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with the frequent lines taken out of their texts.

    Repeated rows, of equal id, source and text, have equal verdicts and all stay or go. Lines without words stay.
    """
    key = [F.col("doc_id").alias("own_id"), F.col("source").alias("own_host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash")]
    profile = materialize(line_profile(docs).withColumn("row", F.monotonically_increasing_id()), "line-profile")
    removed = _frequent_lines(profile, line_docs, line_share).groupBy("row").agg(F.collect_set("h").alias("drop"), F.sum("n").alias("n_frequent_words"))
    judged = profile.drop("lines").join(removed, "row", "left").where(_kept(min_words, least_left)).select("doc_id", "host", "text_hash", "drop").dropDuplicates(["doc_id", "host", "text_hash"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), *key)
    joined = rows.join(judged, F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_host").eqNullSafe(F.col("host")) & (F.col("own_hash") == F.col("text_hash")))
    left = F.array_join(F.filter(F.split("whole.text", "\n"), lambda x: ~F.array_contains("drop", F.xxhash64(_plain(x)))), "\n")
    text = F.when(F.col("drop").isNull(), F.col("whole.text")).otherwise(left)
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"whole.`{c}`").alias(c) for c in docs.columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS t FROM d),
win AS (SELECT rid, i, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS g FROM (SELECT rid, t, unnest(range(1, len(t) - 1)) AS i FROM w WHERE len(t) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS c FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
l AS (SELECT rid, source, x, lower(regexp_replace(trim(x, E' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+', ' ', 'g')) AS y
      FROM (SELECT rid, source, unnest(string_split(body, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT x) AS c FROM l GROUP BY rid),
f AS (SELECT source, y FROM l GROUP BY source, y HAVING count(DISTINCT rid) > 10),
rem AS (SELECT l.rid, count(*) AS nl, sum(len(regexp_extract_all(l.y, '[^\x20\x09-\x0D]+'))) AS nw FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.y = f.y GROUP BY l.rid),
o AS (SELECT w.doc_id, CAST(len(w.t) AS BIGINT) AS n_words, CAST(length(regexp_replace(w.body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(w.body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.c, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.c, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(rem.nl, 0) AS BIGINT) AS n_frequent_lines,
             CAST(len(w.t) - coalesce(rem.nw, 0) AS BIGINT) AS n_words_left
      FROM w LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rem USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_frequent_lines, n_words_left,
       NOT base_failed AND 100 * n_words_left >= 30 * n_words AS kept FROM b
"""
