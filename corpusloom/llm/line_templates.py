"""Line dedup by a log-template tree, in DataFrame functions alone.

Lines go down a tree of fixed depth: by their number of tokens, then by their leading tokens, where tokens that
hold a digit, an at sign or a scheme stand for any value. Inside a leaf a token stays where documents
enough have it at its place and becomes a variable field else. Lines with the same template are one; a template
that documents enough have, and that is constant enough, is dropped from all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP_PATTERN, Marks, discard, free_name, materialize, table

LEADING_TOKENS = 3
MIN_TOKENS = 1
#: Documents that make a template recurring, and a token constant.
MIN_DOCS = 3
#: The percentage of a template's tokens that must be constant.
CONSTANT = 70
ANY = "<*>"
#: A token with such a value in it; only starts of tokens are tried.
_VARIABLE = r"(?<![^ ])(?=[^ ]*(?:[0-9@]|://))[^ ]+"


def masked_lines(raw: Column, words_only: bool = False) -> Column:
    """Each line's tokens with single spaces between, variable fields masked; empty for a line without words.

    With ``words_only``, a line of nothing but variable fields stays as it is, so that only its own copies equal it.
    Most lines need no replacement, which a search is enough to tell. One transform follows another, since an
    expression that a lambda names twice is worked out twice.
    """
    plain = F.transform(raw, lambda x: F.btrim(F.when(x.contains("  ") | x.rlike(r"[\x09-\x0D]"), F.regexp_replace(x, GAP_PATTERN, " ")).otherwise(x)))
    masked = lambda x: F.when(x.contains("://") | x.rlike("[0-9@]"), F.regexp_replace(x, _VARIABLE, ANY)).otherwise(x)
    if not words_only:
        return F.transform(plain, masked)
    both = F.transform(plain, lambda x: F.struct(x.alias("x"), masked(x).alias("m")))
    return F.transform(both, lambda b: F.when(b["m"].startswith(ANY) & (F.btrim(F.replace(b["m"], F.lit(ANY), F.lit(""))) == ""), b["x"]).otherwise(b["m"]))


def _size(m: Column) -> Column:
    return F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1


def _leaf(m: Column, leading: int) -> Column:
    return F.xxhash64(_size(m), F.substring_index(m, " ", leading))


def _key(df: DataFrame) -> list[Column]:
    return [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def line_index(docs: DataFrame, leading: int, words_only: bool = False) -> DataFrame:
    """doc_id, text_hash, n_chars and lines: array of (line, leaf, chars, tokens), line a hash of the masked line."""
    lines = docs.select(*_key(docs), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars_all"), F.split(F.coalesce("text", F.lit("")), "\n").alias("raw"))
    lines = lines.withColumn("m", masked_lines(F.col("raw"), words_only))
    pairs = F.filter(F.arrays_zip("raw", "m"), lambda x: x["m"] != "")
    return lines.select("doc_id", "text_hash", "chars_all", F.transform(pairs, lambda x: F.struct(F.xxhash64(x["m"]).alias("line"), _leaf(x["m"], leading).alias("leaf"), F.length(x["raw"]).alias("chars"), _size(x["m"]).alias("tokens"))).alias("lines"))


def _each_once(index: DataFrame) -> DataFrame:
    """The index with one row for each id and text. Repeated rows are few: only what a filter of bounded size marks is shuffled."""
    keyed = index.withColumn("key", F.xxhash64("doc_id", "text_hash"))
    repeated = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated-rows")
    if repeated.isEmpty():
        return index
    maybe, others = Marks(repeated).split(keyed, "key")
    return others.unionByName(maybe.dropDuplicates(["doc_id", "text_hash"])).drop("key")


def recurring_lines(docs: DataFrame, index: DataFrame, leading: int, min_docs: int, constant: int, min_tokens: int, words_only: bool = False) -> DataFrame:
    """line: hashes of the masked lines whose template recurs.

    Leaves of too few documents go first, by hashes and partial counts; only the others' lines are looked at as
    texts, each different one once, so tokens are spread out for a small part of the corpus. A line or leaf that
    a third of all documents have costs each map task one row.
    """
    once = _each_once(index).select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["leaf"].alias("leaf"), x["tokens"].alias("tokens"))))).alias("x"))
    once = once.select("doc_id", "text_hash", "x.*").where(F.col("tokens") >= min_tokens)
    by_line = materialize(once.groupBy("line", "leaf").agg(F.count("*").alias("docs")), "line-docs")
    # a document may have several lines of one leaf, so this bound is not below the number of documents
    leaves = by_line.groupBy(F.col("leaf").alias("of_leaf")).agg(F.sum("docs").alias("leaf_docs")).where(F.col("leaf_docs") >= min_docs).select("of_leaf")
    wanted = materialize(by_line.join(leaves, F.col("leaf") == F.col("of_leaf"), "left_semi"), "open-lines")

    texts = docs.select(F.explode(masked_lines(F.split("text", "\n"), words_only)).alias("m")).where(F.col("m") != "").select(F.xxhash64("m").alias("seen"), "m")
    texts, _ = Marks(wanted.select("line")).split(texts, "seen")  # a few lines more than wanted, which the next join leaves out
    texts = texts.groupBy(F.col("seen").alias("line")).agg(F.first("m").alias("m"))
    tokens = wanted.join(texts, "line").select("line", "leaf", "docs", F.posexplode(F.split("m", " ")).alias("place", "token"))
    tokens = materialize(tokens, "line-tokens")
    frequent = tokens.where(F.col("token") != ANY).groupBy(F.col("leaf").alias("l"), F.col("place").alias("p"), F.col("token").alias("t")).agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs)
    kept = tokens.join(frequent, (F.col("leaf") == F.col("l")) & (F.col("place") == F.col("p")) & (F.col("token") == F.col("t")), "left")
    field = F.coalesce("t", F.lit(ANY))
    template = kept.groupBy("line", "leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", field.alias("f")))), lambda x: x["f"]), " ").alias("template"), F.count("t").alias("constants"), F.count("*").alias("size"), F.count_if(F.col("token") == ANY).alias("fields"))
    of = F.col("size") - F.col("fields") if words_only else F.col("size")
    template = materialize(template.where((F.col("constants") > 0) & (100 * F.col("constants") >= constant * of)).select(F.col("line").alias("of_line"), F.xxhash64("leaf", "template").alias("template")), "line-templates")
    often = once.join(template, F.col("line") == F.col("of_line")).select("template", "doc_id", "text_hash").distinct().groupBy(F.col("template").alias("of")).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    found = materialize(template.join(often, F.col("template") == F.col("of"), "left_semi").select(F.col("of_line").alias("line")), "recurring-lines")
    for t in (tokens, template, wanted, by_line):
        discard(t)
    return found


def line_templates(docs: DataFrame, leading: int = LEADING_TOKENS, min_docs: int = MIN_DOCS, constant: int = CONSTANT, min_tokens: int = MIN_TOKENS, words_only: bool = True) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_lines, n_dropped, n_chars, n_chars_left, a row for each row.

    n_lines counts lines with a word; n_chars_left is the text's length without the dropped lines and their line
    ends. Null and empty texts have no line. Repeated rows, of equal id and text, count as one document and have
    equal results. Extra columns are not looked at. An empty table gives an empty result.
    """
    index = materialize(line_index(docs, leading, words_only), "line-index")
    gone = recurring_lines(docs, index, leading, min_docs, constant, min_tokens, words_only)
    numbered = materialize(index.withColumn("row", F.monotonically_increasing_id()), "line-rows")
    hits = numbered.select("row", F.explode("lines").alias("x")).select("row", "x.line", "x.chars").join(gone.withColumnRenamed("line", "gone"), F.col("line") == F.col("gone")).groupBy("row").agg(F.count("*").alias("n"), F.sum(F.col("chars") + 1).alias("c"))
    left = F.greatest(F.lit(0), F.col("chars_all") - F.coalesce("c", F.lit(0)))
    return numbered.join(hits, "row", "left").select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n", F.lit(0)).cast("long").alias("n_dropped"), F.col("chars_all").alias("n_chars"), left.cast("long").alias("n_chars_left"))


def without_templates(docs: DataFrame, leading: int = LEADING_TOKENS, min_docs: int = MIN_DOCS, constant: int = CONSTANT, min_tokens: int = MIN_TOKENS, words_only: bool = True) -> DataFrame:
    """The rows of ``docs`` with the recurring lines taken out of their texts. Only rows that lose lines, and a few more, are shuffled."""
    index = materialize(line_index(docs, leading, words_only), "line-index")
    gone = recurring_lines(docs, index, leading, min_docs, constant, min_tokens, words_only).withColumnRenamed("line", "gone")
    key, drop = free_name(docs, "_key"), free_name(docs, "_drop")
    mine = index.select(F.xxhash64("doc_id", "text_hash").alias("of_key"), F.explode(F.transform("lines", lambda x: x["line"])).alias("line")).join(gone, F.col("line") == F.col("gone")).groupBy("of_key").agg(F.collect_set("line").alias(drop))
    mine = materialize(mine, "lines-of-rows")
    keyed = docs.withColumn(key, F.xxhash64(*_key(docs)))
    maybe, others = Marks(mine.select("of_key")).split(keyed, key)
    joined = maybe.join(mine, F.col(key) == F.col("of_key"), "left")
    raw = F.split(F.col("text"), "\n")
    kept = F.transform(F.filter(F.arrays_zip(raw.alias("raw"), masked_lines(raw, words_only).alias("m")), lambda x: ~F.array_contains(F.col(drop), F.xxhash64(x["m"]))), lambda x: x["raw"])
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    changed = joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return others.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(changed)


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of any number of tokens go down the tree, and masked fields do not count against a template."""
    return line_templates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
p AS (SELECT *, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS x FROM (SELECT *, unnest(string_split(text, chr(10))) AS raw FROM d)),
v AS (SELECT *, regexp_replace(x, '[^ ]*(?:[0-9@]|://)[^ ]*', '<*>', 'g') AS y FROM p),
l AS (SELECT rid, doc_id, text, raw, CASE WHEN trim(replace(y, '<*>', '')) = '' THEN x ELSE y END AS m FROM v),
w AS (SELECT *, string_split(m, ' ') AS t FROM l WHERE m <> ''),
o AS (SELECT DISTINCT doc_id, text, m, t, len(t) AS n, list_slice(t, 1, 3) AS lead FROM w),
bl AS (SELECT m, t, n, lead, count(*) AS docs FROM o GROUP BY ALL),
lf AS (SELECT n, lead FROM bl GROUP BY ALL HAVING sum(docs) >= 3),
op AS (SELECT bl.* FROM bl JOIN lf USING (n, lead)),
tk AS (SELECT m, n, lead, docs, i, t[i] AS token FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM op)),
fr AS (SELECT n, lead, i, token FROM tk WHERE token <> '<*>' GROUP BY ALL HAVING sum(docs) >= 3),
tp AS (SELECT tk.m, tk.n, tk.lead, string_agg(coalesce(fr.token, '<*>'), ' ' ORDER BY tk.i) AS template, count(fr.token) AS k, count(*) FILTER (tk.token = '<*>') AS fields
       FROM tk LEFT JOIN fr ON tk.n = fr.n AND tk.lead = fr.lead AND tk.i = fr.i AND tk.token = fr.token GROUP BY ALL),
ok AS (SELECT m, n, lead, template FROM tp WHERE k > 0 AND 100 * k >= 70 * (n - fields)),
rc AS (SELECT n, lead, template FROM (SELECT DISTINCT ok.n, ok.lead, template, doc_id, text FROM o JOIN ok USING (m)) GROUP BY ALL HAVING count(*) >= 3),
gone AS (SELECT m FROM ok JOIN rc USING (n, lead, template)),
h AS (SELECT rid, count(*) AS n_lines, count(gone.m) AS n_dropped, sum(CASE WHEN gone.m IS NOT NULL THEN length(raw) + 1 ELSE 0 END) AS c FROM w LEFT JOIN gone USING (m) GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, CAST(length(text) AS BIGINT) AS n_chars,
       CAST(greatest(0, length(text) - coalesce(c, 0)) AS BIGINT) AS n_chars_left
FROM d LEFT JOIN h USING (rid)
"""
