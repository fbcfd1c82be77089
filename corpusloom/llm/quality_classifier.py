"""Quality classifier with hierarchical empirical Bayes over sites.

A classifier fitted on labelled documents gives each document the evidence that it is good: of quality and
not toxic. Grouped sums of that evidence over all documents give posteriors of hosts and of paths in them,
which shrink sparse ones towards the global mean by as much as the variation between sites tells. A document's
verdict adds to its own evidence the log-odds that its path has without it, against the global ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Marks, free_name, materialize, table, text_slices

#: Bound of the sample of labelled rows that the classifier is fitted on.
LABELLED_ROWS = 20_000
#: What the root of the log-likelihood ratio of a word (or of a word's beginning) must exceed to enter the lexicon.
SIGNIFICANT = 4.5
#: Beginnings of words that may stand for all their forms.
PREFIXES = (3, 4, 5, 6, 7)
_MARKS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2026"


def _segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[starts]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; numpy's own ``unique`` hashes, which is slower for so many different ones."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts between white space, and each word's text."""
    lists = pc.utf8_split_whitespace(text)
    tokens = lists.flatten()
    rows = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.not_equal(tokens, "")
    return tokens.filter(full), rows[full.to_numpy(zero_copy_only=False)]


def _plain(words: pa.Array) -> pa.Array:
    """Words in lower case without marks and digits at their ends."""
    return pc.utf8_trim(pc.utf8_lower(words), characters=_MARKS)


def _beginnings(words: pa.Array):
    """The words, then for each length their beginnings with an asterisk; null where a word is no longer than that."""
    words = words.cast(pa.large_string())
    yield words
    length, star, joined = pc.utf8_length(words), pa.scalar("*", pa.large_string()), pa.scalar("", pa.large_string())
    for k in PREFIXES:
        yield pc.if_else(pc.greater(length, k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, k), star, joined), None)


@dataclass
class Lexicon:
    words: list[str]
    weights: np.ndarray

    def value(self, words: pa.Array) -> np.ndarray:
        """The weight of each word: the largest of its own and its beginnings', 0 if none is listed."""
        out = np.zeros(len(words))
        if self.words and len(words):
            listed = pa.array(self.words, pa.large_string())
            for form in _beginnings(words):
                at = pc.fill_null(pc.index_in(form, listed, skip_nulls=True), len(self.words)).to_numpy(zero_copy_only=False)
                out = np.maximum(out, np.append(self.weights, 0.0)[at])
        return out


def features(text: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row a text: shares of symbols, marks, capitals, digits, repeats, and the lexicon's weight."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    n = len(text)
    tokens, rows = _tokens(text)
    counts = np.bincount(rows, minlength=n)
    size = np.maximum(1, counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    chars = np.maximum(1, pc.utf8_length(text).to_numpy(zero_copy_only=False))
    coded = tokens.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # what a word holds is counted once for each different word
    held = lambda pattern: _segment_sums(pc.count_substring_regex(coded.dictionary, pattern).to_numpy(zero_copy_only=False)[codes], starts, ends)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
    distinct = np.bincount(_distinct(rows.astype(np.int64) * (len(coded.dictionary) + 1) + codes) // (len(coded.dictionary) + 1), minlength=n)
    plain = _plain(coded.dictionary).dictionary_encode()
    value = lexicon.value(plain.dictionary)
    plain_codes = plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    hits = np.flatnonzero(value[plain_codes]) if len(plain_codes) else plain_codes
    pairs = _distinct(rows[hits].astype(np.int64) * (len(value) + 1) + plain_codes[hits])
    strongest = np.zeros(n)
    np.maximum.at(strongest, pairs // (len(value) + 1), value[pairs % (len(value) + 1)])
    weight = np.bincount(pairs // (len(value) + 1), value[pairs % (len(value) + 1)] if len(pairs) else None, minlength=n)
    return np.column_stack(
        [
            np.minimum(1, held(r"[#*$%&|<>{}~^=\\]") / size),
            np.minimum(1, held(r"!") / size),
            np.minimum(1, held(r"\p{Lu}") / chars),
            np.minimum(1, held(r"\p{Nd}") / chars),
            _segment_sums(same, starts, ends) / size,
            1 - distinct / size,
            np.minimum(1, chars / size / 20),
            np.log1p(counts) / 10,
            np.log1p(weight),
            strongest,
            weight / (1 + np.log1p(counts)),
        ]
    )


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights and intercept of a penalised logistic regression, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    quality: np.ndarray
    toxic: np.ndarray

    def evidence(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = (features(text, self.lexicon) - self.mean) / self.scale
        p = lambda w: 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        return p(self.quality), p(self.toxic)


def _presence(batches):
    """For each word, in how many toxic and other texts of the batch it is."""
    for batch in batches:
        for piece in text_slices(batch, "text"):
            tokens, rows = _tokens(pc.fill_null(piece.column("text"), "").cast(pa.large_string()))
            coded = tokens.dictionary_encode()
            plain = _plain(coded.dictionary).dictionary_encode()
            n = piece.num_rows
            pairs = _distinct(plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)] * n + rows)
            toxic = piece.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for form in _beginnings(plain.dictionary):
                coded = form.dictionary_encode()
                width = len(coded.dictionary)
                code = pc.fill_null(coded.indices, width).to_numpy(zero_copy_only=False).astype(np.int64)
                both = _distinct(code[pairs // n] * n + pairs % n)
                both = both[both // n < width]
                bad = toxic[both % n]
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.cast(pa.string()), pa.array(np.bincount(both[bad] // n, minlength=width)), pa.array(np.bincount(both[~bad] // n, minlength=width))], names=["word", "bad", "good"]
                )


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Fits on at most about ``labelled_rows`` labelled ids, the same in each run (a hash of the id picks them).

    Of an id with several labels the worse ones count, of an id with several texts the first by code point.
    """
    spark = docs.sparkSession
    labels = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.min((F.col("quality") != 0).cast("int")).alias("quality"), F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    share = min(1.0, labelled_rows / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).select("doc_id", "quality", "toxic")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))  # bounded by labelled_rows
    sample = materialize(sample, "quality-sample")
    size = chosen.agg(F.sum((F.col("toxic") != 0).cast("long")).alias("bad"), F.count("*").alias("n")).first()
    bad, good = size["bad"] or 0, size["n"] - (size["bad"] or 0)
    presence = sample.select("text", (F.col("toxic") != 0).alias("toxic")).mapInArrow(_presence, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (good - F.col("good") + 0.5))
    n = F.lit(float(bad + good))
    both = F.col("bad") + F.col("good")
    part = lambda x, total: F.when(x > 0, x * F.log(x * n / (both * float(max(1, total))))).otherwise(0.0)
    telling = (
        presence.where((F.col("word") != "") & (both >= 5))
        .withColumn("odds", odds)
        .withColumn("g", F.sqrt(2 * F.greatest(F.lit(0.0), part(F.col("bad"), bad) + part(F.col("good"), good))))
        .where((F.col("odds") > 0) & (F.col("g") > SIGNIFICANT))
        .select("word", "odds")
        .toArrow()  # bounded by the sample's words
        .sort_by([("odds", "descending"), ("word", "ascending")])
    )
    lexicon = Lexicon(telling.column("word").to_pylist(), telling.column("odds").to_numpy())
    shared = spark.sparkContext.broadcast(lexicon)

    def rows(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                x = features(piece.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), piece.column("quality"), piece.column("toxic")], names=["x", "quality", "toxic"])

    got = sample.select("text", F.col("quality").cast("int"), F.col("toxic").cast("int")).mapInArrow(rows, "x array<double>, quality int, toxic int").collect()
    got.sort(key=lambda r: (r["quality"], r["toxic"], r["x"]))  # sums over rows in one order are alike in each run
    width = features(pa.array([""]), lexicon).shape[1]
    if not got:
        return Model(lexicon, np.zeros(width), np.ones(width), np.append(np.zeros(width), 30.0), np.append(np.zeros(width), -30.0))
    x = np.array([r["x"] for r in got])
    mean, scale = x.mean(axis=0), np.maximum(1e-3, x.std(axis=0))
    z = (x - mean) / scale
    return Model(lexicon, mean, scale, _logistic(z, np.array([r["quality"] != 0 for r in got], float)), _logistic(z, np.array([r["toxic"] != 0 for r in got], float)))


def with_evidence(docs: DataFrame, model: Model, name: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``name``: struct of p_quality, p_toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    of = keep.index("text") if "text" in keep else len(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in [*keep, "text"][: max(len(keep), of + 1)]])

    def run(batches):
        fitted = shared.value
        for batch in batches:
            for piece in text_slices(batch, "text"):
                quality, toxic = fitted.evidence(piece.column(of))
                both = pa.StructArray.from_arrays([pa.array(quality), pa.array(toxic)], names=["p_quality", "p_toxic"])
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], both], names=[*keep, name])

    schema = rows.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("struct<p_quality: double, p_toxic: double>").alias(name)).schema
    return rows.mapInArrow(run, schema)


def _strength(n: float, groups: float, squares: float, between: float, within: float, mean: float) -> float:
    """The prior's weight in documents, by the method of moments for groups of a mean that varies between them."""
    spread = n - squares / max(n, 1)
    if groups < 2 or spread <= 0 or n <= groups:
        return 1e6
    variance = (between - (groups - 1) * within / (n - groups)) / spread
    return 1e6 if variance <= 0 else float(np.clip(mean * (1 - mean) / variance - 1, 1.0, 1e6))


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, p) for each document -> host, path, n_path, host_posterior, path_posterior; and the global mean.

    One partial sum a path and task is all that is shuffled, so a hot host costs no more than others.
    Only single rows of sums come to the driver.
    """
    sites, mean = _sites(evidence)
    host = (F.col("host_s") + F.col("host_k") * F.lit(mean)) / (F.col("host_n") + F.col("host_k"))
    return sites.select("host", "path", F.col("n").alias("n_path"), host.alias("host_posterior"), ((F.col("s") + F.col("path_k") * host) / (F.col("n") + F.col("path_k"))).alias("path_posterior")), mean


def _sites(evidence: DataFrame) -> tuple[DataFrame, float]:
    """host, path and their sums: n, s of the path, host_n, host_s; the weights host_k and path_k of the priors; and the global mean."""
    paths = materialize(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "site-sums")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    joined = paths.withColumnRenamed("host", "at").join(hosts, F.col("at").eqNullSafe(F.col("host")))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s"), F.count("*").alias("groups"), F.sum(F.col("host_n") * F.col("host_n").cast("double")).alias("squares"), F.sum(F.col("host_s") * F.col("host_s") / F.col("host_n")).alias("sq")).first()
    n, mean = total["n"] or 0, (total["s"] or 0.0) / max(1, total["n"] or 0)
    host_k = path_k = 1.0
    if n:
        of = joined.agg(
            F.sum("q").alias("q"),
            F.count("*").alias("groups"),
            F.sum(F.col("s") * F.col("s") / F.col("n")).alias("sq"),
            F.sum(F.col("n") * F.col("n").cast("double") / F.col("host_n")).alias("squares"),
        ).first()
        host_k = _strength(n, total["groups"], total["squares"], total["sq"] - n * mean * mean, of["q"] - total["sq"], mean)
        path_k = _strength(n, of["groups"] - total["groups"] + 1, of["squares"], of["sq"] - total["sq"], of["q"] - of["sq"], mean)
    return joined.select("host", "path", "n", "s", "host_n", "host_s", F.lit(host_k).alias("host_k"), F.lit(path_k).alias("path_k")), mean if n else 0.5


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sure(p: Column) -> Column:
    """Log-odds of a probability that is kept off 0 and 1."""
    return _logit(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p)))


def _judged(docs: DataFrame, model: Model, host: str, path: str, keep: list[str]) -> tuple[DataFrame, str, dict[str, Column]]:
    """Evidence of each row, written once with columns ``keep``, joined to its site; the prefix of the columns added; and what follows from them."""
    at = free_name(docs, "_evidence")
    names = list(dict.fromkeys([*keep, host, path]))
    rows = materialize(with_evidence(docs, model, at, names), "evidence")
    good = F.col(f"{at}.p_quality") * (1 - F.col(f"{at}.p_toxic"))
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), good))
    sites, mean = _sites(rows.select(F.col(f"`{host}`").alias("host"), F.col(f"`{path}`").alias("path"), p.alias("p")))
    sites = sites.select(*[F.col(c).alias(f"{at}_{c}") for c in sites.columns])
    joined = rows.join(sites, F.col(f"`{host}`").eqNullSafe(F.col(f"{at}_host")) & F.col(f"`{path}`").eqNullSafe(F.col(f"{at}_path")))
    c = lambda name: F.col(f"{at}_{name}")
    mean = min(1 - 1e-9, max(1e-9, mean))
    posterior = lambda n, s, k, prior: (s + k * prior) / (n + k)
    others_host = posterior(c("host_n") - 1, c("host_s") - p, c("host_k"), F.lit(mean))
    others = posterior(c("n") - 1, c("s") - p, c("path_k"), others_host)  # what the site tells without the document itself
    odds = _sure(p) + _sure(others) - math.log(mean / (1 - mean))
    host_all = posterior(c("host_n"), c("host_s"), c("host_k"), F.lit(mean))
    out = {
        "p_quality": F.col(f"{at}.p_quality"),
        "p_toxic": F.col(f"{at}.p_toxic"),
        "host_posterior": host_all,
        "path_posterior": posterior(c("n"), c("s"), c("path_k"), host_all),
        "score": 1 / (1 + F.exp(-odds)),
        "kept": odds >= 0,
    }
    return joined, at, out


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """(doc_id, text, host, path, ...) -> columns ``keep`` (all if None) and p_quality, p_toxic, host_posterior,
    path_posterior, score, kept; a row for each row. Underscores are added to names that ``keep`` has already.

    score is the posterior probability that the document is good; it is kept at 0.5 or more. Null texts count as
    empty; null hosts and paths are a host and a path of their own; repeated rows are documents of their own.
    Without usable labels every document counts as good. Labels of unknown documents have
    no effect. An empty table gives an empty result. Texts are read once; what is written and joined to the sites
    has the columns ``keep`` and the evidence alone.
    """
    model = model or train(docs, labels)
    keep = docs.columns if keep is None else keep
    joined, _, out = _judged(docs, model, host, path, keep)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    return joined.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(free_name(kept, name)) for name, c in out.items()])


def good_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns.

    Rows are told apart by two hashes of id, text, host and path, on which alone a verdict depends. Only rows that a filter of
    bounded size marks as rejected are shuffled, to be held against the exact hashes; the others stay where they are.
    """
    model = model or train(docs, labels)
    one, two, gone_one, gone_two = (free_name(docs, name) for name in ("_row_a", "_row_b", "_gone_a", "_gone_b"))
    known = [F.col(f"`{c}`") for c in dict.fromkeys(["doc_id", "text", host, path])]
    known += [c.isNull() for c in known]  # a hash passes over nulls
    named = docs.withColumn(one, F.xxhash64(*known)).withColumn(two, F.xxhash64(F.lit(1), *known))
    joined, _, out = _judged(named, model, host, path, [one, two])
    gone = materialize(joined.where(~out["kept"]).select(F.col(one).alias(gone_one), F.col(two).alias(gone_two)).distinct(), "rejected")
    maybe, others = Marks(gone.select(gone_one)).split(named, one)
    left = maybe.join(gone, (F.col(one) == F.col(gone_one)) & (F.col(two) == F.col(gone_two)), "left_anti")
    return others.unionByName(left).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
