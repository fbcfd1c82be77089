"""Quality analytics over event logs: counts, coverage, percentiles, recovery, progress, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_BODY, LOW_TAGS = 0.5, 0.6


def percentage(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100 * n / total)).otherwise(0.0)


def overview(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "done").alias("done"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("body_confidence") < LOW_BODY).alias("low_confidence"),
        F.round(F.avg("body_confidence"), 2).alias("avg_body_confidence"),
        F.round(F.avg("entity_confidence"), 2).alias("avg_entity_confidence"),
    )


def coverage(events: DataFrame, fields: dict[str, str]) -> DataFrame:
    """field, source, n: events by where each field came from; null where it was not found. One pass for all fields."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("source")) for k, c in fields.items()])
    return events.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.source").agg(F.count("*").alias("n"))


def by_domain(events: DataFrame, k: int = 15) -> DataFrame:
    rows = events.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "done").alias("done"), F.round(F.avg("body_confidence"), 2).alias("avg_confidence"))
    return rows.orderBy(F.desc("n"), "domain").limit(k)


def errors(events: DataFrame) -> DataFrame:
    return events.where("outcome = 'failed'").groupBy("error_class").agg(F.count("*").alias("n"))


#: Buckets that a range of values is cut into at a time.
BUCKETS = 4_096


def percentiles(rows: DataFrame, wanted: dict[str, list[float]], buckets: int = BUCKETS) -> dict[tuple[str, float], float | None]:
    """Exact percentiles of numeric columns, interpolated between neighbours; None for a column without values. Nulls and NaN are left out.

    A percentile lies between the values of two ranks. All ranks are looked for at once: the range of each is cut into buckets, their rows
    are counted, and the bucket that holds the rank is the next range, until it holds one value alone. A pass reduces a range by the number of
    buckets, so a few are enough, and no task or driver holds more than a count for each bucket.
    """
    clean = rows.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in wanted])
    first = clean.agg(*[f(c).alias(f"{c}_{n}") for c in wanted for f, n in ((F.count, "n"), (F.min, "lo"), (F.max, "hi"))]).first()
    open_, known = {}, {}
    places = {(c, p): p * (first[f"{c}_n"] - 1) for c, ps in wanted.items() for p in ps if first[f"{c}_n"]}
    for (c, _), at in places.items():
        for rank in {math.floor(at), math.ceil(at)}:
            open_[c, rank] = (0, first[f"{c}_lo"], first[f"{c}_hi"])  # rows below, and the range
    while True:
        known |= {key: lo for key, (_, lo, hi) in open_.items() if lo == hi}
        open_ = {key: x for key, x in open_.items() if x[1] < x[2]}
        if not open_:
            break
        names = list(open_)
        in_range = []
        for i, (c, _) in enumerate(names):
            _, lo, hi = open_[names[i]]
            bucket = F.least(F.lit(buckets - 1), F.floor((F.col(c) / 2 - lo / 2) / (hi / 2 - lo / 2) * buckets)).cast("int")
            in_range.append(F.when(F.col(c).between(lo, hi), F.struct(F.lit(i).alias("i"), bucket.alias("b"), F.col(c).alias("x"))))
        found = clean.select(F.explode(F.array_compact(F.array(*in_range))).alias("s")).groupBy("s.i", "s.b").agg(F.count("*").alias("n"), F.min("s.x").alias("lo"), F.max("s.x").alias("hi")).collect()
        for i, key in enumerate(names):
            below = open_[key][0]
            for r in sorted((r for r in found if r["i"] == i), key=lambda r: r["b"]):
                if key[1] < below + r["n"]:
                    open_[key] = (below, r["lo"], r["hi"])
                    break
                below += r["n"]
    value = lambda c, at: known[c, math.floor(at)] + (known[c, math.ceil(at)] - known[c, math.floor(at)]) * (at - math.floor(at))
    return {(c, p): value(c, places[c, p]) if (c, p) in places else None for c, ps in wanted.items() for p in ps}


def latency(events: DataFrame, columns: tuple[str, ...] = ("fetch_ms", "extract_ms")) -> DataFrame:
    got = percentiles(events.where("outcome = 'done'"), {c: [0.5, 0.95] for c in columns})
    names = {f"p{round(100 * p)}_{c}": x for (c, p), x in got.items()}
    row = events.sparkSession.createDataFrame([tuple(names.values())], ", ".join(f"`{n}` double" for n in names))
    return row.select(*[F.round(n).cast("long").alias(n) for n in names])


def recovery(events: DataFrame, articles: DataFrame) -> DataFrame:
    """Failed urls, and those that have an article with a body by now. Dated versions repeat a url, so urls are counted."""
    a = articles.select(F.col("canonical_url").alias("u"), F.col("body_html").isNotNull().alias("has_body"))
    return events.where("outcome = 'failed'").join(a, F.col("url") == F.col("u"), "left").agg(F.count_distinct("url").alias("failed_urls"), F.count_distinct(F.when(F.col("has_body"), F.col("url"))).alias("recovered"))


def recent_failures(events: DataFrame, k: int = 10) -> DataFrame:
    return events.where("outcome = 'failed'").orderBy(F.desc("created_at"), F.desc("event_id")).limit(k).select("event_id", "url", "error_class", "created_at")


def tagging_overview(events: DataFrame, readable_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Single rows of figures, joined side by side."""
    ref = F.struct("readable_type", "readable_id")
    e = events.agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "done").alias("done"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_distinct(ref).alias("readables"))
    r = readable_tags.agg(F.count_distinct(ref).alias("tagged"), F.count("*").alias("assigned"), F.round(F.avg("confidence"), 2).alias("avg_confidence"))
    return e.join(r).join(tags.agg(F.count("*").alias("vocabulary")))


def top_tags(readable_tags: DataFrame, tags: DataFrame, k: int = 6) -> DataFrame:
    rows = readable_tags.join(tags, F.col("tag_id") == F.col("id")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)
    return rows.join(rows.agg(F.greatest(F.lit(1), F.max("n")).alias("scale")))


def extraction_overview(events: DataFrame, fields: dict[str, str]) -> DataFrame:
    total = F.count("*")
    return events.agg(
        total.alias("total"),
        percentage(F.count_if(F.col("outcome") == "done"), total).alias("success_rate"),
        F.round(F.avg("body_confidence"), 2).alias("avg_confidence"),
        F.round(F.avg("word_count"), 1).alias("avg_words"),
        *[percentage(F.count(c), total).alias(f"{k}_coverage") for k, c in fields.items()],
    )


def mean_tag_confidence(readable_tags: DataFrame) -> DataFrame:
    return readable_tags.groupBy("readable_type", "readable_id").agg(F.avg("confidence").alias("avg_confidence"))


def _unlabelled(events: DataFrame, labels: DataFrame, readable_tags: DataFrame) -> DataFrame:
    """One row a readable that has no label: whether any attempt failed, its mean confidence, its newest attempt."""
    key = ["readable_type", "readable_id"]
    open_ = events.join(labels.where("feature = 'tagging'").select(*key).distinct(), key, "left_anti")
    attempts = open_.groupBy(*key).agg(F.bool_or(F.col("outcome") == "failed").alias("any_failed"), F.max("created_at").alias("newest"))
    return attempts.join(mean_tag_confidence(readable_tags), key, "left")


def tagging_progress(events: DataFrame, labels: DataFrame, readable_tags: DataFrame) -> DataFrame:
    open_ = _unlabelled(events, labels, readable_tags).agg(F.count_if("any_failed").alias("failed"), F.count_if(~F.col("any_failed") & (F.col("avg_confidence") < LOW_TAGS)).alias("low_confidence"))
    return events.agg(F.count_distinct(F.struct("readable_type", "readable_id")).alias("total")).join(labels.where("feature = 'tagging'").agg(F.count("*").alias("labeled"))).join(open_)


def tagging_queue(events: DataFrame, labels: DataFrame, readable_tags: DataFrame, exclude: list | None = None, k: int = 1) -> DataFrame:
    """What to label next: failures, then the least sure, then the newest."""
    rows = _unlabelled(events, labels, readable_tags)
    rows = rows.where(~F.col("readable_id").isin(exclude)) if exclude else rows
    return rows.orderBy(F.desc("any_failed"), F.coalesce("avg_confidence", F.lit(1.0)).asc(), F.desc("newest"), "readable_type", "readable_id").limit(k)


def extraction_progress(events: DataFrame, labels: DataFrame) -> DataFrame:
    done = labels.where("feature = 'extraction'")
    urls = events.join(done.select(F.col("subject_url").alias("url")).distinct(), "url", "left_anti").groupBy("url").agg(F.bool_or(F.col("outcome") == "failed").alias("any_failed"), F.min("body_confidence").alias("least"))
    open_ = urls.agg(F.count_if("any_failed").alias("failed"), F.count_if(~F.col("any_failed") & (F.col("least") < LOW_TAGS)).alias("low_confidence"))
    return events.agg(F.count_distinct("url").alias("total")).join(done.agg(F.count("*").alias("labeled"))).join(open_)


def extraction_queue(events: DataFrame, labels: DataFrame, exclude: list | None = None, k: int = 1) -> DataFrame:
    done = labels.where("feature = 'extraction'").select(F.col("subject_url").alias("url")).distinct()
    rows = events.join(done, "url", "left_anti")
    rows = rows.where(~F.col("url").isin(exclude)) if exclude else rows
    rows = rows.groupBy("url").agg(F.bool_or(F.col("outcome") == "failed").alias("any_failed"), F.min("body_confidence").alias("least"), F.max("created_at").alias("newest"))
    return rows.orderBy(F.desc("any_failed"), F.coalesce("least", F.lit(1.0)).asc(), F.desc("newest"), "url").limit(k)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def set_scores(cases: DataFrame, golden: str = "golden", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, n summed over cases of sets, then precision, recall and F1 once; 0 where nothing is to divide by."""
    g, p = F.coalesce(F.col(golden), F.array().cast("array<string>")), F.coalesce(F.col(predicted), F.array().cast("array<string>"))
    sums = cases.agg(
        F.coalesce(F.sum(F.size(F.array_intersect(g, p))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.size(F.array_except(p, g))), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.size(F.array_except(g, p))), F.lit(0)).alias("fn"), F.count("*").alias("n")
    )
    return with_ratios(sums)


def with_ratios(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def accuracy(cases: DataFrame, golden: str = "golden", predicted: str = "predicted") -> DataFrame:
    """The share of cases where both are equal, null to null too; 0 without cases."""
    return cases.agg(F.coalesce(F.avg(F.col(golden).eqNullSafe(F.col(predicted)).cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def corrections(assigned: Column, wrong: Column, added: Column) -> Column:
    """The golden set: what was assigned without the wrong, with the added."""
    return F.array_union(F.array_except(assigned, wrong), added)


def run_results(golden: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Each prediction beside its golden set; none means the empty set."""
    return predicted.join(golden, key, "left").withColumn("golden", F.coalesce("golden", F.array().cast("array<string>")))


def settle_run(results: DataFrame) -> DataFrame:
    """status, tp, fp, fn, n of a run: failed without results. Ratios are made on reading."""
    s = set_scores(results)
    return s.select(F.when(F.col("n") > 0, "done").otherwise("failed").alias("status"), "tp", "fp", "fn", "n")


def tagging_score(labels: DataFrame, readable_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """labeled, then ``set_scores`` of each labelled readable's tags now against the slugs in its label's JSON ({"tags": [...]})."""
    golden = labels.where("feature = 'tagging'").select("readable_type", "readable_id", F.coalesce(F.from_json("label", "tags array<string>")["tags"], F.array().cast("array<string>")).alias("golden"))
    slugs = tags.select(F.col("id").alias("_t"), "slug")
    now = readable_tags.join(slugs, F.col("tag_id") == F.col("_t")).groupBy("readable_type", "readable_id").agg(F.collect_set("slug").alias("predicted"))
    return set_scores(golden.withColumn("golden", F.array_distinct("golden")).join(now, ["readable_type", "readable_id"], "left")).withColumn("labeled", F.col("n"))


def extraction_score(labels: DataFrame, articles: DataFrame, authorships: DataFrame, authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """labeled, the byline's scores, and source_accuracy: articles as they are now against labels {"authors": [slugs], "source": slug}.

    A url without an article has no authors and no source; of several articles of one url, the one of the smallest id counts.
    """
    label = F.from_json("label", "authors array<string>, source string")
    golden = labels.where("feature = 'extraction'").select("subject_url", F.array_distinct(F.coalesce(label["authors"], F.array().cast("array<string>"))).alias("golden"), label["source"].alias("golden_source"))
    of_url = articles.where(F.col("canonical_url").isNotNull()).groupBy("canonical_url").agg(F.min_by(F.struct(F.col("id").cast("string").alias("id"), F.col("affiliation_id").cast("string").alias("affiliation_id")), "id").alias("a"))
    people = authors.select(F.col("id").cast("string").alias("_author"), F.col("slug").alias("_slug"))
    bylines = authorships.where("readable_type = 'article'").join(people, F.col("author_id").cast("string") == F.col("_author")).groupBy(F.col("readable_id").cast("string").alias("_article")).agg(F.collect_set("_slug").alias("predicted"))
    sources = affiliations.select(F.col("id").cast("string").alias("_source"), F.col("slug").alias("now_source"))
    now = golden.join(of_url, F.col("subject_url") == F.col("canonical_url"), "left").join(bylines, F.col("a.id") == F.col("_article"), "left").join(sources, F.col("a.affiliation_id") == F.col("_source"), "left")
    right = now.agg(F.coalesce(F.avg(F.col("golden_source").eqNullSafe(F.col("now_source")).cast("double")), F.lit(0.0)).alias("source_accuracy"))
    return set_scores(now).withColumn("labeled", F.col("n")).join(right)
