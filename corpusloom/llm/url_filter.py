"""URL filters: rules for hosts and paths, and link-graph propagation for what they leave open.

The verdicts of the rules make seeds: hosts with more allowed than blocked pages are trusted, those with fewer are
distrusted, each by the difference of the shares; both kinds sum to 1. Trust spreads along links (personalised
PageRank), distrust against them. A host whose distrust exceeds ``ratio`` times its trust is blocked.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: (verdict, rule): a rule is a host, which stands for its subdomains too, and the beginning of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
#: The share of its score by which a host may still move when steps end.
TOLERANCE = 1e-4
#: How many times its trust a host's distrust must exceed.
RATIO = 1.0
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(host: Column) -> Column:
    """The host's node in the link graph: without user and port."""
    return F.regexp_replace(host, r"^[^@]*@|:\d*$", "")


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct of rule and verdict, the longest that fits; ties to the first given; null if none fits."""
    best = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):  # the later overrides the earlier
        of, at, rest = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(at + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def links(pages: DataFrame) -> DataFrame:
    """(host, html) -> of_host, to_host, weight: the number of links, between different hosts only. Users and ports do not count."""
    found = pages.where((F.col("host") != "") & F.col("html").isNotNull()).select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("to"))
    target = F.translate(node_of(F.col("to")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return found.select(node_of(F.col("host")).alias("of_host"), target.alias("to_host")).where((F.col("of_host") != F.col("to_host")) & (F.col("to_host") != "")).groupBy("of_host", "to_host").agg(F.count("*").cast("double").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, max_steps: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """seeds (host, trust, distrust) and edges (of_host, to_host, weight) -> host, trust, distrust.

    trust = (1 - damping) * seed + damping * sum over links to the host of trust * weight / weight of all links
    from there; distrust the same over reversed links. Steps end when no host changes by more than the share ``tolerance``
    of its score, a first score being a change of all of it; so every host that a seed reaches has a score. ``max_steps`` ends
    them earlier, and raises an error where hosts still move by more than ``tolerance`` in absolute terms.
    Each step is written to the shared folder, so lineage stays short; ranks and edges are joined by host, and a
    host that everybody links to is summed by parts before the shuffle.
    """
    out = edges.groupBy(F.col("of_host").alias("o")).agg(F.sum("weight").alias("all_out"))
    back = edges.groupBy(F.col("to_host").alias("t")).agg(F.sum("weight").alias("all_in"))
    edges = materialize(
        edges.join(out, F.col("of_host") == F.col("o")).join(back, F.col("to_host") == F.col("t")).select("of_host", "to_host", (F.col("weight") / F.col("all_out")).alias("forth"), (F.col("weight") / F.col("all_in")).alias("against")),
        "host-edges",
    )
    ends = edges.select(F.explode(F.array("of_host", "to_host")).alias("host"))
    base = materialize(
        seeds.select("host", "trust", "distrust").unionByName(ends.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))).groupBy("host").agg(F.max("trust").alias("s_trust"), F.max("distrust").alias("s_distrust")),
        "host-seeds",
    )
    ranks = base.select("host", ((1 - damping) * F.col("s_trust")).alias("trust"), ((1 - damping) * F.col("s_distrust")).alias("distrust"))
    for step in itertools.count():
        forth = edges.join(ranks, F.col("of_host") == F.col("host")).select(F.col("to_host").alias("at"), (F.col("trust") * F.col("forth")).alias("t"), F.lit(0.0).alias("d"))
        against = edges.join(ranks, F.col("to_host") == F.col("host")).select(F.col("of_host").alias("at"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("against")).alias("d"))
        got = forth.unionByName(against).groupBy("at").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        flow = lambda seed, x: (1 - damping) * F.col(seed) + damping * F.coalesce(x, F.lit(0.0))
        new = base.join(got, F.col("host") == F.col("at"), "left").join(ranks.select(F.col("host").alias("was_at"), F.col("trust").alias("was_t"), F.col("distrust").alias("was_d")), F.col("host") == F.col("was_at"))
        new = materialize(new.select("host", flow("s_trust", F.col("t")).alias("trust"), flow("s_distrust", F.col("d")).alias("distrust"), "was_t", "was_d"), f"host-ranks-{step}")
        by = lambda x, was: F.abs(F.col(x) - F.col(was))
        share = lambda x, was: F.when(F.col(x) == F.col(was), 0.0).otherwise(by(x, was) / F.greatest(x, was))
        moved = new.agg(F.max(F.greatest(share("trust", "was_t"), share("distrust", "was_d"))).alias("share"), F.max(F.greatest(by("trust", "was_t"), by("distrust", "was_d"))).alias("most")).first()
        ranks = new.select("host", "trust", "distrust")
        if moved["share"] is None or moved["share"] <= tolerance:
            break
        if step + 1 == max_steps:
            if moved["most"] > tolerance:
                raise RuntimeError(f"hosts still move by {moved['most']} after {max_steps} steps")
            break
    return ranks


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, ratio: float = RATIO, **options) -> DataFrame:
    """(page_id, url, html, ...) -> page_id, host, path, rule, verdict, trust, distrust; a row for each row.

    Null urls and urls without ``://`` have an empty host and path, no rule and scores of 0. Their verdict, and
    that of hosts that neither kind of seed reaches, is allow. A null html has no links. Hosts that differ in
    user or port alone are one node of the graph. Of rules of equal length the first counts. Repeated rows count as
    pages of their own; extra columns are not looked at; an empty table gives an empty result. The html is read once,
    for links between hosts; what is joined back to the pages is one row a host, broadcast only if its measured size allows.
    """
    plain = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = plain.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("node", node_of(F.col("host")))
    share = lambda verdict: F.avg(F.coalesce((F.col("best.verdict") == verdict).cast("double"), F.lit(0.0)))
    by_host = ruled.where(F.col("node") != "").groupBy("node").agg((share("allow") - share("block")).alias("lean"))
    leaning = by_host.select(F.col("node").alias("host"), F.greatest("lean", F.lit(0.0)).alias("trust"), F.greatest(-F.col("lean"), F.lit(0.0)).alias("distrust"))
    mass = leaning.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    seeds = leaning.select("host", *[(F.col(c) / (mass[c] or 1.0)).alias(c) for c in ("trust", "distrust")])
    edges = links(pages.select(host_of(F.col("url")).alias("host"), "html"))
    ranks = propagate(seeds, edges, **options).withColumnRenamed("host", "ranked")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce(F.col("best.verdict"), F.when(distrust > ratio * trust, "block").otherwise("allow"))
    return ruled.join(ranks, F.col("node") == F.col("ranked"), "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: The same by 200 steps of the power iteration, which is more than the tolerance asks for where no path between hosts is longer.
OP1_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, lower_ascii AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM (SELECT *, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM pages)),
r(verdict, rule, host, path) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
x AS (SELECT p.page_id, p.html, p.host, p.path, regexp_replace(p.host, '^[^@]*@|:[0-9]*$', '', 'g') AS node,
    (SELECT rule FROM r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) ORDER BY length(rule) DESC LIMIT 1) AS rule
  FROM p),
j AS (SELECT x.*, r.verdict FROM x LEFT JOIN r USING (rule)),
lean AS (SELECT node, avg(CASE verdict WHEN 'allow' THEN 1.0 WHEN 'block' THEN -1.0 ELSE 0.0 END) AS lean FROM j WHERE node <> '' GROUP BY node),
s AS (SELECT node, greatest(lean, 0) / nullif(sum(greatest(lean, 0)) OVER (), 0) AS trust, greatest(-lean, 0) / nullif(sum(greatest(-lean, 0)) OVER (), 0) AS distrust FROM lean),
l AS (SELECT node AS a, translate(regexp_replace(t, '^[^@]*@|:[0-9]*$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b
  FROM (SELECT node, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)) AS t FROM j WHERE node <> '' AND html IS NOT NULL)),
e AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS forth, w / sum(w) OVER (PARTITION BY b) AS against
  FROM (SELECT a, b, CAST(count(*) AS DOUBLE) AS w FROM l WHERE a <> b AND b <> '' GROUP BY a, b)),
base AS (SELECT node, coalesce(max(trust), 0) AS trust, coalesce(max(distrust), 0) AS distrust
  FROM (SELECT node, trust, distrust FROM s UNION ALL SELECT a, 0, 0 FROM e UNION ALL SELECT b, 0, 0 FROM e) GROUP BY node),
ranks AS (
  SELECT 0 AS step, node, 0.15 * trust AS trust, 0.15 * distrust AS distrust FROM base
  UNION ALL
  SELECT z.step + 1, z.node, 0.15 * base.trust + 0.85 * z.t, 0.15 * base.distrust + 0.85 * z.d
  FROM (SELECT step, node, sum(t) AS t, sum(d) AS d
    FROM (SELECT step, node, 0.0 AS t, 0.0 AS d FROM ranks WHERE step < 200 AND EXISTS (SELECT 1 FROM e)
      UNION ALL SELECT k.step, e.b, k.trust * e.forth, 0.0 FROM ranks k JOIN e ON k.node = e.a WHERE k.step < 200
      UNION ALL SELECT k.step, e.a, 0.0, k.distrust * e.against FROM ranks k JOIN e ON k.node = e.b WHERE k.step < 200)
    GROUP BY step, node) z JOIN base ON base.node = z.node),
last AS (SELECT node, trust, distrust FROM ranks WHERE step = (SELECT max(step) FROM ranks))
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.verdict, CASE WHEN last.distrust > last.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN last ON last.node = j.node
"""
