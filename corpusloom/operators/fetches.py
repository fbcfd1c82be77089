"""What becomes of fetched urls: redirects followed over a table of replies, every hop checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import allowed_url, fetch_class, host, is_private_address, is_retryable, resolved_url
from ..sources.scratch import written

#: Fixed value: it must be this for right results.
MAX_REDIRECTS = 5
#: Doublings after which a chain of more redirects than that is known to be one.
_DOUBLINGS = 3


def _blocked(urls: DataFrame, addresses: DataFrame | None) -> DataFrame:
    """u, blocked of urls: no http address, or a host that is, or leads to, a private address."""
    plain = ~F.coalesce(allowed_url(F.col("u")), F.lit(False))
    if addresses is None:
        return urls.select("u", plain.alias("blocked"))
    of = addresses.groupBy(F.lower("host").alias("_host")).agg(F.bool_or(F.coalesce(is_private_address(F.col("address")), F.lit(True))).alias("_private"))
    literal = is_private_address(host(F.col("u"))).isNotNull()
    found = urls.join(of, host(F.col("u")) == F.col("_host"), "left")
    return found.select("u", (plain | (~literal & F.coalesce("_private", F.lit(True)))).alias("blocked"))


def follow(requested: DataFrame, replies: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """(url) and (url, status, location, content_type) -> url, final_url, redirects, status, error_class, retryable, a row for each requested row.

    A reply of 300 to 399 with a location leads on, relative ones against their own url. Of a url with several replies one is taken: the smallest
    by status, location and type. A url without one is a network error. After more than five redirects, which a loop always has, the class is too-many-redirects;
    before each fetch the url must be of http and not lead to a private address, else it is blocked-url; a location that is no url is
    bad-redirect. With ``addresses`` (host, address) a host leads to all of its addresses, and one without any is blocked. ``final_url`` is the last one reached,
    null where there are too many. A null url is blocked.

    Chains are followed by pointer doubling: three joins of the table of replies with itself, whatever the chains are like.
    """
    one = replies.where("url is not null").groupBy(F.col("url").alias("u")).agg(F.min(F.struct("status", "location", "content_type")).alias("r")).select("u", "r.*")
    leads = F.col("status").between(300, 399) & F.col("location").isNotNull()
    target = resolved_url(F.col("u"), F.col("location"))
    hops = written(one.select("*", F.when(leads, target).alias("next"), (leads & target.isNull()).alias("bad")), "fetch-hops")
    urls = hops.select("u").unionAll(hops.where("next is not null").select("next")).unionAll(requested.where("url is not null").select("url")).distinct()
    checked = _blocked(urls, addresses).join(hops.withColumnRenamed("u", "of"), F.col("u") == F.col("of"), "left").drop("of")
    nodes = written(checked, "fetch-nodes")
    going = ~F.col("blocked") & F.col("next").isNotNull()
    jumps = nodes.select("u", F.when(going, F.col("next")).otherwise(F.col("u")).alias("to"), going.cast("int").alias("steps"))
    for k in range(_DOUBLINGS):
        further = jumps.select(F.col("u").alias("_u"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        jumps = written(jumps.join(further, F.col("to") == F.col("_u")).select("u", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps")), f"fetch-jumps-{k}")
    ends = nodes.select(F.col("u").alias("_end"), "blocked", "status", "content_type", "bad")
    found = jumps.join(ends, F.col("to") == F.col("_end"))
    error = F.when(F.col("steps") > MAX_REDIRECTS, "too-many-redirects").when(~F.col("blocked") & F.coalesce("bad", F.lit(False)), "bad-redirect").otherwise(fetch_class(F.col("status"), F.col("content_type"), F.lit(0), F.col("blocked")))
    known = found.select(F.col("u").alias("_u"), F.when(F.col("steps") <= MAX_REDIRECTS, F.col("to")).alias("final_url"), F.least("steps", F.lit(MAX_REDIRECTS + 1)).alias("redirects"), "status", error.alias("error_class"))
    out = requested.join(known, F.col("url") == F.col("_u"), "left")
    error = F.when(F.col("url").isNull(), "blocked-url").otherwise(F.col("error_class"))
    status: Column = F.when(error.isNull() | (error == "http-status") | (error == "not-html"), F.col("status"))
    return out.select("url", "final_url", F.coalesce("redirects", F.lit(0)).alias("redirects"), status.alias("status"), error.alias("error_class"), F.coalesce(is_retryable(error, F.col("status")), F.lit(False)).alias("retryable"))
