"""Redirect chains, addresses, signatures and percentiles against plain Python."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import random
from urllib.parse import urljoin

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import urls as U
from corpusloom.operators.analytics import percentiles
from corpusloom.operators.fetches import follow


def private(address):
    try:
        a = ipaddress.ip_address(address.strip("[]"))
    except ValueError:
        return None
    reserved = lambda x: any(x in ipaddress.ip_network(n) for n in U.RESERVED_V4)
    if a.version == 6 and a.ipv4_mapped:
        a = a.ipv4_mapped
    if a.version == 4:
        return reserved(a) or a.is_multicast
    carried = a.sixtofour or (ipaddress.IPv4Address(int(a) & 0xFFFFFFFF) if a in ipaddress.ip_network("64:ff9b::/96") else None)
    nets = ("::/127", "fe80::/10", "fec0::/10", "ff00::/8", "fc00::/7")
    return any(a in ipaddress.ip_network(n) for n in nets) or bool(carried and reserved(carried))


def test_addresses_are_those_of_the_library(spark):
    some = random.Random(2)
    v4 = [str(ipaddress.IPv4Address(some.choice([some.getrandbits(32), (some.choice([0, 10, 100, 127, 169, 172, 192, 224, 239, 240]) << 24) + some.getrandbits(24), (172 << 24) + (some.randrange(256) << 16), (192 << 24) + (168 << 16)]))) for _ in range(1500)]
    heads = [0x2002, 0x0064FF9B, 0xFE80, 0xFEC0, 0xFC00, 0xFD00, 0xFF02, 0x2001, 0]
    v6 = []
    for _ in range(1500):
        h = some.choice(heads)
        n = {0x0064FF9B: (h << 96) + some.getrandbits(32), 0: some.choice([0, 1, 2, 0xFFFF << 32]) + some.choice([0, some.getrandbits(32)])}.get(h, (h << 112) + (some.getrandbits(112) if some.random() < 0.5 else some.getrandbits(32) << 80))
        a = ipaddress.IPv6Address(n)
        v6.append(some.choice([str(a), a.exploded, f"[{a}]", str(a).upper(), f"::ffff:{some.choice(v4)}"]))
    bad = ["", "x", "1.2.3", "1.2.3.256", "01.2.3.4", "1.2.3.4.5", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "::1.2.3", "1:2:3:4:5:6:7::8:9", ":1::", "1:", "example.org"]
    rows = v4 + v6 + bad + ["1:2:3:4:5:6:7::", "::", "::1", "2002:7f00:1::", "::ffff:127.0.0.1", "64:ff9b::10.0.0.1"]
    got = spark.createDataFrame([(x,) for x in [*rows, None]], "a string").select("a", U.is_private_address(F.col("a")).alias("p"))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in got.collect():
        assert r["p"] == (None if r["a"] is None else private(r["a"])), r["a"]


def test_signatures_are_those_of_the_library(spark):
    some = random.Random(3)
    cases = [("key", "The quick brown fox jumps over the lazy dog"), ("Jefe", "what do ya want for nothing?"), ("k" * 64, ""), ("k" * 65, "x"), ("é" * 131, "Test Using Larger Than Block-Size Key"), ("\x0b" * 20, "Hi There")]
    cases += [("".join(chr(some.randrange(1, 0x2FF)) for _ in range(some.randrange(1, 140))), "".join(chr(some.randrange(1, 0x2FF)) for _ in range(some.randrange(200)))) for _ in range(60)]
    got = spark.createDataFrame([*cases, ("", "m"), (None, "m"), ("k", None)], "k string, m string").select("k", "m", U.hmac_hex(F.col("k"), F.col("m")).alias("h"))
    assert "Python" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        assert r["h"] == (hmac.new(r["k"].encode(), r["m"].encode(), hashlib.sha256).hexdigest() if r["k"] and r["m"] is not None else None)


def test_locations_resolve_like_the_library_s(spark):
    bases = ["http://x.test/a", "http://x.test", "https://x.test:8080/a/b/c?q=1#f", "http://x.test/a/b/"]
    places = ["/b?y=1", "https://y.test/c", "//z.test/d", "e", "e/f?g", "../h", "../../../i", "./j", "k/../l", "?m=1", "#n", "", "/o/./p/../q/", ".", ".."]
    rows = [(b, x) for b in bases for x in places]
    got = spark.createDataFrame(rows, "b string, l string").select("b", "l", U.resolved_url(F.col("b"), F.col("l")).alias("u")).collect()
    for r in got:
        want = urljoin(r["b"], r["l"])
        assert r["u"].split("#")[0].replace("x.test/?", "x.test?").rstrip("/") == want.split("#")[0].replace("x.test/?", "x.test?").rstrip("/"), r
    bad = spark.createDataFrame([("http://x.test/a", "http://bad host/x"), ("http://x.test/a", None)], "b string, l string").select(U.resolved_url(F.col("b"), F.col("l")).alias("u"))
    assert [r["u"] for r in bad.collect()] == [None, None]


def plain(url, replies, limit=5):
    redirects = 0
    while True:
        if redirects > limit:
            return None, 6, None, "too-many-redirects"
        host = url.split("//")[-1].split("/")[0] if url and url.startswith("http") else ""
        if not host or private(host) or host == "localhost":
            return url, redirects, None, "blocked-url"
        if url not in replies:
            return url, redirects, None, "network"
        status, location, kind = replies[url]
        if 300 <= status <= 399 and location is not None:
            if " " in location:
                return url, redirects, None, "bad-redirect"
            url, redirects = urljoin(url, location), redirects + 1
        elif not 200 <= status <= 299:
            return url, redirects, status, "http-status"
        elif "html" not in (kind or ""):
            return url, redirects, status, "not-html"
        else:
            return url, redirects, status, None


def test_chains(spark):
    some = random.Random(6)
    html = "text/html; charset=utf-8"
    replies = {f"http://c.test/{k}": (301, f"/{k + 1}", None) for k in range(12)}
    replies["http://c.test/12"] = (200, None, html)
    replies |= {"http://l.test/a": (302, "b", None), "http://l.test/b": (302, "a", None), "http://s.test/": (302, "/", None), "http://p.test/": (302, "http://127.0.0.1/x", None), "http://p.test/6": (302, "http://[::ffff:10.0.0.1]/", None), "http://b.test/": (302, "http://bad host/", None), "http://n.test/": (301, "http://gone.test/", None), "http://e.test/": (503, None, html), "http://t.test/": (200, None, "image/png"), "http://m.test/": (304, None, None)}
    names = [f"http://r.test/{k}" for k in range(60)]
    replies |= {n: some.choice([(302, some.choice(names), None), (302, some.choice(names), None), (302, some.choice(names), None), (200, None, html), (404, None, None)]) for n in names}
    asked = [*replies, *replies, "ftp://x.test/", "http://localhost/", "http://none.test/"]
    rows = spark.createDataFrame([(u, *r) for u, r in replies.items()], "url string, status int, location string, content_type string")
    got = follow(spark.createDataFrame([(u,) for u in [*asked, None]], "url string"), rows.unionAll(rows)).collect()
    assert len(got) == len(asked) + 1
    for r in got:
        if r["url"] is None:
            assert r["error_class"] == "blocked-url"
            continue
        assert (r["final_url"], r["redirects"], r["status"], r["error_class"]) == plain(r["url"], replies), r
        assert r["retryable"] == (r["error_class"] == "network" or r["error_class"] == "http-status" and r["status"] >= 500)
    hosts = spark.createDataFrame([("c.test", "93.184.216.34"), ("l.test", "93.184.216.34"), ("l.test", "10.0.0.1")], "host string, address string")
    got = {r["url"]: r["error_class"] for r in follow(rows.select("url"), rows, hosts).collect()}
    assert got["http://c.test/8"] is None and got["http://l.test/a"] == got["http://e.test/"] == "blocked-url"


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(0, 6, 3000), np.full(2000, 7.25), -rng.random(500) * 1e-9, [0.0, 1e300, -1e300]])
    rows = [(float(v), int(k % 5), None) for k, v in enumerate(x)] + [(None, None, None), (float("nan"), 3, None)]
    wanted = {"x": [0.0, 0.1, 0.5, 0.503, 0.95, 1.0], "k": [0.5, 0.99], "none": [0.5]}
    for buckets in (3, 4096):
        got = percentiles(spark.createDataFrame(rows, "x double, k int, none double").repartition(4), wanted, buckets)
        for p in wanted["x"]:
            assert abs(got["x", p] - np.quantile(x, p)) <= 1e-12 * abs(np.quantile(x, p)), p
        assert got["k", 0.5] == 2.0 and got["k", 0.99] == 4.0 and got["none", 0.5] is None
