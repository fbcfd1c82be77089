"""The URL filter at its shipped defaults: many hosts, ports, ties of rules, and its SQL on linked pages."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import url_filter

DDL = "page_id long, url string, html string"


def link(*hosts):
    return " ".join(f'<a class=x href="http://{h}/p">l</a>' for h in hosts)


@pytest.fixture(scope="module")
def far(spark):
    """A blocked host, 2,000 hosts that link to it, and one more host that links to each of those."""
    rows = [(0, "http://bad.com/de/1", None), (1, "http://good.org/", None)]
    rows += [(10 + k, f"http://near{k}.net/en/", link("bad.com")) for k in range(2000)]
    rows += [(5000 + k, f"http://far{k}.net/en/", link(f"near{k}.net")) for k in range(2000)]
    return spark.createDataFrame(rows, DDL)


def test_two_thousand_hosts_behind_one(far):
    got = url_filter.judge(far).collect()
    assert all(r["distrust"] > 0 and r["verdict"] == "block" for r in got if r["host"].endswith(".net")) and len(got) == 4002
    assert abs(sum({r["host"]: r["distrust"] for r in got}.values()) - 1) < 0.9  # a distribution, less what hosts without links lose


def test_equal_shares_and_ratio(spark):
    rows = [(0, "http://a.com/de/", None), (1, "http://a.com/fr/", None), (2, "http://a.com/en/", None), (3, "http://b.com/de/", link("c.net")), (4, "http://c.net/", link("b.com", "good.org")), (5, "http://good.org/", link("c.net"))]
    rows += [(k, f"http://t{k}.org/", None) for k in range(10, 30)]
    pages = spark.createDataFrame(rows, DDL)
    verdict = lambda **o: {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, **o).collect()}
    assert verdict()[2] == "allow" and verdict()[4] == "block" and verdict(ratio=1e6)[4] == "allow"


def test_ports_users_ties_and_clashing_columns(spark):
    rows = [(0, "http://bad.com:8080/de/1", None), (4, "http://bad.com/de/1", None), (1, "http://x.net:81/en/", link("u@BAD.com:8080")), (1, "http://x.net:81/en/", link("bad.com")), (2, "http://y.net/", link("x.net")), (3, "http://z.com/q", "x" * 2_000_000 + link("good.org"))]
    pages = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("q") for c in ("host", "path", "node", "rule", "trust", "best", "ranked", "weight")})
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert got[0]["host"] == "bad.com:8080" and got[0]["rule"] is None and got[0]["verdict"] == "block" and got[1]["verdict"] == got[2]["verdict"] == "block"
    tied = url_filter.judge(pages, rules=(("allow", "com/"), ("block", "com/"), ("block", "net/"))).collect()
    assert {r["verdict"] for r in tied if r["page_id"] == 3} == {"allow"} and {r["verdict"] for r in tied if r["page_id"] == 2} == {"block"}
    assert len(tied) == 6


def test_sql_agrees_on_linked_pages(spark, tmp_path):
    hosts = [f"h{k}.net" for k in range(9)] + ["bad.com", "good.org", "example.org"]
    rows = [(k, f"https://{hosts[k % 12]}/{['de', 'fr', 'en/1', 'es'][k % 4]}/{k}?x", link(hosts[k * 7 % 12], hosts[(k * 5 + 3) % 12])) for k in range(90)] + [(None, None, None), (91, "nothing", "x"), (92, "ftp://H1.NET", "")]
    spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filter.op1_url_filter(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(url_filter.OP1_SQL)
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
