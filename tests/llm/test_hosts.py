import math

import duckdb

from ledgerloom.llm import hosts
from tests.llm.fixtures import folder  # noqa: F401

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/x", "https://www.example.com/en/1", "http://example.com/en/",
        "http://example.com/en", "http://badexample.com/en/", "http://x.net/es/1?a=/fr/", "http://net/fr/2", "http://x.net#/es/",
        "ftp://h.co.uk/a?b#c", "http://É.Com/", "a://b://c/d", "http://com", "http://com/", "http://x.example.com:80/en/"]


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "page_id long, n long, good long")


def test_parts_and_rules(spark):
    rows = {r["page_id"]: r for r in hosts.judge(pages(spark, URLS), outcomes(spark, [])).collect()}
    at = {u: rows[k] for k, u in enumerate(URLS)}
    assert [(at[u]["host"], at[u]["path"]) for u in (None, "", "no scheme", "http://")] == [("", "")] * 4
    assert (at[URLS[4]]["host"], at[URLS[4]]["path"], at[URLS[4]]["rule"], at[URLS[4]]["verdict"]) == (
        "a.example.com", "/en/x", "example.com/en/", "block")
    assert (at[URLS[5]]["rule"], at[URLS[5]]["verdict"]) == ("www.example.com/en/", "allow")
    assert at["http://example.com/en"]["rule"] == "com/" and at["http://badexample.com/en/"]["rule"] == "com/"
    assert at["http://x.net/es/1?a=/fr/"]["rule"] == "net/es/" and at["http://net/fr/2"]["rule"] == "net/fr/"
    assert at["http://x.net#/es/"]["rule"] is None and at["http://com"]["rule"] is None
    assert at["http://com/"]["rule"] == "com/" and at["http://É.Com/"]["host"] == "É.com"
    assert (at["a://b://c/d"]["host"], at["a://b://c/d"]["path"]) == ("b:", "//c/d")
    assert at["http://x.example.com:80/en/"]["rule"] is None  # the port is part of the host


def test_levels(spark):
    df = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "co.uk", "b.co.uk", "a.b.com", "b.com", "com", "")], "host string")
    assert {r["host"]: (r["domain"], r["suffix"]) for r in hosts.with_levels(df).collect()} == {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"),
        "a.b.com": ("b.com", "com"), "b.com": ("b.com", "com"), "com": ("com", "com"), "": ("", "")}


def test_shrinkage(spark):
    """A host with many bad pages is blocked, its neighbour without outcomes leans on their domain, other domains do not."""
    urls, rows = [], []
    for host, n, good in [("bad.one.org", 200, 4), ("new.one.org", 0, 0), ("few.two.org", 2, 1), ("fine.two.org", 300, 295)]:
        rows += [(len(urls) + k, 1, int(k < good)) for k in range(n)]
        urls += [f"http://{host}/{k}" for k in range(max(n, 1))]
    got = {r["host"]: r for r in hosts.judge(pages(spark, urls), outcomes(spark, rows), rules=()).collect()}
    assert got["bad.one.org"]["verdict"] == "block" and got["fine.two.org"]["verdict"] == "allow"
    assert got["bad.one.org"]["rate"] < got["new.one.org"]["rate"] < got["few.two.org"]["rate"] < got["fine.two.org"]["rate"] + 0.5
    assert got["new.one.org"]["n_outcomes"] == 0
    for r in got.values():
        assert 0 <= r["bound"] <= r["rate"] <= 1


def test_odd_tables(spark):
    assert hosts.judge(pages(spark, []), outcomes(spark, [])).collect() == []
    assert hosts.judge(pages(spark, []), outcomes(spark, [(1, 1, 1)])).collect() == []
    clash = pages(spark, ["http://a.org/"] * 2).selectExpr("page_id", "url", "1 AS host", "2 AS path", "3 AS verdict", "4 AS n")
    rows = hosts.judge(clash.union(clash), outcomes(spark, [(0, 1, 1)])).collect()
    assert len(rows) == 4 and {r["host"] for r in rows} == {"a.org"}
    every = hosts.judge(pages(spark, URLS), outcomes(spark, [(k, 1, 1) for k in range(len(URLS))])).collect()
    assert len(every) == len(URLS) and not any(math.isnan(r["rate"]) for r in every)


def test_query_against_its_sql(spark, folder):
    labels = [(k, k % 3 and 1, int(k % 5 == 0)) for k in range(40)] + [(3, None, 0), (4, 1, None), (4, 0, 0)]
    path = folder(pages=pages(spark, URLS * 3), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    cur = con.execute(hosts.ORACLE["op5_host_reputation"])
    names = [c[0] for c in cur.description]
    got = hosts.op5_host_reputation(spark, path).select(names).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, cur.fetchall()))
