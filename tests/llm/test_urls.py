"""Reference resolution and alias classes, in Spark and in the SQL that goes with them."""

from __future__ import annotations

import duckdb
import pytest
from lakewright.llm import url_filter
from pyspark.sql import functions as F

LINK = '<html><LINK rel="canonical" href="{}"></html>'
CASES = [  # reference, page, what it names
    ("g", "http://a/b/c/d;p?q", "a/b/c/g"), ("./g", "http://a/b/c/d;p?q", "a/b/c/g"), ("g/", "http://a/b/c/d;p?q", "a/b/c/g/"), ("/g", "http://a/b/c/d;p?q", "a/g"), ("//g", "http://a/b/c/d;p?q", "g/"),
    ("?y", "http://a/b/c/d;p?q", "a/b/c/d;p?y"), ("g?y", "http://a/b/c/d;p?q", "a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q", "a/b/c/d;p?q"), ("g#s", "http://a/b/c/d;p?q", "a/b/c/g"), (";x", "http://a/b/c/d;p?q", "a/b/c/;x"),
    (".", "http://a/b/c/d;p?q", "a/b/c/"), ("./", "http://a/b/c/d;p?q", "a/b/c/"), ("..", "http://a/b/c/d;p?q", "a/b/"), ("../g", "http://a/b/c/d;p?q", "a/b/g"), ("../..", "http://a/b/c/d;p?q", "a/"), ("../../../g", "http://a/b/c/d;p?q", "a/g"),
    ("g.", "http://a/b/c/d;p?q", "a/b/c/g."), ("..g", "http://a/b/c/d;p?q", "a/b/c/..g"), ("./g/.", "http://a/b/c/d;p?q", "a/b/c/g/"), ("g;x=1/../y", "http://a/b/c/d;p?q", "a/b/c/y"), ("g?y/../x", "http://a/b/c/d;p?q", "a/b/c/g?y/../x"),
    ("/go?u=https://x.com/de/1", "http://a/b", "a/go?u=https://x.com/de/1"), ("g", "http://a", "a/g"), ("HTTPS://B.org", "http://a", "b.org/"), ("mailto:x@y", "http://a", None), ("a&amp;b", "http://a/", "a/a&b"),
]


def test_references(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, href string, base string, want string")
    got = {r.i: r.k for r in df.select("i", url_filter.key(url_filter.absolute(F.col("href"), F.col("base"))).alias("k")).collect()}
    assert [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[2]] == []


@pytest.fixture
def rows():
    pages = [
        (1, "http://net.net/p/q", LINK.format("/go?u=https://x.com/de/1")), (2, "http://net.net/p/r?x=0", LINK.format("?x=1")), (3, "http://net.net/p/r?x=1", LINK.format("https://x.com/de/3")), (4, "http://net.net/top", LINK.format("#top")),
        (5, "http://net.net/a/b/c", LINK.format("../d")), (6, "http://net.net/a/d", LINK.format("https://x.com/de/6")), (7, "http://net.net/two", LINK.format("/one") + LINK.format("https://x.com/de/7")),
        (8, "http://net.net/based", '<base href="https://x.com/de/">' + LINK.format("8")), (9, "go?u=https://x.com/de/9", LINK.format("https://free.org/")), (10, "http://net.net/long", "<p>" * 100_000 + LINK.format("https://x.com/de/10")),
        (11, "http://net.net/mail", LINK.format("mailto:a@x.com")), (None, "http://net.net/one", None), (None, None, None), (12, "", ""), (1, "http://net.net/p/q", "again"),
    ]
    hub = [(100 + i, f"http://h{i}.net/", LINK.format("https://hub.net/x")) for i in range(300)]
    return pages + hub + [(500, "https://hub.net/x", LINK.format("https://x.com/de/0"))]


def test_aliases(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"name": F.lit(1), "component": F.lit(2), "k": F.lit(3), "rule": F.lit(4)})
    got = url_filter.url_filter(spark, df).collect()
    by = {r.page_id: r.verdict for r in got if r.page_id is not None}
    assert [by[i] for i in range(1, 12)] == ["allow", "block", "block", "allow", "block", "block", "block", "block", "block", "block", "allow"]
    assert all(by[100 + i] == "block" for i in range(300)) and by[500] == "block" and by[12] == "allow"
    assert next(r.verdict for r in got if r.page_id is None and r.host) == "block"  # /one, which /two names
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.execute("SELECT page_id, host, path, rule, verdict FROM (" + url_filter.oracle_sql() + ")").fetchall()
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got)
