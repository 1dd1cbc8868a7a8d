"""Edge cases of the URL filters."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fleetspark.llm import url_filters
from tests.compare import same

LOG = "list string, kind string, rule string, action string, published int"
CAPTURES = "id int, url string, fetched_at int"


def test_parts_of_urls(spark):
    urls = {
        "http://user:pw@Host.Example.org:80/a#b": ("host.example.org", "example.org", "host.example.org/a"),
        "https://host.example.org./": ("host.example.org", "example.org", "host.example.org"),
        "https://a.b.co.uk/x?y": ("a.b.co.uk", "b.co.uk", "a.b.co.uk/x?y"),
        "https://co.uk": ("co.uk", "", "co.uk"),
        "http://1.2.3.4/": ("1.2.3.4", "", "1.2.3.4"),
        "http://[::1]:8/z": ("[::1]", "", "[::1]:8/z"),
        "http://h.io?q=a@b": ("h.io", "h.io", "h.io?q=a@b"),
        "ftp://x": ("x", "", "x"),
        "HTTPS://H.com/A?Q=b": ("h.com", "h.com", "h.com/A?Q=b"),
        "https://h.com:443": ("h.com", "h.com", "h.com"),
        "http://h.com:/x/": ("h.com", "h.com", "h.com/x"),
        "https://h.com:80/x": ("h.com", "h.com", "h.com:80/x"),
        "//h.com:80/x": ("h.com", "h.com", "h.com/x"),
        "https://a.github.io/x": ("a.github.io", "a.github.io", "a.github.io/x"),
        "https://b.a.github.io/x": ("b.a.github.io", "a.github.io", "b.a.github.io/x"),
        "https://github.io": ("github.io", "", "github.io"),
        "https://my-github.io": ("my-github.io", "my-github.io", "my-github.io"),
        "h.com:80/x": ("", "", "h.com/x"),
        "mailto:me": ("", "", "mailto:me"),
        "": ("", "", ""),
        "http://" + "a" * 50_000 + ".com": ("a" * 50_000 + ".com", "a" * 50_000 + ".com", "a" * 50_000 + ".com"),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host = url_filters.host_of(F.col("url"))
    got = {r.url: (r.h, r.d, r.p) for r in df.select("url", host.alias("h"), url_filters.domain_of(host).alias("d"), url_filters.plain_url(F.col("url")).alias("p")).collect()}
    assert got == urls


def test_repeated_and_keyless_captures(spark):
    log = spark.createDataFrame([("l", "host", "a.b", "add", 10)] * 2, LOG)
    rows = [(1, "http://a.b", 5), (1, "http://a.b", 12), (1, "http://a.b", 12), (None, "http://a.b", 12), (None, "http://c.b", 12), (1, "http://c.b", 12), (2, "http://a.b", None)]
    got = url_filters.filter_urls(spark.createDataFrame(rows, CAPTURES), log, "id").collect()
    assert sorted((r.id or 0, r.url, r.fetched_at or 0, r.blocked, r.n_entries) for r in got) == sorted((i or 0, u, t or 0, u == "http://a.b" and t == 12, int(u == "http://a.b" and t == 12)) for i, u, t in rows)


def test_clashes_and_empty_tables(spark):
    log = spark.createDataFrame([("l", "host", "a.b", "add", 1)], LOG)
    captures = spark.createDataFrame([(1, "http://a.b", 5)], CAPTURES)
    for name in ("lists", "n_entries", "blocked", "_capture_key"):
        with pytest.raises(ValueError):
            url_filters.filter_urls(captures.withColumn(name, F.lit(1)), log, "id")
    more = url_filters.filter_urls(captures.withColumns({"rule": F.lit("r"), "kind": F.lit("k"), "list": F.lit("x"), "part": F.lit(1), "at": F.lit(2)}), log, "id").first()
    assert (more.blocked, more.rule, more["list"], more.at) == (True, "r", "x", 2)
    assert url_filters.filter_urls(captures.limit(0), log, "id").isEmpty()
    assert url_filters.filter_urls(captures, log.limit(0), "id").first().blocked is False


def test_sql_takes_odd_urls_to_pieces_alike(spark, tmp_path):
    """The query and its SQL over urls of all these kinds, several of each so that lists meet them."""
    kinds = ["http://H.com:80/A", "http://h.com/a", "http://h.com/A", "//h.com/A", "https://h.com:443/x/", "https://h.com:80/x", "https://a.github.io/", "https://b.a.github.io", "https://github.io", "https://u@x.co.uk:/q?R=1#f", "h.com:80/x", "http://1.2.3.4:80", None, ""]
    rows = [(i, kinds[(i * 5) % len(kinds)], "") for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = url_filters.op1_url_filters(spark, str(tmp_path))
    assert got.filter("blocked").count() > 20
    same(got, con, url_filters.OP1_SQL)
