"""What is computed once a row, or once a distinct value, however often it is read."""

from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from websift.functions import urls
from websift.functions.lineage import cut
from websift.operators import links
from websift.plans import registry
from websift.sources.pages import as_pages


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_referrers_meet_normal_forms_made_once(spark):
    pages = as_pages(spark.createDataFrame([(1, "HTTPS://A.example.com:443//x"), (2, "https://a.example.com/y"), (3, None)], "seq long, url string"))
    edges = spark.createDataFrame([("https://a.example.com/b", 5, 2, "https://a.example.com/x"), ("https://a.example.com/c", 5, 1, "https://a.example.com/x"), ("https://a.example.com/a", 9, 0, "https://a.example.com/x")], "src_url string, src_seq long, pos long, dst_url string")
    found = links.with_referrers(pages, edges)
    assert {r.seq: r.referrers for r in found.collect()} == {1: ["https://a.example.com/c"], 2: [], 3: []}
    assert not any("lambda" in line for line in plan(found).splitlines() if "Join" in line)
    two = links.with_referrers(pages, edges, 2).filter("seq = 1").first()
    assert two.referrers == ["https://a.example.com/c", "https://a.example.com/b"]


def test_plain_urls_are_their_own_normal_form(spark):
    paths = ("", "/", "/a", "/a/", "//a", "/a//b", "/a///", "/a;x", "/a;x/b", "/a?q", "/a#f", "/a?", "/ a", "/a\n", "/a ", "/café", "/a/../b", "/a:80//b", "/a@b", "/[x]", "/a\\b", "/%7E")
    given = [s + h + p for s in ("http://", "https://", "HTTP://", "ftp://", "") for h in ("a.example.com", "A.example.com", "a:80", "a:443", "u@a", "a_b-c.d", "[::1]", "") for p in paths]
    rows = spark.createDataFrame([(u,) for u in given], "u string")
    trimmed = F.trim(F.regexp_replace("u", r"^\s+|\s+$", ""))
    whole = urls.let(urls.let(trimmed, lambda t: F.when(t != "", urls.with_scheme(t))), urls._canonical)
    got = rows.select("u", urls.normalize_url("u").alias("short"), whole.alias("whole"), F.col("u").rlike(urls.CANONICAL).alias("plain")).collect()
    assert [(r.u, r.short) for r in got] == [(r.u, r.whole) for r in got]
    assert 20 < sum(r.plain for r in got) < len(got) // 2


def test_sites_of_shops_are_a_small_table(spark):
    assert "Aggregate" not in plan(registry._shops(spark, SF_DIR))


def test_crawl_levels_read_keys_and_survive_equal_ones(spark, monkeypatch):
    written, key = [], links._key
    keep = lambda df, name="cut": written.append((name, [t for _, t in df.dtypes])) or cut(df, name)
    monkeypatch.setattr(links, "cut", keep)
    monkeypatch.setattr(links, "_key", lambda url, seed: F.length(url).cast("long") if seed < 2 else key(url, seed))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("x", "y"), ("c", "dd"), (None, "z"), ("a", "b")], "src_url string, dst_url string")
    starts = spark.createDataFrame([("a", 0), ("q", 2), ("a", 3), ("y", 4)], "url string, depth int")
    assert sorted(map(tuple, links.crawl_depth(starts, edges).collect())) == [("a", 0), ("b", 1), ("c", 1), ("dd", 2), ("q", 2), ("y", 4)]
    assert [t for name, t in written if name == "edges"] == [["bigint", "bigint"]]
