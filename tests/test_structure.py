"""Containment, siblings and referrers against plain loops over the parse's own tree."""

import json
import random

import pytest
from pyspark.sql import functions as F

from websift.operators import links, onpage, reports, structure
from websift.sources import dom
from websift.sources.pages import as_pages
from websift.streaming import ingest

TAGS = ("div", "p", "nav", "a", "br", "h2", "ul", "li", "section")


def drawn(seed: int) -> str:
    """Tags opened and closed at random: unclosed, wrongly nested and stray ones among them."""
    r = random.Random(seed)
    return "".join(f"</{r.choice(TAGS)}>" if r.random() < 0.45 else f"<{r.choice(TAGS)}>x" for _ in range(r.randint(0, 60)))


@pytest.fixture(scope="module")
def pages():
    return {i: drawn(i) for i in range(60)} | {60: "", 61: "<div></div>", 62: "<div>" * 40 + "<a>"}


@pytest.fixture(scope="module")
def nodes(spark, pages):
    return dom.dom_nodes(spark.createDataFrame(list(pages.items()), "seq long, html string")).cache()


@pytest.fixture(scope="module")
def trees(pages):
    return {i: dom.Tree(html) for i, html in pages.items()}


def pairs(trees, outer, inner):
    return {(s, o, i) for s, t in trees.items() for o in t.find(*outer) for i in t.inside(o) if t.tags[i] in inner}


@pytest.mark.parametrize("outer, inner", [(("nav", "div"), ("a", "br")), (("div", "p"), ("div", "p")), (TAGS, TAGS), (("table",), TAGS), (TAGS, ("table",))])
def test_within_is_the_join_on_ranges(nodes, trees, outer, inner):
    asked = lambda which: structure.within(nodes, F.col("tag").isin(*outer), F.col("tag").isin(*inner), which).collect()
    want = pairs(trees, outer, inner)
    rows = asked("all")
    assert len(rows) == len(want) and {(r.seq, r.outer.id, r.node.id) for r in rows} == want
    assert all(trees[r.seq].tags[r.outer.id] == r.outer.tag and trees[r.seq].tags[r.node.id] == r.node.tag for r in rows)
    around = {}
    for s, o, i in want:
        around.setdefault((s, i), []).append(o)
    assert {(r.seq, r.node.id): r.outer.id for r in asked("nearest")} == {k: max(v) for k, v in around.items()}
    assert {(r.seq, r.node.id): r.outer.id for r in asked("outermost")} == {k: min(v) for k, v in around.items()}


@pytest.mark.parametrize("outer, inner", [(("div", "section"), ("div", "p", "ul")), (("nav",), ("a",)), (TAGS, TAGS)])
def test_holding_counts_what_is_inside(nodes, trees, outer, inner):
    rows = structure.holding(nodes, F.col("tag").isin(*outer), F.col("tag").isin(*inner)).collect()
    want = {(s, o): sum(t.tags[i] in inner for i in t.inside(o)) for s, t in trees.items() for o in t.find(*outer)}
    assert len(rows) == len(want) and {(r.seq, r.node.id): r.n for r in rows} == want


def test_siblings(nodes, trees):
    following, heads = {}, {}
    for s, t in trees.items():
        last, head = {}, {}
        for i, parent in enumerate(t.parent):
            if parent in last:
                following[s, last[parent]] = i
            last[parent] = i
            if t.tags[i] == "h2":
                head[parent] = i
            elif parent in head:
                heads[s, i] = head[parent]
    rows = structure.next_siblings(nodes).collect()
    assert len(rows) == sum(len(t.tags) for t in trees.values())
    assert {(r.seq, r.node.id): r.next.id for r in rows if r.next} == following
    assert {(r.seq, r.node.id): r["head"].id for r in structure.below_siblings(nodes, F.col("tag") == "h2").collect()} == heads


def test_one_shuffle_and_defined_choices(nodes):
    found = structure.within(nodes, F.col("tag") == "div", F.col("tag") == "a", "nearest")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    with pytest.raises(ValueError):
        structure.within(nodes, F.lit(True), F.lit(True), "any")
    null = F.lit(None).cast("boolean")
    assert structure.within(nodes, null, F.lit(True)).isEmpty() and structure.holding(nodes, null, null).isEmpty()


def test_first_referrers_of_a_hub(spark):
    hub = spark.range(20000).select((20000 - F.col("id")).alias("src_seq"), F.concat(F.lit("https://a.example.com/"), F.col("id").cast("string")).alias("src_url"), F.lit(0).alias("pos"), F.lit("https://a.example.com/hub").alias("dst_url"))
    edges = hub.union(hub.filter("src_seq < 5")).union(spark.createDataFrame([(7, "https://a.example.com/z", 2, "https://a.example.com/one"), (7, "https://a.example.com/y", 1, "https://a.example.com/one")], hub.schema))
    found = links.first_referrers(edges, 3)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()  # tasks pass on three rows each, not the hub
    assert {r.dst_url: r.referrers for r in found.collect()} == {
        "https://a.example.com/hub": [f"https://a.example.com/{i}" for i in (19999, 19998, 19997)], "https://a.example.com/one": ["https://a.example.com/y", "https://a.example.com/z"],
    }
    whole = {r.dst_url: r.referrers for r in links.referrers(edges).collect()}
    assert all(r.referrers == whole[r.dst_url][:3] for r in found.collect())
    listed = spark.createDataFrame([("https://A.example.com/hub#top",), ("https://a.example.com/alone",), (None,)], "url string")
    pages = {r.url: r.referrers for r in links.with_referrers(as_pages(listed.withColumn("referrers", F.array(F.lit("old")))), edges, 2).collect()}
    assert pages == {"https://A.example.com/hub#top": [f"https://a.example.com/{i}" for i in (19999, 19998)], "https://a.example.com/alone": [], None: []}
    assert links.first_referrers(edges.limit(0), 3).isEmpty()


def test_json_array_from_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small rows would end up in one task
    rows = [(i % 7 if i % 5 else None, f'say "{i % 50}"\n' if i % 3 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, text string").repartition(6)
    read = lambda path: json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))
    for name, frame, want in (("some", df, rows), ("none", df.limit(0), []), ("one", df.limit(1), None)):
        reports.write_json_array(frame, str(tmp_path / name), ("k",))
        got = [(r["k"], r["text"]) for r in read(tmp_path / name)]
        assert len(got) == 1 if want is None else sorted(got, key=repr) == sorted(want, key=repr)
        assert [k is not None for k, _ in got] == sorted(k is not None for k, _ in got) and [k for k, _ in got if k is not None] == sorted(k for k, _ in got if k is not None)
    assert len(list((tmp_path / "some").glob("part-*"))) > 1
    reports.write_json_array(df, str(tmp_path / "some"), ("k",))  # again, over what is there
    assert len(read(tmp_path / "some")) == 500
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shared_values_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    title = lambda i: f"<title>{'' if i % 11 == 0 else f'Title {i % 9}' if i % 2 else f'Own {i}'}</title>"
    body = lambda i: title(i) + (f'<meta name="description" content="About {i % 4}">' if i % 3 else "")
    order = random.Random(1).sample(range(90), 90)
    for i in range(6):  # six files, a batch each
        made = [(p, f"https://a.example.com/{p}", body(p)) for p in order[i::6]]
        spark.createDataFrame(made, "seq long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.page_stream(spark, str(tmp_path / "in"), "seq long, url string, html string", max_files=1)
    query = ingest.shared_values(stream).writeStream.outputMode("update").format("memory").queryName("shared_updates").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    updates = spark.table("shared_updates")
    assert updates.groupBy("metric", "value").count().filter("count > 1").count() > 0  # values were corrected as pages came
    facts = onpage.facts_of(as_pages(spark.read.parquet(str(tmp_path / "in"))))
    got, want = (sorted(map(tuple, df.collect())) for df in (ingest.shared_findings(facts, updates), onpage.cross_page_findings(facts)))
    assert got == want and len(got) > 50
