"""Small authored inputs: rules at their limits, functions, site files, contacts, answers, reports, model boundary, streams."""

import json

import pytest
from pyspark.sql import functions as F

from websift.functions import textnorm, tokens, urls
from websift.operators import boundary, links, nap, onpage, reports, search
from websift.plans import madeup
from websift.sources import sitefiles
from websift.sources.pages import PAGE, as_pages, request_bodies, responses
from websift.streaming import ingest

SITE = "https://shop.example.com"


def html(head="", body="", title="A title of good length", lang=' lang="en"'):
    named = f"<title>{title}</title>" if title is not None else ""
    return f'<!doctype html><html{lang}><head><meta charset="utf-8">{named}{head}</head><body>{body}</body></html>'


def found(spark, *bodies, **columns):
    rows = [(f"{SITE}/p{i}", b, i) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "url string, html string, seq bigint")
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return onpage.in_order(onpage.audit(as_pages(df))).collect()


def metrics(spark, body, **columns):
    return {r.metric for r in found(spark, body, **columns)}


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


IMG = '<img src="/a.png" alt="">'
LIMITS = [
    ("title_missing", html(title=None), html()),
    ("multiple_titles", html("<title>Another</title>"), html()),
    ("title_empty", html(title="  "), html()),
    ("title_too_short", html(title="x" * 14), html(title="x" * 15)),
    ("title_too_long", html(title="x" * 61), html(title="x" * 60)),
    ("meta_description_missing", html(), html('<meta name="Description" content="d">')),
    ("multiple_meta_descriptions", html('<meta name="description" content="a"><meta name="description" content="b">'), html('<meta name="description" content="a">')),
    ("meta_description_empty", html('<meta name="description" content=" ">'), html('<meta name="description" content="a">')),
    ("meta_description_too_short", html(f'<meta name="description" content="{"d" * 49}">'), html(f'<meta name="description" content="{"d" * 50}">')),
    ("meta_description_too_long", html(f'<meta name="description" content="{"d" * 161}">'), html(f'<meta name="description" content="{"d" * 160}">')),
    ("h1_missing", html(), html(body="<h1>x</h1>")),
    ("multiple_h1", html(body="<h1>x</h1><h1>y</h1>"), html(body="<h1>x</h1>")),
    ("empty_h1", html(body="<h1> </h1>"), html(body="<h1>x</h1>")),
    ("heading_hierarchy_skip", html(body="<h3>x</h3>"), html(body="<h2>y</h2><h3>x</h3>")),
    ("robots_noindex", html('<meta name="robots" content="NOINDEX, follow">'), html('<meta name="robots" content="noindexed">')),
    ("robots_nofollow", html('<meta name="robots" content="nofollow">'), html('<meta name="robots" content="follow">')),
    ("canonical_missing", html(), html('<link rel="canonical" href="https://a/">')),
    ("multiple_canonicals", html('<link rel="canonical" href="https://a/"><link rel="canonical" href="https://b/">'), html('<link rel="canonical" href="https://a/">')),
    ("canonical_empty", html('<link rel="canonical" href=" ">'), html('<link rel="canonical" href="/a">')),
    ("canonical_relative", html('<link rel="canonical" href="/a">'), html('<link rel="canonical" href="https://a/">')),
    ("viewport_missing", html(), html('<meta name="viewport" content="width=device-width">')),
    ("viewport_restrictive", html('<meta name="viewport" content="maximum-scale=1">'), html('<meta name="viewport" content="maximum-scale=2">')),
    ("html_lang_missing", html(lang=""), html()),
    ("charset_missing", "<html><head></head></html>", html()),
    ("render_blocking_script", html('<script src="/a.js"></script>'), html('<script src="/a.js" defer="defer"></script>')),
    ("excessive_dom_size", html(body="<i></i>" * 1496), html(body="<i></i>" * 1495)),
    ("image_alt_missing", html(body='<img src="/a.png">'), html(body=IMG)),
    ("image_dimensions_missing", html(body=IMG * 4), html(body=IMG * 3)),
    ("javascript_link", html(body='<a href="JavaScript:x()">x</a>'), html(body='<a href="/x">x</a>')),
    ("empty_href_links", html(body='<a href="#">x</a>' * 4), html(body='<a href="#">x</a>' * 3)),
    ("mixed_content_link", html(body='<a href="http://a/">x</a>'), html(body='<a href="https://a/">x</a>')),
    ("thin_content_signal", html(title=None, body="w " * 119), html(title=None, body="w " * 120)),
    ("open_graph_title_missing", html(), html('<meta property="og:title" content="x">')),
    ("open_graph_image_missing", html(), html('<meta property="og:image" content="x">')),
    ("hreflang_non_absolute", html('<link rel="alternate" hreflang="de" href="/de">'), html('<link rel="alternate" hreflang="de" href="https://a/de">')),
]


def test_page_rules_at_their_limits(spark):
    """All rules in one pass: each fires on its first page and not on its second."""
    bodies = [b for _, fires, silent in LIMITS for b in (fires, silent)]
    got = {(r.page, r.metric) for r in found(spark, *bodies)}
    for i, (metric, _, _) in enumerate(LIMITS):
        assert (f"{SITE}/p{2 * i}", metric) in got, metric
        assert (f"{SITE}/p{2 * i + 1}", metric) not in got, metric


def test_crawl_rules(spark):
    hop = F.struct(F.lit(301).alias("status"), F.lit("https://a/").alias("url"))
    got = metrics(spark, html(), depth=F.lit(4), redirect_chain=F.array(hop, hop), response_time=F.lit(2.51), headers=F.create_map(F.lit("x-robots-tag"), F.lit("NoIndex")))
    assert {"click_depth_high", "redirect_chain", "slow_server_response", "x_robots_noindex"} <= got
    got = metrics(spark, html(), depth=F.lit(3), redirect_chain=F.array(hop), response_time=F.lit(2.5))
    assert not {"click_depth_high", "redirect_chain", "slow_server_response", "x_robots_noindex"} & got
    for status, severity in ((404, "high"), (500, "critical"), (0, "critical")):
        assert [(r.metric, r.severity) for r in found(spark, html(), status=F.lit(status))] == [("http_error", severity)]


def test_cross_page_and_order(spark):
    body = html('<meta name="description" content="the same">', title="Duplicate Company Portal")
    rows = found(spark, body, body, html())
    assert [r.page for r in rows if r.metric == "duplicate_title"] == [f"{SITE}/p0", f"{SITE}/p1"]
    assert sum(r.metric == "duplicate_meta_description" for r in rows) == 2
    pages = [r.page for r in rows if not r.metric.startswith("duplicate")]
    assert pages == sorted(pages)


def test_orphans(spark):
    pages = as_pages(spark.createDataFrame([(f"{SITE}/a", 1, 0), (f"{SITE}/b", 1, 1)], "url string, depth int, seq bigint").withColumn("html", F.lit("x")))
    listed = spark.createDataFrame([(f"{SITE}/a",), (f"{SITE}/b",)], "url string")
    edges = spark.createDataFrame([(SITE, f"{SITE}/b")], "src_url string, dst_url string")
    assert [r.url for r in links.orphans(pages, listed, edges).collect()] == [f"{SITE}/a"]
    assert {r.metric for r in onpage.crawl_findings(pages, listed).collect()} == {"orphan_page_in_sitemap"}


def test_links_come_from_the_parse(spark):
    body = (
        '<a href="/p?a=1&amp;b=2">x</a><!-- <a href="/commented">x</a> --><script>s = "<a href=/script>x</a>";</script><![foo[x]]>'
        '<a title="a > b" href="/after">x</a><a data-href="/data">x</a><a\nhref=/bare>x</a>'
    )
    pages = as_pages(spark.createDataFrame([(f"{SITE}/", html(body=body), 0)], "url string, html string, seq bigint"))
    got = links.links(links.anchors(pages)).orderBy("pos").collect()
    assert [(r.pos, r.dst_url) for r in got] == [(0, f"{SITE}/p?a=1&b=2"), (1, f"{SITE}/after"), (2, f"{SITE}/bare")]


def test_depth_and_sitemaps_end_where_nothing_is_new(spark):
    chain = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(34)] + [("u34", "u0"), ("u0", "u2")], "src_url string, dst_url string").coalesce(1)
    starts = spark.createDataFrame([("u0", 0)], "url string, depth int").coalesce(1)
    got = {r.url: r.depth for r in links.crawl_depth(starts, chain).collect()}
    assert got == {f"u{i}": i if i < 1 else max(1, i - 1) for i in range(35)} and max(got.values()) == 33
    maps = [(f"{SITE}/sitemap.xml" if i == 0 else f"{SITE}/m{i}.xml", f"<sitemapindex><sitemap><loc>{SITE}/m{i + 1}.xml</loc></sitemap></sitemapindex>") for i in range(7)]
    maps.append((f"{SITE}/m7.xml", f"<urlset><url><loc>{SITE}/deep</loc></url></urlset>"))
    files = spark.createDataFrame([(SITE, "/robots.txt", 200, "")], "site string, path string, status int, body string")
    assert [r.url for r in sitefiles.sitemap_urls(files, spark.createDataFrame(maps, "url string, body string")).collect()] == [f"{SITE}/deep"]


@pytest.mark.parametrize(
    ("url", "base", "want"),
    [
        ("https://example.com/about#team", None, "https://example.com/about"), ("/contact", "https://example.com/home", "https://example.com/contact"),
        ("HTTPS://Example.COM:443/Path//Sub", None, "https://example.com/Path/Sub"), ("http://a.com:8080?q=1", None, "http://a.com:8080/?q=1"), ("ftp://a.com/x", None, ""), ("", None, ""),
    ],
)
def test_normalize_url(spark, url, base, want):
    assert value(spark, urls.normalize_url(F.lit(url), None if base is None else F.lit(base))) == want


def test_scalar_functions(spark):
    row = spark.range(1).select(
        F.array(*(textnorm.norm_phone(F.lit(p)) for p in ("+1 (555) 234-5678", "555.234.5678", "1-555-234-5678", "5552345678"))).alias("phones"),
        F.array(*(textnorm.norm_name(F.lit(p)) for p in ("Acme Innovations, LLC", "Acme Innovations Inc.", "Acme Innovations"))).alias("names"),
        F.array(*(textnorm.norm_address(F.lit(p)) for p in ("100 North Main Street, Suite 200, Springfield, IL 62701", "100 N. Main St., Ste. 200, Springfield, IL 62701"))).alias("places"),
        F.array(*(tokens.stem(F.lit(p)) for p in ("services", "service", "pricing", "price", "returned", "return", "companies", "company"))).alias("stems"),
        tokens.query_tokens(F.lit("What are your business return policies?")).alias("asked"),
        F.array(*(urls.is_crawlable_link(F.lit(f"{SITE}{p}")) for p in ("/about-us", "/services/", "/a.pdf", "/a.PNG", "/a.css"))).alias("crawlable"),
        (urls.url_priority_score(F.lit(f"{SITE}/contact-us")) > urls.url_priority_score(F.lit(f"{SITE}/blog/article-1"))).alias("first"),
        F.array(*(urls.same_site(F.lit(u), F.lit("https://example.com/")) for u in ("https://www.example.com/a", "https://other.com/", "mailto:a@example.com"))).alias("same"),
    ).first()
    assert set(row.phones) == {"5552345678"} and set(row.names) == {"acme innovations"} and len(set(row.places)) == 1
    assert row.stems[::2] == row.stems[1::2]
    assert {"business", "return", "policies"} <= set(row.asked) and not {"what", "are"} & set(row.asked)
    assert row.crawlable == [True, True, False, False, False] and row.first and row.same == [True, False, False]


LOCAL = {"@type": "LocalBusiness", "name": "Acme Widgets Inc.", "telephone": "+1-800-555-0199", "address": {"streetAddress": "456 Market Boulevard", "addressLocality": "Austin", "addressRegion": "TX", "postalCode": "78701"}}


def contacts(spark, *bodies):
    rows = [(f"{SITE}/p{i}", b, i) for i, b in enumerate(bodies)]
    return nap.page_candidates(as_pages(spark.createDataFrame(rows, "url string, html string, seq bigint")))


def test_contacts_agree(spark):
    first = html(f'<script type="application/ld+json">{json.dumps(LOCAL)}</script>', '<footer><a href="tel:800-555-0199">call</a></footer>')
    second = html(f'<script type="application/ld+json">{json.dumps(LOCAL)}</script>', '<address>456 Market Blvd., Austin, TX 78701</address><a href="tel:8005550199">call</a>')
    rows = nap.report(contacts(spark, first, second)).collect()
    assert [r.field for r in rows] == ["name", "address", "phone"] and {r.verdict for r in rows} == {"consistent"}
    assert rows[2].confidence == 0.99 and len(rows[2].confidence_explanation) > 20
    assert nap.canonical(nap.verdicts(contacts(spark, first, second))).first().phone == "+1-800-555-0199"


def test_contacts_differ_or_lack(spark):
    rows = {r.field: r for r in nap.report(contacts(spark, html(body='<a href="tel:555-111-2222">a</a>'), html(body='<a href="tel:555-999-8888">a</a>'))).collect()}
    assert rows["phone"].verdict == "mismatch" and rows["address"].verdict == "not_found" and rows["address"].confidence == 0.0


def test_faq_passage_and_answers(spark):
    body = html(body="<h3>What is the warranty period?</h3><p>All hardware items carry a full warranty period of two years from delivery.</p>")
    rows = search.page_passages(as_pages(spark.createDataFrame([(SITE, body, 0)], "url string, html string, seq bigint")))
    assert any("What is the warranty period?: All hardware items" in r.text for r in rows.collect())
    docs = spark.createDataFrame([(1, "Our return policy grants a refund within a window of thirty days."), (2, "The leadership team values honest work.")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "return policy and refund window"), (2, "quantum physics relativistic spacetime equations"), (3, "")], "query_id long, query string")
    scored = search.scores(docs, asked).collect()
    assert {(r.query_id, r.doc) for r in scored} == {(1, 1)}
    assert {r.query_id: r.answer is not None for r in search.answers(docs, asked).collect()} == {1: True, 2: False, 3: False}


ROBOTS = """# all
User-agent: *
Disallow: /private
Allow: /

User-agent: GPTBot
User-agent: CCBot
Disallow: /

Sitemap: https://shop.example.com/maps/one.xml
sitemap: https://shop.example.com/sitemap.xml
"""


def files(spark):
    rows = [(SITE, "/robots.txt", 200, ROBOTS), (SITE, "/llms.txt", 404, ""), ("https://open.example.com", "/robots.txt", 404, "User-agent: *\nDisallow: /"), ("https://open.example.com", "/llms.txt", 200, "about this site")]
    return spark.createDataFrame(rows, "site string, path string, status int, body string")


def test_robots(spark):
    rules = sitefiles.robots_rules(files(spark))
    asked = spark.createDataFrame([(f"{SITE}/private/x", SITE), (f"{SITE}/x", SITE), ("https://open.example.com/x", "https://open.example.com")], "url string, site string")
    ask = lambda agent: {r.url: r.allowed for r in sitefiles.allowed(asked, rules, agent).collect()}
    assert list(ask("AnyBot/1.0").values()).count(False) == 1 and not ask("AnyBot/1.0")[f"{SITE}/private/x"]
    assert not ask("GPTBot/2")[f"{SITE}/x"] and ask("GPTBot/2")["https://open.example.com/x"]


def test_robots_as_the_standard_library(spark):
    """Drawn files of every kind of line; sites without a served or filled file allow everything."""
    bodies = [madeup.robots_file(1000 + i) for i in range(1000)] + ["", " \n\t", "\x85\u2028", "User-agent: *\x0bDisallow: /"]
    rows = [(f"https://s{i}.example.com", "/robots.txt", 200, b) for i, b in enumerate(bodies)] + [("https://gone.example.com", "/robots.txt", 404, "User-agent: *\nDisallow: /")]
    files = spark.createDataFrame(rows, "site string, path string, status int, body string")
    sites = [r[0] for r in rows] + ["https://none.example.com"]
    asked = spark.createDataFrame([(s, s + p) for s in sites for p in madeup.ROBOTS_PATHS], "site string, url string")
    rules = sitefiles.robots_rules(files)
    want = {r[0]: r[3] for r in rows if r[2] == 200 and r[3].strip()}
    for agent in ("GPTBot/1.0", "Mozilla/5.0 (compatible)", "SomeOtherBot"):
        got = {r.url: r.allowed for r in sitefiles.allowed(asked, rules, agent).collect()}
        assert len(got) == len(sites) * len(madeup.ROBOTS_PATHS) and len(set(got.values())) == 2
        for s in sites:
            answers = madeup.robots_verdicts(want[s], agent=agent) if s in want else [True] * len(madeup.ROBOTS_PATHS)
            assert [got[s + p] for p in madeup.ROBOTS_PATHS] == answers, (agent, want.get(s))


def test_site_rules(spark):
    rows = {(r.metric, r.page): r.evidence for r in onpage.site_findings(files(spark)).collect()}
    assert set(rows) == {("llms_txt_missing", f"{SITE}/llms.txt"), ("ai_crawler_blocked", f"{SITE}/robots.txt")}
    assert rows["ai_crawler_blocked", f"{SITE}/robots.txt"].endswith("GPTBot, CCBot.")


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    bodies = [
        (f"{SITE}/maps/one.xml", f"<sitemapindex {ns}><sitemap><loc>{SITE}/maps/two.xml</loc></sitemap></sitemapindex>"),
        (f"{SITE}/maps/two.xml", f'<?xml version="1.0"?><urlset {ns}><url><loc>{SITE}/deep</loc></url><url><loc>https://other.com/x</loc></url></urlset>'),
        (f"{SITE}/sitemap.xml", f"<urlset><url><loc>{SITE}/a</loc></url><url><loc>{SITE}/b.pdf</loc></url><url><loc>{SITE}/b"),
    ]
    docs = spark.createDataFrame(bodies, "url string, body string")
    order = [r.url for r in sitefiles.sitemap_locations(files(spark)).filter(F.col("site") == SITE).orderBy("pos").collect()]
    assert order == [f"{SITE}/maps/one.xml", f"{SITE}/sitemap.xml", f"{SITE}/sitemap_index.xml"]
    got = sitefiles.sitemap_urls(files(spark), docs).orderBy("pos").collect()
    assert {r.url for r in got} == {f"{SITE}/a", f"{SITE}/deep"}
    assert sitefiles.sitemap_urls(files(spark), docs, max_urls=1).count() == 1


def test_responses_and_requests(spark):
    raw = spark.createDataFrame([("https://a/", 200, "Text/HTML; charset=x", "<p>", {"X-Robots-Tag": "y"}, None), ("https://b/", 200, "application/pdf", "%PDF", {}, None), ("https://c/", 200, "text/html", "x", {}, "timed out")], "url string, status int, content_type string, html string, headers map<string,string>, error string")
    rows = {r.url: r for r in responses(raw).collect()}
    assert rows["https://a/"].content_type == "text/html" and rows["https://a/"].headers == {"x-robots-tag": "y"} and rows["https://b/"].html == "" and rows["https://c/"].status == 0
    assert responses(raw).columns == [c.split(" ")[0] for c in PAGE.split(", ")]
    asked = request_bodies(spark.createDataFrame([('{"url": " a.com ", "concurrency": 99}',), ("no json",)], "body string")).collect()
    assert (asked[0].url, asked[0].concurrency, asked[0].max_pages) == ("https://a.com", 10, 25) and asked[1].url == ""


def test_reports(spark, tmp_path):
    rows = onpage.audit(as_pages(spark.createDataFrame([(SITE, html(title="é"), 0)], "url string, html string, seq bigint")))
    told = json.loads(reports.audit_envelope(rows, SITE, boundary.deterministic_summary(onpage.health(rows))).first().json)
    assert told["findings_count"] == len(told["findings"]) > 0 and told["summary"]["is_ai"] is False and told["url"] == SITE
    out = json.loads(reports.export_envelope(rows, "Audit", SITE).first().json)
    assert out["total_findings"] == told["findings_count"] and out["generated_at"]
    reports.write_json_document(onpage.in_order(rows), str(tmp_path / "new" / "audit.json"))
    text = (tmp_path / "new" / "audit.json").read_text()
    assert [f["metric"] for f in json.loads(text)] == [f["metric"] for f in told["findings"]] and "é" in text
    reports.write_json_lines(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == told["findings_count"]
    nap_rows = nap.report(contacts(spark, html(body='<a href="tel:555-111-2222">a</a>')))
    off = boundary.offsite_report(nap.canonical(nap.verdicts(contacts(spark, html()))), SITE)
    told = json.loads(reports.nap_envelope(nap_rows, SITE, off).first().json)
    assert told["fields"] == told["in_site"] and told["off_site"]["status"] == "no_llm" and told["off_site"]["citation_health_score"] is None


def test_model_boundary(spark):
    reply = lambda text: spark.createDataFrame([(text,)], "reply string")
    who = spark.createDataFrame([("Acme", "1 St", "5551234567")], "name string, address string, phone string")
    said = '<think>{no}</think> {"citations": [{"source": "Yelp", "name": "Acme"},], "citation_health_score": 90, "summary": "ok",}'
    row = boundary.offsite_report(who, SITE, reply(said)).first()
    assert (row.status, row.citation_health_score, row.citations[0].source, len(row.recommendations)) == ("success", 90, "Yelp", 2)
    assert boundary.offsite_report(who, SITE, reply("sorry")).first().status == "no_citations_found"
    choices = spark.createDataFrame([(1, 1, "u1", "exact words here"), (1, 9, "u9", "more")], "query_id long, n int, url string, text string")
    answer = lambda n, quote: spark.createDataFrame([(1, json.dumps({"passage_index": n, "verbatim_excerpt": quote, "direct_answer": ""}))], "query_id long, reply string")
    assert boundary.model_answers(choices, answer(1, "exact words")).first().excerpt == "exact words"
    assert boundary.model_answers(choices, answer(1, "other words")).count() == 0 and boundary.model_answers(choices, answer(9, "more")).count() == 0
    hits = spark.createDataFrame([("q", i, f"t{i}", f"u{i}", "b") for i in range(1, 8)], "query string, rank int, title string, href string, body string")
    assert boundary.search_text(hits).first().search_text.count("URL: ") == 5


def test_streams(spark, tmp_path):
    rows = [(f"{SITE}/a", html(), "2025-01-01 00:00:00"), (f"{SITE}/a", html(), "2025-01-01 00:01:00"), (f"{SITE}/b", "", "2025-01-01 00:20:00")]
    spark.createDataFrame(rows, "url string, html string, at string").select("url", "html", F.col("at").cast("timestamp").alias("captured_at")).write.parquet(str(tmp_path / "in"))
    stream = ingest.page_stream(spark, str(tmp_path / "in"), "url string, html string, captured_at timestamp")

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.url for r in run(ingest.first_captures(stream), "first", "append")) == [f"{SITE}/a", f"{SITE}/b"]
    assert sorted((r.outcome, r.n) for r in run(ingest.severity_windows(stream), "windows", "complete")) == [("empty", 1), ("served", 2)]
    got = {(r.page, r.metric) for r in run(ingest.findings_stream(ingest.first_captures(stream)), "found", "append")}
    assert (f"{SITE}/a", "viewport_missing") in got and (f"{SITE}/b", "http_error") in got


def queue_of(starts, edges, budget, shut):
    """One site's crawl by a plain queue: [(url, depth)] in the order fetched."""
    score = {u: 60 if "contact" in u else 50 if u.endswith(".com/") else 10 for u in [s[0] for s in starts] + [e[2] for e in edges]}
    waiting = sorted(((u, d) for u, d, _ in sorted(starts, key=lambda s: s[2])), key=lambda x: -score[x[0]])
    queued, out = {u for u, _ in waiting}, []
    while waiting and len(out) < budget:
        url, depth = waiting.pop(0)
        if any(url.endswith(s) for s in shut):
            continue
        out.append((url, depth))
        new = []
        for _, _, dst in sorted((e for e in edges if e[0] == url), key=lambda e: e[1]):
            if dst not in queued:
                queued.add(dst)
                new.append((dst, depth + 1))
        waiting += sorted(new, key=lambda x: -score[x[0]])
    return out


@pytest.mark.parametrize("budget", [None, 0, 1, 9, 40])
def test_crawl_plan_is_the_queue(spark, budget):
    """Drawn graphs of two sites; a seed that is queued before the root fixes a depth that isn't the shortest."""
    import random

    rnd, starts, edges, want = random.Random(3), [], [], []
    for site, n in (("https://a.com", 60), ("https://b.com", 25)):
        url = lambda i, site=site: f"{site}/" if i == 0 else f"{site}/contact/{i}" if i % 9 == 4 else f"{site}/p/{i}"
        own_starts = [(url(0), 0, -1), (url(4), 1, 0), (url(7), 1, 1), (url(13), 1, 2)]
        own_edges = [(url(rnd.randrange(n)), k, url(min(rnd.randrange(n), rnd.randrange(n)))) for k in range(3 * n)] + [(url(0), 900, url(5)), (url(4), 901, url(5))]
        want += [(site, k + 1, u, d) for k, (u, d) in enumerate(queue_of(own_starts, own_edges, 10**9 if budget is None else budget, ("/p/3", "/p/15")))]
        starts += [(site, *s) for s in own_starts]
        edges += own_edges
    body = "User-agent: any\n" + "".join(f"Allow: /p/{i}\n" for i in range(30, 40)) + "Disallow: /p/3\nDisallow: /p/15\n"
    files = spark.createDataFrame([(s, "/robots.txt", 200, body) for s in ("https://a.com", "https://b.com")], "site string, path string, status int, body string")
    graph = spark.createDataFrame(edges, "src_url string, pos long, dst_url string").repartition(3)
    plan = links.crawl_plan(spark.createDataFrame(starts, "site string, url string, depth int, pos long"), graph, budget, sitefiles.robots_rules(files), "AnyBot/1.0")
    assert sorted(tuple(r) for r in plan.collect()) == sorted(want)


def test_seeds(spark):
    roots = spark.createDataFrame([("s", "HTTPS://A.com"), ("t", "https://t.com/")], "site string, url string")
    listed = spark.createDataFrame([("s", 2, "https://a.com/x"), ("s", 1, "https://www.a.com/y"), ("s", 3, "https://a.com/x"), ("s", 4, "https://other.com/z"), ("s", 5, "https://a.com/"), ("s", 6, "https://a.com/w")], "site string, pos long, url string")
    assert sorted(tuple(r) for r in links.seeds(roots, listed, 2).collect()) == [("s", "https://a.com/", 0, -1), ("s", "https://a.com/x", 1, 2), ("s", "https://www.a.com/y", 1, 1), ("t", "https://t.com/", 0, -1)]
    assert links.seeds(roots, listed).count() == 5
    assert links.crawl_plan(links.seeds(roots, listed).limit(0), spark.createDataFrame([], "src_url string, pos long, dst_url string")).count() == 0


@pytest.mark.parametrize("k,block_docs,query_part", [(1, 4096, 4096), (4, 5, 7), (50, 64, 4096)])
def test_leading_is_the_top_of_all_scores(spark, monkeypatch, k, block_docs, query_part):
    """Drawn texts and questions: ties, phrases, legal URLs and questions, repeated words, questions without words or hits."""
    import random

    monkeypatch.setattr(search, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(search, "QUERY_PART", query_part)
    rnd = random.Random(k)
    words = ["alpha", "alphas", "beta", "gamma", "delta", "refund", "term", "the", "stories", "story", "x", "running", "runs", "omega", "zeta", "eta"]
    docs = [(i, rnd.choice(("https://a.com/terms", "https://a.com/p", "https://a.com/Privacy")), " ".join(rnd.choices(words, k=rnd.choice((1, 3, 8, 40))))) for i in range(300)]
    docs += [(1000 + i, "https://a.com/p", "alpha beta gamma") for i in range(5)] + [(2000, "https://a.com/p", ""), (2001, "https://a.com/p", "the of")]
    asked = [(q, " ".join(rnd.choices(words, k=rnd.choice((1, 2, 3, 6))))) for q in range(40)] + [(90, "alpha beta gamma"), (91, ""), (92, "nowhere found"), (93, "refund terms"), (94, "the of")]
    d, q = spark.createDataFrame(docs, "doc_id long, url string, text string").repartition(3), spark.createDataFrame(asked, "query_id long, query string")
    for url in (None, "url"):
        want = search.top_k(search.scores(d, q, "doc_id", url), k).select("query_id", "rank", "doc", "score", "coverage", "matched")
        got = search.leading(d, q, k, "doc_id", url)
        plain = lambda df: sorted((r.query_id, r["rank"], r.doc, round(r.score, 7), round(r.coverage, 9), r.matched) for r in df.collect())
        assert plain(got) == plain(want) and got.columns == want.columns
    assert search.leading(d.limit(0), q, k).count() == 0 and search.leading(d, q.limit(0), k).count() == 0


def test_blocks_that_cannot_win_are_not_opened():
    import numpy as np

    contest = search.Contest([np.array([0, 1]), np.array([2])], np.zeros(2), np.zeros(2, bool), 2, 0.5, 1e-9)
    strong = (np.repeat(np.arange(5), 2), np.tile([0, 1], 5), np.full(10, 4.0), np.zeros(10, bool))
    contest.block(*strong, 3)
    assert contest.opened == 1 and contest.floor[0] == 8.0 and contest.skipped == 1  # no document has the second question's stem
    contest.block(np.arange(100, 140), np.tile([0, 1], 20), np.full(40, 3.9), np.zeros(40, bool), 3)
    assert contest.opened == 1 and sorted(contest.found[0][0].tolist()) == [0, 1, 2, 3, 4]  # its best sum is 7.8
