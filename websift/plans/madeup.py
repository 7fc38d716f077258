"""Made-up pages on which every page rule, contact source and passage kind fires, and what each of them should give.

The given tables hold few of the cases that the rules are about. Here a customer's key picks a case and its page; the SQL
side is the list of what the case's author expects, laid out by the same keys.
"""

from __future__ import annotations

import random
from urllib.robotparser import RobotFileParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, spread
from ..operators import nap, onpage, search
from ..sources import sitefiles
from ..sources.pages import as_pages

WORDS = " ".join(f"word{i}" for i in range(130))
DESCRIPTION = "A description of more than fifty and fewer than a hundred and sixty letters."
#: A page on which no rule fires.
SOUND = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>A title of a sound length</title>'
    f'<meta name="description" content="{DESCRIPTION}"><meta name="viewport" content="width=device-width">'
    '<link rel="canonical" href="https://a.example.com/p"><meta property="og:title" content="t"><meta property="og:image" content="i">'
    f"</head><body><h1>Head</h1><h2>Sub</h2><p>{WORDS}</p></body></html>"
)


def robots_file(seed: int) -> str:
    """A robots.txt of up to 14 lines drawn from everything that the format's readers tell apart."""
    rnd = random.Random(seed)
    agents = ("*", "GPTBot", "gptbot/2", "Other", "bot", "", "* ")
    paths = ("/", "/private", "/open", "", "*", "/a%20b", "/a%2Fb", "/%7Eme", "/p?q=1", "/caf%C3%A9", "private", "/x;", "/+", "/%zz", "/open/")
    lines = []
    for _ in range(rnd.randint(1, 14)):
        key = rnd.choice(("User-agent", "User-agent", "user-AGENT ", "Disallow", "Disallow", "Allow", "Crawl-delay", "Request-rate", "Sitemap", "Unknown", "empty", "empty", "spaces", "comment", "bare"))
        value = {"user": rnd.choice(agents), "disa": rnd.choice(paths), "allo": rnd.choice(paths), "craw": rnd.choice(("10", "x")), "requ": rnd.choice(("1/5", "y")), "site": "https://r.example.com/map.xml"}.get(key[:4].lower(), "v")
        lines.append({"empty": "", "spaces": "  \t", "comment": "# nothing", "bare": "Disallow"}.get(key) if key in ("empty", "spaces", "comment", "bare") else f"{rnd.choice(('', ' '))}{key}:{rnd.choice(('', ' '))}{value}{rnd.choice(('', '', ' ', ' # c'))}")
    return rnd.choice(("\n", "\n", "\r\n", "\r")).join(lines) + rnd.choice(("", "\n"))


ROBOTS_AGENT = "GPTBot/1.0 (+https://example.com)"
ROBOTS_PATHS = ("/", "/private/x", "/open?q=1", "/a%20b", "/a/b", "/~me", "/caf\u00e9#top", "/p?q=1&r", "/x;y/+", "/%zz?#")
#: Two groups of one agent; an empty line before the rules; a delay alone; a delay between two agents; then drawn ones.
ROBOTS_FILES = (
    "User-agent: GPTBot\nDisallow: /private\n\nUser-agent: GPTBot\nDisallow: /\n",
    "User-agent: GPTBot\n\nDisallow: /\n",
    "User-agent: GPTBot\nCrawl-delay: 5\n\nUser-agent: *\nDisallow: /\n",
    "User-agent: GPTBot\nCrawl-delay: 5\nUser-agent: Other\nDisallow: /\n",
    "User-agent: *\nDisallow: /private\nUser-agent: *\nDisallow: /\n",
    "User-agent: *\nUser-agent: GPTBot\nDisallow: /open\n\nUser-agent: gpt\nAllow: /\n",
    *map(robots_file, range(44)),
)


def _swap(old: str, new: str) -> str:
    assert old in SOUND
    return SOUND.replace(old, new)


def _add(html: str) -> str:
    return _swap("<h2>", html + "<h2>")


_TITLE, _META, _CANONICAL, _H1 = "<title>A title of a sound length</title>", f'<meta name="description" content="{DESCRIPTION}">', '<link rel="canonical" href="https://a.example.com/p">', "<h1>Head</h1>"
_VIEWPORT, _CHARSET, _HEAD_END = '<meta name="viewport" content="width=device-width">', '<meta charset="utf-8">', "</head>"
_LONG = "x" * 161
#: An attribute without a value, as in <script defer>, counts as absent there.
#: (page, path, response seconds, X-Robots-Tag, what fires: metric, severity, evidence).
RULE_CASES: tuple[tuple[str, str, float, str, tuple[tuple[str, str, str], ...]], ...] = (
    (SOUND, "/p", 0.5, "", ()),
    (SOUND, "/p", 2.75, "", (("slow_server_response", "low", "Server response time was 2.75s, exceeding recommended 2.5s threshold."),)),
    (SOUND, "/p", 2.5, "NoIndex, nofollow", (("x_robots_noindex", "high", 'HTTP response header X-Robots-Tag is "NoIndex, nofollow".'),)),
    (_add("<i></i>" * 1500), "/p", 0.5, "", (("excessive_dom_size", "low", "Document contains 1513 DOM elements (recommended maximum is 1,500)."),)),
    (_swap(_HEAD_END, '<script src="a.js"></script><script src="b.js" defer></script><script src="c.js" defer="defer"></script><script src="d.js" type="module"></script></head>'), "/p", 0.5, "", (("render_blocking_script", "low", "Found 2 parser-blocking script(s) in <head>: ['a.js', 'b.js']."),)),
    (_swap(' lang="en"', ""), "/p", 0.5, "", (("html_lang_missing", "low", "The root <html> element is missing a 'lang' attribute."),)),
    (_swap(_CHARSET, ""), "/p", 0.5, "", (("charset_missing", "low", 'No <meta charset="..."> or http-equiv Content-Type tag was found in <head>.'),)),
    (_swap(_TITLE, ""), "/p", 0.5, "", (("title_missing", "high", "No <title> tag found in the document."),)),
    (_swap(_TITLE, _TITLE + "<title>Other</title>"), "/p", 0.5, "", (("multiple_titles", "medium", "Found 2 <title> tags: ['A title of a sound length', 'Other']."),)),
    (_swap(_TITLE, "<title> \n </title>"), "/p", 0.5, "", (("title_empty", "high", "The <title> element exists but is empty or contains only whitespace."),)),
    (_swap(_TITLE, "<title>Fourteen chars</title>"), "/p", 0.5, "", (("title_too_short", "low", 'Title length is only 14 characters: "Fourteen chars".'),)),
    (_swap(_TITLE, f"<title>{'t' * 61}</title>"), "/p", 0.5, "", (("title_too_long", "low", f'Title length is 61 characters (exceeds 60): "{"t" * 61}".'),)),
    (_swap(_META, ""), "/p", 0.5, "", (("meta_description_missing", "medium", 'No <meta name="description"> tag found on the page.'),)),
    (_swap(_META, _META + _META), "/p", 0.5, "", (("multiple_meta_descriptions", "medium", "Found 2 meta description tags."),)),
    (_swap(_META, '<meta name="Description" content="  ">'), "/p", 0.5, "", (("meta_description_empty", "medium", 'The <meta name="description"> tag exists but its content attribute is empty.'),)),
    (_swap(_META, '<meta name="description" content="Too short.">'), "/p", 0.5, "", (("meta_description_too_short", "low", 'Meta description is only 10 characters: "Too short.".'),)),
    (_swap(_META, f'<meta name="description" content="{_LONG}">'), "/p", 0.5, "", (("meta_description_too_long", "low", "Meta description is 161 characters, exceeding the 160 character limit."),)),
    (_swap(_H1, ""), "/p", 0.5, "", (("h1_missing", "medium", "No <h1> heading tag was found in the page markup."),)),
    (_swap(_H1, _H1 + "<h1>Two</h1>"), "/p", 0.5, "", (("multiple_h1", "low", "Found 2 <h1> elements: ['Head', 'Two']."),)),
    (_swap(_H1, "<h1> <b></b> </h1>"), "/p", 0.5, "", (("empty_h1", "medium", "The <h1> element contains no visible text."),)),
    (_swap("<h2>Sub</h2>", "<h3>Sub</h3>"), "/p", 0.5, "", (("heading_hierarchy_skip", "low", "Document contains 1 <h3> elements but no <h2> elements."),)),
    (_swap(_CHARSET, _CHARSET + '<meta name="robots" content="noindex, follow">'), "/p", 0.5, "", (("robots_noindex", "high", '<meta name="robots" content="noindex, follow"> contains "noindex".'),)),
    (_swap(_CHARSET, _CHARSET + '<meta name="robots" content="index, nofollow">'), "/p", 0.5, "", (("robots_nofollow", "medium", '<meta name="robots" content="index, nofollow"> contains "nofollow".'),)),
    (_swap(_CANONICAL, ""), "/p", 0.5, "", (("canonical_missing", "medium", 'No <link rel="canonical"> tag found in the document <head>.'),)),
    (_swap(_CANONICAL, _CANONICAL + _CANONICAL), "/p", 0.5, "", (("multiple_canonicals", "high", "Found 2 conflicting canonical link tags."),)),
    (_swap(_CANONICAL, '<link rel="alternate canonical" href="">'), "/p", 0.5, "", (("canonical_empty", "medium", 'The <link rel="canonical"> tag has an empty href attribute.'),)),
    (_swap(_CANONICAL, '<link rel="canonical" href="/p">'), "/p", 0.5, "", (("canonical_relative", "low", 'Canonical href is a relative path "/p" instead of an absolute URL.'),)),
    (_swap(_VIEWPORT, ""), "/p", 0.5, "", (("viewport_missing", "high", 'No <meta name="viewport"> tag found.'),)),
    (_swap(_VIEWPORT, '<meta name="viewport" content="user-scalable=no">'), "/p", 0.5, "", (("viewport_restrictive", "low", 'Viewport disables zoom: content="user-scalable=no".'),)),
    (_add('<img src="a.png" width="1" height="1"><img src="b.png" alt="" width="1" height="1">'), "/p", 0.5, "", (("image_alt_missing", "medium", "1 image(s) completely lack an 'alt' attribute. Sample src: ['a.png']."),)),
    (_add('<img src="a.png" alt="">' * 4), "/p", 0.5, "", (("image_dimensions_missing", "low", "4 image(s) lack explicit width/height attributes (Cumulative Layout Shift risk)."),)),
    (_add('<a href="javascript:void(0)">x</a>'), "/p", 0.5, "", (("javascript_link", "low", "Found 1 navigation link(s) using 'javascript:' protocol: ['javascript:void(0)']."),)),
    (_add('<a href="#">x</a><a href="">y</a>' * 2), "/p", 0.5, "", (("empty_href_links", "low", 'Found 4 anchor elements with empty href or href="#".'),)),
    (_add('<a href="http://b.example.com/">x</a>'), "/p", 0.5, "", (("mixed_content_link", "low", "HTTPS page contains 1 insecure HTTP link(s): ['http://b.example.com/']."),)),
    (_swap(WORDS, "few words"), "/p", 0.5, "", (("thin_content_signal", "low", "Page contains approximately 10 visible words, which may signal thin content to search engines."),)),
    (_swap('<meta property="og:title" content="t">', ""), "/p", 0.5, "", (("open_graph_title_missing", "low", 'No Open Graph <meta property="og:title"> found.'),)),
    (_swap('<meta property="og:image" content="i">', ""), "/p", 0.5, "", (("open_graph_image_missing", "low", 'No Open Graph <meta property="og:image"> found.'),)),
    (SOUND, "/", 0.5, "", (("structured_data_missing", "low", "Homepage lacks Schema.org structured data (neither JSON-LD nor Microdata detected)."),)),
    (_swap(_CANONICAL, _CANONICAL + '<link rel="alternate" hreflang="de" href="/de"><link rel="alternate" hreflang="fr" href="https://a.example.com/fr">'), "/p", 0.5, "", (("hreflang_non_absolute", "low", 'hreflang="de" target is not an absolute URL: "/de".'),)),
)

#: (markup, what it states: field, value, source); {k} is the customer's key.
CONTACT_CASES: tuple[tuple[str, tuple[tuple[str, str, str], ...]], ...] = (
    ('<script type="application/ld+json">{"@type": "Store", "name": "Shop {k}", "telephone": "+1 555 010 0000", "address": {"streetAddress": "1 Elm St", "addressLocality": "Reno"}}</script>',
     (("name", "Shop {k}", "jsonld"), ("phone", "+1 555 010 0000", "jsonld"), ("address", "1 Elm St, Reno", "jsonld"))),
    ('<script type="application/ld+json">{"@graph": [{"@type": ["Thing"], "name": "no"}, {"@type": ["Organization"], "legalName": "Firm {k}"}]}</script>', (("name", "Firm {k}", "jsonld"),)),
    ('<script type="application/ld+json">{broken</script><p>nothing</p>', ()),
    ('<div itemscope><span itemprop="name">Micro {k}</span><meta itemprop="telephone" content="555-010-0001"><p itemprop="address">2 Oak Ave</p></div>',
     (("name", "Micro {k}", "microdata"), ("phone", "555-010-0001", "microdata"), ("address", "2 Oak Ave", "microdata"))),
    ("<address>  3 Pine \n Road, Town {k} </address><address>short</address>", (("address", "3 Pine Road, Town {k}", "html_address"),)),
    ('<a href="TEL:+15550100002?x=1">call</a><a href="mailto:a@b.c">write</a>', (("phone", "+15550100002", "tel_link"),)),
    ('<meta property="og:site_name" content="Site {k}">', (("name", "Site {k}", "og_site_name"),)),
    ('<header><a href="/">Brand {k}</a><a href="/about">About us</a></header><nav><a class="Logo" href="/x"><b>Nav {k}</b></a><a href="/">Home</a></nav>', (("name", "Brand {k}", "header_brand"), ("name", "Nav {k}", "header_brand"))),
    ('<img src="/logo.png" alt="Pic {k} logo"><img src="/x.png" class="brand" alt="Logo"><img src="/y.png" alt="Other">', (("name", "Pic {k}", "logo_alt"),)),
    ('<footer class="site-footer">© 2020-2024 Foot {k}. All rights reserved. Call (555) 010-0003</footer>', (("name", "Foot {k}", "footer_copyright"), ("phone", "(555) 010-0003", "footer_text"))),
    ('<div class="contact">12 Long Street, Springfield 12345</div>', (("address", "12 Long Street, Springfield 12345", "footer_address"),)),
    ("<footer>© 2020 Unmarked {k}.</footer>", ()),
)

#: A page and its passages in order.
PASSAGE_PAGE = (
    '<html><head><meta name="description" content="What this page is all about, in short."></head><body><nav><p>A paragraph that stands in the navigation</p></nav>'
    "<h2>Opening hours</h2><p>We open at nine in the morning of customer {k}.</p><div><h3>No body</h3></div>"
    "<ul><li>The first item of a list of things</li><li>short</li></ul><div>A box without any block in it, long enough</div><div><p>A paragraph in a box, taken once only</p></div>"
    "<p>A paragraph in a box, taken once only</p><footer><p>A paragraph that stands in the footer</p></footer></body></html>"
)
PASSAGES = (
    "Opening hours: We open at nine in the morning of customer {k}.",
    "We open at nine in the morning of customer {k}.",
    "The first item of a list of things",
    "A paragraph in a box, taken once only",
    "A box without any block in it, long enough",
    "What this page is all about, in short.",
)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k")))


def _cases(spark: SparkSession, sf_dir: str, html: tuple[str, ...]) -> DataFrame:
    """(k, case, html): a key's case and page; the cases are a literal in the plan."""
    case = (F.col("k") % len(html)).cast("int")
    page = F.element_at(F.array(*map(F.lit, html)), case + 1)
    return _keys(spark, sf_dir).select("k", case.alias("case"), F.replace(page, F.lit("{k}"), F.col("k").cast("string")).alias("html"))


def rule_cases(spark, sf_dir):
    """Every page rule on a page made for it, with evidence."""
    at = F.col("case") + 1
    pick = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in RULE_CASES)), at)
    rows = _cases(spark, sf_dir, tuple(c[0] for c in RULE_CASES))
    pages = rows.select(
        F.col("k").alias("seq"), F.concat(F.lit("https://c"), F.col("k").cast("string"), F.lit(".example.com"), pick(1)).alias("url"), "html", F.lit(200).alias("status"),
        pick(2).alias("response_time"), F.create_map(F.lit("x-robots-tag"), pick(3)).alias("headers"),
    )
    return onpage.page_findings(onpage.facts_of(as_pages(pages))).select("seq", "metric", "severity", "page", "evidence")


def sitemap_orphans(spark, sf_dir):
    """Orphans of a sitemap, and failures with the page that led to them."""
    k = F.col("k")
    url = F.concat(F.lit("https://a.example.com/"), k.cast("string"))
    pages = _keys(spark, sf_dir).select(
        k.alias("seq"), url.alias("url"), F.when(k % 7 == 0, "").otherwise("<p>x</p>").alias("html"), F.when(k % 7 == 0, 404).otherwise(200).alias("status"), (k % 3).cast("int").alias("depth"),
        F.when(k % 2 == 1, F.array(F.lit("https://a.example.com/hub"), F.lit("https://a.example.com/other"))).otherwise(F.array().cast("array<string>")).alias("referrers"),
    )
    listed = _keys(spark, sf_dir).filter(k % 5 < 3).select(url.alias("url"))
    return onpage.crawl_findings(as_pages(pages), listed).select("seq", "metric", "severity", "page", "evidence")


def shared_descriptions(spark, sf_dir):
    """Descriptions that several pages share; titles are all their own."""
    k = F.col("k")
    html = F.concat(F.lit("<title>Page "), k.cast("string"), F.lit('</title><meta name="description" content="The description of group '), (k % 9).cast("string"), F.lit(', which goes on for a good many letters">'))
    pages = _keys(spark, sf_dir).select(k.alias("seq"), F.concat(F.lit("https://a.example.com/"), k.cast("string")).alias("url"), html.alias("html"), F.lit(200).alias("status"))
    return onpage.cross_page_findings(onpage.facts_of(as_pages(pages))).select("page", "metric", "severity", "evidence")


def contact_cases(spark, sf_dir):
    """Every source of names, addresses and phones on markup made for it."""
    rows = _cases(spark, sf_dir, tuple(c[0] for c in CONTACT_CASES)).withColumn("seq", F.col("k")).withColumn("url", F.concat(F.lit("https://a.example.com/"), F.col("k").cast("string")))
    return nap.page_candidates(as_pages(rows)).select("seq", "page", "field", "value", "source")


def contact_verdicts(spark, sf_dir):
    """A site that states one name and phone everywhere, and two addresses."""
    k = F.col("k")
    html = F.concat(
        F.lit('<meta property="og:site_name" content="One Firm"><script type="application/ld+json">{"@type": "Store", "name": "One Firm, Inc.", "telephone": "(555) 010-0009"}</script>'),
        F.lit('<a href="tel:+1-555-010-0009">call</a><address>'), F.when(k % 3 == 0, "9 Elm Street, Reno").otherwise("8 Elm Street, Reno"), F.lit("</address>"),
    )
    pages = _keys(spark, sf_dir).select(k.alias("seq"), F.concat(F.lit("https://a.example.com/"), k.cast("string")).alias("url"), html.alias("html"))
    cols = ("n_values", "n_pages", "n_sources", "n_candidates")
    return nap.verdicts(cut(nap.page_candidates(as_pages(pages)), "candidates")).select("field", "verdict", "confidence", *(F.col(c).cast("long").alias(c) for c in cols), "value")


def passage_cases(spark, sf_dir):
    """Every kind of passage, in order, each once a page; navigation and footer give none."""
    rows = _cases(spark, sf_dir, (PASSAGE_PAGE,)).withColumn("seq", F.col("k")).withColumn("url", F.concat(F.lit("https://a.example.com/"), F.col("k").cast("string")))
    return search.page_passages(as_pages(rows.withColumn("status", F.lit(200)))).select("seq", F.col("pos").cast("long").alias("pos"), "text")


def robots_cases(spark, sf_dir):
    """What a crawler may fetch of sites whose robots.txt uses every state of the format, delays, blank lines and escapes among them."""
    k = F.col("s_suppkey")
    site = F.concat(F.lit("https://r"), k.cast("string"), F.lit(".example.com"))
    body = F.element_at(F.array(*map(F.lit, ROBOTS_FILES)), (k % len(ROBOTS_FILES) + 1).cast("int"))
    files = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(site.alias("site"), F.lit("/robots.txt").alias("path"), F.lit(200).alias("status"), body.alias("body"))
    asked = files.select("site", F.explode(F.array(*map(F.lit, ROBOTS_PATHS))).alias("path")).select("site", F.concat("site", "path").alias("url"))
    return sitefiles.allowed(asked, sitefiles.robots_rules(files), ROBOTS_AGENT).select("url", "allowed")


ALL = (rule_cases, sitemap_orphans, shared_descriptions, contact_cases, contact_verdicts, passage_cases, robots_cases)


def robots_verdicts(body: str, paths: tuple[str, ...] = ROBOTS_PATHS, agent: str = ROBOTS_AGENT) -> list[bool]:
    """The standard library's answer for each path of a site."""
    parser = RobotFileParser()
    parser.parse(body.splitlines())
    return [parser.can_fetch(agent, "https://r.example.com" + p) for p in paths]


def oracle_sql() -> dict[str, str]:
    fetched = ", ".join(f"({i}, {_quote(p)}, {ok})" for i, body in enumerate(ROBOTS_FILES) for p, ok in zip(ROBOTS_PATHS, robots_verdicts(body), strict=True))
    fired = ", ".join(f"({i}, {_quote(c[1])}, {_quote(m)}, {_quote(s)}, {_quote(e)})" for i, c in enumerate(RULE_CASES) for m, s, e in c[4])
    stated = ", ".join(f"({i}, {_quote(f)}, {_quote(v)}, {_quote(s)})" for i, c in enumerate(CONTACT_CASES) for f, v, s in c[1])
    texts = ", ".join(f"({i}, {_quote(t)})" for i, t in enumerate(PASSAGES))
    return {
        "rule_cases": f"""SELECT c_custkey::BIGINT AS seq, metric, severity, 'https://c' || c_custkey || '.example.com' || path AS page, evidence
FROM customer JOIN (VALUES {fired}) AS r(n, path, metric, severity, evidence) ON c_custkey % {len(RULE_CASES)} = n""",
        "sitemap_orphans": """WITH p AS (SELECT c_custkey::BIGINT AS seq, 'https://a.example.com/' || c_custkey AS page, c_custkey AS k FROM customer)
SELECT seq, 'orphan_page_in_sitemap' AS metric, 'medium' AS severity, page, 'URL was discovered in sitemap.xml but has zero internal links pointing to it from crawled pages.' AS evidence
FROM p WHERE k % 5 < 3 AND k % 3 > 0 AND k % 2 = 0
UNION ALL SELECT seq, 'http_error', 'high', page, 'HTTP response status is 404.' || CASE WHEN k % 2 = 1 THEN ' Discovered via link on https://a.example.com/hub.' ELSE '' END FROM p WHERE k % 7 = 0""",
        "shared_descriptions": """WITH p AS (SELECT c_custkey % 9 AS g, 'https://a.example.com/' || c_custkey AS page FROM customer), n AS (SELECT g, count(*) AS n FROM p GROUP BY g HAVING count(*) > 1)
SELECT page, 'duplicate_meta_description' AS metric, 'low' AS severity, 'Meta description "' || substr('The description of group ' || g || ', which goes on for a good many letters', 1, 50) || '..." is duplicated across ' || n || ' pages.' AS evidence FROM p JOIN n USING (g)""",
        "contact_cases": f"""SELECT c_custkey::BIGINT AS seq, 'https://a.example.com/' || c_custkey AS page, field, replace(value, '{{k}}', c_custkey::VARCHAR) AS value, source
FROM customer JOIN (VALUES {stated}) AS r(n, field, value, source) ON c_custkey % {len(CONTACT_CASES)} = n""",
        "contact_verdicts": """WITH n AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 3 = 0) AS third, min(c_custkey) AS first FROM customer)
SELECT 'name' AS field, 'consistent' AS verdict, 0.99::DOUBLE AS confidence, 1::BIGINT AS n_values, n AS n_pages, 2::BIGINT AS n_sources, 2 * n AS n_candidates, 'One Firm, Inc.' AS value FROM n
UNION ALL SELECT 'address', 'mismatch', 0.94, 2, n, 1, n, '8 Elm Street, Reno' FROM n
UNION ALL SELECT 'phone', 'consistent', 0.99, 1, n, 2, 2 * n, '(555) 010-0009' FROM n""",
        "robots_cases": f"""SELECT 'https://r' || s_suppkey || '.example.com' || path AS url, allowed FROM supplier JOIN (VALUES {fetched}) AS r(n, path, allowed) ON s_suppkey % {len(ROBOTS_FILES)} = n""",
        "passage_cases": f"SELECT c_custkey::BIGINT AS seq, pos::BIGINT AS pos, replace(text, '{{k}}', c_custkey::VARCHAR) AS text FROM customer, (VALUES {texts}) AS t(pos, text)",
    }
