"""DuckDB SQL that states the registered queries over the raw tables, by pattern where the engine parses."""

from __future__ import annotations

from ..functions.textnorm import ADDRESS_WORDS, CORPORATE
from ..functions.tokens import ENDINGS, STOPWORDS
from ..functions.urls import BLOCKED_EXTENSIONS, CONTACT_WORDS, POLICY_WORDS
from ..operators.nap import PHONE
from ..operators.rules import BOTS, LABELS, TITLE_FIX
from ..operators.search import LEGAL_QUERY

#: What supplier keys are made into names and addresses with.
SUFFIXES = (" Inc.", ", LLC", "  GmbH & Co", " Corporation", "", " (Ltd)")
STREETS = (" North Main Street, Suite 200", " East Park Avenue", " Lakeside Blvd., Floor 3", " W. Market Place", " Old Mill Road\tBuilding 7")

#: The robots.txt files, sitemaps and media types of made-up sites; {site} is a site's root.
ROBOTS = ("User-agent: *\nDisallow: /private\nAllow: /\n", "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nDisallow:\n", " \n", "User-agent: *\nDisallow: /\nSitemap: {site}/map.xml\n")
SITEMAPS = (
    ("/sitemap.xml", "<urlset><url><loc>{site}/first</loc></url><url><loc>{site}/x.pdf</loc></url><url><loc>https://other.example.org/y</loc></url></urlset>"),
    ("/sitemap_index.xml", "<sitemapindex><sitemap><loc>{site}/deep.xml</loc></sitemap></sitemapindex>"),
    ("/deep.xml", "<urlset><url><loc>{site}/first</loc></url><url><loc>{site}/deep</loc></url></urlset>"),
)
MEDIA_TYPES = ("Text/HTML; charset=utf-8", " application/xhtml+xml ", "application/pdf")


#: What the sitemap of a made-up shop lists, its robots.txt, and how many pages a crawl of it may fetch.
SHOP_SITEMAP = ("/supplier/3", "/store/part/7", "/", "/part/1")
SHOP_ROBOTS = "User-agent: *\nDisallow: /part/1\nDisallow: /supplier/2\n"
SHOP_BUDGET = 400


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(t: str) -> str:
    plain = rf"regexp_replace(lower({t}), '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{N}}]', '_', 'g')"
    return rf"regexp_extract_all({plain}, '\b[a-z0-9][a-z0-9''-]*\b')"


def _stem(t: str) -> str:
    one = f"CASE WHEN {t} LIKE '%sses' THEN left({t}, len({t}) - 2) WHEN {t} LIKE '%ies' THEN left({t}, len({t}) - 3) || 'y' WHEN {t} LIKE '%s' AND {t} NOT LIKE '%ss' AND {t} NOT LIKE '%us' AND {t} NOT LIKE '%is' THEN left({t}, len({t}) - 1) ELSE {t} END"
    ends = " ".join(f"WHEN s1 LIKE '%{e}' AND len(s1) - {len(e)} >= 3 THEN left(s1, len(s1) - {len(e)})" for e in ENDINGS)
    cut = f"(SELECT CASE {ends} ELSE s1 END FROM (SELECT {one} AS s1))"
    return f"CASE WHEN len({t}) <= 3 THEN {t} ELSE regexp_replace({cut}, '^(.{{3,}})e$', '\\1') END"


STOP = "(" + ", ".join(map(_quote, STOPWORDS)) + ")"

TOKENS = f"""
words AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
raw AS (SELECT doc_id, unnest(w) AS t FROM words),
vocabulary AS (SELECT t, {_stem("t")} AS stem FROM (SELECT DISTINCT t FROM raw WHERE t NOT IN {STOP})),
toks AS (SELECT doc_id, stem FROM raw JOIN vocabulary USING (t)),
lengths AS (SELECT doc_id, count(*) AS length FROM toks GROUP BY doc_id),
stats AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM lengths),
dfs AS (SELECT stem, count(DISTINCT doc_id) AS df FROM toks GROUP BY stem)
"""

SCORED = f"""{TOKENS},
q AS (SELECT item_id AS query_id, trim(coalesce(text, '')) AS query, list_filter({_words("trim(coalesce(text, ''))")}, lambda t: t NOT IN {STOP} AND len(t) > 1) AS tokens FROM benchmark),
qt AS (SELECT DISTINCT query_id, stem FROM (SELECT query_id, unnest(tokens) AS t FROM q) JOIN (SELECT t, {_stem("t")} AS stem FROM (SELECT DISTINCT unnest(tokens) AS t FROM q)) USING (t)),
qn AS (SELECT query_id, count(*) AS n_stems FROM qt GROUP BY query_id),
tf AS (SELECT doc_id, stem, count(*) AS tf FROM toks WHERE stem IN (SELECT stem FROM qt) GROUP BY doc_id, stem),
base AS (
  SELECT query_id, doc_id AS doc, count(*) AS matched,
         sum(ln(1.0::DOUBLE + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (length / greatest(1.0::DOUBLE, avg_length))))) AS base
  FROM tf JOIN dfs USING (stem) JOIN qt USING (stem) JOIN lengths USING (doc_id), stats GROUP BY query_id, doc_id
),
scored AS (
  SELECT query_id, doc, matched, matched / greatest(1, n_stems) AS coverage, len(tokens) AS n_tokens,
         base + CASE WHEN len(tokens) >= 2 AND contains(array_to_string(w, ' '), array_to_string(tokens, ' ')) THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM base JOIN q USING (query_id) JOIN qn USING (query_id) JOIN words ON words.doc_id = doc
),
ranked AS (
  SELECT query_id, doc, matched, coverage, n_tokens, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc) AS rank
  FROM scored WHERE score > 0.5
)
"""

_ASKED = "trim(coalesce(text, '') || CASE WHEN item_id % 4 = 0 THEN ' refund policy' ELSE '' END)"
_LEGAL = f"CASE WHEN doc % 3 = 0 AND NOT list_has_any(tokens, [{', '.join(map(_quote, LEGAL_QUERY))}]) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
LEGAL = SCORED.replace("trim(coalesce(text, ''))", _ASKED).replace("base + CASE", "(base + CASE").replace("END AS score", f"END) * {_LEGAL} AS score")

MODEL = f"""WITH {SCORED},
best AS (SELECT query_id, 0 AS tier, rank AS place, doc, text FROM ranked JOIN documents ON doc_id = doc WHERE rank <= 8),
fill AS (SELECT text, min(doc_id) AS doc FROM documents JOIN lengths USING (doc_id) WHERE len(text) >= 40 GROUP BY text ORDER BY doc LIMIT 20),
both_ AS (SELECT * FROM best UNION ALL SELECT query_id, 1, doc, doc, text FROM q, fill WHERE len(tokens) > 0),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY tier, place) AS o FROM both_),
listed AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, place) AS n, doc FROM once WHERE o = 1)
SELECT query_id, n, doc FROM listed WHERE n <= 12"""

BODY = r"""
bodies AS (
  SELECT page_id AS seq, url, regexp_replace(regexp_replace(regexp_replace(html, '(?is)(<script[^>]*>).*?</script>', '\1</script>', 'g'), '(?is)(<style[^>]*>).*?</style>', '\1</style>', 'g'), '(?s)<!--.*?-->', '', 'g') AS body
  FROM pages WHERE length(html) > 0
),
f AS (
  SELECT *, len(regexp_extract_all(body, '<[a-zA-Z]')) AS n_nodes,
         regexp_matches(body, '(?i)<title') AS titled,
         replace(replace(trim(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1)), '&amp;', '&'), '&middot;', '·') AS title,
         len(regexp_extract_all(regexp_replace(regexp_replace(body, '<[^>]*>?', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '[\p{L}\p{N}_\p{M}][\p{L}\p{N}_\p{M}’''-]*')) AS n_words,
         len(regexp_extract_all(body, '(?i)<h1[ >]')) AS n_h1,
         len(list_filter(regexp_extract_all(body, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1), lambda h: h IN ('', '#'))) AS n_empty,
         regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) IN ('', '/') AS is_root
  FROM bodies
)
"""
_META = {"meta_description_missing": ("medium", "description"), "viewport_missing": ("high", "viewport"), "open_graph_title_missing": ("low", "og:title"), "open_graph_image_missing": ("low", "og:image")}
_RULES = [
    ("excessive_dom_size", "low", "n_nodes > 1500"),
    ("html_lang_missing", "low", r"NOT regexp_matches(body, '(?i)<html[^>]*\slang\s*=\s*\"[^\"]')"),
    ("charset_missing", "low", r"NOT regexp_matches(body, '(?i)<meta[^>]*\scharset')"),
    ("title_missing", "high", "NOT titled"),
    ("title_empty", "high", "titled AND title = ''"),
    ("title_too_short", "low", "length(title) BETWEEN 1 AND 14"),
    ("title_too_long", "low", "length(title) > 60"),
    ("h1_missing", "medium", "n_h1 = 0"),
    ("multiple_h1", "low", "n_h1 > 1"),
    ("canonical_missing", "medium", r"NOT regexp_matches(body, '(?i)<link[^>]*canonical')"),
    ("image_alt_missing", "medium", r"len(list_filter(regexp_extract_all(body, '(?i)<img[^>]*>'), lambda i: NOT regexp_matches(i, '(?i)\salt'))) > 0"),
    ("empty_href_links", "low", "n_empty > 3"),
    ("thin_content_signal", "low", "n_words < 120 AND NOT is_root"),
    *((m, s, rf"NOT regexp_matches(body, '(?i)<meta[^>]*\"{n}\"')") for m, (s, n) in _META.items()),
]


def _label(metric: str) -> str:
    return LABELS.get(metric, " ".join(w[:1].upper() + w[1:] for w in metric.split("_")))


FINDINGS = BODY + ", findings AS (" + " UNION ALL ".join(f"SELECT seq, url AS page, title, n_words, {_quote(m)} AS metric, {_quote(_label(m))} AS issue, {_quote(s)} AS severity FROM f WHERE {c}" for m, s, c in _RULES) + ")"

TITLES = f"""WITH {FINDINGS}
SELECT seq, metric, issue, page, severity,
  CASE metric WHEN 'title_missing' THEN 'No <title> tag found in the document.' WHEN 'title_empty' THEN 'The <title> element exists but is empty or contains only whitespace.'
    WHEN 'title_too_short' THEN 'Title length is only ' || length(title) || ' characters: "' || title || '".' ELSE 'Title length is ' || length(title) || ' characters (exceeds 60): "' || title || '".' END AS evidence,
  CASE metric WHEN 'title_missing' THEN 'Add a unique, descriptive <title> element inside the <head> section.' WHEN 'title_empty' THEN 'Populate the <title> tag with a meaningful description of the page''s topic.'
    WHEN 'title_too_short' THEN 'Expand the title to between 30 and 60 characters with target keywords and brand identity.' ELSE 'Shorten title to under 60 characters to avoid truncation in search engine result pages.' END AS suggested_fix
FROM findings WHERE metric LIKE 'title%'"""

DUPLICATES = f"""WITH {BODY}, d AS (SELECT title, count(*) AS n, list(url ORDER BY seq)[1:2] AS sample FROM f WHERE title <> '' GROUP BY title HAVING count(*) > 1)
SELECT url AS page, 'duplicate_title' AS metric, 'medium' AS severity, 'Title "' || title || '" is identical across ' || n || ' crawled pages (e.g. [''' || array_to_string(sample, ''', ''') || ''']).' AS evidence FROM f JOIN d USING (title)"""

CRAWL = """WITH c AS (SELECT *, page_id % 7 = 3 OR coalesce(length(html), 0) = 0 AS failed, CASE WHEN page_id % 7 <> 3 THEN 200 WHEN page_id % 2 = 0 THEN 503 ELSE 404 END AS status FROM pages),
findings AS (
  SELECT page_id AS seq, 'click_depth_high' AS metric, url AS page, 'low' AS severity, 'Page is at click depth ' || page_id % 6 || ' from homepage (recommended max is 3).' AS evidence FROM c WHERE page_id % 6 > 3
  UNION ALL SELECT page_id, 'redirect_chain', url, 'medium', 'URL required 2 redirect hops: 301 ' || url || ' -> 301 ' || url || '.' FROM c WHERE page_id % 5 = 0
  UNION ALL SELECT page_id, 'http_error', url, CASE WHEN status >= 500 THEN 'critical' ELSE 'high' END, 'HTTP response status is ' || status || '.' FROM c WHERE failed
)"""

HEALTH = CRAWL + """, h AS (SELECT greatest(40, 100 - 15 * count(*) FILTER (severity = 'critical') - 8 * count(*) FILTER (severity = 'high')) AS health_score, count(*) AS total FROM findings)
SELECT CAST(health_score AS BIGINT) AS health_score, total, CASE WHEN health_score >= 80 THEN 'good' WHEN health_score >= 60 THEN 'fair' ELSE 'poor' END AS band,
  'Site technical evaluation observed ' || total || ' findings with score ' || health_score || '/100.' AS overview FROM h"""

_BLOCKED = r"\.(" + "|".join(BLOCKED_EXTENSIONS) + ")$"
_PARTS = r"lower(regexp_extract({0}, '^([^:/?#]+)://', 1)) AS scheme, lower(regexp_extract({0}, '^[^:/?#]+://([^/?#:]*)', 1)) AS host, regexp_extract({0}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract({0}, '^[^?#]*(\?[^#]+)', 1) AS query"
_CLEAN = r"regexp_replace(regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '/+', '/', 'g'), ';[^/]*$', '')"
_SCORE = "CASE WHEN regexp_matches(lower({0}), '" + "|".join(CONTACT_WORDS) + "') THEN 60 WHEN regexp_matches(lower({0}), '" + "|".join(POLICY_WORDS) + "') THEN 40 WHEN regexp_extract({0}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN 50 ELSE 10 END"

URLS = f"""WITH p AS (SELECT page_id, url, {_PARTS.format("url")} FROM pages)
SELECT page_id, scheme || '://' || host || {_CLEAN} || query AS normalized, regexp_replace(host, '^www\\.', '') = 'ththin.example.com' AS same_site,
  NOT regexp_matches(lower(path), '{_BLOCKED}') AS crawlable, CAST({_SCORE.format("url")} AS BIGINT) AS priority, path IN ('', '/') AS is_root,
  upper(split_part(host, '.', 1)[1]) || split_part(host, '.', 1)[2:] AS brand FROM p"""

LINKS = rf"""
hrefs AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1) AS h FROM pages WHERE length(html) > 0),
a AS (SELECT page_id AS src_seq, url AS src_url, unnest(range(len(h))) AS pos, unnest(h) AS href FROM hrefs),
absolute AS (SELECT src_seq, src_url, pos, regexp_extract(src_url, '^[^:/?#]+://[^/?#]*') || trim(href) AS dst FROM a WHERE href LIKE '/%'),
parts AS (SELECT src_seq, src_url, pos, {_PARTS.format("dst")} FROM absolute),
edges AS (SELECT src_seq, src_url, pos, scheme || '://' || host || {_CLEAN} || query AS dst_url FROM parts WHERE NOT regexp_matches(lower(path), '{_BLOCKED}'))
"""

DEPTH = f"""WITH RECURSIVE {LINKS}, p AS (SELECT {_PARTS.format("url")} FROM pages), starts AS (SELECT DISTINCT scheme || '://' || host || {_CLEAN} || query AS url FROM p)
SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT url, 0 AS depth FROM starts UNION ALL SELECT dst_url, 1 FROM edges) GROUP BY url"""

SHOP = f"""
items AS (SELECT 'https://shop' || l_orderkey % 3 || '.example.com' AS site, l_suppkey, l_partkey, l_orderkey::BIGINT * 8 + l_linenumber AS pos FROM lineitem),
pairs AS (SELECT site, site || '/supplier/' || l_suppkey AS s, site || CASE WHEN l_partkey % 7 = 0 THEN '/store' ELSE '' END || '/part/' || l_partkey AS p, pos FROM items),
clicks AS (
  SELECT site, src, dst, min(pos) AS pos FROM (
    SELECT site, s AS src, p AS dst, pos FROM pairs UNION ALL SELECT site, p, s, pos FROM pairs
    UNION ALL SELECT DISTINCT site, site || '/', site || '/supplier/' || i, i - 1 FROM items, (VALUES (1), (2)) AS t(i)
  ) GROUP BY site, src, dst
)
"""

CRAWL_PLAN = f"""WITH RECURSIVE {SHOP},
scored AS (SELECT *, {_SCORE.format('dst')} AS score FROM clicks),
starts AS (
  SELECT site, site || path AS url, depth, pos, {_SCORE.format("(site || path)")} AS score
  FROM (SELECT DISTINCT site FROM items), (VALUES ('/', 0, -1), ('/supplier/3', 1, 0), ('/store/part/7', 1, 1), ('/part/1', 1, 3)) AS t(path, depth, pos)
),
walk(site, generation, queue, seen) AS (
  SELECT site, 0, list({{'url': url, 'depth': depth}} ORDER BY score DESC, pos), list(url) FROM starts GROUP BY site
  UNION ALL
  SELECT site, generation + 1, list({{'url': dst, 'depth': depth + 1}} ORDER BY place, score DESC, pos, dst), any_value(seen) || list(dst)
  FROM (
    SELECT w.site, w.generation, any_value(w.seen) AS seen, e.dst, any_value(e.score) AS score, min(w.place) AS place, arg_min(e.pos, (w.place, e.pos)) AS pos, arg_min(w.page.depth, (w.place, e.pos)) AS depth
    FROM (SELECT site, generation, seen, unnest(queue) AS page, unnest(range(len(queue))) AS place FROM walk) AS w JOIN scored e ON e.src = w.page.url
    WHERE NOT regexp_matches(w.page.url, 'example.com/(part/1|supplier/2)') AND NOT list_contains(w.seen, e.dst)
    GROUP BY w.site, w.generation, e.dst
  ) GROUP BY site, generation
),
flat AS (SELECT site, generation, unnest(queue) AS page, unnest(range(len(queue))) AS place FROM walk),
numbered AS (
  SELECT site, row_number() OVER (PARTITION BY site ORDER BY generation, place) AS fetch_no, page.url AS url, page.depth AS depth
  FROM flat WHERE NOT regexp_matches(page.url, 'example.com/(part/1|supplier/2)')
)
SELECT site, fetch_no, url, depth::BIGINT AS depth FROM numbered WHERE fetch_no <= {SHOP_BUDGET}"""

SHOP_DEPTH = f"""WITH RECURSIVE {SHOP},
walk(site, depth, level, seen) AS (
  SELECT site, 0, [site || '/'], [site || '/'] FROM (SELECT DISTINCT site FROM items)
  UNION ALL
  SELECT site, depth + 1, list(dst), any_value(seen) || list(dst)
  FROM (SELECT w.site, w.depth, any_value(w.seen) AS seen, e.dst FROM (SELECT site, depth, seen, unnest(level) AS url FROM walk) AS w JOIN clicks e ON e.src = w.url WHERE NOT list_contains(w.seen, e.dst) GROUP BY w.site, w.depth, e.dst)
  GROUP BY site, depth
)
SELECT unnest(level) AS url, depth::BIGINT AS depth FROM walk"""

CANDIDATES = rf"""
found AS (SELECT doc_id AS seq, regexp_extract_all(text, '{PHONE}') AS v FROM documents),
listed AS (SELECT seq, CAST(unnest(range(len(v))) AS BIGINT) AS pos, trim(regexp_replace(unnest(v), '\s+', ' ', 'g')) AS value FROM found),
digits AS (SELECT *, regexp_replace(value, '\D', '', 'g') AS d FROM listed),
c AS (SELECT seq, pos, value, right(d, 10) AS normalized FROM digits)
"""
GROUPED = CANDIDATES + ", g AS (SELECT normalized, count(*) AS occurrences, arg_min(value, (seq, pos)) AS value, min((seq, pos)) AS first FROM c GROUP BY normalized)"
VERDICTS = f"""WITH {GROUPED}, t AS (SELECT (SELECT count(*) FROM g) AS n_values, (SELECT count(DISTINCT seq) FROM c) AS n_pages, (SELECT count(*) FROM c) AS n_candidates, (SELECT value FROM g ORDER BY occurrences DESC, first LIMIT 1) AS value)
SELECT 'phone' AS field, CASE n_values WHEN 0 THEN 'not_found' WHEN 1 THEN 'consistent' ELSE 'mismatch' END AS verdict,
  CAST(CASE n_values WHEN 0 THEN 0.0 WHEN 1 THEN 0.80 + CASE WHEN n_pages >= 2 THEN 0.10 ELSE 0 END ELSE round(0.70 + 0.08 * least(n_pages, 3), 2) END AS DOUBLE) AS confidence,
  n_values, n_pages, CASE WHEN n_values > 0 THEN 1 ELSE 0 END::BIGINT AS n_sources, n_candidates, coalesce(value, '') AS value FROM t
UNION ALL SELECT unnest(['name', 'address']), 'not_found', 0.0, 0, 0, 0, 0, ''"""


def _array(values) -> str:
    return "[" + ", ".join(map(_quote, values)) + "]"


def _names() -> str:
    name = f"s_name || {_array(SUFFIXES)}[s_suppkey % {len(SUFFIXES)} + 1]"
    return rf"""SELECT s_suppkey, {name} AS name, trim(regexp_replace(regexp_replace(regexp_replace(lower({name}), '\b({"|".join(CORPORATE)})\b', ' ', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS normalized FROM supplier"""


def _addresses() -> str:
    streets = "[" + ", ".join(_quote(s).replace("\t", "' || chr(9) || '") for s in STREETS) + "]"
    address = f"CAST(s_suppkey AS VARCHAR) || {streets}[s_suppkey % {len(STREETS)} + 1]"
    out = f"lower({address})"
    for word, short in ADDRESS_WORDS:
        out = rf"regexp_replace({out}, '\b{word}\b', '{short}', 'g')"
    return rf"SELECT s_suppkey, {address} AS address, trim(regexp_replace(regexp_replace({out}, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS normalized FROM supplier"


def _site_rules() -> str:
    bodies = " ".join(f"WHEN {i} THEN {_quote(b)}" for i, b in enumerate(ROBOTS))
    bots = ", ".join(f"CASE WHEN regexp_matches(body, '(?is)User-agent:\\s*{b}\\b.*?Disallow:\\s*/\\s*(?:\\n|\\z)') THEN '{b}' END" for b in BOTS)
    return f"""WITH s AS (
  SELECT s_suppkey AS k, 'https://s' || s_suppkey || '.example.com' AS site, CASE s_suppkey % {len(ROBOTS)} {bodies} END AS body FROM supplier
), shut AS (SELECT site, concat_ws(', ', {bots}) AS bots FROM s WHERE k % 5 <> 0)
SELECT site || '/llms.txt' AS page, 'llms_txt_missing' AS metric, 'low' AS severity,
       'No active /llms.txt found (HTTP status ' || CASE WHEN k % 3 = 0 THEN 404 ELSE 200 END || ').' AS evidence
FROM s WHERE k % 3 = 0 OR k % 2 <> 0
UNION ALL SELECT site || '/robots.txt', 'ai_crawler_blocked', 'medium', 'robots.txt explicitly blocks AI search crawlers: ' || bots || '.' FROM shut WHERE bots <> ''"""


ROBOTS_ALLOWED = """SELECT 'https://s' || s_suppkey || '.example.com' || path AS url,
       s_suppkey % 5 = 0 OR s_suppkey % 4 = 2 OR (s_suppkey % 4 = 0 AND NOT starts_with(path, '/private')) AS allowed
FROM supplier, (VALUES ('/'), ('/private/x'), ('/open?q=1')) AS p(path)"""

SITEMAP_ORDER = """WITH s AS (SELECT 'https://s' || s_suppkey || '.example.com' AS site, CASE WHEN s_suppkey % 4 = 3 AND s_suppkey % 5 <> 0 THEN 1 ELSE 0 END AS own FROM supplier)
SELECT site, site || '/map.xml' AS url, CAST(1 AS BIGINT) AS rank FROM s WHERE own = 1
UNION ALL SELECT site, site || '/sitemap.xml', CAST(own + 1 AS BIGINT) FROM s UNION ALL SELECT site, site || '/sitemap_index.xml', CAST(own + 2 AS BIGINT) FROM s"""

SITEMAP_PAGES = """WITH s AS (SELECT 'https://s' || s_suppkey || '.example.com' AS site FROM supplier)
SELECT site, CAST(1 AS BIGINT) AS pos, site || '/first' AS url FROM s UNION ALL SELECT site, CAST(2 AS BIGINT), site || '/deep' FROM s"""

RESPONSES = f"""WITH r AS (
  SELECT page_id, html, page_id % 11 = 0 AS failed, CASE page_id % {len(MEDIA_TYPES)} {" ".join(f"WHEN {i} THEN {_quote(m)}" for i, m in enumerate(MEDIA_TYPES))} END AS raw FROM pages
), t AS (SELECT *, CASE WHEN failed THEN '' ELSE lower(trim(split_part(raw, ';', 1))) END AS content_type FROM r)
SELECT page_id AS seq, CASE WHEN failed THEN 0 ELSE 200 END AS status, content_type,
       CASE WHEN content_type IN ('text/html', 'application/xhtml+xml') THEN coalesce(len(html), 0) ELSE 0 END AS n_chars, CASE WHEN failed THEN 'timed out' END AS error
FROM t"""


def oracle_sql() -> dict[str, str]:
    return {
        "page_findings": f"WITH {FINDINGS} SELECT seq, metric, issue, page, severity FROM findings",
        "title_findings": TITLES,
        "thin_content": f"WITH {FINDINGS} SELECT seq, page, severity, 'Page contains approximately ' || n_words || ' visible words, which may signal thin content to search engines.' AS evidence FROM findings WHERE metric = 'thin_content_signal'",
        "dom_size": f"WITH {BODY} SELECT seq, CAST(n_nodes AS BIGINT) AS n_nodes FROM f",
        "tag_census": f"WITH {BODY} SELECT tag, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(body, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM f) GROUP BY tag",
        "crawl_findings": f"{CRAWL} SELECT * FROM findings",
        "duplicate_titles": DUPLICATES,
        "severity_rollup": f"WITH {FINDINGS} SELECT severity, count(*) AS n FROM findings GROUP BY severity UNION ALL SELECT 'all', count(*) FROM findings",
        "health_score": HEALTH,
        "url_forms": URLS,
        "out_links": f"WITH {LINKS} SELECT src_seq, CAST(pos AS INTEGER) AS pos, dst_url FROM edges",
        "referrer_counts": f"WITH {LINKS} SELECT dst_url, count(DISTINCT src_url) AS n_referrers FROM edges GROUP BY dst_url",
        "link_priority": f"WITH {LINKS}, one AS (SELECT src_seq, dst_url, min(pos) AS pos, {_SCORE.format('dst_url')} AS score FROM edges GROUP BY src_seq, dst_url) SELECT src_seq, dst_url, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY src_seq ORDER BY score DESC, pos) AS rank FROM one",
        "crawl_depth": DEPTH,
        "crawl_plan": CRAWL_PLAN,
        "shop_depth": SHOP_DEPTH,
        "token_stems": f"WITH {TOKENS} SELECT stem, count(*) AS n FROM toks GROUP BY stem",
        "document_frequencies": f"WITH {TOKENS} SELECT stem, df FROM dfs",
        "corpus_stats": f"WITH {TOKENS} SELECT n_docs, round(avg_length, 6) AS avg_length FROM stats",
        "bm25_topk": f"WITH {SCORED} SELECT query_id, rank, doc, score, round(coverage, 6) AS coverage, matched FROM ranked WHERE rank <= 5",
        "bm25_answers": f"""WITH {SCORED}, found AS (SELECT query_id, doc FROM ranked WHERE rank = 1 AND score >= 1.8 AND coverage >= CASE WHEN n_tokens >= 2 THEN 0.5 ELSE 1.0 END)
SELECT query_id, query, text AS answer, CAST(doc AS VARCHAR) AS url, text AS excerpt FROM q LEFT JOIN found USING (query_id) LEFT JOIN documents ON doc_id = doc""",
        "legal_topk": f"WITH {LEGAL} SELECT query_id, rank, doc, score FROM ranked WHERE rank <= 5",
        "model_candidates": MODEL,
        "norm_names": _names(),
        "norm_addresses": _addresses(),
        "phone_candidates": f"WITH {CANDIDATES} SELECT seq, pos, value, normalized FROM c",
        "nap_groups": f"WITH {GROUPED} SELECT 'phone' AS field, normalized, occurrences, value FROM g",
        "nap_verdicts": VERDICTS,
        "site_rules": _site_rules(),
        "robots_allowed": ROBOTS_ALLOWED,
        "sitemap_order": SITEMAP_ORDER,
        "sitemap_pages": SITEMAP_PAGES,
        "response_forms": RESPONSES,
    }
