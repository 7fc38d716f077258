"""Queries on the elements of the given pages and on referrers of a link graph, with their SQL.

The SQL builds the tree itself: it reads the tags by pattern and walks them with a stack of open elements.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import links, onpage, structure
from ..sources import dom
from ..sources.pages import as_pages
from .registry import _pages, _shop_edges, _table
from .sql import BODY, SHOP

#: Where on a page a link can stand, and which elements make a box more than a leaf.
REGIONS = ("nav", "header", "footer", "article", "aside", "section", "div", "body")
LEAST_REFERRERS = 3


def _nodes(spark, sf_dir):
    return dom.dom_nodes(_pages(spark, sf_dir).filter("html != ''")).select("seq", "id", "end", "parent", "tag")


def link_regions(spark, sf_dir):
    """Links by the nearest region of the page around them."""
    found = structure.within(_nodes(spark, sf_dir), F.col("tag").isin(*REGIONS), F.col("tag") == "a", "nearest")
    return found.groupBy("seq", F.col("outer.id").cast("long").alias("region_id"), F.col("outer.tag").alias("region")).agg(F.count("*").alias("n"))


def leaf_blocks(spark, sf_dir):
    """Boxes with the number of boxes, lists, tables and paragraphs inside; a leaf has none."""
    found = structure.holding(_nodes(spark, sf_dir), F.col("tag").isin(*dom.BOXES), F.col("tag").isin(*dom.NESTED_BOXES))
    return found.select("seq", F.col("node.id").cast("long").alias("id"), F.col("node.tag").alias("tag"), "n")


def heading_followers(spark, sf_dir):
    """The element next to every heading, under the same parent."""
    found = structure.next_siblings(_nodes(spark, sf_dir)).filter(F.col("node.tag").isin(*dom.HEADINGS))
    return found.select("seq", F.col("node.id").cast("long").alias("id"), F.col("node.tag").alias("tag"), F.col("next.tag").alias("next_tag"))


def heading_sections(spark, sf_dir):
    """Elements under every heading up to the next one of the same parent."""
    found = structure.below_siblings(_nodes(spark, sf_dir), F.col("tag").isin(*dom.HEADINGS))
    return found.groupBy("seq", F.col("head.id").cast("long").alias("id"), F.col("node.tag").alias("tag")).agg(F.count("*").alias("n"))


def tag_containment(spark, sf_dir):
    """How often elements of one tag are inside elements of another, at any depth."""
    found = structure.within(_nodes(spark, sf_dir), F.lit(True), F.lit(True))
    return found.groupBy(F.col("outer.tag").alias("outer_tag"), F.col("node.tag").alias("tag")).agg(F.count("*").alias("n"))


def _shop_links(spark, sf_dir):
    return _shop_edges(spark, sf_dir).withColumn("src_seq", F.col("pos"))


def first_referrers(spark, sf_dir):
    """The first pages that link to every page of the shops, where some pages are linked to by hundreds."""
    found = links.first_referrers(_shop_links(spark, sf_dir), LEAST_REFERRERS)
    return found.select("dst_url", F.posexplode("referrers").alias("n", "src_url")).withColumn("n", F.col("n").cast("long"))


def shop_failures(spark, sf_dir):
    """Failed and orphaned pages of the shops, with referrers taken from the links."""
    edges = _shop_links(spark, sf_dir)
    offers = _table(spark, sf_dir, "customer").select(F.concat(F.lit("https://shop"), (F.col("c_custkey") % 3).cast("string"), F.lit(".example.com/offer/"), F.col("c_custkey").cast("string")).alias("url"))
    known = cut(edges.select(F.explode(F.array("src_url", "dst_url")).alias("url")).union(offers).distinct(), "known")
    gone = F.char_length("url") % 5 == 3
    raw = known.select("url", F.when(gone, 404).otherwise(200).alias("status"), F.when(gone, "").otherwise("<p>x</p>").alias("html"), F.when(F.col("url").endswith(".com/"), 0).otherwise(1).alias("depth"))
    listed = known.filter(F.col("url").endswith("7")).select("url")
    found = onpage.crawl_findings(links.with_referrers(as_pages(raw), edges), listed)
    return found.select("metric", "severity", "page", "evidence")


ALL = (link_regions, leaf_blocks, heading_followers, heading_sections, tag_containment, first_referrers, shop_failures)


def _names(tags) -> str:
    return "(" + ", ".join(f"'{t}'" for t in sorted(tags)) + ")"


TREE = rf"""{BODY.strip().replace("bodies AS", "RECURSIVE bodies AS", 1)},
tags AS (SELECT seq, list_transform(regexp_extract_all(body, '<(/?[a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t)) AS t FROM bodies),
walk(seq, i, n, tag, open) AS (
  SELECT seq, 0, 0, CAST(NULL AS VARCHAR), CAST([] AS STRUCT(id BIGINT, tag VARCHAR)[]) FROM tags
  UNION ALL
  SELECT seq, i + 1, n + CASE WHEN t[i + 1] LIKE '/%' THEN 0 ELSE 1 END, CASE WHEN t[i + 1] NOT LIKE '/%' THEN t[i + 1] END,
    CASE WHEN t[i + 1] IN {_names(dom.VOID)} THEN open WHEN t[i + 1] NOT LIKE '/%' THEN list_append(open, {{'id': n::BIGINT, 'tag': t[i + 1]}})
         WHEN list_contains(list_transform(open, lambda o: '/' || o.tag), t[i + 1]) THEN open[:len(open) - list_position(list_reverse(list_transform(open, lambda o: '/' || o.tag)), t[i + 1])] ELSE open END
  FROM walk JOIN tags USING (seq) WHERE i < len(t)
),
nodes AS (SELECT seq, CAST(n - 1 AS BIGINT) AS id, tag, CASE WHEN tag IN {_names(dom.VOID)} THEN open ELSE open[:len(open) - 1] END AS up FROM walk WHERE tag IS NOT NULL),
siblings AS (SELECT seq, id, tag, up[len(up)].id AS parent FROM nodes),
around AS (SELECT seq, id, tag, unnest(up) AS o FROM nodes)
"""

SHOP_CLICKS = f"""WITH {SHOP.strip()},
named AS (SELECT src AS src_url, dst AS dst_url, min(pos) AS pos FROM clicks GROUP BY src, dst),
ranked AS (SELECT dst_url, src_url, row_number() OVER (PARTITION BY dst_url ORDER BY pos, src_url) - 1 AS n FROM named)
"""


def oracle_sql() -> dict[str, str]:
    heads = _names(dom.HEADINGS)
    with_tree = f"WITH {TREE}"
    return {
        "link_regions": f"""{with_tree}, r AS (SELECT seq, list_filter(up, lambda o: o.tag IN {_names(REGIONS)}) AS up FROM nodes WHERE tag = 'a')
SELECT seq, up[len(up)].id AS region_id, up[len(up)].tag AS region, count(*) AS n FROM r WHERE len(up) > 0 GROUP BY ALL""",
        "leaf_blocks": f"""{with_tree}, held AS (SELECT seq, o.id AS id, count(*) AS n FROM around WHERE tag IN {_names(dom.NESTED_BOXES)} GROUP BY ALL)
SELECT seq, id, tag, coalesce(n, 0) AS n FROM nodes LEFT JOIN held USING (seq, id) WHERE tag IN {_names(dom.BOXES)}""",
        "heading_followers": f"{with_tree}, s AS (SELECT seq, id, tag, lead(tag) OVER (PARTITION BY seq, parent ORDER BY id) AS next_tag FROM siblings) SELECT * FROM s WHERE tag IN {heads}",
        "heading_sections": f"""{with_tree}, s AS (SELECT seq, tag, last_value(CASE WHEN tag IN {heads} THEN id END IGNORE NULLS) OVER (PARTITION BY seq, parent ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS id FROM siblings)
SELECT seq, id, tag, count(*) AS n FROM s WHERE id IS NOT NULL AND tag NOT IN {heads} GROUP BY ALL""",
        "tag_containment": f"{with_tree} SELECT o.tag AS outer_tag, tag, count(*) AS n FROM around GROUP BY ALL",
        "first_referrers": f"{SHOP_CLICKS} SELECT dst_url, n, src_url FROM ranked WHERE n < {LEAST_REFERRERS}",
        "shop_failures": f"""{SHOP_CLICKS}, known AS (
  SELECT src_url AS url FROM named UNION SELECT dst_url FROM named UNION SELECT 'https://shop' || c_custkey % 3 || '.example.com/offer/' || c_custkey FROM customer
), pages AS (SELECT url, src_url FROM known LEFT JOIN (SELECT * FROM ranked WHERE n = 0) ON dst_url = url)
SELECT 'http_error' AS metric, 'high' AS severity, url AS page, 'HTTP response status is 404.' || coalesce(' Discovered via link on ' || src_url || '.', '') AS evidence FROM pages WHERE length(url) % 5 = 3
UNION ALL SELECT 'orphan_page_in_sitemap', 'medium', url, 'URL was discovered in sitemap.xml but has zero internal links pointing to it from crawled pages.' FROM pages WHERE src_url IS NULL AND url LIKE '%7' AND url NOT LIKE '%.com/'""",
    }
