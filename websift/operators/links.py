"""The link graph: extraction, referrers, breadth-first depth, priority order, crawl plans and orphans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.lineage import cut, once
from ..sources import dom, sitefiles


def anchors(pages: DataFrame) -> DataFrame:
    """(seq, final_url, pos, href) of every a[href] in pages with HTML and a status below 400, from the page's parse."""
    live = pages.filter((F.col("html") != "") & (F.col("status") < 400)).select("seq", "final_url", "html")
    return dom.parse_pages(live, ("hrefs",)).select("seq", "final_url", F.posexplode("hrefs").alias("pos", "href"))


def links(found: DataFrame, root: str | None = None, strict_compat: bool = False) -> DataFrame:
    """(src_seq, src_url, pos, dst_url) of the anchors that lead to crawlable pages of the root's site (default: the page's own)."""
    base = F.lit(root) if root else F.col("final_url")
    dst = urls.normalize_url("href", "final_url", strict_compat)
    rows = found.select(F.col("seq").alias("src_seq"), F.col("final_url").alias("src_url"), "pos", dst.alias("dst_url"), base.alias("_root"))
    return rows.filter((F.col("dst_url") != "") & urls.same_site("dst_url", "_root") & urls.is_crawlable_link("dst_url")).drop("_root")


def referrers(edges: DataFrame) -> DataFrame:
    """(dst_url, referrers): the distinct pages that link there, in the order of their first link."""
    first = edges.groupBy("dst_url", "src_url").agg(F.min(F.struct("src_seq", "pos")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "src_url")))
    return first.groupBy("dst_url").agg(F.transform(listed, lambda x: x["src_url"]).alias("referrers"))


def referrer_counts(edges: DataFrame) -> DataFrame:
    """(dst_url, n): the same without the lists, for destinations that everything links to."""
    return edges.select("dst_url", "src_url").distinct().groupBy("dst_url").agg(F.count("*").alias("n_referrers"))


def first_referrers(edges: DataFrame, k: int) -> DataFrame:
    """(dst_url, referrers): the first k distinct pages that link there, in the order of their first link.

    A page's links to one destination become one row first; of these every task passes on k a destination at most, so
    that a page that everything links to costs no task more than k rows of each other one. The first page alone is a
    minimum a destination. A hash leads all keys: URLs of a site begin alike, and are slow to sort.
    """
    edges = edges.withColumn("_h", F.xxhash64("dst_url"))
    if k == 1:
        first = edges.groupBy("_h", "dst_url").agg(F.min(F.struct("src_seq", "pos", "src_url")).alias("at"))
        return first.select("dst_url", F.array("at.src_url").alias("referrers"))
    first = edges.groupBy("_h", "dst_url", "src_url").agg(F.min(F.struct("src_seq", "pos")).alias("at"))
    best = first.withColumn("_n", F.row_number().over(Window.partitionBy("_h", "dst_url").orderBy("at", "src_url"))).filter(F.col("_n") <= k)
    listed = F.array_sort(F.collect_list(F.struct("_n", "src_url")))
    return best.groupBy("dst_url").agg(F.transform(listed, lambda x: x["src_url"]).alias("referrers"))


def with_referrers(pages: DataFrame, edges: DataFrame, k: int = 1) -> DataFrame:
    """Pages with the first k pages that link to their URL, as the rules on orphans and failures read them.

    Edges are those of captured pages. A page that nothing links to has none; what the column held before is replaced.
    """
    found = first_referrers(edges, k).select(F.col("dst_url").alias("_dst"), F.col("referrers").alias("_referrers"))
    rows = once(pages, "_url", urls.normalize_url("url")).join(found, F.col("_url") == F.col("_dst"), "left")
    return rows.withColumn("referrers", F.coalesce("_referrers", F.array().cast("array<string>"))).select(*pages.columns)


def prioritized(candidates: DataFrame, batch: str = "batch", pos: str = "pos", url: str = "url") -> DataFrame:
    """Add `rank`: batches in order, within one the higher URL priority first, then the given position."""
    scored = candidates.withColumn("score", urls.url_priority_score(url))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(batch).orderBy(F.col("score").desc(), pos)))


def seeds(roots: DataFrame, sitemap: DataFrame, max_urls: int | None = None) -> DataFrame:
    """(site, url, depth, pos): each site's root (site, url) at depth 0, then its sitemap's URLs (site, pos, url) at depth 1, each once.

    URLs of other sites are left out; max_urls, if given, bounds the listed ones of a site.
    """
    first = roots.select("site", urls.normalize_url("url").alias("url"), F.lit(0).alias("depth"), F.lit(-1).cast("bigint").alias("pos"))
    root = first.select("site", F.col("url").alias("_root"))
    listed = sitemap.join(root, "site").filter(urls.same_site("url", "_root") & (F.col("url") != F.col("_root"))).groupBy("site", "url").agg(F.min("pos").cast("bigint").alias("pos"))
    if max_urls is not None:
        listed = listed.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("pos"))).filter(F.col("_n") <= max_urls).drop("_n")
    return first.unionByName(listed.withColumn("depth", F.lit(1)))


def _queued(level: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A generation's URLs with their place in the site's queue, and each site's totals after it.

    level: site, url, depth, parent (the place of the page that queued it), score, pos, allowed. done: site, queued,
    fetched so far. `place` counts all URLs of a site, `fetch_no` those that may be fetched, up to and including the row.
    The generation is sorted by ranges over all partitions; a range's own numbers are moved by the counts of those
    before it, so that no site has to fit into one task.
    """
    order = [F.col("parent").asc(), F.col("score").desc(), F.col("pos").asc(), F.col("url").asc()]
    dealt = cut(level.repartitionByRange(F.col("site").asc(), *order).withColumn("_part", F.spark_partition_id()), "generation")
    counts = dealt.groupBy("site", "_part").agg(F.count("*").alias("n"), F.count_if("allowed").alias("f"))
    before = Window.partitionBy("site").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select("site", "_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in "nf"))
    moved = moved.join(done, "site", "left").select("site", "_part", *((F.col(f"_{c}") + F.coalesce(t, F.lit(0))).alias(f"_{c}") for c, t in (("n", "queued"), ("f", "fetched"))))
    own = Window.partitionBy("_part", "site").orderBy(*order)
    placed = dealt.withColumns({"place": F.row_number().over(own), "fetch_no": F.sum(F.col("allowed").cast("long")).over(own)}).join(moved, ["site", "_part"])
    totals = counts.groupBy("site").agg(F.sum("n").alias("queued"), F.sum("f").alias("fetched")).unionByName(done).groupBy("site").agg(F.sum("queued").alias("queued"), F.sum("fetched").alias("fetched"))
    return placed.select("site", "url", "depth", "allowed", (F.col("place") + F.col("_n")).alias("place"), (F.col("fetch_no") + F.col("_f")).alias("fetch_no")), cut(totals, "totals")


def crawl_plan(starts: DataFrame, edges: DataFrame, max_pages: int | None = None, rules: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """(site, fetch_no, url, depth): the pages that a crawl of each site fetches, in order, from seeds (site, url, depth, pos) over (src_url, pos, dst_url).

    A site's queue is first in, first out. Seeds go in by URL priority, then position; a fetched page puts in its links
    that were never queued, by priority, then position, and their depth is one more than its own: depth is fixed when a
    URL is first queued, and need not be the shortest way. URLs that robots rules shut out are passed over: they neither
    count towards max_pages nor lead on. Edges are those of captured pages, by requested URL.

    Each round is one generation: what the pages of the last one queue. Every generation is a table of its own; only the
    new one is joined with the edges, and the earlier ones are never written again.
    """
    edges = cut(edges.groupBy("src_url", "dst_url").agg(F.min("pos").alias("pos")), "edges")
    level = starts.groupBy("site", "url").agg(F.min(F.struct("depth", "pos")).alias("s")).select("site", "url", "s.depth", F.lit(0).cast("long").alias("parent"), "s.pos")
    done = starts.select("site").limit(0).withColumns({"queued": F.lit(0).cast("long"), "fetched": F.lit(0).cast("long")})
    plan: list[DataFrame] = []
    while True:
        scored = level.withColumn("score", urls.url_priority_score("url"))
        scored = scored.withColumn("allowed", F.lit(True)) if rules is None else sitefiles.allowed(scored, rules, agent)
        placed, done = _queued(scored, done)
        plan.append(cut(placed, "queue"))
        fetched = plan[-1].filter("allowed")
        if max_pages is not None:
            fetched = fetched.filter(F.col("fetch_no") <= max_pages).join(done.filter(F.col("fetched") < max_pages).select("site"), "site", "left_semi")
        found = fetched.join(edges, F.col("url") == F.col("src_url")).groupBy("site", F.col("dst_url").alias("url")).agg(F.min(F.struct("place", "pos", "depth")).alias("s"))
        known = reduce(DataFrame.unionByName, (p.select("site", "url") for p in plan))
        fresh = found.join(known, ["site", "url"], "left_anti")
        level = cut(fresh.select("site", "url", (F.col("s.depth") + 1).alias("depth"), F.col("s.place").alias("parent"), F.col("s.pos").alias("pos")), "frontier")
        if level.isEmpty():
            break
    whole = reduce(DataFrame.unionByName, plan).filter("allowed")
    return (whole if max_pages is None else whole.filter(F.col("fetch_no") <= max_pages)).select("site", "fetch_no", "url", "depth")


def crawl_depth(starts: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(url, depth): the fewest clicks from the starts (url, depth), level by level over (src_url, dst_url) edges.

    URLs are written once, as names of long keys; the edges that every level reads are pairs of keys. Each level is one
    join of what the level before found with the edges, and a table of its own; it ends when a level is empty and no
    start is left, or max_depth, if given, is reached.
    """
    edges = edges.select("src_url", "dst_url").filter("src_url is not null")
    given = cut(starts.groupBy("url").agg(F.min("depth").alias("depth")))
    names = cut(edges.select(F.explode(F.array("src_url", "dst_url")).alias("url")).union(given.select("url")).distinct(), "names")
    seed, n = 0, names.count()
    while names.select(_key("url", seed)).distinct().count() < n:  # two URLs with one key: others are taken
        seed += 1
    edges = cut(edges.select(_key("src_url", seed).alias("src"), _key("dst_url", seed).alias("dst")).distinct(), "edges")
    level, top = given.agg(F.min("depth")).first()[0] or 0, given.agg(F.max("depth")).first()[0] or 0
    given = given.select(_key("url", seed).alias("key"), "depth")
    found = [given.filter(F.col("depth") == level)]
    while max_depth is None or level < max_depth:
        level += 1
        step = found[-1].join(edges, F.col("key") == F.col("src")).select(F.col("dst").alias("key"))
        new = step.union(given.filter(F.col("depth") == level).select("key")).distinct()
        known = reduce(DataFrame.unionByName, (f.select("key") for f in found))
        found.append(cut(new.join(known, "key", "left_anti").withColumn("depth", F.lit(level))))
        if level >= top and found[-1].isEmpty():
            break
    return names.withColumn("key", _key("url", seed)).join(reduce(DataFrame.unionByName, found), "key").select("url", "depth")


def _key(url: str, seed: int) -> Column:
    return F.xxhash64(url, F.lit(seed))


def orphans(pages: DataFrame, sitemap: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages in the sitemap, below the root, that no page links to."""
    listed = pages.filter("depth > 0").join(sitemap.select("url").distinct(), "url", "left_semi")
    return listed.filter(F.size("referrers") == 0).join(edges.select(F.col("dst_url").alias("url")).distinct(), "url", "left_anti")
