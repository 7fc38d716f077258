"""robots.txt and sitemaps as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.lineage import cut


#: What ends a line, and white space around keys and values, as the standard library's parser sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
RULE_KEYS = ("allow", "disallow", "crawl-delay", "request-rate")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def robots_rules(site_files: DataFrame) -> DataFrame:
    """(site, entry, star, agents, rules) of every robots.txt that was served and isn't blank; rules are (no, allow, path) in order.

    A file is read as a machine of three states would: agent lines in a row name one entry; the first allow, disallow,
    delay or rate line after them makes it count; an empty line ends it, and what follows binds nobody until the next
    agent line. An agent line after a rule line opens the next entry. All of it follows from the nearest line before
    that matters and from the places of the last agent and the last empty line, so windows over a site's lines do.
    An entry without an allow or disallow line allows everything, and so does an empty path.
    """
    served = site_files.filter((F.col("path") == "/robots.txt") & F.col("status").between(200, 399) & (_stripped(F.col("body")) != ""))
    lines = served.select("site", F.posexplode(F.split("body", LINE_END)).alias("no", "raw")).withColumn("line", _stripped(F.regexp_replace("raw", "#.*$", "")))
    lines = lines.withColumn("key", F.when(F.col("line").contains(":"), F.lower(_stripped(F.substring_index("line", ":", 1)))))
    lines = lines.withColumn("value", urls.unquote(_stripped(F.regexp_replace("line", "^[^:]*:", ""))))
    kind = F.when(F.col("raw") == "", "empty").when(F.col("key") == "user-agent", "agent").when(F.col("key").isin(*RULE_KEYS), "rule")
    lines = lines.select("site", "no", "key", "value", kind.alias("kind")).filter("kind is not null")
    before = Window.partitionBy("site").orderBy("no")
    opens = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(before), F.lit("empty")) != "agent")
    last = {f"last_{k}": F.max(F.when(F.col("kind") == k, F.col("no"))).over(before) for k in ("agent", "empty")}
    bound = lines.withColumns({"entry": F.sum(opens.cast("int")).over(before), **last}).filter("last_agent > coalesce(last_empty, -1)")
    allow = (F.col("key") == "allow") | (F.col("value") == "")
    rule = F.when(F.col("key").isin("allow", "disallow"), F.struct("no", allow.alias("allow"), urls.quote(urls.rejoined(F.col("value"))).alias("path")))
    entries = bound.groupBy("site", "entry").agg(
        F.count_if(F.col("kind") == "rule").alias("n"), F.collect_set(F.when(F.col("kind") == "agent", F.col("value"))).alias("agents"), F.array_sort(F.collect_list(rule)).alias("rules")
    )
    return entries.filter("n > 0").select("site", "entry", F.array_contains("agents", "*").alias("star"), "agents", "rules")


def allowed(candidates: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Add `allowed` to (url, site) rows: the first matching rule of the first entry that applies; no entry or rule allows.

    An entry applies if one of its names occurs in the agent's (version cut off); the first entry for `*` applies to
    everyone else, and other entries that name `*` to nobody. A rule matches by path prefix, both sides percent-encoded alike.
    """
    name = F.lit(agent.split("/")[0].lower())
    mine = rules.filter(F.col("star") | F.exists("agents", lambda a: name.contains(F.lower(a))))
    binding = mine.groupBy("site").agg(F.min(F.struct("star", "entry", "rules")).alias("first")).select("site", "first.rules")
    target = urls.quote(urls.local_part(urls.unquote(F.col("url"))))
    rows = candidates.join(binding, "site", "left").withColumn("_target", F.when(target == "", "/").otherwise(target))
    hit = F.get(F.filter("rules", lambda r: F.col("_target").startswith(r["path"])), F.lit(0))
    return rows.withColumn("allowed", F.coalesce(hit["allow"], F.lit(True))).drop("rules", "_target")


def sitemap_locations(site_files: DataFrame) -> DataFrame:
    """(site, pos, url): the sitemaps that robots.txt names, then the two usual places, each once in that order."""
    robots = site_files.filter((F.col("path") == "/robots.txt") & F.col("status").between(200, 399))
    named = robots.select("site", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*Sitemap:\s*(\S+)"), F.lit(1))).alias("pos", "raw"))
    usual = site_files.select("site").distinct().select("site", F.explode(F.array(*(F.struct(F.lit(1_000_000 + i).alias("pos"), F.concat("site", F.lit(p)).alias("raw")) for i, p in enumerate(("/sitemap.xml", "/sitemap_index.xml"))))).alias("u")).select("site", "u.*")
    return named.unionByName(usual).withColumn("url", urls.normalize_url("raw")).filter("url <> ''").groupBy("site", "url").agg(F.min("pos").alias("pos"))


def sitemap_entries(documents: DataFrame) -> DataFrame:
    """(doc_url, pos, loc, is_index) of sitemap documents (url, body), whatever their namespace; broken XML is read by pattern."""
    path = "//*[local-name()='{}']/*[local-name()='loc']/text()"
    pages, children = F.expr(f'xpath(body, "{path.format("url")}")'), F.expr(f'xpath(body, "{path.format("sitemap")}")')
    sound = documents.filter(F.col("body").rlike(r"(?s)^\s*(<\?xml.*?\?>)?.*</(\w+:)?(urlset|sitemapindex)>\s*$"))
    broken = documents.filter(~F.col("body").rlike(r"(?s)^\s*(<\?xml.*?\?>)?.*</(\w+:)?(urlset|sitemapindex)>\s*$"))
    parts = []
    for rows, found in ((sound, ((pages, False), (children, True))), (broken, ((F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), None),))):
        for locs, index in found:
            is_index = F.lit(index) if index is not None else F.col("body").rlike("(?i)<sitemap>")
            parts.append(rows.select(F.col("url").alias("doc_url"), is_index.alias("is_index"), F.posexplode(locs).alias("pos", "raw")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("doc_url", "pos", urls.normalize_url("raw").alias("loc"), "is_index").filter("loc <> ''")


def sitemap_urls(site_files: DataFrame, documents: DataFrame, max_urls: int | None = None, max_levels: int | None = None) -> DataFrame:
    """(site, pos, url): the crawlable pages that a site's sitemaps list, each once, in order; max_urls, if given, bounds those of a site.

    documents are (url, body) of captured sitemaps; an index is followed level by level, within the site, until no
    map is new or max_levels, if given, are read.
    """
    entries = sitemap_entries(documents)
    level = sitemap_locations(site_files).select("site", F.col("url").alias("doc_url"), F.array(F.col("pos").cast("long")).alias("at"))
    level = cut(level)
    found, known, read = None, level.select("site", "doc_url"), 0
    while found is None or (max_levels is None or read < max_levels) and not level.isEmpty():
        rows = level.join(entries, "doc_url").filter(urls.same_site("loc", "site")).withColumn("at", F.concat("at", F.array(F.col("pos").cast("long"))))
        pages = rows.filter(~F.col("is_index") & urls.is_crawlable_link("loc")).select("site", F.col("loc").alias("url"), "at")
        found = pages if found is None else found.unionByName(pages)
        level = cut(rows.filter("is_index").select("site", F.col("loc").alias("doc_url"), "at").join(known, ["site", "doc_url"], "left_anti").groupBy("site", "doc_url").agg(F.min("at").alias("at")))
        read += 1
        known = known.unionByName(level.select("site", "doc_url"))
    once = found.groupBy("site", "url").agg(F.min(F.struct(F.size("at").alias("depth"), "at")).alias("at"))
    pos = F.row_number().over(Window.partitionBy("site").orderBy("at"))
    rows = once.withColumn("pos", pos).select("site", "pos", "url")
    return rows if max_urls is None else rows.filter(F.col("pos") <= max_urls)
