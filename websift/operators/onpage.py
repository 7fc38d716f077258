"""The on-page audit: page rules, site rules and cross-page rules, as one table of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import listed
from ..sources import dom
from . import rules
from .facts import page_facts
from .rules import Rule, say

FINDING = ("metric", "issue", "page", "severity", "evidence", "suggested_fix")
#: Site rules come first, then pages in order with their rules in order, then groups of pages in order of their first page.
ORDER = ("phase", "seq", "rule_no", "item_no")


def _finding(metric, severity, page, evidence, fix) -> list[Column]:
    metric = metric if isinstance(metric, Column) else F.lit(metric)
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return [metric.alias("metric"), rules.label(metric).alias("issue"), page.alias("page"), severity.alias("severity"), evidence.alias("evidence"), F.lit(fix).alias("suggested_fix")]


def _found(rule_no: int, item_no: Column, metric: str, severity: str, page: Column, evidence: Column, fix: str) -> Column:
    return F.struct(F.lit(rule_no).alias("rule_no"), item_no.alias("item_no"), F.lit(metric).alias("metric"), F.lit(severity).alias("severity"), page.alias("page"), evidence.alias("evidence"), F.lit(fix).alias("suggested_fix"))


def _fired(rows: DataFrame, specs: list[Rule], first_no: int, more: Column | None = None) -> DataFrame:
    """One row per rule that fires and per item of `more`: all laid out as an array in the row and exploded, in one pass."""
    hits = F.array_compact(F.array(*(F.when(r.when, _found(first_no + i, F.lit(0), r.metric, r.severity, F.col(r.page), r.evidence, r.fix)) for i, r in enumerate(specs))))
    out = rows.select("seq", F.explode(hits if more is None else F.concat(hits, more)).alias("f")).select("seq", "f.*")
    return out.select(F.lit(1).alias("phase"), "seq", "rule_no", "item_no", "metric", rules.label(F.col("metric")).alias("issue"), "page", "severity", "evidence", "suggested_fix")


def facts_of(pages: DataFrame) -> DataFrame:
    """page_facts of the pages that were served; failed ones are dropped before the parser sees them."""
    return page_facts(dom.parse_pages(served(pages)))


def served(pages: DataFrame) -> DataFrame:
    return pages.withColumn("html_size", F.length("html")).filter(~rules.failed())


def crawl_findings(pages: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """Findings that need no parse: depth, redirects, orphans, failures."""
    rows = pages.withColumn("html_size", F.length("html")).drop("html")
    if sitemap is None:
        rows = rows.withColumn("in_sitemap", F.lit(False))
    else:
        rows = rows.join(sitemap.select("url").distinct().withColumn("in_sitemap", F.lit(True)), "url", "left").fillna(False, ["in_sitemap"])
    return _fired(rows, [*rules.before_parsing(), *rules.http_error()], 0)


def page_findings(facts: DataFrame) -> DataFrame:
    """Findings of the page rules, with one row per alternate link that isn't absolute."""
    evidence = lambda a: say('hreflang="{}" target is not an absolute URL: "{}".', a["lang"], a["href"])
    alternates = F.transform("alternates", lambda a, i: _found(99, i, "hreflang_non_absolute", "low", F.col("final_url"), evidence(a), rules.ALTERNATE_FIX))
    return _fired(facts, rules.on_page(), 10, alternates)


def _shared(facts: DataFrame, value: Column, metric: str) -> DataFrame:
    """One finding per page whose value other pages have as well.

    Groups are counted before anything is joined, so that unique values never travel twice; the sample of two pages is a
    bounded aggregate.
    """
    rows = shared_rows(facts, value)
    at = F.struct("seq", "final_url")
    first = rows.groupBy("value").agg(F.count("*").alias("n"), F.min(at).alias("first")).filter("n > 1")
    second = rows.join(first.select("value", "first"), "value").filter(at > F.col("first")).groupBy("value").agg(F.min(at).alias("second"))
    named = first.join(second, "value", "left").select("value", "n", F.col("first")["seq"].alias("group_seq"), F.array_compact(F.array(F.col("first")["final_url"], F.coalesce(F.col("second")["final_url"], F.col("first")["final_url"]))).alias("sample"))
    return group_findings(rows, named, metric)


#: Rules on values that several pages share: number, severity, evidence and advice.
SHARED = {
    "duplicate_title": (0, "medium", lambda v, n, s: say('Title "{}" is identical across {} crawled pages (e.g. {}).', v, n, listed(s)), rules.TITLE_FIX),
    "duplicate_meta_description": (1, "low", lambda v, n, s: say('Meta description "{}..." is duplicated across {} pages.', F.substring(v, 1, 50), n), rules.DESCRIPTION_FIX),
}


def shared_value(metric: str) -> Column:
    """What pages may share, of a page's facts."""
    return F.col("title") if metric == "duplicate_title" else F.when(F.col("n_descriptions") > 0, F.col("description"))


def shared_rows(facts: DataFrame, value: Column) -> DataFrame:
    """(seq, final_url, value) of the pages that have one."""
    return facts.select("seq", "final_url", value.alias("value")).filter("value is not null and value <> ''")


def group_findings(rows: DataFrame, groups: DataFrame, metric: str) -> DataFrame:
    """One finding per page (seq, final_url, value) of the groups (value, n, group_seq, sample)."""
    rule_no, severity, evidence, fix = SHARED[metric]
    found = rows.join(groups, "value")
    return found.select(F.lit(2 + rule_no).alias("phase"), F.col("group_seq").alias("seq"), F.lit(rule_no).alias("rule_no"), F.col("seq").cast("int").alias("item_no"), *_finding(metric, severity, F.col("final_url"), evidence(F.col("value"), F.col("n"), F.col("sample")), fix))


def cross_page_findings(facts: DataFrame) -> DataFrame:
    """Titles and descriptions that several pages share."""
    title, description = (_shared(facts, shared_value(m), m) for m in SHARED)
    return title.unionByName(description)


def site_findings(site_files: DataFrame) -> DataFrame:
    """Rules on (site, path, status, body): a missing llms.txt, and robots.txt groups that shut AI crawlers out."""
    ok = F.col("status").between(200, 399)
    body = F.coalesce("body", F.lit(""))
    url = F.concat("site", "path")
    llms = site_files.filter((F.col("path") == "/llms.txt") & (~ok | (F.length(F.trim(body)) < 10)))
    llms = llms.select(F.lit(0).alias("phase"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("rule_no"), F.lit(0).alias("item_no"), *_finding("llms_txt_missing", "low", url, say("No active /llms.txt found (HTTP status {}).", "status"), rules.LLMS_FIX))
    shut = F.array_compact(F.array(*(F.when(body.rlike(rf"(?is)User-agent:\s*{bot}\b.*?Disallow:\s*/\s*(?:\n|\z)"), F.lit(bot)) for bot in rules.BOTS)))
    bots = site_files.filter((F.col("path") == "/robots.txt") & ok).withColumn("shut", shut).filter(F.size("shut") > 0)
    bots = bots.select(F.lit(0).alias("phase"), F.lit(0).cast("bigint").alias("seq"), F.lit(1).alias("rule_no"), F.lit(0).alias("item_no"), *_finding("ai_crawler_blocked", "medium", url, say("robots.txt explicitly blocks AI search crawlers: {}.", F.array_join("shut", ", ")), rules.BOTS_FIX))
    return llms.unionByName(bots)


def audit(pages: DataFrame, site_files: DataFrame | None = None, sitemap: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """All findings of a page table, with the order columns; site files and sitemap are optional.

    Pass `facts` (a persisted or written facts_of) to share one parse with other questions.
    """
    facts = facts_of(pages) if facts is None else facts
    out = crawl_findings(pages, sitemap).unionByName(page_findings(facts)).unionByName(cross_page_findings(facts))
    return out.unionByName(site_findings(site_files)) if site_files is not None else out


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*ORDER).select(*FINDING)


def severity_rank(severity) -> Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    return F.array_position(F.array(*map(F.lit, rules.SEVERITIES)), c)


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity and in total (severity null)."""
    return findings.rollup("severity").agg(F.count("*").alias("n"))


def health(findings: DataFrame) -> DataFrame:
    """One row: health_score, band, total, and the summary sentence; 40 at least."""
    count = lambda s: F.count_if(F.col("severity") == s)
    score = F.greatest(F.lit(40), F.lit(100) - count("critical") * 15 - count("high") * 8)
    row = findings.agg(score.alias("health_score"), F.count("*").alias("total"))
    band = F.when(F.col("health_score") >= 80, "good").when(F.col("health_score") >= 60, "fair").otherwise("poor")
    return row.withColumn("band", band).withColumn("overview", say("Site technical evaluation observed {} findings with score {}/100.", "total", "health_score"))


def canonical_mismatches(facts: DataFrame) -> DataFrame:
    """(seq, final_url, canonical_href) where an absolute canonical names another page."""
    absolute = (F.col("n_canonical") == 1) & F.col("canonical_href").rlike("^https?://")
    from ..functions.urls import normalize_url

    return facts.filter(absolute & (normalize_url("canonical_href") != normalize_url("final_url"))).select("seq", "final_url", "canonical_href")


def with_enhanced_fixes(findings: DataFrame, enhance=None) -> DataFrame:
    """Apply a function on the findings frame that rewrites suggested_fix; without one they stay as they are."""
    return findings if enhance is None else enhance(findings)


def numbered(findings: DataFrame) -> DataFrame:
    """A position within each page, for pagination by page and never over all findings at once."""
    return findings.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy(*ORDER)))
