"""The boundary to language models and web search: prompts out, text in, everything between as Columns.

No query reaches the network. A model is a function from a frame with `prompt` to the same frame with `reply`; without
one, every question falls back to what can be said without it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import brand_hint, host

Model = Callable[[DataFrame], DataFrame]
ACTION = "struct<priority:int,impact:string,category:string,action:string,description:string>"
SUMMARY = f"health_score int, overview string, priority_actions array<{ACTION}>"
CITATION = "struct<source:string,url:string,name:string,address:string,phone:string,match_status:string,discrepancy_details:string>"
OFFSITE = f"citation_health_score int, summary string, citations array<{CITATION}>, recommendations array<string>"
# What is said where a model, or its search, comes back with nothing.
NO_MODEL = "A language model with web search is required to look for citations of this business."
NO_MODEL_ADVICE = "Configure a model to enable off-site citation checking."
NO_RESULTS = "No external web citations or directory listings found."
DEFAULT_ADVICE = ("Ensure external directory listings match in-site canonical address exactly.", "Verify phone numbers across local citation aggregators.")
LISTED, LISTED_ADDRESS, LISTED_PHONE, UNKNOWN = "Identified external citations for ", ". Listed address: ", ", phone: ", "N/A"
NOT_LISTED, CLAIM = "No high-confidence external business citations or directory listings were discovered on the public web for ", "Claim and verify a Google Business Profile listing for "
FALLBACK_ADVICE = ("Register consistent business citations on major local directories (Bing Places, Apple Maps, Yelp).", "Ensure the Name, Address, and Phone on external listings match the website markup exactly.")


def reply_json(reply) -> Column:
    """The outermost {...} of a reply, thinking removed; null if there is none."""
    c = F.col(reply) if isinstance(reply, str) else reply
    found = F.regexp_extract(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?s)\{.*\}", 0)
    return F.nullif(found, F.lit(""))


def repaired(text: Column) -> Column:
    """Trailing commas dropped, missing ones between objects or arrays put in."""
    out = F.regexp_replace(text, r",\s*([\]\}])", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"\}\s*\{", "}, {"), r"\]\s*\[", "], [")


def sound_json(reply) -> Column:
    """The reply's JSON object after repair, or as it came, whichever parses; null if neither does."""
    raw = reply_json(reply)
    ok = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(ok(repaired(raw)), repaired(raw)).when(ok(raw), raw)


def search_text(results: DataFrame) -> DataFrame:
    """(query, search_text) of (query, rank, title, href, body) rows: the first five, in order."""
    item = F.format_string("[%d] %s\nURL: %s\nSnippet: %s", "rank", F.coalesce("title", F.lit("Listing")), F.coalesce("href", F.lit("")), F.coalesce("body", F.lit("")))
    rows = results.filter("rank <= 5").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("t")))).alias("items"))
    return rows.select("query", F.coalesce(F.nullif(F.array_join(F.transform("items", lambda i: i["t"]), "\n\n"), F.lit("")), F.lit(NO_RESULTS)).alias("search_text"))


def summary_prompt(findings: DataFrame, url: str, order: tuple[str, ...] = ("phase", "seq", "rule_no", "item_no")) -> DataFrame:
    """One prompt: counts by severity and the first six findings."""
    first = findings.orderBy(*order).limit(6)
    line = F.format_string("- [%s] %s: %s", F.upper("severity"), "issue", F.substring("evidence", 1, 80))
    samples = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("t")))), lambda x: x["t"]), "\n").alias("samples"))
    counts = findings.agg(F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")))
    text = F.format_string(f"Audit target: {url.replace('%', '%%')}\nIssues: %d (critical %d, high %d, medium %d, low %d)\n%s\nReply with JSON: {{{SUMMARY}}}", "n", "critical", "high", "medium", "low", "samples")
    return counts.crossJoin(samples).filter("n > 0").select(text.alias("prompt"))  # one row each


def summarize(findings: DataFrame, url: str, model: Model | None = None) -> DataFrame:
    """A model's (health_score, overview, priority_actions, is_ai), or no row without a model, findings or a usable reply."""
    prompts = summary_prompt(findings, url)
    replies = model(prompts) if model else prompts.withColumn("reply", F.lit(None).cast("string"))
    rows = replies.select(F.from_json(reply_json("reply"), SUMMARY).alias("s")).filter("s.overview is not null and s.priority_actions is not null")
    return rows.select("s.*", F.lit(True).alias("is_ai"))


def deterministic_summary(health: DataFrame) -> DataFrame:
    """The same shape from the health row alone."""
    action = F.struct(F.lit(1).alias("priority"), F.lit("High").alias("impact"), F.lit("SEO").alias("category"), F.lit("Remediate Priority Findings").alias("action"), F.lit("Resolve high severity issues.").alias("description"))
    return health.select("health_score", "overview", F.array(action).alias("priority_actions"), F.lit(False).alias("is_ai"), F.lit("Deterministic Rule-Based").alias("provider"))


def answer_prompts(candidates: DataFrame, queries: DataFrame, shown: int = 8, chars: int = 350) -> DataFrame:
    """(query_id, query, prompt) over (query_id, n, url, text) candidates: the first `shown`, white space collapsed and cut for the prompt."""
    text = F.format_string("[%d] (Page: %s)\n%s", "n", "url", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, chars))
    rows = candidates.filter(F.col("n") <= shown).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("items"))
    joined = F.array_join(F.transform("items", lambda i: i["t"]), "\n\n")
    return rows.join(queries, "query_id").select("query_id", "query", F.concat(F.lit('User query: "'), "query", F.lit('"\n\n'), joined, F.lit("\n\nReply with JSON: {passage_index, verbatim_excerpt, direct_answer}")).alias("prompt"))


def model_answers(candidates: DataFrame, replies: DataFrame, shown: int = 8) -> DataFrame:
    """(query_id, url, excerpt, answer) of replies that name a shown passage and quote it word for word; a missing excerpt is the passage."""
    said = replies.select("query_id", F.from_json(reply_json("reply"), "passage_index int, verbatim_excerpt string, direct_answer string").alias("r")).select("query_id", F.col("r.passage_index").alias("n"), "r.verbatim_excerpt", "r.direct_answer")
    rows = said.filter(F.col("n").between(1, shown)).join(candidates, ["query_id", "n"])
    excerpt = F.coalesce(F.nullif("verbatim_excerpt", F.lit("")), F.col("text"))
    return rows.filter(F.col("text").contains(excerpt)).select("query_id", "url", excerpt.alias("excerpt"), F.coalesce(F.nullif("direct_answer", F.lit("")), excerpt).alias("answer"))


def offsite_report(canonical: DataFrame, url: str, replies: DataFrame | None = None) -> DataFrame:
    """One off-site report from the canonical row and a model's reply (one row `reply`), or the fixed ones without."""
    site = canonical.withColumn("_url", F.lit(url))
    known = F.when(F.col("name") != "", F.col("name")).otherwise(brand_hint("_url"))
    in_site = F.struct("name", "address", "phone")
    no_citations = F.expr(f"cast(array() as array<{CITATION}>)")
    if replies is None:
        return site.select(
            F.lit("no_llm").alias("status"), F.lit(None).cast("int").alias("citation_health_score"), F.lit(NO_MODEL).alias("summary"), no_citations.alias("citations"),
            F.array(F.lit(NO_MODEL_ADVICE)).alias("recommendations"), in_site.alias("in_site_canonical"),
        )
    rows = site.crossJoin(replies.select(sound_json("reply").alias("j")).limit(1)).withColumn("r", F.from_json("j", OFFSITE))  # one row each
    told = F.from_json("j", "summary struct<address:string,phone:string>")["summary"]
    good = F.col("r.citations").isNotNull() | F.col("r.summary").isNotNull()
    citations = F.coalesce("r.citations", no_citations)
    summary = F.when(told.isNotNull(), F.concat(F.lit(LISTED), known, F.lit(LISTED_ADDRESS), F.coalesce(told["address"], F.lit(UNKNOWN)), F.lit(LISTED_PHONE), F.coalesce(told["phone"], F.lit(UNKNOWN)), F.lit("."))).otherwise(F.col("r.summary"))
    nothing = F.concat(F.lit(NOT_LISTED), known, F.lit(" ("), host("_url"), F.lit(")."))
    claim = F.concat(F.lit(CLAIM), known, F.lit("."))
    return rows.select(
        F.when(good, "success").otherwise("no_citations_found").alias("status"),
        F.when(good, F.coalesce("r.citation_health_score", F.when(F.size(citations) > 0, 85).otherwise(50))).otherwise(55).alias("citation_health_score"),
        F.when(good, summary).otherwise(nothing).alias("summary"), F.when(good, citations).otherwise(no_citations).alias("citations"),
        F.when(good, F.coalesce("r.recommendations", F.array(*map(F.lit, DEFAULT_ADVICE)))).otherwise(F.array(claim, *map(F.lit, FALLBACK_ADVICE))).alias("recommendations"), in_site.alias("in_site_canonical"),
    )
