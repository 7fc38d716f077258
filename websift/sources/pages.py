"""Captured pages: the page schema, and readers that fill in what a capture doesn't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = (
    "seq bigint, url string, status int, content_type string, html string, final_url string, error string, "
    "headers map<string,string>, response_time double, referrers array<string>, depth int, redirect_chain array<struct<status:int,url:string>>"
)
# Content types whose body is kept as HTML.
HTML_TYPES = ("text/html", "application/xhtml+xml")
_DEFAULTS = {
    "status": "200", "content_type": "'text/html'", "html": "''", "error": "cast(null as string)", "headers": "cast(map() as map<string,string>)", "response_time": "0.0D",
    "referrers": "cast(array() as array<string>)", "depth": "0", "redirect_chain": "cast(array() as array<struct<status:int,url:string>>)",
}


def as_pages(df: DataFrame) -> DataFrame:
    """Any frame with a url (and page_id or seq as the order) in the page schema; missing columns get defaults."""
    have = set(df.columns)
    seq = "seq" if "seq" in have else "page_id" if "page_id" in have else "0"
    cols = [F.expr(seq).cast("bigint").alias("seq"), F.col("url")]
    for name, default in _DEFAULTS.items():
        cols.append((F.coalesce(F.col(name), F.expr(default)) if name in have and name != "error" else F.col(name) if name in have else F.expr(default)).alias(name))
    cols.append((F.coalesce("final_url", "url") if "final_url" in have else F.col("url")).alias("final_url"))
    names = [c.split(" ")[0] for c in PAGE.split(", ")]
    return df.select(*cols).select(*names)


def responses(raw: DataFrame) -> DataFrame:
    """Raw responses as pages: media type before ';' in lower case, header names in lower case, other types than HTML without body.

    A failed fetch (error not null) is status 0 without body.
    """
    kind = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
    failed = F.col("error").isNotNull() if "error" in raw.columns else F.lit(False)
    out = raw.withColumn("content_type", F.when(failed, F.lit("")).otherwise(kind))
    if "headers" in raw.columns:
        out = out.withColumn("headers", F.map_from_entries(F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]), e["value"]))))
    out = out.withColumn("html", F.when(F.col("content_type").isin(*HTML_TYPES), F.coalesce("html", F.lit(""))).otherwise(F.lit("")))
    out = out.withColumn("response_time", F.round("response_time", 3)) if "response_time" in raw.columns else out
    return as_pages(out.withColumn("status", F.when(failed, F.lit(0)).otherwise(F.col("status"))) if "status" in raw.columns else out)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages from Parquet; only the columns that a query uses are read."""
    return as_pages(spark.read.parquet(path))


def request_bodies(df: DataFrame, column: str = "body") -> DataFrame:
    """JSON request bodies to columns with their defaults; what isn't JSON counts as an empty object."""
    schema = "url string, query string, max_pages int, timeout double, concurrency int, ai_provider string"
    b = F.from_json(F.col(column), schema)
    get = lambda name, default: F.coalesce(b[name], F.lit(default)).alias(name)
    url = F.trim(F.coalesce(b["url"], F.lit("")))
    from ..functions.urls import with_scheme

    return df.select(
        F.when(url != "", with_scheme(url)).otherwise(url).alias("url"), F.trim(F.coalesce(b["query"], F.lit(""))).alias("query"),
        get("max_pages", 25), get("timeout", 12.0), F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(b["concurrency"], F.lit(5)))).alias("concurrency"), get("ai_provider", "auto"),
    )
