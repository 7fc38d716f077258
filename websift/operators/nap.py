"""Business name, address and phone: candidates, groups, verdicts and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textnorm import norm_field
from ..sources import dom

# The fields in report order, and the sources that count as structured.
FIELDS = ("name", "address", "phone")
STRUCTURED = ("jsonld", "microdata", "tel_link")
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
REPORT = (
    "field string, pages_compared array<string>, values array<struct<value:string,normalized:string,pages:array<string>,occurrences:bigint,sources:array<string>>>, "
    "normalized_values array<string>, confidence double, confidence_explanation string, verdict string"
)


def normalized(candidates: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(field, value, page, source, seq, pos) candidates with white space collapsed and `normalized` added; empty ones go."""
    value = F.trim(F.regexp_replace("value", r"(?U)\s+", " "))
    rows = candidates.withColumn("value", value).filter(F.char_length("value") >= 2)
    return rows.withColumn("normalized", norm_field("field", "value", ascii_only)).filter("normalized <> ''")


def page_candidates(pages: DataFrame) -> DataFrame:
    """Candidates from the markup of every page with HTML, whatever its status."""
    parsed = dom.parse_pages(pages.filter("html <> ''").select("seq", F.col("final_url").alias("page"), "html"), ("contacts",))
    rows = parsed.select("seq", "page", F.posexplode("contacts").alias("pos", "c")).select("c.field", "c.value", "page", "c.source", "seq", "pos")
    return normalized(rows)


def text_phones(rows: DataFrame, text_col: str = "text", page_col: str = "page", seq_col: str = "seq") -> DataFrame:
    """Phone candidates anywhere in plain text."""
    found = rows.select(F.col(seq_col).alias("seq"), F.col(page_col).alias("page"), F.posexplode(F.regexp_extract_all(text_col, F.lit(PHONE), F.lit(0))).alias("pos", "value"))
    return normalized(found.select(F.lit("phone").alias("field"), "value", "page", F.lit("text").alias("source"), "seq", "pos"), ascii_only=True)


def groups(candidates: DataFrame, listed: bool = False) -> DataFrame:
    """One row per field and normal form: occurrences, the first value, its place, the distinct sources; with `listed` the distinct pages.

    The pages of a value are as many as a corpus has, so they are listed for reports on one site only.
    """
    at = F.struct("seq", "pos")
    lists = [F.array_sort(F.collect_set("page")).alias("pages")] if listed else []
    return candidates.groupBy("field", "normalized").agg(
        F.count("*").alias("occurrences"), F.min_by("value", at).alias("value"), F.min(at).alias("first"), *lists,
        F.array_sort(F.collect_set("source")).alias("sources"),  # a handful of kinds
    )


def ranked(grouped: DataFrame) -> DataFrame:
    """Groups with their rank in the field: most occurrences first, first seen breaks ties."""
    return grouped.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.col("occurrences").desc(), "first")))


def verdicts(candidates: DataFrame) -> DataFrame:
    """One row per field, also for those without a candidate: verdict, confidence, counts and the explanation.

    Candidates are reduced to groups first, and fields only see groups, so a hot value is counted where it stands.
    """
    spark = candidates.sparkSession
    found = groups(candidates)
    order = F.struct((-F.col("occurrences")).alias("less"), "first")
    per_field = found.groupBy("field").agg(
        F.count("*").alias("n_values"), F.sum("occurrences").alias("n_candidates"), F.min_by(F.struct("normalized", "value", "sources"), order).alias("top"),
        F.bool_or(F.arrays_overlap("sources", F.array(*map(F.lit, STRUCTURED)))).alias("structured"),
    )
    per_field = per_field.select("field", "n_values", "n_candidates", "structured", F.col("top.normalized").alias("one"), F.col("top.value").alias("value"), F.col("top.sources").alias("own_sources"))
    second = found.join(per_field.select("field", "one"), "field").filter("normalized <> one").groupBy("field").agg(F.min_by("normalized", order).alias("two"))
    count = lambda c: candidates.select("field", c).distinct().groupBy("field").agg(F.count("*").alias(f"n_{c}s"))
    fields = spark.createDataFrame([(i, f) for i, f in enumerate(FIELDS)], "field_no int, field string")
    rows = fields.join(per_field, "field", "left").join(second, "field", "left").join(count("page"), "field", "left").join(count("source"), "field", "left")
    one_value = F.lit(0.80) + F.when(F.col("n_pages") >= 2, 0.10).otherwise(0.0) + F.when(F.col("structured"), 0.06).otherwise(0.0) + F.when(F.col("n_sources") >= 2, 0.03).otherwise(0.0)
    several = F.lit(0.70) + F.lit(0.08) * F.least("n_pages", F.lit(3))
    none, consistent = F.col("n_values").isNull(), F.col("n_values") == 1
    said = (
        F.when(none, F.format_string("No business %s indicators were detected on any crawled page.", "field"))
        .when(consistent, F.format_string("Consistent %s verified across %d page(s) and %d source(s) (%s) with 0 discrepancies.", "field", "n_pages", "n_sources", F.array_join("own_sources", ", ")))
        .otherwise(F.format_string("Found %d conflicting normalized %s values across %d pages (e.g. '%s' vs '%s'). The mismatch stems from distinct content rather than formatting differences.", "n_values", "field", "n_pages", "one", "two"))
    )
    return rows.select(
        "field_no", "field", F.when(none, "not_found").when(consistent, "consistent").otherwise("mismatch").alias("verdict"),
        F.when(none, 0.0).when(consistent, F.round(F.least(F.lit(0.99), one_value), 2)).otherwise(F.round(F.least(F.lit(0.98), several), 2)).alias("confidence"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("value", F.lit("")).alias("value"), said.alias("confidence_explanation"),
    )


def report(candidates: DataFrame) -> DataFrame:
    """The three field reports, nested, in field order; a report is per site, so its lists stay what a site has."""
    found = ranked(groups(candidates, listed=True))
    item = F.struct("rank", F.struct("value", "normalized", "pages", "occurrences", "sources").alias("v"))
    listed = found.groupBy("field").agg(F.array_sort(F.collect_list(item)).alias("items"))
    listed = listed.select("field", F.transform("items", lambda i: i["v"]).alias("values"))
    compared = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("values", lambda v: v["pages"])))), F.array().cast("array<string>"))
    empty = F.expr("cast(array() as array<struct<value:string,normalized:string,pages:array<string>,occurrences:bigint,sources:array<string>>>)")
    rows = verdicts(candidates).join(listed, "field", "left").withColumn("values", F.coalesce("values", empty))
    return rows.orderBy("field_no").select("field", compared.alias("pages_compared"), "values", F.transform("values", lambda v: v["normalized"]).alias("normalized_values"), "confidence", "confidence_explanation", "verdict")


def canonical(found: DataFrame) -> DataFrame:
    """One row (name, address, phone): each field's first value, '' where there is none."""
    pick = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, F.trim("value"))), F.lit("")).alias(f)
    return found.agg(*map(pick, FIELDS))
