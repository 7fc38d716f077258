"""Sinks: findings, reports and answers as files, and the JSON envelopes that clients read."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .onpage import FINDING, ORDER


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row, written by the executors; the form for results of any size."""
    df.write.mode("overwrite").json(path)


def write_json_document(df: DataFrame, path: str, single: bool = False) -> None:
    """One indented JSON array (or object) in one local file, streamed row by row through the driver; for one site's report (write_json_array is the form for any size)."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    rows = (json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator())
    with open(path, "w", encoding="utf-8") as f:
        if single:
            json.dump(next(rows, None), f, indent=2, ensure_ascii=False)
            return
        f.write("[")
        for i, row in enumerate(rows):
            f.write(",\n" if i else "\n")
            f.write("\n".join("  " + line for line in json.dumps(row, indent=2, ensure_ascii=False).split("\n")))
        f.write("\n]")


def write_json_array(df: DataFrame, path: str, order: tuple[str, ...]) -> None:
    """One JSON array in many files: read one after another in the order of their names, they are the document.

    Rows are sorted by ranges over all tasks, by `order` and then by their text; equal rows stay as often as they were.
    An empty frame gives an empty array. Tasks write through the file commit of the session, so that attempts that fail
    leave nothing. The driver sees the first row alone.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    lines = df.select(*(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_line"))
    rows = cut(lines.groupBy(*keys, "_line").agg(F.count("*").alias("_n")), "document")
    first = rows.orderBy(*keys, "_line").first()
    starts = F.lit(first is not None) & (F.col("_copy") == 1)
    for k in (*keys, "_line") if first else ():
        starts &= F.col(k).eqNullSafe(F.lit(first[k]))
    each = rows.select(F.lit(1).alias("_at"), *keys, "_line", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"))
    each = each.withColumn("value", F.concat(F.when(starts, "").otherwise(","), "_line"))
    ends = df.sparkSession.createDataFrame([(0, "["), (2, "]")], "_at int, value string")
    whole = each.unionByName(ends, allowMissingColumns=True)
    sort = ["_at", *keys, "_line", "_copy"]
    whole.repartitionByRange(*sort).sortWithinPartitions(*sort).select("value").write.mode("overwrite").text(path)


def _ordered(findings: DataFrame) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, F.struct(*FINDING).alias("f")))), lambda x: x["f"])


def audit_envelope(findings: DataFrame, url: str, summary: DataFrame | None = None) -> DataFrame:
    """One row of JSON for one site: task, url, summary, findings_count, findings."""
    body = findings.agg(F.count("*").alias("findings_count"), _ordered(findings).alias("findings"))
    told = summary.select(F.struct("*").alias("summary")).limit(1) if summary is not None else None
    body = body.join(told, how="left") if told is not None else body.withColumn("summary", F.lit(None).cast("string"))
    return body.select(F.to_json(F.struct(F.lit("q1_onpage").alias("task"), F.lit(url).alias("url"), "summary", "findings_count", "findings"), {"ignoreNullFields": "false"}).alias("json"))


def nap_envelope(report: DataFrame, url: str, off_site: DataFrame) -> DataFrame:
    """One row of JSON for one site: the field reports (under two names) and the off-site report."""
    fields = report.agg(F.collect_list(F.struct("*")).alias("in_site"))
    rows = fields.join(off_site.select(F.struct("*").alias("off_site")).limit(1), how="left")
    return rows.select(F.to_json(F.struct(F.lit("q2_nap").alias("task"), F.lit(url).alias("url"), "in_site", "off_site", F.col("in_site").alias("fields")), {"ignoreNullFields": "false"}).alias("json"))


def answer_envelopes(answers: DataFrame, url: str) -> DataFrame:
    """One row of JSON per answer."""
    answer = F.struct("query", "answer", "url", "excerpt")
    return answers.select("query_id", F.to_json(F.struct(F.lit("q3_qa").alias("task"), F.lit(url).alias("url"), "query", answer.alias("answer")), {"ignoreNullFields": "false"}).alias("json"))


def export_envelope(findings: DataFrame, title: str, url: str) -> DataFrame:
    """One row of JSON as the console exports it; the time is when the query ran."""
    body = findings.agg(F.count("*").alias("total_findings"), _ordered(findings).alias("findings"))
    return body.select(F.to_json(F.struct(F.lit(title).alias("report_title"), F.lit(url).alias("target_url"), F.current_timestamp().cast("string").alias("generated_at"), "total_findings", "findings")).alias("json"))


def consistency_ratio(verdicts: DataFrame) -> DataFrame:
    """One row: consistent fields, all fields, and the label shown for them."""
    row = verdicts.agg(F.count_if(F.col("verdict") == "consistent").alias("consistent"), F.count("*").alias("fields"))
    return row.withColumn("label", F.format_string("%d/%d consistent", "consistent", "fields"))
