"""Pages that drop into a folder, as a stream: each URL once within a watermark, then the same rules as in batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import onpage
from ..sources.pages import as_pages


def page_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """A stream over Parquet captures in a folder; the schema (DDL) must name url, html and a timestamp `captured_at`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def first_captures(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each url's first capture; state is dropped behind the watermark."""
    return stream.withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(["url"])


def findings_stream(stream: DataFrame) -> DataFrame:
    """Page rules on a stream of pages: no cross-page rule, as these need the whole site."""
    pages = as_pages(stream)
    return onpage.crawl_findings(pages).unionByName(onpage.page_findings(onpage.facts_of(pages)))


def severity_windows(stream: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Pages per event-time window and outcome, late ones within the delay included."""
    outcome = F.when(F.length("html") > 0, "served").otherwise("empty").alias("outcome")
    return stream.withWatermark("captured_at", delay).groupBy(F.window("captured_at", width), outcome).agg(F.count("*").alias("n"))


_SHARED = "metric string, value string, n long, group_seq long, sample array<string>"
_SEEN = "n long, seq array<long>, page array<string>"


def shared_values(stream: DataFrame) -> DataFrame:
    """(metric, value, n, group_seq, sample): titles and descriptions that several pages share, again whenever that changes.

    A row takes the place of the earlier ones of its metric and value. State is a number and the two first pages a
    value, whatever the number of pages; no value is forgotten. Pages come once each: drop repeated captures before. Needs
    output mode update.
    """
    facts = onpage.facts_of(as_pages(stream))
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), onpage.shared_value(m).alias("value")) for m in onpage.SHARED)))
    rows = facts.select("seq", F.col("final_url").alias("page"), values.alias("v")).select("v.*", "seq", "page").filter("value is not null and value <> ''")

    def seen(key, batches, state):
        n, seq, page = state.get if state.exists else (0, [], [])
        first = set(zip(seq, page, strict=True))
        for batch in batches:
            n += len(batch)
            first = set(sorted(first | set(batch.nsmallest(2, "seq", keep="all")[["seq", "page"]].itertuples(index=False, name=None)))[:2])
        first = sorted((int(s), str(p)) for s, p in first)
        state.update((n, [s for s, _ in first], [p for _, p in first]))
        if n > 1:
            yield pd.DataFrame({"metric": [key[0]], "value": [key[1]], "n": [n], "group_seq": [first[0][0]], "sample": [[first[0][1], first[-1][1]]]})

    return rows.groupBy("metric", "value").applyInPandasWithState(seen, _SHARED, _SEEN, "update", GroupStateTimeout.NoTimeout)


def shared_findings(facts: DataFrame, updates: DataFrame) -> DataFrame:
    """The cross-page findings of the pages seen so far, from what shared_values gave: the latest row of each value counts."""
    latest = updates.groupBy("metric", "value").agg(F.max_by(F.struct("n", "group_seq", "sample"), "n").alias("g")).select("metric", "value", "g.*")
    parts = [onpage.group_findings(onpage.shared_rows(facts, onpage.shared_value(m)), latest.filter(F.col("metric") == m).drop("metric"), m) for m in onpage.SHARED]
    return parts[0].unionByName(parts[1])
