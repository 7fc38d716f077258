"""Sharding: groups that must stay together go, largest first, to the least-loaded shard.

Longest-processing-time scheduling needs every unit's size in one place, so the units are bounded: each group above
total / (units_per_shard * shards) is a unit of its own (so there are at most units_per_shard * shards of them), and
what is smaller is pooled by the hash of its key into a fixed number of parcels. In a table of fewer groups than that
the schedule is the plain one over all groups, but for those far below the mean size. The fullest shard is above the
least loaded by one unit at most.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, finished, materialize

UNITS = "unit long, shard int"


def schedule(units: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int]]:
    """(unit, size) rows to (unit, shard): largest first, each to the shard with the least so far; ties by number."""
    heap = [(0, shard) for shard in range(n_shards)]
    placed = []
    for unit, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heapq.heappop(heap)
        placed.append((unit, shard))
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", units_per_shard: int = 4096, parcels: int = 4096, rows_per_run: int = 256) -> DataFrame:
    """Place every row in a shard so that equal texts share one and the shards' bytes come out near equal.

    Returns id, size (UTF-8 bytes + 1), text_crc32, shard, slot (0, 1, ... within the shard). A null text counts as an
    empty one and shares its group; repeated rows and null ids are rows like any other; an empty table gives no rows.
    Other columns are not read, whatever their names. Of groups of one size the smaller key (MD5 of the text) goes first.
    Slots are numbered run by run: a run is at most about rows_per_run rows of one unit, so that a group of any size is
    numbered by many tasks, and its runs' offsets are a prefix sum over run counts.
    """
    spark = docs.sparkSession
    text = as_bytes(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = materialize(groups.withColumn("large", F.col("bytes") * (units_per_shard * n_shards) > F.lit(total)), "shard-groups", rows)
    large = groups.filter("large").orderBy("key").select("key", "bytes", "n").collect()  # at most units_per_shard * n_shards rows
    small = (
        groups.filter("not large")
        .groupBy(F.pmod(F.xxhash64("key"), F.lit(parcels)).alias("unit"))
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        .collect()  # at most `parcels` rows
    )
    units = [(r["unit"], r["bytes"], r["n"]) for r in small] + [(parcels + i, r["bytes"], r["n"]) for i, r in enumerate(large)]
    shard_of = dict(schedule([(u, b) for u, b, _ in units], n_shards))
    placed = spark.createDataFrame([(u, shard_of[u], -(-n // rows_per_run)) for u, _, n in units], "unit long, shard int, runs long")
    named = spark.createDataFrame([(bytes(r["key"]), parcels + i) for i, r in enumerate(large)], "key binary, named long")

    runs = (
        rows.join(F.broadcast(named), "key", "left")  # at most units_per_shard * n_shards rows
        .withColumn("unit", F.coalesce("named", F.pmod(F.xxhash64("key"), F.lit(parcels))))
        .join(F.broadcast(placed), "unit")  # at most parcels + units_per_shard * n_shards rows
        .withColumn("run", F.pmod(F.xxhash64("id", "text_crc32"), F.col("runs")))
    )
    # repeated (id, text) rows would all hash to one run: a row number cannot be had without a shuffle, so they share it
    before = Window.partitionBy("shard").orderBy("unit", "run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        runs.groupBy("shard", "unit", "run").agg(F.count("*").alias("rows"))
        .select("unit", "run", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("unit", "run").orderBy("id", "text_crc32")
    placed_rows = (
        runs.withColumn("n", F.row_number().over(within))
        .join(offsets, ["unit", "run"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("offset") + F.col("n") - 1).alias("slot"))
    )
    return finished(placed_rows, "shard-slots", rows, groups)
