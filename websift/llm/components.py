"""Connected components of an edge table by repeated hooking and contraction, with DataFrame joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def spanning(pairs) -> dict[int, int]:
    """Vertex to smallest vertex of its component, for one batch of edges in memory (union-find with path halving)."""
    parent: dict[int, int] = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in list(parent)}


def _thin(batches):
    for batch in batches:
        found = spanning(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        edges = [(v, r) for v, r in found.items() if v != r]
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges to (id, component): the smallest id reachable, for every id that has an edge.

    Each batch of edges is first replaced by a spanning star of its own. Then, until no edge is left, every vertex takes
    the smallest of itself and its neighbours as parent, parents are looked up twice, and edges move to their ends'
    parents. Every round's tables are written, so that hot parents meet plain joins that the planner can split.
    Loops, repeated and reversed edges don't matter; an empty table gives no rows.
    """
    given = edges.select("a", "b")
    edges = materialize(given.filter("a <> b").mapInArrow(_thin, "a long, b long").distinct(), "cc-edges", given)
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")), "cc-hooked", edges)
        before = upper = hooked
        for _ in range(2):
            up = upper.select(F.col("id").alias("component"), F.col("component").alias("upper"))
            upper = upper.join(up, "component", "left").select("id", F.coalesce("upper", "component").alias("component"))
        hooked = materialize(upper, "cc-hooked", before)
        drop_table(before)
        step = hooked.select(F.col("id").alias("component"), F.col("component").alias("upper"))
        if labels is None:
            labels = hooked
        else:
            before, labels = labels, materialize(labels.join(step, "component", "left").select("id", F.coalesce("upper", "component").alias("component")), "cc-labels", labels)
            drop_table(before)
        moved = edges.join(hooked.select(F.col("id").alias("a"), F.col("component").alias("pa")), "a")
        moved = moved.join(hooked.select(F.col("id").alias("b"), F.col("component").alias("pb")), "b")
        moved = moved.filter("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
        before, edges = edges, materialize(moved.mapInArrow(_thin, "a long, b long").distinct(), "cc-edges", edges)
        drop_table(before)
        if labels is not hooked:
            drop_table(hooked)
    if labels is not None:
        drop_table(edges)
        return labels
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
