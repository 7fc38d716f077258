"""Near-duplicate vectors by Euclidean p-stable hashing, followed by exact cosine checks.

A table's key is a few Gaussian projections of the normalised vector, shifted and cut into cells of one width; vectors
that share a key in any table are compared exactly. A pair is counted in the first table where its keys meet, so links
are counted inside the buckets and no pair leaves them. Large buckets are cut into chunks and compared chunk by chunk,
each pair of chunks in a task of its own; equal vectors are compared once, with their number as a weight.

The more vectors there are, the more projections a key has, so that a bucket's number of strangers stays the same, and
the more tables there are, so that a pair at the least cosine is found with the same probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, materialize, shuffle_partitions
from .components import connected_components

SIGNED = "id long, weight long, vector binary, sig binary, keys array<long>"


def same_cell(cosine: float, cell: float) -> float:
    """The probability that one shifted Gaussian projection puts two unit vectors at this cosine into one cell (Datar et al., 2004)."""
    r = cell / math.sqrt(max(1e-12, 2 - 2 * cosine))
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def index_plan(n: int, least: float, recall: float, cell: float, strangers: int = 32) -> tuple[int, int]:
    """Tables and projections a key: about `strangers` unrelated vectors of n share a key, and a pair at `least` is found with probability `recall`."""
    width = max(8, math.ceil(math.log(max(1, n / strangers)) / -math.log(same_cell(0.0, cell))))
    return math.ceil(math.log(1 - recall) / math.log(1 - same_cell(least, cell) ** width)), width


def keys_of(x: np.ndarray, tables: int, width: int, cell: float, seed: int) -> np.ndarray:
    """(n, tables) 64-bit keys of the rows of x (normalised, double)."""
    rng = np.random.default_rng([seed, x.shape[1]])
    out = np.zeros((len(x), tables), np.uint64)
    for t in range(tables):
        a, b, m = rng.standard_normal((x.shape[1], width)), rng.uniform(0, cell, width), rng.integers(1, 1 << 63, width, np.uint64) | np.uint64(1)
        cells = np.floor((x @ a + b) / cell).astype(np.int64).view(np.uint64)
        h = (cells * m).sum(1, dtype=np.uint64) + np.uint64(x.shape[1])
        out[:, t] = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by the largest component, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def block_links(left, right, table: int, least: float):
    """Weighted link counts of both sides, and a spanning set of links. A side is (ids, weights, unit rows, signatures); right is None to compare left with itself."""
    own = right is None
    a, b = left, left if own else right
    counts_a, counts_b = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)
    mask = np.zeros((len(a[0]), len(b[0])), bool)
    for i in range(0, len(a[0]), 256):
        near = a[2][i : i + 256] @ b[2].T >= least
        if own:
            near &= np.arange(i, min(i + 256, len(a[0])))[:, None] < np.arange(len(a[0]))[None, :]
        x, y = np.nonzero(near)
        met = np.zeros(len(x), bool)
        for t in range(table):  # already counted in an earlier table
            met |= a[3][i + x, t] == b[3][y, t]
        near[x[met], y[met]] = False
        mask[i : i + 256] = near
    counts_a += mask @ b[1]
    counts_b += a[1] @ mask
    if own:
        counts_a, counts_b, mask = counts_a + counts_b, None, mask | mask.T
    edges = []
    la, lb = np.arange(len(a[0])), np.arange(len(b[0])) + (0 if own else len(a[0]))
    top = len(a[0]) + len(b[0])
    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    sub = mask[np.ix_(rows, cols)]
    while len(rows):
        new_a = np.minimum(la[rows], np.where(sub, lb[cols][None, :], top).min(1))
        la[rows] = new_a
        new_b = np.minimum(lb[cols], np.where(sub, la[rows][:, None], top).min(0))
        same = (new_b == lb[cols]).all()
        lb[cols] = new_b
        if own:
            joined = np.minimum(la, lb)
            same = same and (joined == la).all() and (joined == lb).all()
            la, lb = joined, joined.copy()
        if same:
            break
    ids = a[0] if own else np.concatenate([a[0], b[0]])
    label = la if own else np.concatenate([la, lb])
    moved = np.flatnonzero(label != np.arange(len(label)))
    edges = list(zip(ids[moved].tolist(), ids[label[moved]].tolist(), strict=True))
    return counts_a, counts_b, edges


def near_vectors(vectors: DataFrame, least: float = 0.9, recall: float = 0.968, cell: float = 1.6, chunk: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept (whether it is its component's smallest id).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
    different lengths with each other; rows with a null id come back with a null component and no links. Rows that share
    an id are one vertex: their links add up. All rows are indexed; a pair at cosine `least` is found with probability
    `recall`, one further above it with more, and pairs below `least` never link. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    stored = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"  # floats travel as they came
    x = F.col("x")
    good = F.coalesce(F.size("x") > 0, F.lit(False)) & F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("x", lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.withColumn("good", good & F.col("id").isNotNull())
    unique = materialize(rows.filter("good").groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "vector-unique")
    tables, width = index_plan(unique.count(), least, recall, cell)

    def sign(batches):
        for batch in batches:
            size = np.array([len(v) for v in batch.column(0)])
            flat = batch.column(0).flatten().to_numpy()
            ends = np.cumsum(size)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                v = np.stack([flat[ends[i] - dim : ends[i]] for i in at])
                keys = keys_of(unit(v), tables, width, cell, seed)
                raw = [r.tobytes() for r in v.astype(stored)]
                sig = [r.tobytes() for r in keys.astype("<u8")]
                ids, weights = batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids, weights, pa.array(raw, pa.binary()), pa.array(sig, pa.binary()), listed], names=["id", "weight", "vector", "sig", "keys"])

    signed = materialize(unique.select("x", "id", "weight").mapInArrow(sign, SIGNED), "vector-signed")
    dealt = signed.select("id", F.posexplode("keys").alias("table", "key"))
    sizes = dealt.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes.select("table", "key", F.ceil(F.col("n") / chunk).alias("chunks")), "vector-buckets", signed)
    mine = F.pmod(F.xxhash64("id"), F.col("chunks"))
    members = (
        dealt.join(sizes, ["table", "key"]).join(signed.select("id", "weight", "vector", "sig"), "id").withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("table", "key", F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"), "mine", "id", "weight", "vector", "sig")
    )

    def compare(batches):
        def side(part):
            x = np.stack([np.frombuffer(r[2], stored) for r in part]).astype(np.float64)
            return np.array([r[0] for r in part]), np.array([r[1] for r in part]), unit(x), np.stack([np.frombuffer(r[3], "<u8") for r in part])

        def solve(head, parts):
            (table, _, c1, c2), first, second = head, parts[0], parts[1]
            if c1 == c2:
                if len(first) < 2:
                    return [], []
                left = side(first)
                counts, _, edges = block_links(left, None, table, least)
                return [(i, n) for i, n in zip(left[0].tolist(), counts.tolist(), strict=True) if n], edges
            if not first or not second:
                return [], []
            left, right = side(first), side(second)
            ca, cb, edges = block_links(left, right, table, least)
            return [(i, n) for ids, c in ((left[0], ca), (right[0], cb)) for i, n in zip(ids.tolist(), c.tolist(), strict=True) if n], edges

        head, parts, out = None, ([], []), []

        def flush(force):
            if out and (force or len(out) > 20_000):
                cols = list(zip(*out, strict=True))
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "n", "root"])

        def close():
            counts, edges = solve(head, parts)
            out.extend((i, n, None) for i, n in counts)
            out.extend((a, 0, b) for a, b in edges)

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for table, key, c1, c2, mine, i, w, v, s in zip(*cols, strict=True):
                if head != (table, key, c1, c2):
                    if head:
                        close()
                    head, parts = (table, key, c1, c2), ([], [])
                parts[0 if mine == c1 else 1].append((i, w, v, s))
            if done := flush(False):
                yield done
        if head:
            close()
        if done := flush(True):
            yield done

    key = ["table", "key", "c1", "c2"]
    found = materialize(members.repartition(shuffle_partitions(spark), *key).sortWithinPartitions(*key).mapInArrow(compare, "id long, n long, root long"), "vector-links")
    links = found.filter("root is null").groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.filter("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    whole = materialize(
        unique.join(links, "id", "left").join(parts, "id", "left")
        .select("x", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("component")),
        "vector-found", unique,
    )
    back = rows.withColumn("x", F.when(F.col("good"), x)).join(whole, "x", "left")
    component = F.when(F.col("good"), F.col("component")).otherwise(F.col("id"))
    result = back.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
    return finished(result, "vector-result", unique, signed, sizes, found, parts, whole)
