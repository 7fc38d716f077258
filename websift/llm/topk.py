"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are taken in blocks. A block keeps, for each dimension, its vectors sorted by that component. A query reads
the lists of its own dimensions from the end that its weight favours, all to the same depth; every vector met for the
first time is scored whole (the random access). No vector still unseen can score more than the sum of the lists' next
components times the query's weights; once that bound is below the query's k-th best score, the block is done, and a
block whose bound is below it from the start isn't opened. A worker keeps the k best of each query from block to block.

Queries are broadcast in parts of bounded size, and all vectors pass by each part: no candidate is shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .matrices import LARGEST, clamped, floors, largest, matrices

FOUND = "query_row long, query_id long, vec_id long, row long, score long"
#: Lists are first read to this depth, then to twice as deep each time: only the moment of the stop depends on it.
DEPTH = 8


class Best:
    """The k best (score, id, row) of every query so far, ties to the smaller id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.found = [()] * n
        self.least = np.full(n, -LARGEST - 1, np.int64)
        self.full = np.zeros(n, bool)

    def add(self, i: int, *new: np.ndarray) -> None:
        """new: scores, null flags, ids and rows of candidates."""
        scores = new[0]
        if self.full[i]:
            keep = scores >= self.least[i]
            if not keep.any():
                return
            new = tuple(x[keep] for x in new)
        if len(self.found[i]):
            new = tuple(map(np.concatenate, zip(self.found[i], new, strict=True)))
        order = np.lexsort((new[3], new[2], new[1], -new[0]))[: self.k]
        self.found[i] = tuple(x[order] for x in new)
        self.full[i] = len(order) == self.k
        self.least[i] = self.found[i][0][-1] if len(order) else self.least[i]


class Block:
    """Candidate vectors of one length with a sorted list of them for each dimension."""

    def __init__(self, values: np.ndarray, ids: np.ndarray, null: np.ndarray, rows: np.ndarray):
        self.values, self.ids, self.null, self.rows = values, ids, null, rows
        self.falling = np.argsort(values, axis=0, kind="stable")[::-1].T
        self.rising = self.falling[:, ::-1]

    def depths(self) -> list[int]:
        out = [0]
        while out[-1] < len(self.values):
            out.append(min(len(self.values), max(DEPTH, 2 * out[-1])))
        return out

    def bounds(self, weights: np.ndarray, values: np.ndarray) -> np.ndarray:
        """(queries, depths): what a vector that no list has shown above a depth can score at most."""
        dims, cuts = np.arange(values.shape[1])[:, None], self.depths()[:-1]
        zero = weights.dtype.type(0) if weights.dtype != object else 0
        return np.maximum(weights, zero) @ values[self.falling[:, cuts], dims] + np.minimum(weights, zero) @ values[self.rising[:, cuts], dims]


def search(block: Block, rows: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Take a block's vectors into the queries' best; how many were scored."""
    values, size = block.values, int(largest(weights)) * int(largest(block.values)) * max(1, weights.shape[1])
    kind = np.float64 if size < 1 << 53 else np.int64 if size < 1 << 62 else object  # exact in each case
    values, weights = values.astype(kind), weights.astype(kind)
    depths, bounds, scored = block.depths(), block.bounds(weights, values), 0
    for i in np.flatnonzero(~(best.full & (bounds[:, 0] < best.least))).tolist():
        q = weights[i]
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        if not len(up) + len(down):
            up = np.arange(len(q))[:1]  # all weights are 0: any list shows every vector
        seen = np.zeros(len(values), bool)
        for d, (start, stop) in enumerate(zip(depths[:-1], depths[1:], strict=True)):
            if best.full[i] and bounds[i, d] < best.least[i]:
                break
            met = seen.copy()
            met[block.falling[up, start:stop]] = True
            met[block.rising[down, start:stop]] = True
            if not len(q):
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            seen = met
            new = new[block.rows[new] != rows[i]]
            scored += len(new)
            if len(new):
                best.add(i, clamped(values[new] @ q), block.null[new], block.ids[new], block.rows[new])
    return scored


def _identified(batch: pa.RecordBatch, scale: int):
    """(length, whole numbers, ids, null flags, rows) of a batch of row, id, vector, for each length."""
    rows, ids = batch.column(0).to_numpy(), batch.column(1)
    null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(LARGEST).to_numpy()
    for at, m in matrices(batch.column(2)):
        yield m.shape[1], floors(m, scale), ids[at], null[at], rows[at]


def _joined(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _scan(shared, k: int, scale: int, block: int):
    def run(batches):
        queries = shared.value
        best = {n: Best(len(q[3]), k) for n, q in queries.items()}
        waiting: dict[int, list] = {n: [] for n in queries}

        def work(n: int, all_rows: bool) -> None:
            if waiting[n]:
                values, ids, null, rows = _joined(waiting[n])
                whole = len(rows) if all_rows else len(rows) // block * block
                for i in range(0, whole, block):
                    part = slice(i, min(i + block, whole))
                    search(Block(values[part], ids[part], null[part], rows[part]), queries[n][3], queries[n][0], best[n])
                waiting[n] = [(values[whole:], ids[whole:], null[whole:], rows[whole:])] if whole < len(rows) else []

        for batch in batches:
            for n, *rest in _identified(batch, scale):
                if n in queries:
                    waiting[n].append(rest)
                    if sum(len(w[3]) for w in waiting[n]) >= block:
                        work(n, False)
        for n, (_, ids, null, rows) in queries.items():
            work(n, True)
            for a in range(0, len(rows), 4096):
                found = [(j, f) for j in range(a, min(a + 4096, len(rows))) if len(f := best[n].found[j])]
                if found:
                    scores, nulls, vec_ids, vec_rows = _joined([f for _, f in found])
                    at = np.repeat([j for j, _ in found], [len(f[0]) for _, f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(ids[at], mask=null[at]), pa.array(vec_ids, mask=nulls), pa.array(vec_rows), pa.array(scores)], names=["query_row", "query_id", "vec_id", "row", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, query_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row for which `is_query` holds, the k other rows of the highest inner product.

    Components are floor(scale * x), exactly; ties go to the smaller id, null ids last. A query has fewer rows where
    there are fewer candidates. Vectors that are null or hold null or non-finite components take no part; vectors of
    different lengths are no candidates of each other. Rows that share an id are vectors each: as queries each has its
    own k rows, and only the very row is left out of its candidates. Scores beyond a long are held at its ends, where
    they tie. An empty table gives no rows. Other columns are read by `is_query` alone.

    Queries are read by the driver and broadcast about `query_bytes` at a time, one part after the other; `block`
    candidates share their lists. Neither changes a row.
    """
    spark = vectors.sparkSession
    told = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    table = materialize(told, "topk-vectors")
    asking = table.filter("asks").select("row", "id", "vector")
    size = asking.agg(F.sum(8 * (F.size("vector") + 4)).alias("n")).first().n or 0
    parts = max(1, -(-size // query_bytes))
    best = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    results = []
    for part in range(parts):
        own = asking.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).toArrow().combine_chunks()
        queries: dict[int, list] = {}
        for batch in own.to_batches():
            for n, *rest in _identified(batch, scale):
                queries.setdefault(n, []).append(rest)
        shared = spark.sparkContext.broadcast({n: _joined(q) for n, q in queries.items()})
        found = table.select("row", "id", "vector").mapInArrow(_scan(shared, k, scale, block), FOUND)
        ranked = found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        results.append(materialize(ranked, "topk-found"))
        shared.unpersist()
    return reduce(DataFrame.unionAll, results)
