import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from websift.llm import topk
from websift.llm.queries import op13_topk

from ..conftest import SF_DIR

TOP = 2**63 - 1


def brute(rows, every, k):
    kept = [(n, i, [math.floor(256 * c) if abs(c) < 2**53 else 256 * int(c) for c in v]) for n, (i, v) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, i, v in kept:
        if i is not None and i % every == 0:
            scores = [(max(-TOP, min(TOP, sum(a * b for a, b in zip(v, w, strict=True)))), j) for m, j, w in kept if m != n and len(w) == len(v)]
            best = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
            out += [(i, rank + 1, j, s) for rank, (s, j) in enumerate(best)]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert got(op13_topk(spark, SF_DIR)) == brute(rows, 50, 5)


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
@pytest.mark.parametrize("block,query_bytes", [(8192, 1 << 24), (7, 300)])
def test_odd_vectors(spark, kind, block, query_bytes):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 6) / 8).tolist()) for i in range(60)]  # many ties
    rows += [(20, [0.0] * 6), (10, [0.5] * 6), (10, [0.5] * 6), (None, [1.0] * 6)]  # all weights 0; an id three times; no id
    rows += [(30, None), (40, [None] * 6), (50, [float("nan")] * 6), (55, [float("inf")] * 6)]  # no part
    rows += [(70, []), (71, []), (80, [1.0]), (90, [1.0, 2.0]), (91, [-1.0, 2.0])]  # other lengths, one without candidates
    rows += [(100, [1e18] * 3), (101, [1e18] * 3), (102, [-1e18] * 3), (110, [2.0**62, 0.0, 0.0]), (112, [0.5] * 3)]  # beyond a long
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").selectExpr("*", "1 as id", "'c' as row", "2 as score").repartition(3)
    want = brute([(i, None if v is None else [None if c is None else float(np.float32(c)) if kind == "array<float>" else c for c in v]) for i, v in rows], 10, 4)
    assert got(topk.top_k(df, F.col("vec_id") % 10 == 0, 4, block=block, query_bytes=query_bytes)) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


def test_the_threshold_stops_early():
    """Vectors of few large components: most are never scored, and a block of weak ones isn't opened."""
    rng = np.random.default_rng(4)
    values = (rng.pareto(1.5, size=(4000, 8)) * 50).astype(np.int64)
    ids = np.arange(4000)
    block = topk.Block(values, ids, np.zeros(4000, bool), ids)
    best = topk.Best(20, 5)
    scored = topk.search(block, ids[:20], values[:20], best)
    want = np.sort(np.where(ids[:, None] == ids[None, :20], -1, values @ values[:20].T), axis=0)[::-1][:5].T
    assert np.array_equal(np.stack([f[0] for f in best.found]), want) and 0 < scored < 0.5 * 20 * 4000
    weak = topk.Block(np.ones((100, 8), np.int64), ids[:100] + 9000, np.zeros(100, bool), ids[:100] + 9000)
    assert topk.search(weak, ids[:20], values[:20], best) == 0
