import numpy as np
import pytest

from websift.llm.vectors import index_plan, near_vectors, same_cell



def brute(rows, least=0.9):
    """{id: (n_links, component)} over (id, vector) rows with distinct ids."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    pairs = 0
    for dim in {len(v) for _, v in good}:
        own = [(i, v / np.linalg.norm(v)) for i, v in good if len(v) == dim]
        ids, x = [i for i, _ in own], np.stack([v for _, v in own])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            links[ids[a]] += 1
            links[ids[b]] += 1
            pairs += 1
            p, q = find(ids[a]), find(ids[b])
            parent[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i, _ in rows}, pairs


def test_given_table(spark):
    """No two of the given vectors reach 0.9: nothing links."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    want, pairs = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(table).collect()}
    assert got == want and pairs == 0


@pytest.mark.parametrize("dim", [8, 64])
@pytest.mark.parametrize("cosine,least_found", [(0.901, 0.95), (0.92, 0.96), (0.95, 0.99)])
def test_recall(spark, dim, cosine, least_found):
    """Pairs planted at a cosine, among as many strangers: found as often as calculated."""
    rng = np.random.default_rng(dim)
    n = 4000
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * b])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, pairs = brute(rows)
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = sum(got.values()) // 2
    assert pairs >= n and all(k <= want[i][0] for i, k in got.items())
    print("dimension", dim, "cosine", cosine, "found", found, "of", pairs)
    assert found >= least_found * pairs


def test_plan_follows_the_number_of_vectors():
    assert same_cell(1.0, 1.6) > 0.999 and abs(same_cell(0.9, 1.6) - 0.777) < 0.001
    plans = [index_plan(n, 0.9, 0.968, 1.6) for n in (0, 1000, 50_000, 10**6, 10**9)]
    assert plans[0] == plans[1] and all(x < y for x, y in zip(plans[1:], plans[2:], strict=False))
    for (tables, width), n in zip(plans[2:], (50_000, 10**6, 10**9), strict=True):
        assert n * same_cell(0.0, 1.6) ** width <= 32 and 1 - (1 - same_cell(0.9, 1.6) ** width) ** tables >= 0.968


def test_repeated_ids(spark):
    """Rows of one id are one vertex: their links add up, and they tie their components together."""
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (4, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 1.0])]
    got = sorted((r.vec_id, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]


def test_chunks_count_alike(spark):
    rng = np.random.default_rng(0)
    center = rng.standard_normal(16)
    rows = [(i, (center + 0.03 * rng.standard_normal(16)).tolist()) for i in range(150)] + [(i, rng.standard_normal(16).tolist()) for i in range(150, 300)] + [(i, [1.0] * 16) for i in range(300, 340)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want, _ = brute(rows)
    for chunk in (1000, 20):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, chunk=chunk).collect()}
        assert got == want


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_odd_vectors(spark, kind):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [1e-30, 0.0]), (11, [1e30, 1e25]), (12, [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").selectExpr("*", "1 as id", "'c' as x", "2 as table")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    for i in (1, 2, 10, 11, 12):
        assert got[i] == (4, 1, i == 1)
    for i in (3, 4, 5, 6, 7, 8, 9):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, False)
    assert near_vectors(df.limit(0)).count() == 0
