import hashlib
import math

import numpy as np
import pytest

from websift.llm.codes import Cells, compress
from websift.llm.queries import op11_codes

from ..conftest import SF_DIR

TOP = 2**63 - 1


def brute(rows, parts=8, entries=16, rounds=6):
    """{(id, vector): (code, error, label_error, digest)} of (id, vector, label) rows, in Python integers and full comparisons."""
    kept = [(i, tuple(v), label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out, of_label = {}, {}
    for n in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == n), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        whole = [[math.floor(c * 4096) if abs(c) < 2**53 else int(c) * 4096 for c in v] for _, v, _ in own]
        cuts = [list(x) for x in np.array_split(range(n), parts)]
        books = [[[v[p] for p in c] for v in whole[:entries]] for c in cuts]

        def assign(v, books=books, cuts=cuts):
            found = []
            for c, book in zip(cuts, books, strict=True):
                gaps = [sum((v[p] - e) ** 2 for p, e in zip(c, entry, strict=True)) for entry in book]
                found.append((gaps.index(min(gaps)), min(gaps)))
            return found

        for _ in range(rounds):
            codes = [assign(v) for v in whole]
            for k, c in enumerate(cuts):
                for e in range(len(books[k])):
                    mine = [v for v, code in zip(whole, codes, strict=True) if code[k][0] == e]
                    if mine:
                        books[k][e] = [sum(v[p] for v in mine) // len(mine) for p in c]
        digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
        for (i, v, label), w in zip(own, whole, strict=True):
            code = assign(w)
            error = min(TOP, sum(g for _, g in code))
            of_label[label] = of_label.get(label, 0) + error
            out[i, v, label] = ("".join(f"{e:02x}" for e, _ in code), error, digest)
    return sorted(((i, code, error, min(TOP, of_label[label]), digest) for (i, v, label), (code, error, digest), times in
                   ((k, x, sum(1 for r in kept if r == k)) for k, x in out.items()) for _ in range(times)), key=repr)


def got(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def once(rows):
    """Errors are added up once a row: the brute force above counts a repeated row once, so keep rows distinct there."""
    return list(dict.fromkeys((i, None if v is None else tuple(v), label) for i, v, label in rows))


def test_query_against_brute_force(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert got(op11_codes(spark, SF_DIR)) == brute(once(rows))


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_odd_vectors(spark, kind):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).astype(np.float32).astype(float).tolist(), i % 3) for i in range(40)]
    rows += [(100, None, 1), (101, [None] * 16, 1), (102, [float("nan")] + [0.0] * 15, 1), (103, [0.0] * 15 + [float("-inf")], 1)]  # dropped
    rows += [(200, [0.0] * 16, None), (201, [0.25] * 16, None), (None, [0.5] * 16, 2), (7, [0.125] * 16, 0)]  # null label, null id, an id twice
    rows += [(300, [1.0, -2.0], 1), (301, [1.5, 2.0], 1), (302, [], 1), (303, [0.5] * 11, 2)]  # lengths of their own
    rows += [(400 + i, [(-1.0) ** i * 2.0 ** (50 + 3 * i)] * 24, 5) for i in range(20)]  # beyond 64 bits
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").selectExpr("*", "1 as id", "'c' as code", "2 as error", "3 as length").repartition(3)
    want = brute([(i, None if v is None else [None if c is None else float(np.float32(c)) if kind == "array<float>" else c for c in v], x) for i, v, x in rows])
    assert got(compress(df)) == want and any(r[2] == TOP for r in want)
    assert compress(df.limit(0)).count() == 0
    assert compress(df.filter("vec_id in (100, 102)")).count() == 0


def test_repeated_rows_count_each(spark):
    rows = [(1, [float(x)] * 8, 0) for x in (1, 2)] * 3
    found = got(compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2), entries=1))
    assert len(found) == 6 and {r[3] for r in found} == {sum(r[2] for r in found)}


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(2)
    entries = (rng.normal(size=(16, 8)) * 500).astype(np.int64)
    q = np.concatenate([(rng.normal(size=(500, 8)) * 500).astype(np.int64), entries, entries[[3, 3]]])
    at, gap, refined = Cells(np.concatenate([entries, entries[:2]])).nearest(q)
    full = ((q[:, None] - entries[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (gap == full.min(1)).all()
    assert refined < 0.6 * len(q) * 18


def test_lost_ties_go_to_the_lower_entry():
    at, _, _ = Cells(np.array([[5], [1], [1], [5], [3]])).nearest(np.array([[1], [5], [3], [2], [4]]))
    assert at.tolist() == [1, 0, 4, 1, 0]
