import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from websift.llm.mixing import mix_sources, mixed_copies, sainte_lague

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Shares by weight, the excess above 3 times a source's size reshared until none is above."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, open_ = total - sum(3 * sizes[s] for s in full), [s for s in names if s not in full]
        level = Fraction(rest, sum(weight[s] for s in open_)) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s] if s in full else weight[s] * level) for s in names}
        full |= over


def brute_seats(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        k = max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * got[i] + 1), -i))
        got[k] += 1
    return got


@pytest.mark.parametrize("seed", range(6))
def test_seats(spark, seed):
    rnd = random.Random(seed)
    votes = [rnd.choice([0, 1, 7, rnd.randint(1, 10_000)]) for _ in range(rnd.randint(1, 30))]
    seats = rnd.randint(0, 200)
    df = spark.createDataFrame([(i, float(v), seats) for i, v in enumerate(votes)], "i int, votes double, seats long")
    got = [r.got for r in sainte_lague(df, [], ["i"], "votes", "seats", "got").orderBy("i").collect()]
    assert got == brute_seats(votes, seats)


def check(rows, got):
    size, sizes = {}, defaultdict(int)
    for r in rows:
        n = len(WORD.findall(r.text or ""))
        size[r.doc_id, r.source] = n
        sizes[r.source] += n
    want, taken = brute_targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size[r.doc_id, r.source] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(1.0, 0.01 * t), (s, taken[s], t)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = mix_sources(docs).collect()
    check(docs.collect(), a)
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in a) == sorted((r.doc_id, r.taken) for r in again)


def test_odd_rows(odd, none):
    check(odd.collect(), mix_sources(odd).collect())
    assert mix_sources(none).count() == 0
    assert mix_sources(odd.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0


def test_hot_source(spark):
    rows = [(i, "w " * (i % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(docs.collect(), mix_sources(docs, rows_per_shard=100).collect())
    check(docs.collect(), mix_sources(docs, rows_per_shard=20, shards_per_range=8).collect())
    by = {}
    for r in mix_sources(docs, rows_per_shard=100, block=50).collect():
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 25 + 50 for t, n in by.values())


def test_rows_without_an_id_are_spread(spark):
    docs = spark.createDataFrame([(None, f"w{i} " * (i % 9), "s") for i in range(2000)], "doc_id long, text string, source string")
    got = mix_sources(docs, rows_per_shard=10).collect()
    assert len(got) == 2000 and sum(r.taken for r in got) == got[0].target == sum(i % 9 for i in range(2000))


def test_copies_are_what_the_mix_takes_rounded(spark, odd, none):
    """Repeated ids and null ones included: rows that share an id and a source are copied alike."""
    rnd = random.Random(4)
    rows = [(rnd.choice([None, i, i, i // 3]), "w " * rnd.choice([0, 1, 5, rnd.randrange(60)]), rnd.choice(["a", "b", "b", None])) for i in range(2500)]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = made.unionByName(odd.select("doc_id", "text", "source")).localCheckpoint()
    taken, size = defaultdict(int), defaultdict(int)
    for r in mix_sources(docs, rows_per_shard=20).collect():
        taken[r.doc_id, r.source] += r.taken
        size[r.doc_id, r.source] += r["size"]
    want = Counter()
    for r in docs.collect():
        k = r.doc_id, r.source
        want[tuple(r)] += int(taken[k] / size[k] + 0.5) if size[k] else 0
    assert Counter(map(tuple, mixed_copies(docs, rows_per_shard=20).collect())) == +want
    assert mixed_copies(none).count() == 0
