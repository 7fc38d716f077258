import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

from websift.llm.sharding import schedule, shard_documents


def check(docs, got, n):
    texts = {}
    shards, slots, sizes = defaultdict(set), defaultdict(list), Counter()
    for r in docs:
        texts.setdefault((r.doc_id, zlib.crc32((r.text or "").encode())), r.text or "")
    assert len(got) == len(docs)
    for r in got:
        text = texts[r.doc_id, r.text_crc32]
        assert r["size"] == len(text.encode()) + 1
        shards[text].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < n for s in slots)
    return sizes


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = check(docs.collect(), shard_documents(docs, 16).collect(), 16)
    assert max(sizes.values()) <= 1.1 * min(sizes.values())


def test_against_a_plain_heap(spark):
    """Every group goes where a heap over all groups puts it, sorted by size and then by key."""
    rnd = random.Random(2)
    texts = ["t%d " % i + "x" * int(rnd.paretovariate(1.1) * 20) for i in range(700)]
    docs = spark.createDataFrame([(i, rnd.choice(texts)) for i in range(3000)], "doc_id long, text string")
    rows = docs.collect()
    size = Counter()
    for r in rows:
        size[r.text] += len(r.text.encode()) + 1
    heap, want = [(0, s) for s in range(16)], {}
    for text in sorted(size, key=lambda t: (-size[t], hashlib.md5(t.encode()).digest())):
        load, shard = heapq.heappop(heap)
        want[text] = shard
        heapq.heappush(heap, (load + size[text], shard))
    got = shard_documents(docs, 16)
    assert {r.doc_id: r.shard for r in got.collect()} == {r.doc_id: want[r.text] for r in rows}
    loads = check(rows, got.collect(), 16)
    pooled = check(rows, shard_documents(docs, 16, units_per_shard=8, parcels=64).collect(), 16)
    assert max(loads.values()) - min(loads.values()) <= max(size.values()) and sum(pooled.values()) == sum(loads.values())


def test_hot_group(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"text {i}") for i in range(6000)], "doc_id long, text string")
    check(docs.collect(), shard_documents(docs, 4).collect(), 4)


def test_odd_rows(odd, none):
    check(odd.collect(), shard_documents(odd, 16).collect(), 16)
    assert shard_documents(none, 16).count() == 0


def test_schedule():
    assert schedule([(1, 5), (2, 4), (3, 3), (4, 3)], 2) == [(1, 0), (2, 1), (3, 1), (4, 0)]
