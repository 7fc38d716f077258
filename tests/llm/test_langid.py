import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from websift.llm import langid
from websift.llm.queries import op10_langid


def test_grams():
    codes, doc, has = langid.grams(["Ab, cd!", None, "", "12 3", "ab cd", "é"])
    assert has.tolist() == [True, False, False, False, True, True]
    assert codes[doc == 0].tolist() == codes[doc == 4].tolist() and len(codes[doc == 0]) == 2
    assert set(doc.tolist()) == {0, 4}


def test_filters_return_all_languages():
    a, b = langid.grams(["hello there"])[0], langid.grams(["hello where"])[0]
    f = langid.Filters({"x": a, "y": b}, {"x": 1, "y": 1})
    masks = f.languages(a)[0]
    assert all(m & 1 for m in masks.tolist())
    both = set(a.tolist()) & set(b.tolist())
    assert all(bool(m & 2) for c, m in zip(a.tolist(), masks.tolist(), strict=True) if c in both)
    many = langid.Filters({f"l{i:03}": np.arange(i * 50, i * 50 + 50, dtype=np.uint64) for i in range(70)}, {})
    assert many.masks.shape[0] == 2 and all(m >> (69 - 64) & 1 for m in many.languages(np.arange(69 * 50, 69 * 50 + 50, dtype=np.uint64))[1].tolist())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = op10_langid(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def plain_grams(text):
    """Runs of 4 characters around whole words, one bordering space at most."""
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" "):
        spaced = f" {word} "
        for i in range(len(spaced) - 3):
            out[spaced[i : i + 4]] += 1
    return out


def test_against_sets(spark):
    """The filters hold what plain sets hold, and predict as exact counts do wherever those differ clearly."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    counts = defaultdict(Counter)
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts[r.lang].update(plain_grams(r.text))
    total = {x: sum(c.values()) for x, c in counts.items()}
    top = Counter()
    for x, c in counts.items():
        for g, n in c.items():
            top[g] = max(top[g], n / total[x])
    known = {x: {g for g, n in c.items() if n / total[x] >= 0.3 * top[g]} for x, c in counts.items()}
    train = docs.filter(~langid.held_out())
    table = langid.known_grams(langid.gram_counts(train, 4000)[0], 0.3).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in table} == {x: len(g) for x, g in known.items()}
    clear = 0
    for r, p in zip(rows, langid.identify(docs, langid.learn(train)).collect(), strict=True):
        assert r.doc_id == p.doc_id
        own = plain_grams(r.text)
        n, hits = sum(own.values()), {x: sum(k for g, k in own.items() if g in known[x]) for x in known}
        best = sorted(hits, key=lambda x: (-hits[x], x))
        if n and hits[best[0]] - hits[best[1]] > 0.03 * n + 2:
            clear += 1
            assert p.lang_pred == best[0]
            assert abs(p.coverage - hits[best[0]] / n) < 0.03
    assert clear > 0.9 * len(rows)


def test_rule_does_not_depend_on_size(spark):
    """Doubling the table leaves every language's n-grams as they are, rare ones included."""
    docs = spark.createDataFrame([(1, "hello there", "en"), (2, "bonjour la", "fr")], "doc_id long, text string, lang string")
    many = docs.crossJoin(spark.range(3000)).selectExpr("doc_id * 10000 + id as doc_id", "text", "lang")
    sets = [{(r.lang, r.code) for r in langid.known_grams(langid.gram_counts(d, 10_000)[0], 0.3).collect()} for d in (docs, many)]
    assert sets[0] == sets[1] and len(sets[0]) > 10


def test_ties_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1 as score", "2 as Coverage")
    got = langid.identify(docs, langid.learn(docs))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "coverage"]
    assert [(r.lang_pred, r.score) for r in got.collect()] == [("a", 0.5), ("a", 0.5)]


def test_odd_rows(spark, odd, none):
    model = langid.learn(odd)
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.lang_pred == ("en" if any(c.isalpha() for c in r.text or "") else "und")
    assert langid.identify(none, model).count() == 0
    unlearned = langid.learn(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, unlearned).collect()} == {("und", 0.0)}
