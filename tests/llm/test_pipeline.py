"""The pipeline on sf0.001, every stage against a brute-force version of it."""

import random
import re
import struct
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.test_jaccard import brute
from websift.llm.queries import vocabulary_path

TOKEN = re.compile(r'(token = ")[0-9a-f]{40}(")')
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output rows."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF_DIR)
        out[name] = (docs.collect(), done.collect())
        docs = spark.createDataFrame(out[name][1], done.schema)
    return out


def letter_grams(text):
    """Runs of 4 characters in which a word's letters stand, one bordering space at most."""
    spaced = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    out = Counter()
    for m in re.finditer(r"[^ ]+", spaced):
        word = f" {m[0]} "
        for i in range(len(word) - 3):
            out[word[i : i + 4]] += 1
    return out


def test_language(stages):
    import zlib

    before, after = stages["language ID"]
    counts = defaultdict(Counter)
    for r in before:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts[r.lang].update(letter_grams(r.text))
    total = {x: sum(c.values()) for x, c in counts.items()}
    top = Counter()
    for x, c in counts.items():
        for g, n in c.items():
            top[g] = max(top[g], n / total[x])
    known = {x: {g for g, n in c.items() if n / total[x] >= 0.3 * top[g]} for x, c in counts.items()}
    kept = {r.doc_id for r in after}
    for r in before:
        found = letter_grams(r.text or "")
        n = sum(found.values())
        cover = max(sum(k for g, k in found.items() if g in own) for own in known.values()) / n if n else 0.0
        if cover >= corpus_pipeline.LEAST_COVERAGE + 0.02:
            assert r.doc_id in kept
        if not any(c.isalpha() for c in r.text or "") or cover < corpus_pipeline.LEAST_COVERAGE - 0.02:
            assert r.doc_id not in kept
    assert {tuple(r) for r in after} <= {tuple(r) for r in before} and len(kept) >= 0.9 * len(before)


def test_near_duplicates(stages):
    before, after = stages["n-gram Jaccard join"]
    groups = brute([(r.doc_id, r.text) for r in before], 5, 80, 100)
    assert Counter(r.doc_id for r in after) == Counter(i for i, _, c in groups if i == c)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_secrets(stages):
    before, after = stages["secret scans"]
    want = {r.doc_id: TOKEN.sub(r"\1[SECRET]\2", r.text) for r in before}
    assert {r.doc_id: r.text for r in after} == want and len(after) == len(before)
    assert all(r.n_chars == len(r.text) for r in after if "[SECRET]" in r.text)


def test_mix(stages):
    before, after = stages["mixing sources to target weights"]
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in before}
    by_source, taken = Counter(), Counter()
    for r in before:
        by_source[r.source] += size[r.doc_id]
    for r in after:
        taken[r.source] += size[r.doc_id]
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(by_source.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * by_source[s]}
        for s in over or free:
            target[s] = 3.0 * by_source[s] if over else weight[s] * level
            left -= target[s] if over else 0
        free = free - over if over else set()
    for s in names:
        rows = [size[r.doc_id] for r in before if r.source == s]
        assert abs(taken[s] - target[s]) <= -(-len(rows) // 512) * max(rows) / 2 + 64
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_encoding(stages):
    before, after = stages["BPE encoding"]
    own = Tokenizer.from_file(vocabulary_path())
    own.no_truncation()
    own.no_padding()
    want = Counter()
    for r in before:
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), struct.pack(f"<{len(ids)}I", *ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in after) == want


def test_run_is_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((r.doc_id, bytes(r.ids)) for r in stages["BPE encoding"][1])


def test_odd_rows(spark, odd, none):
    """Null ids and texts, repeated rows and extra columns go through every stage that takes any row."""
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd, SF_DIR).count() > 0
        assert stage(spark, none, SF_DIR).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, odd, SF_DIR).collect()
    assert Counter(r.doc_id for r in kept) == {1: 2, 2: 1, 3: 1, None: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    assert corpus_pipeline.language(spark, odd, SF_DIR).filter("text is null or text in ('', '!!! ... 123 456')").count() == 0
    assert corpus_pipeline.language(spark, none, SF_DIR).count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("stage", [corpus_pipeline.near_duplicates, corpus_pipeline.source_mix])
def test_texts_stay_where_they_are_read(spark, stage, tmp_path):
    """Where no table is small enough for a broadcast by the planner, texts that repeat nothing aren't shuffled."""
    rnd = random.Random(3)
    made = [(i, " ".join(rnd.randbytes(12).hex() for _ in range(160)), "en", f"s{i % 3}", 0) for i in range(1500)]
    made += [(i + 2000, made[i][1], "en", "s0", 0) for i in range(20)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/docs")
    docs, before = spark.read.parquet(f"{tmp_path}/docs"), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = stage(spark, docs, SF_DIR).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    given = {r[0]: r for r in made}
    assert all(tuple(r) == given[r.doc_id] for r in rows) and len({r.doc_id for r in rows}) > 1000
    if stage is corpus_pipeline.near_duplicates:
        assert sorted(r.doc_id for r in rows) == list(range(1500))
    assert shuffled(spark) - before < 0.4 * sum(len(r[1]) for r in made)
