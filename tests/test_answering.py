"""Answers: the best document alone, and only where it can be one."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from websift.operators import search
from websift.plans import registry


def drawn(seed):
    """Questions and blocks of documents: stems of very different frequency, parts, lengths of questions from none to many."""
    r = np.random.default_rng(seed)
    n_stems, bound = 60, 1 / np.arange(1, 61)
    stems = [r.choice(n_stems, size, replace=False, p=bound / bound.sum()) for size in [0, 1, 2, 3, 3, 4, 5, *r.integers(1, 20, 60)]]
    blocks = []
    for b in range(3):
        docs = [(d, s) for d in range(b * 400, b * 400 + 400) for s in r.choice(n_stems, r.integers(1, 15), replace=False, p=bound / bound.sum())]
        doc, stem = np.array(docs).T
        blocks.append((doc, stem, np.round(r.random(len(doc)) * np.log(stem + 2.0), 1), doc % 5 == 0))
    return stems, blocks, np.where(r.random(len(stems)) < 0.8, 3.0, 0.0), r.random(len(stems)) < 0.3, n_stems


def test_two_rounds_keep_what_can_be_first():
    for seed in range(4):
        stems, blocks, bonus, legal, n_stems = drawn(seed)
        size = np.array([len(s) for s in stems])
        need = np.where(bonus > 0, (size + 1) // 2, size)
        first = search.Answering(stems, bonus, legal, 0.5, 1e-8, need, np.full(len(stems), 1.8), True)
        for b in blocks:
            first.block(*b, n_stems)
        some = [q for q, f in enumerate(first.found) if f is not None and len(f[0])]
        second = search.Answering([stems[q] for q in some], bonus[some], legal[some], 0.5, 1e-8, need[some], first.floor[some], False)
        for b in blocks:
            second.block(*b, n_stems)
        kept = {q: {*first.found[q][0], *(second.found[i][0] if second.found[i] is not None else ())} for i, q in enumerate(some)}
        doc, stem, part, demoted = map(np.concatenate, zip(*blocks, strict=True))
        low = dict(zip(doc.tolist(), demoted.tolist(), strict=True))
        for q, own in enumerate(map(set, stems)):
            base, matched = {}, {}
            for d, s, p in zip(doc.tolist(), stem.tolist(), part.tolist(), strict=True):
                if s in own:
                    base[d], matched[d] = base.get(d, 0.0) + p, matched.get(d, 0) + 1
            factor = {d: 0.5 if low[d] and not legal[q] else 1.0 for d in base}
            least = {d: base[d] * factor[d] for d in base}
            most = {d: least[d] + (bonus[q] if matched[d] >= len(own) - 2 else 0.0) * factor[d] for d in base}
            able = [d for d in base if matched[d] >= max(1, need[q]) and most[d] >= 1.8]
            assert (q in kept) == bool(able), (seed, q)
            if able:
                floor = max(1.8, *(least[d] for d in able))
                reach = max(floor, *(least[d] for d in base))  # a better one of any kind may take the place
                assert {d for d in base if most[d] >= reach} <= kept[q], (seed, q)


def test_few_documents_are_added_up():
    stems, blocks, bonus, legal, n_stems = drawn(9)
    size = np.array([len(s) for s in stems])
    made = search.Answering(stems, bonus, legal, 0.5, 1e-8, np.maximum(1, size - 1), np.full(len(stems), 1.8), True)
    for b in blocks:
        made.block(*b, n_stems)
    assert made.opened > 100 and made.scored < made.opened / 2


def words(r):
    return " ".join(r.choice("apple apples pear kiwis plum fig melons date lime grape berry nut quince olive mango the of".split()) for _ in range(r.randint(0, 14)))


def test_answers_are_those_of_all_pairs(spark, monkeypatch):
    for name, value in (("BLOCK_DOCS", 40), ("ANSWER_DOCS", 40), ("ANSWER_PART", 30)):
        monkeypatch.setattr(search, name, value, raising=False)
    r = random.Random(3)
    docs = spark.createDataFrame([(i, f"https://a.example.com/{'terms' if i % 4 == 0 else 'p'}/{i}", words(r)) for i in range(300)], "doc_id long, url string, text string").cache()
    asked = spark.createDataFrame([(i, words(r) + (" refund policy" if i % 7 == 0 else "")) for i in range(80)] + [(80, ""), (81, "unknown"), (82, "the"), (83, "fig fig")], "query_id long, query string").cache()
    top = search.top_k(search.scores(docs, asked, url_col="url"), 1)
    n = search.prepared_queries(asked).select("query_id", F.size("tokens").alias("n_tokens"))
    good = top.join(n, "query_id").filter((F.col("score") >= 1.8) & (F.col("coverage") >= F.when(F.col("n_tokens") >= 2, 0.5).otherwise(1.0)))
    wanted = {r.query_id: (r.url, r.text) for r in good.join(docs, F.col("doc") == docs.doc_id).collect()}
    got = {r.query_id: (r.url, r.answer) for r in search.answers(docs, asked, url_col="url").collect()}
    assert len(got) == 84 and 20 < len(wanted) < 84
    assert got == {q: wanted.get(q, (None, None)) for q in got}


def test_no_documents_no_answers(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "apple pie")], "query_id long, query string")
    assert [tuple(r) for r in search.answers(docs, asked).collect()] == [(1, "apple pie", None, None, None)]
    assert search.answers(docs, asked.limit(0)).collect() == []


def test_pages_are_parsed_for_the_index_alone(spark):
    plan = registry.page_answers(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
