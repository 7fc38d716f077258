import random
import re

import pytest
from pyspark.sql import functions as F

from websift.llm.components import connected_components
from websift.llm.jaccard import group_matrix, least_shared, opened_pairs, qualifying, shingle_sets, similar_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words_set(text, k):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    """(id, text) rows to {id: (sizes, component)}; rows with the same id are one vertex."""
    sets = [(i, words_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    index = {}
    for n, (i, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(n)
    for n, (i, s) in enumerate(sets):
        near = {m for g in s for m in index[g] if m < n}
        for m in near:
            j, o = sets[m]
            if i is not None and j is not None and den * len(s & o) >= num * len(s | o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def same(docs, k=4, num=85, den=100):
    got = similar_documents(docs, k, num, den).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], k, num, den)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    return want


def test_shingles():
    texts = ["One two  THREE four\tfive", "a b", "b a", "", " \n ", "É é a A a", "x\x0by\x0cz\x1cw q"]
    for k in (1, 3, 4, 5):
        for text, s in zip(texts, shingle_sets([t.encode() for t in texts], k), strict=True):
            assert len(s) == len(words_set(text, k))
    a, b = shingle_sets([b"a b", b"b a"], 4)
    assert a != b


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_documents(spark, k, num):
    want = same(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), k, num)
    assert sum(i != c for i, _, c in want) > 20


def test_hot_line_and_near_copies(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnop") + rnd.choice("qrstuvwxyz")
    base, line = [word() for _ in range(120)], "this very line stands in a third of all texts here"
    rows = []
    for i in range(400):
        if i % 3 == 0:
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
        elif i % 3 == 1:
            rows.append((i, " ".join(word() for _ in range(rnd.randint(1, 30))) + " " + line))
        else:
            rows.append((i, " ".join(word() for _ in range(rnd.randint(1, 60)))))
    same(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_null_text_of_a_shared_id(spark):
    words = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, None), (5, words), (6, words + " more"), (6, None), (7, None)], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in similar_documents(df).collect())
    assert got == [(5, 5), (5, 5), (6, 5), (6, 5), (7, 7)]


def test_unlike_words_of_one_polynomial_hash(spark):
    """Strings that hash alike modulo 2 ** 64 under any polynomial share no shingle here."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    assert not set(shingle_sets([morse.encode()], 1)[0].tolist()) & set(shingle_sets([other.encode()], 1)[0].tolist())
    df = spark.createDataFrame([(1, f"{morse} x y z"), (2, f"{other} x y z"), (3, f"{morse} x y z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in similar_documents(df).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_words_at_the_hash_s_steps():
    for n in (1, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200):
        texts = ["x" * n, "x" * (n - 1) + "y", "y" + "x" * (n - 1), "X" * n + " ", "x" * (n + 1)]
        h = [shingle_sets([t.encode()], 1)[0].tolist() for t in texts]
        assert h[0] == h[3] and len({tuple(x) for x in h}) == (3 if n == 1 else 4)


@pytest.mark.parametrize("num,den", [(85, 100), (80, 100), (1, 2)])
def test_least_shared_in_prefixes(spark, num, den):
    """No similar pair's prefixes share less than the bound, whatever the sizes."""
    rnd = random.Random(num)
    rows = []
    for _ in range(4000):
        both, left, right = rnd.randint(1, 60), rnd.randint(0, 12), rnd.randint(0, 12)
        order = rnd.sample(range(100), both + left + right)
        x, y = sorted(order[: both + left]), sorted(order[:both] + order[both + left :])
        if den * both >= num * (both + left + right):
            prefix = lambda s: set(s[: len(s) - -(-num * len(s) // den) + 1])
            rows.append((len(x), len(y), len(prefix(x) & prefix(y))))
    df = spark.createDataFrame(rows, "x long, y long, shared long")
    assert df.filter(F.col("shared") < least_shared(F.col("x"), F.col("y"), num, den)).count() == 0
    assert df.filter(F.col("shared") == least_shared(F.col("x"), F.col("y"), num, den)).count() > 0


def test_bounds_agree(spark):
    df = spark.range(1, 300).selectExpr("id as x", "cast(id * 0.9 as long) + 1 as y").withColumn("least", least_shared(F.col("x"), F.col("y"), 85, 100))
    assert all(r.least == least_shared(r.x, r.y, 85, 100) for r in df.collect())


@pytest.mark.parametrize("chunk", [4096, 7])
def test_opened_pairs(spark, chunk):
    """Members that share enough of a query's shingles, whatever the chunks their group is cut into."""
    rnd = random.Random(chunk)
    held = {i: set(rnd.sample(range(40), 20)) for i in range(60)}
    rows = [(t, i, 100, 0 if i < 50 else i) for i, s in held.items() for t in s]
    labelled = spark.createDataFrame(rows, "token long, id long, n long, group long")
    qualified = spark.createDataFrame([(i, 100, 0) for i in range(50, 60)], "id long, n long, group long")
    groups = spark.createDataFrame([(i, 0) for i in range(50)], "id long, component long")
    least = least_shared(100, 100, 85, 100)
    want = {(j, i) for i in range(50, 60) for j in range(50) if len(held[i] & held[j]) >= least}
    got = opened_pairs(labelled, qualified, groups, 85, 100, chunk).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and 0 < len(want) < 500


@pytest.mark.parametrize("chunk", [4096, 3])
def test_qualifying_groups(spark, chunk):
    """Groups whose union holds enough of a query's shingles, against plain sets, whatever parts the lists are cut into."""
    rnd = random.Random(chunk)
    sizes = {i: rnd.randint(80, 130) for i in range(40)}
    group = {i: i - i % 4 for i in sizes}
    held = {i: set(rnd.sample(range(60), 18)) for i in sizes}
    labelled = spark.createDataFrame([(t, i, sizes[i], group[i]) for i, s in held.items() for t in s], "token long, id long, n long, group long")
    want = set()
    for q in sizes:
        for g in set(group.values()):
            rows = [(t, sizes[m]) for m in sizes if group[m] == g for t in held[m] & held[q]]
            low, high = max(min((n for _, n in rows), default=10**9), -(-sizes[q] * 85 // 100)), min(max((n for _, n in rows), default=0), sizes[q] * 100 // 85)
            if g < group[q] and low <= high and len({t for t, _ in rows}) >= min(least_shared(sizes[q], low, 85, 100), least_shared(sizes[q], high, 85, 100)):
                want.add((q, g))
    got = qualifying(labelled, group_matrix(labelled), 85, 100, chunk).collect()
    assert {(r.id, r.group) for r in got} == want and len(got) == len(want) and len(want) > 20


def test_groups_stay_closed(spark):
    """Two families of near copies that share a passage: their groups meet in the matrix, and the bound keeps them closed."""
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnop") + rnd.choice("qrstuvwxyz")
    passage = [word() for _ in range(60)]
    families = [[word() for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(180):
        w = [*families[i % 6], *passage]
        w[rnd.randrange(60)] = word()
        rows.append((i, " ".join(w)))
    seen: dict = {}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in similar_documents(df, seen=seen).collect()}
    assert got == {i: c for i, _, c in brute(rows, 4, 85, 100)}
    assert seen["met"] > seen["opened"] >= 0, seen


def test_odd_rows(odd, none):
    same(odd)
    assert similar_documents(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(500 + i, 500) for i in range(1, 300)] + [(9, 9), (2000, 1000), (1000, 2000)]
    rnd = random.Random(1)
    rnd.shuffle(chain)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 500 for i in range(500, 800)} | {1000: 1000, 2000: 1000}
