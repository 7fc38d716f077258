import hashlib
import random

import numpy as np
import pytest

from websift.llm import suffixes
from websift.llm.queries import op3_suffixes


def by_doubling(t):
    """Suffix array by rank doubling."""
    n = len(t)
    rank, step = np.unique(t, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key)
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


@pytest.mark.parametrize("text", ["banana", "mississippi", "aaaaaaaa", "abababab", "a", "", "abcabcabcabx", "zyxw", "aabbaabbaabb"])
def test_suffix_array(text):
    t = np.array([ord(c) for c in text] + [0])
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    sa = suffixes.suffix_array(t)
    assert sa.tolist() == want
    lcp = suffixes.permuted_prefixes(t.astype(np.uint16), sa)
    for r in range(1, len(want)):
        a, b = t[want[r - 1] :].tolist(), t[want[r] :].tolist()
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[want[r]] == n


@pytest.mark.parametrize("sigma", [1, 2, 4, 200, 3000])
def test_random_suffix_arrays(sigma):
    rng = np.random.default_rng(sigma)
    for n in (3, 50, 400):
        t = np.append(rng.integers(1, sigma + 1, n), 0)
        assert suffixes.suffix_array(t).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())
        r = np.append(np.tile(rng.integers(1, sigma + 1, 7), n // 3), 0)
        assert suffixes.suffix_array(r).tolist() == by_doubling(r).tolist()


def test_every_level_is_induced():
    """2 MB of prose: the reduced strings, of tens of thousands of names, are sorted by induction too."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    text = " ".join(rnd.choices(words, k=400_000))[: 2 << 20]
    t, levels = np.append(np.frombuffer(text.encode(), np.uint8).astype(np.int64), 0), []
    assert (suffixes.suffix_array(t, levels) == by_doubling(t)).all()
    assert len(levels) >= 3 and levels[1] > 500_000 and all(b <= a // 2 for a, b in zip(levels, levels[1:], strict=False))


def test_unlike_strings_of_one_hash_keep_their_names():
    """A Thue-Morse string and its complement hash alike modulo 2 ** 64; names come from the bytes."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    t = np.array([ord(c) for c in "c" + morse + "c" + other + "c" + morse] + [0])
    assert suffixes.suffix_array(t).tolist() == by_doubling(t).tolist()


def test_stretches_hold_every_window_once():
    texts = [b"abcdefghijklmnopqrstuvwxyz", b"", b"abc", bytes(range(97, 107)), b"y" * 31]
    got = [(i, at + s) for rows, offsets, parts in suffixes.stretches(texts, 4, 10) for i, at, p in zip(rows, offsets, parts, strict=True) for s in range(len(p) - 3)]
    assert got == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 3)]


def brute(rows, length):
    """(id, text) rows with distinct ids to {id: (bytes, removed, spans, kept)}."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            else:
                seen[w] = s
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out[i] = (len(data), int(gone.sum()), int(np.sum(gone[1:] & ~gone[:-1]) + gone[0]), hashlib.sha256(kept).hexdigest())
    return out


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_suffixes(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows, 100)


@pytest.mark.parametrize("crowd", [1000, 2])
def test_small_windows(spark, crowd):
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdef ") for _ in range(40))
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    rows += [(i, "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 30))) + passage + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 30)))) for i in range(40, 70)]
    rows += [(70, "é" * 40), (71, "xé" * 30), (72, "abc" * 50), (73, "abc" * 50), (74, "q" * 300), (75, None), (76, ""), (77, rows[45][1]), (78, rows[45][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.remove_repeats(df, 12, crowd=crowd).collect()}
    assert got == brute(rows, 12)


def test_texts_longer_than_a_block(spark):
    rnd = random.Random(6)
    body = "".join(rnd.choice("abcdefgh") for _ in range(1_300_000))
    rows = [(1, body), (2, "start " + body[1_040_000:1_060_000] + " end"), (3, body[:500] + "z" + body[500:900])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.remove_repeats(df, 40).collect()}
    assert got == brute(rows, 40)


def test_odd_rows(odd, none):
    got = suffixes.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[4].n_bytes == 120_000 and by[4].n_removed == 119_999 and by[4].n_spans == 1 and bytes(by[4].kept) == b"x"
    assert by[3].n_bytes == by[2].n_bytes == 0 and by[None].n_removed == 0
    assert suffixes.remove_repeats(none).count() == 0


def brute_by_id(rows, length):
    """The same where rows may share an id: they are one document, whose windows at one start don't remove each other."""
    first = {}
    for i, text in rows:
        data = text.encode()
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            first[w] = min(first.get(w, (i, s)), (i, s))
    gone = {}
    for i, text in rows:
        data = text.encode()
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < (i, s):
                gone.setdefault(i, set()).update(range(s, s + length))
    return sorted((i, bytes(b for k, b in enumerate(text.encode()) if k not in gone.get(i, ()))) for i, text in rows)


def test_ids_with_a_copy_and_another_text(spark):
    rnd = random.Random(9)
    made = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    t, p, b = made(400), made(180), made(600)
    rows = [(1, t), (2, made(50) + p + made(40)), (5, t), (5, b), (9, b[:150] + made(200)), (11, t), (11, t), (12, b), (12, p + made(30))]
    want = brute_by_id(rows, 100)
    assert dict(want)[9] != rows[4][1].encode()
    for crowd in (1000, 2):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = sorted((r.doc_id, bytes(r.kept)) for r in suffixes.remove_repeats(df, 100, crowd=crowd).collect())
        assert got == want
