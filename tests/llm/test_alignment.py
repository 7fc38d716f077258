import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from websift.llm import alignment
from websift.llm.queries import ALIGNED, op12_alignment, vocabulary_path

from ..conftest import SF_DIR

A, B = map(vocabulary_path, ALIGNED)


class Libraries:
    """Both installed libraries on whole texts, and everything else in plain Python."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(i, self.b.id_to_piece(i)) for i in self.b.encode(text)]
        b = [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i, p in pieces]
        whole = (" " + text).encode()
        return (a, b) if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else ([], [])

    def rows(self, docs):
        kept, count = [], Counter()
        for i, text in docs:
            a, b = self.tokens(text)
            ends = []
            for side in (a, b):
                at, own = 0, {}
                for k, (_, raw) in enumerate(side):
                    at += len(raw)
                    own[at] = k
                ends.append(own)
            cuts = sorted(set(ends[0]) & set(ends[1]))
            groups, x, y = [], 0, 0
            for c in cuts:
                groups.append(",".join(str(t) for t, _ in a[x : ends[0][c] + 1]) + "|" + ",".join(str(t) for t, _ in b[y : ends[1][c] + 1]))
                x, y = ends[0][c] + 1, ends[1][c] + 1
            links = [(a[ends[0][c]][0], b[ends[1][c]][0]) for c in cuts]
            count.update(links)
            kept.append((i, len(a), len(b), groups, links))
        most = defaultdict(int)
        for (_, second), n in count.items():
            most[second] = max(most[second], n)
        return sorted(((i, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
                        hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for i, n_a, n_b, groups, links in kept), key=repr)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    assert df.columns == NAMES and all(t == "bigint" for _, t in df.dtypes[:-1])
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


def test_query_against_the_libraries(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert got(op12_alignment(spark, SF_DIR)) == libraries.rows(docs)


def test_odd_texts(odd, none, libraries):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    found = got(alignment.align_documents(odd, A, B))
    assert found == libraries.rows(docs)
    assert (2, 0, 0, 0, 0, 0, 0, "") in found and (3, 0, 0, 0, 0, 0, 0, "") in found
    assert alignment.align_documents(none, A, B).count() == 0


TEXTS = [
    "a  b", "  a ", "\n\n\t", "▁a", "a▁ b", "<unk> <s> <0x41> <|endoftext|>", "ﬁ ① é é", "日本語 と 한국어", "a　b\xa0c d", "🙂🙂‍♂️", "x" * 2500, " " * 3000, "!?" * 900 + " z",
    "it's we'll I'D", "\x00\x01\x1c\x85", "a\r\nb",
]


def test_same_as_the_libraries(libraries):
    with open(A, "rb") as a, open(B, "rb") as b:
        own = alignment.Both(a.read(), b.read())
    rng = random.Random(5)
    pool = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    made = ["".join(rng.choice(pool) if rng.random() < 0.3 else rng.choice(" abcXYZ019.,'!\n\t　é日▁sll<|>") for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    for text in TEXTS + made:
        found = own.tokens(text)
        a, b = libraries.tokens(text)
        assert found[0].tolist() == [i for i, _ in a] and found[2].tolist() == [i for i, _ in b], text
        if a:
            assert found[1][-1] == found[3][-1] == len((" " + text).encode())


@pytest.mark.parametrize("frequent", [1, 40, 1 << 40])
def test_frequent_pairs_and_others_agree(spark, libraries, frequent):
    docs = [(k, t) for k, t in enumerate(TEXTS * 3)] + [(None, "a b"), (1, "a b"), (1, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(alignment.align_documents(df, A, B, frequent=frequent)) == libraries.rows(docs)


def test_groups_and_links(spark):
    rows = [(1, [10, 11, 12], [2, 3, 6], [20, 21], [3, 6]), (2, [], [], [], []), (3, [10], [4], [20, 21, 22], [1, 2, 4])]
    tokens = spark.createDataFrame(rows, "id int, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>")
    found = {r.id: r for r in alignment.groups_text(alignment.align(tokens), "told").withColumn("links", F.transform("links", lambda x: F.concat_ws("-", F.shiftright(x, 32), x.bitwiseAND(0xFFFFFFFF)))).collect()}
    assert [found[i].told for i in (1, 2, 3)] == ["10,11|20;12|21", "", "10|20,21,22"]
    assert found[1].a_cuts == [2, 3] and found[1].b_cuts == [1, 2] and found[2].a_cuts == []
    assert found[1].links == ["11-20", "12-21"] and found[3].links == ["10-22"] and found[2].links == []


def test_long_runs_are_those_of_the_pattern():
    import re

    rng = random.Random(6)
    pattern = re.compile(r"\S{1000}|\s{1000}")
    for _ in range(300):
        text = "".join(rng.choice(["x", " ", "\u3000\x1c"]) * rng.choice([1, 2, 499, 500, 501, 999, 1000]) for _ in range(rng.randrange(6)))
        assert alignment.has_long_run(text) == (pattern.search(text) is not None)


def test_links_and_digests_leave_the_worker_without_tokens(spark):
    """Tokens and their places are several numbers a word: only links, counts and a digest go back to Spark."""
    docs = spark.createDataFrame([(1, "it's a b", 7), (2, None, 8)], "doc_id long, text string, links int")
    steps = alignment.groups_text(alignment.align(alignment.tokenize(docs, A, B)), "told").collect()
    found = alignment.measure(docs, A, B)
    assert found.columns == ["doc_id", *alignment.MEASURES] and not set(alignment.TOKENS) & set(found.columns)
    for x, y in zip(steps, found.collect(), strict=True):
        assert (y.n_a, y.n_b, y.n_groups, y.links) == (len(x.a_ids), len(x.b_ids), len(x.a_cuts), x.links)
        assert y.groups_sha256 == (hashlib.sha256(x.told.encode()).hexdigest() if x.told else "")
