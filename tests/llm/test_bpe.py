import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from websift.llm import bpe
from websift.llm.queries import op2_bpe, vocabulary_path

from ..conftest import SF_DIR


@pytest.fixture(scope="module")
def library():
    return Library.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def own():
    with open(vocabulary_path(), "rb") as f:
        return bpe.Tokenizer(f.read())


@pytest.mark.parametrize("text", [
    "", " ", "Hello, World's best 123 tests!!", "ÀÉ façade naïve Straße 日本語", "é ́x a\x1cb\x1dc\xa0d\x85e　f", "ΟΔΥΣΣΕΥΣ ΣΑΣ İstanbul",
    "<|endoftext|>mid<|startoftext|> <|endoftext|", "it's we'll I'D 'S \"'s x'ss", "a\n\n\tb\rc d", "²½Ⅷ ٣ x²", "🙂🙂‍♂️ emoji ퟿", "x" * 3000, "&&&***$$$ word%%% ### !!", "\x00\x01\x7f",
])
def test_same_as_library(text, own, library):
    ids = library.encode(text, add_special_tokens=False).ids
    packed = own.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert own.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_forced(own):
    assert own.never and not any(t for t in own.tokens if any(p in own.never for p in zip(t.encode()[:-1], t.encode()[1:], strict=False)) and t.isascii() and "<" not in t)


def test_query_against_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = op2_bpe(spark, SF_DIR).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, none, library):
    got = bpe.encode_documents(odd, vocabulary_path(), keep=("key",)).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[3].n_tokens == by[2].n_tokens == 0 and by[None].n_tokens > 0
    assert by[6].n_tokens == len(library.encode("a b c d e f g h " * 5_000, add_special_tokens=False).ids)
    assert bpe.encode_documents(none, vocabulary_path()).count() == 0


def test_clashing_names_and_both_decoders(odd, library):
    docs = odd.selectExpr("*", "'clash' as ids", "'clash' as n_tokens", "'clash' as decoded")
    path = vocabulary_path()
    both = bpe.encode_documents(docs, path, keep=("ids", "n_tokens", "decoded"), decode=True)
    assert both.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    plain = bpe.encode_documents(docs, path, keep=("ids", "source", "decoded"))
    assert plain.columns == ["doc_id", "source", "decoded", "n_tokens", "ids"]
    again = bpe.decode_documents(plain, path)
    assert again.columns.count("decoded") == 1
    one = sorted(((r.doc_id, r.decoded) for r in both.collect()), key=str)
    assert one == sorted(((r.doc_id, r.decoded) for r in again.collect()), key=str)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(d == library.decode(library.encode(texts[i], add_special_tokens=False).ids, skip_special_tokens=False) for i, d in one)


def test_a_large_vocabulary_is_merged_once(monkeypatch):
    with open(vocabulary_path(), "rb") as f:
        fresh = bpe.Tokenizer(f.read())
    text = " ".join(f"w{''.join(chr(97 + int(d)) for d in str(i))}" for i in range(100_000))
    first = fresh.encode(text)
    monkeypatch.setattr(fresh, "fragment", None)  # a word that was forgotten would be merged again
    assert fresh.encode(text) == first
