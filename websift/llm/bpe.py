"""Byte-pair encoding and decoding by forced-boundary splitting.

A pair of adjacent bytes that no vocabulary token contains can never be merged over, so a text may be cut there: the
fragments are encoded independently and their ids concatenated. White space and the pre-tokenizer's pieces are cuts of
the same kind (no token spans them), so a worker keeps the ids of the chunks it has met and looks the next ones up.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, widened, without

#: Fixed values of the vocabulary's file format: pieces that its pre-tokenizer keeps, and the bytes that its byte-level
#: alphabet shows as themselves (the others follow from U+0100 on).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+"  # of a run without white space
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"  # of a run without white space
SHOWN = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
#: A worker remembers chunks and pieces in two generations of at most this many each.
MEMO = 1 << 17
NONE = 1 << 40


def byte_alphabet() -> list[str]:
    shown = {b for low, high in SHOWN for b in range(low, high + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Memo:
    """A bounded memory of results: when the new generation is full it becomes the old one, and what is asked for again moves up."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(key) <= 64:
            if len(self.new) >= MEMO:
                self.old, self.new = self.new, {}
            self.new[key] = value
        return value


class Decoder:
    """The tokens of one vocabulary file, and nothing that only encoding needs."""

    def __init__(self, file: bytes | dict):
        spec = json.loads(file) if isinstance(file, bytes) else file
        named = [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]
        self.tokens = [""] * (max(i for _, i in named) + 1)
        for token, i in named:
            self.tokens[i] = token

    def decode(self, packed: bytes) -> str:
        """The file has no decoder: the tokens as they are written, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class Tokenizer(Decoder):
    """The encoder and decoder of one vocabulary file (lower-casing, NFC, word ends marked)."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        super().__init__(spec)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[int, int] = {}  # of a pair of ids, packed
        self.made: list[int] = []  # the id that the merge of a rank gives
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.made.append(vocab[a + b])
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.end] for c in alphabet]
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.joined = np.zeros((256, 256), bool)  # pairs of bytes that some token holds side by side
        for token in vocab:
            raw = [byte_of[c] for c in token.removesuffix(self.end) if c in byte_of]
            self.joined[raw[:-1], raw[1:]] = True
        self.never = frozenset(map(tuple, np.argwhere(~self.joined).tolist()))
        self.added = added
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.markers = tuple(added)
        self.pieces = regex.compile(PIECES)
        self.ascii_pieces = re.compile(ASCII_PIECES).findall
        self.chunks, self.parts = Memo(), Memo()

    def fragment(self, raw: bytes, ends: bool) -> list[int]:
        """Ids of one fragment: the best-ranked neighbouring pair is merged, leftmost first, until none is left."""
        ids = [self.inner[b] for b in raw]
        if ends:
            ids[-1] = self.last[raw[-1]]
        if len(ids) > 200:
            return self.long_fragment(ids)
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 20 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], NONE)
        return ids

    def long_fragment(self, ids: list[int]) -> list[int]:
        """The same by a heap of places over linked neighbours, for fragments of any length."""
        n, rank, made = len(ids), self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 20 | ids[j], NONE) != r:
                continue
            ids[i], ids[j] = made[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (new := rank(ids[x] << 20 | ids[y], NONE)) != NONE:
                    heapq.heappush(heap, (new, x))
        return [i for i in ids if i >= 0]

    def piece(self, text: str) -> bytes:
        """Packed ids of one pre-tokenized piece, cut where two neighbouring bytes are never joined."""
        known = self.parts.get(text)
        if known is not None:
            return known
        raw, never = text.encode(), self.never
        cuts = [i + 1 for i, pair in enumerate(zip(raw, raw[1:], strict=False)) if pair in never]
        ids: list[int] = []
        for start, stop in zip([0, *cuts], [*cuts, len(raw)], strict=True):
            ids += self.fragment(raw[start:stop], stop == len(raw))
        return self.parts.put(text, array("I", ids).tobytes())

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space, packed as little-endian unsigned 32-bit integers."""
        if (known := self.chunks.old.get(chunk)) is not None:
            return self.chunks.put(chunk, known)
        if chunk.isascii():
            pieces = self.ascii_pieces(chunk.lower())
        else:
            pieces = self.pieces.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())
        return self.chunks.put(chunk, b"".join([self.piece(p) for p in pieces]))

    def plain(self, text: str) -> bytes:
        chunks = WHITE.split(text) if CONTROL.search(text) else text.split()
        chunk = self.chunk
        out = []
        for c in chunks:
            if c:
                out.append(self.chunks.new.get(c) or chunk(c))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.special is None or not any(m in text for m in self.markers):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


#: Information separators are white space to str.split, but not to the tokenizer.
CONTROL = re.compile("[\x1c-\x1f]")
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@lru_cache(maxsize=1)
def tokenizer(file: bytes) -> Tokenizer:
    return Tokenizer(file)


@lru_cache(maxsize=1)
def decoder(file: bytes) -> Decoder:
    return Decoder(file)


def shipped(df: DataFrame, path: str):
    """The vocabulary file's bytes (1.7 MB, whatever the input) as a broadcast, so that executors need no such file."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decode: bool = False) -> DataFrame:
    """Encode every whole text: id, the kept columns, n_tokens, ids (packed little-endian unsigned 32-bit integers).

    Null texts are empty ones and give no tokens; rows are independent, so repeated rows and null ids just stay; an empty
    table gives no rows. Texts are taken about a megabyte at a time, a longer one by itself. A kept column of the name of
    a result gives way to the result; other columns are not read. With `decode`, decoded (the text of the ids) is added
    by the same worker, which saves a second one.
    """
    file = shipped(docs, path)
    made = {"n_tokens": "long", "ids": "binary"} | ({"decoded": "string"} if decode else {})
    kept = [c for c in dict.fromkeys((id_col, *keep)) if c.lower() not in made]
    rows = docs.select(*kept, F.col(text_col).alias("_text"))

    def run(batches):
        own = tokenizer(file.value)
        for batch in (part for b in batches for part in slices(b, b.num_columns - 1)):
            packed = [own.encode(t) if t else b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [*batch.columns[:-1], pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
            if decode:
                cols.append(pa.array([own.decode(p) for p in packed], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *made])

    return rows.mapInArrow(run, widened(rows.drop("_text").schema, **made))


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Add decoded: the text of the packed ids (null where they are null).

    Rows are independent, repeated ones agree, and an empty table gives no rows; ids are taken about a megabyte at a
    time, those of a longer text by themselves. A column named decoded is replaced.
    """
    file = shipped(encoded, path)
    rows = without(encoded, "decoded")
    names = rows.columns
    at = names.index(ids_col)

    def run(batches):
        own = decoder(file.value)
        for batch in (part for b in batches for part in slices(b, at)):
            texts = [None if p is None else own.decode(p) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return rows.mapInArrow(run, widened(rows.schema, decoded="string"))
