"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and what they link there.

A worker tokenises about a megabyte of texts and aligns them at once, while the tokens are at hand: marks at the byte
offsets where one vocabulary's tokens end tell which of the other's end there, and numpy lays the groups out as text.
Only links, counts and digests leave it; how often each pair of ids is linked in the corpus is Spark's joins and sums.

Ids are the installed libraries': the byte-level vocabulary's ids follow the order of its merges (checked), so that it
can also be read as a table of ranks, which the fastest of them encodes; texts with very long runs go to the other one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType
from tokenizers import Tokenizer

from .bpe import byte_alphabet, shipped
from .common import finished, materialize, slices, widened, without

#: Fixed value: the pre-tokenizer of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces so long take the square of their length as ranks.
LONG = 1000
BLANK = re.compile(rf"\s{{{LONG}}}")
NONE = np.zeros(0, np.int32)
TOKENS = {name: ArrayType(IntegerType()) for name in ("a_ids", "a_ends", "b_ids", "b_ends")}
#: Pairs with more than this part of all links are looked up by a broadcast: there are fewer of them than this number.
FREQUENT = 1 << 17


def has_long_run(text: str) -> bool:
    """Whether as many characters as LONG stand together that are all white space, or none of which is."""
    if len(text) < LONG:
        return False
    words = list(map(len, text.split()))
    return max(words, default=0) >= LONG or len(text) - sum(words) >= LONG and BLANK.search(text) is not None


def _whole(table: list[bytes], ids: list[int]) -> bytes:
    """The bytes of ids, joined."""
    return b"".join(itemgetter(*ids)(table)) if len(ids) > 1 else b"".join(table[i] for i in ids)


class Both:
    """The tokenizers of two vocabulary files, and the bytes of their tokens."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        model = json.loads(a_file)["model"]
        self.a_bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if not all(x < y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("the first vocabulary's ids don't follow the order of its merges")
        added = {t["id"] for t in json.loads(a_file)["added_tokens"]}
        ranks = {raw: i for i, raw in enumerate(self.a_bytes) if i not in added}
        self.fast = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int32) for x in (self.a_bytes, self.b_bytes))

    def tokens(self, text: str | None) -> tuple:
        """(a ids, a ends, b ids, b ends) of a text; all empty for texts without tokens."""
        if not text:
            return (NONE,) * 4
        spaced = " " + text
        a = self.a.encode(spaced, add_special_tokens=False).ids if has_long_run(text) else self.fast.encode_ordinary(spaced)
        b = self.b.encode(text, num_threads=1)
        if not _whole(self.a_bytes, a) == spaced.encode() == _whole(self.b_bytes, b):
            return (NONE,) * 4
        a, b = np.array(a, np.int32), np.array(b, np.int32)
        return a, np.cumsum(self.a_length[a], dtype=np.int32), b, np.cumsum(self.b_length[b], dtype=np.int32)


@lru_cache(maxsize=1)
def both(a_file: bytes, b_file: bytes) -> Both:
    return Both(a_file, b_file)


def _lists(arrays: tuple[np.ndarray, ...]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, NONE])))


def tokenize(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """Add a_ids, a_ends, b_ids, b_ends to every row in place of its text: ids in order, and the byte offset of each token's end.

    A is a byte-level BPE file of the tokenizers library, given a space and the text; B a sentencepiece BPE model, given
    the text, which puts the space there itself. Offsets count from that space. Special tokens are neither added nor
    found in texts. Texts that are null or empty, or whose joined tokens of either vocabulary aren't the space and the
    text in UTF-8 (white space that B's normal form changes, its space mark in the text), have four empty arrays.
    Rows are independent: repeated ones agree, null ids stay, an empty table gives no rows. Texts are taken about a
    megabyte at a time, a longer one by itself. Columns named as the four are replaced.
    """
    a_file, b_file = shipped(docs, a_path), shipped(docs, b_path)
    kept = [c for c in docs.columns if c != text_col and c.lower() not in TOKENS]
    rows = docs.select(*kept, F.col(text_col).alias("_text"))

    def run(batches):
        own = both(a_file.value, b_file.value)
        for batch in (part for b in batches for part in slices(b, len(kept))):
            found = zip(*(own.tokens(t) for t in batch.column(len(kept)).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(_lists, found)], names=[*kept, *TOKENS])

    return rows.mapInArrow(run, widened(rows.drop("_text").schema, **TOKENS))


class Side(NamedTuple):
    """One vocabulary's tokens of some rows, one row after another."""

    ids: np.ndarray
    ends: np.ndarray
    #: Where each row's tokens start among these, and the last row's end.
    rows: np.ndarray

    def by_row(self, values: np.ndarray) -> np.ndarray:
        """The sum of the tokens' values in each row."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.rows])


def _side(ids: list[np.ndarray], ends: list[np.ndarray]) -> Side:
    return Side(np.concatenate([*ids, NONE]), np.concatenate([*ends, NONE]), np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)]))


def cut(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of each vocabulary end where one of the other does, in the same row.

    As no token is empty, exactly one token of each ends at a cut; a row's last tokens end together.
    """
    ends = [np.concatenate([[0], x.ends])[np.where(np.diff(x.rows) > 0, x.rows[1:], 0)] for x in (a, b)]
    base = np.concatenate([[0], np.cumsum(np.maximum(*ends), dtype=np.int64)])
    at_a, at_b = (x.ends + np.repeat(base[:-1], np.diff(x.rows)) for x in (a, b))
    ends_a, ends_b = np.zeros((2, base[-1] + 1), bool)
    ends_a[at_a] = ends_b[at_b] = True
    return ends_b[at_a], ends_a[at_b]


def link(a: Side, b: Side, last_a: np.ndarray, last_b: np.ndarray) -> np.ndarray:
    """The links (first id * 2^32 + second id) between the tokens that end at cuts."""
    return a.ids[last_a].astype(np.int64) << 32 | b.ids[last_b]


@lru_cache(maxsize=2)
def _numerals(bits: int) -> tuple[np.ndarray, ...]:
    """Every number below 2^bits in decimal and a separator, `,` `|` `;`, as 8 bytes padded with zeros; and its length with the separator."""
    if bits > 23:
        raise ValueError("ids of more than 7 digits")
    decimal = np.arange(1 << bits).astype("S7")
    return *(np.strings.add(decimal, sep).astype("S8").view(np.uint64) for sep in (b",", b"|", b";")), np.strings.str_len(decimal).astype(np.int64) + 1


def write(a: Side, b: Side, last_a: np.ndarray, last_b: np.ndarray) -> Iterator[memoryview]:
    """Each row's groups as text, `a1,a2|b1;a3|b2,b3`: ids of A and B in order; empty without tokens."""
    comma, bar, semicolon, length = _numerals(max(map(int.bit_length, (int(x.ids.max(initial=0)) for x in (a, b)))))
    stop_a, stop_b = (np.flatnonzero(last) + 1 for last in (last_a, last_b))
    out = np.empty(len(a.ids) + len(b.ids), np.uint64)  # a group's A tokens come after the B tokens of the groups before it
    out[np.arange(len(a.ids)) + np.repeat(np.concatenate([[0], stop_b])[:-1], np.diff(stop_a, prepend=0))] = np.where(last_a, bar[a.ids], comma[a.ids])
    out[np.arange(len(b.ids)) + np.repeat(stop_a, np.diff(stop_b, prepend=0))] = np.where(last_b, semicolon[b.ids], comma[b.ids])
    cells = out.view(np.uint8)
    text = memoryview(cells[cells != 0])
    start = 0
    for n in (a.by_row(length[a.ids]) + b.by_row(length[b.ids])).tolist():
        yield text[start : start + max(0, n - 1)]
        start += n


def _sides(batch: pa.RecordBatch) -> tuple[Side, Side]:
    """Both vocabularies' tokens of a batch of tokenised rows."""
    column = lambda c: batch.column(batch.schema.get_field_index(c)).flatten().to_numpy()
    rows = lambda c: np.concatenate([[0], np.cumsum(batch.column(batch.schema.get_field_index(c)).value_lengths().to_numpy(), dtype=np.int64)])
    return Side(column("a_ids"), column("a_ends"), rows("a_ids")), Side(column("b_ids"), column("b_ends"), rows("b_ids"))


def align(tokens: DataFrame) -> DataFrame:
    """Add a_cuts, b_cuts (1-based places of each group's last token) and links (first id * 2^32 + second id) to tokenised rows.

    The byte offsets where tokens of both vocabularies end cut them into groups. As no token is empty, exactly one token
    of each ends at a cut, so a group has one link: that of its last tokens. Rows without tokens have empty arrays.
    Columns named as the three are replaced.
    """
    tokens = without(tokens, "a_cuts", "b_cuts", "links")

    def run(batches):
        for batch in batches:
            a, b = _sides(batch)
            last = cut(a, b)
            places, lists = [np.flatnonzero(x) for x in last], a.by_row(last[0])
            offsets = pa.array(np.concatenate([[0], np.cumsum(lists)]).astype(np.int32))
            values = [(p + 1 - np.repeat(x.rows[:-1], lists)).astype(np.int32) for p, x in zip(places, (a, b), strict=True)]
            added = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (*values, link(a, b, *last))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "a_cuts", "b_cuts", "links"])

    return tokens.mapInArrow(run, widened(tokens.schema, a_cuts=ArrayType(IntegerType()), b_cuts=ArrayType(IntegerType()), links=ArrayType(LongType())))


def groups_text(aligned: DataFrame, name: str) -> DataFrame:
    """Add the groups of aligned rows as text under a name, `a1,a2|b1;a3|b2,b3`: ids of A and B in order; empty without tokens."""
    aligned = without(aligned, name)

    def run(batches):
        for batch in batches:
            a, b = _sides(batch)
            told = pa.array([str(t, "ascii") for t in write(a, b, *cut(a, b))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, told], names=[*batch.schema.names, name])

    return aligned.mapInArrow(run, widened(aligned.schema, **{name: "string"}))


MEASURES = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "links": ArrayType(LongType())}


def measure(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """Add n_a, n_b, n_groups, n_links, groups_sha256, links to every row in place of its text: what `tokenize`, `align` and `groups_text` give, in one go.

    groups_sha256 digests the groups' text; it is empty for texts without tokens. Rows are taken as by `tokenize`.
    """
    a_file, b_file = shipped(docs, a_path), shipped(docs, b_path)
    kept = [c for c in docs.columns if c != text_col and c.lower() not in MEASURES]
    rows = docs.select(*kept, F.col(text_col).alias("_text"))

    def run(batches):
        own = both(a_file.value, b_file.value)
        for batch in (part for b in batches for part in slices(b, len(kept))):
            a_ids, a_ends, b_ids, b_ends = zip(*(own.tokens(t) for t in batch.column(len(kept)).to_pylist()), strict=True)
            a, b = _side(a_ids, a_ends), _side(b_ids, b_ends)
            last = cut(a, b)
            groups = a.by_row(last[0])
            links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(groups)]).astype(np.int32)), pa.array(link(a, b, *last)))
            digests = [hashlib.sha256(t).hexdigest() if len(t) else "" for t in write(a, b, *last)]
            counts = (np.diff(a.rows), np.diff(b.rows), groups, groups)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), links], names=[*kept, *MEASURES])

    return rows.mapInArrow(run, widened(rows.drop("_text").schema, **MEASURES))


def pair_counts(links: DataFrame) -> DataFrame:
    """(link, n, best) of a frame with one link a row: how many rows hold the pair, and whether no pair of its second id has more."""
    counted = links.groupBy("link").agg(F.count("*").alias("n"))
    second = F.col("link").bitwiseAND(F.lit((1 << 32) - 1))
    most = counted.groupBy(second.alias("_b")).agg(F.max("n").alias("_most"))
    return counted.join(most, second == F.col("_b")).select("link", "n", (F.col("n") == F.col("_most")).alias("best"))


def score_links(aligned: DataFrame, row_col: str, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum) of every row that has links: how many of its links are their second id's commonest, and the sum of its links' counts.

    `aligned` is a written table, `row_col` tells its rows apart. Pairs that hold more than 1 / `frequent` of all links
    (so fewer than `frequent` pairs, at every size) are looked up by a broadcast; links of the others, none of which is
    frequent, meet their pair's count by a shuffle. Sums are taken by row before the shuffle.
    """
    links = aligned.select(F.col(row_col), F.explode("links").alias("link"))
    pairs = materialize(pair_counts(links), "alignment-pairs", aligned)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > F.lit(total // frequent)
    common = F.broadcast(pairs.filter(often))
    scores = [
        links.join(common, "link"),
        links.join(common.select("link"), "link", "left_anti").join(pairs.filter(~often), "link"),
    ]
    by_row = [s.groupBy(row_col).agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum")) for s in scores]
    summed = by_row[0].unionByName(by_row[1]).groupBy(row_col).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return finished(summed, "alignment-scores", pairs)


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum (all long), groups_sha256.

    groups_sha256 digests the groups as `groups_text` writes them; it is empty for texts without tokens, whose numbers
    are zeros. Counts are taken over all rows, repeated ones included, so that equal texts have equal values. An empty
    table gives no rows. Other columns are not read, whatever their names.
    """
    told = measure(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_words")), a_path, b_path, "_words")
    told = told.withColumn("_row", F.monotonically_increasing_id())
    table = materialize(told, "alignment-tokens")
    scores = score_links(table, "_row", frequent)
    whole = table.drop("links").join(scores, "_row", "left").fillna(0, ["n_best", "count_sum"])
    return whole.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
