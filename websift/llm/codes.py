"""Vector codes: each part of a vector becomes the number of its codebook's nearest entry, found by VA-file filtering.

Components are whole numbers. A codebook's coordinates are quantised to a few bits: cells that hold equally many entries,
with their lowest and highest coordinate. For each vector part, lookup tables by cell give the least and the greatest
squared distance a coordinate can add, hence bounds of every entry's distance; only entries whose lower bound doesn't
pass the least upper bound are compared, in exact integers.

Codebooks are learned in rounds over all vectors: workers sum their own vectors by entry, Spark adds the sums up, and
the driver holds the codebooks alone (entries x length numbers for each length of vectors).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, widened
from .matrices import LARGEST, clamped, finite, floors, largest, matrices

#: Rows of a matrix that are compared at a time.
ROWS = 4096
SUMS = "length int, entry int, position int, limb int, value long"


class Cells:
    """The VA-file of one part's entries."""

    def __init__(self, entries: np.ndarray, bits: int = 3):
        n = len(entries)
        self.entries = entries
        cells = min(n, 1 << bits)
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = rank * cells // n
        ordered = np.sort(entries, axis=0, kind="stable")
        starts = -(-np.arange(cells + 1) * n // cells)
        self.low, self.high = ordered[starts[:-1]], ordered[starts[1:] - 1]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each row's nearest entry, ties to the lower one; and how many distances were computed."""
        entries, low, high = self.entries, self.low, self.high
        if 4 * int(max(largest(q), largest(entries))) ** 2 * max(1, q.shape[1]) >= 1 << 62:
            q, entries, low, high = (x.astype(object) for x in (q, entries, low, high))
        to_low, to_high = low[None] - q[:, None, :], q[:, None, :] - high[None]
        inner, outer = np.maximum(0, np.maximum(to_low, to_high)) ** 2, np.maximum(-to_low, -to_high) ** 2
        at = np.arange(q.shape[1])[None, :]
        lower, upper = inner[:, self.cell, at].sum(2), outer[:, self.cell, at].sum(2)
        rows, js = np.nonzero(lower <= upper.min(1)[:, None])
        gap = q[rows] - entries[js]
        refined = (gap * gap).sum(1)
        best = np.full(lower.shape, refined.max() + 1, refined.dtype)
        best[rows, js] = refined
        entry = best.argmin(1)
        return entry, best[np.arange(len(q)), entry], len(rows)


class Codebook:
    """The entries of all parts of one length of vectors: a matrix whose columns are positions, cut into parts."""

    def __init__(self, entries: np.ndarray, parts: int):
        self.entries = entries
        bounds = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(entries.shape[1]), parts))])
        self.parts = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.cells = [Cells(entries[:, p]) for p in self.parts]

    def assign(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) entry numbers, and the squared distances summed over parts, of a matrix of whole numbers."""
        found = [c.nearest(m[:, p]) for c, p in zip(self.cells, self.parts, strict=True)]
        wide = any(f[1].dtype == object for f in found) or sum(int(largest(f[1])) for f in found) > LARGEST
        return np.stack([f[0] for f in found], 1), sum((f[1].astype(object) if wide else f[1] for f in found), np.zeros(len(m), object if wide else np.int64))

    def digest(self) -> str:
        """SHA-256 of all components as decimal numbers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for p in self.parts for row in self.entries[:, p].tolist() for x in row).encode()).hexdigest()


def _blocks(column: pa.Array, books: dict[int, Codebook], scale: int):
    for rows, m in matrices(column):
        for i in range(0, len(rows), ROWS):
            whole = floors(m[i : i + ROWS], scale)
            yield rows[i : i + ROWS], whole, books[m.shape[1]]


def _sums(books, scale: int):
    """A worker's sums of vectors by entry, in limbs of 32 bits so that Spark can add them up without overflow; positions below 0 count a part's vectors."""

    def run(batches):
        total = {n: (np.zeros(b.entries.shape, object), np.zeros((len(b.parts), len(b.entries)), object)) for n, b in books.value.items()}
        for batch in batches:
            for _, m, book in _blocks(batch.column(0), books.value, scale):
                sums, counts = total[m.shape[1]]
                codes, _ = book.assign(m)
                for k, part in enumerate(book.parts):
                    for e in np.unique(codes[:, k]):
                        own = m[codes[:, k] == e, part]
                        sums[e, part] += (own if largest(own) < 1 << 48 else own.astype(object)).sum(0).astype(object)
                        counts[k, e] += len(own)
        out = []
        for n, (sums, counts) in total.items():
            values = [(e, p, x) for (e, p), x in np.ndenumerate(sums)] + [(e, -1 - k, x) for (k, e), x in np.ndenumerate(counts)]
            for e, p, x in values:
                x, sign, limb = int(abs(x)), 1 if x > 0 else -1, 0
                while x:
                    out.append((n, e, p, limb, sign * (x & 0xFFFFFFFF)))
                    x, limb = x >> 32, limb + 1
        if out:
            kinds = [pa.int32()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["length", "entry", "position", "limb", "value"])

    return run


def _improved(book: Codebook, sums: dict[tuple[int, int], int]) -> Codebook:
    entries = book.entries.astype(object)
    for k, part in enumerate(book.parts):
        for e in range(len(entries)):
            if n := sums.get((e, -1 - k), 0):
                entries[e, part] = [sums.get((e, p), 0) // n for p in range(part.start, part.stop)]
    return Codebook(entries if largest(entries) >= 1 << 62 else entries.astype(np.int64), len(book.parts))


def learn(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> dict[int, Codebook]:
    """A codebook for each length of the vectors: it starts as the vectors of the smallest ids, ties by their components; null ids are last.

    Every round assigns all vectors and replaces each entry by the floor of its parts' mean; unused entries stay. The
    number of entries is bounded by 256, that of lengths by what the driver can hold (one, in a usual table).
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    spark = rows.sparkSession
    vector = F.col(vector_col)
    whole = rows.filter(finite(vector)).select(F.size(vector).alias("length"), F.col(id_col).alias("id"), vector.cast("array<double>").alias("vector"))
    first = F.row_number().over(Window.partitionBy("length").orderBy(F.col("id").asc_nulls_last(), "vector"))
    starts: dict[int, list] = {}
    for r in sorted(whole.withColumn("n", first).filter(F.col("n") <= entries).collect(), key=lambda r: r.n):
        starts.setdefault(r.length, []).append(r.vector)
    books = {n: Codebook(floors(np.array(v, float).reshape(len(v), n), scale), parts) for n, v in starts.items()}
    for _ in range(rounds if books else 0):
        shared = spark.sparkContext.broadcast(books)
        added = rows.select(vector).mapInArrow(_sums(shared, scale), SUMS).groupBy("length", "entry", "position", "limb").agg(F.sum("value").alias("value")).collect()
        sums: dict[int, dict] = {n: {} for n in books}
        for r in added:
            own = sums[r.length]
            own[r.entry, r.position] = own.get((r.entry, r.position), 0) + (r.value << 32 * r.limb)
        books = {n: _improved(b, sums[n]) for n, b in books.items()}
        shared.unpersist()
    return books


def encode(rows: DataFrame, books: dict[int, Codebook], scale: int = 4096, vector_col: str = "embedding") -> DataFrame:
    """Replace the vector by code (two hex digits a part), error (squared distance of vector and entries) and codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped. Errors beyond the largest long are held
    there. Columns named as the three are replaced.
    """
    made = {"code": "string", "error": "long", "codebooks_sha256": "string"}
    kept = [c for c in rows.columns if c != vector_col and c.lower() not in made]
    given = rows.select(*kept, F.col(vector_col).alias("_vector"))
    shared = given.sparkSession.sparkContext.broadcast((books, {n: b.digest() for n, b in books.items()}))

    def run(batches):
        own, digests = shared.value
        for batch in batches:
            for at, m, book in _blocks(batch.column(len(kept)), own, scale):
                codes, errors = book.assign(m)
                width, text = 2 * len(book.parts), codes.astype(np.uint8).tobytes().hex()
                made_here = [pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string()), pa.array(clamped(errors)), pa.array([digests[m.shape[1]]] * len(m), pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.select(range(len(kept))).take(pa.array(at)).columns, *made_here], names=[*kept, *made])

    return given.mapInArrow(run, widened(given.drop("_vector").schema, **made))


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: id, code, error, label_error, codebooks_sha256; codebooks are learned from the same vectors.

    Vectors that are null or hold null or non-finite components are dropped. Each component x becomes floor(scale * x),
    exactly; a vector is cut into `parts` consecutive parts of one length (where that can't be, the first are longer by
    one). Vectors of another length are a corpus of their own, with codebooks of their own. Rows that share an id are
    vectors each, and null ids stay. label_error adds up errors over equal labels of all lengths, nulls together; it and
    error stop at the largest long. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    books = learn(rows, parts, entries, rounds, scale, "id", "vector")
    coded = materialize(encode(rows, books, scale, "vector"), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(LARGEST)).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
