"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized through integral images, kept as NPY tiles with difference hashes."""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fresh_path, materialize, slices, widened, without

HASH_ROWS, HASH_COLS = 8, 9


def _fields(data: bytes, n: int) -> tuple[list[int], int]:
    """The n numbers after a Netpbm magic, and where the white space after the last ends; # starts a comment."""
    out, at = [], 2
    while len(out) < n:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P2, P3 (plain) and P5, P6 (raw, 8 or 16 bits) as height x width [x 3]; P1 and P4 bitmaps as 0 and 1 (1 is black)."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    if kind in (b"P1", b"P4"):
        (w, h), at = _fields(data, 2)
        if kind == b"P1":
            bits = [c - 48 for c in data[at - 1 :] if c in b"01"]
            return np.array(bits[: w * h], np.uint8).reshape(h, w)
        rows = np.frombuffer(data, np.uint8, h * -(-w // 8), at).reshape(h, -1)
        return np.unpackbits(rows, axis=1)[:, :w]
    (w, h, top), at = _fields(data, 3)
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P2", b"P3"):
        flat = np.array(data[at - 1 :].split()[: w * h * depth], np.uint16)
        flat = flat.astype(np.uint8) if top < 256 else flat
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * depth, at)
    return flat.reshape((h, w, 3) if depth == 3 else (h, w))


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A raw 8-bit grey map."""
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as height x width x 3 in RGB, top row first."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, head, w, h = struct.unpack_from("<I4xIii", data, 10)[0], *struct.unpack_from("<Iii", data, 14)
    bits, packing = struct.unpack_from("<HI", data, 28)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("a BMP of this kind is not read")
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        palette = np.zeros((256, 3), np.uint8)
        own = np.frombuffer(data, np.uint8, start - 14 - head, 14 + head)
        own = own[: len(own) // 4 * 4].reshape(-1, 4)[:256]
        palette[: len(own)] = own[:, 2::-1]
        return palette[rows]
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode_media(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    """RGB to luminance; grey stays."""
    return pixels if pixels.ndim == 2 else pixels[..., 0] * 0.299 + pixels[..., 1] * 0.587 + pixels[..., 2] * 0.114


def area_resize(pixels: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over the exact (fractional) areas, from a summed-area table read at interpolated corners; 0 for an empty image.

    The table is piecewise bilinear, so reads between its entries are exact. Only its rows at the corners are made, which
    keeps memory at a few rows whatever the height.
    """
    h, w = pixels.shape
    if not h or not w:
        return np.zeros((rows, cols))

    def at(n, parts):
        x = np.arange(parts + 1) * (n / parts)
        low = np.minimum(x.astype(np.int64), n - 1)
        return low, x - low

    (r, fr), (c, fc) = at(h, rows), at(w, cols)
    starts = np.unique(r)  # the first is 0
    sums = np.add.reduceat(pixels, starts, axis=0, dtype=np.float64)
    above = np.concatenate([np.zeros((1, w)), np.cumsum(sums, 0)])[np.searchsorted(starts, r)]
    strips = above + pixels[r] * fr[:, None]
    table = np.concatenate([np.zeros((rows + 1, 1)), np.cumsum(strips, 1)], 1)
    corners = table[:, c] + strips[:, c] * fc
    return np.diff(np.diff(corners, axis=0), axis=1) / ((h / rows) * (w / cols))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 8 neighbours in a row grows."""
    small = np.round(area_resize(grey(pixels), HASH_ROWS, HASH_COLS), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def store_payloads(rows: DataFrame, payload_col: str, width: int = 64) -> DataFrame:
    """Replace a binary column whose lengths are multiples of `width` by media: the payload as the samples of a PGM (null stays).

    A column named media is replaced. Payloads are taken about a megabyte at a time, longer ones by themselves.
    """
    rows = rows if payload_col.lower() == "media" else without(rows, "media")
    at, names = rows.columns.index(payload_col), [c for c in rows.columns if c != payload_col]

    def run(batches):
        for batch in (part for b in batches for part in slices(b, at)):
            media = [None if p is None else encode_pgm(np.frombuffer(p, np.uint8).reshape(-1, width)) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(media, pa.binary())], names=[*names, "media"])

    return rows.mapInArrow(run, widened(rows.drop(payload_col).schema, media="binary"))


def media_features(rows: DataFrame, media_col: str = "media", tile: int = 32, keep_samples: bool = True) -> DataFrame:
    """Decode media and add samples (the decoded 8-bit samples, in order), height, width, tile (an NPY of tile x tile grey bytes) and dhash.

    Null media give nulls; media that can't be decoded give nulls and the reason in media_error. Rows are independent,
    so repeated ones agree; an empty table gives no rows. Columns of the added names are replaced. Media are taken about a
    megabyte at a time, a larger one by itself.
    """
    rows = without(rows, "samples", "height", "width", "tile", "dhash", "media_error")
    names = rows.columns
    at = names.index(media_col)
    fields = [("samples", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("media_error", pa.string())]

    def one(data):
        if data is None:
            return (None,) * 6
        try:
            pixels = decode_media(data)
        except (ValueError, struct.error, IndexError) as e:
            return (None,) * 5 + (str(e)[:200] or type(e).__name__,)
        small = np.clip(np.round(area_resize(grey(pixels), tile, tile)), 0, 255).astype(np.uint8)
        return pixels.tobytes() if keep_samples else None, pixels.shape[0], pixels.shape[1], npy(small), difference_hash(pixels), None

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                cols = list(zip(*map(one, part.column(at).to_pylist()), strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True))], names=[*names, *(n for n, _ in fields)])

    schema = widened(rows.schema, samples="binary", height="integer", width="integer", tile="binary", dhash="string", media_error="string")
    return rows.mapInArrow(run, schema)


def write_tiles(rows: DataFrame, folder: str | None = None, id_col: str = "doc_id", tile_col: str = "tile", hash_col: str = "dhash") -> DataFrame:
    """Write every row's tile to NPY archives, a file for each task, and return the index: id, hash, file, offset, length.

    A tile is read back by `np.load` on its bytes of the file. The index is committed by Spark as a table and names the
    file of the attempt that succeeded. Rows without a tile are left out; an empty table writes nothing.
    """
    folder = folder or fresh_path(rows.sparkSession, "tiles")
    picked = rows.select(F.col(id_col).alias("id"), F.col(hash_col).alias("dhash"), F.col(tile_col).alias("tile")).filter("tile is not null")

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, sink, at = f"part-{uuid.uuid4().hex}.npy", None, 0
        for batch in batches:
            sink = sink or store.open_output_stream(f"{root}/{name}", compression=None)
            sizes = np.asarray(pc.binary_length(batch.column(2)), np.int64)
            for tile in batch.column(2).to_pylist():
                sink.write(tile)
            offsets = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([name] * len(sizes)), pa.array(offsets), pa.array(sizes)], names=["id", "dhash", "file", "offset", "length"])
        if sink:
            sink.close()

    kind = picked.schema["id"].dataType.simpleString()
    index = materialize(picked.mapInArrow(run, f"id {kind}, dhash string, file string, offset long, length long"), "tile-index")
    return index.select(F.col("id").alias(id_col), "dhash", F.concat(F.lit(f"{folder}/"), "file").alias("file"), "offset", "length")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64) -> DataFrame:
    """Every whole text as a stored picture: id, n_bytes, media. Null is empty; zero bytes fill up to a positive multiple of `width`.

    The media are written to the shared folder and read back; repeated rows, null ids and empty texts are rows like any
    other, and an empty table gives no rows. Other columns are not read, whatever their names.
    """
    text = as_bytes(text_col)
    n = F.octet_length(text)
    fill = F.greatest(F.lit(1), F.ceil(n / width)) * width - n
    # rpad on binary would need the full length as a literal: the zeros are cut from one constant
    rows = docs.select(F.col(id_col), n.cast("long").alias("n_bytes"), F.concat(text, F.substring(F.lit(bytes(width)), F.lit(1), fill.cast("int"))).alias("payload"))
    return materialize(store_payloads(rows, "payload", width), "media")
