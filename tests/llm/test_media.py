import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from websift.llm import media
from websift.llm.queries import op8_media

from ..conftest import SF_DIR


def brute_resize(p, rows, cols):
    """Means over fractional areas, pixel by pixel."""
    h, w = p.shape
    out = np.zeros((rows, cols))
    for i in range(rows):
        for j in range(cols):
            y0, y1, x0, x1 = i * h / rows, (i + 1) * h / rows, j * w / cols, (j + 1) * w / cols
            wy = np.clip(np.minimum(np.arange(h) + 1, y1) - np.maximum(np.arange(h), y0), 0, None)
            wx = np.clip(np.minimum(np.arange(w) + 1, x1) - np.maximum(np.arange(w), x0), 0, None)
            out[i, j] = wy @ p @ wx / ((y1 - y0) * (x1 - x0))
    return out


@pytest.mark.parametrize("shape", [(1, 64), (8, 9), (7, 5), (33, 64)])
def test_resize(shape):
    p = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert np.allclose(media.area_resize(p, 8, 9), brute_resize(p.astype(float), 8, 9))


def test_formats():
    p = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode_media(media.encode_pgm(p)) == p).all()
    assert (media.decode_media(b"P2 # note\n4 3\n255\n" + b" ".join(b"%d" % x for x in p.ravel())) == p).all()
    rgb = np.arange(36, dtype=np.uint8).reshape(3, 4, 3)
    assert (media.decode_media(b"P6\n4 3\n255\n" + rgb.tobytes()) == rgb).all()
    assert media.decode_media(b"P4\n10 1\n" + bytes([0b10100000, 0b01000000])).tolist() == [[1, 0, 1, 0, 0, 0, 0, 0, 0, 1]]
    rows = b"".join(r[:, ::-1].tobytes() for r in rgb[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 3, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (media.decode_media(bmp) == rgb).all()
    tile = np.load(io.BytesIO(media.npy(p)))
    assert (tile == p).all() and len(media.difference_hash(rgb)) == 16


def test_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = op8_media(spark, SF_DIR).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id]
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = media.encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_odd_rows(spark, odd, none):
    got = media.media_features(media.text_media(odd)).collect()
    assert len(got) == odd.count() and {bytes(r.samples) for r in got if not r.n_bytes} == {bytes(64)}
    assert media.media_features(media.text_media(none)).count() == 0
    bad = media.media_features(spark.createDataFrame([(1, b"P5 nonsense"), (2, None)], "k int, media binary")).collect()
    assert bad[0].samples is None and bad[0].media_error and bad[1].media_error is None


@pytest.mark.parametrize("shape", [(1, 1), (3, 200), (500, 2), (100, 64)])
def test_resize_to_more_and_fewer(shape):
    p = np.random.default_rng(2).integers(0, 256, shape).astype(np.uint8)
    for to in ((1, 1), (8, 9), (32, 32)):
        assert np.allclose(media.area_resize(p, *to), brute_resize(p.astype(float), *to))


def test_tiles_are_written_and_read_back(odd, none):
    features = media.media_features(media.text_media(odd)).withColumn("file", F.lit("clash"))
    want = {(r.doc_id, r.dhash, bytes(r.tile)) for r in features.collect()}
    index = media.write_tiles(features)
    got = set()
    for r in index.collect():
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            raw = f.read(r.length)
        assert np.load(io.BytesIO(raw)).shape == (32, 32)
        got.add((r.doc_id, r.dhash, raw))
    assert got == want and index.count() == odd.count()
    assert media.write_tiles(media.media_features(media.text_media(none))).count() == 0


def test_clashing_names(odd):
    rows = media.text_media(odd).selectExpr("*", "'x' as tile", "1 as samples", "2 as Height", "3 as width", "4 as dhash", "5 as media_error")
    got = media.media_features(rows)
    assert got.columns == ["doc_id", "n_bytes", "media", "samples", "height", "width", "tile", "dhash", "media_error"]
    assert got.filter("media_error is null and dhash is not null").count() == odd.count()
