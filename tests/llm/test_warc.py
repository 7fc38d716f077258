import gzip
import hashlib

from websift.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload int")


def expected(rows):
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        same = [j for j, _, h, *_ in rows if (h or "").encode() == data and j is not None]
        top = max(same, default=None) if len(data) >= 1000 else None
        refers = top if top is not None and i != top else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    big, tricky = "é" * 600, "line\r\n\r\nWARC/1.1\r\n\r\n" * 80
    rows = [(1, "http://a/", big, "x", 1), (2, "http://b/", big, "x", 1), (2, "http://b/", big, "x", 1), (3, None, None, None, 1), (4, "u v\nw", "", "", 1), (5, "s", "small", "", 1),
            (6, "s", "small", "", 1), (7, "t", tricky, "", 1), (None, "n", big, "", 1), (8, "long", "z" * 300_000, "", 1), (9, "long", "z" * 300_000, "", 1)]
    index = warc.write_archives(pages(spark, rows).repartition(3))
    got = warc.read_records(index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert warc.read_records(index.filter("page_id = 7")).first().payload.decode() == tricky
    one = index.filter("page_id = 5").first()
    with open(one.file.removeprefix("file://"), "rb") as f:
        f.seek(one.offset)
        assert gzip.decompress(f.read(one.length)).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_empty(spark):
    assert warc.read_records(warc.write_archives(pages(spark, []))).count() == 0
