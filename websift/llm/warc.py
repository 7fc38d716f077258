"""WARC archives: records written with an index beside them, and read back by coalesced byte ranges.

Each task writes one archive of gzip members, one member per record, and returns the index rows of what it wrote
(file, offset, length, url, digest). The index is committed as a table by Spark, and names the file of the attempt that
succeeded: a lost executor costs a second archive and no row. Readers take the selected index rows sorted by place, join
ranges that nearly touch, and read each joined range once.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fresh_path, materialize, slices

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: A record's name carries the page's id, as there is nothing else to look it up by.
NAME = "urn:websift:page:"
DATE = "1970-01-01T00:00:00Z"
GAP, RANGE = 64 << 10, 8 << 20


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, response or (if it refers to another) revisit; a revisit's block has no payload, but its header tells the length."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; its payload is None for a revisit. Raises ValueError where lengths or digest don't hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("no WARC record")
    field = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(field["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    payload = None if field["warc-type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload's digest is wrong")
    of = lambda key: int(n) if (n := field.get(key, "").strip("<>").removeprefix(NAME)) else None
    return {"page_id": of("warc-record-id"), "url": field.get("warc-target-uri", ""), "payload_bytes": int(field["warc-payload-length"]), "payload_digest": digest, "record_type": field["warc-type"], "refers_to": of("warc-refers-to"), "payload": payload}


def revisits(pages: DataFrame, least: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, payload, digest and refers_to (null for a response): of equal payloads of `least` bytes, all but the largest id revisit it.

    Payloads are equal where their digest, length and a second hash are, as SHA-1 alone can be made to collide. Only
    those that occur twice go into the join, as a written table, so that the planner knows their size and can split a hot
    payload's side.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), as_bytes(html_col).alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= least
    rows = rows.withColumn("key", F.when(large, F.concat_ws(":", "digest", F.length("payload"), F.xxhash64("payload"))))
    twice = rows.filter("key is not null").groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n")
    twice = materialize(twice, "warc-digests", pages)
    return (
        rows.join(twice, "key", "left")
        .withColumn("refers_to", F.when(~F.coalesce(F.col("page_id") == F.col("response"), F.lit(False)), F.col("response")))
        .select("page_id", "url", "payload", "digest", "refers_to")
    )


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 3) -> DataFrame:
    """Write one record per row and return the index, one row per record, as a written table.

    Null payloads and urls are empty; rows with the same id are records of their own (of equal large payloads, every row
    with the largest id is a response); null ids revisit the largest id, and respond where all ids are null. An empty
    table writes nothing. Other columns are not read, whatever their names. Very long payloads are records like any other.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        sink, at = None, 0
        for batch in (part for b in batches for part in slices(b, 2)):
            out = []
            for r in batch.to_pylist():
                data = gzip.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"]), level, mtime=0)
                sink = sink or store.open_output_stream(f"{root}/{name}", compression=None)
                sink.write(data)
                out.append({"page_id": r["page_id"], "url": r["url"], "file": name, "offset": at, "length": len(data), "payload_digest": r["digest"], "record_type": "response" if r["refers_to"] is None else "revisit"})
                at += len(data)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=ARROW_INDEX)
        if sink:
            sink.close()

    index = materialize(revisits(pages, least, id_col, url_col, html_col).mapInArrow(run, INDEX), "warc-index")
    return index.withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


ARROW_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())])
ARROW_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_records(index: DataFrame) -> DataFrame:
    """Read the records that the index rows name, whichever were selected; payload is null for revisits.

    Rows are dealt by file and 64 MB stretch and sorted by offset; ranges up to 64 KB apart are read as one, of 8 MB at most
    unless a single record is larger.
    """

    def ranges(rows):
        held, file, start, stop = [], None, 0, 0
        for r in rows:
            end = r["offset"] + r["length"]
            if held and (r["file"] != file or r["offset"] > stop + GAP or end - start > RANGE):
                yield file, start, stop, held
                held = []
            if not held:
                file, start, stop = r["file"], r["offset"], end
            held.append(r)
            stop = max(stop, end)
        if held:
            yield file, start, stop, held

    def run(batches):
        name, source, out, size = None, None, [], 0
        for file, start, stop, held in ranges(r for b in batches for r in b.to_pylist()):
            if file != name:
                if source:
                    source.close()
                store, path = pafs.FileSystem.from_uri(file)
                name, source = file, store.open_input_file(path)
            data = source.read_at(stop - start, start)
            for r in held:
                at = r["offset"] - start
                out.append(parse(zlib.decompress(data[at : at + r["length"]], 31)))
                size += len(out[-1]["payload"] or b"")
                if size > RANGE or len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=ARROW_READ)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=ARROW_READ)
        if source:
            source.close()

    picked = index.select("file", "offset", "length")
    dealt = picked.repartition("file", F.floor(F.col("offset") / (64 << 20))).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, READ)
