"""Suffix-array removal of repeated byte strings.

Every window of `length` bytes belongs to the run of windows that share its minimizer (the least hash among its
k-byte strings): equal windows have equal minimizers, so only runs whose minimizer occurs again can hold a repeat. Those
runs go to shards by minimizer. A shard's runs are laid end to end and get a suffix array by induced sorting; permuted
common prefixes then tell which windows are equal, and all but the first (by document, then start) are removed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, as_bytes, drop_table, materialize, shuffle_partitions, sized, slices
from .jaccard import mix

SHARD = 1 << 20


# -- suffix arrays ---------------------------------------------------------------------------------------------------


def ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, ... size[0] of them, then those of the next range."""
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())


def smaller(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (S-type); the last one, the sentinel, is."""
    n = len(t)
    less, differs = np.zeros(n, bool), np.ones(n, bool)
    less[:-1], differs[:-1] = t[:-1] < t[1:], t[:-1] != t[1:]
    less[-1] = True
    at = np.where(differs, np.arange(n), n)
    return less[np.minimum.accumulate(at[::-1])[::-1]]


def spread(sa, at, chars, values, forward) -> None:
    """Put values into their characters' buckets in the order given, moving the buckets' ends."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.diff(c, prepend=-1))
    sizes = np.diff(first, append=len(c))
    rank = np.arange(len(c)) - np.repeat(first, sizes)
    heads = c[first]
    if forward:
        sa[np.repeat(at[heads], sizes) + rank] = values[order]
        at[heads] += sizes
    else:
        sa[np.repeat(at[heads], sizes) - rank] = values[order]
        at[heads] -= sizes


def chained(queue: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """What a bucket's entries put into their own bucket: the places before each in its run of one character, nearest first over all entries."""
    long = runs[queue] > 0
    queue = queue[long]
    size = runs[queue]
    step = ranges(np.ones(len(queue), np.int64), size)
    return (np.repeat(queue, size) - step)[np.argsort(step, kind="stable")]


def induce(t, s_type, runs, lms, starts, stops) -> np.ndarray:
    """Sort all suffixes from leftmost-smaller ones in the order given: larger ones left to right, then smaller ones right to left.

    Buckets are done in stretches: as many as put nothing into one another, so that an alphabet of any size takes few
    steps; a bucket that puts entries into itself is a stretch of its own, and gets those run by run.
    """
    n, k = len(t), len(starts)
    sa = np.full(n, -1, np.int64)
    tail = stops - 1
    spread(sa, tail, t[lms[::-1]], lms[::-1], False)
    seeds = stops - 1 - tail
    head = starts.copy()

    c, width = 0, 64
    while c < k:
        e = min(k, c + width)
        low, size = np.empty(2 * (e - c), np.int64), np.empty(2 * (e - c), np.int64)
        low[::2], low[1::2] = starts[c:e], stops[c:e] - seeds[c:e]
        size[::2], size[1::2] = head[c:e] - starts[c:e], seeds[c:e]
        i = sa[ranges(low, size)]
        j = i - 1
        ok = (i > 0) & ~s_type[j]
        to = t[j[ok]]
        b = int(to.min()) if len(to) else e
        if b <= c:
            more = chained(sa[starts[c] : head[c]], runs)
            sa[head[c] : head[c] + len(more)] = more
            head[c] += len(more)
            j = np.concatenate([sa[starts[c] : head[c]], sa[stops[c] - seeds[c] : stops[c]]]) - 1
            j = j[j >= 0]
            j = j[~s_type[j] & (t[j] != c)]
            b = c + 1
        else:
            b = min(b, e)
            held = int(size[: 2 * (b - c)].sum())
            j = j[:held][ok[:held]]
        if len(j):
            spread(sa, head, t[j], j, True)
        width = 2 * width if b == e else max(8, 2 * (b - c))
        c = b

    tail = stops - 1
    c, width = k - 1, 64
    while c >= 0:
        e = max(-1, c - width)  # buckets c, c - 1, ..., e + 1
        own = np.arange(c, e, -1)
        low, size = np.empty(2 * len(own), np.int64), np.empty(2 * len(own), np.int64)
        low[::2], low[1::2] = tail[own] + 1, starts[own]
        size[::2], size[1::2] = stops[own] - 1 - tail[own], head[own] - starts[own]
        at = np.repeat(low + size - 1 + (np.cumsum(size) - size), size) - np.arange(size.sum())  # each part backwards
        i = sa[at]
        j = i - 1
        ok = (i > 0) & s_type[j]
        to = t[j[ok]]
        b = int(to.max()) if len(to) else e
        if b >= c:
            more = chained(sa[tail[c] + 1 : stops[c]][::-1], runs)
            sa[tail[c] - len(more) + 1 : tail[c] + 1] = more[::-1]
            tail[c] -= len(more)
            j = np.concatenate([sa[tail[c] + 1 : stops[c]][::-1], sa[starts[c] : head[c]][::-1]]) - 1
            j = j[j >= 0]
            j = j[s_type[j] & (t[j] != c)]
            b = c - 1
        else:
            b = max(b, e)
            held = int(size[: 2 * (c - b)].sum())
            j = j[:held][ok[:held]]
        if len(j):
            spread(sa, tail, t[j], j, False)
        width = 2 * width if b == e else max(8, 2 * (c - b))
        c = b
    sa[0] = n - 1
    return sa


def names(t: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """0, 1, ... for the substrings between leftmost-smaller positions, in the order given; equal ones share a name."""
    size = np.zeros(len(t), np.int64)
    size[lms] = np.append(lms[1:], len(t) - 1) + 1 - lms
    size = size[ordered]
    same = np.zeros(len(ordered), bool)
    pairs = np.flatnonzero(size[1:] == size[:-1])
    if len(pairs):
        equal = t[ranges(ordered[pairs], size[pairs])] == t[ranges(ordered[pairs + 1], size[pairs])]
        same[pairs + 1] = np.logical_and.reduceat(equal, np.cumsum(size[pairs]) - size[pairs])
    return np.cumsum(~same) - 1


def suffix_array(t: np.ndarray, levels: list[int] | None = None) -> np.ndarray:
    """Suffix array, by induced sorting at every level, of numbers 0, 1, ... whose last one is 0 and occurs nowhere else.

    `levels`, if given, gets the length of the string at every level.
    """
    n = len(t)
    t = t.astype(np.int64)
    if levels is not None:
        levels.append(n)
    size = np.bincount(t)
    stops = np.cumsum(size)
    starts = stops - size
    s_type = smaller(t)
    place = np.arange(n)
    runs = place - np.maximum.accumulate(np.where(np.diff(t, prepend=-1) != 0, place, 0))  # how many equal characters stand before
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        sa = induce(t, s_type, runs, lms, starts, stops)
        ordered = sa[is_lms[sa]]
        ids = names(t, ordered, lms)
        if ids[-1] == len(lms) - 1:
            lms = ordered
        else:
            reduced = np.zeros(n, np.int64)
            reduced[ordered] = ids
            lms = lms[suffix_array(reduced[lms], levels)]
    return induce(t, s_type, runs, lms, starts, stops)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position in text order, the common prefix of its suffix with the one before it in the suffix array.

    Only positions whose left neighbours differ (irreducible ones) are compared; the next ones have one less each.
    """
    n = len(t)
    before = np.zeros(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n - 1
    position = np.arange(n)
    plain = (position == 0) | (before == 0)
    plain[1:] |= t[position[1:] - 1] != t[before[1:] - 1]
    plain[sa[0]] = True
    wide = np.concatenate([t.astype(np.uint64), np.zeros(8, np.uint64)])
    four = wide[:-3] | (wide[1:-2] << np.uint64(16)) | (wide[2:-1] << np.uint64(32)) | (wide[3:] << np.uint64(48))
    lcp = np.zeros(n, np.int64)
    active = np.flatnonzero(plain & (position != sa[0]))
    a, b = active.copy(), before[active]
    while len(active):
        same = (four[a] == four[b]) & (np.maximum(a, b) + 4 <= n)
        done = ~same
        x, y, who = a[done], b[done], active[done]
        for _ in range(4):
            ok = (np.maximum(x, y) < n) & (wide[x] == wide[y])
            lcp[who[ok]] += 1
            x, y, who = x[ok] + 1, y[ok] + 1, who[ok]
        active = active[same]
        lcp[active] += 4
        a, b = a[same] + 4, b[same] + 4
    reach = np.maximum.accumulate(np.where(plain, lcp + position, -1))
    return np.maximum(reach - position, 0)


def repeats(pieces: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, start) of every window of `length` bytes in the pieces that equals one with a smaller (id, start)."""
    sizes = np.array([len(p) for p in pieces])
    laid = np.frombuffer(b"\0".join(pieces) + b"\0\0", np.uint8).astype(np.uint16) + 2
    at = np.cumsum(sizes + 1) - sizes - 1
    laid[at + sizes] = 1
    laid[-1] = 0
    sa = suffix_array(laid)
    lcp = permuted_prefixes(laid, sa)[sa]
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    piece = np.append(piece, len(pieces) - 1)
    offset = np.arange(len(laid)) - at[piece]
    left = sizes[piece] - offset
    group = np.cumsum(lcp < length)
    fits = left[sa] >= length
    where, group = sa[fits], group[fits]
    many = np.zeros(len(group), bool)
    again = group[1:] == group[:-1]
    many[1:] |= again
    many[:-1] |= again
    where, group = where[many], group[many]
    who, start = ids[piece[where]], starts[piece[where]] + offset[where]
    order = np.lexsort((start, who, group))
    who, start, group = who[order], start[order], group[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    top = np.repeat(first, np.diff(first, append=len(group)))
    later = (who != who[top]) | (start != start[top])
    return who[later], start[later]


def as_runs(who: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, start, count) of maximal runs of neighbouring windows."""
    order = np.lexsort((start, who))
    who, start = who[order], start[order]
    cut = np.ones(len(who), bool)
    cut[1:] = (who[1:] != who[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(who))[: len(first)] - 1
    return who[first], start[first], start[last] - start[first] + 1


# -- runs of windows with one minimizer ------------------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2 ** 64."""
    both = (BASE, pow(BASE, -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in both)


#: The value of each byte in a string's hash: any fixed 64-bit numbers do, as equal hashes only cost a look.
VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def stretches(texts: list[bytes], length: int, size: int = BLOCK):
    """(text numbers, offsets, parts): texts cut into parts of about `size` bytes whose windows of `length` bytes are all of the text's, a list for each `size`."""
    held, total = ([], [], []), 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), size):
            part = text if len(text) <= size else text[at : at + size + length - 1]
            for out, x in zip(held, (i, at, part), strict=True):
                out.append(x)
            total += len(part)
            if total >= size:
                yield held
                held, total = ([], [], []), 0
            if part is text:
                break
    if held[0]:
        yield held


def runs_of(texts: list[bytes], length: int, k: int):
    """Runs of windows with one minimizer: text number, start, number of windows, minimizer, and whether it occurs in the run twice."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data) - length + 1
    if n <= 0:
        return none
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    up, down = (p[: len(data) + 1] for p in powers(max(len(data) + 1, 2 * BLOCK + 4 * length)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[data] * up[: len(data)])])
    h = mix((total[k:] - total[: len(data) - k + 1]) * down[: len(data) - k + 1])
    del total
    w = length - k + 1
    least, span = h, 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: n], least[w - span : w - span + n])
    doc = np.repeat(np.arange(len(texts)), sizes)
    valid = doc[:n] == doc[length - 1 :]
    cut = np.ones(n, bool)
    cut[1:] = (least[1:] != least[:-1]) | (doc[1:n] != doc[: n - 1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    met = np.concatenate([[0], np.cumsum(h[:n] == least)])
    return doc[first], first - begin[doc[first]], last - first + 1, least[first], met[last] > met[first]


def tags(minimizers: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A minimizer's bucket and 32-bit tag in it: a tag that two minimizers share costs a look and changes nothing."""
    m = mix(minimizers)
    return (m & np.uint64(0xFFFFFFFF)) % np.uint64(buckets), (m >> np.uint64(32)).astype(np.uint32)


def repeated_tags(docs: DataFrame, length: int, k: int, buckets: int, crowd: int) -> DataFrame:
    """(id, tag, crowded) of every run whose minimizer occurs again anywhere, or twice in the run; crowded: over `crowd` times.

    A run travels as 6 bytes in packed blocks, one block per stretch of texts and bucket; a task counts bucket by bucket.
    """

    def deal(batches):
        for batch in batches:
            for part in slices(batch, 1):
                ids = part.column(0).to_numpy()
                for rows, _, texts in stretches(part.column(1).to_pylist(), length):
                    rows = np.array(rows)
                    doc, _, _, m, twice = runs_of(texts, length, k)
                    if not len(doc):
                        continue
                    who, m = ids[rows[np.concatenate([doc, doc[twice]])]], np.concatenate([m, m[twice]])
                    bucket, tag = tags(m, buckets)
                    order = np.argsort(bucket, kind="stable")
                    bucket, tag, who = bucket[order].astype(np.int64), tag[order], who[order]
                    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                    ends = np.append(cuts[1:], len(bucket))
                    out = []
                    for x, y in zip(cuts, ends, strict=True):
                        own, short = np.unique(who[x:y], return_inverse=True)
                        out.append((own.astype("<i8").tobytes(), short.astype("<u2" if len(own) <= 1 << 16 else "<u4").tobytes(), tag[x:y].astype("<u4").tobytes()))
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *(pa.array(col, pa.binary()) for col in cols)], names=["bucket", "ids", "docs", "tags"])

    def counted(bucket, parts):
        ids, tag = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(tag)
        ids, tag = ids[order], tag[order]
        first = np.flatnonzero(np.diff(tag.astype(np.int64), prepend=-1))
        size = np.diff(first, append=len(tag))
        times = np.repeat(size, size)
        keep = np.flatnonzero(times > 1)
        for i in range(0, len(keep), 200_000):
            at = keep[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array((np.int64(bucket) << 32) | tag[at].astype(np.int64)), pa.array(times[at] > crowd)], names=["id", "tag", "crowded"])

    def count(batches):
        now, parts = None, []
        for batch in batches:
            for bucket, ids, docs_, tags_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if parts:
                        yield from counted(now, parts)
                    now, parts = bucket, []
                own, tag = np.frombuffer(ids, "<i8"), np.frombuffer(tags_, "<u4")
                parts.append((own[np.frombuffer(docs_, "<u2" if len(own) <= 1 << 16 else "<u4")], tag))
        if parts:
            yield from counted(now, parts)

    parts = shuffle_partitions(docs.sparkSession)
    dealt = docs.mapInArrow(deal, "bucket long, ids binary, docs binary, tags binary")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "id long, tag long, crowded boolean")


PIECES = "shard long, id long, start long, n long, twice boolean, content binary"


def cut_pieces(rows: DataFrame, length: int, k: int, buckets: int) -> DataFrame:
    """The bytes of every run with a repeated tag, once per batch: (shard, id, start, n windows, twice, content).

    Rows are (id, data, tags, crowded tags). Of equal runs in a batch the first (id, start) is sent; the others come
    back without content: all their windows are repeats. A crowded tag's runs are sent window by window, each to the
    shard of its own bytes, so that a passage in any number of surroundings spreads over all shards.
    """

    def pieces(ids, known_tags, crowded_tags, rows, offsets, texts):
        doc, start, n, m, twice = runs_of(texts, length, k)
        bucket, tag = tags(m, buckets)
        full = (bucket.astype(np.int64) << 32) | tag.astype(np.int64)
        known, crowd = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        for d, row in enumerate(rows):
            x, y = ends[d], ends[d + 1]
            if x < y:
                known[x:y] = np.isin(full[x:y], np.array(known_tags[row], np.int64))
                if crowded_tags[row]:
                    crowd[x:y] = np.isin(full[x:y], np.array(crowded_tags[row], np.int64))
        at = np.flatnonzero(known)
        own = ids[np.array(rows)[doc[at]]]
        place = start + np.array(offsets)[doc]
        order = np.lexsort((place[at], own))
        at, own = at[order], own[order]
        seen: dict[bytes, tuple] = {}
        windows: dict[bytes, tuple] = {}
        out = []
        for i, who in zip(at.tolist(), own.tolist(), strict=True):
            s, c, at_ = int(start[i]), int(n[i]), int(place[i])
            content = texts[doc[i]][s : s + c + length - 1]
            if content in seen:
                if seen[content] != (who, at_):
                    out.append((None, who, at_, c, False, None))
                continue
            seen[content] = (who, at_)
            if not crowd[i]:
                out.append((int(full[i]), who, at_, c, bool(twice[i]), content))
                continue
            for o in range(c):
                window = content[o : o + length]
                if window in windows:
                    if windows[window] != (who, at_ + o):
                        out.append((None, who, at_ + o, 1, False, None))
                else:
                    windows[window] = (who, at_ + o)
                    out.append((-1 - (hash_of(window) >> 1), who, at_ + o, 1, False, window))
        return out

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                ids = part.column(0).to_numpy()
                known, crowded = part.column(2).to_pylist(), part.column(3).to_pylist()
                for rows_, offsets, texts in stretches(part.column(1).to_pylist(), length):
                    out = pieces(ids, known, crowded, rows_, offsets, texts)
                    if out:
                        cols = list(zip(*out, strict=True))
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return rows.mapInArrow(run, PIECES)


def hash_of(data: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


SPANS = "id long, start long, n long"


def solve_shards(pieces: DataFrame, length: int) -> DataFrame:
    """(id, start, n) runs of windows that repeat an earlier one, shard by shard.

    A task reads its shards in order, holds one shard's distinct pieces, and builds suffix arrays over about a megabyte
    of whole shards at a time; a shard with a single piece that holds its minimizer once has nothing to compare.
    """

    def spans(who, start, n):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (who, start, n)], names=["id", "start", "n"])

    def solved(laid):
        ids, starts = np.array([x[1] for x in laid]), np.array([x[2] for x in laid])
        who, start = repeats([x[0] for x in laid], ids, starts, length)
        if len(who):
            yield spans(*as_runs(who, start))

    def run(batches):
        now, own, gone, laid, size = None, {}, [], [], 0
        for shard, who, start, n, twice, content in (row for batch in batches for part in slices(batch, 5) for row in [*zip(*(c.to_pylist() for c in part.columns), strict=True)]):
            if shard != now:
                if len(own) > 1 or own and next(iter(own.values()))[3]:
                    laid += [(c, *x[:2]) for c, x in own.items()]
                    size += sum(map(len, own)) + len(own)
                if size > SHARD:
                    yield from solved(laid)
                    laid, size = [], 0
                if len(gone) > 50_000:
                    yield spans(*zip(*gone, strict=True))
                    gone = []
                now, own = shard, {}
            held = own.get(content)
            if held is None:
                own[content] = (who, start, n, twice)
            elif (who, start) < held[:2]:
                gone.append((held[0], held[1], n))
                own[content] = (who, start, n, twice)
            elif (who, start) > held[:2]:
                gone.append((who, start, n))
        if len(own) > 1 or own and next(iter(own.values()))[3]:
            laid += [(c, *x[:2]) for c, x in own.items()]
        if laid:
            yield from solved(laid)
        if gone:
            yield spans(*zip(*gone, strict=True))

    parts = shuffle_partitions(pieces.sparkSession)
    return pieces.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(run, SPANS)


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", crowd: int = 1000) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts earlier: id, n_bytes, n_removed, n_spans, kept (binary).

    Earlier means a smaller id, or the same id and a smaller start; overlaps count, strings never cross documents, and
    all are judged on the input. Null texts are empty. Rows with the same id count as one document: what starts at
    the same place in both doesn't remove itself, and what goes from one goes from the other. Rows with a null id are
    left as they are and remove nothing. An empty table gives no rows. Very long texts are cut into overlapping
    stretches of a megabyte that hold all their windows. Later copies of a whole text (equal in length and by two digests) go at
    once, without being cut into pieces, where their id holds no other text. `docs` may hold further columns of any name; they are not read.
    """
    spark = docs.sparkSession
    k = max(1, length * 48 // 100)
    buckets = 8 * shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("data"))
    named = rows.filter("id is not null")
    key = F.unhex(F.concat(F.md5("data"), F.sha1("data")))
    whole = materialize(named.filter(F.length("data") >= length).select("id", key.alias("key"), F.length("data").alias("size")), "suffix-keys")
    first = materialize(whole.groupBy("key", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "suffix-first", whole)
    told = materialize(whole.join(first, ["key", "size"], "left").select("id", "size", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("copy")), "suffix-copies", whole)
    copies = told.filter("copy").select("id", F.lit(0).cast("long").alias("start"), (F.col("size") - length + 1).cast("long").alias("n"))
    only_copies = told.groupBy("id").agg(F.every("copy").alias("copy")).filter("copy").select("id")  # an id may hold a copy and another text

    tagged = repeated_tags(named, length, k, buckets, crowd).distinct()
    tagged = tagged.groupBy("id").agg(F.collect_list("tag").alias("tags"), F.array_compact(F.collect_list(F.when(F.col("crowded"), F.col("tag")))).alias("crowded"))  # a document's own runs
    tagged = materialize(tagged.join(only_copies, "id", "left_anti"), "suffix-tags", named)
    pieces = materialize(cut_pieces(named.join(tagged, "id").select("id", "data", "tags", "crowded"), length, k, buckets), "suffix-pieces", named)
    spans = pieces.filter("content is null").select("id", "start", "n").union(solve_shards(pieces.filter("content is not null"), length)).union(copies)
    spans = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"))  # a document's own spans
    spans = materialize(spans, "suffix-spans", pieces)
    drop_table(whole, first, told, tagged, pieces)

    def cut(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            data, found = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            removed, runs, kept = [], [], []
            for text, own in zip(data, found, strict=True):
                parts, at, n, gone = [], 0, 0, 0
                for s in own or []:
                    start, stop = min(s["start"], len(text)), min(s["start"] + s["n"] + length - 1, len(text))
                    if stop <= at:
                        continue
                    if start > at or at == 0 and not n:
                        parts.append(text[at:start])
                        n += 1
                    gone += stop - max(start, at)
                    at = stop
                kept.append(b"".join([*parts, text[at:]]) if own else text)
                removed.append(gone)
                runs.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in data], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    whole = rows.join(spans, "id", "left").select("id", "data", "spans")
    return sized(whole, rows).mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)
