"""Exact n-gram Jaccard self-join by a token-group matrix.

Documents with equal shingle sets collapse to one representative. A representative is indexed by its prefix: the first
|X| - ceil(t |X|) + 1 shingles in one global order (commonest shingles last, else by hash). Two sets of sizes x and y
with a Jaccard similarity of t or more share at least ceil(t (x + y) / (1 + t)) shingles, of which `least_shared` lie in
both prefixes: what the smaller prefix does not cover is too little for the rest.

Similar documents are partitioned into groups: each representative is checked against the leaders (smallest and largest
id) of its prefix shingles' lists, and what links forms a group. The token-group matrix stores each group's union of
prefix shingles, with the range of sizes that hold each. A query document's overlap with a group is at most the number
of its prefix shingles in the union; where that is less than the least that any member of a fitting size would need, the
group stays closed. Of the groups that qualify, members that reach the same bound themselves are checked on their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, drop_table, finished, marked, materialize, shuffle_partitions, slices
from .components import connected_components

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of up to so many bytes are hashed 8 bytes at a time over all words at once, longer ones one by one.
SHORT = 64
MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased), and how many each text has."""
    low = LOWER[np.frombuffer(b" " + b" ".join(texts) + b" " + bytes(8), np.uint8)]
    space = SPACE[low[:-8]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, length = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))  # the 8 bytes from each place on
    words = mix(length.astype(np.uint64) + np.uint64((seed << 32) + 1))
    for at in range(0, SHORT, 8):
        own = np.flatnonzero(length > at) if at else slice(None)
        if at and not len(own):
            break
        part = eight[start[own] + at] & MASK[np.minimum(length[own] - at, 8)]
        words[own] = mix(words[own] ^ part)
    for i in np.flatnonzero(length > SHORT).tolist():
        raw = low[start[i] : start[i] + length[i]].tobytes()
        words[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(start, ends, "right"), prepend=0)


def shingle_sets(texts: list[bytes], k: int, seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; fewer words: the whole sequence as one; none: empty."""
    words, counts = word_hashes(texts, seed)
    n = max(0, len(words) - k + 1)
    rolled = mix(words[:n])
    for i in range(1, k):
        rolled = mix(rolled + words[i : n + i])
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(rolled[at : at + c - k + 1]))
        elif c:
            h = mix(np.full(1, c, np.uint64))
            for w in words[at : at + c]:
                h = mix(h + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def encoded(column: pa.Array) -> list[bytes]:
    return [t.encode() for t in column.to_pylist()]


def common_shingles(texts: DataFrame, k: int, most: int, least: int = 2) -> np.ndarray:
    """Up to `most` of the commonest shingles over all documents, those in `least` different texts of some block; sorted.

    They only set the global order, in which they come last: any choice is right, a good one keeps lists short.
    """

    def count(batches):
        for batch in batches:
            for part in slices(batch, 0, size=4 * BLOCK):  # the wider the stretch, the more shingles show that they repeat
                sets = []
                for piece in slices(part, 0):
                    sets += shingle_sets(list(dict.fromkeys(encoded(piece.column(0)))), k)
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                h, n = h[n >= least], n[n >= least]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counted = texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.col("n").desc(), "h").limit(most).select("h").toArrow()  # at most `most` numbers
    return np.sort(top["h"].to_numpy().view(np.uint64))


def describe(docs: DataFrame, k: int, num: int, den: int, hot) -> DataFrame:
    """id, n (set size), digest of the set, prefix (packed 64-bit shingles in global order)."""

    def run(batches):
        last = hot.value
        for batch in batches:
            for part in slices(batch, 1):
                n, digest, prefix = [], [], []
                for s in shingle_sets(encoded(part.column(1)), k):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    p = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    if len(last) and len(s):
                        at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                        common = last[at] == s
                        s = np.concatenate([s[~common], s[common]])
                    prefix.append(s[:p].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.binary())], names=["id", "n", "digest", "prefix"])

    return docs.mapInArrow(run, "id long, n long, digest binary, prefix binary")


POSTING = "token long, id long, n long"


def shared_postings(reps: DataFrame, hot, buckets: int) -> DataFrame:
    """(token, id, n) of the prefix shingles that two representatives or more hold; a token is a shingle's bucket and 32-bit tag.

    Most shingles stand in one prefix only and need not travel: postings go to their bucket as about 6 bytes in packed
    blocks, are counted there bucket by bucket, and only repeated ones come out as rows. The commonest shingles (`hot`)
    are known to repeat and aren't counted, so that a bucket holds no long list; their blocks are dealt by chance.
    Shingles that share a token cost a look and change nothing.
    """

    def block(bucket, who, ids, sizes, tokens, kind):
        own, short = np.unique(who, return_inverse=True)
        return bucket, ids[own].astype("<i8").tobytes(), sizes[own].astype("<i8").tobytes(), short.astype("<u4").tobytes(), tokens.astype(kind).tobytes()

    def deal(batches):
        last = hot.value
        for batch in batches:
            for part in slices(batch, 2, size=4 * BLOCK):
                packed = part.column(2).to_pylist()
                token = np.frombuffer(b"".join(packed), "<u8")
                if not len(token):
                    continue
                who = np.repeat(np.arange(len(packed)), [len(p) // 8 for p in packed])
                ids, sizes = part.column(0).to_numpy(), part.column(1).to_numpy()
                known = last[np.minimum(np.searchsorted(last, token), len(last) - 1)] == token if len(last) else np.zeros(len(token), bool)
                m = mix(token)
                bucket, tag = ((m & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64), (m >> np.uint64(32)).astype(np.int64)
                out = []
                if known.any():
                    out.append(block(-1 - int(ids[0]) % buckets, who[known], ids, sizes, (bucket << 32 | tag)[known], "<i8"))
                rare = np.flatnonzero(~known)
                rare = rare[np.argsort(bucket[rare], kind="stable")]
                cuts = np.flatnonzero(np.diff(bucket[rare], prepend=-1))
                for x, y in zip(cuts, np.append(cuts[1:], len(rare)), strict=True):
                    at = rare[x:y]
                    out.append(block(int(bucket[at[0]]), who[at], ids, sizes, tag[at], "<u4"))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "ids", "sizes", "docs", "tokens"])

    def rows(token, ids, sizes):
        for i in range(0, len(token), 100_000):
            cols = (token[i : i + 100_000], ids[i : i + 100_000], sizes[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "id", "n"])

    def counted(bucket, parts):
        tag, ids, sizes = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(tag, kind="stable")
        tag = tag[order]
        same = np.zeros(len(tag) + 1, bool)
        same[1:-1] = tag[1:] == tag[:-1]
        kept = same[1:] | same[:-1]
        yield from rows(np.int64(bucket) << 32 | tag[kept].astype(np.int64), ids[order[kept]], sizes[order[kept]])

    def lists(batches):
        now, parts = None, []
        for batch in batches:
            for bucket, ids, sizes, docs, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs = np.frombuffer(docs, "<u4")
                ids, sizes = np.frombuffer(ids, "<i8")[docs], np.frombuffer(sizes, "<i8")[docs]
                if bucket < 0:
                    yield from rows(np.frombuffer(tokens, "<i8"), ids, sizes)
                    continue
                if bucket != now and parts:
                    yield from counted(now, parts)
                    parts = []
                now = bucket
                parts.append((np.frombuffer(tokens, "<u4"), ids, sizes))
        if parts:
            yield from counted(now, parts)

    dealt = reps.select("id", "n", "prefix").mapInArrow(deal, "bucket long, ids binary, sizes binary, docs binary, tokens binary")
    return dealt.repartition(shuffle_partitions(reps.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(lists, POSTING)


def verified(pairs: DataFrame, rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The (a, b) pairs whose shingle sets reach the similarity, as a written table; checked on the whole texts with hashes of another seed.

    Of the (id, text) rows those of a pair, and few others, get further than where they are read.
    """
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-ids", pairs)
    texts = materialize(marked(rows, "id", ids, "met").filter("met").drop("met").join(ids, "id"), "jaccard-texts", rows)
    drop_table(ids)
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    both_texts = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2, 3):
                left, right = encoded(part.column(2)), encoded(part.column(3))
                new = list(dict.fromkeys([*left, *right]))
                known = dict(zip(new, shingle_sets(new, k, seed=1), strict=True))
                keep = []
                for i, (x, y) in enumerate(zip(left, right, strict=True)):
                    x, y = known[x], known[y]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and den * both >= num * (len(x) + len(y) - both):
                        keep.append(i)
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], names=["a", "b"])

    links = materialize(both_texts.mapInArrow(run, "a long, b long"), "jaccard-links", pairs, texts)
    drop_table(texts)
    return links


def up(a, b: int):
    """a / b rounded up, of columns (exact for numbers of shingles, far below 2 ** 53) or of numbers."""
    return F.ceil(a / b) if isinstance(a, Column) else -(-a // b)


def least_shared(x, y, num: int, den: int):
    """How many shingles the prefixes of sets of x and y shingles share at least, if the sets' similarity is num / den or more."""
    greatest = F.greatest if isinstance(x, Column) else np.maximum
    return up((x + y) * num, num + den) - greatest(up(x * num, den), up(y * num, den)) + 1


def fits(x: Column, y: Column, num: int, den: int) -> Column:
    """Whether sets of x and y shingles can be that similar."""
    return F.least(x, y) * den >= F.greatest(x, y) * num


def leader_pairs(listed: DataFrame, reps: DataFrame, leaders: int, num: int, den: int) -> DataFrame:
    """(a, b) of representatives and the leaders that they meet most often, as far as their prefixes share enough shingles."""
    sizes = reps.select(F.col("id").alias("leader"), F.col("n").alias("leader_n"))
    star = listed.select("id", "n", F.explode(F.array_distinct(F.array("low", "high"))).alias("leader")).filter("id <> leader")
    star = star.groupBy("id", "n", "leader").agg(F.count("*").alias("c")).join(sizes, "leader").filter(fits(F.col("n"), F.col("leader_n"), num, den))
    best = star.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "leader")), asc=False), 1, leaders).alias("best"))  # a document's own lists
    met = listed.select("token", "id", "n").join(best.select("id", F.explode("best.leader").alias("leader")), "id")
    held = listed.select("token", F.col("id").alias("leader"), F.col("n").alias("leader_n"))
    shared = met.join(held, ["token", "leader"]).groupBy("id", "n", "leader", "leader_n").agg(F.count("*").alias("shared"))
    enough = shared.filter(F.col("shared") >= least_shared(F.col("n"), F.col("leader_n"), num, den))
    return enough.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def group_matrix(labelled: DataFrame) -> DataFrame:
    """(token, group, low, high): every group's union of prefix shingles, with the sizes of its members that hold each."""
    return labelled.groupBy("token", "group").agg(F.min("n").alias("low"), F.max("n").alias("high"))


def reached(queries: DataFrame, unions: DataFrame, on: list[str], part: Column, num: int, den: int, below: bool) -> DataFrame:
    """(id, n, target) of every query and target that share enough shingles.

    Queries are (on, id, n, own) rows, a row for each shingle, and unions (on, target, low, high) rows: the sizes of what
    holds the shingle there. A target is reached if the query shares as many shingles with it as the least that any set
    of a fitting size in its range would need; the least is smallest at an end of the fitting sizes, as it grows with a
    set's size up to the query's and falls beyond it. With `below`, targets are smaller numbers than the query's own.

    A shingle's targets travel packed, one row for each value of `part`, so that a query meets rows by its shingles and
    not by their holders; a task adds up one query against one part at a time.
    """
    packed = unions.withColumn("part", part).groupBy(*on, "part").agg(*(F.collect_list(c).alias(c) for c in ("target", "low", "high")))
    met = queries.select(*on, "id", "n", "own").join(packed, on).select("id", "n", "own", "part", "target", "low", "high")

    def added(found):
        """What was met, each target once: how often, and its range of sizes."""
        target, low, high, count = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(target, kind="stable")
        target = target[order]
        first = np.flatnonzero(np.diff(target, prepend=target[0] - 1))
        return target[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.add.reduceat(count[order], first)

    def enough(head, found):
        id_, n, own, _ = head
        target, low, high, count = added(found)
        low, high = np.maximum(low, up(n * num, den)), np.minimum(high, n * den // num)
        ok = (low <= high) & (count >= np.minimum(least_shared(n, low, num, den), least_shared(n, high, num, den)))
        ok &= target < own if below else target != id_
        return [np.full(int(ok.sum()), id_), np.full(int(ok.sum()), n), target[ok]]

    def run(batches):
        head, found, held, out, size = None, [], 0, [], 0
        for batch in batches:
            ends = [batch.column(c).offsets.to_numpy() for c in (4, 5, 6)]
            values = [batch.column(c).values.to_numpy() for c in (4, 5, 6)]
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if key != head:
                    if head:
                        out.append(enough(head, found))
                        size += len(out[-1][0])
                    head, found, held = key, [], 0
                own = [v[e[i] : e[i + 1]] for v, e in zip(values, ends, strict=True)]
                found.append((*own, np.ones(len(own[0]), np.int64)))
                held += len(own[0])
                if held > 1 << 20:
                    found, held = [added(found)], 0
                if size > 50_000 or len(out) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "n", "target"])
                    out, size = [], 0
        if head:
            out.append(enough(head, found))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "n", "target"])

    key = ["id", "n", "own", "part"]
    dealt = met.repartition(shuffle_partitions(queries.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "id long, n long, target long")


def qualifying(queries: DataFrame, matrix: DataFrame, num: int, den: int, chunk: int = 4096) -> DataFrame:
    """(id, n, group) of every group, of a smaller number than the query's own, whose union holds enough of the query's prefix."""
    longest = matrix.groupBy("token").count().agg(F.max("count")).first()[0] or 1
    part = F.pmod(F.xxhash64("target"), F.lit(-(-longest // chunk)))
    own = queries.withColumn("own", F.col("group"))
    return reached(own, matrix.withColumnRenamed("group", "target"), ["token"], part, num, den, True).withColumnRenamed("target", "group")


def opened_pairs(queries: DataFrame, qualified: DataFrame, groups: DataFrame, num: int, den: int, chunk: int = 4096) -> DataFrame:
    """(a, b) of queries and members of their qualifying groups whose prefixes share as many shingles as their sizes ask for."""
    parts = groups.groupBy(F.col("component").alias("group")).agg(F.ceil(F.count("*") / chunk).alias("parts"))
    members = queries.join(qualified.select("group").distinct(), "group").join(parts, "group", "left")
    members = members.select("token", "group", F.col("id").alias("target"), F.col("n").alias("low"), F.col("n").alias("high"), F.coalesce("parts", F.lit(1)).alias("parts"))
    asking = queries.select("token", "id", "n").join(qualified, ["id", "n"]).withColumn("own", F.col("group"))
    found = reached(asking, members, ["token", "group"], F.pmod(F.xxhash64("target"), F.col("parts")), num, den, False)
    return found.select(F.least("id", "target").alias("a"), F.greatest("id", "target").alias("b")).distinct()


def similar_documents(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", leaders: int = 3, common: int = 1 << 18, seen: dict | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links of similarity num / den or more).

    A document without words has no shingles, links with nothing and is its own component; a null text is an empty one.
    Rows that share an id are one document here, linked where any of their texts is. Rows with a null id come back with
    a null component and link with nothing. An empty table gives no rows. Very long texts are read whole, about a
    megabyte of texts at a time. `docs` may hold further columns of any name; they are not read. `leaders` and `common`
    only set how much is grouped before the exact pass, never what is found. `seen`, if given, gets the numbers of
    query-group pairs met and opened.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hot = spark.sparkContext.broadcast(common_shingles(rows.select("text"), k, common))  # at most `common` numbers
    described = materialize(describe(rows, k, num, den, hot), "jaccard-described", rows)
    reps = described.filter("n > 0 and id is not null").groupBy("digest").agg(F.min(F.struct("id", "n", "prefix")).alias("r"))
    reps = materialize(reps.select("digest", "r.*"), "jaccard-reps", described)
    posted = materialize(shared_postings(reps, hot, 4 * shuffle_partitions(spark)), "jaccard-postings", reps)
    lists = posted.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high")
    listed = materialize(posted.join(lists, "token"), "jaccard-listed", posted)
    drop_table(posted)

    # 1. partition similar documents into groups, by their lists' leaders
    tried = materialize(leader_pairs(listed, reps, leaders, num, den), "jaccard-pairs", listed)
    links = verified(tried, rows, k, num, den)
    groups = connected_components(links)

    # 2. token-group matrix: shingles of one group only can open nothing
    labelled = listed.select("token", "id", "n").join(groups, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    matrix = materialize(group_matrix(labelled), "jaccard-matrix", listed)
    several = matrix.groupBy("token").agg(F.min("group").alias("one"), F.max("group").alias("two")).filter("one <> two").select("token")
    queries = materialize(labelled.join(several, "token"), "jaccard-queries", listed)
    drop_table(listed)
    qualified = materialize(qualifying(queries, matrix.join(several, "token"), num, den), "jaccard-qualified", queries, matrix)

    # 3. open the groups that qualify
    new = materialize(opened_pairs(queries, qualified, groups, num, den).join(tried, ["a", "b"], "left_anti"), "jaccard-pairs", queries, qualified)
    if seen is not None:
        met = queries.alias("q").join(matrix.alias("m"), "token").filter("q.group > m.group").select("id", "m.group").distinct().count()
        seen.update(met=met, opened=qualified.count(), pairs=new.count(), tried=tried.count())
    drop_table(matrix, queries, qualified, tried)
    more = verified(new, rows, k, num, den)
    drop_table(new)
    # rows that share an id tie their sets' representatives together
    named = described.filter("id is not null").select("id", "digest", F.xxhash64("digest").alias("h"))
    shared = materialize(named.groupBy("id").agg(F.min("h").alias("one"), F.max("h").alias("two")).filter("one <> two").select("id"), "jaccard-shared-ids", described)
    tied = named.join(shared, "id").join(reps.select("digest", F.col("id").alias("rep")), "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    tied = materialize(tied, "jaccard-tied", shared, reps)
    parts = connected_components(links.union(more).union(tied))

    # representatives carry their component to all documents with the same set
    found = reps.select("digest", "id").join(parts, "id", "left").select("digest", F.coalesce("component", "id").alias("by_set"))
    ids = shared.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("by_id"))
    result = described.join(found, "digest", "left").join(ids, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("by_id", "by_set", "id")).alias("component_id")
    )
    return finished(result, "jaccard-result", described, reps, links, more, tied, groups, shared, parts)
