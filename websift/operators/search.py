"""Grounded question answering: passages, an inverted index, BM25 and the refusal to guess."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.lineage import cut, once
from ..sources import dom

# BM25, bonus and malus, and what an answer must reach.
K1, B = 1.5, 0.75
PHRASE_BONUS, LEGAL_FACTOR = 3.0, 0.5
LEAST_SCORE, ANSWER_SCORE, ANSWER_COVERAGE = 0.5, 1.8, 0.5
LEGAL_URL = ("terms", "privacy", "legal", "policy", "disclaimer", "license")
LEGAL_QUERY = ("term", "privacy", "legal", "refund", "policy", "disclaimer", "license")


def page_passages(pages: DataFrame) -> DataFrame:
    """(seq, pos, url, text): every page's candidate answers, each once a page; the same text on two pages stays two."""
    live = pages.filter((F.col("html") != "") & (F.col("status") < 400)).select("seq", F.col("final_url").alias("url"), "html")
    return dom.parse_pages(live, ("passages",)).select("seq", "url", F.posexplode("passages").alias("pos", "text"))


def passages(rows: DataFrame, *order: str) -> DataFrame:
    """Any (url, text) rows as (url, text, order columns), the first of equal texts of a url by the order."""
    first = F.row_number().over(Window.partitionBy("url", "text").orderBy(*order))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n")


def indexed(docs: DataFrame) -> DataFrame:
    """Add spoken (all words, joined by spaces), content (words without stop words) and length; passages without content are no documents."""
    read = once(docs, "_w", tokens.words("text"))
    read = once(read, "content", tokens.content_words(F.col("_w"))).withColumn("spoken", F.array_join("_w", " ")).drop("_w")
    return read.withColumn("length", F.size("content")).filter("length > 0").select(*docs.columns, "spoken", "content", "length")


def vocabulary_of(docs: DataFrame) -> DataFrame:
    """(word, stem) of every content word: the vocabulary is stemmed once, not the text.

    The words are a table of their own: what is asked of their stems would otherwise be moved below the grouping, to every
    word of the text.
    """
    return tokens.with_stem(cut(docs.select(F.explode("content").alias("word")).distinct(), "vocabulary"), "word")


def postings(docs: DataFrame, id_col: str = "doc_id", vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc, stem, tf, length), of the vocabulary's stems alone if one is given: others go before anything is counted."""
    words = vocabulary_of(docs)
    words = words if vocabulary is None else words.join(vocabulary, "stem", "left_semi")
    rows = docs.select(F.col(id_col).alias("doc"), "length", F.explode("content").alias("word")).join(words, "word")
    return rows.groupBy("doc", "stem").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def stem_counts(docs: DataFrame) -> DataFrame:
    """(stem, n): occurrences over all documents. Words are counted first and the vocabulary is stemmed, not the text."""
    counted = docs.select(F.explode("content").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return tokens.with_stem(counted, "word").groupBy("stem").agg(F.sum("n").alias("n"))


def document_frequencies(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(stem, df): the documents of every stem."""
    rows = docs.select(id_col, F.explode(F.array_distinct("content")).alias("word")).join(vocabulary_of(docs), "word")
    return rows.select(id_col, "stem").distinct().groupBy("stem").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))


def prepared_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query) with tokens, distinct stems, the phrase, and whether it asks about legal matters."""
    q = queries.select("query_id", F.trim("query").alias("query")).withColumn("tokens", tokens.query_tokens("query"))
    return q.select(
        "query_id", "query", "tokens", F.array_distinct(F.transform("tokens", tokens.stem)).alias("stems"), F.array_join("tokens", " ").alias("phrase"),
        F.arrays_overlap("tokens", F.array(*map(F.lit, LEGAL_QUERY))).alias("legal"),
    )


def bm25(tf: Column, length: Column, df: Column, n_docs: Column, avg_length: Column) -> Column:
    idf = F.ln(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * (length / F.greatest(F.lit(1.0), avg_length))))


def scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", url_col: str | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """(query_id, doc, score, coverage, matched) of every document above the least score, for a batch of queries.

    The documents are indexed once, into a written table. Only the batch's own vocabulary is counted: other stems go in
    a semi join as soon as they are exploded, and term counts are combined before they are shuffled; document frequencies
    come from the same counts. Words are looked at again for the phrase bonus only, where it can be had: a phrase that
    stands in a text has all its words there but the first and the last, which may be the end and the start of others.
    Queries are the small side of all joins and are left to the planner, which sees their size.
    """
    named = [F.col(id_col).alias("doc"), *([F.col(url_col).alias("url")] if url_col else [])]
    docs, prepared = cut(indexed(docs).select(*named, "spoken", "content", "length"), "index"), prepared_queries(queries)
    stats = corpus_stats(docs)
    terms = prepared.select("query_id", F.explode("stems").alias("stem"))
    vocabulary = terms.select("stem").distinct()
    hits = postings(docs, "doc", vocabulary)
    frequency = hits.groupBy("stem").agg(F.count("*").alias("df"))
    # one row of corpus figures
    weighted = hits.join(frequency, "stem").crossJoin(F.broadcast(stats)).withColumn("part", bm25(F.col("tf"), F.col("length"), F.col("df"), F.col("n_docs"), F.col("avg_length")))
    summed = weighted.join(terms, "stem").groupBy("query_id", "doc").agg(F.sum("part").alias("base"), F.count("*").alias("matched"))
    asked = prepared.select("query_id", "phrase", "legal", F.size("tokens").alias("n_tokens"), F.size("stems").alias("n_stems"))
    rows = cut(summed.join(asked, "query_id"), "matches")
    may = rows.filter((F.col("n_tokens") >= 2) & (F.col("matched") >= F.col("n_stems") - 2)).select("query_id", "doc", "phrase")
    said = may.join(docs.select("doc", "spoken"), "doc").filter(F.col("spoken").contains(F.col("phrase"))).select("query_id", "doc", F.lit(PHRASE_BONUS).alias("bonus"))
    rows = rows.join(said, ["query_id", "doc"], "left")
    score = F.col("base") + F.coalesce("bonus", F.lit(0.0))
    if url_col:
        rows = rows.join(docs.select("doc", "url"), "doc")
        score = F.when(F.lower("url").rlike("|".join(LEGAL_URL)) & ~F.col("legal"), score * LEGAL_FACTOR).otherwise(score)
    out = rows.select("query_id", "doc", score.alias("score"), (F.col("matched") / F.greatest(F.lit(1), F.col("n_stems"))).alias("coverage"), "matched")
    return out.filter(F.col("score") > least)


def top_k(scored: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Each query's k best documents, ties by document; scores are rounded, as sums of floats depend on their order."""
    rounded = scored.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc"))
    return rounded.withColumn("rank", rank).filter(F.col("rank") <= k)


class Contest:
    """A part of the queries against blocks of documents: what can still be among a query's k best is kept.

    A query is a set of stem numbers. `floor` is its k-th best score so far without bonuses: no better bound than a
    document that is known to reach it. A block's documents are looked at only if the greatest parts of the query's
    stems in the block, with the bonus, add up to the floor.
    """

    def __init__(self, stems: list[np.ndarray], bonus: np.ndarray, legal: np.ndarray, k: int, least: float, slack: float):
        self.stems, self.bonus, self.legal, self.k, self.least, self.slack = stems, bonus, legal, k, least, slack
        self.flat = np.concatenate([*stems, np.zeros(0, np.int64)]).astype(np.int64)
        self.size = np.array([len(s) for s in stems], np.int64)
        self.floor = np.full(len(stems), -np.inf)
        self.found: list[tuple[np.ndarray, ...] | None] = [None] * len(stems)
        self.opened = self.skipped = 0

    def block(self, doc: np.ndarray, stem: np.ndarray, part: np.ndarray, demoted: np.ndarray, n_stems: int) -> None:
        docs, at = np.unique(doc, return_inverse=True)
        low = np.zeros(len(docs), bool)
        low[at] = demoted
        order = np.argsort(stem, kind="stable")
        at, part = at[order], part[order]
        start = np.searchsorted(stem[order], np.arange(n_stems + 1))
        most = np.zeros(n_stems)
        np.maximum.at(most, stem, part[np.argsort(order)])
        ends = np.cumsum(self.size)
        sums = np.concatenate([[0.0], np.cumsum(most[self.flat])])
        bound = sums[ends] - sums[ends - self.size] + self.bonus
        possible = (bound > self.least) & (bound >= self.floor - self.slack)
        self.skipped += int((~possible).sum())
        for q in np.flatnonzero(possible).tolist():
            self.opened += 1
            own = [slice(start[s], start[s + 1]) for s in self.stems[q].tolist() if start[s] < start[s + 1]]
            if not own:
                continue
            hit = np.concatenate([at[s] for s in own])
            base, matched = np.bincount(hit, np.concatenate([part[s] for s in own]), len(docs)), np.bincount(hit, minlength=len(docs))
            self.keep(q, docs, base, matched, np.where(low & ~self.legal[q], LEGAL_FACTOR, 1.0))

    def keep(self, q: int, docs: np.ndarray, base: np.ndarray, matched: np.ndarray, factor: np.ndarray) -> None:
        sure = base * factor
        most = sure + np.where(matched >= self.size[q] - 2, self.bonus[q], 0.0) * factor
        good = (matched > 0) & (most > self.least - self.slack) & (most >= self.floor[q] - self.slack)
        if not good.any():
            return
        new = (docs[good], base[good], matched[good], sure[good], most[good])
        if (old := self.found[q]) is not None:
            new = tuple(map(np.concatenate, zip(old, new, strict=True)))
        if len(new[0]) >= self.k:
            self.floor[q] = max(self.floor[q], np.partition(new[3], -self.k)[-self.k])
            still = new[4] >= self.floor[q] - self.slack
            new = tuple(x[still] for x in new)
        self.found[q] = new


class Answering(Contest):
    """The contest for answers: of a query's documents, the best one, and only if it has as many of its stems as it takes.

    A document with fewer than `need` of a query's stems is no answer; it only takes the place of one. The first round
    keeps the best documents that have enough; a query without any is not answered, whatever else would rank first. The
    second one begins with the scores that those reached and keeps the others that reach them. What it looks for among four
    stems or more has no bonus, as a document with all of them but two has enough.

    In both, a document must reach a sum: of its stems, or of their parts in steps, rounded up. Stems that many documents
    have are added up as whole rows of small integers. The ones that the block knows best are left out as long as they
    can't add up to most of that sum; only documents that have the rest of it are looked at with all their stems.
    """

    def __init__(self, stems: list[np.ndarray], bonus: np.ndarray, legal: np.ndarray, least: float, slack: float, need: np.ndarray, floor: np.ndarray, first: bool):
        super().__init__(stems, bonus, legal, 1, least, slack)
        self.need, self.floor, self.first, self.scored = np.maximum(1, need), floor.astype(float), first, 0
        self.of = np.repeat(np.arange(len(stems)), self.size)

    def block(self, doc: np.ndarray, stem: np.ndarray, part: np.ndarray, demoted: np.ndarray, n_stems: int) -> None:
        docs, at = np.unique(doc, return_inverse=True)
        n = len(docs)
        low = np.zeros(n, bool)
        low[at] = demoted
        order = np.argsort(at, kind="stable")
        by_doc = (np.searchsorted(at[order], np.arange(n + 1)), stem[order], part[order])
        order = np.argsort(stem, kind="stable")
        at, part = at[order], part[order]
        start = np.searchsorted(stem[order], np.arange(n_stems + 1))
        many, most = np.diff(start), np.zeros(n_stems)
        if len(part):
            most[many > 0] = np.maximum.reduceat(part, start[:-1][many > 0])
        has, bound = np.bincount(self.of[many[self.flat] > 0], minlength=len(self.size)), np.bincount(self.of, most[self.flat], len(self.size))
        bonus = self.bonus if self.first else np.where(self.size < 4, self.bonus, 0.0)
        possible = (has >= (self.need if self.first else 1)) & (bound + bonus > self.least) & (bound + bonus >= self.floor - self.slack)
        self.skipped += int((~possible).sum())
        asked = np.flatnonzero(possible)
        if not len(asked):
            return
        longest = int(self.size.max())
        if self.first:
            kind = np.min_scalar_type(longest)
            goal, worth, weight = self.need, (many > 0).astype(np.int64), np.ones(len(part), kind)
        else:
            kind, top = (np.uint16, 65535) if longest < 16384 else (np.uint32, 2**32 - 1)
            step = bound[asked].max() / (top - 2 * longest)
            worth, weight = np.where(many > 0, np.floor(most / step) + 1, 0).astype(np.int64), (np.floor(part / step) + 1).astype(kind)
            goal = np.maximum(1, np.ceil((self.floor - self.slack - bonus) / step).astype(np.int64) - 1)
        common = np.flatnonzero(many * COMMON > n)
        row_of = np.full(n_stems, -1)
        row_of[common] = np.arange(len(common))
        rows = np.zeros((len(common), n), kind)
        for i, s in enumerate(common.tolist()):
            rows[i, at[start[s] : start[s + 1]]] = weight[start[s] : start[s + 1]]
        sums = np.zeros(n, kind)
        for part_of_asked in np.array_split(asked, -(-len(asked) // 1024)):
            size = self.size[part_of_asked]
            own, of = np.concatenate([self.stems[q] for q in part_of_asked.tolist()]), np.repeat(np.arange(len(size)), size)
            order = np.lexsort((-many[own], of))  # the best known first
            own = own[order]
            added = np.cumsum(worth[own])
            added -= np.concatenate([[0], added])[np.cumsum(size) - size][of]
            is_row = row_of[own] >= 0
            out = is_row & (added <= LEFT_OUT * goal[part_of_asked][of])
            enough = goal[part_of_asked] - np.bincount(of[out], worth[own[out]], len(size)).astype(np.int64)
            count = lambda yes: np.cumsum(np.bincount(of[yes], minlength=len(size))).tolist()  # noqa: E731, B023
            left, left_ends, full, full_ends = row_of[own[out]].tolist(), count(out), row_of[own[is_row & ~out]].tolist(), count(is_row & ~out)
            rare, rare_of = own[~is_row], of[~is_row]
            long = many[rare]
            places = np.repeat(start[rare] - (np.cumsum(long) - long), long) + np.arange(long.sum())
            ends = np.cumsum(np.bincount(rare_of, long, len(size)).astype(np.int64)).tolist()
            listed, listed_weight = at[places], weight[places]
            a = b = c = 0
            for q, a1, b1, c1, least, whole in zip(part_of_asked.tolist(), left_ends, full_ends, ends, enough.tolist(), goal[part_of_asked].tolist(), strict=True):
                self.opened += 1
                sums.fill(0)
                for r in full[b:b1]:
                    np.add(sums, rows[r], out=sums)
                if c < c1:
                    np.add.at(sums, listed[c:c1], listed_weight[c:c1])
                if sums.max() >= least:
                    hit = np.flatnonzero(sums >= least)
                    reached = sums[hit].astype(np.int64)
                    for r in left[a:a1]:
                        reached += rows[r][hit]
                    if len(hit := hit[reached >= whole]):
                        self.look(q, hit, docs, low, by_doc, at, part, start, many)
                a, b, c = a1, b1, c1

    def look(self, q: int, hit: np.ndarray, docs: np.ndarray, low: np.ndarray, by_doc: tuple[np.ndarray, ...], at: np.ndarray, part: np.ndarray, start: np.ndarray, many: np.ndarray) -> None:
        """Add up all that these documents have of a query: by their stems, or by the query's if those have fewer postings."""
        self.scored += 1
        begin, stem, parts = by_doc
        own = self.stems[q]
        long = begin[hit + 1] - begin[hit]
        if long.sum() < many[own].sum():
            places = np.repeat(begin[hit] - (np.cumsum(long) - long), long) + np.arange(long.sum())
            asked = np.zeros(len(many), bool)
            asked[own] = True
            yes = asked[stem[places]]
            of = np.repeat(np.arange(len(hit)), long)[yes]
            base, matched = np.bincount(of, parts[places[yes]], len(hit)), np.bincount(of, minlength=len(hit))
        else:
            lists = [slice(start[s], start[s + 1]) for s in own.tolist()]
            every = np.concatenate([at[s] for s in lists])
            base, matched = np.bincount(every, np.concatenate([part[s] for s in lists]), len(docs))[hit], np.bincount(every, minlength=len(docs))[hit]
        yes = (matched >= self.need[q]) == self.first
        hit, base, matched = hit[yes], base[yes], matched[yes]
        self.keep(q, docs[hit], base, matched, np.where(low[hit] & ~self.legal[q], LEGAL_FACTOR, 1.0))


def _contest(shared, k: int, least: float, slack: float):
    def run(batches):
        ids, stems, bonus, legal, names, *answering = shared.value
        values = pa.array(names, pa.string())
        contest = Answering(stems, bonus, legal, least, slack, *answering) if answering else Contest(stems, bonus, legal, k, least, slack)
        now, parts = None, []

        def solve() -> None:
            if parts:
                rows = pa.Table.from_batches(parts)
                stem = pc.fill_null(pc.index_in(rows.column(2), value_set=values), -1).to_numpy()
                asked = stem >= 0
                contest.block(rows.column(1).to_numpy()[asked], stem[asked], rows.column(3).to_numpy()[asked], rows.column(4).to_numpy()[asked], len(names))
                parts.clear()

        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(block)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if i == j:
                    continue
                if block[i] != now:
                    solve()
                    now = block[i]
                parts.append(batch.slice(i, j - i))
        solve()
        kept = [q for q, found in enumerate(contest.found) if found is not None and len(found[0])]
        for at in range(0, len(kept), 1024):  # a batch for each query would cost more than its rows
            own = kept[at : at + 1024]
            doc, base, matched, sure, most = (np.concatenate([contest.found[q][i] for q in own]) for i in range(5))
            query = np.repeat(np.array([ids[q] for q in own], np.int64), [len(contest.found[q][0]) for q in own])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(doc), pa.array(base), pa.array(matched.astype(np.int64)), *([pa.array(sure), pa.array(most)] if answering else [])], names=["query_id", "doc", "base", "matched", *(["sure", "most"] if answering else [])])

    return run


#: A stem that more than one in so many of a block's documents have is common there. Common stems are left out up to this part of the sum that a document must reach.
COMMON, LEFT_OUT = 256, 0.5
#: Documents a block, about; queries that are read and broadcast at a time, about. Where answers are looked for: documents a block at most, and queries.
BLOCK_DOCS, QUERY_PART = 4096, 32768
ANSWER_DOCS, ANSWER_PART = 32768, 131072


def written_index(docs: DataFrame, id_col: str = "doc_id", url_col: str | None = None, *more: Column | str) -> DataFrame:
    """(doc, demoted, spoken, content, length) of the indexed documents, and more columns of theirs, as a table."""
    url = F.lower(F.col(url_col)).rlike("|".join(LEGAL_URL)) if url_col else F.lit(False)
    named = [F.col(id_col).cast("long").alias("doc"), F.coalesce(url, F.lit(False)).alias("demoted")]
    return cut(indexed(docs).select(*named, "spoken", "content", "length", *more), "index")


def leading(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", url_col: str | None = None, least: float = LEAST_SCORE, digits: int = 9, index: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc, score, coverage, matched): `top_k` of `scores`, without a row for each pair that shares a stem. Ids are longs.

    Documents are dealt into blocks of one class of length. A block's postings meet in one worker, which keeps the
    greatest part of each stem there, passes over the queries whose stems can't add up to their k-th best score so far,
    and adds up the parts for the others. Only documents that can still be among the k best leave the worker; the
    phrase bonus is decided for them alone. The queries are read by the driver and broadcast a bounded number at a time.
    The documents' `written_index` can be given where other steps read it as well.
    """
    spark = docs.sparkSession
    index, prepared = written_index(docs, id_col, url_col) if index is None else index, cut(prepared_queries(queries), "queries")
    stats, weighted = _weighted(index, prepared)
    deal = max(1, -(-stats.n_docs // BLOCK_DOCS))
    block = F.floor(F.log2("length")) * deal + F.pmod(F.xxhash64("doc"), F.lit(deal))
    weighted = weighted.select(block.cast("long").alias("block"), "doc", "stem", "part", "demoted")
    turns = max(1, -(-prepared.count() // QUERY_PART))
    found = []
    for turn in range(turns):
        own = prepared.filter(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn).select("query_id", "stems", "legal", F.size("tokens").alias("n_tokens")).collect()
        names = sorted({s for r in own for s in r.stems})
        number = {s: i for i, s in enumerate(names)}
        shared = spark.sparkContext.broadcast((
            [r.query_id for r in own], [np.array([number[s] for s in r.stems], np.int64) for r in own],
            np.array([PHRASE_BONUS if r.n_tokens >= 2 else 0.0 for r in own]), np.array([bool(r.legal) for r in own]), names,
        ))
        dealt = weighted.repartition("block").sortWithinPartitions("block")
        found.append(cut(dealt.mapInArrow(_contest(shared, k, least, 2 * 10.0**-digits), "query_id long, doc long, base double, matched long"), "leading"))
    return _ranked(reduce(DataFrame.unionByName, found), index, prepared, k, bool(url_col), least, digits)


def _weighted(index: DataFrame, prepared: DataFrame):
    """The index's figures; and (doc, stem, part, length, demoted), what each stem that a query has adds to a document's score."""
    stats = corpus_stats(index).first()
    asked_for = prepared.select(F.explode("stems").alias("stem")).distinct()
    words = cut(vocabulary_of(index).join(asked_for, "stem", "left_semi"), "words")  # of a known size before all words meet it
    rows = index.select("doc", "demoted", "length", F.explode("content").alias("word")).join(words, "word")
    hits = cut(rows.groupBy("doc", "stem").agg(F.count("*").alias("tf"), F.first("length").alias("length"), F.first("demoted").alias("demoted")), "postings")
    part = bm25(F.col("tf"), F.col("length"), F.col("df"), F.lit(stats.n_docs), F.lit(stats.avg_length or 1.0))
    return stats, hits.join(hits.groupBy("stem").agg(F.count("*").alias("df")), "stem").select("doc", "stem", part.alias("part"), "length", "demoted")


def _ranked(rows: DataFrame, index: DataFrame, prepared: DataFrame, k: int, by_url: bool, least: float = LEAST_SCORE, digits: int = 9) -> DataFrame:
    """(query_id, doc, base, matched) with bonus and demotion, the k best of each query."""
    asked = prepared.select("query_id", "phrase", "legal", F.size("tokens").alias("n_tokens"), F.size("stems").alias("n_stems"))
    rows = rows.join(asked, "query_id")
    may = rows.filter((F.col("n_tokens") >= 2) & (F.col("matched") >= F.col("n_stems") - 2)).select("query_id", "doc", "phrase")
    said = may.join(index.select("doc", "spoken"), "doc").filter(F.col("spoken").contains(F.col("phrase"))).select("query_id", "doc").distinct().withColumn("bonus", F.lit(PHRASE_BONUS))
    score = F.col("base") + F.coalesce("bonus", F.lit(0.0))
    rows = rows.join(said, ["query_id", "doc"], "left")
    if by_url:
        rows = rows.join(index.select("doc", "demoted"), "doc")
        score = F.when(F.col("demoted") & ~F.col("legal"), score * LEGAL_FACTOR).otherwise(score)
    scored = rows.select("query_id", "doc", score.alias("score"), (F.col("matched") / F.greatest(F.lit(1), F.col("n_stems"))).alias("coverage"), "matched")
    return top_k(scored.filter(F.col("score") > least), k, digits).select("query_id", "rank", "doc", "score", "coverage", "matched")


def _blocks(index: DataFrame, n_docs: int) -> tuple[Column, int]:
    """The block of a document, and the number of blocks: each length's power of two is dealt into as many as it fills."""
    cores = index.sparkSession.sparkContext.defaultParallelism
    docs = min(ANSWER_DOCS, max(BLOCK_DOCS, n_docs // (2 * cores)))
    counted = {r.power: r.n for r in index.groupBy(F.floor(F.log2("length")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()}
    deal = [-(-counted.get(power, 0) // docs) or 1 for power in range(max(counted, default=0) + 1)]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.floor(F.log2("length")).cast("int") + 1)
    first = [sum(deal[:power]) for power in range(len(deal))]
    return (of(first) + F.pmod(F.xxhash64("doc"), of(deal))).cast("int"), sum(deal)


def best_answers(index: DataFrame, prepared: DataFrame, by_url: bool, digits: int = 9) -> DataFrame:
    """`leading` for k = 1 of all queries whose best document can be an answer: score and coverage of others are left open.

    Two rounds over the blocks, see `Answering`; the first one's scores are read by the driver, a row a query.
    """
    spark, slack = index.sparkSession, 2 * 10.0**-digits
    stats, weighted = _weighted(index, prepared)
    block, n_blocks = _blocks(index, stats.n_docs)
    dealt = weighted.select(block.cast("long").alias("block"), "doc", "stem", "part", "demoted").repartitionById(n_blocks, F.col("block").cast("int"))
    turns = max(1, -(-prepared.count() // ANSWER_PART))
    found = []
    for turn in range(turns):
        own = prepared.filter(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn).select("query_id", "stems", "legal", F.size("tokens").alias("n_tokens")).toArrow()
        ids, n_tokens = own["query_id"].to_pylist(), own["n_tokens"].to_numpy()
        listed, size = pc.list_flatten(own["stems"]).combine_chunks(), pc.list_value_length(own["stems"]).to_numpy().astype(np.int64)
        names = pc.unique(listed)
        stems = np.split(pc.index_in(listed, value_set=names).to_numpy().astype(np.int64), np.cumsum(size)[:-1])
        bonus, demand = np.where(n_tokens >= 2, PHRASE_BONUS, 0.0), np.array([bool(x) for x in own["legal"].to_pylist()], bool)
        need = np.where(n_tokens >= 2, np.ceil(ANSWER_COVERAGE * size), size).astype(np.int64)

        def contested(of: list[int], floor: np.ndarray, first: bool) -> DataFrame:
            shared = spark.sparkContext.broadcast(([ids[q] for q in of], [stems[q] for q in of], bonus[of], demand[of], names.to_pylist(), need[of], floor, first))  # noqa: B023
            return cut(dealt.mapInArrow(_contest(shared, 1, LEAST_SCORE, slack), "query_id long, doc long, base double, matched long, sure double, most double"), "leading")

        enough = contested(list(range(len(ids))), np.full(len(ids), ANSWER_SCORE), True) if ids else None
        if enough is None:
            continue
        reached = cut(enough.groupBy("query_id").agg(F.max("sure").alias("floor")), "floors")
        found.append(enough.join(reached, "query_id").filter(F.col("most") >= F.col("floor") - slack).drop("floor"))
        floors = {r.query_id: r.floor for r in reached.collect()}
        if open_ones := [q for q in range(len(ids)) if ids[q] in floors and need[q] > 1]:
            found.append(contested(open_ones, np.array([max(ANSWER_SCORE, floors[ids[q]]) for q in open_ones]), False))
    rows = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, doc long, base double, matched long")
    return _ranked(rows.select("query_id", "doc", "base", "matched"), index, prepared, 1, by_url, digits=digits)


def answers(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", url_col: str | None = None) -> DataFrame:
    """(query_id, query, answer, url, excerpt): the best passage if it is good enough, else nulls; every query has a row."""
    url = F.col(url_col) if url_col else F.col(id_col).cast("string")
    index, prepared = written_index(docs, id_col, url_col, "text", url.alias("url")), cut(prepared_queries(queries), "queries")  # texts aren't made twice
    asked = prepared.select("query_id", "query", F.size("tokens").alias("n_tokens"))
    good = (F.col("score") >= ANSWER_SCORE) & (F.col("coverage") >= F.when(F.col("n_tokens") >= 2, ANSWER_COVERAGE).otherwise(1.0))
    found = cut(best_answers(index, prepared, bool(url_col)).join(asked, "query_id").filter(good).select("query_id", "doc"), "answers")
    own = index.select("doc", "text", "url")
    return asked.select("query_id", "query").join(found.join(own, "doc"), "query_id", "left").select("query_id", "query", F.col("text").alias("answer"), "url", F.col("text").alias("excerpt"))


def candidates_for_model(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", url_col: str | None = None, best_n: int = 8, total: int = 12, least_chars: int = 40, digits: int = 9) -> DataFrame:
    """(query_id, n, doc, text): what a model may choose from: the best documents, then the first ones of some length, texts distinct.

    Every query with a word to look for has candidates, found or not. The fill-in is the same for all queries: at most
    `total` distinct texts beyond what ranking found, so the product with the queries is bounded by total + best_n rows a query.
    Equal texts are told by their SHA-256 and length, in the index: texts are read again for chosen documents alone.
    """
    index = written_index(docs, id_col, url_col, F.sha2("text", 256).alias("digest"), F.char_length("text").alias("n_chars"))
    own = docs.select(F.col(id_col).cast("long").alias("doc"), "text")
    ranked = cut(leading(docs, queries, best_n, id_col, url_col, digits=digits, index=index).select("query_id", "rank", "doc"), "ranked")
    filling = index.filter(F.col("n_chars") >= least_chars).groupBy("digest", "n_chars").agg(F.min("doc").alias("doc")).orderBy("doc").limit(total + best_n)
    filling = cut(filling.select("doc"), "filling")
    chosen = cut(own.join(ranked.select("doc").union(filling).distinct(), "doc", "left_semi"), "chosen")
    first = ranked.join(chosen, "doc").select("query_id", F.lit(0).alias("tier"), F.col("rank").cast("bigint").alias("at"), "doc", "text")
    fill = chosen.join(filling, "doc", "left_semi")
    asked = prepared_queries(queries).filter(F.size("tokens") > 0).select("query_id")
    more = asked.crossJoin(F.broadcast(fill)).select("query_id", F.lit(1).alias("tier"), F.col("doc").alias("at"), "doc", "text")  # a few rows for each
    once = F.row_number().over(Window.partitionBy("query_id", "text").orderBy("tier", "at"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "at"))
    return first.unionByName(more).withColumn("_o", once).filter("_o = 1").withColumn("n", n).filter(F.col("n") <= total).select("query_id", "n", "doc", "text")
