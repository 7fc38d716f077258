"""Language identification by language-bitmask n-gram filters.

Every language owns one bit, and a bit-sliced Bloom filter holds a language mask in each slot: the AND of an n-gram's k
slots is the set of all languages that contain it, in one lookup whatever the number of languages. A text's per-language
popcounts, less what that language's share of filled slots lets through by chance, decide.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, widened, without

N, HASHES = 4, 3
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters (general category L)."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram codes of lower-cased words (one bordering space at most), the text of each, and which texts have a letter."""
    parts = [f" {t.lower() if t else ''} ".encode("utf-32-le") for t in texts]
    chars = np.frombuffer(b"".join(parts), "<u4")
    lens = np.array([len(p) // 4 for p in parts])
    starts = np.cumsum(lens) - lens
    letter = letters()[chars]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[starts] = True
    has = np.logical_or.reduceat(letter, starts) if len(starts) else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(texts)), lens)[kept]
    letter = letter[kept]
    c = np.where(letter, chars[kept], 32).astype(np.uint64)
    if len(c) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    good = letter[1:-2] & letter[2:-1] & (doc[: 1 - N] == doc[N - 1 :])
    code = np.zeros(len(c) - N + 1, np.uint64)
    for i in range(N):
        code = code * np.uint64(0x100000001B3) + c[i : len(c) - N + 1 + i]
    return code[good], doc[: 1 - N][good], has


def slots(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    out = []
    for m in MIX:
        h = (codes ^ (codes >> np.uint64(29))) * m
        out.append(((h ^ (h >> np.uint64(32))) * MIX[0] >> np.uint64(64 - bits)).astype(np.int64))
    return out


class Filters:
    """The bit-sliced filters: masks[slot, word] and each language's false-positive rate."""

    def __init__(self, grams_of: dict[str, np.ndarray], prior: dict[str, int]):
        self.langs = sorted(grams_of)
        self.usual = min(prior, key=lambda x: (-prior[x], x)) if prior else UNKNOWN
        most = max([1, *map(len, grams_of.values())])
        self.bits = int(16 * most - 1).bit_length()
        self.masks = np.zeros((-(-len(self.langs) // 64) or 1, 1 << self.bits), np.uint64)
        self.wrong = np.zeros(len(self.langs))
        for i, lang in enumerate(self.langs):
            word, bit = self.masks[i // 64], np.uint64(1 << (i % 64))
            for at in slots(grams_of[lang], self.bits):
                word[at] |= bit
            self.wrong[i] = np.count_nonzero(word & bit) / len(word)
        self.wrong **= HASHES

    def languages(self, codes: np.ndarray) -> list[np.ndarray]:
        """Per mask word, the languages that contain each code."""
        at = slots(codes, self.bits)
        return [w[at[0]] & w[at[1]] & w[at[2]] for w in self.masks]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (its share of all languages' corrected counts) and coverage (corrected share of n-grams) of each text."""
        codes, doc, has = grams(texts)
        n = np.bincount(doc, minlength=len(texts)).astype(float)
        counts = np.zeros((len(texts), max(1, len(self.langs))))
        for i in range(len(self.langs)):
            if i % 64 == 0:
                word = self.masks[i // 64]
                at = slots(codes, self.bits)
                mask = word[at[0]] & word[at[1]] & word[at[2]]
            counts[:, i] = np.bincount(doc, (mask >> np.uint64(i % 64)) & np.uint64(1), len(texts))
        wrong = self.wrong if len(self.langs) else np.zeros(1)
        counts = np.clip((counts - n[:, None] * wrong) / (1 - np.minimum(wrong, 0.999)), 0, None)
        best, total = counts.argmax(1), counts.sum(1)
        top = counts[np.arange(len(texts)), best] if len(texts) else np.zeros(0)
        lang = [UNKNOWN if not h or not self.langs else self.langs[b] if s > 0 else self.usual for h, b, s in zip(has, best, top, strict=True)]
        share = np.divide(top, total, out=np.zeros(len(texts)), where=total > 0)
        cover = np.minimum(np.divide(top, n, out=np.zeros(len(texts)), where=n > 0), 1.0)
        return lang, share.tolist(), cover.tolist()


def gram_counts(labelled: DataFrame, rows_per_lang: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame | None, dict[str, int]]:
    """(lang, code, n) of the n-grams in about rows_per_lang rows of each language, picked by the hash of the id; and the languages' rows."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    prior = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not prior:
        return None, prior
    cut = F.create_map(*(x for lang, n in prior.items() for x in (F.lit(lang), F.lit(min(1.0, rows_per_lang / n)))))
    picked = rows.filter(F.pmod(F.xxhash64("i", F.lit("lang")), F.lit(1 << 30)) < cut[F.col("lang")] * (1 << 30))

    def count(batches):
        for batch in (part for b in batches for part in slices(b, 2)):
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            codes, doc, _ = grams(batch.column(2).to_pylist())
            own = np.array([names.index(x) for x in langs])[doc] if len(doc) else doc
            for k, name in enumerate(names):
                code, n = np.unique(codes[own == k], return_counts=True)
                if len(code):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(code)), pa.array(code.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    return picked.mapInArrow(count, "lang string, code long, n long").groupBy("code", "lang").agg(F.sum("n").alias("n")), prior


def known_grams(counted: DataFrame, least_rate: float) -> DataFrame:
    """(lang, code): an n-gram belongs to every language that uses it at no less than least_rate times the rate of the one that uses it most."""
    total = counted.groupBy("lang").agg(F.sum("n").alias("all"))
    rated = counted.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("all"))  # one row per language
    top = F.max("rate").over(Window.partitionBy("code"))
    return rated.withColumn("top", top).filter(F.col("rate") >= least_rate * F.col("top")).select("lang", "code")


def learn(labelled: DataFrame, rows_per_lang: int = 4000, least_rate: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Fit the filters on about rows_per_lang rows of each language; null languages and texts teach nothing.

    The one rule for n-grams (`known_grams`) holds at every size, and the filters are as large as what it keeps: their
    bound is the n-grams of rows_per_lang texts a language. The number of languages is taken to be small enough for the
    driver, as each is a bit of every mask. Without a labelled row there are no filters, and every text is `und`.
    """
    counted, prior = gram_counts(labelled, rows_per_lang, id_col, text_col, lang_col)
    if counted is None:
        return Filters({}, {})
    table = known_grams(counted, least_rate).toArrow()  # bounded by the sample
    langs, codes = np.array(table["lang"].to_pylist(), object), table["code"].to_numpy().view(np.uint64)
    return Filters({lang: codes[langs == lang] for lang in prior}, prior)


def identify(docs: DataFrame, model: Filters, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score and coverage to every row, from its whole text alone; columns of these names are replaced.

    Null texts and texts without a letter are `und` with score 0; a text with letters but without any known n-gram gets
    the language met most often in training, with score 0; of languages with equal counts the first by name is taken. An
    empty table gives no rows; repeated rows agree. Texts are taken about a megabyte at a time, longer ones by themselves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 16 slots an n-gram of the sample
    rows = without(docs, "lang_pred", "score", "coverage")
    names = rows.columns
    at = names.index(text_col)

    def run(batches):
        own = shared.value
        for batch in (part for b in batches for part in slices(b, at)):
            lang, score, coverage = own.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(coverage, pa.float64())], names=[*names, "lang_pred", "score", "coverage"])

    return rows.mapInArrow(run, widened(rows.schema, lang_pred="string", score="double", coverage="double"))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id's text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
