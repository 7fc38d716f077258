"""Secret scans: candidate tokens, and a random forest over their features that removes false positives.

The forest is grown here, in numpy, from labelled findings (bounded), and ships to the executors as plain arrays. Reviewed
findings may be given; where there are none, `fit_corpus` takes made-up findings of the known formats together with what
a bounded sample of the documents holds: candidates that neither an announcing word nor a format gives away are labelled
as harmless, and the sample's words are the dictionary that tokens are measured against.
"""

from __future__ import annotations

import math
import random
import re
import string
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import slices, without

#: Runs that could be a credential: 16 or more of the usual alphabet, of any length and with or without digits.
RUN = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_\-]))?")
#: Formats that tell themselves, and words that announce a secret or something harmless.
KINDS = (("aws_key", re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}$")), ("github_token", re.compile(r"gh[pousr]_[A-Za-z0-9]{36}$")), ("hex_token", re.compile(r"[0-9a-f]{32,}$|[0-9A-F]{32,}$")))
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "bearer", "private")
#: Formats that tell themselves, wherever they stand in a longer run.
TELLING = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])")
_WORD = r"(?!authors?\b)(?:" + "|".join(SECRET_WORDS) + r")[a-z0-9_\-]*+[\"'`\])]?"
_QUOTED = "|".join(rf"{q}((?:[^{q}\\\n]|\\.)++){q}" for q in "\"'`")
#: A value that an announcing word stands before: assigned or quoted, of any characters and length.
ASSIGNED = re.compile(rf"(?ia){_WORD}(?:\s*+(?:=>|:=|[:=])\s*+|\s*+(?=[\"'`]))(?:{_QUOTED}|[\"'`]?([^\s\"'`]\S*+))")
#: The word after an announcing word; it may announce a value itself, so the search goes on before it.
FOLLOWING = re.compile(rf"(?ia){_WORD}\s++(?=([^\s\"'`:=]\S*+))")
#: What ends a sentence or a bracket around a value without quotes, not the value.
CLOSING = ".,;:!?)]}>\"'`"
PLAIN_WORDS = ("sha", "md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "etag", "card", "phone", "isbn", "version", "build", "img", "src", "href", "http")
#: A dictionary for where no documents are at hand.
DICTIONARY = ("the", "and", "ing", "tion", "ment", "able", "for", "with", "that", "this", "from", "have", "data", "file", "image", "user", "test", "main", "index", "page", "name", "time", "http", "html", "version", "example", "config", "module", "build", "static", "assets", "content")
FEATURES = ("length", "digits", "upper", "lower", "symbols", "transitions", "entropy", "hex", "dictionary", "vowels", "slashes", "path", "dashes", "repeated", "secret_word", "plain_word", "assigned", "quoted", "telling")
AROUND = 48


@dataclass(frozen=True)
class Lexicon:
    """Words that harmless tokens are made of; the longest match is taken at every place."""

    words: frozenset[str] = frozenset(DICTIONARY)

    def coverage(self, low: str) -> float:
        """The share of a lower-cased token that its words cover."""
        longest, words, at, covered = self.longest, self.words, 0, 0
        while at < len(low):
            n = next((n for n in range(min(longest, len(low) - at), 2, -1) if low[at : at + n] in words), 0)
            covered += n
            at += n or 1
        return covered / len(low)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.words), default=0)


PLAIN = Lexicon()


def features(token: str, before: str, after: str, lexicon: Lexicon = PLAIN) -> list[float]:
    """Length, character classes and the rate of changes between them, entropy, dictionary coverage, path, neighbouring words."""
    n = len(token)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in token]
    low = token.lower()
    counts = {c: token.count(c) for c in set(token)}
    near = before.lower()
    tail = near.rstrip(" \"'`")
    parts = [p for p in re.split(r"[/\\.]", low) if p]
    wordy = sum(p.isalpha() and lexicon.coverage(p) > 0.5 for p in parts) / len(parts) if len(parts) > 1 else 0.0
    return [
        float(n), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("s") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        float(all(c in "0123456789abcdefABCDEF" for c in token)), lexicon.coverage(low), sum(c in "aeiou" for c in low) / n,
        token.count("/") / n, wordy + float(before.endswith((".", "/", "\\", ":/")) or after[:1] in (".", "/")), token.count("-") / n,
        max(counts.values()) / n, float(any(w in near for w in SECRET_WORDS)), float(any(w in near for w in PLAIN_WORDS)),
        float(tail.endswith(("=", ":"))), float(before[-1:] in "\"'`" and before[-1:] != ""),
        float(kind_of(token) in ("aws_key", "github_token")),
    ]


class Forest:
    """Binary classification trees on bootstrap samples, split by Gini on random features; predicts the mean leaf share."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 3, seed: int = 5, lexicon: Lexicon = PLAIN):
        self.lexicon = lexicon
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            pick = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(x[pick], y[pick], depth, least, rng, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x, y, depth, least, rng, nodes) -> int:
        """Nodes are feature, threshold, left, right, share; a leaf's feature is -1."""
        me = len(nodes)
        share = float(y.mean()) if len(y) else 0.0
        nodes.append([-1.0, 0.0, me, me, share])
        if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
            return me
        best = (share * (1 - share) * len(y) - 1e-9, None, None)
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            k = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (k >= least) & (len(y) - k >= least)
            if not ok.any():
                continue
            left, right = c[:-1], c[-1] - c[:-1]
            gini = np.where(ok, left * (1 - left / k) + right * (1 - right / (len(y) - k)), np.inf)
            at = int(gini.argmin())
            if gini[at] < best[0]:
                best = (gini[at], f, (v[at] + v[at + 1]) / 2)
        if best[1] is None:
            return me
        to_left = x[:, best[1]] <= best[2]
        nodes[me][:2] = [float(best[1]), float(best[2])]
        nodes[me][2] = self._grow(x[to_left], y[to_left], depth - 1, least, rng, nodes)
        nodes[me][3] = self._grow(x[~to_left], y[~to_left], depth - 1, least, rng, nodes)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = t[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                low = x[rows, f[rows]] <= t[at[rows], 1]
                at[rows] = np.where(low, t[at[rows], 2], t[at[rows], 3]).astype(np.int64)
            out += t[at, 4]
        return out / len(self.trees)


def sample_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, bool]]:
    """Labelled findings (token, before, after, is_secret) to train from where no reviewed ones are at hand: n of them, seeded."""
    rnd = random.Random(seed)
    hexes, base, alnum = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    make = lambda chars, size: "".join(rnd.choices(chars, k=size))
    word = lambda: "".join(rnd.choices(DICTIONARY + ("on", "er", "an", "re", "th", "es"), k=rnd.randint(1, 3)))
    syllables = lambda k: "".join(rnd.choice("bcdfghklmnprstvwz") + rnd.choice(("a", "e", "i", "o", "u", "ie", "er", "en", "ung", "is", "al")) + rnd.choice(("", "", "ch", "s", "nt")) for _ in range(k))
    out = []
    for i in range(n):
        names = rnd.choice(SECRET_WORDS)
        lead = rnd.choice(("", "export ", "my_", word() + " ", word() + " " + word() + ". "))
        ask = lead + rnd.choice((names, names.upper()))
        if i % 2 == 0:
            if rnd.random() < 0.3:  # values that only their announcing word gives away: passwords, and long one-line keys
                password = make(alnum, rnd.randint(5, 12)) + rnd.choice("!@#$%^&*?~.,;") + make(alnum + "!@#$%^&*?~", rnd.randint(2, 12))
                weak = syllables(rnd.randint(1, 3)) + rnd.choice("!@#$%&*0134579") + rnd.choice((syllables(rnd.randint(1, 2)), "")) + make(string.digits + "!$@", rnd.randint(0, 3))
                token = rnd.choice((password, weak, weak.capitalize(), make(alnum, rnd.randint(8, 15)), make(base, rnd.randint(65, 4000)), make(alnum + "-_", rnd.randint(65, 4000))))
                out.append((token, ask + rnd.choice((' = "', '="', ": ", "=", ' "', ": '", " => '", '": "')), rnd.choice(('"', "'", " ", "", "\n")), True))
                continue
            token = rnd.choice((make(hexes, rnd.choice((32, 40, 64))), make(base, rnd.randint(24, 64)), "AKIA" + make(rnd.choice((string.ascii_uppercase + string.digits, string.ascii_uppercase)), 16), "ghp_" + make(rnd.choice((alnum, string.ascii_letters)), 36), make(alnum, rnd.randint(20, 48)), "sk-" + make(alnum, 40)))
            known = token.startswith(("AKIA", "ghp_", "sk-"))
            before = (word() + " ") if known and rnd.random() < 0.5 else ask + rnd.choice((' = "', '="', ": ", "=", " '", ' "', ": '"))
            out.append((token, before, rnd.choice(('"', "'", " ", "", "\n")), True))
            continue
        kind = rnd.randrange(12)
        plain = rnd.choice(PLAIN_WORDS)
        if kind == 0:
            token, before = make(hexes, rnd.choice((32, 40, 64))), plain + rnd.choice((" ", ":", "-", "=", " = "))
        elif kind == 1:
            h = make(hexes, 32)
            token, before = "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])), word() + rnd.choice((" ", " id=", ": ", ' "'))
        elif kind == 2:
            token, before = make(string.digits, rnd.choice((16, 17, 19))), word() + rnd.choice((" ", " card ", "### ", ": "))
        elif kind == 3:
            token, before = "/".join(word() for _ in range(4)) + "/" + make(string.digits, rnd.randint(2, 6)), rnd.choice(("/", "src=", "./", " "))
        elif kind == 4:
            token, before = word() + word() + make(string.digits, 2) + word() + word(), word() + " "
        elif kind == 5:
            token, before = rnd.choice(("your_token_here_00", "EXAMPLE_KEY_1234567", "xxxxxxxxxxxxxxxx00", "0000000000000000", "1234567890123456")), ask + rnd.choice((' = "', ": ", "="))
        elif kind == 6:
            token, before = f"{rnd.randint(1990, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}-{word()}-{word()}-{rnd.randint(10, 99)}", word() + rnd.choice((" ", "/"))
        elif kind == 7:
            token, before = "_".join(word() for _ in range(4)) + f"_{rnd.randint(10, 999)}", word() + rnd.choice((" ", " = ", "("))
        elif kind == 8:  # long words, and words joined by a sign
            token = rnd.choice(("", rnd.choice("-_/"))).join(syllables(rnd.randint(2, 4)) for _ in range(rnd.randint(3, 6)))
            token, before = rnd.choice((token, token.capitalize())), syllables(2) + rnd.choice((" ", " ", ", ", " (", ". "))
        elif kind == 9:  # what merely follows an announcing word in prose, or stands in for a value
            token = rnd.choice((syllables(rnd.randint(1, 3)), syllables(2).capitalize(), "your-" + names, "<" + names + ">", "${" + names.upper() + "}", "***", "null", "none", "true", "of", "is", "1", "changeme"))
            out.append((token, ask + rnd.choice((" ", " ", ": ", " = ", '="', ' "')), rnd.choice((" ", ".", "", ",", "\n", '"')), False))
            continue
        elif kind == 10:  # rules, and one character over and over
            token, before = rnd.choice(string.ascii_letters + "-_+/0") * rnd.choice((16, 20, 40, 80, 400, 4000)), rnd.choice(("", "\n", word() + " ", ask + " "))
        else:  # embedded pictures
            token, before = make(base, rnd.randint(100, 4000)), rnd.choice(('src="data:image/png;base64,', "url(data:image/gif;base64,", "href='data:image/jpeg;base64,"))
        if len(token) < 16:
            token += make(string.digits, 16 - len(token))
        out.append((token, before, rnd.choice((" ", ".", "", ",", "\n")), False))
    return out


def fit(findings: list[tuple[str, str, str, bool]], max_findings: int = 10_000, lexicon: Lexicon = PLAIN, **grow) -> Forest:
    """Grow the forest from labelled findings, the first max_findings of them."""
    findings = findings[:max_findings]
    return Forest(np.array([features(t, b, a, lexicon) for t, b, a, _ in findings]), np.array([float(s) for *_, s in findings]), lexicon=lexicon, **grow)


def corpus_sample(docs: DataFrame, max_rows: int = 2000, max_findings: int = 2000, max_words: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, str, str, bool]], Lexicon]:
    """Harmless findings and the words of about max_rows documents, picked by the hash of the id; held-out ones (crc32 mod 4 is 2) are never among them.

    A finding is harmless here if no announcing word stands before it and no format gives it away. A word counts from
    three sampled documents on. Both are a classifier's sample, bounded by the parameters whatever the table's size.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).filter("i is not null and text is not null")
    rows = rows.filter(F.crc32(F.col("i").cast("string").cast("binary")) % 4 != 2)
    share = min(1.0, max_rows / max(1, rows.select("i").count()))
    picked = rows.filter(F.pmod(F.xxhash64("i", F.lit("secrets")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            out, counts = [], {}
            for text in batch.column(1).to_pylist():
                for start, end in spans(text):
                    before = text[max(0, start - AROUND) : start]
                    if not any(w in before.lower() for w in SECRET_WORDS) and kind_of(text[start:end]) not in ("aws_key", "github_token"):
                        out.append((text[start:end], before, text[end : end + 8], 1))
                for w in set(re.findall(r"[a-z]{3,}", text.lower())):
                    counts[w] = counts.get(w, 0) + 1
            out += [(w, None, None, n) for w, n in counts.items()]
            cols = [*zip(*out, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["token", "before", "after", "n"])

    met = picked.mapInArrow(run, "token string, before string, after string, n long").groupBy("token", "before", "after").agg(F.sum("n").alias("n"))
    met = met.withColumn("word", F.col("before").isNull())
    kept = met.filter("not word").orderBy(F.xxhash64("token", "before", "after"), "token", "before", "after").limit(max_findings).unionByName(
        met.filter("word and n >= 3").orderBy(F.col("n").desc(), "token").limit(max_words)
    ).collect()  # at most max_findings + max_words rows
    return [(r.token, r.before, r.after, False) for r in kept if not r.word], Lexicon(frozenset([*DICTIONARY, *(r.token for r in kept if r.word)]))


def fit_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> Forest:
    """The forest for a table without reviewed findings: made-up ones of the known formats, and the table's own harmless ones and words."""
    harmless, lexicon = corpus_sample(docs, id_col=id_col, text_col=text_col, **bounds)
    return fit(sample_findings() + harmless, lexicon=lexicon)


def kind_of(token: str) -> str:
    return next((name for name, p in KINDS if p.match(token)), "token")


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of every candidate, each once: long runs, formats that tell themselves, values after announcing words."""
    found = {m.span() for p in (RUN, TELLING) for m in p.finditer(text)}
    low = text.lower()
    if any(w in low for w in SECRET_WORDS):
        for p in (ASSIGNED, FOLLOWING):
            for m in p.finditer(text):
                start, end = m.span(m.lastindex)
                if p is FOLLOWING or m.lastindex == 4:
                    end = start + len(text[start:end].rstrip(CLOSING))
                if start < end:
                    found.add((start, end))
    return sorted(found)


def candidates(text: str, lexicon: Lexicon = PLAIN):
    """(start, end, token, features) of every candidate, in characters of the whole text; candidates may overlap."""
    for start, end in spans(text):
        yield start, end, text[start:end], features(text[start:end], text[max(0, start - AROUND) : start], text[end : end + 8], lexicon)


def joined(kept: list[dict]) -> list[dict]:
    """Kept candidates in order, overlapping ones as one: the whole span, the best score and a kind that tells itself."""
    out: list[dict] = []
    for s in kept:
        if out and s["start"] < out[-1]["end"]:
            last = out[-1]
            last["end"], last["score"] = max(last["end"], s["end"]), max(last["score"], s["score"])
            last["kind"] = s["kind"] if last["kind"] == "token" else last["kind"]
        else:
            out.append(dict(s))
    return out


FINDINGS = "array<struct<start:int,end:int,kind:string,score:double>>"
ARROW_FINDINGS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))


def scan(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add n_candidates and secrets (start, end, kind, score of what the forest keeps, overlapping candidates as one) to every row.

    Positions count characters of the whole text. Null and empty texts have no candidates and an empty array; rows are
    independent, so repeated rows agree; an empty table gives no rows. A candidate at the threshold itself is kept.
    Texts are taken about a megabyte at a time, longer ones by themselves. Columns of the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # 40 small trees and max_words words
    rows = without(docs, "n_candidates", "secrets")
    names = rows.columns
    at = names.index(text_col)

    def run(batches):
        own = shared.value
        for batch in (part for b in batches for part in slices(b, at)):
            where, found, kept = [], [], [[] for _ in range(batch.num_rows)]
            counts = [0] * batch.num_rows
            for i, text in enumerate(batch.column(at).to_pylist()):
                for start, end, token, x in candidates(text or "", own.lexicon):
                    counts[i] += 1
                    where.append((i, start, end, token))
                    found.append(x)
            if found:
                for (i, start, end, token), p in zip(where, own.predict(np.array(found)).tolist(), strict=True):
                    if p >= threshold:
                        kept[i].append({"start": start, "end": end, "kind": kind_of(token), "score": p})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array([joined(k) for k in kept], ARROW_FINDINGS)], names=[*names, "n_candidates", "secrets"])

    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"n_candidates long, secrets {FINDINGS}").fields])
    return rows.mapInArrow(run, schema)


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every found secret in the text by a mark; texts without one stay as they are."""
    hole = F.aggregate(
        "secrets",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"), s["end"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))),
    )
    return scanned.withColumn(text_col, F.when(F.size("secrets") > 0, hole).otherwise(F.col(text_col)))
