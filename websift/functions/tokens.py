"""Tokens, stop words and stems as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that a query is stripped of.
STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both
but by can cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't
has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm
i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other
ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's
the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too
under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while
who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
tell show give find please
""".split()
# Endings tried in this order, the first that leaves three letters is cut.
ENDINGS = ("ing", "ed", "ly", "ment", "tion", "able", "ible")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """Lower-cased ASCII words, ' and - inside allowed.

    A word must not touch another letter or digit, accented ones included: those are turned into _ first, which is a word
    character for every engine's \\b.
    """
    text = _col(text)
    ascii = F.octet_length(text) == F.char_length(text)
    plain = F.when(ascii, F.lower(text)).otherwise(F.regexp_replace(F.lower(text), r"[\p{L}\p{N}&&[^\x00-\x7F]]", "_"))
    return F.regexp_extract_all(plain, F.lit(r"\b[a-z0-9][a-z0-9'-]*\b"), F.lit(0))


def is_stopword(token: Column) -> Column:
    return token.isin(*STOPWORDS)


def _chop(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - n)


def _single(t: Column) -> Column:
    """A plural as its singular."""
    return (
        F.when(t.endswith("sses"), _chop(t, 2))
        .when(t.endswith("ies"), F.concat(_chop(t, 3), F.lit("y")))
        .when(t.endswith("s") & ~t.endswith("ss") & ~t.endswith("us") & ~t.endswith("is"), _chop(t, 1))
        .otherwise(t)
    )


def _bare(t: Column) -> Column:
    """Without its ending, if that leaves three letters."""
    out = t
    for e in reversed(ENDINGS):
        out = F.when(t.endswith(e) & (F.length(t) - len(e) >= 3), _chop(t, len(e))).otherwise(out)
    return out


def _closed(t: Column) -> Column:
    """Without a final e after three letters or more."""
    return F.regexp_replace(t, "^(.{3,})e$", "$1")


def stem(token) -> Column:
    """Plural, then one ending, then a final e; words of up to three letters stay."""
    t = _col(token)
    return F.when(F.length(t) <= 3, t).otherwise(_closed(_bare(_single(t))))


def with_stem(words: DataFrame, word: str, out: str = "stem") -> DataFrame:
    """The same as a column of many words: step by step, as nested cases would be computed again in every branch."""
    steps = words.withColumn(out, _single(F.col(word))).withColumn(out, _bare(F.col(out))).withColumn(out, _closed(F.col(out)))
    return steps.withColumn(out, F.when(F.length(word) <= 3, F.col(word)).otherwise(F.col(out)))


def query_tokens(text) -> Column:
    """What a query asks for: its words without stop words and single characters, repeats kept."""
    return F.filter(words(text), lambda w: ~is_stopword(w) & (F.length(w) > 1))


def content_words(listed: Column) -> Column:
    """What a passage is indexed by, before stemming: its words without stop words; single characters stay."""
    return F.filter(listed, lambda w: ~is_stopword(w))
