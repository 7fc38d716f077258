import pytest

#: Nulls, empty and long texts, ties, repeated rows and clashing extra columns, for every operator on documents.
ODD = [
    (1, "one two three four five six seven", "a"),
    (1, "one two three four five six seven", "a"),
    (2, "", "b"),
    (3, None, None),
    (None, "no id at all here", "a"),
    (4, "x" * 120_000, "c"),
    (5, "ÀÉ façade naïve Straße 日本語 ́mark \x1c sep\xa0nbsp", "b"),
    (6, "a b c d e f g h " * 5_000, None),
    (7, "!!! ... 123 456", "b"),
    (8, "one two three four five six seven", "c"),
]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "en", s, len(t or ""), "clash", 1, 2.5) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size int, id double").repartition(3)


@pytest.fixture
def none(odd):
    return odd.limit(0)
