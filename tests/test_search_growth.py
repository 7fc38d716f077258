"""What searches compute once a text and once a word."""

from tests.test_growth import plan
from websift.functions.lineage import cut
from websift.operators import search


def test_a_text_is_read_once_and_a_word_stemmed_once(spark):
    docs = spark.createDataFrame([(1, "The Cities' naïve cafés, K2 and a Kelvin"), (2, "the and"), (3, None), (4, "")], "doc_id long, text string")
    read = search.indexed(docs)
    assert plan(read).count("regexp_extract_all") == 1
    assert [(r.doc_id, r.content, r.length) for r in read.collect()] == [(1, ["cities", "k2", "kelvin"], 3)]
    assert "Aggregate" not in plan(search.vocabulary_of(cut(read)).filter("stem <> ''"))


def test_equal_texts_fill_in_once(spark):
    long = "candidate number one that is long enough to fill in"
    docs = spark.createDataFrame([(3, long), (1, long), (2, "apple pie"), (5, "the and of it, which it is not, as only those who are the same"), (4, long + " two")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "apple")], "query_id long, query string")
    found = search.candidates_for_model(docs, asked)
    assert [(r.query_id, r.n, r.doc, r.text) for r in found.orderBy("n").collect()] == [(7, 1, 2, "apple pie"), (7, 2, 1, long), (7, 3, 4, long + " two")]
    assert len([1 for line in plan(found).splitlines() if "Aggregate" in line and "text" in line]) == 0
