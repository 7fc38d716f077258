"""Character references without a semicolon: as the SQL of the registered queries reads them, and as browsers do."""

import duckdb
import pytest

from tests.test_queries import plain
from websift.operators import onpage
from websift.plans import registry
from websift.sources.pages import as_pages

BODY = '<html lang="en"><head><title>{}</title></head><body><h1>{}</h1><a href="/x?a=1&b=2">{}</a></body></html>'
HTML = (
    BODY.format("Shared by two of.&amp;&amp;&amp", "Head&amp", "word " * 113),  # 120 words, the two unclosed ones among them
    BODY.format("Shared by two of.&amp;&amp;&amp", "Head&amp;", "word " * 117),
    BODY.format("Shared by two of.&amp;&amp;&amp;", "Head &copy; &middot", "word " * 113),
    BODY.format("A title of &quot;some length&quot;, then sixty", "Head &quot;x&quot;", "word " * 108),
    BODY.format("A title of &quot;some length&quot;, then sixty", "Head", "word " * 109),
    BODY.format("Its own, to the end", "Head", "word " * 200) + "<p>cut off &amp",
)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("references"))
    rows = [(i, f"https://a.example.com/{i}", html) for i, html in enumerate(HTML)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["page_findings", "title_findings", "duplicate_titles", "thin_content", "severity_rollup"])
def test_open_references_as_in_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet/*.parquet'")
    asked = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in asked.description]
    df = registry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(asked.fetchall(), names)


def test_open_references_as_in_browsers(spark, sf_dir):
    pages = as_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert {r.title for r in onpage.facts_of(pages).filter("seq < 3").collect()} == {"Shared by two of.&&&"}
