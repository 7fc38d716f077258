"""A corpus pipeline of five stages, each written as Parquet and read back as the next one's documents.

language ID -> near-duplicate removal -> secret redaction -> source mixing -> BPE encoding
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websift.llm import bpe, jaccard, langid, mixing, secrets
from websift.llm.common import drop_table, finished, fresh_path, marked, sized
from websift.llm.queries import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected where fewer of its n-grams than this belong to the language that it is most like.
LEAST_COVERAGE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language: null, without letters, or like none of the learned ones.

    Repeated rows are kept or rejected together; an empty table gives no rows.
    """
    model = langid.learn(docs.filter(~langid.held_out() & F.col("doc_id").isNotNull()))
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("coverage") >= LEAST_COVERAGE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of documents linked by 5-word shingles at a similarity of 0.8 or more.

    Rows that share an id are kept or dropped together; rows without an id stay. Most documents that stay are told by a
    small filter of the ids to drop where they are read; the others meet those ids themselves, by a join as the planner
    sees fit.
    """
    groups = jaccard.similar_documents(docs, 5, 80, 100)
    dropped = finished(groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "stage-dropped", groups)
    own = marked(docs.select(*COLUMNS), "doc_id", dropped, "met")
    doubtful = own.filter("met").select(*COLUMNS).join(dropped, "doc_id", "left_anti")
    return sized(own.filter("not met").select(*COLUMNS).unionByName(doubtful), docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace found secrets by a mark; every document stays, and n_chars follows its text. Repeated rows agree; an empty table gives no rows."""
    found = secrets.redact(secrets.scan(docs.select(*COLUMNS), secrets.fit_corpus(docs)))
    chars = F.when(F.size("secrets") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", chars).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents as the mix takes them: as many copies as taken / size, rounded; none of what it leaves out.

    Rows that share an id and a source are copied alike, null ids among them; texts without words have no copy to take.
    """
    return sized(mixing.mixed_copies(docs.select(*COLUMNS)), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every whole text: doc_id, lang, source, n_tokens, ids (packed little-endian unsigned 32-bit integers).

    Null texts give no tokens; repeated rows agree; an empty table gives no rows.
    """
    return bpe.encode_documents(docs, vocabulary_path(), keep=("lang", "source"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_redaction),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding", encoding),
]

#: SQL can express neither the learned filters and forest nor the merges of BPE; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; every stage's result is a table in the shared folder, deleted once the next one is written."""
    docs = given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if docs is not given:
            drop_table(docs)
        docs = spark.read.parquet(path)
    return docs
