"""The registered queries of these operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, codes, jaccard, langid, media, mixing, secrets, sharding, suffixes, topk, vectors, warc
from .common import as_bytes, table

#: The vocabulary that op2 and the pipeline encode with; a parameter of the operators.
VOCABULARY = "word_bpe_49k.json"
#: The two vocabularies that op12 aligns.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives, then read all records back by their index."""
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index).drop("payload")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document and decode its ids again, as digests."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), decode=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every byte of every document that a 100-byte string covers which also starts earlier."""
    kept = suffixes.remove_repeats(table(spark, sf_dir, "documents"), 100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), 4, 85, 100)


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link counts and components of all embeddings at a cosine of 0.9 or more."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents, sources weighing 5, 2, 1 in turn, none above 3 times its size."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put all documents into 16 shards of near equal bytes, equal texts together."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as a grey map, read it back and take its features."""
    stored = media.text_media(table(spark, sf_dir, "documents"))
    read = media.media_features(stored)
    return read.select(
        "doc_id", "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("dhash").alias("feature"),
        F.sha2("tile", 256).alias("tile_sha256"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of candidate secrets, and those that the forest keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit_corpus(docs))
    return found.select(
        "doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"),
        F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["start"], s["end"], s["kind"])), " ").alias("spans"),
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language with filters learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(~langid.held_out() & F.col("doc_id").isNotNull()))
    return langid.identify(docs.drop("lang"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "coverage")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by 8 codebooks of 16 entries, learned in 6 rounds, and their errors."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens that two vocabularies give every document."""
    return alignment.align_documents(table(spark, sf_dir, "documents"), *map(vocabulary_path, ALIGNED))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 other embeddings of the highest inner product, for every id divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc, "op2_bpe": op2_bpe, "op3_suffixes": op3_suffixes, "op4_jaccard": op4_jaccard, "op5_vectors": op5_vectors, "op6_mixing": op6_mixing,
        "op7_sharding": op7_sharding, "op8_media": op8_media, "op9_secrets": op9_secrets, "op10_langid": op10_langid, "op11_codes": op11_codes, "op12_alignment": op12_alignment,
        "op13_topk": op13_topk,
    }


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(octet_length(encode(html)), 0) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM p
)
SELECT page_id, trim(regexp_replace(url, '\\s+', ' ', 'g')) AS url, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response <> page_id THEN response END AS refers_to
FROM r JOIN pages USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": WARC_SQL}
