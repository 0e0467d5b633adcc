"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    decontamination,
    embedding_dedup,
    fitting,
    jaccard_join,
    language_id,
    mixing,
    quality,
    sharding,
    token_counts,
    toxicity,
    warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous; learns where the fold isn't 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(fitting.fold(4) != 2))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fitting.fold(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    return embedding_dedup.near_copies(table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it leaks: doc_id, item_id, score, first_word, last_word."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return jaccard_join.join_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_pre_tokens, n_tokens."""
    return token_counts.counted(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharding.place(table(spark, sf_dir, "documents"), 40)


def _predicted(scored: DataFrame, modulus: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id", (fitting.fold(modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; learns labels where the fold isn't 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(fitting.fold(3) != 1))
    return _predicted(quality.score(docs, model), 3, 1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; learns labels where the fold isn't 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fitting.fold(5) != 0))
    return _predicted(toxicity.score(docs, model), 5, 0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_language_id, op3_embedding_dedup, op4_decontamination, op5_ngram_jaccard_join,
        op6_token_counts, op7_sharding, op8_quality, op9_toxicity, op10_warc,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.SQL, "op3_embedding_dedup": embedding_dedup.SQL, "op5_ngram_jaccard_join": jaccard_join.SQL, "op7_sharding": sharding.SQL, "op10_warc": warc.SQL,
}
