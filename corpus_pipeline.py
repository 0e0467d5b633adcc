"""A training corpus from documents, stage by stage: STAGES, run and ORACLE_SQL.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs, extra ones included, whatever their names. Between stages the rows are
written and read again. Null and empty texts are texts without words: the quality model
scores them like others, the other filters keep them, the mix keeps them once. Repeated
rows are documents of their own to every stage but near_copies, which keeps one of them. An empty table
gives an empty result. The operators are imported by the stages that call them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score is 0.5 or more, by a model of the learnable labels.

    A null doc_id has no label and is scored by its text. Without labels every text has one score and either all stay or none.
    """
    from tidemark.llm import fitting, quality, tables

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fitting.fold(3) != 1)
    model = quality.fit(docs, labels)
    (score,) = tables.free_names(docs, "score")
    return fitting.scored(docs, model.score, score).filter(f"{score} >= 0.5").drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; documents without words all stay."""
    from tidemark.llm import jaccard_join

    return jaccard_join.first_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark passage."""
    from tidemark.llm import decontamination

    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them; null is a source like any other."""
    from tidemark.llm import mixing

    return mixing.repeat(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row; equal rows go to one shard, each with a slot."""
    from tidemark.llm import sharding

    return sharding.place(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Training and alignment can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    from tidemark.llm import tables

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = tables.written(docs, name)
    return docs
