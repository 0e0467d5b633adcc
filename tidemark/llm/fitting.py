"""Shared parts of the trained operators: sampling labelled rows, gradient descent, scoring whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tidemark.llm import tables, textops


def fold(modulus: int) -> Column:
    """crc32(doc_id as text) mod `modulus`; a null doc_id counts as the text null."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % modulus


def sampled(rows: DataFrame, strata: str, most: int, seed: str) -> DataFrame:
    """At most about `most` rows of each stratum, by a hash of doc_id.

    A row stays if its hash, as a fraction, is below most / rows of its stratum.
    The strata's counts are one row each; they are sent to every task if they
    are few enough, so no stratum's rows meet in one.
    """
    share = tables.small(rows.groupBy(strata).agg(F.least(F.lit(1.0), F.lit(float(most)) / F.count("*")).alias("_share")), "shares")
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(share, strata).filter(part < F.col("_share")).drop("_share")


def one_text_each(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys and the least text of the rows that share them, so a doc_id that many rows repeat enters a sample once."""
    return rows.groupBy(*keys).agg(F.min("text").alias("text"))


def order_of(ids: list, *then: list) -> np.ndarray:
    """The places of rows in the order of their ids, of any one type, nulls first, and of what follows."""
    return np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, *[t[i] for t in then])), np.int64)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def adam(start: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def features_of(texts: DataFrame, keep: list[str], features: Callable[[pa.Array], np.ndarray]) -> tuple[pa.Table, np.ndarray]:
    """The `keep` columns and float32 feature rows of a bounded table with a text column, on the driver."""
    schema = StructType([f for f in texts.schema.fields if f.name in keep]).add("_x", "binary")

    def run(batches):
        for batch in batches:
            x = features(batch.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in schema.fields[:-1]], pa.array([r.tobytes() for r in x], pa.binary())], schema.names)

    got = texts.select(*schema.names[:-1], "text").mapInArrow(textops.released(run), schema).toArrow()
    parts = [np.frombuffer(value.as_buffer(), np.float32) for value in got.column("_x")]
    x = np.stack(parts) if parts else np.zeros((0, 0), np.float32)
    return got.drop_columns("_x"), x


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], column: str = "score") -> DataFrame:
    """docs, all rows and columns, with score(text) as a double column; a column of that name is replaced."""
    docs = docs.drop(column)
    schema = StructType([*docs.schema.fields]).add(column, DoubleType())

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(batch.column("text")), pa.float64())], schema.names)

    return docs.mapInArrow(textops.released(run), schema)
