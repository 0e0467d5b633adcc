"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for each bit a binary classifier over
hashed byte trigrams is trained to tell the languages with a 1 from those with
a 0. A text's language is the codeword of least loss, each bit's logistic loss
weighted by how well its classifier separates the learning rows; where the two
best codewords are near, the text is flagged ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import fitting, textops

BUCKETS = 4096
#: Bound of the learning sample, shared evenly by the languages.
MOST_LEARNED = 3000
#: More languages than this are an error: a model has 4,097 weights for each of its bits, about ten a doubling of the languages.
MOST_LANGUAGES = 1000
STEPS, RATE, DECAY = 300, 0.1, 1e-4
CLEAR_MARGIN = 0.5


def trigram_features(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams (A-Z lower-cased) in each text."""
    out = np.zeros((len(column), BUCKETS), np.float32)
    for first, data, bounds in textops.chunks(column, most=256):
        rows = len(bounds) - 1
        counts = np.zeros(rows * BUCKETS, np.float32)
        if len(data) >= 3:
            low = textops.lower_ascii(data).astype(np.uint32)
            # digits and ASCII punctuation say nothing of a language
            low[(low < 97) | ((low > 122) & (low < 128))] = 32
            code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
            bucket = (code * np.uint32(2654435761)) >> np.uint32(20)
            row = np.repeat(np.arange(rows), np.diff(bounds))
            inside = (row[:-2] == row[2:]) & (code != 0x202020)
            counts = np.bincount(row[:-2][inside] * BUCKETS + bucket[inside], minlength=rows * BUCKETS)
        counts = counts.reshape(rows, BUCKETS)
        out[first : first + rows] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    return out


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and +1 for each class: all distinct splits up to 6 classes, else the best of 50 random codes."""
    if classes <= 6:
        masks = range(1, max(2, 1 << (classes - 1)))
        return np.array([[1 if c == 0 or not m >> (c - 1) & 1 else -1 for m in masks] for c in range(classes)])
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (classes, bits))
        least = (bits - (code @ code.T - 2 * bits * np.eye(classes)).max()) / 2
        if least > apart:
            best, apart = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, column: pa.Array) -> np.ndarray:
        margins = trigram_features(column) @ self.weights.astype(np.float32) + self.bias
        return (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(2)


def fit(rows: DataFrame, most: int = MOST_LEARNED) -> Model | None:
    """A model of rows (doc_id, text, lang) with lang not null, from a sample of about `most`; None without rows. Ids may be of any type."""
    known = rows.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is lang a column of languages?")
    if not languages:
        return None
    sample = fitting.one_text_each(fitting.sampled(known, "lang", max(1, most // len(languages)), "language"), "doc_id", "lang")
    got, x = fitting.features_of(sample, ["doc_id", "lang"], trigram_features)
    label = np.array([languages.index(v) for v in got.column("lang").to_pylist()])
    order = fitting.order_of(got.column("doc_id").to_pylist(), label.tolist())
    x, label = x[order].astype(np.float64), label[order]
    code = codewords(len(languages))
    aim = code[label]
    # each language weighs the same, however many rows it has
    weight = 1.0 / np.maximum(1, np.bincount(label, minlength=len(languages)))[label] / len(languages)

    w = fitting.adam(np.zeros((BUCKETS + 1, code.shape[1])), gradient(x, aim, weight), STEPS, RATE)
    right = (((x @ w[:-1] + w[-1]) * aim > 0) * weight[:, None]).sum(0)
    trust = np.clip(np.log((right + 1e-3) / (1 - right + 1e-3)), 0.05, None)
    del x, got
    textops.release()
    return Model(languages, code, w[:-1], w[-1], trust / trust.sum() * code.shape[1])


def gradient(x: np.ndarray, aim: np.ndarray, weight: np.ndarray):
    """The gradient of the weighted logistic loss of each bit, with half the decay."""

    def at(w):
        pull = -aim * fitting.logistic(-aim * (x @ w[:-1] + w[-1])) * weight[:, None]
        return np.vstack([x.T @ pull + DECAY * w[:-1], pull.sum(0, keepdims=True)])

    return at


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score (0 to 1, the share of the best codeword) and ambiguous.

    `und` with score 0 where the text is null or holds no letter, or nothing was
    learned. Other columns stay as they are, but those of the three names are replaced; every row is
    scored on its own, so repeated rows agree. With equal losses the first language in code point order is chosen.
    """
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    docs = docs.drop("lang_pred", "score", "ambiguous")
    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()).add("ambiguous", BooleanType())

    def run(batches):
        for batch in batches:
            n = len(batch)
            names, score, unclear = ["und"] * n, np.zeros(n), np.ones(n, bool)
            for at in range(0, n if model else 0, 1024):
                loss = model.losses(batch.column("text").slice(at, 1024))
                best = loss.argmin(1)
                share = np.exp(loss.min(1, keepdims=True) - loss)
                ranked = np.sort(loss, 1)
                names[at : at + 1024] = [model.languages[i] for i in best]
                score[at : at + 1024] = 1 / share.sum(1)
                if loss.shape[1] > 1:
                    unclear[at : at + 1024] = ranked[:, 1] - ranked[:, 0] < CLEAR_MARGIN
                else:
                    unclear[at : at + 1024] = False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(unclear)], schema.names)

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.mapInArrow(textops.released(run), schema)
    return found.withColumns(
        {
            "lang_pred": F.when(letters, F.col("lang_pred")).otherwise("und"),
            "score": F.when(letters, F.col("score")).otherwise(0.0),
            "ambiguous": F.when(letters, F.col("ambiguous")).otherwise(True),
        }
    )
