"""Toxicity by a counterfactual-regularised classifier.

Features are the presence of words, and of beginnings of words (stems that take many
endings), in the whole text: those whose presence
differs most between toxic and other learning rows, and the identity terms. The
loss is logistic, plus a penalty on the squared change of the score when the
identity terms of a learning text are swapped for other terms, so that a neutral
mention of a group weighs the same, and little, whichever group it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import fitting, tables, textops

#: Neutral names of groups, by kind; terms are swapped within a kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "deaf", "blind"),
)
#: Bounds of the learning sample (rows of each label) and of the features.
MOST_LEARNED, MOST_WORDS, LEAST_ROWS, LEAST_GAIN = 6000, 1000, 4, 10.0
#: Lengths, in bytes, of the beginnings of words that are features beside whole words.
BEGINNINGS = (4, 6, 8)
STEPS, RATE, DECAY, SWAP_PENALTY = 500, 0.05, 2e-5, 10.0


def word_keys(words: list[str]) -> np.ndarray:
    """The hashes that textops.letter_words gives to these words."""
    out = np.zeros(len(words), np.uint64)
    for _, data, bounds in textops.chunks(pa.array(words, pa.string())):
        rows, found = textops.letter_words(data, bounds)
        out[rows] = found
    return out


def beginning_keys(words: list[str]) -> np.ndarray:
    """The hashes of all that textops.letter_parts finds in these words."""
    found = [textops.letter_parts(data, bounds, BEGINNINGS)[1] for _, data, bounds in textops.chunks(pa.array(words, pa.string()))]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))


def _presence(column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of each feature word present in each text, once each; keys are sorted."""
    row_parts, feature_parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, data, bounds in textops.chunks(column):
        rows, words = textops.letter_parts(data, bounds, BEGINNINGS)
        if not len(keys) or not len(words):
            continue
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        hit = keys[at] == words
        pair = np.unique(rows[hit] * len(keys) + at[hit])
        row_parts.append(pair // len(keys) + first)
        feature_parts.append(pair % len(keys))
    return np.concatenate(row_parts), np.concatenate(feature_parts)


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        rows, features = _presence(column, self.keys)
        return fitting.logistic(np.bincount(rows, weights=self.weights[features], minlength=len(column))[: len(column)] + self.bias)


def gain(n: Column, a: Column, rows: float, toxic: float) -> Column:
    """Log likelihood ratio of a word that n of the rows have, a of them toxic."""

    def part(seen: Column, of: Column, share: float) -> Column:
        return seen * F.ln(F.greatest(seen, F.lit(1e-9)) / F.greatest(of * share, F.lit(1e-9)))

    share = toxic / max(rows, 1.0)
    n, a = n.cast("double"), a.cast("double")
    return part(a, n, share) + part(n - a, n, 1 - share) + part(toxic - a, rows - n, share) + part(rows - n - toxic + a, rows - n, 1 - share)


def choose_words(sample: DataFrame, rows: int, toxic: int, most: int = MOST_WORDS) -> np.ndarray:
    """The hashes of the words whose presence tells most of the label in sample (toxic, text), ties to the smaller hash.

    By log likelihood ratio, LEAST_GAIN at least: below it, in a vocabulary of
    tens of thousands, words differ by chance. Words are counted in Spark, each task's
    first; what comes to the driver is the chosen ones, whatever the texts' length.
    """

    def run(batches):
        for batch in batches:
            is_toxic = np.array(batch.column("toxic").to_pylist(), np.int64) == 1
            for first, data, bounds in textops.chunks(batch.column("text")):
                of, words = textops.letter_parts(data, bounds, BEGINNINGS)
                order = np.lexsort((words, of))
                of, words = of[order], words[order]
                fresh = np.ones(len(of), bool)
                fresh[1:] = (of[1:] != of[:-1]) | (words[1:] != words[:-1])
                keys, at = np.unique(words[fresh], return_inverse=True)
                n = np.bincount(at, minlength=len(keys))
                on = np.bincount(at, weights=is_toxic[first + of[fresh]], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(on)], ["word", "n", "a"])

    counts = sample.select("toxic", "text").mapInArrow(textops.released(run), "word long, n long, a long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    telling = counts.filter(F.col("n") >= LEAST_ROWS).withColumn("gain", gain(F.col("n"), F.col("a"), float(rows), float(toxic))).filter(F.col("gain") >= LEAST_GAIN)
    # unsigned order: ties go to the smaller hash
    best = telling.orderBy(F.desc("gain"), (F.col("word") < 0), "word").limit(most).select("word").toArrow()
    return np.sort(best.column("word").to_numpy().view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LEARNED, penalty: float = SWAP_PENALTY) -> Model:
    """A model from docs (doc_id, text) and the learnable labels (doc_id, toxic).

    Null labels are left out; a document labelled twice counts as toxic if either says so; ids may be of any type.
    With labels of one kind only, or none, all texts score alike.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    flat = (counts.get(1, 0) + 0.5) / (total + 1)
    flat = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(flat / (1 - flat))))
    if not counts.get(1) or not counts.get(0):
        return flat
    # of bounded size, so it may be sent to every task
    chosen = F.broadcast(fitting.sampled(known, "toxic", most, "toxicity"))
    sample = tables.written(fitting.one_text_each(docs.select("doc_id", "text").join(chosen, "doc_id"), "doc_id", "toxic"), "sample")
    found = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not found:
        return flat
    terms = [word_keys(list(kind)) for kind in IDENTITY_TERMS]
    # beginnings of the terms are left out: swapping a term must swap all that tells of it
    telling = np.setdiff1d(choose_words(sample, sum(found.values()), found.get(1, 0)), beginning_keys([t for kind in IDENTITY_TERMS for t in kind]))
    keys = np.union1d(telling, np.concatenate(terms))

    def run(batches):
        for batch in batches:
            rows, features = _presence(batch.column("text"), keys)
            cuts = np.searchsorted(rows, np.arange(len(batch) + 1))
            sets = [features[a:b].astype(np.uint16).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(sets, pa.binary())], ["doc_id", "toxic", "words"])

    # a row's features are at most two bytes for each of the keys
    got = sample.mapInArrow(textops.released(run), tables.schema_with(sample, ["doc_id", "toxic"], "words binary")).toArrow()
    order = fitting.order_of(got.column("doc_id").to_pylist())
    toxic = np.array(got.column("toxic").to_pylist(), np.int64)[order]
    x = np.zeros((len(order), len(keys)))
    for row, i in enumerate(order):
        x[row, np.frombuffer(got.column("words")[int(i)].as_buffer(), np.uint16)] = 1
    weight = np.where(toxic == 1, counts[1] / total / max(1, (toxic == 1).sum()), counts[0] / total / max(1, (toxic == 0).sum()))
    w = fitting.adam(np.zeros(len(keys) + 1), gradient(x, toxic, weight, swaps(x, [np.searchsorted(keys, kind) for kind in terms]), penalty), STEPS, RATE)
    del x, got
    textops.release()
    return Model(keys, w[:-1], float(w[-1]))


def swaps(x: np.ndarray, kinds: list[np.ndarray]) -> np.ndarray:
    """What the features lose when identity terms are swapped, a row for each learning text that has one; kinds are the terms' columns.

    A text's terms move on by one within their kind. A text of each term alone is
    added, so that every term is held near its kind even where no learning text has it.
    """
    swapped, changed = x.copy(), np.zeros(len(x), bool)
    for at in kinds:
        swapped[:, at] = np.roll(x[:, at], 1, axis=1)
        changed |= x[:, at].any(1)
    alone = np.zeros((sum(map(len, kinds)), x.shape[1]))
    moved, i = alone.copy(), 0
    for at in kinds:
        for j in range(len(at)):
            alone[i, at[j]] = moved[i, at[(j + 1) % len(at)]] = 1
            i += 1
    return np.vstack([(x - swapped)[changed], alone - moved])


def gradient(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, difference: np.ndarray, penalty: float):
    """The gradient of the weighted logistic loss, half the penalty times the mean squared change of the score, and half the decay."""
    decay = DECAY * np.ones(x.shape[1] + 1)
    decay[-1] = 0

    def at(w):
        pull = (fitting.logistic(x @ w[:-1] + w[-1]) - toxic) * weight
        swap = difference.T @ (difference @ w[:-1]) * (penalty / len(difference))
        return np.append(x.T @ pull + swap, pull.sum()) + decay * w

    return at


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all rows and columns, with score (0 to 1; a column score is replaced). Null text scores as empty text; repeated rows score alike."""
    return fitting.scored(docs, model.score)
