"""Quality classification by positive-unlabelled learning.

Trusted positives (documents labelled 1) and unlabelled web text (any
documents) train a linear scorer by the non-negative unbiased risk: with prior
p, p * loss(positives, +) plus the unlabelled loss(-) less p * loss(positives, -),
the latter difference kept from going below zero by stepping back whenever it
does. The prior is estimated: as the share of 1 among the learnable labels where some
are 0 (they serve for nothing else), and from positives and unlabelled alone where none is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import fitting, textops

#: Bounds of the learning sample.
MOST_POSITIVE, MOST_UNLABELLED = 8000, 8000
STEPS, RATE, DECAY = 800, 0.05, 1e-4
CLASSES = 24
EXTRA = 6


def _byte_classes() -> np.ndarray:
    """A class for each byte: kinds of letters, digits, spaces, breaks, and frequent signs by themselves."""
    kind = np.full(256, 2, np.int64)  # other signs
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[128:] = 3
    kind[ord("0") : ord("9") + 1] = 4
    kind[32], kind[10] = 5, 6
    for i, sign in enumerate(b".,;:!?|#$%&*@/<>-"):
        kind[sign] = 7 + i
    return kind


_KIND = _byte_classes()


def style_features(column: pa.Array) -> np.ndarray:
    """Shares of pairs of neighbouring byte classes, and six shapes of each text: a row of floats."""
    pairs = CLASSES * CLASSES
    out = np.zeros((len(column), pairs + EXTRA), np.float32)
    for first, data, bounds in textops.chunks(column, most=512):
        rows, length = len(bounds) - 1, np.diff(bounds)
        row = np.repeat(np.arange(rows), length)
        kind = _KIND[data]
        same = row[:-1] == row[1:]
        count = np.bincount(row[:-1][same] * pairs + kind[:-1][same] * CLASSES + kind[1:][same], minlength=rows * pairs).reshape(rows, pairs)
        x = out[first : first + rows]
        x[:, :pairs] = np.sqrt(count / np.maximum(1, count.sum(1, keepdims=True)))
        of, words = textops.space_words(data, bounds)
        total = np.bincount(of, minlength=rows)
        order = np.lexsort((words, of))
        fresh = np.ones(len(of), bool)
        fresh[1:] = (of[order][1:] != of[order][:-1]) | (words[order][1:] != words[order][:-1])
        distinct = np.bincount(of[order][fresh], minlength=rows)
        line_of, start, end = textops.spans(data != 10, bounds)
        lines = np.bincount(line_of, minlength=rows)
        marks = textops.span_hashes(data, start, end)
        order = np.lexsort((marks, line_of))
        again = np.zeros(len(line_of), bool)
        again[1:] = (line_of[order][1:] == line_of[order][:-1]) & (marks[order][1:] == marks[order][:-1])
        repeated = np.bincount(line_of[order][again], minlength=rows)
        n = np.maximum(1, total)
        x[:, pairs] = np.log1p(total) / 10
        x[:, pairs + 1] = distinct / n
        x[:, pairs + 2] = repeated / np.maximum(1, lines)
        x[:, pairs + 3] = np.minimum(40, length / n) / 40
        x[:, pairs + 4] = np.log1p(lines) / 10
        x[:, pairs + 5] = total == 0
    return out


@dataclass
class Model:
    weights: np.ndarray
    prior: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for at in range(0, len(column), 2048):
            x = style_features(column.slice(at, 2048)).astype(np.float64)
            out[at : at + 2048] = fitting.logistic(x @ self.weights[:-1] + self.weights[-1])
        return out


def risk_gradient(positive: np.ndarray, unlabelled: np.ndarray, prior: float):
    """(the non-negative part of the risk, the gradient to step by) at given weights, bias last.

    The gradient is that of the whole risk, prior * loss(positive, +) + loss(unlabelled, -) - prior * loss(positive, -),
    while the difference of the last two is 0 or more, and that of the negated difference while it is below; half the decay is added.
    """
    p, u = (np.asarray(x, np.float32) for x in (positive, unlabelled))

    def mean(x, v):
        # products only, so no table of the sample's size is made in a step
        v = v.astype(np.float32)
        return np.append(v @ x, v.sum()).astype(np.float64) / len(x)

    def at(w):
        weights = w[:-1].astype(np.float32)
        fp, fu = (x @ weights + np.float32(w[-1]) for x in (p, u))
        up = -prior * mean(p, fitting.logistic(-fp))
        negative = mean(u, fitting.logistic(fu)) - prior * mean(p, fitting.logistic(fp))
        risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        return risk, (up + negative if risk >= 0 else -negative) + np.append(DECAY * w[:-1], 0.0)

    return at


def fit_rows(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights (bias last) of least non-negative risk under the logistic loss."""
    at = risk_gradient(positive, unlabelled, prior)
    return fitting.adam(np.zeros(np.shape(positive)[1] + 1), lambda w: at(w)[1], STEPS, RATE)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from the two samples alone.

    A scorer is learned to tell one half of the positives from one half of the
    unlabelled. Of the other halves, whatever score is asked for, the unlabelled
    that reach it are at least the prior times the positives that do; the prior is the least ratio found, over
    scores that a twentieth of the positives or more reach.
    """
    w = fit_rows(positive[::2], unlabelled[::2], 0.5)
    p, u = (np.sort(np.asarray(x, np.float64)[1::2] @ w[:-1]) for x in (positive, unlabelled))
    if not len(p) or not len(u):
        return 0.5
    reached = np.arange(len(p), 0, -1) / len(p)
    ratio = (len(u) - np.searchsorted(u, p)) / len(u) / reached
    return float(np.clip(ratio[reached >= 0.05].min(), 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """A model from docs (doc_id, text) and the learnable labels (doc_id, quality).

    Null labels are left out; a document labelled twice counts as 1 if either says so.
    Ids may be of any type; with labels of 1 alone the prior is class_prior's.
    Without positives the model scores everything by the prior (0.5 without any label).
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.0)
    if not counts.get(1):
        flat = np.zeros(CLASSES * CLASSES + EXTRA + 1)
        flat[-1] = np.log(prior / (1 - prior))
        return Model(flat, prior)
    # both samples are of bounded size, so they may be sent to every task
    positive = F.broadcast(fitting.sampled(known.filter("quality = 1"), "quality", most_positive, "positive").select("doc_id"))
    texts = docs.select("doc_id", "text")
    total = texts.count()
    part = F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    unlabelled = texts.filter(part < most_unlabelled / max(1, total)).withColumn("kind", F.lit("u"))
    trusted = texts.join(positive, "doc_id", "left_semi").withColumn("kind", F.lit("p"))
    both = fitting.one_text_each(trusted.unionByName(unlabelled), "doc_id", "kind")
    got, x = fitting.features_of(both, ["doc_id", "kind"], style_features)
    kind = np.array(got.column("kind").to_pylist())
    order = fitting.order_of(got.column("doc_id").to_pylist())
    order = order[np.argsort(kind[order], kind="stable")]  # positives, then unlabelled
    kind, x = kind[order], x[order]
    first = int((kind == "p").sum())
    if not (kind == "u").any() or not (kind == "p").any():
        return Model(np.append(np.zeros(CLASSES * CLASSES + EXTRA), np.log(prior / (1 - prior))), prior)
    if not counts.get(0):
        prior = class_prior(x[:first], x[first:])
    model = Model(fit_rows(x[:first], x[first:], prior), prior)
    del x, got
    textops.release()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all rows and columns, with score (0 to 1; a column score is replaced). Null text scores as empty text; repeated rows score alike."""
    return fitting.scored(docs, model.score)
