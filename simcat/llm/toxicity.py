"""Toxicity scores from an FTRL-proximal logistic regression over hashed n-grams.

Features of a text are the set of its words, word pairs and skip pairs (one word left out),
hashed into 2 ** BITS coordinates. FTRL-proximal gives every coordinate its own learning rate and
sets those whose gradient sum stays within the L1 bound to exactly zero, so the model is a short
list of (coordinate, weight), at most 2 ** BITS of them, that is broadcast to the scoring tasks.

Training reads at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of
their id, in that order, in one task of bounded size; scoring reads every text whole.

Defined results: null and empty texts have no features and get the intercept's score; labels that
are null, or of unknown documents, are ignored; of rows with equal ids training takes the smallest
text, and any toxic label counts; without labels nothing is known to be toxic and every score is
next to 0; equal texts get
equal scores; an empty table stays empty; extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, materialise

BITS = 20
#: Labelled documents that training reads at most.
TRAIN_ROWS = 16384
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 20.0, 0.1
#: Times that a toxic example counts.
TOXIC_WEIGHT = 4.0
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Log-odds beyond which a probability is taken as certain.
_FAR = 35.0
#: Odd multipliers that mix the hashes of the words of a feature.
_MIX = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263))


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Coordinates of a text's words, word pairs and skip pairs, with repeats."""
    words = _WORD.findall((text or "").lower().encode())
    h = np.fromiter(map(crc32, words), np.uint32, len(words))
    a, b, c, d = _MIX
    shift = np.uint32(32 - bits)
    pair = (h[:-1] * b + h[1:] * c + np.uint32(1)) * d
    skip = (h[:-2] * c + h[2:] * b + np.uint32(2)) * d
    return np.concatenate([h * a, pair ^ (pair >> np.uint32(15)), skip ^ (skip >> np.uint32(15))]) >> shift


class Ftrl:
    """FTRL-proximal for logistic loss over sets of coordinates; the last one is the intercept."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, toxic_weight: float = TOXIC_WEIGHT):
        self.alpha, self.beta, self.l1, self.l2, self.toxic_weight = alpha, beta, l1, l2, toxic_weight
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.where(np.abs(z) <= self.l1, 0.0, np.sign(z) * self.l1 - z)
        return shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, coordinates: np.ndarray, label: int) -> None:
        at = np.r_[coordinates, len(self.z) - 1]
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -_FAR, _FAR))) - label) * (self.toxic_weight if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, epochs: int = EPOCHS, bits: int = BITS) -> DataFrame:
    """(coordinate, weight): the weights that aren't zero; coordinate 2 ** bits is the intercept."""
    truth = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    picked = truth.join(source.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(rows)
    picked = materialise(picked, "toxic-picked")
    texts = source.join(picked, "id").groupBy("id", "y").agg(F.min("t").alias("t"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen = [(np.unique(features(t, bits)).astype(np.int32), y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        model = Ftrl(bits)
        for _ in range(epochs if seen else 0):
            for x, y in seen:
                model.learn(x, y)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], names=["coordinate", "weight"])

    alone = texts.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("t", "y")
    return alone.mapInArrow(fit, "coordinate int, weight double")


def score(docs: DataFrame, model: DataFrame, text: str = "text", name: str = "score", bits: int = BITS) -> DataFrame:
    """``docs`` with the probability of label 1."""
    dense = np.zeros((1 << bits) + 1, np.float32)
    rows = model.collect()  # 2 ** bits + 1 at most
    dense[-1] = -_FAR if not rows else 0
    for at, w in rows:
        dense[at] = w
    sent = docs.sparkSession.sparkContext.broadcast(dense)

    def rate(texts: pd.Series) -> pd.Series:
        let_go()
        w = sent.value
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            x = features(t, bits)
            x = np.unique(x[w[x] != 0])
            out[i] = 1 / (1 + np.exp(-np.clip(np.sort(w[x].astype(np.float64)).sum() + w[-1], -_FAR, _FAR)))
        return pd.Series(out)

    return docs.withColumn(name, F.pandas_udf(rate, "double")(F.col(text)))


def held_out(key: str = "doc_id", folds: int = 5):
    """Rows whose labels are never learnt: crc32 of the id as text, modulo the folds, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_and_score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", name: str = "score") -> DataFrame:
    """``docs`` with scores of a model trained on the labelled rows that aren't held out."""
    model = materialise(train(docs, labels.filter(~held_out(key)), key, text, label), "toxic-model")
    return score(docs, model, text, name)
