"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words (lower case, bare of punctuation), pairs of neighbours, and pairs with one word
between them, hashed to 2**BITS coordinates. Every coordinate has its own learning rate, and the L1 term keeps most
weights at zero; what is left is a short list of (coordinate, weight), broadcast to score every text.

The classifier learns from a bounded sample of the labelled documents (TRAIN_ROWS, TRAIN_FEATURES; which ones follows from a hash of the
doc_id), a few times over, in one executor task. Several labels of one document: the largest counts. Several rows with one
doc_id: the least text is learned from. Rows without a label or id are not learned from. Null and empty texts have no features: they get the
score of the bias. With no labels at all, every score is 0. Every row is scored, repeated ones and very long texts too. The whole row
travels as _row, so its columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, ship

BITS = 20
#: The sample that is learned from: so many documents at most, and of them, in the order of their hash, as many as have this many features in all.
TRAIN_ROWS, TRAIN_FEATURES = 15_000, 32_000_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1e-3
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Features:
    """text -> distinct coordinates, ascending."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        words = text.lower().encode("utf-8", "replace").split() if text else []
        known = self.known
        if len(known) > 300_000:
            known.clear()
        found = [*map(known.get, words)]
        if None in found:
            for w in set(words).difference(known):
                bare = w.strip(PUNCTUATION)
                known[w] = xxh3_64_intdigest(bare) | 1 if bare else 0
            found = [*map(known.get, words)]
        h = np.array(found, dtype=np.uint64)
        h = h[h != 0]
        if not len(h):
            return np.empty(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            parts = [mix64(h)]
            for step in (1, 2):
                if len(h) > step:
                    parts.append(mix64(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:] + np.uint64(step)))
        return np.unique((np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64))


class Ftrl:
    """Follow the regularised leader, proximal: per-coordinate sums z and n; the last coordinate is the bias."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == 1 << BITS, 0.0, L1)
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _feature_batches(batches):
    features = Features()
    for batch in batches:
        own = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), pa.array(own, pa.list_(pa.int64()))], names=["place", "label", "features"])


def _train_batches(batches):
    rows, room = [], TRAIN_FEATURES
    for b in batches:
        for f, y in zip(b.column("features").to_numpy(zero_copy_only=False) if room > 0 else (), b.column("label").to_pylist()):
            room -= len(f)
            if room >= 0:
                rows.append((np.asarray(f, dtype=np.int32), y))
    model = Ftrl()
    for _ in range(EPOCHS if rows else 0):
        for features, label in rows:
            model.learn(features, label)
    at = np.arange(len(model.z))
    w = model.weights(at)
    keep = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at[keep]), pa.array(w[keep])], names=["at", "weight"])


def train(docs: DataFrame, labels: DataFrame, learn_if: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> np.ndarray | None:
    """Dense weights (at most 2**BITS + 1 doubles) from labelled documents; None without any."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(learn_if)
        .groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
        .withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(TRAIN_ROWS)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # at most TRAIN_ROWS ids
    rows = rows.groupBy("id", "place", "label").agg(F.min("text").alias("text"))
    made = rows.select("place", "label", "text").mapInArrow(_feature_batches, "place long, label int, features array<long>")
    one = made.repartition(1).sortWithinPartitions("place", "label", F.hash("features"))
    got = one.mapInArrow(_train_batches, "at long, weight double").toPandas()  # weights that are not zero
    if not len(got):
        return None
    w = np.zeros((1 << BITS) + 1)
    w[got["at"].to_numpy()] = got["weight"].to_numpy()
    return w


def _score(shared):
    def run(batches):
        w, features = shared.value, Features()
        for batch in batches:
            total = np.array([w[features(t)].sum() + w[-1] for t in batch.column("_text").to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(score, pa.float64())], names=["_row", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_if: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """_row (the whole row) and score; learn_if is a condition on the labels' ids."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    w = train(docs, labels, learn_if, id_col, text_col, label_col)
    if w is None:
        return docs.select(row, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(w)
    return docs.select(row, F.col(text_col).cast("string").alias("_text")).mapInArrow(_score(shared), f"_row {docs.schema.simpleString()}, score double")


ship(__name__)
