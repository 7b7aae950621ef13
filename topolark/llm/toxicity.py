"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its lower-cased words, their stems (first bytes), word pairs side by side and word
pairs with one or two words between, all hashed into 2**BITS slots and counted. FTRL-proximal keeps a
learning rate for each coordinate and drives the weights of uninformative slots to exactly zero (L1), so
that what remains is a short list of (slot, weight) that is broadcast and applied to every whole text.

Learning is sequential by nature. It runs in one task over a bounded sample of labelled rows, which a lost executor
merely restarts: at most ``most_rows`` documents, one row for each id, in the order of a seeded hash, and no more once
their features number MOST_FEATURES. Features are taken before, in parallel; scoring is a map over all rows.

Nulls and ties: a null or empty text has no features and gets the score of the bias alone; null labels and
labels of unknown documents are not learnt from; a document with several labels is toxic if one says so, one with
several texts is learnt by the smallest; repeated rows stay repeated. With nothing to learn from, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolark.llm.common import bounded_batches, bounded_rows, held_out, tally, word_chunks

#: Hash slots; the dense form of the weights is 8 MB.
BITS = 20
STEM = 4
#: Labelled documents learnt from, at most, and features of all of them.
MOST_ROWS, MOST_FEATURES = 9000, 1 << 25

#: ASCII punctuation and control bytes separate words.
WORDS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
KNUTH, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def slots(text: bytes | None) -> Iterator[np.ndarray]:
    """Hash slots of a text's features, repeats included, part by part."""
    tail = np.zeros(0, np.uint64)
    for words in word_chunks((text or b"").decode("utf-8", "replace").lower().encode().translate(WORDS)):
        new = np.fromiter(map(crc32, words), np.uint64, len(words))
        stem = np.fromiter([crc32(w[:STEM]) for w in words], np.uint64, len(words))
        word, old = np.concatenate((tail, new)), len(tail)
        kinds = [new, stem * MIX + np.uint64(1)]
        for gap in (1, 2, 3):
            second = max(gap, old)
            if len(word) > second:
                kinds.append(word[second - gap : len(word) - gap] * MIX + word[second:] * KNUTH + np.uint64(gap + 1))
        tail = word[-3:]
        yield ((np.concatenate(kinds) * KNUTH) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal: a rate for each coordinate, and L1 (one for all or for each), which sets weights to zero."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float | np.ndarray = 8.0):
        self.alpha, self.beta, self.l1 = alpha, beta, np.broadcast_to(np.asarray(l1, float), size)
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha))

    def step(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """One step along the gradient g at coordinates whose weights are w."""
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def counted(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text; slot 2**BITS is the bias."""
    at, n = tally(slots(text))
    return np.append(at, 1 << BITS), np.append(np.minimum(n, 3).astype(float), 1.0)


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) that are not zero. The bias has no penalty."""
    penalty = np.full((1 << BITS) + 1, 8.0)
    penalty[-1] = 0.0
    model = Ftrl(len(penalty), l1=penalty)
    for _ in range(epochs):
        for (at, x), y in zip(rows, labels):
            w = model.weights(at)
            model.step(at, w, (sigmoid(w @ x) - y) * x)
    w = model.weights()
    found = np.flatnonzero(w)
    return found, w[found]


def features_of(rows: DataFrame, label: str, take) -> DataFrame:
    """(doc_id, label, at, x) of rows (doc_id, label, text), by take(text), sorted in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                some = batch.slice(a, 64)
                taken = [take(t.as_py()) for t in some.column(2)]
                at, x = ([f[k] for f in taken] for k in range(2))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([v.astype(np.float32) for v in x], pa.list_(pa.float32()))], ["doc_id", label, "at", "x"])

    kept = rows.select("doc_id", F.col(label).cast("int").alias(label), "text")
    taken = kept.mapInArrow(run, f"doc_id long, {label} int, at array<int>, x array<float>")
    return taken.repartition(1).sortWithinPartitions(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id")


def gathered(batches: Iterator[pa.RecordBatch], most: int = MOST_FEATURES) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """(features, labels) of features_of()'s rows, as far as their features number no more than most."""
    rows, labels, held = [], [], 0
    for batch in batches:
        for label, at, x in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            held += len(at)
            if held > most:
                return rows, labels
            rows.append((np.array(at.values, np.int32), np.array(x.values, np.float32)))  # eight bytes a feature
            labels.append(label)
    return rows, labels


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights from ``labels`` (doc_id, toxic) of rows that are not held out."""
    bounded_batches(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = features_of(bounded_rows(docs, known, most_rows, seed), "toxic", counted)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = gathered(batches)
        at, w = learn(seen, toxic) if seen else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], ["at", "w"])

    model = rows.mapInArrow(fit, "at binary, w binary").collect()
    if not model:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.frombuffer(bytes(model[0].at), np.int32).astype(np.int64), np.frombuffer(bytes(model[0].w))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most 2**BITS pairs of 12 bytes, in practice some thousands

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << BITS) + 1)
        dense[shared.value[0]] = shared.value[1]
        for batch in batches:
            p = sigmoid(np.fromiter((total(dense, t.as_py()) + dense[-1] for t in batch.column(1)), float, batch.num_rows))
            if not len(shared.value[0]):
                p = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scored, "doc_id long, score double")


def total(dense: np.ndarray, text: bytes | None) -> float:
    """Weighted sum of a text; only slots with a weight are counted and capped."""
    at, n = tally(part[dense[part] != 0.0] for part in slots(text))
    return float(dense[at] @ np.minimum(n, 3))


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on) of every row."""
    scored = score(docs, train(docs.sparkSession, docs, labels, most_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
