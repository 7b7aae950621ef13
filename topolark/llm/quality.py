"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - w . x) with one weight vector w shared by all grades and ordered thresholds.
The features of a text are hashed: its words, their stems, and word pairs up to two words apart (those of the
toxicity model), and the shapes of its words (letters, capitals, digits and other signs, runs collapsed), pairs of
shapes side by side and whether a word repeats the one before, by the square root of their share in the text. The
expected grade is the sum of the tail probabilities P(grade >= j), which also serve selection.

The model is fitted row by row with FTRL-proximal for the weights (a penalty for each kind of feature) and AdaGrad for
the thresholds, in one task over a bounded sample of rated rows: at most ``most_rows`` documents, one row for each id, in
the order of a seeded hash, and no more once their features number MOST_FEATURES. Features are taken before, in
parallel. All rows are then scored in a map.

Nulls and ties: a null or empty text has no features and gets the tail probabilities of the thresholds alone;
rows without a rating are not learnt from; a document with several ratings has the lowest, one with several texts is
learnt by the smallest; repeated rows stay repeated. With nothing to learn from, every tail probability is 1, so that
nothing is rejected.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from topolark.llm import toxicity
from topolark.llm.common import beside_text, bounded_batches, bounded_rows, held_out, tally, with_text, word_chunks
from topolark.llm.toxicity import Ftrl, features_of, gathered, sigmoid

#: Slots of shapes, before those of words.
BITS = 14
SIZE = (1 << BITS) + (1 << toxicity.BITS)
#: Rated documents learnt from, at most.
MOST_ROWS = 9000
#: Weight of the shares of shapes, penalties of shapes and words, and least distance of thresholds.
SHARE, SHAPE_L1, WORD_L1, GAP = 10.0, 0.1, 8.0, 0.05

SHAPE = bytes(48 if 48 <= b <= 57 else 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
SPACES = bytes(32 if chr(b) in " \t\n\v\f\r" else b for b in range(256))
KNUTH = toxicity.KNUTH


class Shapes(dict):
    """Hash of a shape; shapes differ in few ways, so a word costs one look-up."""

    def __missing__(self, shape: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        found = self[shape] = crc32(bytes(k for k, _ in groupby(shape)))
        return found


def shape_slots(text: bytes | None, shapes: Shapes) -> Iterator[np.ndarray]:
    """Hash slots of the shapes of a text's words, of pairs of them and of repetitions, part by part."""
    last: list[bytes] = []
    for words in word_chunks((text or b"").translate(SPACES)):
        words, old = last + words, len(last)
        one = np.fromiter(map(shapes.__getitem__, [w.translate(SHAPE) for w in words]), np.uint64, len(words))
        again = np.fromiter(map(operator.eq, words[1:], words), np.uint64, max(0, len(words) - 1))
        every = np.concatenate((one[old:], one[:-1] * np.uint64(31) + one[1:] * np.uint64(17) + np.uint64(1), again + np.uint64(2)))
        last = words[-1:]
        yield ((every * KNUTH) >> np.uint64(64 - BITS)).astype(np.int64)


def shape_shares(text: bytes | None, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of the shapes of a text."""
    at, n = tally(shape_slots(text, shapes))
    return at, SHARE * np.sqrt(n / max(1, sum(map(len, word_chunks((text or b"").translate(SPACES))))))


def features(text: bytes | None, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text."""
    at, x = shape_shares(text, shapes)
    slots, n = tally(toxicity.slots(text))
    return np.concatenate((at, slots + (1 << BITS))), np.concatenate((x, np.minimum(n, 3)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], levels: int, epochs: int = 8, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds). Thresholds are moved apart where a step brings them out of order."""
    penalty = np.full(SIZE, WORD_L1)
    penalty[: 1 << BITS] = SHAPE_L1
    model, thresholds, squares = Ftrl(SIZE, alpha=0.5, l1=penalty), np.linspace(-2.0, 0.0, levels - 1), np.ones(levels - 1)
    for _ in range(epochs):
        for (at, x), grade in zip(rows, grades):
            w = model.weights(at)
            s = w @ x
            upper = sigmoid(thresholds[grade] - s) if grade < levels - 1 else 1.0
            lower = sigmoid(thresholds[grade - 1] - s) if grade else 0.0
            p = max(upper - lower, 1e-9)
            above, below = upper * (1 - upper) / p, lower * (1 - lower) / p
            model.step(at, w, (above - below) * x)
            g = np.zeros(levels - 1)
            if grade < levels - 1:
                g[grade] -= above
            if grade:
                g[grade - 1] += below
            squares += g * g
            thresholds = thresholds - rate * g / np.sqrt(squares)
            for j in range(1, levels - 1):
                thresholds[j] = max(thresholds[j], thresholds[j - 1] + GAP)
    return model.weights(), thresholds


def train(docs: DataFrame, ratings: DataFrame, levels: int, most_rows: int = MOST_ROWS, seed: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(slots, weights, thresholds) from ``ratings`` (doc_id, grade from 0 to levels - 1) of rows that are not held out."""
    bounded_batches(docs.sparkSession)
    known = ratings.where(F.col("grade").between(0, levels - 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    shapes = Shapes()
    rows = features_of(bounded_rows(docs, known, most_rows, seed), "grade", lambda text: features(text, shapes))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, grades = gathered(batches)
        if seen:
            w, thresholds = fit(seen, grades, levels)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (at, w[at], thresholds)], ["at", "w", "thresholds"])

    model = rows.mapInArrow(fitted, "at binary, w binary, thresholds binary").collect()  # at most SIZE pairs
    return (np.frombuffer(bytes(model[0].at), np.int64), np.frombuffer(bytes(model[0].w)), np.frombuffer(bytes(model[0].thresholds))) if model else None


def raw_score(w: np.ndarray, text: bytes | None, shapes: Shapes) -> float:
    at, x = shape_shares(text, shapes)
    return float(w[at] @ x) + toxicity.total(w[1 << BITS :], text)


def rate(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None, levels: int, keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns to keep) with tail: array of P(grade >= j) for j from 1 up."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select(*[c for c in keep or docs.columns if c != "tail"]).schema.add("tail", ArrayType(DoubleType()))
    names, place = schema.names, docs.columns.index("text")
    own = [docs.columns.index(c) for c in names[:-1]]

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, w = Shapes(), np.zeros(SIZE)
        if shared.value is not None:
            w[shared.value[0]] = shared.value[1]
        for batch in batches:
            if shared.value is None:
                tails = np.ones((batch.num_rows, levels - 1))
            else:
                s = np.array([raw_score(w, t.as_buffer().to_pybytes() if t.is_valid else None, shapes) for t in batch.column(place)])
                tails = sigmoid(s.reshape(-1, 1) - shared.value[2])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in own), pa.array(list(tails), pa.list_(pa.float64()))], names)

    return docs.mapInArrow(rated, schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """Ratings from the labels: 0 for low quality, 1 for good but toxic, 2 for good and not toxic."""
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2).alias("grade"))


def expected_grade(tail):
    return F.aggregate(tail, F.lit(0.0), lambda a, p: a + p)


def select_quality(docs: DataFrame, ratings: DataFrame, levels: int = 3, at_least: int = 1, most_rows: int = MOST_ROWS) -> DataFrame:
    """The documents whose grade is at_least that with a probability of a half or more; all columns kept."""
    model = train(docs, ratings, levels, most_rows)
    kept = rate(beside_text(docs), model, levels).where(F.col("tail")[at_least - 1] >= 0.5)
    return kept.select(*with_text(docs.columns))
