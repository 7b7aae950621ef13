import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topolark.llm import quality, toxicity
from topolark.llm.common import bounded_rows, held_out

WORDS = [f"word{k}" for k in range(200)]


def made(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = list(rng.choice(WORDS, rng.integers(5, 80)))
        toxic = k % 5 == 0
        if toxic:
            words.insert(len(words) // 2, "vilename" if k % 2 else "awfulthing")
        low = k % 7 == 0
        text = " ".join(w.upper() + "!!" for w in words) if low else " ".join(words).capitalize() + "."
        rows.append((k, text, int(toxic), int(not low)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(k, t, "extra") for k, t, *_ in rows] + [(5000, None, ""), (5001, "", ""), (None, "word1", ""), (3, rows[3][1], "")], "doc_id long, text string, tail string")
    labels = spark.createDataFrame([(k, q, t) for k, _, t, q in rows] + [(None, 1, 0), (9999, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_generalizes_and_covers_all_rows(spark):
    rows = made(900, 1)
    docs, labels = tables(spark, rows)
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == docs.count()
    truth = {k: t for k, _, t, _ in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 200
    assert np.mean([p == t for p, t in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)


def test_toxicity_without_anything_to_learn(spark):
    docs, labels = tables(spark, made(10, 2))
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_no_held_out_label_reaches_the_model(spark):
    rows = made(300, 3)
    docs, labels = tables(spark, rows)
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda r: (str(r.doc_id), r.score)
    assert sorted(map(key, toxicity.toxicity(docs, labels).collect())) == sorted(map(key, toxicity.toxicity(docs, flipped).collect()))


def test_weights_are_sparse():
    rows = made(900, 4)
    at, w = toxicity.learn([toxicity.counted(t.encode()) for _, t, *_ in rows], [y for *_, y, _ in rows])
    assert 0 < len(at) < 2000 and np.isfinite(w).all()


class PlainFtrl:
    """FTRL-proximal by plain loops over dictionaries."""

    def __init__(self, alpha, penalty):
        self.alpha, self.penalty, self.z, self.n = alpha, penalty, {}, {}

    def weight(self, i):
        z, l1 = self.z.get(i, 0.0), self.penalty(i)
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((1.0 + math.sqrt(self.n.get(i, 0.0))) / self.alpha)

    def step(self, w, slope, row):
        for i, x in row.items():
            g, n = slope * x, self.n.get(i, 0.0)
            self.z[i] = self.z.get(i, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w[i]
            self.n[i] = n + g * g


def plain_sigmoid(v):
    return 1.0 / (1.0 + math.exp(-v))


def test_toxicity_fit_equals_plain_loops():
    rows = made(120, 8)
    bias = 1 << toxicity.BITS
    counts = [toxicity.counted(t.encode()) for _, t, *_ in rows]
    at, w = toxicity.learn(counts, [y for _, _, y, _ in rows])
    plain = PlainFtrl(1.0, lambda i: 0.0 if i == bias else 8.0)
    for _ in range(4):
        for (ids, x), (_, _, y, _) in zip(counts, rows):
            row = dict(zip(ids.tolist(), x.tolist()))
            now = {i: plain.weight(i) for i in row}
            plain.step(now, plain_sigmoid(sum(now[i] * x for i, x in row.items())) - y, row)
    expected = {i: v for i in plain.z if (v := plain.weight(i))}
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx(expected, abs=1e-9)


def plain_slots(text):
    """Counts of a text's features by plain loops."""
    words, mask = re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower().encode()), (1 << 64) - 1
    hashed = [crc32(w) for w in words]
    values = [*hashed, *(crc32(w[:4]) * int(toxicity.MIX) + 1 for w in words)]
    values += [hashed[i] * int(toxicity.MIX) + hashed[i + gap] * int(toxicity.KNUTH) + gap + 1 for gap in (1, 2, 3) for i in range(len(words) - gap)]
    return Counter((v * int(toxicity.KNUTH) & mask) >> (64 - toxicity.BITS) for v in values)


@pytest.mark.parametrize("size", [1, 5, 40, 1 << 20])
def test_features_by_parts_are_those_of_the_whole_text(monkeypatch, size):
    text = "Some words, some 12 OTHER words; é word word word -- x\ty\n z " * 5
    parts = toxicity.word_chunks
    monkeypatch.setattr(toxicity, "word_chunks", lambda t: parts(t, size))
    monkeypatch.setattr(quality, "word_chunks", lambda t: parts(t, size))
    at, n = toxicity.tally(toxicity.slots(text.encode()))
    assert dict(zip(at.tolist(), n.tolist())) == plain_slots(text)
    at, x = quality.shape_shares(text.encode(), quality.Shapes())
    monkeypatch.undo()
    whole = quality.shape_shares(text.encode(), quality.Shapes())
    assert at.tolist() == whole[0].tolist() and x.tolist() == pytest.approx(whole[1].tolist())


def test_quality_fit_equals_plain_loops():
    rows, shapes, levels = made(120, 9), quality.Shapes(), 3
    counts = [quality.features(t.encode(), shapes) for _, t, *_ in rows]
    grades = [0 if not q else 1 if t else 2 for _, _, t, q in rows]
    w, thresholds = quality.fit(counts, grades, levels)
    plain, cuts, squares = PlainFtrl(0.5, lambda i: quality.SHAPE_L1 if i < 1 << quality.BITS else quality.WORD_L1), [-2.0, 0.0], [1.0, 1.0]
    for _ in range(8):
        for (ids, x), grade in zip(counts, grades):
            row = dict(zip(ids.tolist(), x.tolist()))
            now = {i: plain.weight(i) for i in row}
            s = sum(now[i] * x for i, x in row.items())
            upper, lower = (plain_sigmoid(cuts[grade] - s) if grade < 2 else 1.0), (plain_sigmoid(cuts[grade - 1] - s) if grade else 0.0)
            p = max(upper - lower, 1e-9)
            plain.step(now, (upper * (1 - upper) - lower * (1 - lower)) / p, row)
            slopes = [0.0, 0.0]
            if grade < 2:
                slopes[grade] -= upper * (1 - upper) / p
            if grade:
                slopes[grade - 1] += lower * (1 - lower) / p
            squares = [a + g * g for a, g in zip(squares, slopes)]
            cuts = [c - 0.1 * g / math.sqrt(a) for c, g, a in zip(cuts, slopes, squares)]
            cuts[1] = max(cuts[1], cuts[0] + quality.GAP)
    assert thresholds.tolist() == pytest.approx(cuts, abs=1e-9)
    assert {i: v for i, v in enumerate(w.tolist()) if v} == pytest.approx({i: v for i in plain.z if (v := plain.weight(i))}, abs=1e-9)


def test_all_three_grades_are_told_apart(spark):
    rows = made(1500, 10)
    docs, labels = tables(spark, rows)
    model = quality.train(docs, quality.grades_of(labels), 3)
    grade = F.when(F.col("tail")[0] < 0.5, 0).when(F.col("tail")[1] < 0.5, 1).otherwise(2)
    rated = quality.rate(docs.drop("tail"), model, 3, ["doc_id"]).where(held_out(F.col("doc_id"))).select("doc_id", grade.alias("grade")).collect()
    truth = {k: 0 if not q else 1 if t else 2 for k, _, t, q in rows}
    for g in range(3):
        mine = [r.grade == g for r in rated if truth.get(r.doc_id) == g]
        assert len(mine) > 30 and np.mean(mine) > 0.8, g


def test_training_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b a"), (1, "a b"), (1, "a b"), (2, None), (3, "c")] + [(4, "hot")] * 50, "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "doc_id long, y int")
    assert sorted((r.doc_id, r.y, r.text) for r in bounded_rows(docs, known, 9, 1).collect() if r.text) == [(1, 1, b"a b"), (3, 1, b"c"), (4, 0, b"hot")]
    assert bounded_rows(docs, known, 2, 1).count() == 2
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 1, 0]), pa.array([[1, 2], [3], [4, 5]], pa.list_(pa.int32())), pa.array([[1.0, 2.0], [3.0], [4.0, 5.0]], pa.list_(pa.float32()))], ["doc_id", "y", "at", "x"])
    assert [at.tolist() for at, _ in toxicity.gathered(iter([batch]), 4)[0]] == [[1, 2], [3]]
    assert toxicity.gathered(iter([batch]))[1] == [0, 1, 0]


def test_equal_scores_of_equal_texts(spark):
    docs, labels = tables(spark, made(60, 11))
    docs = docs.union(docs)
    scores = {}
    for r in toxicity.toxicity(docs, labels).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        scores.setdefault((r.doc_id, r.text), set()).add(r.score)
    assert all(len(s) == 1 for (k, _), s in scores.items() if k != 3)


def test_quality_selects_by_tail_probability(spark):
    rows = made(700, 5)
    docs, labels = tables(spark, rows)
    kept = quality.select_quality(docs, quality.grades_of(labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    low = {k for k, _, _, q in rows if q == 0}
    fine = {k for k, _, _, q in rows if q == 1}
    assert len(fine - ids) <= 0.01 * len(fine) and len(low & ids) <= 0.05 * len(low)
    assert {5000, 5001, None} <= ids
    assert {r.tail for r in kept.where("doc_id in (1, 2)").collect()} == {"extra"}


def test_tails_are_ordered_and_expected_grade_adds_them(spark):
    rows = made(400, 6)
    docs, labels = tables(spark, rows)
    docs = docs.drop("tail")
    model = quality.train(docs, quality.grades_of(labels), 3)
    assert model[2][0] < model[2][1]
    for r in quality.rate(docs, model, 3).withColumn("e", quality.expected_grade(F.col("tail"))).collect():
        assert r.tail[0] >= r.tail[1] and abs(sum(r.tail) - r.e) < 1e-12


def test_quality_without_ratings_or_rows(spark):
    docs, labels = tables(spark, made(10, 7))
    assert quality.select_quality(docs, quality.grades_of(labels.limit(0))).count() == docs.count()
    assert quality.select_quality(docs.limit(0), quality.grades_of(labels)).count() == 0
