import numpy as np
from pyspark.sql import functions as F

from topolark.llm import ann


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-float(np.dot(np.float64(v), np.float64(x))), i) for i, x in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_matches_brute_force_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    good = [(k, rng.standard_normal(8).astype(np.float32).tolist()) for k in range(300)]
    copies = [(1000 + k, good[3][1]) for k in range(150)]
    bad = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [float("inf")] * 8), (None, good[5][1]), (2100, []), (2120, [1.0, 2.0]), good[7]]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + copies + bad], "vec_id long, embedding array<float>, rep int")
    found = {}
    for r in ann.neighbours(df, F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = good + copies
    expected = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert found.keys() == expected.keys()
    hits = total = 0
    for q, ranked in found.items():
        ranked.sort()
        assert [r for r, *_ in ranked] == list(range(1, 21))
        at = dict(rows)
        assert all(abs(s - float(np.dot(np.float64(at[q]), np.float64(at[v])))) < 1e-9 for _, v, s in ranked)
        assert [(-s, v) for _, v, s in ranked] == sorted((-s, v) for _, v, s in ranked)
        hits += len({v for _, v, _ in ranked} & {v for v, _ in expected[q]})
        total += 20
    assert hits / total >= 0.9
    # The copies tie with one another: the smallest ids come first.
    assert [v for _, v, _ in found[1000]][:20] == [3, *range(1001, 1020)]


def test_recall_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 256)
    monkeypatch.setattr(ann, "LEAF", 64)
    monkeypatch.setattr(ann, "BLOCK", 100)
    rng = np.random.default_rng(2)
    rows = [(k, (rng.standard_normal(16) * (1 + k % 3)).tolist()) for k in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.neighbours(df, F.col("vec_id") % 50 == 0, k=10).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    expected = brute(rows, [r for r in rows if r[0] % 50 == 0], 10)
    assert sum(len(found[q] & {i for i, _ in e}) for q, e in expected.items()) / (10 * len(expected)) >= 0.9
    assert all(len(v) == 10 for v in found.values())


def test_few_rows(spark):
    kind = "vec_id long, embedding array<double>"
    every = F.lit(True)
    assert ann.neighbours(spark.createDataFrame([], kind), every).count() == 0
    assert ann.neighbours(spark.createDataFrame([(1, [1.0, 0.0])], kind), every).count() == 0
    two = ann.neighbours(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 1.0])], kind), every).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in two) == [(1, 1, 2, 0.5), (2, 1, 1, 0.5)]


def test_answers_come_from_leaves(spark, monkeypatch):
    """Candidates are the vectors of the leaves taken: with one leaf a query, most neighbours are missed."""
    monkeypatch.setattr(ann, "LEAF", 16)
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)

    def recall():
        found = {}
        for r in ann.neighbours(df, F.col("vec_id") % 20 == 0, k=10).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        return sum(len(found.get(q, set()) & {i for i, _ in e}) for q, e in expected.items()) / (10 * len(expected))

    assert recall() >= 0.9
    every = ann.Forest.search
    monkeypatch.setattr(ann.Forest, "search", lambda self, margins, sizes, enough: every(self, margins, sizes, enough)[:1])
    assert recall() < 0.5


def test_hot_vector_repeated_ids_and_lengths(spark):
    hot, far = [3.0, 0.0], [0.0, 1.0]
    rows = [(k, hot) for k in range(400)] + [(1000, far), (1000, [0.0, 2.0]), (1001, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.neighbours(df, (F.col("vec_id") % 2 == 0), k=3).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {*range(0, 400, 2), 1000}
    assert sorted(found[0]) == [(1, 1, 9.0), (2, 2, 9.0), (3, 3, 9.0)] and sorted(found[2]) == [(1, 0, 9.0), (2, 1, 9.0), (3, 3, 9.0)]
    # An id with two vectors asks with both; its own rows are never among its neighbours.
    assert sorted(found[1000]) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]
    tied = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [1.0, 1.0]), (4, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in ann.neighbours(tied, F.lit(True)).collect()) == [(3, 4), (4, 3)]
