import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from topolark.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), most=3.0):
    """Water-filling by rounds of clamping: source -> target."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free = {}, set(order)
    while free:
        level = (sum(sizes.values()) - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight string, key_ long")


def data():
    rows = []
    for k in range(400):
        source = "hot" if k % 3 == 0 else None if k % 17 == 0 else ["a", "Zz", "é", "tiny", ""][k % 5]
        if source == "tiny" and k > 60:
            source = "a"
        rows.append((k, "word " * (1 + k * 7 % 90), source, "w", k))
    return rows + [(None, "no id here", "a", "w", 1), (900, None, "a", None, None), (901, "", "a", "", 0), (902, " \t\n", None, "", 0), (5, "again", "a", "", 0), (5, "again", "a", "", 0)]


def test_targets_and_takes(spark):
    rows = data()
    df = rows_of(spark, rows)
    found = mixing.mix(df).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, text, source, _, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORDS.findall(text or ""))
    expected = targets(sizes)
    taken = {}
    for r in found:
        assert r.size == len(WORDS.findall(r.text or ""))
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.times * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, target in expected.items():
        assert abs(taken[source] - target) <= max(3, 0.02 * target), (source, taken[source], target)
    again = {(r.doc_id, r.text, r.taken) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text, r.taken) for r in found}
    assert {r.key_ for r in found} == {r[4] for r in rows} and {r.weight for r in found} == {r[3] for r in rows}


def test_narrow_agrees_with_whole_rows(spark):
    df = rows_of(spark, data())
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, mixing.mix(df, narrow=True).collect())) == sorted(map(key, mixing.mix(df).collect()))


def test_one_source_and_no_rows(spark):
    df = rows_of(spark, [(k, "a b c", "only", "", 0) for k in range(9)])
    assert {r.taken for r in mixing.mix(df).collect()} == {3}
    assert mixing.mix(rows_of(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(rows_of(spark, [(1, None, None, "", 0)])).collect()] == [0]


def test_equal_rows_do_not_overshoot(spark):
    df = rows_of(spark, [(1, "w " * 10, "a", "", 0)] * 50 + [(2, "w " * 400, "b", "", 0)])
    out = mixing.mix(df).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert {r.source: r["sum(taken)"] <= r["max(target)"] + 1 for r in out if r.source == "a"} == {"a": True}


def greedy(rows, target, near):
    """(drawn places, gap) by one pass in order: what exceeds the rest is passed over, as long as more than near lacks."""
    gap, drawn, most = target, set(), target
    groups = {}
    for place, size in rows:
        groups.setdefault(place, []).append(size)
    for place in sorted(groups):
        if gap <= near * target and most != gap:
            break
        size, words = groups[place][0], sum(groups[place])
        if size > most:
            continue
        if words > gap:  # ends a round
            most = gap
            if gap <= near * target:
                break
            continue
        gap -= words
        drawn.add(place)
    return drawn, gap


def test_filling_equals_one_pass_in_order(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "w " * int(rng.integers(1, 60)), "ab"[k % 2], "", 0) for k in range(300)] + [(7, "w " * 3, "a", "", 0)] * 5
    df = rows_of(spark, rows)
    near = 0.0
    out = mixing.mix(df, weights=(1.0, 3.0), max_epochs=3.0, near=near).collect()
    places = {}
    for r in mixing.sized(df, 7).collect():
        places.setdefault(r.source, []).append((tuple(r.place_), r.size))
    of = {(r.doc_id, r.text): (r.times, r.target, r.source_size) for r in out}
    for source, some in places.items():
        target, size = next((r.target, r.source_size) for r in out if r.source == source)
        whole = int(target // size)
        drawn, gap = greedy(some, target - whole * size, near)
        extra = {tuple(r.place_) for r in mixing.sized(df, 7).where(F.col("source") == source).collect() if of[r.doc_id, r.text][0] > whole}
        assert drawn <= extra and len(extra - drawn) <= 1
        assert gap < 60


def test_one_very_long_document(spark):
    rows = [(k, "w " * (300 + k % 200), "a", "", 0) for k in range(500)] + [(900, "w " * 100000, "a", "", 0)] + [(k + 1000, "w " * 700, "b", "", 0) for k in range(400)]
    for seed in range(4):
        out = mixing.mix(rows_of(spark, rows), weights=(1.0, 3.0), seed=seed).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
        assert all(abs(r.taken - r.target) <= 0.005 * r.target for r in out), (seed, out)


def test_capped_source_draws_nothing_more(spark):
    rows = [(1, "a b", "small", "", 0), (2, "", "small", "", 0), (3, None, "small", "", 0)] + [(10 + k, "w " * 50, "big", "", 0) for k in range(20)]
    out = {r.doc_id: r for r in mixing.mix(rows_of(spark, rows), weights=(1.0, 5.0)).collect()}
    assert {out[k].times for k in (1, 2, 3)} == {3} and max(r.times for r in out.values()) <= 3


def test_sources_are_ordered_over_ranges(spark):
    names = [f"s{k:04d}" for k in range(500)] + ["é", "Z", "", "z", "\U0001f600", "￿"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "source string")
    found = {r.source: r.position for r in mixing.in_order(df, mixing.Scratch(spark)).collect()}
    assert found == {n: k for k, n in enumerate([*sorted(names), None])}
