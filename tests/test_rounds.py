"""Decisions by rounds against going through the rows one by one."""

import math

import numpy as np
import pytest

from topolark.operators import network, rounds


def one_by_one(points, reach, last):
    """home of each point (ord, x, y)."""
    found, homes = [], {}
    for order, x, y in sorted(points):
        home = next((c for c in found if math.dist((x, y), c[-1 if last else 0][1:]) <= reach), None)
        if home is None:
            home = []
            found.append(home)
        home.append((order, x, y))
        homes[order] = home[0][0]
    return homes


@pytest.mark.parametrize("n, spread", [(60, 100.0), (300, 100.0), (300, 20.0), (200, 1.0)])
def test_clusters_equal_the_loop(spark, n, spread):
    """Thin and dense points, repeated ones and ones at exactly the reach."""
    rng = np.random.default_rng(n)
    points = [(f"d{k % 2}", k, float(x), float(y)) for k, (x, y) in enumerate(np.round(rng.uniform(0, spread, (n, 2)) / 3) * 3)]
    df = spark.createDataFrame(points, "drawing_id string, ord long, x double, y double")
    for run, last in ((rounds.by_leader, False), (rounds.by_last_member, True)):
        found = {(r.drawing_id, r.ord): r.home for r in run(df, 15.0).collect()}
        want = {(d, k): home for d in ("d0", "d1") for k, home in one_by_one([p[1:] for p in points if p[0] == d], 15.0, last).items()}
        assert found == want


def test_no_points(spark):
    empty = spark.createDataFrame([], "drawing_id string, ord long, x double, y double")
    assert network.clusters(empty, 15.0, "first").count() == 0 and network.clusters(empty, 15.0, "last").count() == 0


def test_one_dense_spot_makes_no_square(spark):
    """A thousand points in one place have one leader, found in one round."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("d", k, *map(float, p)) for k, p in enumerate(rng.uniform(0, 5, (1000, 2)))], "drawing_id string, ord long, x double, y double")
    assert {r.home for r in rounds.by_leader(df, 15.0).collect()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_matches_equal_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = sorted({("d", int(a), int(b), float(rng.integers(0, 4))) for a, b in rng.integers(0, 25, (160, 2))})
    found = rounds.one_to_one(spark.createDataFrame(pairs, "drawing_id string, a long, b long, far double"), "drawing_id", "a", "b", ["far"]).collect()
    left, right, want = set(), set(), []
    for _, a, b, far in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.append((a, b))
    assert sorted((r.a, r.b) for r in found) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_claims_equal_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = {(f"d{a % 2}", int(a), int(b)): (float(rng.integers(0, 6)), bool(rng.random() < 0.8)) for a, b in rng.integers(0, 30, (250, 2))}
    rows = [(*k, *v) for k, v in pairs.items()]
    found = rounds.claims(spark.createDataFrame(rows, "drawing_id string, who long, what long, far double, takes boolean")).collect()
    taken, want = set(), []
    for who in range(30):
        mine = sorted((far, b, takes) for (d, a, b), (far, takes) in pairs.items() if a == who and (d, b) not in taken)
        if mine and mine[0][2]:
            taken.add((f"d{who % 2}", mine[0][1]))
            want.append((who, mine[0][1]))
    assert sorted((r.who, r.what) for r in found) == sorted(want)


def test_claims_in_a_row(spark):
    """All want the same things in the same order, so each round settles one more."""
    rows = [("d", a, b, float(b), True) for a in range(8) for b in range(8)]
    found = rounds.claims(spark.createDataFrame(rows, "drawing_id string, who long, what long, far double, takes boolean")).collect()
    assert sorted((r.who, r.what) for r in found) == [(k, k) for k in range(8)]
