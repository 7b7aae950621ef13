"""Rows that lie in the same place many times: searched once, with the results of going through all pairs."""

import contextlib
import math
import os
import random

import numpy as np
import pytest

from topolark.functions.staging import Staging
from topolark.operators import drawing, grid, mutate, network, paths, relate, rounds, select, spatial, trees
from topolark.plans import topology

FOLDER = "/root/testdata/sf0.001"

LINE = "x1 double, y1 double, x2 double, y2 double"


@pytest.fixture
def joined(monkeypatch):
    """Rows of the left side that each search within a radius, or of outlines, is given."""
    seen = []
    for module, name in ((drawing, "within"), (drawing, "enclosing"), (network, "within")):

        def counted(left, *rest, real=getattr(module, name), **more):
            seen.append(left.count())
            return real(left, *rest, **more)

        monkeypatch.setattr(module, name, counted)
    return seen


@contextlib.contextmanager
def session_conf(spark, name: str, value: str):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    yield
    spark.conf.set(name, before)


def labelled(spark, n: int = 40, many: int = 4):
    """n labels in a few places of two drawings: (rows, DataFrame)."""
    rows = [(f"D{k % 2}", k, str(k % 3), float(k % many) * 9, float(k % 2)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "drawing_id string, idx long, text string, x double, y double")


def planned(spark, n: int = 60):
    rng = random.Random(3)
    spots = [(rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(12)]
    short = [(x + 3, y + 2, x + rng.uniform(5, 60), y + rng.uniform(5, 60)) for x, y, _, _ in spots]
    hops = spark.createDataFrame([(f"D{k % 2}", k, *spots[k % 12]) for k in range(n)], "drawing_id string, hop_id long, ax double, ay double, bx double, by double")
    walls = spark.createDataFrame([(f"D{k % 2}", k, *short[k % 12]) for k in range(n)], f"drawing_id string, wall_id long, {LINE}")
    return hops, walls, spots, short


def meet(p, q) -> bool:
    turn = lambda ax, ay, bx, by, cx, cy: (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0
    return turn(*p, *q[:2]) != turn(*p, *q[2:]) and turn(*q, *p[:2]) != turn(*q, *p[2:])


def test_hops_that_meet_a_wall_are_found_without_their_pairs(spark):
    hops, walls, spots, short = planned(spark)
    wanted = {k for k in range(60) if any(meet(spots[k % 12], short[j % 12]) for j in range(k % 2, 60, 2))}
    assert 0 < len(wanted) < 60
    for staging in (None, Staging(spark)):
        found = spatial.crossed(hops, walls, ("drawing_id",), staging=staging).collect()
        assert sorted(r.hop_id for r in found) == sorted(wanted)
    rows = relate.hops_by_sight(hops, walls, ("drawing_id",)).collect()
    assert {r.hop_id for r in rows if r.crosses} == wanted and len(rows) == 60
    assert [(r.crosses, r.length, r.hop_id) for r in rows] == sorted((r.crosses, r.length, r.hop_id) for r in rows)


def test_lines_in_the_same_place_cross_as_each_of_them(spark):
    hops, walls, spots, short = planned(spark)
    far = lambda p, q: min(math.dist(a, b) for a in (p[:2], p[2:]) for b in (q[:2], q[2:]))
    wanted = {(k, j) for k in range(60) for j in range(k % 2, 60, 2) if meet(spots[k % 12], short[j % 12]) and far(spots[k % 12], short[j % 12]) > 12}
    pairs = spatial.crossing(hops, walls, ("drawing_id",), ignore=12.0)
    assert sorted((r.hop_id, r.wall_id) for r in pairs.collect()) == sorted(wanted)


def test_pairs_of_lines_are_told_in_one_join(spark, capsys):
    """pairs aren't joined with their rows again, and the code of the test is short enough (8000 bytes) for the JVM to compile it."""
    rng = random.Random(11)
    long = [(rng.uniform(-900, 900), rng.uniform(-900, 900), rng.uniform(-900, 900), rng.uniform(-900, 900)) for _ in range(40)]
    lines = [e for x, y, u, v in long for e in ((x, y, u, v), (x, y, x + u / 40, y + v / 40), (x, y, x, y + v / 9), (40.0, 40.0, 40.0 * round(u / 40), 40.0))]
    rows = [(k, *e) for k, e in enumerate(lines + [lines[0]] * 600)]  # more copies than a row holds ids
    hops = spark.createDataFrame([*rows, (9999, None, 0.0, 1.0, 1.0)], "hop_id long, ax double, ay double, bx double, by double")
    walls = spark.createDataFrame(rows, f"wall_id long, {LINE}")
    met = spatial.crossing(hops, walls)
    w = np.array([r[1:] for r in rows])
    wanted = [(i, int(j)) for i, r in enumerate(w) for j in np.flatnonzero(paths.meet(r[:2], r[2:], w[:, :2], w[:, 2:]))]
    assert sorted((r.hop_id, r.wall_id) for r in met.collect()) == wanted
    with session_conf(spark, "spark.sql.adaptive.enabled", "false"):
        spatial.crossing(hops, walls).explain("codegen")
    said = capsys.readouterr().out
    joined = [part for part in said.split("== Subtree") if "final class" not in part.split("SortMergeJoin")[0] and "SortMergeJoin" in part]
    assert len(joined) == 1 and int(joined[0].split("maxMethodCodeSize:")[1].split(";")[0]) < 8000


def test_fills_are_summed_at_the_places_of_labels(spark, joined):
    rows, labels = labelled(spark)
    fills = [(f"D{k % 2}", f"c{k % 5}", 2.0 * k, 0.0, 2.0 * k + k % 3 + 1, 5.0) for k in range(30)]
    wanted: dict = {}
    for d, _, text, x, y in rows:
        for e, color, x0, y0, x1, y1 in fills:
            if d == e and math.hypot((x0 + x1) / 2 - x, (y0 + y1) / 2 - y) <= 20:
                wanted[d, color, text] = wanted.get((d, color, text), 0) + (x1 - x0) * (y1 - y0)
    found = drawing.color_contributions(labels, spark.createDataFrame(fills, "drawing_id string, color string, x0 double, y0 double, x1 double, y1 double"))
    assert {(r.drawing_id, r.color, r.label): r.area for r in found.collect()} == pytest.approx(wanted)
    assert joined == [4]


def test_rooms_in_one_place_look_for_the_nearest_label_once(spark, joined):
    rows, labels = labelled(spark)
    over = [(d, i + 1, f"Lab {i}", x + 5, y) for d, i, _, x, y in rows]
    found = drawing.overlay_field(labels, spark.createDataFrame(over, labels.schema)).collect()
    wanted = {i: min(((math.hypot(x - a, y - b), j, t) for e, j, t, a, b in over if e == d and math.hypot(x - a, y - b) <= 20), default=(0, 0, None))[2] for d, i, _, x, y in rows}
    assert {r.idx: r.value for r in found} == wanted and joined == [4]


def test_rooms_in_one_place_share_their_nearest_doors(spark, joined):
    rows, labels = labelled(spark, 60)
    rooms = labels.selectExpr("drawing_id", "idx as room_id", "x", "y")
    found = drawing.door_candidates(rooms, labels.selectExpr("drawing_id", "idx as door_id", "x", "y")).collect()
    for d, i, _, x, y in rows:
        wanted = sorted((math.hypot(x - a, y - b), j) for e, j, _, a, b in rows if e == d)[:8]
        assert [(r.far, r.door_id) for r in sorted(found, key=lambda r: r["rank"]) if r.room_id == i] == wanted
    assert max(joined) == 4


def test_labels_in_one_place_look_for_their_outline_once(spark, joined):
    rows, labels = labelled(spark)
    box = lambda a, s: [(a, -s), (a + s, -s), (a + s, s), (a, s)]
    outlines = spark.createDataFrame([(f"D{k % 2}", k, [{"x": float(x), "y": float(y)} for x, y in box(-1, 5 + k % 4 // 2)]) for k in range(20)], "drawing_id string, poly_id long, points array<struct<x: double, y: double>>")
    found = network.room_outlines(labels, outlines, "1").collect()
    assert {(r.drawing_id, r.idx): r.poly_id for r in found} == {(d, i): i % 2 for d, i, text, x, _ in rows if text == "1" and x < 4}
    assert joined == [4]


def test_clicks_meet_the_nodes_around_them_only(spark):
    class T:
        nodes = spark.createDataFrame([(f"N{k}", f"F{k % 2}", float(k % 50 * 20), 0.0, k) for k in range(200)], "id string, floor_id string, x double, y double, idx long")

    clicks = [(f"A{k}", f"F{k % 2}", 13.0 * k, 3.0, zoom) for k, zoom in enumerate((1.0, 3.0, 0.25, 40.0, float("inf"), -1.0, 1.0, 1.0))]
    found = mutate.snap_clicks(T, spark.createDataFrame(clicks, "click_id string, floor_id string, x double, y double, zoom double"))
    nodes = T.nodes.collect()
    wanted = {c: min(((math.hypot(x - n.x, y - n.y), n.idx, n.id) for n in nodes if n.floor_id == f and math.hypot(x - n.x, y - n.y) <= 18 * zoom), default=(0, 0, None))[2] for c, f, x, y, zoom in clicks}
    assert {r.click_id: r.node_id for r in found.collect()} == wanted and None in wanted.values()
    # The floor alone is no key of the join.
    assert "c_" in [w for w in found._jdf.queryExecution().optimizedPlan().toString().replace("#", " ").split() if w == "c_"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_links_of_a_floor_meet_at_that_floor_only(spark):
    t = topology.derive_paired(spark, FOLDER)
    rows = lambda t: sorted(map(tuple, select.drawable_links(t, "F3").select("id", "access_point_id", "node_id", "cost", "idx").collect()))
    assert rows(t) == rows(topology.derive(spark, FOLDER)) != []
    ends = []
    t.links._kept, kept = (lambda points, nodes: (ends.extend((points(t.access_points).count(), nodes(t.nodes).count())), kept(points, nodes))[1]), t.links._kept
    rows(t)
    assert ends == [t.access_points.where("floor_id = 'F3'").count(), t.nodes.where("floor_id = 'F3'").count()]


def test_rounds_of_claims_do_not_grow_with_the_members_of_a_side(spark, monkeypatch):
    rng = random.Random(5)
    sides = [[(rng.uniform(0, 9), what, rng.random() < 0.9) for what in rng.sample(range(400), 150)] for _ in range(4)]
    members = [(f"D{k % 2}", k % 4, k) for k in range(240)]
    taken, wanted = set(), set()
    for d, side, who in members:
        first = min((p for p in sides[side] if (d, p[1]) not in taken), default=None)
        if first and first[2]:
            taken.add((d, first[1]))
            wanted.add((d, who, first[1]))
    pairs = [(f"D{s % 2}", s, what, far, takes) for s in range(4) for far, what, takes in sides[s]]
    written = []
    real = Staging.write
    monkeypatch.setattr(Staging, "write", lambda self, df: (written.append(1), real(self, df))[1])
    found = rounds.shared_claims(spark.createDataFrame(pairs, "drawing_id string, side long, what long, far double, takes boolean"), spark.createDataFrame(members, "drawing_id string, side long, who long"))
    assert set(map(tuple, found.select("drawing_id", "who", "what").collect())) == wanted
    assert len(written) < 80
    single = [(d, who, what, far, takes) for d, side, who in members for far, what, takes in sides[side]]
    found = rounds.claims(spark.createDataFrame(single, "drawing_id string, who long, what long, far double, takes boolean"))
    assert set(map(tuple, found.select("drawing_id", "who", "what").collect())) == wanted


def test_rooms_in_one_place_share_a_walk(spark, joined, monkeypatch):
    rows = []
    real = network.around
    monkeypatch.setattr(network, "around", lambda r, *rest: (rows.append(r.count()), real(r, *rest))[1])
    walls = spark.createDataFrame([("D", k, 20.0, -10.0, 20.0, 10.0) for k in range(5)], "drawing_id string, idx long, x1 double, y1 double, x2 double, y2 double")
    rooms = spark.createDataFrame([("D", f"R{k}", 0.0, 0.0) for k in range(6)], "drawing_id string, id string, x double, y double")
    doors = spark.createDataFrame([("D", "door", 40.0, 0.0)], "drawing_id string, door string, x double, y double")
    found = network.room_doors(rooms, doors, walls).collect()
    assert sorted(r.id for r in found) == [f"R{k}" for k in range(6)] and len({r.length for r in found}) == 1 and found[0].length > 40
    walks = network.short_walks(rooms.selectExpr("*", "40D as tx", "0D as ty"), walls).collect()
    assert sorted(r.id for r in walks) == [f"R{k}" for k in range(6)] and len({str(r.path) for r in walks}) == 1
    assert rows == [1, 1] and joined == [1]
    # Walls in one place come once, as four numbers.
    assert [list(r.near) for r in real(rooms.limit(1), walls, 150.0).collect()] == [[20.0, -10.0, 20.0, 10.0]]


def test_leader_pairs_are_told_without_grouping_them(spark):
    rooms = spark.createDataFrame([("D", 1, 0.0, 0.0), ("D", 2, 6.0, 6.0)], "drawing_id string, idx long, x double, y double")
    ticks = spark.createDataFrame([("D", 7, "line", 0.0, 0.0, 12.0, 12.0, drawing.LEADER_LAYER)], f"drawing_id string, idx long, type string, {LINE}, layer string")
    found = drawing.leader_matches(rooms, ticks)
    assert sorted((r.idx, r.seg_idx, r.tx, r.ty) for r in found.collect()) == [(1, 7, 12.0, 12.0), (2, 7, 0.0, 0.0)]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_within_longer_ones_stay_away(spark):
    """Copies of a floor whose walls start in one place add no walls to a row; others in that direction or place stay."""
    lines = [(0.0, 0.0, float(k), 2.0 * k) for k in range(1, 30)] + [(0.0, 0.0, -4.0, -8.0), (0.0, 0.0, 0.0, 9.0), (0.0, 0.0, 0.0, 5.0), (1.0, 2.0, 3.0, 6.0)]
    walls = spark.createDataFrame([("D", k, *e) for k, e in enumerate(lines)], f"drawing_id string, idx long, {LINE}")
    kept = spatial.outermost(walls, ("drawing_id",)).collect()
    assert {(r.x1, r.y1, r.x2, r.y2) for r in kept} == {lines[28], lines[29], lines[30], lines[32]}
    near = network.around(spark.createDataFrame([("D", "a", 1.0, 1.0)], "drawing_id string, id string, x double, y double"), walls, 50.0).first().near
    assert len(near) == 4 * 4
    # What meets any line meets one that is left, and the other way round.
    rng = random.Random(7)
    hops = [tuple(float(rng.randrange(-20, 40)) for _ in range(4)) for _ in range(300)]
    every = network.lines_of([v for e in lines for v in e])
    left = network.lines_of(near)
    meets = lambda hop, some: bool(paths.meet(np.array(hop[:2]), np.array(hop[2:]), some[:, :2], some[:, 2:]).any())
    assert [meets(h, every) for h in hops] == [meets(h, left) for h in hops]


def test_walks_are_looked_for_when_asked_for(monkeypatch):
    asked = []
    monkeypatch.setattr(paths, "entry", lambda p, lines, real=paths.entry: (asked.append(p), real(p, lines))[1])
    walks = paths.fan((0.0, 0.0), [(12.0, 0.0), (60.0, 0.0), (90.0, 0.0)], np.zeros((0, 4)), 25)
    assert next(walks)[-1] == (12.0, 0.0) and len(asked) == 2


def test_pairs_out_of_sight_are_told_at_the_outermost_walls(spark, monkeypatch):
    """Of pairs that meet an outermost wall none is tried against all walls; what ends near a point doesn't count."""
    given = []

    def counted(hops, walls, *rest, real=trees.crossed, **more):
        given.append((hops.count(), walls.count()))
        return real(hops, walls, *rest, **more)

    monkeypatch.setattr(trees, "crossed", counted)
    walls = spark.createDataFrame([("D", k, 50.0, -300.0, 50.0, -300.0 + 20 * k) for k in range(1, 31)], f"drawing_id string, wall_id long, {LINE}")
    ends = [(0.0, 0.0, 100.0, 0.0), (0.0, 290.0, 100.0, 290.0), (0.0, 400.0, 100.0, 400.0), (45.0, 295.0, 60.0, 296.0)]
    pairs = spark.createDataFrame([("D", f"a{k}", f"b{k}", *e) for k, e in enumerate(ends)], "drawing_id string, a string, b string, ax double, ay double, bx double, by double")
    seen = trees.in_sight(pairs, walls, 20.0, Staging(spark)).collect()
    assert sorted(r.a for r in seen) == ["a2", "a3"] and given == [(4, 1), (2, 30)]


def test_outlines_and_lines_in_one_place_are_filled_once(spark):
    """Copies make no cells: what is exploded is as many rows with twenty copies as with one."""
    corners = [(0.0, 0.0), (9.0, 1.0), (8.0, 9.0), (-2.0, 7.0)]
    outlines = lambda n: spark.createDataFrame([("D", k, corners) for k in range(n)], "drawing_id string, poly_id long, points array<struct<x: double, y: double>>")
    lines = lambda n: spark.createDataFrame([("D", k, 0.0, 0.0, 30.0, 12.0) for k in range(n)], f"drawing_id string, idx long, {LINE}")

    def exploded(cells):
        plan = cells._jdf.queryExecution().optimizedPlan().toString().splitlines()
        lowest = max(k for k, line in enumerate(plan) if "Generate" in line)
        return any("Aggregate" in line for line in plan[lowest:])

    for made, rows in ((grid.polygon_cells, outlines), (grid.segment_cells, lines)):
        assert sorted(made(rows(20), 2.0).collect()) == sorted(made(rows(1), 2.0).collect())
        assert exploded(made(rows(20), 2.0))  # copies are gone before any cell is made
