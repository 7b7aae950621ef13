import heapq
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from fixtures import base, make
from pyspark.sql import functions as F

from topolark.functions import keys
from topolark.functions.staging import Staging
from topolark.operators import drawing, grid, network, paths, spatial, suggest, trees, validate
from topolark.sources import project


def test_room_patterns(spark):
    rows = [("4210", "4", True), ("4001A", "4", True), ("5122", "4", False), ("A353", "A", True), ("A100A", "A", True), ("B372", "A", False), ("42100", "4", False), ("ab-123", "G1", True)]
    df = spark.createDataFrame(rows, "text string, level string, expected boolean")
    assert all(r.found == r.expected for r in df.withColumn("found", drawing.room_number_match(F.col("text"), F.col("level"))).collect())


def test_room_suggestions_keep_the_first(spark):
    rows = [("d", k, t, 10.0 * k, 5.0, "4", 200.0, 100.0) for k, t in enumerate(["4210", "4210", "4211a", "5122"])]
    found = suggest.room_suggestions(spark.createDataFrame(rows, "drawing_id string, idx long, text string, x double, y double, level string, page_width double, page_height double")).orderBy("idx").collect()
    assert [(r.id, r.room_number) for r in found] == [("room-4210", "4210"), ("room-4211a", "4211A")]
    assert all(0 <= r.x <= 1 and 0 <= r.y <= 1 for r in found)


def test_numbers_of_levels(spark):
    cases = [("", 0.0), (" 7 ", 7.0), ("0x10", 16.0), ("1e2", 100.0), ("-2.5", -2.5), ("Infinity", math.inf)]
    df = spark.createDataFrame([(t,) for t, _ in cases] + [("B1",), ("4d",), ("1_0",)], "t string").select("t", keys.number(F.col("t")).alias("n"))
    found = {r.t: r.n for r in df.collect()}
    assert all(found[t] == n for t, n in cases) and all(math.isnan(found[t]) for t in ("B1", "4d", "1_0"))


def test_half_up_and_natural_keys(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.04,)], "x double").select(keys.half_up(F.col("x")).alias("a"), keys.half_up(F.col("x"), 1).alias("b"))
    assert [tuple(r) for r in df.collect()] == [(-2.0, -2.5), (3.0, 2.5), (0.0, 0.0)]
    names = spark.createDataFrame([("Room 10",), ("room 9",), ("Room 009b",)], "n string").orderBy(keys.natural_key(F.col("n"))).collect()
    assert [r.n for r in names] == ["room 9", "Room 009b", "Room 10"]


def test_bucketed_joins_match_brute_force(spark):
    rng = random.Random(1)
    points = [(k, rng.uniform(-90, 90), rng.uniform(-90, 90)) for k in range(150)]
    a = spark.createDataFrame(points, "a long, x double, y double")
    b = spark.createDataFrame(points, "b long, rx double, ry double")
    found = sorted((r.a, r.b) for r in spatial.within(a, b, 17.0).collect())
    assert found == sorted((i, j) for i, x, y in points for j, u, v in points if math.hypot(x - u, y - v) <= 17.0)
    lines = [(k, rng.uniform(0, 200), rng.uniform(0, 200), rng.uniform(0, 200), rng.uniform(0, 200)) for k in range(60)] + [(60, 0.0, 0.0, 10.0, 0.0), (61, 5.0, 0.0, 20.0, 0.0), (62, 10.0, 0.0, 10.0, 9.0)]
    hops = spark.createDataFrame(lines, "hop_id long, ax double, ay double, bx double, by double")
    walls = spark.createDataFrame(lines, "wall_id long, x1 double, y1 double, x2 double, y2 double")
    met = {(r.hop_id, r.wall_id) for r in spatial.crossing(hops, walls).collect()}
    w = np.array([x[1:] for x in lines])
    assert met == {(i, j) for i in range(len(lines)) for j in np.flatnonzero(paths.meet(w[i, :2], w[i, 2:], w[:, :2], w[:, 2:]))}
    assert {(60, 61), (60, 62), (61, 62)} <= met


def test_morphology_and_components(spark):
    block = [("d", x, y) for x in range(10) for y in range(6)] + [("d", 30, 30), ("e", 0, 0)]
    m = spark.createDataFrame(block, "drawing_id string, cx int, cy int")
    cells = lambda df: {tuple(r) for r in df.select("drawing_id", "cx", "cy").collect()}
    offsets = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4]
    wide = {(d, x + dx, y + dy) for d, x, y in block for dx, dy in offsets}
    assert cells(grid.dilate(m, 2)) == wide
    assert cells(grid.erode(m, 2)) == {c for c in block if all((c[0], c[1] + dx, c[2] + dy) in set(block) for dx, dy in offsets)}
    assert set(block) <= cells(grid.close(m, 2)) and cells(grid.open_(m, 2)) <= set(block)
    seeds = spark.createDataFrame([("d", 0, 0), ("e", 9, 9)], "drawing_id string, cx int, cy int")
    assert cells(grid.touching(m, seeds)) == {c for c in block if c[0] == "d" and c[1] < 30}


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_discs_by_rows_match_brute_force(spark, radius):
    rng = np.random.default_rng(9)
    mask = {(int(x), int(y)) for x, y in rng.integers(0, 25, (260, 2))}
    m = spark.createDataFrame([("d", x, y) for x, y in mask], "drawing_id string, cx int, cy int")
    disc = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    cells = lambda rows: {(r.cx, r.cy) for r in rows.collect()}
    wide = cells(grid.dilate(m, radius))
    assert wide == {(x + i, y + j) for x, y in mask for i, j in disc}
    assert cells(grid.erode(m, radius)) == {p for p in mask if all((p[0] + i, p[1] + j) in mask for i, j in disc)}
    assert cells(grid.close(m, radius)) == {p for p in wide if all((p[0] + i, p[1] + j) in wide for i, j in disc)}


def test_thinning_and_tracing_of_a_cross(spark):
    cross = {(x, y) for x in range(80) for y in range(38, 43)} | {(x, y) for x in range(38, 43) for y in range(80)}
    m = spark.createDataFrame([("d", x, y) for x, y in cross], "drawing_id string, cx int, cy int")
    thin = grid.thin(m)
    skeleton = {(r.cx, r.cy) for r in thin.collect()}
    assert skeleton <= cross and len(skeleton) < 200
    runs = {r.run for r in grid.trace(thin).collect()}
    assert len(runs) >= 4
    lines = grid.trace(thin).select("drawing_id", "run", "pos", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"))
    assert grid.simplify(lines, 3.0).groupBy("run").count().where("count > 4").count() == 0


def test_simplification_keeps_corners():
    points = np.array([(0, 0), (5, 0.5), (10, 0), (10, 5), (10, 10)], float)
    assert grid.simplify_points(points, 1.0) == [0, 2, 4]
    assert grid.simplify_points(points[:2], 1.0) == [0, 1]


def test_many_lines_are_simplified_as_each_alone(spark):
    rng, rows, kept = np.random.default_rng(3), [], set()
    for run in range(200):
        points = np.cumsum(rng.integers(-2, 3, (int(rng.integers(1, 40)), 2)), 0).astype(float)
        rows += [(f"d{run % 3}", run, k, float(x), float(y)) for k, (x, y) in enumerate(points)]
        kept |= {(f"d{run % 3}", run, k, *points[k].tolist()) for k in grid.simplify_points(points, 2.0)}
    df = spark.createDataFrame(rows, "drawing_id string, run int, pos int, x double, y double").repartition(4)
    found = [tuple(r) for r in grid.simplify(df).collect()]
    assert len(found) == len(kept) and set(found) == kept
    assert grid.simplify(df.limit(0)).count() == 0
    assert paths.kept_points([tuple(p) for p in points], paths.Walls(np.array([[4.0, 3.0, 4.0, 9.0]])), 20.0) != [0, 4]


def test_paths_go_around_walls():
    lines = np.array([[30.0, -60.0, 30.0, 60.0]])
    walls = paths.Walls(lines)
    path = paths.simplified(paths.walk((0.0, 0.0), (60.0, 0.0), lines), walls)
    assert path[0] == (0.0, 0.0) and path[-1] == (60.0, 0.0) and paths.length_of(path) > 120
    assert not any(walls.crosses(a, b) for a, b in zip(path, path[1:]))
    assert paths.simplified(paths.walk((0.0, 0.0), (60.0, 0.0), np.zeros((0, 4))), paths.Walls(np.zeros((0, 4)))) == [(0.0, 0.0), (60.0, 0.0)]


def cheapest(start, end, lines, ring=None, factor=1.0):
    """Cost of the cheapest way between the entry cells, by Dijkstra over a dictionary."""
    s, g = (tuple(map(int, paths.entry(p, lines))) for p in (start, end))
    walls, best, queue, done = paths.Walls(lines), {s: 0.0}, [(0.0, s)], set()
    every = np.concatenate((lines.reshape(-1, 2), [start, end], ring or [start])) / paths.CELL
    low, high = np.floor(every.min(0)) - 4, np.ceil(every.max(0)) + 4
    while queue:
        cost, u = heapq.heappop(queue)
        if u == g:
            return cost
        if u in done:
            continue
        done.add(u)
        for i, j in itertools.product((-1, 0, 1), repeat=2):
            v = (u[0] + i, u[1] + j)
            if v == u or not (low[0] <= v[0] <= high[0] and low[1] <= v[1] <= high[1]) or walls.crosses((u[0] * 6.0, u[1] * 6.0), (v[0] * 6.0, v[1] * 6.0)):
                continue
            toll = factor if ring and not paths.inside(np.array(v) * 6.0, ring) else 1.0
            if (more := cost + 6.0 * math.hypot(i, j) * toll) < best.get(v, math.inf):
                best[v] = more
                heapq.heappush(queue, (more, v))
    return None


@pytest.mark.parametrize("factor", [1.0, 25.0])
def test_walks_are_the_cheapest(factor):
    rng = np.random.default_rng(6)
    ring = [(10.0, 10.0), (110.0, 20.0), (100.0, 60.0), (50.0, 40.0), (20.0, 110.0)] if factor > 1 else None
    found = 0
    for _ in range(8):
        lines = rng.uniform(0, 120, (25, 4))
        lines[:, 2:] = lines[:, :2] + rng.uniform(-40, 40, (25, 2))
        start, end = (tuple(map(float, rng.uniform(0, 120, 2))) for _ in range(2))
        if paths.entry(start, lines) is None or paths.entry(end, lines) is None:
            assert paths.walk(start, end, lines, ring, factor) is None
            continue
        walk, cost = paths.walk(start, end, lines, ring, factor), cheapest(start, end, lines, ring, factor)
        assert (walk is None) == (cost is None)
        if walk and len(walk) > 2:
            cells = [np.array(p) for p in walk if paths.entry(p, np.zeros((0, 4))) is not None and all(v % 6 == 0 for v in p)]
            tolls = [factor if ring and not paths.inside(c, ring) else 1.0 for c in cells[1:]]
            assert sum(t * float(np.hypot(*(b - a))) for a, b, t in zip(cells, cells[1:], tolls)) == pytest.approx(cost)
            found += 1
    assert found > 3


def test_rooms_find_their_doors(spark):
    """Each room's door by brute force: the shortest of the walks to all doors of the drawing."""
    rng = np.random.default_rng(7)
    rooms = [("d", f"r{k}", *map(float, rng.uniform(0, 300, 2))) for k in range(25)]
    doors = [("d", f"p{k}", *map(float, rng.uniform(0, 300, 2))) for k in range(12)]
    lines = rng.uniform(0, 300, (40, 4))
    lines[:, 2:] = lines[:, :2] + rng.uniform(-50, 50, (40, 2))
    walls = spark.createDataFrame([("d", k, *map(float, w)) for k, w in enumerate(lines)], "drawing_id string, idx long, x1 double, y1 double, x2 double, y2 double")
    point = "drawing_id string, {} string, x double, y double"
    out = network.room_doors(spark.createDataFrame(rooms, point.format("id")), spark.createDataFrame(doors, point.format("door")), walls).collect()
    found, boxed = {r.id: (r.door, round(r.length, 6)) for r in out}, paths.Walls(lines)
    expected = {}
    for _, room, x, y in rooms:
        best = None
        for _, door, u, v in sorted(doors, key=lambda d: math.dist((x, y), d[2:]))[:8]:
            walk = paths.simplified(paths.walk((x, y), (u, v), lines), boxed)
            if walk and (best is None or paths.length_of(walk) < best[0]):
                best = (paths.length_of(walk), door, math.dist((x, y), (u, v)))
        if best and best[0] <= 100 and best[0] <= 2.2 * max(best[2], 1):
            expected[room] = (best[1], round(best[0], 6))
    assert found == expected and len(found) > 5


def test_graph_of_a_floor(spark):
    """Two rooms on either side of a wall with a door in it: both reach the door, waypoints lie between."""
    rooms = spark.createDataFrame([("d", "a", 20.0, 30.0), ("d", "b", 90.0, 30.0)], "drawing_id string, id string, x double, y double")
    lines = [("line", "ARCH|A-WALL", 50.0, 0.0, 50.0, 25.0), ("line", "ARCH|A-WALL", 50.0, 40.0, 50.0, 90.0), ("curve", "ARCH|A-DOOR", 50.0, 30.0, 50.0, 34.0), ("curve", "ARCH|A-DOOR", 140.0, 30.0, 140.0, 34.0)]
    segments = spark.createDataFrame([("d", k, t, x1, y1, x2, y2, layer) for k, (t, layer, x1, y1, x2, y2) in enumerate(lines)], "drawing_id string, idx long, type string, x1 double, y1 double, x2 double, y2 double, layer string")
    edges = network.auto_graph(rooms, segments).collect()
    ends = {r.from_node for r in edges} | {r.to_node for r in edges}
    assert {"a", "b", "d-door-0", "d-door-1"} <= ends and {r.type for r in edges} == {"door", "corridor"}
    assert all(r.weight > 0 for r in edges)
    lonely = network.auto_graph(rooms, segments.where("type = 'line'")).collect()
    assert [(r.from_node, r.to_node, r.weight, r.type) for r in lonely] == [("a", "b", 70.0, "corridor")]


def tree_by_brute_force(nodes, walls=None):
    """All pairs by length and ids, those in sight first where walls are given."""
    ids, home, out = sorted(nodes), {k: k for k in nodes}, set()
    boxed = paths.Walls(np.array(walls)) if walls is not None else None
    pairs = sorted((math.sqrt((nodes[a][0] - nodes[b][0]) ** 2 + (nodes[a][1] - nodes[b][1]) ** 2), a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    for seen in (True, False) if walls is not None else (False,):
        for far, a, b in pairs:
            if home[a] != home[b] and not (seen and far and boxed.crosses(nodes[a], nodes[b], 20.0)):
                old, new = home[b], home[a]
                home = {k: new if h == old else h for k, h in home.items()}
                out.add((a, b))
    return out


@pytest.mark.parametrize("kind, tile", [("even", 4096), ("even", 8), ("grid", 4096), ("blobs", 4096), ("blobs", 8), ("line", 6), ("same", 4096)])
def test_spanning_trees(spark, monkeypatch, kind, tile):
    """Even points, ties and repeated places, two far blobs and a line, as one tile and as several."""
    monkeypatch.setattr(trees, "TILE", tile)
    rng = np.random.default_rng(3)
    points = {"even": rng.uniform(0, 300, (50, 2)), "grid": np.round(rng.uniform(0, 60, (60, 2)) / 10) * 10, "blobs": np.concatenate((rng.normal(0, 1, (20, 2)), rng.normal(900, 1, (20, 2)))), "line": np.stack((np.arange(25) * 7.0, np.zeros(25)), 1), "same": np.zeros((3, 2))}[kind]
    nodes = {f"n{k:02d}": tuple(map(float, p)) for k, p in enumerate(points)}
    walls = rng.uniform(0, 300, (14, 4))
    walls[:, 2:] = walls[:, :2] + rng.uniform(-90, 90, (14, 2))
    df = spark.createDataFrame([("d", k, *p) for k, p in nodes.items()] + [("e", "only", 1.0, 1.0)], "drawing_id string, id string, x double, y double")
    lines = spark.createDataFrame([("d", k, *map(float, w)) for k, w in enumerate(walls)], "drawing_id string, wall_id long, x1 double, y1 double, x2 double, y2 double")
    assert {(r.a, r.b) for r in trees.spanning_tree(df).collect()} == tree_by_brute_force(nodes)
    assert {(r.a, r.b) for r in trees.spanning_tree(df, lines).collect()} == tree_by_brute_force(nodes, walls)


def test_trees_see_walls(spark):
    df = spark.createDataFrame([("d", "a", 0.0, 0.0), ("d", "b", 60.0, 0.0), ("d", "c", 0.0, 90.0)], "drawing_id string, id string, x double, y double")
    wall = spark.createDataFrame([("d", 1, 30.0, -50.0, 30.0, 50.0)], "drawing_id string, wall_id long, x1 double, y1 double, x2 double, y2 double")
    split = {(r.a, r.b): r.seen for r in trees.spanning_tree(df, wall, 1.0).collect()}
    assert len(split) == 2 and split[("a", "c")] and not split.get(("a", "b"), False)
    assert trees.spanning_tree(df.limit(0), wall).count() == 0


def test_walks_widen_their_windows(spark):
    """Long walls make a way far longer than the first window; each walk equals that of the whole drawing."""
    walls = [("d", 0, 300.0, -900.0, 300.0, 700.0), ("d", 1, 500.0, -700.0, 500.0, 900.0), ("e", 0, 1000.0, 0.0, 1000.0, 5.0)]
    pairs = [("d", "a", "b", 0.0, 0.0, 620.0, 30.0), ("d", "a", "c", 0.0, 0.0, 90.0, 40.0), ("e", "a", "b", 0.0, 0.0, 50.0, 0.0), ("f", "a", "b", 0.0, 0.0, 50.0, 8.0)]
    wall_df = spark.createDataFrame(walls, "drawing_id string, idx long, x1 double, y1 double, x2 double, y2 double")
    found = network.long_walks(spark.createDataFrame(pairs, "drawing_id string, a string, b string, ax double, ay double, bx double, by double"), wall_df, None, Staging(spark)).collect()
    for r in found:
        lines = np.array([w[2:] for w in walls if w[0] == r.drawing_id]).reshape(-1, 4)
        p = next(p for p in pairs if p[:3] == (r.drawing_id, r.a, r.b))
        want = paths.simplified(paths.walk(p[3:5], p[5:7], lines), paths.Walls(lines))
        assert paths.length_of([(q.x, q.y) for q in r.path]) == pytest.approx(paths.length_of(want))
    assert len(found) == 4


def test_exterior_rings():
    square = [(0, 0, 9, 0), (9, 0, 9, 9), (9, 9, 0, 9), (0, 9, 0, 0)]
    assert len(network.exterior_ring(square)) == 4
    assert network.exterior_ring(square[1:]) is None and network.exterior_ring([]) is None
    assert network.exterior_ring(square + [(x + 20, y, u + 20, v) for x, y, u, v in square]) is None


def test_clusters_by_first_and_last(spark):
    df = spark.createDataFrame([("d", k, 12.0 * k, 0.0) for k in range(6)], "drawing_id string, ord long, x double, y double")
    assert network.clusters(df, 15.0, "last").count() == 1
    assert network.clusters(df, 15.0, "first").count() == 3
    assert network.clusters(df, 15.0, "last", 7).count() == 0


def test_openings_partition_the_wall(spark):
    walls = spark.createDataFrame([("d", 1, 0.0, 0.0, 200.0, 0.0), ("d", 2, 0.0, 300.0, 100.0, 300.0), ("d", 3, 5.0, 5.0, 5.0, 5.0)], "drawing_id string, wall_id long, x1 double, y1 double, x2 double, y2 double")
    doors = spark.createDataFrame([("d", 50.0, 0.0), ("d", 65.0, 5.0), ("d", 200.0, 0.0)], "drawing_id string, x double, y double")
    found = sorted((r.wall_id, round(r.lo * 200), round(r.hi * 200)) for r in drawing.cut_openings(walls, doors).collect())
    assert found == [(1, 0, 30), (1, 84, 180), (2, 0, 200)]


def test_registration(spark):
    labels = [("d", f"{k}", float(k * 7 % 40), float(k * 11 % 60)) for k in range(12)]
    base_ = spark.createDataFrame(labels, "drawing_id string, text string, x double, y double")
    other = base_.select("drawing_id", "text", (F.col("x") * 2 + 1).alias("x"), (F.col("y") / 4).alias("y"))
    r = drawing.register(base_, other).first()
    assert (r.scale_x, r.scale_y) == (pytest.approx(0.5), pytest.approx(4.0)) and r.residual < 1e-6
    assert drawing.register(base_.limit(5), other).count() == 0


def test_project_round_trip(spark, tmp_path):
    t = make(spark, **base())
    project.write_project(project.join(t, "m", "Map", "2024-01-01T00:00:00Z"), str(tmp_path / "p"))
    back = project.split(project.read_project(spark, str(tmp_path / "p")))
    for name in ("buildings", "floors", "places", "access_points", "nodes", "segments", "edges", "links"):
        columns = [c for c in getattr(t, name).columns if c in getattr(back, name).columns and not (name == "access_points" and c in "xy")]
        assert sorted(map(tuple, getattr(back, name).select(*columns).collect())) == sorted(map(tuple, getattr(t, name).select(*columns).collect())), name
    assert validate.validate(back).count() == 0
    project.save(t, str(tmp_path / "saved"))
    assert project.load(spark, str(tmp_path / "saved")).nodes.count() == 2
    assert project.empty_project(spark, "m", "Map", "Main").buildings.count() == 1
    assert project.repair_file(spark, str(tmp_path / "p"), str(tmp_path / "q")).count() == 0
    (tmp_path / "bad.json").write_text('{"documentVersion": 2}')
    with pytest.raises(ValueError):
        project.read_project(spark, str(tmp_path / "bad.json"))


def test_service_checks(spark):
    cases = [("a.txt", "text/plain", 5, 415), ("a.PDF", "text/plain", 5, None), ("a", "application/pdf", 0, 400), (None, None, 0, 415), ("x.pdf", None, None, 400)]
    rows = spark.createDataFrame([c[:3] for c in cases], "name string, kind string, size int").select("*", project.refusal(F.col("name"), F.col("kind"), F.col("size")).alias("r")).collect()
    assert {(r.name, r.kind, r["size"]): r.r and r.r.status for r in rows} == {c[:3]: c[3] for c in cases}
    for name, kind, size, status in cases[:4]:
        if status is None:
            project.check_upload(name, kind, size)
        else:
            with pytest.raises(project.ServiceError) as e:
                project.check_upload(name, kind, size)
            assert e.value.status == status


def test_levels_of_file_names(spark):
    cases = {"Main-Floor-12.pdf": "12", "level_3a plan.PNG": "3A", "site-a-esim-map.pdf": "A", "north 12 west 7.pdf": "7", "x.tif": "?", "HALL fl9.pdf": "9", "roof2b.pdf": "2B", "a-esim.pdf": "?", "floor--3.pdf": "3", "floor x-y floor": "Y", "b floor_z level": "Z"}
    df = spark.createDataFrame([(n,) for n in cases], "n string").select("n", project.guess_level(F.col("n"), F.lit("?")).alias("level"))
    assert {r.n: r.level for r in df.collect()} == cases


def test_nearest_doors_look_further(spark):
    rng = np.random.default_rng(5)
    rooms = [("d", k, *map(float, rng.uniform(0, 900, 2))) for k in range(40)] + [("e", 1, 0.0, 0.0), ("f", 1, 5.0, 5.0)]
    doors = [("d", k, *map(float, rng.uniform(0, 900, 2))) for k in range(30)] + [("e", 9, 4000.0, 0.0)]
    found = {}
    point = "drawing_id string, {} long, x double, y double"
    for r in drawing.door_candidates(spark.createDataFrame(rooms, point.format("room_id")), spark.createDataFrame(doors, point.format("door_id")), 4).collect():
        found.setdefault((r.drawing_id, r.room_id), []).append((r["rank"], r.door_id))
    for name, k, x, y in rooms:
        near = sorted((math.dist((x, y), p[2:]), p[1]) for p in doors if p[0] == name)[:4]
        assert sorted(found.get((name, k), [])) == [(n + 1, i) for n, (_, i) in enumerate(near)]


def test_traced_runs_cover_a_drawing():
    """Two squares tied by a bar, a free ring, a spur and a lone cell."""
    square = lambda x, n: {(x + i, j) for i in range(n) for j in (0, n - 1)} | {(x + i, j) for i in (0, n - 1) for j in range(n)}
    ring, tied = {(x, s * (12 - abs(x))) for x in range(-12, 13) for s in (1, -1)}, square(100, 12) | square(140, 12) | {(x, 5) for x in range(111, 141)}
    runs = grid.trace_cells(ring | tied | {(300, 0)} | {(400 + k, 0) for k in range(10)} | {(500 + k, 0) for k in range(30)})
    covered = {c for run in runs for c in run}
    assert ring | tied <= covered | {(300, 0)} and not covered & ({(300, 0)} | {(400 + k, 0) for k in range(10)}) and {(500 + k, 0) for k in range(30)} <= covered
    assert all(max(abs(a - c), abs(b - d)) == 1 for run in runs for (a, b), (c, d) in zip(run, run[1:]))
    assert sum(run[0] in ring for run in runs) == 1 and len(next(run for run in runs if run[0] in ring)) == len(ring)


def test_simplification_around_walls_by_rows(spark):
    rng = np.random.default_rng(8)
    lines = [("d", run, k, 10.0 * k, float(rng.uniform(0, 12))) for run in range(6) for k in range(25)]
    walls = [("d", k, *map(float, (x, y, x + 8, y + 6))) for k, (x, y) in enumerate(rng.uniform((0, -5), (240, 12), (30, 2)))]
    df = spark.createDataFrame(lines, "drawing_id string, run int, pos int, x double, y double")
    out = network.simplify_around_walls(df, spark.createDataFrame(walls, "drawing_id string, idx long, x1 double, y1 double, x2 double, y2 double"), 12.0).collect()
    boxed = paths.Walls(np.array([w[2:] for w in walls]))
    for run in range(6):
        points = [r[3:] for r in lines if r[1] == run]
        assert sorted(r.pos for r in out if r.run == run) == paths.kept_points(points, boxed, 12.0)


def test_hallways_from_a_painted_corridor(spark):
    text = "drawing_id string, text string, x double, y double"
    labels = spark.createDataFrame([("a", grid.CORRIDOR, 50.0, 50.0), ("b", grid.CORRIDOR, 50.0, 50.0), ("b", "Lab", 50.0, 50.0), ("b", "Lab", 52.0, 50.0), ("c", "Lab", 5.0, 5.0), ("e", grid.CORRIDOR, 50.0, 50.0)], text)
    fills = spark.createDataFrame([(n, "k", 40.0, 40.0, 60.0, 60.0, 0.5, 0.5, 0.5) for n in "abe"], "drawing_id string, color string, x0 double, y0 double, x1 double, y1 double, r double, g double, b double")
    pixels = spark.createDataFrame([("a", x, y, 128, 120, 128) for x in range(0, 400) for y in range(90, 130)] + [("a", x, 300, 0, 0, 0) for x in range(300)] + [("e", 1, 1, 128, 128, 128)], "drawing_id string, x int, y int, r int, g int, b int")
    lines = grid.hallway_suggestions(grid.corridor_cells(labels, fills, grid.pixel_cells(pixels, 6)), 6.0, 1224.0, 792.0)
    found = lines.collect()
    assert {r.drawing_id for r in found} == {"a"} and len(found) >= 2 and all(0 <= r.x <= 0.34 and 0.1 < r.y < 0.18 for r in found)
    assert {r.drawing_id: r.warning for r in grid.hallway_warnings(labels, fills, lines).collect()} == {"b": grid.NO_FILL, "c": grid.NO_FILL, "e": grid.NO_LINES}


def test_walkable_rooms(spark):
    room = spark.createDataFrame([("d", 1, [(0.0, 0.0), (100.0, 0.0), (100.0, 60.0), (0.0, 60.0)])], "drawing_id string, poly_id long, points array<struct<x: double, y: double>>")
    table = spark.createDataFrame([("d", 48.0, 30.0, 52.0, 30.0)], "drawing_id string, x1 double, y1 double, x2 double, y2 double")
    cells = {(r.cx, r.cy) for r in grid.walkable_room_cells(room, table, 1.0).collect()}
    assert (20, 30) in cells and (50, 30) not in cells and (50, 33) not in cells and (50, 35) in cells and (0, 0) not in cells


def test_greedy_matching_is_one_to_one(spark):
    rows = [("d", 1, 1, 1.0, 0.0, 0.0), ("d", 1, 2, 2.0, 0.0, 0.0), ("d", 2, 1, 1.5, 0.0, 0.0), ("d", 2, 2, 9.0, 1.0, 1.0)]
    found = network.greedy_matches(spark.createDataFrame(rows, "drawing_id string, idx long, seg_idx long, near double, tx double, ty double")).collect()
    assert sorted((r.idx, r.seg_idx) for r in found) == [(1, 1), (2, 2)]
    assert isinstance(found[0].asDict(), dict) and pd.DataFrame(found).shape[0] == 2


def test_a_failed_save_leaves_the_old_project(spark, tmp_path):
    folder = str(tmp_path / "saved")
    with pytest.raises(ValueError, match="Nothing is saved"):
        project.load(spark, folder)
    t = make(spark, **base())
    project.save(t, folder)
    broken = t.with_(nodes=t.nodes.limit(1), edges=t.edges.withColumn("cost", F.raise_error(F.lit("lost on the way")).cast("double")))
    with pytest.raises(Exception, match="lost on the way"):
        project.save(broken, folder)
    assert project.load(spark, folder).nodes.count() == 2 and len(list((tmp_path / "saved").glob("version-*"))) == 1
    reader = project.load(spark, folder)
    for k, n in enumerate((1, 2, 1)):
        project.save(t.with_(nodes=t.nodes.limit(n)), folder)
        assert project.load(spark, folder).nodes.count() == n
        assert k or reader.nodes.count() == 2  # the save before is still whole
    assert len(list((tmp_path / "saved").glob("version-*"))) == 2


def test_sizes_of_image_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02\x00\x00\x00"
    gif = b"GIF87a" + (300).to_bytes(2, "little") + (513).to_bytes(2, "little")
    exif = b"\xff\xe1" + (60_002).to_bytes(2, "big") + b"\xff\xc0" * 30_000
    jpeg = b"\xff\xd8" + exif + b"\xff\xff\xc4\x00\x04\x00\x00" + b"\xff\xc2\x00\x11\x08" + (768).to_bytes(2, "big") + (1024).to_bytes(2, "big") + b"\x03"
    files = {"a.png": png, "b.gif": gif, "c.jpg": jpeg, "short.jpg": b"\xff\xd8\xff", "scan.jpg": b"\xff\xd8\xff\xda\x00\x04\x00\x00", "short.png": png[:18], "text.png": b"hello", "empty.png": b""}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = {r.path.rsplit("/", 1)[1]: (r.format, r.width, r.height) for r in project.read_images(spark, str(tmp_path)).collect()}
    assert found == {"a.png": ("png", 640, 480), "b.gif": ("gif", 300, 513), "c.jpg": ("jpeg", 1024, 768)}


def test_thinning_by_tiles_equals_the_whole_picture(spark):
    """Thick shapes that lie across many tiles, some thicker than the passes of a round go, in two drawings."""
    rng = np.random.default_rng(12)
    picture = np.zeros((150, 150), bool)
    for x, y, w, h in rng.integers(0, 110, (14, 4)):
        picture[x : x + 4 + w // 3, y : y + 4 + h // 3] = True
    picture &= rng.random(picture.shape) < 0.995
    cells = [("d", int(x) - 40, int(y) - 40) for x, y in zip(*np.nonzero(picture))] + [("e", k, 0) for k in range(40)]
    thin, _ = grid.thin_picture(picture, 1000)
    want = {("d", int(x) - 40, int(y) - 40) for x, y in zip(*np.nonzero(thin))}
    df = spark.createDataFrame(cells, "drawing_id string, cx int, cy int")
    for tile, passes in ((32, 3), (1024, 4), (1024, 24)):
        found = {tuple(r) for r in grid.thin(df, tile, passes).collect()}
        assert {c for c in found if c[0] == "d"} == want and {c for c in found if c[0] == "e"} == {("e", k, 0) for k in range(40)}
    assert grid.thin(df.limit(0)).count() == 0
