"""Plans that hold at size: nothing that grows with pairs is broadcast, written or joined again, with the results of going through all."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from topolark.functions.staging import Staging
from topolark.operators import drawing, mutate, network, route, spatial, validate
from topolark.plans import q_mutate, topology
from topolark.sources import project

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_exploded_labels_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(driver.queries()["join5"](spark, FOLDER))


def test_pairs_of_places_give_the_pairs_of_rows(spark):
    rng = random.Random(5)
    spots = [(rng.uniform(0, 90), rng.uniform(0, 90)) for _ in range(9)]
    left, right = ([(f"D{k % 2}", k, *rng.choice(spots)) for k in range(n)] for n in (60, 50))
    a, b = spark.createDataFrame(left, "drawing_id string, idx long, x double, y double"), spark.createDataFrame(right, "drawing_id string, other long, rx double, ry double")
    found = spatial.within_alike(a, b, 30.0, "idx", "other", ("drawing_id",))
    want = sorted((p[0], p[1], q[1]) for p in left for q in right if p[0] == q[0] and math.hypot(p[2] - q[2], p[3] - q[3]) <= 30)
    assert sorted((r.drawing_id, r.idx, r.other) for r in found.collect()) == want


def repeated_labels(spark, n: int = 60, many: int = 6):
    rows = [(f"D{k % 2}", k, float(k % many) * 9, float(k % 2)) for k in range(n)]
    return spark.createDataFrame(rows, "drawing_id string, idx long, x double, y double")


def squares(spark, n: int = 24):
    rows = [(f"D{k % 2}", k, [(x - 1.0, -1.0), (x + 12.0, -1.0), (x + 12.0, 5.0), (x - 1.0, 5.0)]) for k in range(n) for x in [float(k % 4) * 9]]
    return spark.createDataFrame(rows, "drawing_id string, poly_id long, points array<struct<x: double, y: double>>")


def test_labels_and_outlines_in_one_place_meet_once(spark, monkeypatch):
    labels, outlines, seen, real = repeated_labels(spark), squares(spark), [], drawing.enclosing
    pairs = sorted((r.drawing_id, r.poly_id, r.idx) for r in real(labels, outlines).collect())

    def counted(points, shapes, *rest):
        seen.append((points.count(), shapes.count()))
        return real(points, shapes, *rest)

    monkeypatch.setattr(drawing, "enclosing", counted)
    assert sorted((r.drawing_id, r.poly_id, r.idx) for r in drawing.labels_inside(labels, outlines).collect()) == pairs
    counts = {(r.drawing_id, r.poly_id): r.inside for r in drawing.counts_inside(labels, outlines).collect()}
    assert counts == {k: sum(p[:2] == k for p in pairs) for k in {p[:2] for p in pairs}}
    assert sorted(tuple(r) for r in drawing.labels_found(labels, outlines).collect()) == sorted({(p[0], p[2]) for p in pairs})
    assert seen == [(6, 4)] * 3


def test_vertical_labels_in_one_place_share_their_rooms(spark, monkeypatch):
    seen, real = [], network.within

    def counted(left, right, *rest, **more):
        seen.append((left.count(), right.count()))
        return real(left, right, *rest, **more)

    monkeypatch.setattr(network, "within", counted)
    labels = repeated_labels(spark)
    positions = labels.where("idx % 5 < 2").selectExpr("drawing_id", "idx as ord", "if(idx % 5 = 0, 'stair', 'elevator') as kind", "x", "y")
    walls = spark.createDataFrame([("D0", k, "line", layer, 20.0, 0.0, 21.0, 2.0) for k, layer in enumerate(["A-FLOR-STRS"] * 9 + ["X|A-FLOR-EVTR"] * 9)], "drawing_id string, idx long, type string, layer string, x1 double, y1 double, x2 double, y2 double")
    found = network.mark_vertical(labels.selectExpr("*", "'room' as type"), walls, positions)
    got = {(r.drawing_id, r.idx): r.type for r in found.collect()}
    # One by one: stairs first, each in order takes the nearest free room, if the layer is drawn there.
    rooms = {(r.drawing_id, r.idx): (r.x, r.y) for r in labels.collect()}
    want = dict.fromkeys(rooms, "room")
    for p in sorted(positions.collect(), key=lambda p: (p.kind == "elevator", p.ord)):
        free = [(math.hypot(x - p.x, y - p.y), i) for (d, i), (x, y) in rooms.items() if d == p.drawing_id and want[d, i] == "room" and math.hypot(x - p.x, y - p.y) <= 40]
        if free:
            x, y = rooms[p.drawing_id, min(free)[1]]
            if p.drawing_id == "D0" and min(math.hypot(x - 20, y), math.hypot(x - 21, y - 2)) <= 40:
                want[p.drawing_id, min(free)[1]] = p.kind
    assert got == want and {"stair", "elevator"} <= set(got.values())
    assert seen == [(6, 4), (6, 12)]


@needs_tables
def test_paired_links_are_searched_by_places_and_give_the_same_routes(spark):
    t = topology.derive_staged(spark, FOLDER)
    plain = t.with_(links=Staging(spark).write(t.links))
    asked, paired = [], t.links._paired
    t.links._paired = lambda points, on: asked.append(points) or paired(points, on)
    wanted = t.places.selectExpr("'P4' as from_place_id", "id as to_place_id", "explode(array(false, true)) as step_free")
    rows = lambda found: sorted(map(str, found.collect()))
    assert rows(route.find_routes(t, wanted)) == rows(route.find_routes(plain, wanted))
    some = spark.createDataFrame([("P4",), ("P1",)], "place_id string")
    assert rows(route.place_distances(t, some)) == rows(route.place_distances(plain, some))
    assert len(asked) == 2  # where routes start, not where they end


@needs_tables
def test_edits_of_paired_links_make_no_pairs_to_count_or_to_remove(spark):
    t = topology.derive_staged(spark, FOLDER)
    plain = t.with_(links=Staging(spark).write(t.links))
    rows = lambda found: sorted(map(str, found.collect()))
    for edit in (lambda t: mutate.delete_segment(t, "S1-2"), lambda t: mutate.delete_place(t, "P8"), lambda t: mutate.delete_node(t, "N1")):
        sizes = q_mutate.sizes(edit(t))
        assert rows(sizes) == rows(q_mutate.sizes(edit(plain)))
        assert "sqrt" not in plan(sizes).lower()  # no link gets a cost
    toggles = t.access_points.selectExpr("id as access_point_id", "concat('N', idx % 4) as node_id")
    one = t.links.where("idx % 3 = 0").select("access_point_id", "node_id")
    same = [c for c in mutate.toggle_links(t, toggles).columns]
    assert rows(mutate.toggle_links(t, toggles, F.col("idx") % 3 == 0).select(*same)) == rows(mutate.toggle_links(plain, toggles.unionByName(one)).select(*same))


@needs_tables
def test_paired_links_are_kept_in_files_as_their_ends(spark, tmp_path):
    t = topology.derive_staged(spark, FOLDER)
    rows = lambda t: sorted(map(str, t.links.select("id", "access_point_id", "node_id", "cost", "idx").collect()))
    links = rows(t)
    project.save(t, str(tmp_path / "saved"))
    project.write_parts(t, "m", "Map", "2024-01-01T00:00:00Z", str(tmp_path / "parts"))
    assert rows(project.load(spark, str(tmp_path / "saved"))) == links
    back, head = project.read_parts(spark, str(tmp_path / "parts"))
    assert rows(back) == links and head["name"] == "Map"
    assert sorted(map(str, back.edges.select("id", "cost").collect())) == sorted(map(str, t.edges.select("id", "cost").collect()))
    files = sorted((tmp_path / "parts").glob("section_=*/part-*"), key=lambda f: (int(f.parent.name.split("=")[1]), f.name))
    said = json.loads("".join(f.read_text() for f in files))["topology"]
    assert len(said["linkedPoints"]) == t.access_points.count() and len(said["linkedNodes"]) == t.nodes.count() and "terminalAccessLinks" not in said
    with pytest.raises(ValueError, match="Unknown rule"):
        topology.with_ends(t, "other", *t.links._ends.values())


@needs_tables
def test_no_row_holds_the_document_of_src1(spark):
    assert "collect_list(struct(i" not in plan(driver.queries()["src1"](spark, FOLDER))


@needs_tables
def test_perturbed_pairs_are_checked_by_their_ends(spark):
    t = topology.derive_staged(spark, FOLDER, perturbed=True)
    plain = t.with_(links=Staging(spark).write(t.links))
    rows = lambda found: sorted(map(str, found.collect()))
    for rule in (1, 17, 18, 19, 20, 21):
        assert rows(validate.check(t, rule)) == rows(validate.check(plain, rule))
    issues = validate.validate(t)
    assert rows(issues) == rows(validate.validate(plain))
    sorts = [line for line in plan(validate.check(t, 1)).splitlines() if "Sort [" in line and "concat(L" in line]
    assert not sorts and "access_point_id" not in "".join(line for line in plan(issues).splitlines() if "Exchange" in line)
