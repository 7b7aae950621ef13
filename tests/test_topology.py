import numpy as np
import pytest
from fixtures import base, make, tall

from topolark.operators import audit, mutate, route, suggest, validate
from topolark.plans.topology import staged


def codes(t):
    return sorted((r.code, r.path) for r in validate.validate(t).collect())


def asked(spark, t, a, b, free=False):
    return route.find_routes(t, spark.createDataFrame([(a, b, free)], "from_place_id string, to_place_id string, step_free boolean")).first()


def test_valid_map_has_no_issues(spark):
    assert codes(make(spark, **base())) == []


def test_link_across_floors(spark):
    t = make(spark, **base(west_floor="f5", floors=[("f5", "b1", "5", "Five")]))
    assert codes(t) == [("floor_mismatch", "terminalAccessLinks[0].nodeId")]


def test_route_by_stairs(spark):
    r = asked(spark, make(spark, **tall()), "room", "upper")
    assert (r.status, r.total_cost, r.floor_ids) == ("ok", 300.0, ["f4", "f5"])
    assert [h.kind for h in r.traversals] == ["stairs", "path"]
    assert r.traversals[0].instruction == "Take Core from floor 4 to floor 5."
    assert (r.arrival_instruction, r.origin_instruction) == ("You are there.", "Leave.")


def test_step_free_refuses_stairs_and_takes_the_elevator(spark):
    assert asked(spark, make(spark, **tall()), "room", "upper", True).status == "no_step_free_route"
    r = asked(spark, make(spark, **tall("elevator")), "room", "upper", True)
    assert (r.status, r.total_cost) == ("ok", 240.0) and {h.kind for h in r.traversals} == {"elevator", "path"}


def crossing():
    return base(
        east="building_portal",
        buildings=[("b2", "Other")],
        floors=[("g4", "b2", "4", "Four")],
        places=[("far", "b2", "room", "Far", "410")],
        access_points=[("far-door", "far", "g4", "terminal", None, 0.0, 0.0)],
        nodes=[("portal", "g4", "building_portal", 0.0, 0.0), ("inner", "g4", "junction", 40.0, 0.0)],
        segments=[("bridge", "building_connection", "east", "portal"), ("inside", "hallway", "portal", "inner")],
        edges=[("e5", "bridge", "east", "portal", 60.0, "Cross.", None, None), ("e6", "inside", "portal", "inner", 80.0, "In.", None, None), ("e7", "bridge", "portal", "east", 60.0, "Cross.", None, None)],
        links=[("l9", "far-door", "inner", 20.0, "There.", None)],
    )


def test_route_across_buildings(spark):
    t = make(spark, **crossing())
    r = asked(spark, t, "room", "far")
    assert (r.total_cost, r.floor_ids) == (50 + 60 + 80 + 20, ["f4", "g4"])
    assert (r.traversals[0].kind, r.traversals[0].destination_floor_id, r.traversals[0].instruction) == ("building_connection", "g4", "Cross.")
    assert codes(t) == []


def test_statuses(spark):
    t = make(spark, **tall())
    assert asked(spark, t, "room", "room").status == "same_place"
    assert asked(spark, t, "room", "nowhere").status == "no_access"
    assert asked(spark, t, "upper", "room").status == "ok"
    lines = route.directions(route.find_routes(t, spark.createDataFrame([("room", "upper", False)], "from_place_id string, to_place_id string, step_free boolean"))).orderBy("step").collect()
    assert [x.instruction for x in lines] == ["Leave.", "Take Core from floor 4 to floor 5.", "On.", "You are there."]


def rows_of(routes):
    return sorted(routes.collect(), key=lambda r: (r.from_place_id or "", r.to_place_id or "", r.step_free))


def test_joins_and_search_agree_on_whole_routes(spark):
    for t in (make(spark, **tall()), make(spark, **tall("elevator")), make(spark, **crossing())):
        places = [r.id for r in t.places.collect()] + ["nowhere"]
        wanted = spark.createDataFrame([(a, b, f) for a in places for b in places for f in (False, True)], "from_place_id string, to_place_id string, step_free boolean")
        found = rows_of(route.find_routes(t, wanted))
        assert found == rows_of(route.find_routes(t, wanted, most_broadcast=0))
        assert any(r.status == "ok" and r.traversals for r in found)


def test_joins_and_search_agree_on_a_grid_of_ties(spark):
    """A grid on which many routes cost the same, hops that cost nothing among them."""
    rng, size = np.random.default_rng(1), 5
    name = lambda i, j: f"n{i}{j}"
    rows = base(places=[(f"p{i}", "b1", "landmark", f"P{i}", None) for i in range(size)], access_points=[(f"a{i}", f"p{i}", "f4", "network_node", name(i, size - 1 - i), None, None) for i in range(size)])
    rows["nodes"] += [(name(i, j), "f4", "turn", 0.0, 0.0) for i in range(size) for j in range(size)]
    steps = [(name(i, j), name(i + a, j + b)) for i in range(size) for j in range(size) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + a < size and 0 <= j + b < size]
    rng.shuffle(steps)
    rows["segments"] += [(f"g{k}", "hallway", u, v) for k, (u, v) in enumerate(steps)]
    rows["edges"] += [(f"h{k}", f"g{k}", str(u), str(v), float(rng.integers(0, 3)), None, None, None) for k, (u, v) in enumerate(steps)]
    t = make(spark, **rows)
    wanted = spark.createDataFrame([(f"p{a}", f"p{b}", False) for a in range(size) for b in range(size)], "from_place_id string, to_place_id string, step_free boolean")
    found = rows_of(route.find_routes(t, wanted))
    assert found == rows_of(route.find_routes(t, wanted, most_broadcast=0))
    assert all(r.status == ("same_place" if r.from_place_id == r.to_place_id else "ok") for r in found)


def test_plans_read_each_relation_once(spark):
    """Rows of a collection are read once for all their rules; look-ups and removed ids are written tables."""
    t = staged(make(spark, **crossing()))
    scans = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("FileScan")
    own = len(vars(t)) - 1
    assert scans(validate.validate(t)) <= own + 24  # the relations, connectors of elements, and look-ups
    cut = mutate.remove_floor(t, "f4")
    assert sum(scans(getattr(cut, name)) for name in ("nodes", "segments", "edges", "links", "places")) <= 5 + 8


def test_endless_falling_costs_raise(spark):
    graph = spark.createDataFrame([("a", "b", -2.0), ("b", "a", 1.0)], "from_node_id string, to_node_id string, cost double")
    seeds = spark.createDataFrame([("s", "a", 0.0)], "source string, node_id string, cost double")
    for most in (10, 0):
        with pytest.raises(Exception, match="fall for ever"):
            route.distances(seeds, graph, most_broadcast=most).collect()


def test_ties_keep_the_first_hop(spark):
    rows = base(nodes=[("a", "f4", "turn", 0.0, 0.0), ("b", "f4", "turn", 0.0, 0.0), ("z", "f4", "turn", 0.0, 0.0)], places=[("goal", "b1", "landmark", "Goal", None)], access_points=[("net", "goal", "f4", "network_node", "z", None, None)])
    rows["segments"] += [(f"s{k}", "hallway", u, v) for k, (u, v) in enumerate([("west", "b"), ("west", "a"), ("a", "z"), ("b", "z")])]
    rows["edges"] += [(f"t{k}", f"s{k}", u, v, 5.0, None, None, None) for k, (u, v) in enumerate([("west", "b"), ("west", "a"), ("a", "z"), ("b", "z")])]
    assert [h.to_node_id for h in asked(spark, make(spark, **rows), "room", "goal").traversals] == ["b", "z"]


def test_remove_only_floor(spark):
    t = mutate.remove_floor(make(spark, **base()), "f4")
    assert {n: getattr(t, n).count() for n in ("buildings", "floors", "places", "access_points", "nodes", "segments", "edges", "links")} == {"buildings": 1, "floors": 0, "places": 0, "access_points": 0, "nodes": 0, "segments": 0, "edges": 0, "links": 0}
    same = make(spark, **base())
    assert mutate.remove_floor(same, "unknown").nodes.count() == 2


def test_remove_building_keeps_the_near_portal(spark):
    t = mutate.remove_building(make(spark, **crossing()), "b2")
    assert sorted(r.id for r in t.nodes.collect()) == ["east", "west"]
    assert sorted(r.id for r in t.segments.collect()) == ["hall"] and sorted(r.id for r in t.edges.collect()) == ["e1", "e2"]
    assert [r.id for r in t.buildings.collect()] == ["b1"] and codes(t) == []
    with pytest.raises(ValueError):
        mutate.guarded_remove_building(t, "b1")


def test_removed_floor_hands_the_connector_to_another_place(spark):
    rows = tall()
    rows["places"] += [("s4", "b1", "stairs", "Stairs 4", None), ("s5", "b1", "stairs", "Stairs 5", None)]
    rows["access_points"] += [("p4", "s4", "f4", "network_node", "east", None, None), ("p5", "s5", "f5", "network_node", "up", None, None)]
    rows["connectors"] = [("c1", "stairs", "Core", "s4")]
    t = mutate.remove_floor(make(spark, **rows), "f4")
    assert [r.place_id for r in t.connectors.collect()] == ["s5"]
    assert [r.node_id for r in t.connector_stops.collect()] == ["up"] and codes(t) == []


def test_audit_and_repair(spark):
    rows = tall()
    rows["nodes"] += [("lone", "f5", "stair_landing", 0.0, 0.0)]
    rows["connector_stops"] = [("c1", "stairs", 0, "east"), ("c1", "stairs", 1, "lone"), ("c1", "stairs", 2, "gone"), ("c1", "stairs", 3, "mid")]
    rows["access_points"] += [("pl", "upper", "f5", "network_node", "lone", None, None)]
    t = make(spark, **rows)
    found = {r.stop_node_id: (r.code, r.floor_id, r.replacement_node_id) for r in audit.audit(t).collect()}
    assert found == {"lone": ("isolated_stop", "f5", "up"), "gone": ("missing_stop", "unknown", None), "mid": ("wrong_stop_kind", "f5", None)}
    fixed = audit.repair(t)
    assert [(r.previous_node_id, r.replacement_node_id) for r in fixed.repairs.collect()] == [("lone", "up")]
    assert [r.node_id for r in fixed.topology.connector_stops.orderBy("pos").collect()] == ["east", "up", "gone", "mid"]
    assert {r.id: r.label for r in fixed.topology.nodes.collect()} == {"west": None, "east": None, "up": "Core", "mid": None}
    assert fixed.topology.access_points.where("id = 'pl'").first().node_id == "up"


def test_accept_rooms(spark):
    t = make(spark, **base())
    offered = spark.createDataFrame([("f4", 0, "4210", 5.0, 6.0), ("f4", 1, "400", 1.0, 1.0), ("f4", 2, "4210", 9.0, 9.0)], "floor_id string, ord long, room_number string, x double, y double")
    out = suggest.accept_rooms(t, offered)
    new = out.places.where("room_number = '4210'").collect()
    assert len(new) == 1 and out.places.count() == 2 and out.access_points.count() == 2 and out.links.count() == 2
    assert out.access_points.where(f"place_id = '{new[0].id}'").first().connection == "terminal" and codes(out) == []


def test_accept_hallway(spark):
    t = make(spark, buildings=[("b1", "Main")], floors=[("f4", "b1", "4", "Four")])
    points = spark.createDataFrame([("f4", "h", k, x, y) for k, (x, y) in enumerate([(10.0, 20.0), (50.0, 20.0), (50.0, 80.0)])], "floor_id string, hallway string, pos long, x double, y double")
    out = suggest.accept_hallways(t, points)
    assert {(r.x, r.y): r.kind for r in out.nodes.collect()} == {(10.0, 20.0): "hallway_endpoint", (50.0, 20.0): "turn", (50.0, 80.0): "hallway_endpoint"}
    assert out.segments.count() == 2
    assert sorted((r.cost, r.direction) for r in out.edges.collect()) == [(40.0, "east"), (40.0, "west"), (60.0, "north"), (60.0, "south")]
    assert suggest.accept_hallways(out, points).segments.count() == 2


@pytest.mark.parametrize("relation, row, code", [
    ("floors", ("f9", "b9", "9", "x"), "missing_building"), ("nodes", ("n9", "f9", "turn", 0.0, 0.0), "missing_floor"), ("segments", ("s9", "hallway", "west", "west"), "self_segment"),
    ("segments", ("s9", "building_connection", "west", "east"), "building_connection_same_building"), ("edges", ("e9", "none", "west", "east", 1.0, None, None, None), "missing_segment"),
    ("edges", ("e9", "hall", "west", "east", float("nan"), None, None, None), "invalid_cost"), ("edges", ("e9", "hall", "west", "west", 1.0, None, None, None), "edge_segment_mismatch"),
    ("links", ("l9", "none", "west", 1.0, None, None), "missing_access_point"), ("connectors", ("c9", "stairs", "x", "none"), "missing_place"), ("nodes", ("west", "f4", "turn", 0.0, 0.0), "duplicate_id"),
])
def test_each_rule_fires(spark, relation, row, code):
    assert code in {c for c, _ in codes(make(spark, **base(**{relation: [row]})))}


def along(spark, n):
    """A line of nodes, hops both ways, whose costs tell the direction."""
    name = lambda k: f"n{k:05d}"
    hops = [(name(k), name(k + 1), 1.0) for k in range(n - 1)] + [(name(k + 1), name(k), 2.0) for k in range(n - 1)]
    return spark.createDataFrame(hops, "from_node_id string, to_node_id string, cost double"), spark.createDataFrame([("s", name(10), 5.0), ("z", name(n - 1), 0.0)], "source string, node_id string, cost double")


def test_distances_along_a_long_line(spark):
    """5000 nodes in a row, as one part and in parts that a way passes one after another."""
    hops, seeds = along(spark, 5000)
    want = {("s", f"n{k:05d}"): 5.0 + (k - 10 if k >= 10 else 2.0 * (10 - k)) for k in range(5000)} | {("z", f"n{k:05d}"): 2.0 * (4999 - k) for k in range(5000)}
    for most in (route.MOST_BROADCAST, 4000):
        assert {(r.source, r.node_id): r.cost for r in route.distances(seeds, hops, most).collect()} == want


def test_plan_of_distances_does_not_grow_with_rounds(spark):
    hops, seeds = along(spark, 40)
    sizes = [len(route.distances(seeds, hops, most)._jdf.queryExecution().analyzed().toString()) for most in (12, 6)]
    assert sizes[1] < 3 * sizes[0]


def test_whole_routes_do_not_depend_on_parts(spark):
    t = make(spark, **crossing())
    wanted = spark.createDataFrame([("room", "far", False), ("far", "room", False), ("room", "room", True)], "from_place_id string, to_place_id string, step_free boolean")
    assert rows_of(route.find_routes(t, wanted)) == rows_of(route.find_routes(t, wanted, 2))
