"""Small topologies as DataFrames."""

from topolark.plans.topology import Topology

SCHEMAS = {
    "buildings": "id string, name string, idx long",
    "floors": "id string, building_id string, level string, name string, idx long",
    "places": "id string, building_id string, kind string, name string, room_number string, idx long",
    "access_points": "id string, place_id string, floor_id string, connection string, node_id string, x double, y double, idx long",
    "nodes": "id string, floor_id string, kind string, x double, y double, idx long",
    "segments": "id string, kind string, from_node_id string, to_node_id string, idx long",
    "edges": "id string, segment_id string, from_node_id string, to_node_id string, cost double, instruction string, enabled boolean, wheelchair_accessible string, idx long",
    "links": "id string, access_point_id string, node_id string, cost double, to_place_instruction string, from_place_instruction string, idx long",
    "connectors": "id string, kind string, name string, place_id string, idx long",
    "connector_stops": "connector_id string, kind string, pos long, node_id string",
    "connector_segments": "connector_id string, pos long, segment_id string",
    "plans": "id string, floor_id string, file_name string, width double, height double, idx long",
}


def make(spark, **rows) -> Topology:
    """Rows lack their last column, idx, which is their place."""
    out = {}
    for name, schema in SCHEMAS.items():
        given = rows.get(name, [])
        full = [tuple(r) if name.startswith("connector_") else (*r, k) for k, r in enumerate(given)]
        out[name] = spark.createDataFrame(full, schema)
    return Topology(**out)


def base(east="junction", west_floor="f4", **more):
    """One building, a floor at level 4, a hallway of 100 between west and east, a terminal room linked to both."""
    rows = {
        "buildings": [("b1", "Main")],
        "floors": [("f4", "b1", "4", "Four")],
        "places": [("room", "b1", "room", "Room", "400")],
        "access_points": [("door", "room", "f4", "terminal", None, 50.0, 10.0)],
        "nodes": [("west", west_floor, "junction", 0.0, 0.0), ("east", "f4", east, 100.0, 0.0)],
        "segments": [("hall", "hallway", "west", "east")],
        "edges": [("e1", "hall", "west", "east", 100.0, "Go east.", None, None), ("e2", "hall", "east", "west", 100.0, "Go west.", None, None)],
        "links": [("l1", "door", "west", 50.0, "Arrive.", "Leave."), ("l2", "door", "east", 50.0, "Arrive.", "Leave.")],
    }
    for name, extra in more.items():
        rows[name] = rows.get(name, []) + extra
    return rows


def tall(kind="stairs"):
    """The base with a second floor reached by stairs or an elevator."""
    node = "stair_landing" if kind == "stairs" else "elevator_lobby"
    return base(
        east=node,
        floors=[("f5", "b1", "5", "Five")],
        places=[("upper", "b1", "room", "Upper", "500")],
        access_points=[("door5", "upper", "f5", "terminal", None, 0.0, 0.0)],
        nodes=[("up", "f5", node, 100.0, 0.0), ("mid", "f5", "junction", 150.0, 0.0)],
        segments=[("hall5", "hallway", "up", "mid")],
        edges=[("e3", "hall5", "up", "mid", 50.0, "On.", None, None), ("e4", "hall5", "mid", "up", 50.0, "Back.", None, None)],
        links=[("l3", "door5", "mid", 20.0, "You are there.", None)],
        connectors=[("c1", kind, "Core", None)],
        connector_stops=[("c1", kind, 0, "east"), ("c1", kind, 1, "up")],
    )
