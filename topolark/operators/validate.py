"""Referential integrity of a topology: rules over views of its collections, as a DataFrame of issues.

An issue has ``rule`` (order of the checks), ``idx`` and ``sub`` (place of the row and of an element in it),
``code``, ``path`` and ``message``; codes and messages are fixed values. Lookups over repeated ids see the last row, as the document's maps do.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolark.functions.keys import bad_cost, last_wins, renamed
from topolark.functions.staging import Staging
from topolark.plans.topology import Topology

#: Names of the collections in a document, by relation and in checking order.
COLLECTIONS = {
    "buildings": "buildings", "floors": "floors", "places": "places", "access_points": "accessPoints", "nodes": "nodes",
    "segments": "segments", "edges": "edges", "links": "terminalAccessLinks", "connectors": "verticalConnectors",
}


def at(collection: str, field: str = "", idx: str = "idx") -> Column:
    return F.concat(F.lit(f"{collection}["), F.col(idx).cast("string"), F.lit("]" + (f".{field}" if field else "")))


class Maps:
    """Look-ups by id over the relations of a topology, each made once where a staging is given."""

    def __init__(self, t: Topology, staging: Staging | None = None):
        self.rows = {name: last_wins(getattr(t, name)) for name in ("buildings", "floors", "places", "access_points", "nodes", "segments")}
        if staging:
            self.rows = staging.write_all(self.rows)

    def join(self, rows: DataFrame, column: str, relation: str, prefix: str, *fields: str) -> DataFrame:
        """rows with fields of what their reference finds; ``<prefix>id`` is null if it finds nothing."""
        found = renamed(self.rows[relation], prefix, "id", *fields)
        return rows.join(found, F.col(column) == F.col(f"{prefix}id"), "left")


@dataclass(frozen=True)
class Rule:
    number: int
    code: str
    broken: Column | str
    path: Column
    message: Column | str
    sub: Column | None = None

    def issue(self) -> Column:
        """The issue of a row that breaks the rule, else null."""
        said = F.lit(self.message) if isinstance(self.message, str) else self.message
        sub = (F.lit(-1) if self.sub is None else self.sub).cast("long")
        issue = F.struct(F.lit(self.number).alias("rule"), F.col("idx").cast("long").alias("idx"), sub.alias("sub"), F.lit(self.code).alias("code"), self.path.alias("path"), said.alias("message"))
        return F.when(F.expr(self.broken) if isinstance(self.broken, str) else self.broken, issue)


def unknown(what: str, column: str) -> Column:
    return F.concat(F.lit(f"Unknown {what}: "), F.col(column))


def element(collection: str, field: str) -> Column:
    return F.concat(at(collection, f"{field}["), F.col("pos").cast("string"), F.lit("]"))


#: Each view gives rows, joined with all that their rules ask for, and these rules, so that one pass checks them all.
View = tuple[DataFrame, list[Rule]]


def numbered(rows: DataFrame) -> DataFrame:
    if hasattr(rows, "_numbered"):  # rows that know which of their id they are
        return rows._numbered()
    return rows.withColumn("again_", F.row_number().over(Window.partitionBy("id").orderBy("idx")))


def repeated(relation: str) -> Rule:
    """The rule of numbered() rows."""
    return Rule(1, "duplicate_id", "again_ > 1", at(COLLECTIONS[relation], "id"), F.concat(F.lit("Duplicate id: "), F.col("id")))


def buildings(t: Topology, maps: Maps) -> View:
    return t.buildings, []


def floors(t: Topology, maps: Maps) -> View:
    return maps.join(t.floors, "building_id", "buildings", "b_"), [Rule(2, "missing_building", "b_id is null", at("floors", "buildingId"), unknown("building", "building_id"))]


def places(t: Topology, maps: Maps) -> View:
    return maps.join(t.places, "building_id", "buildings", "b_"), [Rule(3, "missing_building", "b_id is null", at("places", "buildingId"), unknown("building", "building_id"))]


def nodes(t: Topology, maps: Maps) -> View:
    return maps.join(t.nodes, "floor_id", "floors", "f_"), [Rule(4, "missing_floor", "f_id is null", at("nodes", "floorId"), unknown("floor", "floor_id"))]


def access_points(t: Topology, maps: Maps) -> View:
    rows = maps.join(maps.join(maps.join(t.access_points, "place_id", "places", "p_", "building_id"), "floor_id", "floors", "f_", "building_id"), "node_id", "nodes", "n_")
    name = "accessPoints"
    return rows, [
        Rule(5, "missing_place", "p_id is null", at(name, "placeId"), unknown("place", "place_id")),
        Rule(6, "missing_floor", "f_id is null", at(name, "floorId"), unknown("floor", "floor_id")),
        Rule(7, "building_mismatch", "p_building_id <> f_building_id", at(name, "floorId"), "Access point floor must belong to the place's building"),
        Rule(8, "missing_node", "connection = 'network_node' and n_id is null", at(name, "nodeId"), unknown("node", "node_id")),
    ]


def segments(t: Topology, maps: Maps) -> View:
    """Segments with both end nodes and the buildings of their floors."""
    rows = maps.join(maps.join(t.segments, "from_node_id", "nodes", "a_", "floor_id", "kind"), "to_node_id", "nodes", "b_", "floor_id", "kind")
    rows = maps.join(maps.join(rows, "a_floor_id", "floors", "fa_", "building_id"), "b_floor_id", "floors", "fb_", "building_id")
    both, bridge = "a_id is not null and b_id is not null", "kind = 'building_connection'"
    return rows, [
        Rule(9, "missing_node", "a_id is null or b_id is null", at("segments"), "Segment references an unknown node"),
        Rule(10, "self_segment", "from_node_id = to_node_id", at("segments"), "A path segment must connect different nodes"),
        Rule(11, "building_connection_same_building", f"{both} and {bridge} and fa_building_id <=> fb_building_id", at("segments"), "A building connection must join nodes in different buildings"),
        Rule(12, "building_connection_node_kind", f"{both} and {bridge} and (a_kind <> 'building_portal' or b_kind <> 'building_portal')", at("segments"), "Building connections must use building_portal nodes at both ends"),
        Rule(13, "cross_building_segment_kind", f"{both} and not {bridge} and fa_building_id <> fb_building_id", at("segments", "kind"), "Paths between buildings must use building_connection"),
    ]


def edges(t: Topology, maps: Maps) -> View:
    same = "(from_node_id = s_from_node_id and to_node_id = s_to_node_id) or (from_node_id = s_to_node_id and to_node_id = s_from_node_id)"
    return maps.join(t.edges, "segment_id", "segments", "s_", "from_node_id", "to_node_id"), [
        Rule(14, "missing_segment", "s_id is null", at("edges", "segmentId"), unknown("segment", "segment_id")),
        Rule(15, "edge_segment_mismatch", f"s_id is not null and not ({same})", at("edges"), "Edge endpoints must match its segment"),
        Rule(16, "invalid_cost", bad_cost(F.col("cost")), at("edges", "cost"), "Edge cost must be positive"),
    ]


def links(t: Topology, maps: Maps) -> View:
    name = "terminalAccessLinks"
    if hasattr(t.links, "_viewed"):  # pairs are looked up by their ends
        rows = t.links._viewed(renamed(maps.rows["access_points"], "p_", "id", "connection", "floor_id"), "p_", renamed(maps.rows["nodes"], "n_", "id", "floor_id"), "n_")
    else:
        rows = maps.join(maps.join(t.links, "access_point_id", "access_points", "p_", "connection", "floor_id"), "node_id", "nodes", "n_", "floor_id")
    return rows, [
        Rule(17, "missing_access_point", "p_id is null", at(name, "accessPointId"), "Unknown access point"),
        Rule(18, "non_terminal_access_link", "p_connection <> 'terminal'", at(name, "accessPointId"), "Access link must reference a terminal point"),
        Rule(19, "missing_node", "n_id is null", at(name, "nodeId"), "Unknown node"),
        Rule(20, "floor_mismatch", "p_floor_id <> n_floor_id", at(name, "nodeId"), "Terminal link cannot cross floors"),
        Rule(21, "invalid_cost", bad_cost(F.col("cost")), at(name, "cost"), "Terminal access cost must be positive"),
    ]


def connectors(t: Topology, maps: Maps) -> View:
    rule = Rule(22, "missing_place", "nullif(place_id, '') is not null and p_id is null", at("verticalConnectors", "placeId"), "Connector references an unknown place")
    return maps.join(t.connectors, "place_id", "places", "p_"), [rule]


def with_connector(t: Topology, rows: DataFrame) -> DataFrame:
    """Elements with their connector's row (id may repeat)."""
    return rows.join(t.connectors.select(F.col("id").alias("connector_id"), F.col("kind").alias("c_kind"), "idx"), "connector_id")


def stops(t: Topology, maps: Maps) -> View:
    rows = maps.join(with_connector(t, t.connector_stops.select("connector_id", "pos", "node_id")), "node_id", "nodes", "n_", "floor_id", "kind")
    expected, path = F.when(F.col("c_kind") == "stairs", "stair_landing").otherwise("elevator_lobby"), element("verticalConnectors", "stopNodeIds")
    return rows, [
        Rule(23, "missing_node", "n_id is null", path, "Unknown connector stop node", F.col("pos")),
        Rule(24, "connector_node_kind", F.col("n_kind") != expected, path, F.concat("c_kind", F.lit(" stops must use "), expected, F.lit(" nodes")), F.col("pos")),
    ]


def spans(t: Topology, maps: Maps) -> View:
    """Number of buildings of each connector's stops."""
    rows = maps.join(maps.join(with_connector(t, t.connector_stops.select("connector_id", "node_id")), "node_id", "nodes", "n_", "floor_id"), "n_floor_id", "floors", "f_", "building_id")
    rows = rows.groupBy("idx").agg(F.countDistinct(F.nullif("f_building_id", F.lit(""))).alias("n"))
    message = "A stair or elevator group cannot span different buildings; use a building connection instead"
    return rows, [Rule(25, "vertical_connector_crosses_buildings", "n > 1", at("verticalConnectors", "stopNodeIds"), message)]


def connector_paths(t: Topology, maps: Maps) -> View:
    rows = maps.join(with_connector(t, t.connector_segments), "segment_id", "segments", "s_", "kind")
    path = element("verticalConnectors", "segmentIds")
    return rows, [
        Rule(26, "missing_segment", "s_id is null", path, "Unknown connector segment", F.col("pos")),
        Rule(27, "connector_segment_kind", "s_kind <> c_kind", path, F.concat(F.lit("Connector segments must have kind "), "c_kind"), F.col("pos")),
    ]


VIEWS = (buildings, floors, places, nodes, access_points, segments, edges, links, connectors, stops, spans, connector_paths)


def checked(view: View, only: int | None = None) -> DataFrame:
    """Issues of a view's rows, of all rules or one."""
    rows, rules = view
    # Rows that break nothing go before an array is made of what the others break.
    tests = [F.expr(r.broken) if isinstance(r.broken, str) else r.broken for r in rules if only in (None, r.number)]
    rows = rows.where(reduce(lambda a, b: a | b, [F.coalesce(test, F.lit(False)) for test in tests], F.lit(False)))
    found = F.array(*[r.issue() for r in rules if only in (None, r.number)])
    return rows.select(F.explode(F.filter(found, lambda i: i.isNotNull())).alias("i")).select("i.*")


def check(t: Topology, number: int) -> DataFrame:
    """Issues of one rule."""
    if number == 1:
        return reduce(DataFrame.unionByName, [checked((numbered(getattr(t, name)), [repeated(name)])) for name in COLLECTIONS])
    maps = Maps(t)
    view = next(v for v in (view(t, maps) for view in VIEWS) if any(r.number == number for r in v[1]))
    return checked(view, number)


RULES = tuple(partial(check, number=k) for k in range(1, 28))

#: Place of each rule's group in the document's order of checks; rules of a group interleave by row.
GROUPS = (0, 1, 2, 3, 4, 4, 4, 4, 5, 5, 5, 5, 5, 6, 6, 6, 7, 7, 7, 7, 7, 8, 8, 8, 8, 8, 8)


def validate(t: Topology) -> DataFrame:
    """All issues, with ``group`` to order them: by group, idx, rule and sub.

    Look-ups are written once, and each collection is read once for all its rules.
    """
    maps = Maps(t, Staging(t.nodes.sparkSession))
    t = t.with_(**{name: numbered(rows) for name in COLLECTIONS if not hasattr(rows := getattr(t, name), "_viewed")})
    views = []
    for view in VIEWS:
        rows, rules = view(t, maps)
        views.append((rows, [*([repeated(view.__name__)] if view.__name__ in COLLECTIONS else []), *rules]))
    group = F.element_at(F.array(*[F.lit(g) for g in GROUPS]), F.col("rule"))
    return reduce(DataFrame.unionByName, map(checked, views)).withColumn("group", group)
