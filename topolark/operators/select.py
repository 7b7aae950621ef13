"""Views of a topology: filters, look-ups and menu rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topolark.functions.keys import first_wins, last_wins, natural_key, renamed
from topolark.plans.topology import Topology, links_of_kept


def floors_of(t: Topology, building_id: str) -> DataFrame:
    return t.floors.where(F.col("building_id") == building_id)


def end_floors(t: Topology) -> DataFrame:
    """Segments with the floors of their ends (null where unknown)."""
    node = last_wins(t.nodes)
    a, b = renamed(node, "a_", "id", "floor_id"), renamed(node, "b_", "id", "floor_id")
    return t.segments.join(a, F.col("from_node_id") == F.col("a_id"), "left").join(b, F.col("to_node_id") == F.col("b_id"), "left")


def segments_inside(t: Topology, floor_id: str) -> DataFrame:
    return end_floors(t).where((F.col("a_floor_id") == floor_id) & (F.col("b_floor_id") == floor_id)).select(*t.segments.columns)


def connections_at(t: Topology, floor_id: str) -> DataFrame:
    """Building connections with either end on the floor."""
    return end_floors(t).where("kind = 'building_connection'").where((F.col("a_floor_id") == floor_id) | (F.col("b_floor_id") == floor_id))


def remote_ends(t: Topology, floor_id: str) -> DataFrame:
    """(id, remote_node_id, level, building) of each connection at a floor, seen from there."""
    rows = connections_at(t, floor_id)
    local = F.col("a_floor_id") == floor_id
    rows = rows.withColumns({"remote_node_id": F.when(local, F.col("to_node_id")).otherwise(F.col("from_node_id")), "remote_floor": F.when(local, F.col("b_floor_id")).otherwise(F.col("a_floor_id"))})
    rows = rows.join(renamed(first_wins(t.floors), "f_", "id", "level", "building_id"), F.col("remote_floor") == F.col("f_id"), "left")
    rows = rows.join(renamed(first_wins(t.buildings), "g_", "id", "name"), F.col("f_building_id") == F.col("g_id"), "left")
    return rows.select("id", "remote_node_id", F.coalesce("f_level", F.lit("?")).alias("level"), F.coalesce("g_name", F.lit("OTHER BUILDING")).alias("building"))


def point_positions(t: Topology, floor_id: str | None = None) -> DataFrame:
    """(id, place_id, x, y) of access points with a place and a position, own or the node's."""
    rows = t.access_points if floor_id is None else t.access_points.where(F.col("floor_id") == floor_id)
    rows = rows.join(renamed(last_wins(t.nodes), "n_", "id", "x", "y"), F.col("node_id") == F.col("n_id"), "left")
    own = F.col("connection") == "terminal"
    rows = rows.withColumns({"px": F.when(own, F.col("x")).otherwise(F.col("n_x")), "py": F.when(own, F.col("y")).otherwise(F.col("n_y"))})
    rows = rows.join(t.places.select(F.col("id").alias("p_id")).distinct(), F.col("place_id") == F.col("p_id"), "left_semi").where("px is not null")
    return rows.select("id", "place_id", F.col("px").alias("x"), F.col("py").alias("y"))


def drawable_links(t: Topology, floor_id: str) -> DataFrame:
    """Links of a floor's points to its nodes. Of paired links the ends are taken before they meet."""
    points = t.access_points.where(F.col("floor_id") == floor_id).select(F.col("id").alias("a_id"))
    nodes = t.nodes.where(F.col("floor_id") == floor_id).select(F.col("id").alias("n_id"))
    return links_of_kept(t, lambda rows, on: rows.join(points, F.col(on) == F.col("a_id"), "left_semi"), lambda rows, on: rows.join(nodes, F.col(on) == F.col("n_id"), "left_semi"))


def linked_nodes(t: Topology, place_id: str) -> DataFrame:
    points = t.access_points.where(F.col("place_id") == place_id).select(F.col("id").alias("a_id"))
    links = t.links.join(points, F.col("access_point_id") == F.col("a_id"), "left_semi").select(F.col("node_id").alias("l_id"))
    return t.nodes.join(links, F.col("id") == F.col("l_id"), "left_semi")


def place_menu(t: Topology) -> DataFrame:
    """Places with an access point: building, floors (levels in order of points, once each) and name, with sort keys."""
    levels = t.access_points.join(renamed(last_wins(t.floors), "f_", "id", "level"), F.col("floor_id") == F.col("f_id"), "left").withColumn("level", F.coalesce("f_level", "floor_id"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "level"))), lambda s: s.level)
    labels = levels.groupBy("place_id").agg(F.array_join(F.array_distinct(ordered), "/").alias("floor_label"))
    names = renamed(last_wins(t.buildings), "g_", "id", "name")
    rows = t.places.join(labels, F.col("id") == F.col("place_id")).join(names, F.col("building_id") == F.col("g_id"), "left")
    return rows.select("id", F.coalesce("g_name", "building_id").alias("building"), "floor_label", "name", natural_key(F.col("floor_label")).alias("floor_key"), natural_key(F.col("name")).alias("name_key"))


def sorted_menu(t: Topology) -> DataFrame:
    return place_menu(t).orderBy(F.lower("building"), "floor_key", "name_key", "id")
