"""Counts, neighbours and references over whole relations: small compositions of joins, groups and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolark.functions.keys import last_wins
from topolark.functions.staging import Staging
from topolark.operators import audit, select
from topolark.operators.spatial import crossed, within
from topolark.plans.topology import Topology


def used_places(places: DataFrame, points: DataFrame) -> DataFrame:
    """Places that one of the access points belongs to."""
    return places.join(points.select(F.col("place_id").alias("id")), "id", "left_semi")


def shares_inside(points: DataFrame, found: DataFrame, run: Column, least: float = 0.5) -> DataFrame:
    """(drawing_id, run, share) of the runs of points (drawing_id, idx) of which at least that share is among found."""
    inside = found.select("drawing_id", "idx").distinct().withColumn("in_", F.lit(1.0))
    rows = points.select("drawing_id", "idx").join(inside, ["drawing_id", "idx"], "left").withColumn("run", run)
    return rows.groupBy("drawing_id", "run").agg(F.avg(F.coalesce("in_", F.lit(0.0))).alias("share")).where(F.col("share") >= least)


def edges_by_kind(t: Topology) -> DataFrame:
    """(kind, edges, cost) of the segments that edges belong to; costs that are no numbers don't count."""
    kinds = last_wins(t.segments).select(F.col("id").alias("segment_id"), "kind")
    cost = F.when(~F.isnan("cost") & (F.abs("cost") < 1e300), F.col("cost"))
    return t.edges.join(kinds, "segment_id").groupBy("kind").agg(F.count("*").alias("edges"), F.sum(cost).alias("cost"))


def dangling_links(t: Topology) -> DataFrame:
    """Links whose node doesn't exist."""
    return t.links.join(t.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def joined_nodes(t: Topology) -> DataFrame:
    """Nodes that are an end of a segment."""
    return t.nodes.join(t.segments.select(F.explode(F.array("from_node_id", "to_node_id")).alias("id")), "id", "left_semi")


def stop_pairs(t: Topology) -> DataFrame:
    """(connector_id, a, b): ordered pairs of different stop nodes of a connector."""
    a, b = (t.connector_stops.select("connector_id", F.col("node_id").alias(name)) for name in "ab")
    return a.join(b, "connector_id").where("a <> b")


def floor_counts(t: Topology) -> DataFrame:
    """(floor_id, nodes, places, paths) of every floor that has any."""
    nodes = t.nodes.groupBy("floor_id").agg(F.count("*").alias("nodes"))
    places = t.access_points.groupBy("floor_id").agg(F.countDistinct("place_id").alias("places"))
    paths = select.end_floors(t).groupBy(F.col("a_floor_id").alias("floor_id")).agg(F.count("*").alias("paths"))
    return nodes.join(places, "floor_id", "full_outer").join(paths, "floor_id", "full_outer")


def distinct_counts(t: Topology) -> DataFrame:
    """(floor_id, places, network_nodes) of the access points."""
    return t.access_points.groupBy("floor_id").agg(F.countDistinct("place_id").alias("places"), F.countDistinct("node_id").alias("network_nodes"))


def segment_flags(edges: DataFrame) -> DataFrame:
    """(segment_id, any_enabled, all_positive) of the edges of each segment."""
    return edges.groupBy("segment_id").agg(F.bool_or(audit.enabled()).alias("any_enabled"), F.bool_and(F.col("cost") > 0).alias("all_positive"))


def first_labels(labels: DataFrame) -> DataFrame:
    """The first label of each text of a drawing, whatever its case."""
    place = F.row_number().over(Window.partitionBy("drawing_id", F.upper("text")).orderBy("idx"))
    return labels.withColumn("n_", place).where("n_ = 1").drop("n_")


def nearest_labels(rooms: DataFrame, labels: DataFrame, reach: float) -> DataFrame:
    """(drawing_id, idx, label_idx): the nearest label within reach of each room, the first on ties."""
    at = labels.select("drawing_id", F.col("idx").alias("label_idx"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = within(rooms.select("drawing_id", "idx", "x", "y"), at, reach, ("drawing_id",))
    return near.groupBy("drawing_id", "idx").agg(F.min_by("label_idx", F.struct("far", "label_idx")).alias("label_idx"))


def next_nodes(nodes: DataFrame) -> DataFrame:
    """(floor_id, a, b): each node of a floor and the one that follows it in the document."""
    after = F.lead("id").over(Window.partitionBy("floor_id").orderBy("idx"))
    return nodes.select("floor_id", F.col("id").alias("a"), after.alias("b")).where("b is not null")


def floor_changes(nodes: DataFrame, run: Column) -> DataFrame:
    """(idx, floor_id) where a run of nodes begins or its floor changes."""
    before = F.lag("floor_id").over(Window.partitionBy(run).orderBy("idx"))
    return nodes.select("idx", "floor_id", before.alias("p")).where("p is null or p <> floor_id").select("idx", "floor_id")


def hops_by_sight(hops: DataFrame, walls: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(hop_id, crosses, length) of hops (hop_id, ax, ay, bx, by): those in line of sight first, then by length.

    on: columns that a hop and the walls of its drawing share.
    """
    staging = Staging(hops.sparkSession)
    hops = staging.write(hops.select(*on, "hop_id", "ax", "ay", "bx", "by"))
    met = crossed(hops, walls, on, staging=staging).select("hop_id").distinct().withColumn("crosses", F.lit(True))
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    rows = hops.join(met, "hop_id", "left").select("hop_id", F.coalesce("crosses", F.lit(False)).alias("crosses"), F.round(length, 6).alias("length"))
    return rows.orderBy("crosses", "length", "hop_id")


def nearest_nodes(nodes: DataFrame, x: float, y: float, k: int) -> DataFrame:
    """(id, far) of the k nodes nearest to a point, the first on ties."""
    far = F.round(F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2), 6)
    return nodes.withColumn("far", far).orderBy("far", "idx").limit(k).select("id", "far")


def common_floors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Floors that rows of both relations lie on."""
    return a.select("floor_id").intersect(b.select("floor_id"))
