"""Room and hallway suggestions from labels, and their acceptance into a topology.

Ids of accepted rows are derived from the suggestion, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolark.functions.keys import clamped_distance, direction, first_wins, half_up, renamed
from topolark.operators.drawing import room_number_match
from topolark.plans.topology import Topology

NETWORK_KINDS = ("hallway_endpoint", "junction", "turn")


def unit(value: Column, size: Column) -> Column:
    """Share of the page, within 0 and 1, at seven digits."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / size)), 7)


def room_suggestions(labels: DataFrame) -> DataFrame:
    """First label of each room number of a drawing's level: drawing_id, idx, id, room_number, x, y.

    labels: drawing_id, idx, text, x, y, level, page_width, page_height.
    """
    number = F.upper(F.trim("text"))
    rows = labels.where(room_number_match(F.col("text"), F.col("level"))).withColumn("room_number", number)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("drawing_id", "room_number").orderBy("idx"))).where("n = 1")
    return first.select("drawing_id", "idx", F.concat(F.lit("room-"), F.lower("room_number")).alias("id"), "room_number", unit(F.col("x"), F.col("page_width")).alias("x"), unit(F.col("y"), F.col("page_height")).alias("y"))


def suggestion_warnings(labels: DataFrame) -> DataFrame:
    """(drawing_id, warning) of drawings without any room suggestion."""
    found = room_suggestions(labels).select("drawing_id").distinct()
    return labels.select("drawing_id").distinct().join(found, "drawing_id", "left_anti").withColumn("warning", F.lit("No room labels matched the selected floor."))


def accept_rooms(t: Topology, suggestions: DataFrame) -> Topology:
    """Rooms (floor_id, ord, room_number, x, y) whose number the floor lacks become places with a terminal point."""
    known = t.places.where("kind = 'room'").select(F.col("id").alias("p_id"), F.upper("room_number").alias("k_number"))
    known = t.access_points.select(F.col("floor_id").alias("k_floor"), "place_id").join(known, F.col("place_id") == F.col("p_id")).select("k_floor", "k_number").distinct()
    floor = renamed(first_wins(t.floors), "f_", "id", "building_id")
    rows = suggestions.withColumn("key", F.upper("room_number")).join(floor, F.col("floor_id") == F.col("f_id"))
    rows = rows.join(known, (F.col("floor_id") == F.col("k_floor")) & (F.col("key") == F.col("k_number")), "left_anti")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("floor_id", "key").orderBy("ord"))).where("n = 1")
    own = F.concat_ws("-", F.lit("suggested"), "floor_id", F.lower("key"))
    places = rows.select(own.alias("id"), F.col("f_building_id").alias("building_id"), F.lit("room").alias("kind"), F.col("room_number").alias("name"), "room_number", (F.lit(1 << 40) + F.col("ord")).alias("idx"))
    points = rows.select(
        F.concat(own, F.lit("-access")).alias("id"), own.alias("place_id"), "floor_id", F.lit("terminal").alias("connection"), F.lit(None).cast("string").alias("node_id"), "x", "y",
        (F.lit(1 << 40) + F.col("ord")).alias("idx"), F.concat(F.lit("Stop at room "), "room_number", F.lit(".")).alias("arrival_instruction"),
    )
    return t.with_(places=t.places.unionByName(places, allowMissingColumns=True), access_points=t.access_points.unionByName(points, allowMissingColumns=True))


def snap_key(x: Column, y: Column) -> Column:
    """Position to half a pixel; minus zero reads as zero."""
    half = lambda v: (half_up(v * 2) / 2 + F.lit(0.0)).cast("string")
    return F.concat_ws(":", half(x), half(y))


def accept_hallways(t: Topology, points: DataFrame) -> Topology:
    """Polylines (floor_id, hallway, pos, x, y, by hallway and pos) become nodes, segments and pairs of edges.

    Points snap to the last network node of their half-pixel key on the floor, else to the first new point.
    Degenerate hops and pairs that any segment joins already are left out.
    """
    keyed = points.withColumn("key", snap_key(F.col("x"), F.col("y")))
    old = t.nodes.where(F.col("kind").isin(*NETWORK_KINDS)).withColumn("key", snap_key(F.col("x"), F.col("y")))
    old = old.groupBy(F.col("floor_id").alias("o_floor"), F.col("key").alias("o_key")).agg(F.max_by(F.struct("id", "x", "y"), "idx").alias("o"))
    order = F.struct("hallway", "pos")
    fresh = keyed.groupBy("floor_id", "key").agg(F.min_by(F.struct("x", "y"), order).alias("at"), F.min(order).alias("seen"))
    fresh = fresh.join(old, (F.col("floor_id") == F.col("o_floor")) & (F.col("key") == F.col("o_key")), "left")
    new_id = F.concat_ws("-", F.lit("suggested-node"), "floor_id", "key")
    nodes = fresh.select("floor_id", "key", F.coalesce("o.id", new_id).alias("node_id"), F.coalesce("o.x", "at.x").alias("nx"), F.coalesce("o.y", "at.y").alias("ny"), F.col("o.id").isNull().alias("is_new"), "seen")
    along = Window.partitionBy("floor_id", "hallway").orderBy("pos")
    hops = keyed.select("floor_id", "hallway", "pos", F.col("key").alias("a_key"), F.lead("key").over(along).alias("b_key")).where("b_key is not null")
    a, b = (nodes.select(F.col("floor_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("key", "node_id", "nx", "ny")]) for p in "ab")
    hops = hops.join(a, ["floor_id", "a_key"]).join(b, ["floor_id", "b_key"]).where("a_node_id <> b_node_id")
    pair = F.array_sort(F.array("a_node_id", "b_node_id"))
    known = t.segments.select(F.array_sort(F.array("from_node_id", "to_node_id")).alias("pair_")).distinct()
    hops = hops.withColumn("pair", pair).join(known, F.col("pair") == F.col("pair_"), "left_anti")
    hops = hops.withColumn("n", F.row_number().over(Window.partitionBy("pair").orderBy("floor_id", "hallway", "pos"))).where("n = 1")
    seg_id = F.concat_ws("-", F.lit("suggested-hallway"), "a_node_id", "b_node_id")
    segments = hops.select(seg_id.alias("id"), F.lit("hallway").alias("kind"), F.col("a_node_id").alias("from_node_id"), F.col("b_node_id").alias("to_node_id"))
    dx, dy = F.col("b_nx") - F.col("a_nx"), F.col("b_ny") - F.col("a_ny")
    cost = half_up(clamped_distance(F.col("a_nx"), F.col("a_ny"), F.col("b_nx"), F.col("b_ny")), 1)
    ways = F.array(F.struct(F.lit("-f").alias("way"), F.col("a_node_id").alias("u"), F.col("b_node_id").alias("v"), direction(dx, dy).alias("d")), F.struct(F.lit("-r").alias("way"), F.col("b_node_id").alias("u"), F.col("a_node_id").alias("v"), direction(-dx, -dy).alias("d")))
    edges = hops.select(seg_id.alias("segment_id"), cost.alias("cost"), F.explode(ways).alias("w"))
    edges = edges.select(F.concat("segment_id", "w.way").alias("id"), "segment_id", F.col("w.u").alias("from_node_id"), F.col("w.v").alias("to_node_id"), "cost", F.col("w.d").alias("direction"), F.concat(F.lit("Continue "), "w.d", F.lit(".")).alias("instruction"))
    every = t.segments.unionByName(segments, allowMissingColumns=True)
    degree = every.select(F.explode(F.array("from_node_id", "to_node_id")).alias("d_id")).groupBy("d_id").agg(F.count("*").alias("degree"))
    # A point that no new hop uses still becomes a node, of degree zero, if its hallway has two points.
    used = hops_keys(keyed)
    made = nodes.where("is_new").join(used, ["floor_id", "key"], "left_semi").join(degree, F.col("node_id") == F.col("d_id"), "left")
    n = F.coalesce("degree", F.lit(0))
    kind = F.when(n >= 3, "junction").when(n <= 1, "hallway_endpoint").otherwise("turn")
    made = made.select(F.col("node_id").alias("id"), "floor_id", kind.alias("kind"), F.col("nx").alias("x"), F.col("ny").alias("y"))
    return t.with_(nodes=t.nodes.unionByName(made, allowMissingColumns=True), segments=every, edges=t.edges.unionByName(edges, allowMissingColumns=True))


def hops_keys(keyed: DataFrame) -> DataFrame:
    """Keys of the points of hallways that have a hop at all."""
    long = keyed.groupBy("floor_id", "hallway").agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    return keyed.join(long, ["floor_id", "hallway"], "left_semi").select("floor_id", "key").distinct()


def dismiss(plans: DataFrame, floor_id: str, category: str = "all") -> DataFrame:
    """Plans with suggestions (struct of rooms, hallways, warnings) of a floor emptied, of one category or all."""
    if category not in ("rooms", "hallways", "all"):
        raise ValueError(category)
    s = F.col("suggestions")
    fields = ("rooms", "hallways", "warnings") if category == "all" else (category,)
    for name in fields:
        s = s.withField(name, F.slice(F.col(f"suggestions.{name}"), 1, 0))
    return plans.withColumn("suggestions", F.when((F.col("floor_id") == floor_id) & F.col("suggestions").isNotNull(), s).otherwise(F.col("suggestions")))
