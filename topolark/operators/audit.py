"""Audit of vertical connectors and repair of stops that have exactly one possible replacement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolark.functions.keys import last_wins, renamed
from topolark.functions.staging import Staging
from topolark.plans.topology import Topology


@dataclass(frozen=True)
class Repair:
    topology: Topology
    repairs: DataFrame


def enabled() -> Column:
    return F.coalesce(F.col("enabled"), F.lit(True))


def routed_degree(t: Topology) -> DataFrame:
    """(id, degree) of every node: enabled edges that start or end there, a loop counting twice."""
    ends = t.edges.where(enabled()).select(F.explode(F.array("from_node_id", "to_node_id")).alias("id"))
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return t.nodes.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def audit(t: Topology) -> DataFrame:
    """Stops at fault, in the order of connectors and stops; the first fault of a stop counts."""
    expected = F.when(F.col("kind") == "stairs", "stair_landing").otherwise("elevator_lobby")
    of = t.connectors.select(F.col("id").alias("connector_id"), F.col("name").alias("connector_name"), F.col("idx").alias("connector_idx"), expected.alias("expected"))
    node = renamed(last_wins(t.nodes), "n_", "id", "floor_id", "kind")
    degree = renamed(routed_degree(t), "d_", "id", "degree")
    stops = t.connector_stops.select("connector_id", "pos", F.col("node_id").alias("stop_node_id")).join(of, "connector_id")
    stops = stops.join(node, F.col("stop_node_id") == F.col("n_id"), "left").join(degree, F.col("stop_node_id") == F.col("d_id"), "left")
    code = F.when(F.col("n_id").isNull(), "missing_stop").when(F.col("n_kind") != F.col("expected"), "wrong_stop_kind").when(F.coalesce("d_degree", F.lit(0)) == 0, "isolated_stop")
    faulty = stops.withColumn("code", code).where("code is not null")
    live = t.nodes.join(degree.where("d_degree > 0"), F.col("id") == F.col("d_id")).select(F.col("id").alias("c_id"), F.col("floor_id").alias("c_floor"), F.col("kind").alias("c_kind"))
    isolated = faulty.where("code = 'isolated_stop'").select("connector_idx", "pos", "stop_node_id", "n_floor_id", "expected")
    options = isolated.join(live, (F.col("n_floor_id") == F.col("c_floor")) & (F.col("expected") == F.col("c_kind")) & (F.col("c_id") != F.col("stop_node_id")))
    single = options.groupBy("connector_idx", "pos").agg(F.count("*").alias("many"), F.min("c_id").alias("replacement_node_id")).where("many = 1").drop("many")
    out = faulty.join(single, ["connector_idx", "pos"], "left")
    return out.select("connector_idx", "connector_id", "connector_name", "pos", "stop_node_id", F.coalesce("n_floor_id", F.lit("unknown")).alias("floor_id"), "code", "replacement_node_id")


def repair(t: Topology) -> Repair:
    """Isolated stops give way to their only replacement, in all connectors and network access points.

    Terminal links are not remapped and remapped stops are not deduplicated.
    """
    found = Staging(t.nodes.sparkSession).write(audit(t).where("replacement_node_id is not null"))  # read by all that follows
    order = F.struct("connector_idx", "pos")
    swap = found.groupBy(F.col("stop_node_id").alias("old")).agg(F.max_by("replacement_node_id", order).alias("new"))
    label = found.groupBy(F.col("replacement_node_id").alias("labelled")).agg(F.min_by("connector_name", order).alias("label"))
    used = t.segments.select(F.explode(F.array("from_node_id", "to_node_id")).alias("used")).distinct()
    unused = swap.join(used, F.col("old") == F.col("used"), "left_anti")
    nodes = t.nodes.drop("label").join(unused, F.col("id") == F.col("old"), "left_anti").join(label, F.col("id") == F.col("labelled"), "left").drop("labelled")

    def remapped(rows: DataFrame) -> DataFrame:
        return rows.join(swap, F.col("node_id") == F.col("old"), "left").withColumn("node_id", F.coalesce("new", "node_id")).drop("old", "new")

    network = F.col("connection") == "network_node"
    points = t.access_points.join(swap, network & (F.col("node_id") == F.col("old")), "left").withColumn("node_id", F.coalesce("new", "node_id")).drop("old", "new")
    log = found.select("connector_id", "connector_name", "floor_id", F.col("stop_node_id").alias("previous_node_id"), "replacement_node_id")
    return Repair(t.with_(nodes=nodes, access_points=points, connector_stops=remapped(t.connector_stops)), log)
