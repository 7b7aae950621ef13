"""Directed shortest routes across floors and buildings, with a step-free option.

Hops come from enabled edges and from ordered pairs of connector stops on different floors. A graph is cut into parts
of a bounded number of hops; each is searched as a whole, joins carry labels (cost, hops) between parts, and a graph of
one part takes one round. Routes are put together from predecessors by pointer doubling, for the ends asked for only. A
route doesn't depend on how the graph is cut.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolark.functions.keys import last_wins, number, renamed
from topolark.functions.staging import Staging
from topolark.operators.audit import enabled
from topolark.plans.topology import Topology, least_links, linked_points, links_at

#: Cost of a connector by level.
STAIRS, ELEVATOR = 180.0, 120.0
#: Hops of a part of the graph, which are sent together and searched by one task (some hundred bytes each).
MOST_BROADCAST = 1 << 21


def endpoint_options(t: Topology, side: str = "origin", wanted: DataFrame | None = None) -> DataFrame:
    """(place_id, node_id, cost, access_link_id, instruction, ord): where a route can start or end.

    wanted: rows (place_id, ...) whose options are asked for; their other columns come along. Links are met after all that.
    """
    points = t.access_points.select("place_id", "connection", F.col("id").alias("point_id"), F.col("node_id").alias("own_node"), F.col("idx").alias("point_idx"))
    more = [] if wanted is None else [c for c in wanted.columns if c != "place_id"]
    if wanted is not None:
        points = points.join(wanted, "place_id")
    network = points.where("connection = 'network_node'").select("place_id", *more, F.col("own_node").alias("node_id"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("access_link_id"), F.lit(None).cast("string").alias("instruction"), "point_idx", F.lit(0).cast("long").alias("link_idx"))
    column = "from_place_instruction" if side == "origin" else "to_place_instruction"
    said = F.nullif(F.col(column), F.lit("")) if column in t.links.columns else F.lit(None).cast("string")
    terminal = links_at(t, points.where("connection <> 'network_node'").select("place_id", *more, "point_id", "point_idx"), "point_id")
    terminal = terminal.select("place_id", *more, "node_id", "cost", F.col("id").alias("access_link_id"), said.alias("instruction"), "point_idx", F.col("idx").alias("link_idx"))
    return network.unionByName(terminal)


def edge_hops(t: Topology, step_free: bool = False) -> DataFrame:
    """Hops of enabled edges whose ends and segment exist."""
    a, b = renamed(last_wins(t.nodes), "a_", "id", "floor_id"), renamed(last_wins(t.nodes), "b_", "id", "floor_id")
    s = renamed(last_wins(t.segments), "s_", "id", "kind")
    rows = t.edges.where(enabled())
    if step_free:
        rows = rows.where(F.coalesce("wheelchair_accessible", F.lit("unknown")) != "no")
        s = s.where("s_kind <> 'stairs'")
    said = F.col("instruction") if "instruction" in t.edges.columns else F.lit(None).cast("string")
    rows = rows.select("from_node_id", "to_node_id", "segment_id", "cost", "idx", said.alias("instruction"))
    rows = rows.join(a, F.col("from_node_id") == F.col("a_id")).join(b, F.col("to_node_id") == F.col("b_id")).join(s, F.col("segment_id") == F.col("s_id"))
    kind = F.when(F.col("s_kind") == "building_connection", "building_connection").otherwise("path")
    return rows.select("from_node_id", "to_node_id", "cost", kind.alias("kind"), "segment_id", "instruction", F.col("a_floor_id").alias("floor_id"), F.when(F.col("a_floor_id") != F.col("b_floor_id"), F.col("b_floor_id")).alias("destination_floor_id"), F.col("idx").alias("ord"), F.lit(0).cast("long").alias("ord2"))


def connector_stops_of(t: Topology, step_free: bool) -> tuple[DataFrame, DataFrame]:
    """Connectors, and their stops with floor and level."""
    of = t.connectors.select(F.col("id").alias("connector_id"), "kind", "name", F.col("idx").alias("connector_idx"))
    if step_free:
        of = of.where("kind <> 'stairs'")
    node, floor = renamed(last_wins(t.nodes), "n_", "id", "floor_id"), renamed(last_wins(t.floors), "f_", "id", "level")
    stops = t.connector_stops.select("connector_id", "pos", "node_id").join(node, F.col("node_id") == F.col("n_id")).join(floor, F.col("n_floor_id") == F.col("f_id"), "left")
    return of, stops.select("connector_id", "pos", "node_id", F.col("n_floor_id").alias("floor_id"), F.coalesce("f_level", "n_floor_id").alias("level"))


def climb() -> Column:
    """Cost of a connector of a kind between a_level and b_level."""
    delta = F.abs(number(F.col("b_level")) - number(F.col("a_level")))
    usable = ~F.isnan(delta) & (delta < float("inf")) & (delta > 0)
    return F.when(F.col("kind") == "stairs", STAIRS).otherwise(ELEVATOR) * F.when(usable, delta).otherwise(1.0)


def vertical_hops(t: Topology, step_free: bool = False) -> DataFrame:
    """Hops between each ordered pair of a connector's stops on different floors."""
    of, stops = connector_stops_of(t, step_free)
    a, b = (stops.select("connector_id", *[F.col(c).alias(f"{p}_{c}") for c in ("pos", "node_id", "floor_id", "level")]) for p in "ab")
    pairs = of.join(a, "connector_id").join(b, "connector_id").where("a_node_id <> b_node_id and a_floor_id <> b_floor_id")
    said = F.concat(F.lit("Take "), "name", F.lit(" from floor "), "a_level", F.lit(" to floor "), "b_level", F.lit("."))
    # Hops of a node stand behind its edges, in the order of connectors and stops.
    ord_ = F.lit(1 << 40) + F.col("connector_idx")
    return pairs.select(F.col("a_node_id").alias("from_node_id"), F.col("b_node_id").alias("to_node_id"), climb().alias("cost"), "kind", F.lit(None).cast("string").alias("segment_id"), said.alias("instruction"), F.col("a_floor_id").alias("floor_id"), F.col("b_floor_id").alias("destination_floor_id"), ord_.alias("ord"), (F.col("a_pos") * (1 << 20) + F.col("b_pos")).alias("ord2"))


def hops(t: Topology, step_free: bool = False) -> DataFrame:
    return edge_hops(t, step_free).unionByName(vertical_hops(t, step_free))


#: Ids of hubs start so; they are no nodes of a topology.
HUB = "\0hub:"


def compact_hops(t: Topology, step_free: bool = False) -> DataFrame:
    """(from_node_id, to_node_id, cost, floor_id, steps): hops() for searches, with as many rows as there are edges and stops.

    What a hop between two stops costs depends on their floors only. So a stop leads to a hub of its connector and floor,
    that to the hubs of other floors, which takes the cost and the step, and these to their stops.
    """
    flat = edge_hops(t, step_free).select("from_node_id", "to_node_id", "cost", "floor_id", F.lit(1).alias("steps"))
    of, stops = connector_stops_of(t, step_free)
    hub = lambda way, side="": F.concat_ws(":", F.lit(HUB + way), F.col("connector_idx").cast("string"), "kind", f"{side}floor_id")
    at = of.join(stops, "connector_id").where("floor_id is not null and node_id is not null")
    ends = at.select(F.col("node_id").alias("from_node_id"), hub("from").alias("to_node_id"), "floor_id").unionByName(at.select(hub("to").alias("from_node_id"), F.col("node_id").alias("to_node_id"), "floor_id")).distinct()
    floors = at.select("connector_idx", "kind", "floor_id", "level").distinct()
    a, b = (floors.select("connector_idx", "kind", *[F.col(c).alias(f"{p}_{c}") for c in ("floor_id", "level")]) for p in "ab")
    between = a.join(b, ["connector_idx", "kind"]).where("a_floor_id <> b_floor_id").select(hub("from", "a_").alias("from_node_id"), hub("to", "b_").alias("to_node_id"), climb().alias("cost"), F.col("a_floor_id").alias("floor_id"), F.lit(1).alias("steps"))
    free = ends.select("from_node_id", "to_node_id", F.lit(0.0).alias("cost"), "floor_id", F.lit(0).alias("steps"))
    return flat.unionByName(free).unionByName(between)


#: A label of a node is (cost, n): the least cost from the source's seeds, and the fewest hops of that cost.
LABEL = ["cost", "n"]


def divided(edges: DataFrame, most: int, staging: Staging) -> DataFrame:
    """(node_id, part, pos) of every node of edges (node_id, to_node_id, near): parts of nodes in a row with about ``most`` hops.

    Nodes stand in the order of near (the least of their hops) and id, so that those of one floor mostly share a part.
    Ranges are numbered apart.
    """
    ends = edges.select("node_id", "near", F.lit(1).alias("hops")).unionByName(edges.select(F.col("to_node_id").alias("node_id"), F.lit(None).cast("string").alias("near"), F.lit(0).alias("hops")))
    nodes = ends.groupBy("node_id").agg(F.min("near").alias("near"), F.sum("hops").alias("hops"))
    many = max(1, -(-edges.count() // max(most, 1)))  # no more ranges than parts, as each begins a part
    ranges = staging.write(nodes.repartitionByRange(many, "near", "node_id").withColumn("range_", F.spark_partition_id()))
    order = Window.partitionBy("range_").orderBy("near", "node_id")
    before = F.coalesce(F.sum("hops").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.col("range_").cast("long") * (1 << 40) + F.floor(before / max(most, 1))
    rows = ranges.withColumn("part", part)
    return staging.write(rows.select("node_id", "part", (F.row_number().over(Window.partitionBy("part").orderBy("near", "node_id")) - 1).alias("pos")))


#: Hops of a part by the node that they start from: first[pos] to first[pos + 1] are the places of its ends, costs and steps.
Near = tuple[list[int], list[int], list[float], list[int]]


def by_start(hops_: pa.StructScalar | None) -> tuple[Near, bool]:
    """Hops (u, v, w, k) by their start, and whether any cost is below zero."""
    if hops_ is None or not hops_.is_valid or not len(hops_.values):
        return ([0], [], [], []), False
    u, v, w, k = (hops_.values.field(name).to_numpy(zero_copy_only=False) for name in "uvwk")
    order = np.argsort(u, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(u))])
    return (first.tolist(), v[order].tolist(), w[order].tolist(), k[order].tolist()), bool((w < 0).any())


def spread(starts: list[tuple[int, float, int]], near: Near, falling: bool, most: int) -> dict[int, tuple[float, int]]:
    """Labels of all nodes that starts (pos, cost, n) reach within a part. Raises when a way has more hops than there are nodes."""
    first, ends, costs, counts = near
    last = len(first) - 1
    best: dict[int, tuple[float, int]] = {}
    for pos, *label in starts:
        if pos not in best or tuple(label) < best[pos]:
            best[pos] = tuple(label)
    queue = deque(best) if falling else [(*label, pos) for pos, label in best.items()]
    if not falling:
        heapq.heapify(queue)
    while queue:
        if falling:
            pos = queue.popleft()
            cost, n = best[pos]
        else:
            cost, n, pos = heapq.heappop(queue)
            if (cost, n) != best[pos]:
                continue
        for at in range(first[pos], first[pos + 1]) if pos < last else ():
            to, offer = ends[at], (cost + costs[at], n + counts[at])
            if to not in best or offer < best[to]:
                if n >= most:
                    raise ValueError("Costs fall for ever along a cycle of hops.")
                best[to] = offer
                queue.append(to) if falling else heapq.heappush(queue, (*offer, to))
    return best


def spread_parts(front: DataFrame, parts: DataFrame, key: list[str], slices: int, most: int) -> DataFrame:
    """Labels that front (key, part, pos, cost, n) gives to nodes of its own parts, over the hops within them.

    parts: a row (part, and step_free if it is in the key) with the hops of a part, which each slice of sources gets once.
    """
    free = [c for c in key if c != "source"]
    starts = front.groupBy(*key, "part").agg(F.collect_list(F.struct("pos", "cost", "n")).alias("starts"))
    sliced = starts.groupBy(*free, "part", F.pmod(F.xxhash64("source"), F.lit(slices)).alias("slice")).agg(F.collect_list(F.struct("source", "starts")).alias("rows"))
    named = {"step_free": "boolean", "source": "string"}
    kinds = {"step_free": pa.bool_(), "source": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *own, part, rows, hops_ in zip(*(batch.column(k).to_pylist() for k in range(len(free) + 2)), batch.column(len(free) + 2)):
                near, falling = by_start(hops_)
                for row in rows:
                    best = spread([(s["pos"], s["cost"], s["n"]) for s in row["starts"]], near, falling, most)
                    size = len(best)
                    columns = [pa.array([v] * size, kinds[c]) for c, v in zip([*free, "source"], [*own, row["source"]])]
                    columns += [pa.array([part] * size, pa.int64()), pa.array(list(best), pa.int32()), pa.array([b[0] for b in best.values()], pa.float64()), pa.array([b[1] for b in best.values()], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, [*free, "source", "part", "pos", "cost", "n"])

    whole = sliced.join(parts, [*free, "part"], "left").select(*free, "part", "rows", "hops")
    return whole.mapInArrow(run, ", ".join(f"{c} {named[c]}" for c in [*free, "source"]) + ", part long, pos int, cost double, n int")


def least(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.min(F.struct(*LABEL)).alias("l")).select(*key, "l.*")


def labels(seeds: DataFrame, graph: DataFrame, most_broadcast: int) -> DataFrame:
    """(source, node_id, cost, n) of every node that a source reaches, by (step_free, source) if seeds have both.

    seeds: source, node_id, cost; graph: from_node_id, to_node_id, cost, and steps (else 1). Hubs get no label. The graph is cut into parts of most_broadcast hops.
    In a round every part that a source has newly entered is searched to its end in one go, and joins carry the better
    labels over the hops between parts; so the rounds are as many as the parts that a way passes, and a graph of one part
    takes one. What is known is kept in at most four tables, merged when a fifth would come.
    """
    staging = Staging(seeds.sparkSession)
    free = ["step_free"] if "step_free" in seeds.columns else []
    key, at = [*free, "source"], ["part", "pos"]
    near = F.col("floor_id") if "floor_id" in graph.columns else F.lit(None).cast("string")
    graph = graph.where("from_node_id is not null and to_node_id is not null and cost is not null")
    steps = F.col("steps") if "steps" in graph.columns else F.lit(1)
    pairs = graph.groupBy(*free, F.col("from_node_id").alias("node_id"), "to_node_id", steps.alias("steps")).agg(F.min("cost").alias("hop"), F.min(near).alias("near"))
    edges, start = staging.write_all({"edges": pairs, "start": seeds.where("source is not null and node_id is not null and cost is not null").groupBy(*key, "node_id").agg(F.min("cost").alias("cost"))}).values()
    nodes = divided(edges.select("node_id", "to_node_id", "near").unionByName(start.select("node_id", F.col("node_id").alias("to_node_id"), F.lit(None).cast("string").alias("near"))), most_broadcast, staging)
    of = lambda name, *as_: nodes.select(F.col("node_id").alias(name), *[F.col(c).alias(a) for c, a in zip(at, as_)])
    hops_ = staging.write(edges.join(of("node_id", "part", "u"), "node_id").join(of("to_node_id", "to_part", "v"), "to_node_id").select(*free, "part", "u", "to_part", "v", "hop", "steps"))
    inner = hops_.where("part = to_part").groupBy(*free, "part").agg(F.collect_list(F.struct("u", "v", F.col("hop").alias("w"), F.col("steps").alias("k"))).alias("hops"))
    counts = {r.what: r.n for r in nodes.select(F.lit("nodes").alias("what")).unionAll(start.select("source").distinct().select(F.lit("sources"))).unionAll(hops_.where("part <> to_part").limit(1).select(F.lit("outer"))).groupBy("what").agg(F.count("*").alias("n")).collect()}
    parts, slices, most = staging.write(inner), 1 + counts.get("sources", 0) // 64, counts.get("nodes", 0)

    front = start.join(nodes, "node_id").select(*key, *at, "cost", F.lit(0).alias("n"))
    known: list[DataFrame] = []
    while True:
        reached = spread_parts(front, parts, key, slices, most)
        if not counts.get("outer"):
            known = [staging.write(reached)]
            break
        before = least(reduce(DataFrame.unionByName, known), *key, *at).withColumnsRenamed({"cost": "old_cost", "n": "old_n"}) if known else None
        better = F.col("old_cost").isNull() | (F.struct(*LABEL) < F.struct(F.col("old_cost").alias("cost"), F.col("old_n").alias("n")))
        if before is not None:
            reached = reached.join(before, [*key, *at], "left").where(better).select(*key, *at, *LABEL)
        fresh = staging.write(reached)
        known = [staging.write(least(reduce(DataFrame.unionByName, [*known, fresh]), *key, *at))] if len(known) == 4 else [*known, fresh]
        outer = hops_.where("part <> to_part").withColumnRenamed("u", "pos")
        offers = fresh.join(outer, [*free, *at]).select(*key, F.col("to_part").alias("part"), F.col("v").alias("pos"), (F.col("cost") + F.col("hop")).alias("cost"), (F.col("n") + F.col("steps")).alias("n"))
        now = least(reduce(DataFrame.unionByName, known), *key, *at).withColumnsRenamed({"cost": "old_cost", "n": "old_n"})
        front = staging.write(least(offers, *key, *at).join(now, [*key, *at], "left").where(better).select(*key, *at, *LABEL))
        longest = front.agg(F.max("n")).first()[0]
        if longest is None:
            break
        if longest > most:
            raise ValueError("Costs fall for ever along a cycle of hops.")
    every = known[0] if len(known) == 1 else least(reduce(DataFrame.unionByName, known), *key, *at)
    return every.join(nodes.where(~F.col("node_id").startswith(HUB)), at).select(*key, "node_id", *LABEL)


def distances(seeds: DataFrame, graph: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(source, node_id, cost): least cost from each source's seeds (source, node_id, cost) to every node reached.

    most_broadcast: hops of a part of the graph, which goes as a whole to the tasks that search it.
    """
    return labels(seeds.select("source", "node_id", "cost"), graph, most_broadcast).select("source", "node_id", "cost")


def predecessors(reached: DataFrame, graph: DataFrame) -> DataFrame:
    """(step_free, source, node_id, before, ord, ord2, n): the hop that reaches each node and where it comes from.

    Of the hops that give a node its label the one counts whose start was cheapest to reach, then whose start has the first
    hop into it, then the first.
    """
    key = ["step_free", "source"]
    here = reached.select(*key, F.col("node_id").alias("from_node_id"), F.col("cost").alias("so_far"), F.col("n").alias("hops_"))
    usable = graph.where("from_node_id is not null and to_node_id is not null and cost is not null").select("step_free", "from_node_id", F.col("to_node_id").alias("node_id"), F.col("cost").alias("hop"), "ord", "ord2")
    tight = here.join(usable, ["step_free", "from_node_id"]).join(reached, [*key, "node_id"]).where("so_far + hop = cost and hops_ + 1 = n")
    first = tight.groupBy(*key, F.col("node_id").alias("from_node_id")).agg(F.min(F.struct("ord", "ord2")).alias("first_"))
    choice = F.struct("so_far", "first_", "ord", "ord2", F.col("from_node_id").alias("before"))
    found = tight.join(first, [*key, "from_node_id"], "left").groupBy(*key, "node_id", "n").agg(F.min(choice).alias("c"))
    return found.select(*key, "node_id", "c.before", "c.ord", "c.ord2", "n")


def unrolled(ends: DataFrame, pointers: DataFrame, staging: Staging) -> DataFrame:
    """(request, n, ord, ord2): the hops of the ways that end at ends (request, step_free, source, node_id), n from 1.

    Pointer doubling: jump table k leads 2^k hops back, and every node that an end's way has so far is taken 2^k hops further
    back, from the largest k on, so that the rounds are the logarithm of the longest way.
    """
    key = ["step_free", "source", "node_id"]
    jumps, longest = [pointers.select(*key, "before")], pointers.agg(F.max("n")).first()[0] or 0
    while 1 << len(jumps) < longest:
        step = jumps[-1]
        further = step.select("step_free", "source", F.col("node_id").alias("before"), F.col("before").alias("beyond"))
        jumps.append(staging.write(step.join(further, ["step_free", "source", "before"]).select(*key, F.col("beyond").alias("before"))))
    some = ends.select("request", *key)
    for jump in reversed(jumps):
        back = some.join(jump, key).select("request", "step_free", "source", F.col("before").alias("node_id"))
        some = staging.write(some.unionByName(back))
    return some.join(pointers, key).select("request", "step_free", "n", "ord", "ord2")


def place_distances(t: Topology, from_places: DataFrame, step_free: bool = False, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(from_place_id, to_place_id, cost) of every place that each of from_places (place_id) reaches."""
    seeds = endpoint_options(t, wanted=from_places.select("place_id").distinct()).select(F.col("place_id").alias("source"), "node_id", "cost")
    reached = Staging(seeds.sparkSession).write(distances(seeds, compact_hops(t, step_free), most_broadcast).select("source", "node_id", F.col("cost").alias("walked")))
    points = t.access_points.where("connection <> 'network_node'").select("place_id", F.col("id").alias("point_id"))
    found = least_links(t, points.crossJoin(reached.select("source").distinct()), reached.withColumnRenamed("walked", "cost"), ["source"], whole=False)
    last = endpoint_options(t if found is None else t.with_(links=t.links.limit(0)), "destination").select("place_id", "node_id", "cost")
    total = reached.join(last, "node_id").select("source", "place_id", (F.col("walked") + F.col("cost")).alias("total"))
    if found is not None:
        total = total.unionByName(found.select("source", "place_id", "total"))
    total = total.groupBy(F.col("source").alias("from_place_id"), F.col("place_id").alias("to_place_id")).agg(F.min("total").alias("cost"))
    return total.where("from_place_id <> to_place_id")


HOP = "struct<from_node_id: string, to_node_id: string, cost: double, kind: string, segment_id: string, instruction: string, floor_id: string, destination_floor_id: string>"
ROUTE = f"from_place_id string, to_place_id string, step_free boolean, status string, total_cost double, start_node_id string, end_node_id string, origin_access_link_id string, arrival_access_link_id string, origin_instruction string, arrival_instruction string, floor_ids array<string>, traversals array<{HOP}>"


OPTION = "struct<cost: double, point_idx: bigint, link_idx: bigint, node_id: string, access_link_id: string, instruction: string>"


def options_of(t: Topology, side: str, wanted: DataFrame) -> DataFrame:
    """endpoint_options() of wanted (place_id, ...) with the option as one struct, whose order decides between equal costs."""
    fields = [F.col(f.split(":")[0]).cast(f.split(": ")[1]) for f in OPTION[7:-1].split(", ")]
    return endpoint_options(t, side, wanted).select(*wanted.columns, "node_id", F.struct(*fields).cast(OPTION).alias("option"))


def open_places(t: Topology) -> DataFrame:
    """(place_id) of places with an option."""
    points = t.access_points.select("place_id", "connection", "id")
    linked = linked_points(t).select(F.col("access_point_id").alias("id"))
    return points.where("connection = 'network_node'").unionByName(points.where("connection <> 'network_node'").join(linked, "id", "left_semi").select(*points.columns)).select("place_id").distinct()


def arrivals(t: Topology, going: DataFrame, reached: DataFrame, staging: Staging) -> Callable[[DataFrame], DataFrame]:
    """What gives wanted (place_id, from_place_id, step_free, request, ...) with their options ``last`` at labelled nodes, the label's n and the total.

    Of a point's paired links only the first of least total is among the options; these are found once, for all that are going.
    """

    def labelled(options: DataFrame) -> DataFrame:
        at = reached.withColumnRenamed("source", "from_place_id")
        return options.join(at, ["step_free", "from_place_id", "node_id"]).withColumn("total", F.col("cost") + F.col("last.cost"))

    points = t.access_points.where("connection <> 'network_node'").select("place_id", F.col("id").alias("point_id"), F.col("idx").alias("point_idx"))
    key = ["step_free", "source"]
    found = least_links(t, points.join(going.withColumnRenamed("from_place_id", "source").drop("request"), "place_id"), reached.select(*key, "node_id", "cost"), key)
    if found is None:
        return lambda wanted: labelled(options_of(t, "destination", wanted).withColumnRenamed("option", "last"))
    plain = t.with_(links=t.links.limit(0))
    said = F.nullif(F.col("to_place_instruction"), F.lit("")) if "to_place_instruction" in t.links.columns else F.lit(None).cast("string")
    option = F.struct("cost", "point_idx", F.col("idx").alias("link_idx"), "node_id", F.col("id").alias("access_link_id"), said.alias("instruction")).cast(OPTION)
    kept = ["place_id", "from_place_id", "step_free", "node_id"]
    found = staging.write(found.withColumnRenamed("source", "from_place_id").select(*kept, option.alias("last")).join(reached.select("step_free", F.col("source").alias("from_place_id"), "node_id", F.col("cost").alias("walked"), "n"), kept[1:]))

    def ends(wanted: DataFrame) -> DataFrame:
        network = labelled(options_of(plain, "destination", wanted).withColumnRenamed("option", "last"))
        linked = wanted.join(found.withColumnRenamed("walked", "cost"), kept[:3]).withColumn("total", F.col("cost") + F.col("last.cost"))
        return network.unionByName(linked)

    return ends


def find_routes(t: Topology, requests: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """A row for each request (from_place_id, to_place_id, step_free) with status, cost, floors and hops.

    status: ok, same_place, no_access, no_route or no_step_free_route. Of equally cheap routes the one with the fewest
    hops counts, then as predecessors() says; of equally cheap ways in or out the first. Only routes that are asked for are
    put together, when their ends are chosen; until then a node has a label and a predecessor.
    """
    staging = Staging(requests.sparkSession)
    key = ["from_place_id", "to_place_id", "step_free"]
    every = {"graph": hops(t).withColumn("step_free", F.lit(False)).unionByName(hops(t, True).withColumn("step_free", F.lit(True)))}
    every["wanted"] = requests.select("from_place_id", "to_place_id", F.coalesce("step_free", F.lit(False)).alias("step_free")).withColumn("request", F.xxhash64(*key))
    every["open"] = open_places(t)
    every["compact"] = compact_hops(t).withColumn("step_free", F.lit(False)).unionByName(compact_hops(t, True).withColumn("step_free", F.lit(True)))
    graph, wanted, open_, compact = staging.write_all(every).values()
    asked = wanted.select(F.col("from_place_id").alias("place_id"), "step_free").where("place_id is not null").distinct()
    starts = options_of(t, "origin", asked).select("step_free", F.col("place_id").alias("source"), "node_id", "option")
    starts = staging.write(starts.groupBy("step_free", "source", "node_id").agg(F.min("option").alias("option")))
    reached = staging.write(labels(starts.select("step_free", "source", "node_id", F.col("option.cost").alias("cost")), compact, most_broadcast))

    # The least total is found first, over plain numbers; only options that give it are compared as wholes.
    going = wanted.where("from_place_id <> to_place_id").withColumnRenamed("to_place_id", "place_id").distinct()
    ends = arrivals(t, going, reached, staging)
    totals = staging.write(ends(going).groupBy("request").agg(F.min("total").alias("least")))
    total = F.struct("total", F.col("last.point_idx").alias("p"), F.col("last.link_idx").alias("l"), "last", "n")
    best = ends(going.join(totals, "request")).where("total = least").withColumnRenamed("place_id", "to_place_id")
    tables = {"best": best.groupBy(*key).agg(F.min(total).alias("b")).select(*key, "b.*"), "pointers": predecessors(reached, graph)}
    best, pointers = staging.write_all(tables).values()

    # What a route is but for its arrival is the same for all that end at a node: hops, floors and start are put together once for each.
    end = ["step_free", "from_place_id", "end_"]
    ends = best.select("step_free", "from_place_id", F.col("last.node_id").alias("end_")).distinct().withColumn("request", F.xxhash64(*end))
    names = [f.split(":")[0].strip() for f in HOP[7:-1].split(", ")]
    steps = unrolled(ends.withColumnsRenamed({"from_place_id": "source", "end_": "node_id"}), pointers, staging).join(graph, ["step_free", "ord", "ord2"]).groupBy("request").agg(F.array_sort(F.collect_list(F.struct("n", F.struct(*names).alias("hop")))).alias("s"))
    ways = ends.join(steps, "request", "left").withColumn("traversals", F.coalesce(F.transform("s", lambda x: x.hop).cast(f"array<{HOP}>"), F.array().cast(f"array<{HOP}>"))).drop("s", "request")
    ways = ways.withColumn("start_node_id", F.coalesce(F.get("traversals", F.lit(0)).from_node_id, F.col("end_")))
    ways = ways.join(starts.select("step_free", F.col("source").alias("from_place_id"), F.col("node_id").alias("start_node_id"), F.col("option").alias("first")), ["step_free", "from_place_id", "start_node_id"])
    floor = last_wins(t.nodes).select("id", "floor_id")
    ways = ways.join(renamed(floor, "a_", "id", "floor_id"), F.col("start_node_id") == F.col("a_id"), "left").join(renamed(floor, "b_", "id", "floor_id"), F.col("end_") == F.col("b_id"), "left")
    ways = staging.write(ways.withColumn("floor_ids", floor_sequence()).select(*end, "start_node_id", "first", "floor_ids", "traversals"))

    has = lambda side, name: open_.select(F.col("place_id").alias(name), F.lit(True).alias(f"{side}_"))
    rows = wanted.join(best, key, "left").join(has("origin", "from_place_id"), "from_place_id", "left").join(has("destination", "to_place_id"), "to_place_id", "left")
    rows = rows.withColumn("end_", F.col("last.node_id")).join(ways, end, "left").withColumn("traversals", F.coalesce("traversals", F.array().cast(f"array<{HOP}>")))
    closed = F.col("origin_").isNull() | F.col("destination_").isNull()
    status = F.when(F.col("from_place_id") == F.col("to_place_id"), "same_place").when(closed, "no_access").when(F.col("total").isNotNull(), "ok").when(F.col("step_free"), "no_step_free_route").otherwise("no_route")
    ok = lambda c: F.when(F.col("total").isNotNull(), c)
    return rows.select(
        *key, status.alias("status"), F.col("total").alias("total_cost"), ok(F.col("start_node_id")).alias("start_node_id"), F.col("last.node_id").alias("end_node_id"), F.col("first.access_link_id").alias("origin_access_link_id"),
        F.col("last.access_link_id").alias("arrival_access_link_id"), F.col("first.instruction").alias("origin_instruction"), F.col("last.instruction").alias("arrival_instruction"), ok(F.col("floor_ids")).alias("floor_ids"), "traversals",
    )


def floor_sequence() -> Column:
    """Floors in order of passing, of a_floor_id, traversals and b_floor_id; only consecutive repeats collapse."""
    hops_ = F.flatten(F.transform("traversals", lambda h: F.array(h.floor_id, h.destination_floor_id)))
    every = F.filter(F.concat(F.array("a_floor_id"), hops_, F.array("b_floor_id")), lambda f: f.isNotNull() & (f != ""))
    pairs = F.arrays_zip(every.alias("here"), F.concat(F.array(F.lit(None).cast("string")), every).alias("before"))
    return F.transform(F.filter(pairs, lambda p: p["here"].isNotNull() & ~p["here"].eqNullSafe(p["before"])), lambda p: p["here"])


def directions(routes: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Turn-by-turn rows (step from 0): an origin line, one for each hop, an arrival line."""
    key = ["from_place_id", "to_place_id", "step_free"]
    ok = routes.where("status = 'ok'")
    line = lambda floor, text: F.struct(floor.alias("floor_id"), text.alias("instruction"))
    middle = F.transform("traversals", lambda h: line(F.coalesce(h.destination_floor_id, h.floor_id), h.instruction))
    first = F.when(F.col("origin_instruction").isNotNull(), F.array(line(F.get("floor_ids", F.lit(0)), F.col("origin_instruction"))))
    last = F.when(F.col("arrival_instruction").isNotNull(), F.array(line(F.element_at("floor_ids", -1), F.col("arrival_instruction"))))
    none = F.array().cast("array<struct<floor_id: string, instruction: string>>")
    lines = F.concat(F.coalesce(first, none), middle, F.coalesce(last, none))
    return ok.select(*key, F.posexplode(lines).alias("step", "l")).select(*key, "step", "l.*")


def highlights(routes: DataFrame) -> DataFrame:
    """(kind, id) of the segments, nodes, access links and places that a route touches."""
    key = ["from_place_id", "to_place_id", "step_free"]
    ok = routes.where("status = 'ok'")
    item = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("id"))
    every = F.concat(
        F.transform("traversals", lambda h: item("segment", h.segment_id)),
        F.flatten(F.transform("traversals", lambda h: F.array(item("node", h.from_node_id), item("node", h.to_node_id)))),
        F.array(item("node", F.col("start_node_id")), item("node", F.col("end_node_id")), item("access_link", F.col("origin_access_link_id")), item("access_link", F.col("arrival_access_link_id")), item("place", F.col("from_place_id")), item("place", F.col("to_place_id"))),
    )
    return ok.select(*key, F.explode(F.array_distinct(every)).alias("i")).select(*key, "i.*").where("id is not null")
