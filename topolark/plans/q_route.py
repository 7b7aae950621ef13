"""Queries of the routing operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolark.functions.keys import half_up
from topolark.operators import route
from topolark.plans.derived import duckdb_sql
from topolark.plans.topology import Topology, derive, derive_paired, derive_staged, with_link_columns

#: The place that the queries start from.
FROM = "P4"

OPTIONS = "opts as (select a.place_id, a.node_id, cast(0 as double) as cost, cast(null as varchar) as access_link_id, a.idx as p, 0 as l from access_points a where a.connection = 'network_node' union all select a.place_id, l.node_id, l.cost, l.id, a.idx, l.idx from access_points a join links l on l.access_point_id = a.id where a.connection <> 'network_node')"
EDGE_HOPS = "edge_hops as (select e.from_node_id, e.to_node_id, e.cost, case when s.kind = 'building_connection' then 'building_connection' else 'path' end as kind, e.segment_id, a.floor_id, case when a.floor_id <> b.floor_id then b.floor_id end as destination_floor_id, s.kind as segment_kind, e.wheelchair_accessible as wheel, e.idx as ord from edges e join nodes a on a.id = e.from_node_id join nodes b on b.id = e.to_node_id join segments s on s.id = e.segment_id where e.enabled is distinct from false)"
VERTICAL = "vertical as (select a.node_id as from_node_id, b.node_id as to_node_id, (case when c.kind = 'stairs' then 180.0 else 120.0 end) * cast(greatest(1, abs(cast(fb.level as int) - cast(fa.level as int))) as double) as cost, c.kind, 'Take ' || c.name || ' from floor ' || fa.level || ' to floor ' || fb.level || '.' as instruction, fa.id as floor_id, fb.id as destination_floor_id, (1::bigint << 40) + c.idx as ord, a.pos * (1 << 20) + b.pos as ord2 from connector_stops a join connector_stops b on a.connector_id = b.connector_id join connectors c on c.id = a.connector_id join nodes na on na.id = a.node_id join nodes nb on nb.id = b.node_id join floors fa on fa.id = na.floor_id join floors fb on fb.id = nb.floor_id where a.node_id <> b.node_id and na.floor_id <> nb.floor_id)"
FREE = "segment_kind <> 'stairs' and coalesce(wheel, 'unknown') <> 'no'"


def graph(step_free: bool, name: str = "hops") -> str:
    where, kind = (f" where {FREE}", " where kind <> 'stairs'") if step_free else ("", "")
    return f"{name} as (select from_node_id u, to_node_id v, cost w from edge_hops{where} union all select from_node_id, to_node_id, cost from vertical{kind})"


def reach(name: str, hops: str) -> str:
    return f"""{name}(node, d) using key (node) as (select node_id, min(cost) from opts where place_id = '{FROM}' group by node_id
  union select h.v, min({name}.d + h.w) from {name} join {hops} h on h.u = {name}.node left join recurring.{name} r on r.node = h.v where r.d is null or {name}.d + h.w < r.d group by h.v)"""


def costs(name: str, dist: str) -> str:
    return f"{name} as (select o.place_id, min({dist}.d + o.cost) as cost from {dist} join opts o on o.node_id = {dist}.node group by o.place_id)"


BASE = f"with {OPTIONS}, {EDGE_HOPS}, {VERTICAL}"
COSTS = f"{BASE}, {graph(False)}, {graph(True, 'free_hops')}, {reach('dist', 'hops')}, {reach('free_dist', 'free_hops')}, {costs('costs', 'dist')}, {costs('free_costs', 'free_dist')}"
WANTED = f"wanted as (select id as place_id, free from places cross join (values (false), (true)) f(free)), known as (select w.place_id, w.free, case when w.free then f.cost else c.cost end as cost, exists (select 1 from opts o where o.place_id = w.place_id) as has from wanted w left join costs c on c.place_id = w.place_id left join free_costs f on f.place_id = w.place_id)"
STATUS = f"case when place_id = '{FROM}' then 'same_place' when not has then 'no_access' when cost is not null then 'ok' when free then 'no_step_free_route' else 'no_route' end"


#: Whole routes from FROM: labels, predecessors, the best end of each place, and its way back hop by hop.
ROUTED = f"""{BASE}, hops_ as (select false as free, from_node_id u, to_node_id v, cost w, ord, 0::bigint as ord2, kind, segment_id, 'Follow ' || segment_id as instruction, floor_id, destination_floor_id from edge_hops
  union all select true, from_node_id, to_node_id, cost, ord, 0, kind, segment_id, 'Follow ' || segment_id, floor_id, destination_floor_id from edge_hops where {FREE}
  union all select f.free, from_node_id, to_node_id, cost, ord, ord2, kind, null, instruction, floor_id, destination_floor_id from vertical cross join (values (false), (true)) f(free) where not f.free or kind <> 'stairs'),
lab(free, node, d, n) using key (free, node) as (select free, node_id, min(cost), 0::bigint from opts cross join (values (false), (true)) f(free) where place_id = '{FROM}' group by all
  union select h.free, h.v, min({{'d': lab.d + h.w, 'n': lab.n + 1}}).d, min({{'d': lab.d + h.w, 'n': lab.n + 1}}).n from lab join hops_ h on h.u = lab.node and h.free = lab.free left join recurring.lab r on r.node = h.v and r.free = h.free
    where r.d is null or lab.d + h.w < r.d or (lab.d + h.w = r.d and lab.n + 1 < r.n) group by h.free, h.v),
tight as (select h.*, a.d as so_far, b.n from hops_ h join lab a on a.free = h.free and a.node = h.u join lab b on b.free = h.free and b.node = h.v where a.d + h.w = b.d and a.n + 1 = b.n),
firsts as (select free, v as node, min({{'ord': ord, 'ord2': ord2}}) as first_ from tight group by all),
pred as (select t.* from tight t left join firsts f on f.free = t.free and f.node = t.u qualify row_number() over (partition by t.free, t.v order by so_far, first_ nulls first, ord, ord2, u) = 1),
best as (select o.place_id, lab.free, lab.node, lab.n, lab.d + o.cost as total, o.access_link_id from lab join opts o on o.node_id = lab.node where o.place_id <> '{FROM}' qualify row_number() over (partition by o.place_id, lab.free order by lab.d + o.cost, o.p, o.l) = 1),
way(place_id, free, node, n) as (select place_id, free, node, n from best union all select w.place_id, w.free, p.u, w.n - 1 from way w join pred p on p.free = w.free and p.v = w.node where w.n > 0),
steps as (select w.place_id, p.* from way w join pred p on p.free = w.free and p.v = w.node where w.n > 0),
ends as (select b.*, coalesce(s.node, b.node) as start from best b left join (select place_id, free, node from way where n = 0) s on s.place_id = b.place_id and s.free = b.free),
stops as (select e.place_id, e.free, 0 as spot, n.floor_id from ends e join nodes n on n.id = e.start union all select place_id, free, 2 * n, floor_id from steps union all select place_id, free, 2 * n + 1, destination_floor_id from steps
  union all select e.place_id, e.free, 1::bigint << 40, n.floor_id from ends e join nodes n on n.id = e.node),
passed as (select *, lag(floor_id) over (partition by place_id, free order by spot) as before from stops where floor_id is not null),
lines as (select place_id, free, n as step, coalesce(destination_floor_id, floor_id) as floor_id, instruction from steps union all select e.place_id, e.free, 1::bigint << 40, n.floor_id, 'Arrive by ' || access_link_id from ends e join nodes n on n.id = e.node where access_link_id is not null),
touched as (select place_id, free, 'segment' as kind, segment_id as id from steps union select place_id, free, 'node', unnest([u, v]) from steps union select place_id, free, 'node', unnest([start, node]) from ends union select place_id, free, 'access_link', access_link_id from ends union select place_id, free, 'place', unnest(['{FROM}', place_id]) from ends)"""


def told(t: Topology) -> Topology:
    t = with_link_columns(t, {"from_place_instruction": F.concat(F.lit("Leave by "), "id"), "to_place_instruction": F.concat(F.lit("Arrive by "), "id")})
    return t.with_(edges=t.edges.withColumn("instruction", F.concat(F.lit("Follow "), "segment_id")))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = told(derive_staged(spark, sf_dir))
    free = F.explode(F.array(F.lit(False), F.lit(True)))
    wanted = t.places.select(F.lit(FROM).alias("from_place_id"), F.col("id").alias("to_place_id"), free.alias("step_free"))
    return route.find_routes(t, wanted)


def from_place(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(FROM,)], "place_id string")


def rte5(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derive_staged(spark, sf_dir)
    seeds = route.endpoint_options(t, wanted=from_place(spark)).select(F.col("place_id").alias("source"), "node_id", "cost")
    return route.distances(seeds, route.compact_hops(t)).select("node_id", F.round("cost", 1).alias("cost"))


def rte6(spark: SparkSession, sf_dir: str, step_free: bool = False) -> DataFrame:
    found = route.place_distances(derive_staged(spark, sf_dir), from_place(spark), step_free)
    return found.select("to_place_id", F.round("cost", 1).alias("cost"))


def rte7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole routes, hop by hop."""
    hops = F.transform("traversals", lambda h: F.concat(F.coalesce(h.segment_id, h.kind), F.lit(":"), h.from_node_id, F.lit(">"), h.to_node_id))
    ok = routes(spark, sf_dir).where("status = 'ok'")
    return ok.select("to_place_id", "step_free", F.round("total_cost", 1).alias("total_cost"), "start_node_id", "end_node_id", F.array_join(hops, " ").alias("hops"))


def rte8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes(spark, sf_dir).where("status = 'ok'").select("to_place_id", "step_free", F.array_join("floor_ids", ">").alias("floors"))


def rte10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of directions; a route of no hops that starts and ends on a network node has none."""
    lines = route.directions(routes(spark, sf_dir))
    return lines.select("to_place_id", "step_free", F.col("step").cast("long").alias("step"), "floor_id", "instruction")


def build() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    def sql(body: str, head: str = COSTS) -> str:
        return duckdb_sql(f"{head} {body}", recursive=True)

    keep = ("from_node_id", "to_node_id", "cost")
    return {
        "rte1": (lambda s, d: route.endpoint_options(derive_paired(s, d)).select("place_id", "node_id", "cost", "access_link_id"), sql("select place_id, node_id, cost, access_link_id from opts", BASE)),
        "rte2": (lambda s, d: route.edge_hops(derive(s, d)).select(*keep, "kind", "segment_id", "floor_id", "destination_floor_id"), sql("select from_node_id, to_node_id, cost, kind, segment_id, floor_id, destination_floor_id from edge_hops", BASE)),
        "rte3": (lambda s, d: route.vertical_hops(derive(s, d)).select(*keep, "kind", "instruction", "floor_id", "destination_floor_id"), sql("select * exclude (ord, ord2) from vertical", BASE)),
        "rte4": (lambda s, d: route.hops(derive(s, d), True).select(*keep), sql("select u as from_node_id, v as to_node_id, w as cost from free_hops", f"{BASE}, {graph(True, 'free_hops')}")),
        "rte5": (rte5, sql("select node as node_id, round(d, 1) as cost from dist", f"{BASE}, {graph(False)}, {reach('dist', 'hops')}")),
        "rte6": (rte6, sql(f"select place_id as to_place_id, round(cost, 1) as cost from costs where place_id <> '{FROM}'", f"{BASE}, {graph(False)}, {reach('dist', 'hops')}, {costs('costs', 'dist')}")),
        "rte6_step_free": (lambda s, d: rte6(s, d, True), sql(f"select place_id as to_place_id, round(cost, 1) as cost from free_costs where place_id <> '{FROM}'", f"{BASE}, {graph(True, 'free_hops')}, {reach('free_dist', 'free_hops')}, {costs('free_costs', 'free_dist')}")),
        "rte7": (rte7, sql("select e.place_id as to_place_id, e.free as step_free, round(e.total, 1) as total_cost, e.start as start_node_id, e.node as end_node_id, coalesce(string_agg(coalesce(s.segment_id, s.kind) || ':' || s.u || '>' || s.v, ' ' order by s.n), '') as hops from ends e left join steps s on s.place_id = e.place_id and s.free = e.free group by all", ROUTED)),
        "rte8": (rte8, sql("select place_id as to_place_id, free as step_free, string_agg(floor_id, '>' order by spot) as floors from passed where before is distinct from floor_id group by all", ROUTED)),
        "rte9": (lambda s, d: routes(s, d).select("to_place_id", "step_free", "status"), sql(f"select place_id as to_place_id, free as step_free, {STATUS} as status from known", f"{COSTS}, {WANTED}")),
        "rte10": (rte10, sql("select place_id as to_place_id, free as step_free, row_number() over (partition by place_id, free order by step) - 1 as step, floor_id, instruction from lines", ROUTED)),
        "rte11": (lambda s, d: route.highlights(routes(s, d)).select("to_place_id", "step_free", "kind", "id"), sql("select place_id as to_place_id, free as step_free, kind, id from touched where id is not null", ROUTED)),
        "rte12": (lambda s, d: routes(s, d).where("status = 'ok'").select("to_place_id", "step_free", half_up(F.round("total_cost", 6)).cast("long").alias("rounded")), sql(f"select place_id as to_place_id, free as step_free, cast(floor(round(cost, 6) + 0.5) as bigint) as rounded from known where cost is not null and place_id <> '{FROM}'", f"{COSTS}, {WANTED}")),
    }
