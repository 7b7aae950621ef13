"""Queries of the edits, with their SQL. Removals take every third floor, building B1 or single rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolark.operators import mutate
from topolark.plans.derived import duckdb_sql
from topolark.plans.topology import Topology, derive, derive_paired, derive_staged

COUNTED = ("buildings", "floors", "places", "access_points", "nodes", "segments", "edges", "links", "connectors", "connector_stops", "connector_segments", "plans")
LEN = "greatest(1.0, sqrt(pow({b}.x-{a}.x,2)+pow({b}.y-{a}.y,2)))"


def heading(dx: str, dy: str) -> str:
    return f"case when abs({dx}) > abs({dy})*1.8 then case when {dx} > 0 then 'east' else 'west' end when abs({dy}) > abs({dx})*1.8 then case when {dy} > 0 then 'south' else 'north' end else (case when {dy} >= 0 then 'south' else 'north' end) || (case when {dx} >= 0 then 'east' else 'west' end) end"


def sizes(t: Topology) -> DataFrame:
    """Rows and sum of idx of every relation."""
    out = None
    for name in COUNTED:
        rows = getattr(t, name)
        mark = F.sum("idx" if "idx" in rows.columns else "pos")
        # Paired links tell their number and sum without being made.
        counts = rows._totals() if hasattr(rows, "_totals") else rows.agg(F.count("*").alias("row_count"), mark.alias("mark"))
        one = counts.select(F.lit(name).alias("relation"), "row_count", F.coalesce("mark", F.lit(0)).cast("long").alias("mark"))
        out = one if out is None else out.unionByName(one)
    return out.select("relation", "row_count", "mark")


def sizes_sql(head: str, names: dict[str, str]) -> str:
    parts = [f"select '{n}' as relation, count(*) as row_count, coalesce(cast(sum({'pos' if n.startswith('connector_s') else 'idx'}) as bigint), 0) as mark from {names.get(n, n)}" for n in COUNTED]
    return duckdb_sql(f"{head} {' union all '.join(parts)}")


def cascade(floors: str, buildings: str) -> str:
    return f"""with gf as ({floors}), gb as ({buildings}), gn as (select id from nodes where floor_id in (from gf)),
 gp as (select a.id, a.place_id from access_points a left join places p on p.id = a.place_id where a.floor_id in (from gf) or p.building_id in (from gb)),
 left_points as (select * from access_points where id not in (select id from gp)),
 gpl as (select id from places where building_id in (from gb) or (id in (select place_id from gp) and id not in (select place_id from left_points))),
 gs as (select id from segments where from_node_id in (from gn) or to_node_id in (from gn)),
 r_buildings as (select * from buildings where id not in (from gb)), r_floors as (select * from floors where id not in (from gf)),
 r_places as (select * from places where id not in (from gpl)), r_access_points as (select * from left_points where place_id not in (from gpl)),
 r_nodes as (select * from nodes where id not in (from gn)), r_segments as (select * from segments where id not in (from gs)),
 r_edges as (select * from edges where segment_id not in (from gs) and from_node_id not in (from gn) and to_node_id not in (from gn)),
 r_links as (select * from links where access_point_id not in (select id from gp) and node_id not in (from gn)),
 r_connector_stops as (select * from connector_stops where node_id not in (from gn)),
 r_connectors as (select c.* replace (case when c.place_id in (from gpl) then (select a.place_id from r_access_points a join r_connector_stops s on s.node_id = a.node_id where s.connector_id = c.id and a.connection = 'network_node' order by a.idx limit 1) else c.place_id end as place_id) from connectors c where c.id in (select connector_id from r_connector_stops)),
 r_connector_segments as (select * from connector_segments where segment_id not in (from gs)), r_plans as (select * from plans where floor_id not in (from gf))"""


R = {n: f"r_{n}" for n in COUNTED}
SOME_FLOORS = "select id from floors where idx % 3 = 0"


def removed(s: SparkSession, d: str) -> Topology:
    t = derive_staged(s, d)
    return mutate.remove_floors(t, mutate.ids(t.floors.where("idx % 3 = 0")), mutate.ids(t.buildings.limit(0)))


def some_pairs(t: Topology) -> DataFrame:
    """New hallways between nodes n and n + 3."""
    a = t.nodes.select(F.col("id").alias("from_node_id"), (F.col("idx") + 3).alias("next"), F.col("idx").alias("k"))
    b = t.nodes.select(F.col("id").alias("to_node_id"), F.col("idx").alias("next"))
    return a.join(b, "next").select(F.concat(F.lit("H"), F.col("k").cast("string")).alias("id"), "from_node_id", "to_node_id")


PAIRS = "pairs3 as (select 'H' || a.idx as id, a.id as from_node_id, b.id as to_node_id from nodes a join nodes b on b.idx = a.idx + 3)"


def mut14(s: SparkSession, d: str) -> DataFrame:
    text = F.concat("name", F.lit(" , ,"), "id", F.lit(",  x"), "building_id")
    return derive(s, d).places.select("id", F.array_join(mutate.aliases(text), "|").alias("aliases"))


def clicks(t: Topology) -> DataFrame:
    return t.access_points.select(F.col("id").alias("click_id"), "floor_id", "x", "y", (1 + F.col("idx") % 3).cast("double").alias("zoom"))


def build() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    def q(run, sql: str):
        return run, duckdb_sql(sql)

    few = cascade(SOME_FLOORS, "select id from buildings where false")
    one = cascade("select id from floors where id = 'F3'", "select id from buildings where false")
    house = cascade("select id from floors where building_id = 'B1'", "select id from buildings where id = 'B1'")
    own = "own as (select * from access_points where place_id = 'P8'), gn as (select node_id id from own where connection = 'network_node'), gs as (select id from segments where from_node_id in (from gn) or to_node_id in (from gn))"
    return {
        "mut1": (lambda s, d: sizes(mutate.remove_floor(derive_staged(s, d), "F3")), sizes_sql(one, R)),
        "mut2": (lambda s, d: sizes(mutate.remove_building(derive_staged(s, d), "B1")), sizes_sql(house, R)),
        "mut3": (lambda s, d: sizes(removed(s, d)), sizes_sql(few, R)),
        "mut4": q(lambda s, d: removed(s, d).connectors.select("id", "kind", "place_id"), f"{few} select id, kind, place_id from r_connectors"),
        "mut5": q(
            lambda s, d: (lambda t: mutate.removal_scope(t, mutate.ids(t.floors.where("idx % 3 = 0"))))(derive(s, d)),
            f"{few} select (select count(*) from gf) as floors, (select count(*) from gn) as nodes, (select count(*) from gs) as segments, (select count(distinct place_id) from access_points where floor_id in (from gf)) as places",
        ),
        "mut6": (lambda s, d: sizes(mutate.guarded_remove_building(derive_staged(s, d), "B1")).where("relation = 'buildings'"), duckdb_sql(f"{house} select 'buildings' as relation, count(*) as row_count, cast(sum(idx) as bigint) as mark from r_buildings")),
        "mut7": (lambda s, d: sizes(mutate.delete_segment(derive_staged(s, d), "S1-2")), sizes_sql("with r_segments as (select * from segments where id <> 'S1-2'), r_edges as (select * from edges where segment_id <> 'S1-2')", {"segments": "r_segments", "edges": "r_edges"})),
        "mut8": (
            lambda s, d: sizes(mutate.delete_place(derive_staged(s, d), "P8")),
            sizes_sql(
                f"with {own}, r_places as (select * from places where id <> 'P8'), r_access_points as (select * from access_points where id not in (select id from own)), r_links as (select * from links where access_point_id not in (select id from own) and node_id not in (from gn)), r_nodes as (select * from nodes where id not in (from gn)), r_segments as (select * from segments where id not in (from gs)), r_edges as (select * from edges where segment_id not in (from gs))",
                {n: f"r_{n}" for n in ("places", "access_points", "links", "nodes", "segments", "edges")},
            ),
        ),
        "mut9": (
            lambda s, d: sizes(mutate.delete_node(derive_staged(s, d), "N10")),
            sizes_sql("with gs as (select id from segments where from_node_id = 'N10' or to_node_id = 'N10'), r_nodes as (select * from nodes where id <> 'N10'), r_links as (select * from links where node_id <> 'N10'), r_segments as (select * from segments where id not in (from gs)), r_edges as (select * from edges where segment_id not in (from gs))", {n: f"r_{n}" for n in ("nodes", "links", "segments", "edges")}),
        ),
        "mut10": q(
            lambda s, d: (lambda t: mutate.patch(t.nodes, t.nodes.where("idx % 4 = 1").select("id", F.lit("turn").alias("kind"), F.when(F.col("idx") % 8 == 1, F.col("x") + 5).alias("x"))))(derive(s, d)).select("id", "kind", "x", "y"),
            "select id, case when idx % 4 = 1 then 'turn' else kind end as kind, case when idx % 8 = 1 then x + 5 else x end as x, y from nodes",
        ),
        "mut11": q(
            lambda s, d: (lambda t: t.floors.select("id", "building_id").unionByName(t.places.select("id", "building_id")))(mutate.move_floor(derive(s, d), "F2", "B4")),
            "select id, case when id = 'F2' then 'B4' else building_id end as building_id from floors union all select id, case when id in (select place_id from access_points where floor_id = 'F2') then 'B4' else building_id end from places",
        ),
        "mut12": q(
            lambda s, d: mutate.merge_connectors(derive(s, d), "VSB1", "VSB2").connector_stops.select("connector_id", "pos", "node_id"),
            "select case when connector_id = 'VSB2' then 'VSB1' else connector_id end as connector_id, cast(row_number() over (partition by case when connector_id = 'VSB2' then 'VSB1' else connector_id end order by connector_id, pos) - 1 as bigint) as pos, node_id from connector_stops",
        ),
        "mut13": q(
            lambda s, d: (lambda t: mutate.mergeable_peers(t.with_(floors=t.floors.withColumn("building_id", F.concat(F.lit("B"), F.col("idx") % 2)))))(derive(s, d)),
            "with f as (select id, 'B' || (idx % 2) as building_id from floors), firsts as (select s.connector_id, arg_min(f.building_id, s.pos) b from connector_stops s join nodes n on n.id = s.node_id join f on f.id = n.floor_id group by s.connector_id) select a.id, b.id as peer_id from connectors a join connectors b on a.kind = b.kind and a.id <> b.id join firsts x on x.connector_id = a.id join firsts y on y.connector_id = b.id and x.b is not distinct from y.b",
        ),
        "mut14": q(mut14, "select id, array_to_string(list_filter([trim(x) for x in string_split(concat(name, ' , ,', id, ',  x', building_id), ',')], lambda x: x <> ''), '|') as aliases from places"),
        "mut15": q(
            lambda s, d: (lambda t: mutate.draw_hallways(t, some_pairs(t)))(derive(s, d)).select("id", "segment_id", "from_node_id", "to_node_id", "cost", "direction", "instruction"),
            f"with {PAIRS}, ends as (select p.*, b.x-a.x dx, b.y-a.y dy, floor({LEN.format(a='a', b='b')}*10+0.5)/10 as cost from pairs3 p join nodes a on a.id = p.from_node_id join nodes b on b.id = p.to_node_id), two as (select id || '-f' as id, id as segment_id, from_node_id, to_node_id, cost, {heading('dx', 'dy')} as direction from ends union all select id || '-r', id, to_node_id, from_node_id, cost, {heading('-dx', '-dy')} from ends) select *, 'Continue ' || direction || '.' as instruction from two",
        ),
        "mut16": q(
            lambda s, d: (lambda t: mutate.snap_clicks(t, clicks(t)))(derive(s, d)),
            "select a.id as click_id, (select n.id from nodes n where n.floor_id = a.floor_id and sqrt(pow(a.x-n.x,2)+pow(a.y-n.y,2)) <= 18.0*(1 + a.idx % 3) order by sqrt(pow(a.x-n.x,2)+pow(a.y-n.y,2)), n.idx limit 1) as node_id from access_points a",
        ),
        "mut17": q(
            lambda s, d: (lambda t: mutate.connect_buildings(t, some_pairs(t)))(derive(s, d)).edges.where("id like 'H%'").select("id", "segment_id", "from_node_id", "to_node_id", "cost", "instruction"),
            f"with {PAIRS}, ends as (select p.*, ga.name a_name, gb.name b_name from pairs3 p join nodes a on a.id = p.from_node_id join nodes b on b.id = p.to_node_id left join floors fa on fa.id = a.floor_id left join floors fb on fb.id = b.floor_id left join buildings ga on ga.id = fa.building_id left join buildings gb on gb.id = fb.building_id where fa.building_id is distinct from fb.building_id) select id || '-f' as id, id as segment_id, from_node_id, to_node_id, 60.0::double as cost, 'Follow the connector hallway into ' || b_name || '.' as instruction from ends union all select id || '-r', id, to_node_id, from_node_id, 60.0::double, 'Follow the connector hallway into ' || a_name || '.' from ends",
        ),
        "mut18": q(
            lambda s, d: (lambda t: mutate.default_names(t.places, t.access_points.select(F.when(F.col("connection") == "terminal", "room").otherwise("stairs").alias("kind"), F.col("idx").alias("ord"))))(derive(s, d)),
            "with added as (select case when connection = 'terminal' then 'room' else 'stairs' end as kind, idx as ord from access_points) select a.kind, a.ord, a.kind || ' ' || (row_number() over (partition by a.kind order by a.ord) + (select count(*) from places p where p.kind = a.kind)) as name from added a",
        ),
        "mut19": q(
            lambda s, d: (lambda t: mutate.toggle_links(t, t.access_points.where("connection = 'terminal'").select(F.col("id").alias("access_point_id"), F.concat(F.lit("N"), F.col("idx") % 10).alias("node_id")), F.col("idx") % 3 == 0))(derive_paired(s, d)).select("id", "access_point_id", "node_id", F.round("cost", 1).alias("cost"), "to_place_instruction", "from_place_instruction"),
            f"with toggles as (select distinct access_point_id, node_id from (select access_point_id, node_id from links where idx % 3 = 0 union all select id, 'N' || (idx % 10) from access_points where connection = 'terminal')), new as (select t.*, p.x-n.x dx, p.y-n.y dy, floor({LEN.format(a='n', b='p')}*10+0.5)/10 as cost from toggles t join access_points p on p.id = t.access_point_id join nodes n on n.id = t.node_id where not exists (select 1 from links l where l.access_point_id = t.access_point_id and l.node_id = t.node_id)) select id, access_point_id, node_id, round(cost, 1) as cost, null as to_place_instruction, null as from_place_instruction from links l where not exists (select 1 from toggles t where t.access_point_id = l.access_point_id and t.node_id = l.node_id) union all select 'link-' || access_point_id || '-' || node_id, access_point_id, node_id, round(cost, 1), 'Continue ' || {heading('dx', 'dy')} || ' to the destination.', 'Head ' || {heading('-dx', '-dy')} || ' into the hallway.' from new",
        ),
    }
