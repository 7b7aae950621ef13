"""Queries of the integrity rules and the connector audit over perturbed relations, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolark.operators import audit, validate
from topolark.plans.derived import duckdb_sql
from topolark.plans.topology import derive, derive_paired, derive_staged


def last(name: str) -> str:
    return f"(select * from {name} qualify row_number() over (partition by id order by idx desc) = 1)"


def issue(rule: int, code: str, path: str, message: str, rest: str, sub: str = "-1") -> str:
    return f"select {rule} as rule, cast({path.split('|')[1]} as bigint) as idx, cast({sub} as bigint) as sub, '{code}' as code, {path.split('|')[0]} as path, {message} as message from {rest}"


def path(collection: str, field: str = "", idx: str = "t.idx") -> str:
    tail = f"].{field}" if field else "]"
    return f"concat('{collection}[', {idx}, '{tail}')|{idx}"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def missing(rule: int, code: str, rel: str, coll: str, field: str, col: str, target: str, message: str, extra: str = "true") -> str:
    return issue(rule, code, path(coll, field), message, f"{rel} t where {extra} and not exists (select 1 from {target} x where x.id = t.{col})")


ENDS = f"""ends as (select t.*, a.id a_id, b.id b_id, a.kind a_kind, b.kind b_kind, fa.building_id fa, fb.building_id fb from d_segments t
  left join {last('d_nodes')} a on a.id = t.from_node_id left join {last('d_nodes')} b on b.id = t.to_node_id
  left join {last('d_floors')} fa on fa.id = a.floor_id left join {last('d_floors')} fb on fb.id = b.floor_id)"""
STOPS = f"""stops as (select s.connector_id, s.pos, s.node_id, c.kind, c.name, c.idx, n.id n_id, n.kind n_kind, n.floor_id, f.building_id from d_connector_stops s join d_connectors c on c.id = s.connector_id
  left join {last('d_nodes')} n on n.id = s.node_id left join {last('d_floors')} f on f.id = n.floor_id)"""
PATHS = f"""paths as (select s.pos, s.segment_id, c.kind, c.idx, x.id x_id, x.kind x_kind from d_connector_segments s join d_connectors c on c.id = s.connector_id left join {last('d_segments')} x on x.id = s.segment_id)"""
BAD = "(t.cost is null or isnan(t.cost) or isinf(t.cost) or t.cost <= 0)"
EXPECTED = "case when t.kind = 'stairs' then 'stair_landing' else 'elevator_lobby' end"
STOP_PATH = "concat('verticalConnectors[', t.idx, '].stopNodeIds[', t.pos, ']')|t.idx"
SEGMENT_PATH = "concat('verticalConnectors[', t.idx, '].segmentIds[', t.pos, ']')|t.idx"

RULE_SQL = {
    1: " union all ".join(issue(1, "duplicate_id", path(coll, "id"), "concat('Duplicate id: ', t.id)", f"(select id, idx, row_number() over (partition by id order by idx) n from d_{rel}) t where n > 1") for rel, coll in validate.COLLECTIONS.items()),
    2: missing(2, "missing_building", "d_floors", "floors", "buildingId", "building_id", "d_buildings", "concat('Unknown building: ', t.building_id)"),
    3: missing(3, "missing_building", "d_places", "places", "buildingId", "building_id", "d_buildings", "concat('Unknown building: ', t.building_id)"),
    4: missing(4, "missing_floor", "d_nodes", "nodes", "floorId", "floor_id", "d_floors", "concat('Unknown floor: ', t.floor_id)"),
    5: missing(5, "missing_place", "d_access_points", "accessPoints", "placeId", "place_id", "d_places", "concat('Unknown place: ', t.place_id)"),
    6: missing(6, "missing_floor", "d_access_points", "accessPoints", "floorId", "floor_id", "d_floors", "concat('Unknown floor: ', t.floor_id)"),
    7: issue(7, "building_mismatch", path("accessPoints", "floorId"), lit("Access point floor must belong to the place's building"), f"d_access_points t join {last('d_places')} p on p.id = t.place_id join {last('d_floors')} f on f.id = t.floor_id where p.building_id <> f.building_id"),
    8: missing(8, "missing_node", "d_access_points", "accessPoints", "nodeId", "node_id", "d_nodes", "concat('Unknown node: ', t.node_id)", "t.connection = 'network_node'"),
    9: f"with {ENDS} " + issue(9, "missing_node", path("segments"), lit("Segment references an unknown node"), "ends t where a_id is null or b_id is null"),
    10: issue(10, "self_segment", path("segments"), lit("A path segment must connect different nodes"), "d_segments t where from_node_id = to_node_id"),
    11: f"with {ENDS} " + issue(11, "building_connection_same_building", path("segments"), lit("A building connection must join nodes in different buildings"), "ends t where a_id is not null and b_id is not null and t.kind = 'building_connection' and fa is not distinct from fb"),
    12: f"with {ENDS} " + issue(12, "building_connection_node_kind", path("segments"), lit("Building connections must use building_portal nodes at both ends"), "ends t where t.kind = 'building_connection' and (a_kind <> 'building_portal' or b_kind <> 'building_portal') and a_id is not null and b_id is not null"),
    13: f"with {ENDS} " + issue(13, "cross_building_segment_kind", path("segments", "kind"), lit("Paths between buildings must use building_connection"), "ends t where t.kind <> 'building_connection' and fa <> fb"),
    14: missing(14, "missing_segment", "d_edges", "edges", "segmentId", "segment_id", "d_segments", "concat('Unknown segment: ', t.segment_id)"),
    15: issue(15, "edge_segment_mismatch", path("edges"), lit("Edge endpoints must match its segment"), f"d_edges t join {last('d_segments')} s on s.id = t.segment_id where (t.from_node_id, t.to_node_id) not in ((s.from_node_id, s.to_node_id), (s.to_node_id, s.from_node_id))"),
    16: issue(16, "invalid_cost", path("edges", "cost"), lit("Edge cost must be positive"), f"d_edges t where {BAD}"),
    17: missing(17, "missing_access_point", "d_links", "terminalAccessLinks", "accessPointId", "access_point_id", "d_access_points", lit("Unknown access point")),
    18: issue(18, "non_terminal_access_link", path("terminalAccessLinks", "accessPointId"), lit("Access link must reference a terminal point"), f"d_links t join {last('d_access_points')} p on p.id = t.access_point_id where p.connection <> 'terminal'"),
    19: missing(19, "missing_node", "d_links", "terminalAccessLinks", "nodeId", "node_id", "d_nodes", lit("Unknown node")),
    20: issue(20, "floor_mismatch", path("terminalAccessLinks", "nodeId"), lit("Terminal link cannot cross floors"), f"d_links t join {last('d_access_points')} p on p.id = t.access_point_id join {last('d_nodes')} n on n.id = t.node_id where p.floor_id <> n.floor_id"),
    21: issue(21, "invalid_cost", path("terminalAccessLinks", "cost"), lit("Terminal access cost must be positive"), f"d_links t where {BAD}"),
    22: missing(22, "missing_place", "d_connectors", "verticalConnectors", "placeId", "place_id", "d_places", lit("Connector references an unknown place"), "t.place_id <> ''"),
    23: f"with {STOPS} " + issue(23, "missing_node", STOP_PATH, lit("Unknown connector stop node"), "stops t where n_id is null", "t.pos"),
    24: f"with {STOPS} " + issue(24, "connector_node_kind", STOP_PATH, f"concat(t.kind, ' stops must use ', {EXPECTED}, ' nodes')", f"stops t where n_kind <> {EXPECTED}", "t.pos"),
    25: f"with {STOPS} " + issue(25, "vertical_connector_crosses_buildings", path("verticalConnectors", "stopNodeIds"), lit("A stair or elevator group cannot span different buildings; use a building connection instead"), "(select idx from stops group by idx having count(distinct nullif(building_id, '')) > 1) t"),
    26: f"with {PATHS} " + issue(26, "missing_segment", SEGMENT_PATH, lit("Unknown connector segment"), "paths t where x_id is null", "t.pos"),
    27: f"with {PATHS} " + issue(27, "connector_segment_kind", SEGMENT_PATH, "concat('Connector segments must have kind ', t.kind)", "paths t where x_kind <> t.kind", "t.pos"),
}

DEGREE = """degree as (select n.id, count(e.n) as degree from (select distinct id from d_nodes) n left join (select from_node_id n from d_edges where coalesce(enabled, true) union all select to_node_id n from d_edges where coalesce(enabled, true)) e on e.n = n.id group by n.id)"""
def quiet(nodes: str) -> str:
    """Predicate by which edges of some stops are left out, so that stops become isolated."""
    return f"cast(substr({nodes}, 2) as bigint) % 30 <> 0 and cast(substr({nodes}, 2) as bigint) % 50 <> 1"


QUIET = f"select * from edges where {quiet('from_node_id')} and {quiet('to_node_id')}"
NODES = "select id, case when kind in ('stair_landing', 'elevator_lobby') then concat('F', cast(floor(idx / 10) as bigint) % 4) else floor_id end floor_id, kind, x, y, idx from nodes"
AUDIT_SQL = f"""with quiet as ({QUIET}), anodes as ({NODES}),
 degree as (select n.id, count(e.n) as degree from anodes n left join (select from_node_id n from quiet where coalesce(enabled, true) union all select to_node_id n from quiet where coalesce(enabled, true)) e on e.n = n.id group by n.id),
 stops as (select s.connector_id, c.name, s.pos, s.node_id, n.id n_id, n.kind, n.floor_id, {EXPECTED.replace('t.kind', 'c.kind')} expected, d.degree
   from {{stops}} s join connectors c on c.id = s.connector_id left join anodes n on n.id = s.node_id left join degree d on d.id = s.node_id),
 candidates as (select s.connector_id, s.pos, min(n.id) node, count(*) many from stops s join anodes n on n.floor_id = s.floor_id and n.kind = s.expected and n.id <> s.node_id join degree d on d.id = n.id and d.degree > 0 group by s.connector_id, s.pos),
 found as (select s.connector_id, name as connector_name, s.pos, node_id as stop_node_id, coalesce(floor_id, 'unknown') as floor_id,
   case when n_id is null then 'missing_stop' when kind <> expected then 'wrong_stop_kind' when degree = 0 then 'isolated_stop' end as code,
   case when n_id is not null and kind = expected and degree = 0 and many = 1 then node end as replacement_node_id
   from stops s left join candidates c on c.connector_id = s.connector_id and c.pos = s.pos)"""
AUDIT_STOPS = "(select * from connector_stops union all select id connector_id, kind, cast(1000 as bigint) pos, 'N-missing' node_id from connectors where idx % 2 = 0 union all select id, kind, cast(1001 as bigint), 'N3' from connectors where idx % 3 = 1)"
AUDIT_SQL = AUDIT_SQL.replace("{stops}", AUDIT_STOPS)


def audited(spark: SparkSession, sf_dir: str):
    """The derived topology with isolated, missing and wrong stops."""
    t = derive_staged(spark, sf_dir)
    number = lambda c: F.substring(c, 2, 20).cast("long")
    keep = lambda c: (number(F.col(c)) % 30 != 0) & (number(F.col(c)) % 50 != 1)
    extra = t.connectors.where("idx % 2 = 0").select(F.col("id").alias("connector_id"), "kind", F.lit(1000).cast("long").alias("pos"), F.lit("N-missing").alias("node_id"))
    wrong = t.connectors.where("idx % 3 = 1").select(F.col("id").alias("connector_id"), "kind", F.lit(1001).cast("long").alias("pos"), F.lit("N3").alias("node_id"))
    few = F.concat(F.lit("F"), F.floor(F.col("idx") / 10) % 4)
    nodes = t.nodes.withColumn("floor_id", F.when(F.col("kind").isin("stair_landing", "elevator_lobby"), few).otherwise(F.col("floor_id")))
    return t.with_(nodes=nodes, edges=t.edges.where(keep("from_node_id") & keep("to_node_id")), connector_stops=t.connector_stops.unionByName(extra).unionByName(wrong))


def aud4_nodes(t) -> DataFrame:
    return audit.repair(t).topology.nodes.select("id", "floor_id", "kind", "label")


#: Rules that read links.
LINKED = (1, 17, 18, 19, 20, 21)


def build() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    out = {}
    for k, rule in enumerate(validate.RULES, 1):
        out[f"val{k}"] = (lambda s, d, rule=rule, made=derive_paired if k in LINKED else derive: rule(made(s, d, perturbed=True)), duckdb_sql(RULE_SQL[k]))
    every = " union all ".join(f"select code, path from ({RULE_SQL[k]}) r{k}" for k in range(1, 28) if not RULE_SQL[k].startswith("with"))
    merged = f"""with {ENDS}, {STOPS}, {PATHS}, issues as ({every} {' '.join(f"union all select code, path from ({'select' + RULE_SQL[k].rsplit(') select', 1)[1]}) r{k}" for k in range(1, 28) if RULE_SQL[k].startswith('with'))})
      select code, count(*) as issues, min(path) as first_path from issues group by code"""
    out["val28"] = (lambda s, d: validate.validate(derive_staged(s, d, perturbed=True)).groupBy("code").agg(F.count("*").alias("issues"), F.min("path").alias("first_path")), duckdb_sql(merged))
    degree = duckdb_sql(f"with {DEGREE} select id, degree from degree")
    out["aud1"] = (lambda s, d: audit.routed_degree(derive(s, d, perturbed=True)), degree)
    out["aud2"] = (lambda s, d: audit.audit(audited(s, d)).select("connector_id", "connector_name", "pos", "stop_node_id", "floor_id", "code"), duckdb_sql(AUDIT_SQL + " select connector_id, connector_name, pos, stop_node_id, floor_id, code from found where code is not null"))
    out["aud3"] = (lambda s, d: audit.audit(audited(s, d)).where("code = 'isolated_stop'").select("connector_id", "stop_node_id", "replacement_node_id"), duckdb_sql(AUDIT_SQL + " select connector_id, stop_node_id, replacement_node_id from found where code = 'isolated_stop'"))
    repairs = AUDIT_SQL + ", repairs as (select * from found where replacement_node_id is not null)"
    out["aud4"] = (lambda s, d: audit.repair(audited(s, d)).repairs, duckdb_sql(repairs + " select connector_id, connector_name, floor_id, stop_node_id as previous_node_id, replacement_node_id from repairs"))
    out["aud4_stops"] = (
        lambda s, d: audit.repair(audited(s, d)).topology.connector_stops.select("connector_id", "pos", "node_id"),
        duckdb_sql(repairs + f" select s.connector_id, s.pos, coalesce(r.replacement_node_id, s.node_id) as node_id from {AUDIT_STOPS} s left join (select distinct stop_node_id, replacement_node_id from repairs) r on r.stop_node_id = s.node_id"),
    )
    out["aud4_nodes"] = (
        lambda s, d: aud4_nodes(audited(s, d)),
        duckdb_sql(repairs + """ select n.id, n.floor_id, n.kind, (select r.connector_name from repairs r where r.replacement_node_id = n.id order by r.connector_id, r.pos limit 1) as label from anodes n
          where not exists (select 1 from repairs r where r.stop_node_id = n.id) or exists (select 1 from segments s where s.from_node_id = n.id or s.to_node_id = n.id)"""),
    )
    return out
