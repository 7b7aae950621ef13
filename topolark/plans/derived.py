"""A topology derived by formula from the driver's tables, by statements valid in Spark SQL and DuckDB alike.

The plain relations form a sound topology; those that start with ``d_`` are perturbed copies in which every
integrity rule is broken by some rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("region", "nation", "supplier", "customer", "lineitem", "part")

NUM = "sqrt((nb.x-na.x)*(nb.x-na.x)+(nb.y-na.y)*(nb.y-na.y))"

#: Fixed statements, in the order in which they build on each other.
RELATIONS: dict[str, str] = {
    "buildings": "select concat('B',r_regionkey) id, r_name as name, cast(r_regionkey as bigint) idx from region",
    "floors": "select concat('F',n_nationkey) id, concat('B',n_regionkey) building_id, cast(row_number() over (partition by n_regionkey order by n_nationkey) as string) as level, n_name as name, cast(n_nationkey as bigint) idx from nation",
    "nodes": "select concat('N',s_suppkey) id, concat('F',s_nationkey) floor_id, case when s_suppkey%10=0 then 'stair_landing' when s_suppkey%10=1 then 'elevator_lobby' when s_suppkey%10=2 then 'building_portal' when s_suppkey%10<6 then 'junction' else 'turn' end kind, cast((s_suppkey*37)%1000 as double) x, cast((s_suppkey*53)%700 as double) y, s_suppkey idx from supplier",
    "pairs": "select a, b, min(o) o from (select l_suppkey a, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey) b, l_orderkey o from lineitem) q where b is not null and o%61=0 group by a,b",
    "segments": "select concat('S',a,'-',b) id, case when fa.building_id<>fb.building_id then 'building_connection' when fa.id<>fb.id then 'stairs' else 'hallway' end kind, concat('N',a) from_node_id, concat('N',b) to_node_id, o src, cast(row_number() over (order by a,b)-1 as bigint) idx from pairs join nodes na on na.id=concat('N',a) join nodes nb on nb.id=concat('N',b) join floors fa on fa.id=na.floor_id join floors fb on fb.id=nb.floor_id",
    "edges": f"select concat(s.id,d.sfx) id, s.id segment_id, case when d.sfx='-f' then s.from_node_id else s.to_node_id end from_node_id, case when d.sfx='-f' then s.to_node_id else s.from_node_id end to_node_id, case when s.src%101=0 then cast(0 as double) else greatest(cast(1 as double), floor({NUM}*10+0.5)/cast(10 as double)) end cost, case when s.src%17=0 then false when s.src%17=1 then true else cast(null as boolean) end enabled, case when s.src%5=0 then 'no' when s.src%5=1 then 'yes' else cast(null as string) end wheelchair_accessible, s.idx*2+d.k idx from segments s join nodes na on na.id=s.from_node_id join nodes nb on nb.id=s.to_node_id cross join (select '-f' sfx, 0 k union all select '-r' sfx, 1 k) d where d.sfx='-f' or s.src%3<>0",
    "places": "select concat('P',c_custkey) id, concat('B',n_regionkey) building_id, case when c_custkey%4<>0 then 'room' else 'landmark' end kind, c_name as name, case when c_custkey%4<>0 then cast(c_custkey as string) end room_number, c_custkey idx from customer join nation on c_nationkey=n_nationkey",
    "access_points": "select concat('A',c_custkey) id, concat('P',c_custkey) place_id, concat('F',c_nationkey) floor_id, case when c_custkey%4<>0 then 'terminal' else 'network_node' end connection, case when c_custkey%4=0 then case when c_custkey%20=0 then 'N-missing' else concat('N',c_custkey%(select count(*) from supplier)) end end node_id, cast((c_custkey*31)%1000 as double) x, cast((c_custkey*17)%700 as double) y, c_custkey idx from customer",
    "links": "select concat('L',a.idx,'-',n.idx) id, a.id access_point_id, n.id node_id, greatest(cast(1 as double), floor(sqrt((n.x-a.x)*(n.x-a.x)+(n.y-a.y)*(n.y-a.y))*10+0.5)/cast(10 as double)) cost, cast(row_number() over (order by a.idx,n.idx)-1 as bigint) idx from access_points a join nodes n on n.floor_id=a.floor_id where a.connection='terminal'",
    "connector_stops": "select concat(case when n.kind='stair_landing' then 'VS' else 'VE' end, f.building_id) connector_id, case when n.kind='stair_landing' then 'stairs' else 'elevator' end kind, cast(row_number() over (partition by f.building_id,n.kind order by n.idx)-1 as bigint) pos, n.id node_id from nodes n join floors f on f.id=n.floor_id where n.kind in ('stair_landing','elevator_lobby')",
    "connectors": "select connector_id id, kind, concat('Connector ', connector_id) name, case when kind='stairs' then 'P4' end place_id, cast(row_number() over (order by connector_id)-1 as bigint) idx from (select distinct connector_id, kind from connector_stops) q",
    "connector_segments": "select concat('VS', f.building_id) connector_id, cast(row_number() over (partition by f.building_id order by s.idx)-1 as bigint) pos, s.id segment_id from segments s join nodes n on n.id=s.from_node_id join floors f on f.id=n.floor_id join connectors c on c.id=concat('VS', f.building_id) where s.kind='stairs' and s.idx%4=0",
    "plans": "select concat('plan-', id) id, id floor_id, concat(lower(name), '-floor-', level, '.pdf') file_name, cast(1224 as double) width, cast(792 as double) height, idx from floors where idx%3<>1",
    "dlabels": "select p_partkey idx, 1 page, cast(p_size*100+p_partkey%37 as string) text, cast((p_partkey*37)%1224 as double) x, cast((p_partkey*53)%792 as double) y from part",
    "walls": "select p_partkey idx, case when p_partkey%9=8 then 'curve' else 'line' end type, cast((p_partkey*37)%1224 as double) x1, cast((p_partkey*53)%792 as double) y1, cast((p_partkey*37)%1224+p_size as double) x2, cast((p_partkey*53)%792+(p_partkey%3)*p_size as double) y2, case p_partkey%5 when 0 then 'ARCH|A-WALL' when 1 then 'ARCH|A-DOOR' when 2 then 'ARCH|A-FURN' when 3 then 'A-SPAC-IDEN-LEDR' end layer from part",
    "fills": "select p_partkey idx, concat('c',p_partkey%6) color, cast((p_partkey*37)%1224 as double) x0, cast((p_partkey*53)%792 as double) y0, cast((p_partkey*37)%1224+p_size as double) x1, cast((p_partkey*53)%792+5 as double) y1 from part",
    # Perturbed copies.
    "d_buildings": "select id, name, idx from buildings where idx<>3 union all select id, 'again' as name, idx+100 idx from buildings where idx=1",
    "d_floors": "select id, case when idx%6=5 then 'B-missing' else building_id end building_id, level, name, idx from floors where idx<>7 union all select id, 'B0' as building_id, '9' as level, name, idx+1000 idx from floors where idx%9=4",
    "d_nodes": "select id, case when idx%13=5 then 'F-missing' else floor_id end floor_id, case when idx%10=0 and idx%4=2 then 'turn' else kind end kind, x, y, idx from nodes where idx%29<>7 union all select id, floor_id, kind, x, y, idx+1000000 idx from nodes where idx%19=4",
    "d_segments": "select id, case when idx%11=2 and kind<>'hallway' then 'hallway' when idx%7=3 then 'building_connection' else kind end kind, from_node_id, case when idx%23=1 then from_node_id when idx%31=3 then 'N-missing' else to_node_id end to_node_id, src, idx from segments where idx%37<>5 union all select id, kind, from_node_id, to_node_id, src, idx+1000000 idx from segments where idx%40=8",
    "d_edges": "select id, case when idx%41=3 then 'S-missing' else segment_id end segment_id, from_node_id, case when idx%43=2 then 'N1' else to_node_id end to_node_id, case idx%47 when 1 then cast('NaN' as double) when 2 then cast(null as double) when 3 then cast(-1 as double) when 4 then cast('Infinity' as double) else cost end cost, enabled, wheelchair_accessible, idx from edges union all select id, segment_id, from_node_id, to_node_id, cost, enabled, wheelchair_accessible, idx+1000000 idx from edges where idx%50=9",
    "d_places": "select id, case when idx%33=4 then 'B-missing' else building_id end building_id, kind, name, room_number, idx from places where idx%45<>7 union all select id, building_id, kind, name, room_number, idx+1000000 idx from places where idx%55=6",
    "d_access_points": "select id, case when idx%27=5 then 'P-missing' else place_id end place_id, case when idx%26=7 then 'F-missing' when idx%32=9 then 'F1' else floor_id end floor_id, connection, node_id, x, y, idx from access_points where idx%49<>11 union all select id, place_id, floor_id, connection, node_id, x, y, idx+1000000 idx from access_points where idx%60=13",
    "d_links": "select id, case when idx%51=3 then 'A-missing' when idx%59=6 then 'A4' else access_point_id end access_point_id, case when idx%53=4 then 'N-missing' when idx%61=7 then 'N1' else node_id end node_id, case when idx%57=5 then cast(0 as double) when idx%63=8 then cast('NaN' as double) else cost end cost, idx from links union all select id, access_point_id, node_id, cost, idx+10000000 idx from links where idx%70=9",
    "d_connectors": "select id, kind, name, case idx%3 when 0 then 'P-missing' when 1 then '' else place_id end place_id, idx from connectors union all select id, kind, name, place_id, idx+100 idx from connectors where idx=0",
    "d_connector_stops": "select connector_id, kind, pos, case when pos%5=1 then 'N-missing' else node_id end node_id from connector_stops union all select id connector_id, kind, cast(1000 as bigint) pos, 'N10' as node_id from connectors union all select id connector_id, kind, cast(1001 as bigint) pos, 'N1' as node_id from connectors",
    "d_connector_segments": "select connector_id, pos, case when pos%3=1 then 'S-missing' else segment_id end segment_id from connector_segments union all select c.id connector_id, cast(1000 as bigint) pos, s.id segment_id from connectors c cross join segments s where s.idx=6",
}


def needed(text: str, made: Iterable[str] = ()) -> list[str]:
    """Relations that a statement mentions, with what they build on unless they are made already, in order."""
    found: set[str] = set()
    queue = [text]
    while queue:
        said = set(re.findall(r"\w+", queue.pop()))
        for name in RELATIONS.keys() & said - found:
            found.add(name)
            queue += [] if name in made else [RELATIONS[name]]
    return [n for n in RELATIONS if n in found]


def duckdb_sql(statement: str, recursive: bool = False) -> str:
    """The statement with the relations it needs as common table expressions.

    A statement may start with ``with`` and further expressions of its own.
    """
    parts = ", ".join(f"{n} as ({RELATIONS[n]})" for n in needed(statement))
    body = statement.strip()
    head = "with recursive " if recursive else "with "
    if body.lower().startswith("with "):
        return f"{head}{parts}, {body[5:]}" if parts else f"{head}{body[5:]}"
    return f"{head}{parts} {body}" if parts else body


#: Numbering of a whole relation, which Spark does over ranges where it can write tables.
NUMBERING = re.compile(r"cast\(row_number\(\) over \(order by ([^)]*)\)-1 as bigint\) idx")


def unnumbered(spark: SparkSession, sf_dir: str, name: str, made: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """A relation without its idx, and the columns by whose order it is numbered, which come beside its own."""
    keys = NUMBERING.search(RELATIONS[name])[1].split(",")
    order = [f"order{k}_" for k in range(len(keys))]
    said = ", ".join(f"{key} as {column}" for key, column in zip(keys, order))
    return relation(spark, sf_dir, name, made, NUMBERING.sub(said, RELATIONS[name])), order


def relation(spark: SparkSession, sf_dir: str, name: str, made: dict[str, str] | None = None, text: str | None = None) -> DataFrame:
    """A relation over the driver's tables; made: folders of relations that are written already."""
    made, text = made or {}, text or RELATIONS[name]
    bodies = {n: f"select * from parquet.`{made[n]}`" if n in made else RELATIONS[n] for n in needed(text, made)}
    used = " ".join([text, *bodies.values()])
    sources = [s for s in SOURCES if re.search(rf"\b{s}\b", used)]
    parts = [f"{s} as (select * from parquet.`{sf_dir}/{s}.parquet`)" for s in sources] + [f"{n} as ({body})" for n, body in bodies.items()]
    return spark.sql(f"with {', '.join(parts)} {text}")
