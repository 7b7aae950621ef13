"""Queries of suggestions, sources and raster operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolark.functions.staging import Staging
from topolark.operators import grid, suggest
from topolark.plans.derived import duckdb_sql, relation
from topolark.plans.q_mutate import heading, sizes
from topolark.plans.q_select import LABELS, WALLS, drawn, drawn_sql, quads
from topolark.plans.q_validate import AUDIT_SQL, audited
from topolark.plans.topology import Topology, derive, derive_staged
from topolark.sources import project

SIZE = 8.0
#: A mask of one cell for each label of a coarse grid of 40 by 30, and its disc offsets.
MASK = f"mask as (select distinct drawing_id, cast(floor(x/30) as int) as cx, cast(floor(y/30) as int) as cy from {LABELS})"


def disc_sql(radius: int, name: str = "disc") -> str:
    return f"{name} as (select dx, dy from range(-{radius}, {radius + 1}) a(dx) cross join range(-{radius}, {radius + 1}) b(dy) where dx*dx+dy*dy <= {radius * radius})"


DILATED = "dil as (select distinct drawing_id, cx+dx as cx, cy+dy as cy from mask cross join disc)"


def eroded(source: str, name: str) -> str:
    return f"{name} as (select drawing_id, cx+dx as cx, cy+dy as cy from {source} cross join disc group by all having count(*) = (select count(*) from disc))"


def mask(s: SparkSession, d: str) -> DataFrame:
    return drawn(s, d, "dlabels").select("drawing_id", F.floor(F.col("x") / 30).cast("int").alias("cx"), F.floor(F.col("y") / 30).cast("int").alias("cy")).distinct()


def leveled(s: SparkSession, d: str) -> DataFrame:
    """Labels as rows of a suggestion request at levels 1 to 5, by drawing; drawing D7 has letters."""
    level = F.when(F.col("drawing_id") == "D7", "Q").otherwise((F.substring("drawing_id", 2, 1).cast("int") % 5 + 1).cast("string"))
    return drawn(s, d, "dlabels").select("drawing_id", "idx", "text", "x", "y", level.alias("level"), F.lit(1224.0).alias("page_width"), F.lit(792.0).alias("page_height"))


SUGGESTED = f"rooms_ as (select drawing_id, idx, text as room_number, x/1224 as x, y/792 as y from (select *, case when drawing_id = 'D7' then 'Q' else cast(cast(substr(drawing_id, 2, 1) as int)%5+1 as varchar) end as level from {LABELS}) where regexp_full_match(text, concat(level, '[0-9]{{2,3}}[A-Z]?')) qualify row_number() over (partition by drawing_id, text order by idx) = 1)"


def offered(s: SparkSession, d: str) -> DataFrame:
    """Room suggestions for floors, some of which the floors have under other case or twice."""
    t = derive(s, d)
    known = t.places.where("kind = 'room'").join(t.access_points.select(F.col("place_id").alias("id"), "floor_id"), "id")
    known = known.where("idx % 5 = 0").select("floor_id", F.col("idx").alias("ord"), "room_number")
    new = t.access_points.where("idx % 4 = 3").select("floor_id", (F.col("idx") + 100000).alias("ord"), F.concat(F.lit("r"), (F.col("idx") % 50).cast("string")).alias("room_number"))
    return known.unionByName(new).withColumns({"x": F.col("ord").cast("double"), "y": F.lit(1.0)})


def polylines(s: SparkSession, d: str) -> DataFrame:
    """Hallways of five points a floor, snapping to nodes here and there."""
    t = derive(s, d)
    nodes = t.nodes.select("floor_id", F.lit("h").alias("hallway"), F.col("idx").alias("pos"), (F.col("x") + F.when(F.col("idx") % 2 == 0, 0.1).otherwise(7.0)).alias("x"), "y")
    return nodes.withColumn("hallway", F.concat("hallway", (F.col("pos") % 3).cast("string")))


def sug4(s: SparkSession, d: str) -> DataFrame:
    return suggest.accept_hallways(derive(s, d), polylines(s, d)).edges.where("id like 'suggested%'").select("from_node_id", "to_node_id", F.round("cost", 1).alias("cost"), "direction", "instruction")


def sug5(s: SparkSession, d: str) -> DataFrame:
    return suggest.accept_hallways(derive(s, d), polylines(s, d)).nodes.where("id like 'suggested%'").select("id", "floor_id", "kind", "x", "y")


def half_sql(v: str) -> str:
    return f"cast(floor({v}*2+0.5)/2 as double)"


HALLS = f"""pts as (select floor_id, 'h' || (idx%3) as hallway, idx as pos, x + case when idx%2=0 then 0.1 else 7.0 end as x, y from nodes),
 keyed as (select *, {half_sql('x')} || ':' || {half_sql('y')} as key from pts),
 old as (select floor_id, {half_sql('x')} || ':' || {half_sql('y')} as key, arg_max(id, idx) as id, arg_max(x, idx) as x, arg_max(y, idx) as y from nodes where kind in ('hallway_endpoint','junction','turn') group by all),
 fresh as (select k.floor_id, k.key, arg_min(k.x, (k.hallway, k.pos)) as x, arg_min(k.y, (k.hallway, k.pos)) as y from keyed k group by all),
 snapped as (select f.floor_id, f.key, coalesce(o.id, 'suggested-node-' || f.floor_id || '-' || f.key) as node_id, coalesce(o.x, f.x) as x, coalesce(o.y, f.y) as y, o.id is null as is_new from fresh f left join old o on o.floor_id = f.floor_id and o.key = f.key),
 hop as (select floor_id, hallway, pos, key as a_key, lead(key) over (partition by floor_id, hallway order by pos) as b_key from keyed),
 ended as (select h.*, a.node_id as u, b.node_id as v, a.x as ax, a.y as ay, b.x as bx, b.y as b_y from hop h join snapped a on a.floor_id = h.floor_id and a.key = h.a_key join snapped b on b.floor_id = h.floor_id and b.key = h.b_key where a.node_id <> b.node_id),
 segs as (select * from ended e where not exists (select 1 from segments s where (s.from_node_id = e.u and s.to_node_id = e.v) or (s.from_node_id = e.v and s.to_node_id = e.u)) qualify row_number() over (partition by least(u, v), greatest(u, v) order by floor_id, hallway, pos) = 1)"""


def touching(s: SparkSession, d: str) -> DataFrame:
    m = grid.dilate(mask(s, d), 1)
    return grid.touching(m, m.where("cx + cy < 12"))


def halls(s: SparkSession, d: str) -> DataFrame:
    """All walls of 32 drawings, drawn out, as lines of corridors."""
    return drawn(s, d, "walls", 32).select("drawing_id", "x1", "y1", (F.col("x1") + F.when(F.col("idx") % 3 > 0, 120.0).otherwise(0.0)).alias("x2"), (F.col("y1") + F.when(F.col("idx") % 3 != 1, 120.0).otherwise(0.0)).alias("y2"))


def corridors(s: SparkSession, d: str) -> DataFrame:
    return grid.dilate(grid.segment_cells(halls(s, d), 6.0), 2)


def painted(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, fills, pixels) of pages: corridor labels sit on fills of one color, but for every fifth drawing."""
    odd, side = F.expr("int(substr(drawing_id, 2)) % 5 = 0"), F.expr("(idx div 32) % 2 = 0")
    labels = drawn(s, d, "dlabels", 32).select("drawing_id", "x", "y", F.when(odd | side, F.col("text")).otherwise(grid.CORRIDOR).alias("text"))
    fills = drawn(s, d, "dlabels", 32).select("drawing_id", F.when(side, "other").otherwise("hall").alias("color"), (F.col("x") - 2).alias("x0"), (F.col("y") - 2).alias("y0"), (F.col("x") + 2).alias("x1"), (F.col("y") + 2).alias("y1"))
    fills = fills.withColumns({"r": F.when(F.col("color") == "hall", 0.2).otherwise(0.9), "g": F.lit(0.6), "b": F.lit(0.4)})
    pixels = corridors(s, d).select("drawing_id", (F.col("cx") * 6).alias("x"), (F.col("cy") * 6).alias("y"), (F.lit(51) + F.col("cx") % 10).alias("r"), F.lit(153).alias("g"), F.lit(102).alias("b"))
    aside = pixels.withColumn("x", F.col("x") + 3).withColumn("r", F.lit(51))
    return labels, fills, pixels.unionByName(aside)


def hallways(s: SparkSession, d: str) -> DataFrame:
    labels, fills, pixels = painted(s, d)
    return grid.hallway_suggestions(grid.corridor_cells(labels, fills, grid.pixel_cells(pixels, 6)), 6.0, 1224.0, 792.0)


def answers(s: SparkSession, d: str) -> DataFrame:
    """One answer of the suggestion service for each label; two in three fail."""
    at = F.struct((F.col("x") / 1224).alias("x"), (F.col("y") / 792).alias("y"))
    return drawn(s, d, "dlabels").select(
        "drawing_id", "idx", F.lit(1224.0).alias("width"), F.lit(792.0).alias("height"), F.when(F.col("idx") % 3 == 0, 200).when(F.col("idx") % 3 == 1, 400 + F.col("idx").cast("int") % 20).alias("status"), F.when(F.col("idx") % 6 == 1, "No page.").when(F.col("idx") % 6 == 2, "Offline.").alias("detail"),
        F.array(F.struct(F.col("text").alias("id"), F.col("text").alias("room_number"), at.alias("position"))).alias("rooms"), F.array(F.struct(F.lit("h").alias("id"), F.array(at, at).alias("points"))).alias("hallways"), F.array(F.lit("w")).alias("warnings"),
    )


def received(s: SparkSession, d: str) -> DataFrame:
    rows = answers(s, d)
    out = project.received_suggestions(rows.withColumn("drawing_id", F.concat_ws("-", "drawing_id", F.col("idx").cast("string"))))
    return out.select("drawing_id", F.round(F.get("rooms", F.lit(0)).position.x, 6).alias("x"), F.size(F.flatten(F.transform("hallways", lambda h: h.points))).cast("long").alias("points"), F.array_join("warnings", "|").alias("warnings"))


def grd7(s: SparkSession, d: str) -> DataFrame:
    """Size of masks and skeletons; a skeleton lies in its mask."""
    m = corridors(s, d)
    k = grid.thin(m)
    inside = grid.intersect(k, m).groupBy("drawing_id").agg(F.count("*").alias("inside"))
    return m.groupBy("drawing_id").agg(F.count("*").alias("cells")).join(k.groupBy("drawing_id").agg(F.count("*").alias("thin")), "drawing_id").join(inside, "drawing_id")


def saved(s: SparkSession, d: str) -> Topology:
    """The derived topology as a document in parts and back."""
    folder = f"{Staging(s).root}/document"
    project.write_parts(derive_staged(s, d), "map", "Derived", "2024-01-01T00:00:00.000Z", folder)
    return project.read_parts(s, folder)[0]


def src1(s: SparkSession, d: str) -> DataFrame:
    t = saved(s, d)
    return t.edges.select("id", "segment_id", "cost", "enabled", "wheelchair_accessible", "idx")


def reloaded(s: SparkSession, d: str) -> Topology:
    """The derived topology saved to the shared folder and loaded again."""
    folder = f"{Staging(s).root}/saved"
    project.save(derive_staged(s, d), folder)
    return project.load(s, folder)


def repaired_file(s: SparkSession, d: str) -> DataFrame:
    """Log of repairing the audited topology as a document."""
    root = Staging(s).root
    project.write_parts(audited(s, d), "m", "Map", "2024-01-01T00:00:00Z", f"{root}/in")
    return project.repair_file(s, f"{root}/in", f"{root}/out")


def file_names(s: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("Main-Floor-%d.pdf", "level_%da plan.PNG", "site-a-esim-map.pdf", "north 12 west %d.pdf", "x.tif", "HALL fl%d.pdf")])
    return derive(s, d).nodes.select("idx", F.replace(F.element_at(kinds, (F.col("idx") % 6 + 1).cast("int")), F.lit("%d"), F.col("idx").cast("string")).alias("name"))


NAMES = "names_ as (select idx, replace(['Main-Floor-%d.pdf','level_%da plan.PNG','site-a-esim-map.pdf','north 12 west %d.pdf','x.tif','HALL fl%d.pdf'][cast(idx%6+1 as int)], '%d', cast(idx as varchar)) as name from nodes)"


def images(s: SparkSession, d: str) -> DataFrame:
    """Heads of image files by formula: PNG, GIF, JPEG behind other segments, and files of no known kind."""
    c = F.col
    size = drawn(s, d, "dlabels").select("idx", (c("idx") % 4000 + 1).alias("w"), (c("idx") * 7 % 3000 + 1).alias("h"))
    hexed = lambda v, n: F.lpad(F.hex(v), 2 * n, "0")
    low = lambda v: F.concat(hexed(v % 256, 1), hexed(F.floor(v / 256).cast("long"), 1))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(c("w"), 4), hexed(c("h"), 4), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), low(c("w")), low(c("h")), F.lit("F70000"))
    jpeg = F.concat(F.lit("FFD8"), F.repeat(F.lit("FFE00010" + "4A" * 14), 3), F.lit("FFFFC400041122"), F.lit("FFC2001108"), hexed(c("h"), 2), hexed(c("w"), 2), F.lit("03011100"))
    head = F.when(c("idx") % 4 == 0, png).when(c("idx") % 4 == 1, gif).when(c("idx") % 4 == 2, jpeg).otherwise(F.lit("255044462D312E37"))
    return size.select("idx", F.unhex(head).alias("content"))


def build() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    def q(run, sql: str):
        return run, duckdb_sql(sql)

    level = "case idx%6 when 0 then cast(idx as varchar) when 1 then idx || 'A' when 2 then 'A' when 3 then cast(idx as varchar) when 4 then '?' else cast(idx as varchar) end"
    return {
        "sug1": q(lambda s, d: suggest.room_suggestions(leveled(s, d)).select("drawing_id", "id", "room_number", "x", "y"), f"with {SUGGESTED} select drawing_id, 'room-' || lower(room_number) as id, room_number, round(x, 7) as x, round(y, 7) as y from rooms_"),
        "sug1_warnings": q(lambda s, d: suggest.suggestion_warnings(leveled(s, d)).select("drawing_id"), f"with {SUGGESTED} select distinct drawing_id from {LABELS} where drawing_id not in (select drawing_id from rooms_)"),
        "sug3": q(
            lambda s, d: suggest.accept_rooms(derive(s, d), offered(s, d)).places.where("id like 'suggested%'").select("id", "building_id", "room_number"),
            "with offered as (select a.floor_id, p.idx as ord, p.room_number from places p join access_points a on a.place_id = p.id where p.kind = 'room' and p.idx%5=0 union all select floor_id, idx+100000, 'r' || (idx%50) from access_points where idx%4=3), fresh as (select * from offered o where not exists (select 1 from places p join access_points a on a.place_id = p.id where p.kind = 'room' and a.floor_id = o.floor_id and upper(p.room_number) = upper(o.room_number)) qualify row_number() over (partition by floor_id, upper(room_number) order by ord) = 1) select 'suggested-' || f.floor_id || '-' || lower(f.room_number) as id, fl.building_id, f.room_number from fresh f join floors fl on fl.id = f.floor_id",
        ),
        "sug4": q(sug4, f"with {HALLS}, two as (select u as from_node_id, v as to_node_id, bx-ax as dx, b_y-ay as dy from segs union all select v, u, ax-bx, ay-b_y from segs) select from_node_id, to_node_id, round(floor(greatest(1.0, sqrt(dx*dx+dy*dy))*10+0.5)/10, 1) as cost, {heading('dx', 'dy')} as direction, 'Continue ' || {heading('dx', 'dy')} || '.' as instruction from two"),
        "sug5": q(sug5, f"with {HALLS}, every as (select from_node_id n from segments union all select to_node_id from segments union all select u from segs union all select v from segs), deg as (select n, count(*) c from every group by n) select s.node_id as id, s.floor_id, case when coalesce(c, 0) >= 3 then 'junction' when coalesce(c, 0) <= 1 then 'hallway_endpoint' else 'turn' end as kind, s.x, s.y from snapped s left join deg on deg.n = s.node_id where is_new and exists (select 1 from keyed k where k.floor_id = s.floor_id and k.key = s.key and (select count(*) from keyed z where z.floor_id = k.floor_id and z.hallway = k.hallway) >= 2)"),
        "sug6": q(
            lambda s, d: suggest.dismiss(derive(s, d).plans.withColumn("suggestions", F.struct(F.array(F.col("id")).alias("rooms"), F.array(F.col("id")).alias("hallways"), F.array(F.lit("w")).alias("warnings"))), "F3", "rooms").select("id", F.size("suggestions.rooms").alias("rooms"), F.size("suggestions.hallways").alias("hallways")),
            "select id, case when floor_id = 'F3' then 0 else 1 end as rooms, 1 as hallways from plans",
        ),
        "src1": q(src1, "select id, segment_id, cost, enabled, wheelchair_accessible, cast(row_number() over (order by idx) - 1 as bigint) as idx from edges"),
        "src1_stops": q(lambda s, d: saved(s, d).connector_stops.select("connector_id", "pos", "node_id"), "select connector_id, cast(row_number() over (partition by connector_id order by pos) - 1 as bigint) as pos, node_id from connector_stops"),
        "src2": q(lambda s, d: project.empty_documents(relation(s, d, "buildings").select(F.col("id").alias("map_id"), F.lower("name").alias("name"), F.col("name").alias("building"))).select("topology.id", "topology.name", F.col("topology.buildings")[0]["id"].alias("building_id"), F.col("topology.buildings")[0]["name"].alias("building"), *[F.size(f"topology.{c}").cast("long").alias(f"n_{c}") for c in ("buildings", "floors", "nodes", "verticalConnectors")]), "select id, lower(name) as name, id || '-building' as building_id, name as building, 1::bigint as n_buildings, 0::bigint as n_floors, 0::bigint as n_nodes, 0::bigint as \"n_verticalConnectors\" from buildings"),
        "src3": q(lambda s, d: reloaded(s, d).links.select("id", "access_point_id", "node_id", "cost"), "select id, access_point_id, node_id, cost from links"),
        "snk2": q(lambda s, d: sizes(reloaded(s, d)).select("relation", "row_count"), " union all ".join(f"select '{n}' as relation, count(*) as row_count from {n}" for n in ("buildings", "floors", "places", "access_points", "nodes", "segments", "edges", "links", "connectors", "connector_stops", "connector_segments", "plans"))),
        "snk3": q(repaired_file, AUDIT_SQL + " select connector_id, connector_name, floor_id, stop_node_id as previous_node_id, replacement_node_id from found where replacement_node_id is not null"),
        "src4": q(lambda s, d: project.text_labels(drawn(s, d, "dlabels").select("drawing_id", "idx", F.when(F.col("idx") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit(" "))).alias("text"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 10).alias("x1"), (F.col("y") + 4).alias("y1"))), f"select drawing_id, idx, text, x + 5 as x, y + 2 as y from {LABELS} where idx%9<>0"),
        "src5": q(lambda s, d: project.vector_segments(drawn(s, d, "walls").select("idx", "layer", F.element_at(F.array(F.lit("l"), F.lit("c"), F.lit("re")), (F.col("idx") % 3 + 1).cast("int")).alias("op"))), f"select idx, layer, case when idx%3=0 then 'line' else 'curve' end as type from {WALLS} where idx%3<>2"),
        "src7": q(lambda s, d: project.page(drawn(s, d, "dlabels").withColumn("page", F.col("idx") % 4 + 1), 2).select("idx"), "select idx from dlabels where idx%4=1"),
        "src9_sizes": q(lambda s, d: images(s, d).select("idx", project.image_size(F.col("content")).alias("i")).select("idx", "i.format", F.col("i.width").cast("double").alias("width"), F.col("i.height").cast("double").alias("height")), "select idx, case idx%4 when 0 then 'png' when 1 then 'gif' when 2 then 'jpeg' end as format, cast(case when idx%4<3 then idx%4000+1 end as double) as width, cast(case when idx%4<3 then idx*7%3000+1 end as double) as height from dlabels"),
        "src9": q(lambda s, d: file_names(s, d).select("idx", project.import_kind(F.col("name"), F.when(F.col("idx") % 6 == 1, "image/png").otherwise("application/octet-stream")).alias("kind")), f"with {NAMES} select idx, case when lower(name) like '%.pdf' then 'pdf' when idx%6=1 then 'image' end as kind from names_"),
        "src10": q(lambda s, d: file_names(s, d).select("idx", project.guess_level(F.col("name"), F.lit("?")).alias("level")), f"select idx, {level} as level from nodes"),
        "src11": q(lambda s, d: project.scale_suggestions(drawn(s, d, "dlabels").select("idx", (F.col("x") / 1224).alias("x"), (F.col("y") / 792).alias("y"), F.lit(1224.0).alias("width"), F.lit(792.0).alias("height"))).select("idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")), "select idx, x, y from dlabels"),
        "snk1": q(lambda s, d: file_names(s, d).select("idx", project.file_slug(F.concat(F.lit("--"), F.when(F.col("idx") % 7 == 0, "!!").otherwise(F.col("name")), F.lit(" "))).alias("slug")), f"with {NAMES} select idx, coalesce(nullif(regexp_replace(regexp_replace(lower(case when idx%7=0 then '!!' else name end), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'map') as slug from names_"),
        "grd1": q(
            lambda s, d: grid.polygon_cells(quads(s, d), SIZE),
            f"with quads as (select drawing_id, idx as poly_id, [x/{SIZE}, (x+3*(20+idx%30))/{SIZE}, (x+2*(20+idx%30))/{SIZE}, (x-(20+idx%30))/{SIZE}] as px, [y/{SIZE}, (y+(20+idx%30))/{SIZE}, (y+3*(20+idx%30))/{SIZE}, (y+2*(20+idx%30))/{SIZE}] as py from {LABELS} where idx%7=1), rws as (select *, unnest(range(cast(trunc(list_min(py)) as bigint), cast(trunc(list_max(py)) as bigint)+1)) as cy from quads), cross_ as (select drawing_id, poly_id, cy, px[k] + (cy+0.5-py[k])*(px[k%4+1]-px[k])/(py[k%4+1]-py[k]) as cx from rws cross join (values (1),(2),(3),(4)) t(k) where (py[k] > cy+0.5) <> (py[k%4+1] > cy+0.5)), num as (select *, row_number() over (partition by drawing_id, poly_id, cy order by cx) - 1 as n from cross_), spans as (select drawing_id, poly_id, cy, n//2 as s, min(cx) as lo, max(cx) as hi from num group by all having count(*) = 2) select distinct drawing_id, cast(unnest(range(cast(trunc(lo) as bigint), cast(trunc(hi) as bigint)+1)) as int) as cx, cast(cy as int) as cy from spans",
        ),
        "grd2": q(lambda s, d: grid.segment_cells(drawn(s, d, "walls"), SIZE), f"with l as (select drawing_id, x1, y1, x2, y2, sqrt(pow(x2-x1,2)+pow(y2-y1,2))/{SIZE} as len from {WALLS}), st as (select *, unnest(range(0, cast(trunc(len*2) as bigint)+2)) as step from l), t as (select *, least(1.0, step/greatest(1.0, len*2)) as t from st) select distinct drawing_id, cast(trunc((x1+(x2-x1)*t)/{SIZE}) as int) as cx, cast(trunc((y1+(y2-y1)*t)/{SIZE}) as int) as cy from t"),
        "grd3": q(lambda s, d: grid.dilate(mask(s, d), 2), f"with {MASK}, {disc_sql(2)}, {DILATED} select drawing_id, cast(cx as int) as cx, cast(cy as int) as cy from dil"),
        "grd4": q(lambda s, d: grid.erode(grid.dilate(mask(s, d), 2), 1), f"with {MASK}, {disc_sql(2, 'wide')}, dil as (select distinct drawing_id, cx+dx as cx, cy+dy as cy from mask cross join wide), {disc_sql(1)}, {eroded('dil', 'ero')} select drawing_id, cast(cx as int) as cx, cast(cy as int) as cy from ero"),
        "grd5": q(lambda s, d: grid.close(mask(s, d), 2), f"with {MASK}, {disc_sql(2)}, {DILATED}, {eroded('dil', 'ero')} select drawing_id, cast(cx as int) as cx, cast(cy as int) as cy from ero"),
        "grd5_open": q(lambda s, d: grid.open_(grid.dilate(mask(s, d), 1), 2), f"with {MASK}, {disc_sql(1, 'small')}, base as (select distinct drawing_id, cx+dx as cx, cy+dy as cy from mask cross join small), {disc_sql(2)}, {eroded('base', 'ero')} select distinct drawing_id, cast(cx+dx as int) as cx, cast(cy+dy as int) as cy from ero cross join disc"),
        "grd6": (touching, duckdb_sql(f"with {MASK}, {disc_sql(1)}, base as (select distinct drawing_id, cx+dx as cx, cy+dy as cy from mask cross join disc), reached(drawing_id, cx, cy) as (select drawing_id, cx, cy from base where cx+cy < 12 union select b.drawing_id, b.cx, b.cy from reached r join base b on b.drawing_id = r.drawing_id and abs(b.cx-r.cx)+abs(b.cy-r.cy) = 1) select drawing_id, cast(cx as int) as cx, cast(cy as int) as cy from reached", recursive=True)),
        "grd7": (grd7, None),
        "grd8": (lambda s, d: grid.trace(grid.thin(corridors(s, d))).groupBy("drawing_id").agg(F.countDistinct("run").alias("runs"), F.count("*").alias("cells")), None),
        "grd9": q(lambda s, d: grid.clear_barriers(grid.dilate(mask(s, d), 2), mask(s, d).where("cx % 3 = 0"), 1), f"with {MASK}, {disc_sql(2)}, {DILATED}, {disc_sql(1, 'one')}, bar as (select distinct drawing_id, cx+dx as cx, cy+dy as cy from mask cross join one where cx%3=0) select drawing_id, cast(cx as int) as cx, cast(cy as int) as cy from dil where not exists (select 1 from bar b where b.drawing_id = dil.drawing_id and b.cx = dil.cx and b.cy = dil.cy)"),
        "set1": q(lambda s, d: (lambda m: grid.union(grid.subtract(m, m.where("cx % 2 = 0")), grid.intersect(m, m.where("cy % 2 = 0"))))(mask(s, d)), f"with {MASK} select * from mask where cx%2<>0 or cy%2=0"),
        "sug2": (hallways, None),
        "sug2_warnings": q(lambda s, d: grid.hallway_warnings(*painted(s, d)[:2], hallways(s, d)), f"select distinct drawing_id, '{grid.NO_FILL}' as warning from {drawn_sql('dlabels', 32)} where cast(substr(drawing_id, 2) as int)%5 = 0"),
        "src8": q(lambda s, d: grid.pixel_cells(drawn(s, d, "dlabels").select("drawing_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), (F.col("idx") % 256).alias("r"), F.lit(1).alias("g"), F.lit(2).alias("b")), 3).select("drawing_id", "cx", "cy", "r"), f"select drawing_id, cast(x as int)//3 as cx, cast(y as int)//3 as cy, idx%256 as r from {LABELS} where cast(x as int)%3 = 0 and cast(y as int)%3 = 0"),
        "src11_failures": q(received, f"select drawing_id || '-' || idx as drawing_id, case when idx%3=0 then round(x, 6) end as x, cast(case when idx%3=0 then 2 else 0 end as bigint) as points, case when idx%3=0 then 'w' when idx%6=1 then 'Automatic suggestions unavailable: No page.' when idx%6=4 then 'Automatic suggestions unavailable: Suggestion service returned ' || (400+idx%20) || '.' when idx%6=2 then 'Automatic suggestions unavailable: Offline.' else 'Automatic suggestions unavailable.' end as warnings from {LABELS}"),
        "src12": q(lambda s, d: file_names(s, d).select("idx", project.refusal(F.col("name"), F.when(F.col("idx") % 5 == 0, "application/pdf").otherwise("text/plain"), F.col("idx") % 4).alias("r")).select("idx", F.coalesce("r.status", F.lit(200)).alias("status"), "r.detail"), f"with {NAMES} select idx, case when not lower(name) like '%.pdf' and idx%5<>0 then 415 when idx%4=0 then 400 else 200 end as status, case when not lower(name) like '%.pdf' and idx%5<>0 then 'Suggestions require a PDF floorplan.' when idx%4=0 then 'The uploaded PDF is empty.' end as detail from names_"),
        "grd10_cells": (lambda s, d: grid.walkable_room_cells(quads(s, d), drawn(s, d, "walls").where("type = 'line'"), 2.0), None),
    }
