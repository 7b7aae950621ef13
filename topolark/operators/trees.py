"""Spanning trees of the points of drawings, plain and around walls, by phases of a growing radius.

A phase joins the points within its radius that are not connected yet, so that after it any two parts lie farther apart
than the radius; only the shortest pair of two parts is kept, and of a point's neighbours at first only the nearest in
each sixth of the circle, which a Euclidean tree can't do without. The edges kept go into tiles of some thousand points:
a tile settles what no edge across its border can change and hands on the few edges that are left, to tiles four times
as wide. A drawing of a few thousand points is one tile; a larger one is many, and no task sees all of its pairs.

Edges are ordered by length, then by the ids of both ends, so that there is one tree.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolark.functions.geometry import cells_of_box
from topolark.functions.staging import Staging
from topolark.operators.spatial import crossed, outermost

#: Points of a tile, about; how much the radius grows in a phase; and how often the points of a cell may be met at first.
TILE, GROWTH, DENSE = 4096, 3.0, 16

EDGE = ["drawing_id", "u", "v", "far", "a", "b"]
SETTLED = "drawing_id string, kind string, u string, v string, far double, a string, b string"


def settle(edges: pd.DataFrame) -> pd.DataFrame:
    """What a tile decides. edges: u, v, far, a, b; v null marks a part u with edges across the border.

    Rows of kind edge are in the tree, of kind left may be, of kind home name the part (v) that a part (u) has become.
    """
    open_ = set(edges.u[edges.v.isna()])
    home: dict[str, str] = {}

    def part(k: str) -> str:
        while home.setdefault(k, k) != k:
            home[k] = home[home[k]]
            k = home[k]
        return k

    forest = []
    for e in edges.dropna(subset="v").sort_values(["far", "a", "b"])[["u", "v", "far", "a", "b"]].itertuples(index=False, name=None):
        if (p := part(e[0])) != (q := part(e[1])):
            home[max(p, q)] = min(p, q)
            forest.append(e)
    # Of the forest an edge is certain if it is the shortest of a part whose edges are all inside the tile.
    home, chosen = {k: k for k in (*home, *open_)}, []
    while forest:
        first: dict[str, tuple] = {}
        for e in forest:
            for end in (part(e[0]), part(e[1])):
                if end not in open_:
                    first.setdefault(end, e)
        if not first:
            break
        for e in set(first.values()):
            p, q = part(e[0]), part(e[1])
            home[max(p, q)] = min(p, q)
            if p in open_ or q in open_:
                open_ -= {p, q}
                open_.add(min(p, q))
            chosen.append(e)
        taken = set(chosen)
        forest = [e for e in forest if e not in taken]
    rows = [("edge", *e) for e in chosen] + [("left", part(e[0]), part(e[1]), *e[2:]) for e in forest]
    rows += [("home", k, part(k), None, None, None) for k in home]
    out = pd.DataFrame(rows, columns=["kind", "u", "v", "far", "a", "b"])
    return out.assign(drawing_id=edges.drawing_id.iloc[0])[["drawing_id", *out.columns]]


def shortest(edges: DataFrame) -> DataFrame:
    """The first edge of each pair of parts."""
    u, v = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    return edges.select("drawing_id", u, v, F.struct("far", "a", "b").alias("e")).groupBy("drawing_id", "u", "v").agg(F.min("e").alias("e")).select("drawing_id", "u", "v", "e.*")


def forest(edges: DataFrame, places: DataFrame, tiled: bool, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """(tree edges, homes (drawing_id, u, v)) of candidate edges between parts (drawing_id, u, v, far, a, b).

    places: drawing_id, u, tx, ty (the tile of each part). Without tiles a drawing is one group.
    """
    if not tiled:
        rows = staging.write(edges.groupBy("drawing_id").applyInPandas(settle, SETTLED))
        return rows.where("kind = 'edge'"), rows.where("kind = 'home'").select("drawing_id", "u", "v")
    found, homes, scale = [], None, 1
    while True:
        tile = lambda e: places.select("drawing_id", F.col("u").alias(e), F.concat_ws("/", *[F.floor(F.col(t) / scale).cast("string") for t in ("tx", "ty")]).alias(f"tile_{e}"))
        at = staging.write(edges.join(tile("u"), ["drawing_id", "u"]).join(tile("v"), ["drawing_id", "v"]))
        across, none = at.where("tile_u <> tile_v"), F.lit(None)
        marks = across.select("drawing_id", F.explode(F.array(F.struct(F.col("tile_u").alias("tile"), "u"), F.struct(F.col("tile_v").alias("tile"), F.col("v").alias("u")))).alias("m")).select("drawing_id", "m.*").distinct()
        inside = at.where("tile_u = tile_v").select(*EDGE, F.col("tile_u").alias("tile")).unionByName(marks.select("drawing_id", "u", none.cast("string").alias("v"), none.cast("double").alias("far"), none.cast("string").alias("a"), none.cast("string").alias("b"), "tile"))
        rows = staging.write(inside.groupBy("drawing_id", "tile").applyInPandas(settle, SETTLED))
        step = rows.where("kind = 'home'").select("drawing_id", "u", "v")
        found.append(rows.where("kind = 'edge'"))
        after = step.select("drawing_id", F.col("u").alias("v"), F.col("v").alias("w"))
        homes = staging.write(step if homes is None else homes.join(after, ["drawing_id", "v"], "left").select("drawing_id", "u", F.coalesce("w", "v").alias("v")).unionByName(step.join(homes, ["drawing_id", "u"], "left_anti")))
        moved = lambda e: after.select("drawing_id", F.col("v").alias(e), F.col("w").alias(f"new_{e}"))
        relabelled = across.join(moved("u"), ["drawing_id", "u"], "left").join(moved("v"), ["drawing_id", "v"], "left").select("drawing_id", F.coalesce("new_u", "u").alias("u"), F.coalesce("new_v", "v").alias("v"), "far", "a", "b")
        edges = staging.write(shortest(rows.where("kind = 'left'").select(*EDGE).unionByName(relabelled).where("u <> v")))
        if edges.isEmpty():
            return reduce(DataFrame.unionByName, found), homes
        scale *= 4


def sector(dx: Column, dy: Column) -> Column:
    """The sixth of the circle that a direction points to."""
    return F.floor((F.atan2(dy, dx) + 3.141592653589793) / 1.0471975511965976)


def scales(points: DataFrame) -> DataFrame:
    """(drawing_id, n, x0, y0, most, tile, reach): extent of each drawing, width of its tiles and radius of its first phase.

    The radius is some two mean distances, or as many halvings less as keep the points of a cell from meeting too often.
    """
    boxes = points.groupBy("drawing_id").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy"])
    wide, high = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    most = F.sqrt(wide**2 + high**2)
    mean = F.greatest(F.sqrt(wide * high / F.col("n")), most / F.col("n"), F.lit(1e-6))
    boxes = boxes.select("drawing_id", "n", F.col("min_x").alias("x0"), F.col("min_y").alias("y0"), (most + 1e-6).alias("most"), (mean * TILE**0.5).alias("tile"), (2 * mean).alias("widest"))
    tried = F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.pow(F.lit(0.5), k))).alias("part")
    cells = points.join(boxes, "drawing_id").select("drawing_id", "n", "widest", "x", "y", tried)
    reach = F.col("widest") * F.col("part")
    met = cells.groupBy("drawing_id", "n", reach.alias("reach"), F.floor(F.col("x") / reach).alias("cx"), F.floor(F.col("y") / reach).alias("cy")).agg(F.count("*").alias("m")).groupBy("drawing_id", "n", "reach").agg(F.sum(F.col("m") * F.col("m")).alias("met"))
    best = met.groupBy("drawing_id").agg(F.coalesce(F.max(F.when(F.col("met") <= DENSE * F.col("n"), F.col("reach"))), F.min("reach")).alias("reach"))
    return boxes.drop("widest").join(best, "drawing_id")


def near_pairs(points: DataFrame) -> DataFrame:
    """Pairs (drawing_id, a, b, u, v, far, ax, ay, bx, by) of points of different homes farther than ``before`` and within ``reach``."""
    x, y, r = F.col("x"), F.col("y"), F.col("reach")
    left = points.select("drawing_id", F.col("id").alias("a"), F.col("home").alias("u"), x.alias("ax"), y.alias("ay"), "reach", "before", F.floor(x / r).alias("cx"), F.floor(y / r).alias("cy"))
    right = points.select("drawing_id", F.col("id").alias("b"), F.col("home").alias("v"), x.alias("bx"), y.alias("by"), F.explode(cells_of_box(x - r, y - r, x + r, y + r, r)).alias("c")).select("drawing_id", "b", "v", "bx", "by", "c.cx", "c.cy")
    far = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return left.join(right, ["drawing_id", "cx", "cy"]).withColumn("far", far).where("a < b and u <> v and far > before and far <= reach").drop("cx", "cy", "reach", "before")


def in_sectors(pairs: DataFrame) -> DataFrame:
    """The pairs in which one end is the other's nearest in a sixth of the circle around it."""
    d = [F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")]
    ends = F.array(F.struct(F.col("a").alias("at"), sector(*d).alias("sixth")), F.struct(F.col("b").alias("at"), sector(-d[0], -d[1]).alias("sixth")))
    rows = pairs.select("drawing_id", F.explode(ends).alias("e"), F.struct("far", "a", "b", "u", "v").alias("p"))
    return rows.groupBy("drawing_id", "e.at", "e.sixth").agg(F.min("p").alias("p")).select("drawing_id", "p.*").distinct()


def in_sight(pairs: DataFrame, walls: DataFrame, ignore: float, staging: Staging) -> DataFrame:
    """The pairs between which no wall (drawing_id, wall_id, x1, y1, x2, y2) lies; ends of walls near a point don't count.

    Most pairs meet one of the outermost walls near their middle; only those that don't are tried against all walls.
    """
    on = ["drawing_id", "hop_id"]
    pairs = staging.write(pairs.withColumn("hop_id", F.struct("a", "b")))
    hops = pairs.select(*on, "ax", "ay", "bx", "by")
    met = crossed(hops, outermost(walls, ("drawing_id",)), ("drawing_id",), ignore=ignore, staging=staging)
    left = staging.write(pairs.join(met, on, "left_anti"))
    met = crossed(left.select(*on, "ax", "ay", "bx", "by"), walls, ("drawing_id",), ignore=ignore)
    return left.join(met, on, "left_anti").drop("hop_id")


def grown(points: DataFrame, walls: DataFrame | None, ignore: float, tiled: bool, staging: Staging) -> tuple[list[DataFrame], DataFrame]:
    """(tree edges, points with new homes): phases until each drawing is one part or the radius covers it."""
    found, phase = [], 0
    while True:
        pairs = near_pairs(points)
        if walls is not None:
            pairs = in_sight(pairs, walls, ignore, staging)
        elif not phase:
            pairs = in_sectors(pairs)
        places = points.where("id = home").select("drawing_id", F.col("id").alias("u"), "tx", "ty")
        edges, homes = forest(shortest(pairs), places, tiled, staging)
        found.append(edges.select("drawing_id", "a", "b", "far"))
        moved = points.join(homes.select("drawing_id", F.col("u").alias("home"), F.col("v").alias("new")), ["drawing_id", "home"], "left").withColumn("home", F.coalesce("new", "home")).drop("new")
        points = staging.write(moved.withColumns({"before": F.col("reach"), "reach": F.col("reach") * GROWTH}))
        parts = points.groupBy("drawing_id").agg(F.min("home").alias("low"), F.max("home").alias("high"), F.first("before").alias("r"), F.first("most").alias("most"))
        if parts.where("low <> high and r < most").isEmpty():
            return found, points
        phase += 1


def spanning_tree(points: DataFrame, walls: DataFrame | None = None, ignore: float = 20.0) -> DataFrame:
    """(drawing_id, a, b, far, seen): the shortest spanning tree of each drawing's points (drawing_id, id, x, y); a before b.

    walls (drawing_id, wall_id, x1, y1, x2, y2): pairs in line of sight then come before all others; seen tells them. Points
    in one place hang from the first of them.
    """
    staging = Staging(points.sparkSession)
    rows = staging.write(points.select("drawing_id", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    single = rows.groupBy("drawing_id", "x", "y").agg(F.min("id").alias("id"))
    alike = rows.withColumnRenamed("id", "b").join(single.withColumnRenamed("id", "a"), ["drawing_id", "x", "y"]).where("a <> b")
    sized = staging.write(scales(single))
    tile = lambda c: F.floor((F.col(c) - F.col(f"{c}0")) / F.col("tile"))
    start = staging.write(single.join(sized, "drawing_id").select("drawing_id", "id", "x", "y", F.col("id").alias("home"), "reach", F.lit(-1.0).alias("before"), "most", tile("x").alias("tx"), tile("y").alias("ty")))
    tiled = not sized.where(F.col("n") > TILE).isEmpty()
    trees = [alike.select("drawing_id", "a", "b", F.lit(0.0).alias("far"), F.lit(True).alias("seen"))]
    if walls is not None:
        seen, start = grown(start, walls, ignore, tiled, staging)
        trees += [t.withColumn("seen", F.lit(True)) for t in seen]
        start = start.drop("reach").join(sized.select("drawing_id", "reach"), "drawing_id").withColumn("before", F.lit(-1.0))
    rest, _ = grown(start, None, ignore, tiled, staging)
    trees += [t.withColumn("seen", F.lit(walls is None)) for t in rest]
    return reduce(DataFrame.unionByName, trees)
