"""Spatial joins as equi-joins on grid buckets, followed by the exact predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolark.functions.geometry import cells_of_box, cells_of_line, columns_of_line, segments_cross
from topolark.functions.staging import Staging

#: Edge length of a bucket.
BUCKET = 40.0
#: Columns and rows between the first and the last cell of a wall, at most.
REACH = 4
#: Ids that a row of lines in one place holds, at most.
ALIKE_MOST = 256


def within(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = (), l_xy: tuple[str, str] = ("x", "y"), r_xy: tuple[str, str] = ("rx", "ry"), strict: bool = False) -> DataFrame:
    """Pairs within a radius, with their distance ``far``. Columns of the two sides must differ but for ``on``.

    The left side is put into the bucket of its point and the right side into all buckets within the radius, so
    that each pair meets once and nothing needs deduplication.
    """
    size = max(radius, 1e-9)
    a = left.withColumns({"bx_": F.floor(F.col(l_xy[0]) / size), "by_": F.floor(F.col(l_xy[1]) / size)})
    x, y = F.col(r_xy[0]), F.col(r_xy[1])
    b = right.withColumn("c_", F.explode(cells_of_box(x - radius, y - radius, x + radius, y + radius, size)))
    b = b.withColumns({"bx_": F.col("c_.cx"), "by_": F.col("c_.cy")}).drop("c_")
    far = F.sqrt((F.col(l_xy[0]) - x) ** 2 + (F.col(l_xy[1]) - y) ** 2)
    near = (far < radius) if strict else (far <= radius)
    return a.join(b.hint("merge"), [*on, "bx_", "by_"]).withColumn("far", far).where(near).drop("bx_", "by_")


def meets(ignore: float, boxes: bool = True) -> Column:
    """Whether a hop meets a wall. boxes: far lines are told by their boxes first."""
    c = F.col
    # Boxes that lie apart, by more than any slack of the exact test, are told at less cost.
    near = [F.greatest(f"a{k}", f"b{k}") >= F.least(f"{k}1", f"{k}2") - 1e-3 for k in "xy"] + [F.least(f"a{k}", f"b{k}") <= F.greatest(f"{k}1", f"{k}2") + 1e-3 for k in "xy"]
    exact = segments_cross((c("ax"), c("ay")), (c("bx"), c("by")), (c("x1"), c("y1")), (c("x2"), c("y2")))
    if boxes:
        exact = near[0] & near[1] & near[2] & near[3] & exact
    if ignore:
        far = [F.sqrt((c(p) - c(f"x{k}")) ** 2 + (c(q) - c(f"y{k}")) ** 2) for p, q in (("ax", "ay"), ("bx", "by")) for k in (1, 2)]
        exact = exact & (F.least(*far) > ignore)
    return exact


def alike(rows: DataFrame, name: str, place: list[str]) -> DataFrame:
    """A row for each place, with the ids of the rows there; of more than ALIKE_MOST ids, a row for each so many."""
    number = F.row_number().over(Window.partitionBy(*place).orderBy(name)) - 1
    lists = rows.select(*place, name).withColumn("list_", F.floor(number / ALIKE_MOST)).groupBy(*place, "list_").agg(F.collect_list(name).alias(f"{name}s_"))
    return lists.drop("list_")


def within_alike(left: DataFrame, right: DataFrame, radius: float, l_id: str, r_id: str, on: tuple[str, ...] = ()) -> DataFrame:
    """The pairs (l_id, r_id, far) of within(): rows in one place meet once and carry their ids along, so that pairs are neither written nor joined again."""
    a, b = alike(left, l_id, [*on, "x", "y"]), alike(right, r_id, [*on, "rx", "ry"])
    pairs = within(a, b, radius, on).withColumn(l_id, F.explode(f"{l_id}s_")).withColumn(r_id, F.explode(f"{r_id}s_"))
    return pairs.select(*on, l_id, r_id, "far")


def by_cell(rows: DataFrame, ends: tuple[str, ...], earlier: str) -> DataFrame:
    """Lines by the cells (cx_, cy_) of size_ that they pass. A bit of ``earlier`` is set for each cell of the line, of those up to REACH columns
    and rows away, that comes before the row's own, by columns and then by rows."""
    rows = rows.withColumn("spans_", columns_of_line(*map(F.col, ends), F.col("size_"))).select("*", F.posexplode("spans_").alias("at_", "span_"))
    rows = rows.withColumn("cy_", F.explode(F.sequence("span_.low", "span_.high")))

    def bits(found: Column, span: Column) -> Column:
        high = F.when(span.cx == F.col("cx_"), F.col("cy_") - 1).otherwise(span.high)
        first, last = F.greatest(span.low - F.col("cy_"), F.lit(-REACH)) + REACH, F.least(high - F.col("cy_"), F.lit(REACH)) + REACH
        rows = F.when(first <= last, F.pow(F.lit(2.0), last + 1) - F.pow(F.lit(2.0), first)).otherwise(0.0)
        return found + (rows * F.pow(F.lit(2.0), (2 * REACH + 1) * (F.col("cx_") - span.cx))).cast("long")

    near = F.slice("spans_", F.greatest(F.col("at_") + 1 - REACH, F.lit(1)), F.least(F.col("at_"), F.lit(REACH)) + 1)
    rows = rows.withColumn("cx_", F.col("span_.cx"))
    return rows.withColumn(earlier, F.aggregate(near, F.lit(0).cast("long"), bits)).drop("spans_", "at_", "span_")


def outermost(walls: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """The walls (x1, y1, x2, y2) without those that lie within a longer one from the same start: what meets these meets that one."""
    c = F.col
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    way = {"sx_": F.signum(dx), "sy_": F.signum(dy), "slope_": F.coalesce(dy / F.nullif(dx, F.lit(0.0)), F.lit(0.0))}
    rows, key = walls.withColumns(way), [*on, "x1", "y1", *way]
    longest = rows.groupBy(*key).agg(F.max(F.struct((F.abs(dx) + F.abs(dy)).alias("l"), "x2", "y2")).alias("m_"))
    # A slope that is the same by rounding only drops nothing.
    own = (c("x2") == c("m_.x2")) & (c("y2") == c("m_.y2")) | (dx * (c("m_.y2") - c("y1")) != dy * (c("m_.x2") - c("x1")))
    return rows.join(longest, key).where(own).select(*walls.columns)


def crossing(hops: DataFrame, walls: DataFrame, on: tuple[str, ...] = (), bucket: float = BUCKET, ignore: float = 0.0) -> DataFrame:
    """The pairs (hop_id, wall_id), each once, of hops (ax, ay, bx, by) that meet walls (x1, y1, x2, y2).

    Lines in the same place meet the same lines: they are tested once and carry their ids along, so that pairs are neither written nor joined again.
    Walls lie in cells some of which they span, longer ones in larger cells, and hops in cells of all sizes that walls have.
    ignore: walls an end of which comes this near to an end of the hop don't count.
    """
    c, a_ends, b_ends = F.col, ("ax", "ay", "bx", "by"), ("x1", "y1", "x2", "y2")
    # A wall spans at most three cells, so no two of its cells are more than four apart.
    span = F.greatest(F.abs(c("x2") - c("x1")), F.abs(c("y2") - c("y1"))) / ((REACH - 1) * bucket)
    size = bucket * F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(span, F.lit(1.0)))))
    b = alike(walls, "wall_id", [*on, *b_ends]).withColumn("size_", size)
    sizes = walls.select(size.alias("size_")).where("size_ is not null").distinct()  # powers of two
    a = alike(hops, "hop_id", [*on, *a_ends]).crossJoin(F.broadcast(sizes))
    a, b = by_cell(a, a_ends, "a_before_"), by_cell(b, b_ends, "b_before_")
    # Values that can't be null keep the code of the test short enough to be compiled; lines that lack one are gone.
    filled = lambda rows, names: rows.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in names})
    a, b = filled(a.withColumn("slack_", (F.abs(c("bx") - c("ax")) + F.abs(c("by") - c("ay"))) * 1e-3 + 1e-8), [*a_ends, "slack_"]), filled(b, b_ends)
    # Walls with both ends on one side of the hop's line, by more than any slack of the exact test, are told first.
    side = [(c("bx") - c("ax")) * (c(f"y{k}") - c("ay")) - (c("by") - c("ay")) * (c(f"x{k}") - c("ax")) for k in (1, 2)]
    apart = ((side[0] > c("slack_")) & (side[1] > c("slack_"))) | ((side[0] < -c("slack_")) & (side[1] < -c("slack_")))
    # A pair counts in the first cell that both share. Rows that were exploded are more than they are thought to be, so nothing is broadcast.
    once = c("a_before_").bitwiseAND(c("b_before_")) == 0
    pairs = a.hint("merge").join(b, [*on, "size_", "cx_", "cy_"]).where(~apart & once & meets(ignore, boxes=False)).select(*on, "hop_ids_", "wall_ids_")
    return pairs.withColumn("hop_id", F.explode("hop_ids_")).withColumn("wall_id", F.explode("wall_ids_")).select(*on, "hop_id", "wall_id")


def crossed(hops: DataFrame, walls: DataFrame, on: tuple[str, ...] = (), bucket: float = BUCKET, ignore: float = 0.0, staging: Staging | None = None) -> DataFrame:
    """(hop_id) of the hops that meet any wall, each once, with the columns that they share with walls. A hop's search in a bucket ends at the first wall.

    staging: hops are tried in the bucket of their middle first, then in those of two more points, and only those left in all.
    """
    hops = hops.select(*on, "hop_id", "ax", "ay", "bx", "by")
    cells = lambda rows, ends: rows.withColumn("c_", F.explode(cells_of_line(*map(F.col, ends), bucket)))
    b, exact, keys = cells(walls.select(*on, "x1", "y1", "x2", "y2").distinct(), ("x1", "y1", "x2", "y2")), meets(ignore), (*on, "c_")
    for name in keys:
        b = b.withColumnRenamed(name, f"{name}_w")
        exact = (F.col(name) == F.col(f"{name}_w")) & exact
    met = lambda rows: rows.join(b.hint("merge"), exact, "left_semi").select(*on, "hop_id").distinct()
    if staging is None:
        return met(cells(hops, ("ax", "ay", "bx", "by")))
    # A wall that is met is met, whichever bucket finds it.
    at = lambda k: F.struct(*[F.floor((F.col(f"a{v}") + (F.col(f"b{v}") - F.col(f"a{v}")) * k) / bucket).alias(f"c{v}") for v in "xy"])
    b, left, found = staging.write(b), staging.write(hops), []
    for share in ([0.5], [0.25, 0.75], None):
        some = cells_of_line(*map(F.col, ("ax", "ay", "bx", "by")), bucket) if share is None else F.array(*map(at, share))
        found.append(staging.write(met(left.withColumn("c_", F.explode(some)))))
        left = left.join(found[-1], [*on, "hop_id"], "left_anti")
    return reduce(DataFrame.unionByName, found)
