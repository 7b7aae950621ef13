"""Planar geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    """1 for a left turn from a over b to c, -1 for a right turn, 0 within 1e-9 of a line."""
    turn = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return F.when(F.abs(turn) < 1e-9, 0).when(turn > 0, 1).otherwise(-1)


def on_segment(ax, ay, bx, by, px, py, eps: float = 1e-6) -> Column:
    """Whether p lies within the box of a and b."""
    inside = lambda a, b, p: (p >= F.least(a, b) - eps) & (p <= F.greatest(a, b) + eps)
    return inside(ax, bx, px) & inside(ay, by, py)


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether segments a-b and c-d meet, touching and overlapping included. Points are (x, y) columns."""
    turns = [orientation(*a, *b, *c), orientation(*a, *b, *d), orientation(*c, *d, *a), orientation(*c, *d, *b)]
    proper = (turns[0] != turns[1]) & (turns[2] != turns[3])
    touch = [(turns[0] == 0) & on_segment(*a, *b, *c), (turns[1] == 0) & on_segment(*a, *b, *d), (turns[2] == 0) & on_segment(*c, *d, *a), (turns[3] == 0) & on_segment(*c, *d, *b)]
    return proper | touch[0] | touch[1] | touch[2] | touch[3]


def ring_edges(points: Column) -> Column:
    """Pairs (a, b) of a closed ring."""
    return F.transform(points, lambda p, i: F.struct(p.alias("a"), F.get(points, (i + 1) % F.size(points)).alias("b")))


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Ray cast to the right; an edge counts its lower end in y but not its upper."""

    def crosses(e: Column) -> Column:
        spans = (e.a.y > y) != (e.b.y > y)
        at = (e.b.x - e.a.x) * (y - e.a.y) / F.nullif(e.b.y - e.a.y, F.lit(0.0)) + e.a.x
        return spans & F.coalesce(x < at, F.lit(False))

    return F.aggregate(ring_edges(points), F.lit(False), lambda inside, e: inside != crosses(e))


def polygon_area(points: Column) -> Column:
    return F.abs(F.aggregate(ring_edges(points), F.lit(0.0), lambda s, e: s + e.a.x * e.b.y - e.b.x * e.a.y)) / 2


def centroid(points: Column) -> Column:
    """Mean of the vertices."""
    mean = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[f]) / F.size(points)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def path_length(points: Column) -> Column:
    hops = F.transform(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, i: F.sqrt((p.x - F.get(points, i).x) ** 2 + (p.y - F.get(points, i).y) ** 2))
    return F.aggregate(hops, F.lit(0.0), lambda s, h: s + h)


def line_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance from p to the line through a and b, or to a where they coincide."""
    length = F.sqrt((bx - ax) ** 2 + (by - ay) ** 2)
    across = F.abs((bx - ax) * (ay - py) - (ax - px) * (by - ay))
    return F.when(length == 0, F.sqrt((px - ax) ** 2 + (py - ay) ** 2)).otherwise(across / F.nullif(length, F.lit(0.0)))


#: Fixed thresholds, first match wins.
COLORS = (
    ("white/very light", "r > 0.85 and g > 0.85 and b > 0.85"),
    ("tan/orange", "r > 0.85 and g > 0.55 and g < 0.85 and b < 0.65"),
    ("magenta/pink", "r > 0.8 and g < 0.3 and b > 0.5"),
    ("green", "g > 0.8 and r < 0.5 and b < 0.5"),
    ("yellow", "r > 0.85 and g > 0.85 and b < 0.65"),
    ("blue/cyan", "b > 0.8 and r < 0.6"),
    ("salmon/pink", "r > 0.8 and g > 0.4 and g < 0.75 and b < 0.75"),
)


def color_name() -> Column:
    """Name of the color in columns r, g and b (0 to 1)."""
    cases = " ".join(f"when {test} then '{name}'" for name, test in COLORS)
    return F.expr(f"case {cases} else format_string('rgb(%.2f,%.2f,%.2f)', r, g, b) end")


def cells_of_box(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Grid cells (cx, cy) that the box of two corners overlaps."""
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    return F.flatten(F.transform(span(x0, x1), lambda cx: F.transform(span(y0, y1), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def columns_of_line(x0: Column, y0: Column, x1: Column, y1: Column, size: float | Column, slack: float = 1e-5) -> Column:
    """Grid columns (cx) that a line passes, in order, with its rows in each (from low to high), with a little slack on all sides."""
    low, high = F.least(x0, x1), F.greatest(x0, x1)
    slope = F.when(high - low > slack, (y1 - y0) / F.nullif(x1 - x0, F.lit(0.0)))

    def column(cx: Column) -> Column:
        at = lambda x: y0 + (F.greatest(low, F.least(high, x)) - x0) * slope
        a, b = F.coalesce(at(cx * size - slack), y0), F.coalesce(at((cx + 1) * size + slack), y1)
        return F.struct(cx.alias("cx"), F.floor((F.least(a, b) - slack) / size).alias("low"), F.floor((F.greatest(a, b) + slack) / size).alias("high"))

    return F.transform(F.sequence(F.floor((low - slack) / size), F.floor((high + slack) / size)), column)


def cells_of_line(x0: Column, y0: Column, x1: Column, y1: Column, size: float, slack: float = 1e-5) -> Column:
    """Grid cells (cx, cy) that a line passes, column by column, with a little slack on all sides.

    Two lines that meet share a cell, and a line takes cells in proportion to its length, not to its box.
    """
    return F.flatten(F.transform(columns_of_line(x0, y0, x1, y1, size, slack), lambda c: F.transform(F.sequence(c.low, c.high), lambda cy: F.struct(c.cx.alias("cx"), cy.alias("cy")))))
