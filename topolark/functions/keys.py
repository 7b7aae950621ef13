"""Lookups over possibly repeated ids, and the scalar rules of the document format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(rows: DataFrame, pick, key: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(pick(F.struct(*rest), "idx").alias("r")).select(key, "r.*")


def last_wins(rows: DataFrame, key: str = "id") -> DataFrame:
    """The row with the largest idx of each key, as a map filled in order keeps it."""
    return _one(rows, F.max_by, key)


def first_wins(rows: DataFrame, key: str = "id") -> DataFrame:
    """The row with the smallest idx of each key, as a search from the front finds it."""
    return _one(rows, F.min_by, key)


def renamed(rows: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns])


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves toward plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def number(text: Column) -> Column:
    """Numeric value of a document's text: blank is 0, decimal or 0x notation counts, anything else is NaN."""
    t = F.trim(text)
    decimal = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    hexa = t.rlike(r"^0[xX][0-9a-fA-F]+$")
    return (
        F.when(t == "", 0.0)
        .when(decimal, t.try_cast("double"))
        .when(hexa, F.conv(F.substring(t, 3, 64), 16, 10).cast("double"))
        .when(t.rlike(r"^[+-]?Infinity$"), F.when(t.startswith("-"), float("-inf")).otherwise(float("inf")))
        .otherwise(float("nan"))
    )


def natural_key(text: Column) -> Column:
    """Sort key by which digit runs compare as numbers."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(F.ltrim(r, F.lit("0")), 20, "0")).otherwise(r)), "")


def bad_cost(cost: Column) -> Column:
    return cost.isNull() | F.isnan(cost) | (F.abs(cost) == float("inf")) | (cost <= 0)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def clamped_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Editor's distance: at least 1."""
    return F.greatest(F.lit(1.0), distance(ax, ay, bx, by))


def direction(dx: Column, dy: Column) -> Column:
    """Eight-way heading with y growing down; an axis dominates beyond 1.8 times the other."""
    ew, ns = F.when(dx > 0, "east").otherwise("west"), F.when(dy > 0, "south").otherwise("north")
    diagonal = F.concat(F.when(dy >= 0, "south").otherwise("north"), F.when(dx >= 0, "east").otherwise("west"))
    return F.when(F.abs(dx) > F.abs(dy) * 1.8, ew).when(F.abs(dy) > F.abs(dx) * 1.8, ns).otherwise(diagonal)
