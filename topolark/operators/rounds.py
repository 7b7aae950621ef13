"""Decisions that are made in order, taken by rounds of joins: matches, claims and clusters.

A round decides everything whose outcome no undecided row can change, so the result is that of going through the rows
one by one. Rounds are as many as the longest chain of rows that wait for one another; each is written once, and what is
decided is held in at most four tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolark.functions.components import components
from topolark.functions.staging import Staging


class Collected:
    """Rows of several rounds in at most four tables."""

    def __init__(self, staging: Staging):
        self.staging, self.tables = staging, []

    def add(self, rows: DataFrame) -> None:
        self.tables.append(rows)
        if len(self.tables) > 4:
            self.tables = [self.staging.write(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables)


def one_to_one(pairs: DataFrame, by: str, left: str, right: str, order: list[str]) -> DataFrame:
    """The pairs that remain when pairs are taken in an order and no left or right is taken twice.

    A pair that comes first for both of its ends is always taken; it takes all other pairs of these ends away.
    """
    staging = Staging(pairs.sparkSession)
    kept, place = Collected(staging), F.struct(*order, left, right)
    first = lambda end: F.min(place).over(Window.partitionBy(by, end))
    left_over = pairs
    while True:
        marked = staging.write(left_over.withColumn("taken_", (first(left) == place) & (first(right) == place)))
        taken = marked.where("taken_")
        if taken.isEmpty():
            return kept.all().select(*pairs.columns) if kept.tables else taken.select(*pairs.columns)
        kept.add(taken)
        rest = marked.where("not taken_").drop("taken_")
        for end in (left, right):
            rest = rest.join(taken.select(by, end), [by, end], "left_anti")
        left_over = rest.select(*pairs.columns)


def claims(pairs: DataFrame, by: str = "drawing_id") -> DataFrame:
    """(by, who, what): each ``who``, in order, claims the nearest ``what`` not claimed yet.

    pairs: by, who (its place in the order), what, far, takes; a nearest one that doesn't take is left alone, and its claimant
    goes without.
    """
    return shared_claims(pairs.withColumn("side", F.col("who")).select(by, "side", "what", "far", "takes"), pairs.select(by, F.col("who").alias("side"), "who").distinct(), by)


def shared_claims(pairs: DataFrame, members: DataFrame, by: str = "drawing_id") -> DataFrame:
    """claims() of members (by, side, who) of sides, all of a side having the same pairs (by, side, what, far, takes).

    All ask for their nearest, each is kept by the first who asked, and the others ask for their next. Members of a side ask one
    behind the other at once, since none can get what one before it of the same side gets or passes over. So rounds don't grow
    with the members of a side, and of a round only the first who asked for each ``what`` is written.
    """
    staging = Staging(pairs.sparkSession)
    offer = F.array_sort(F.collect_list(F.struct("far", "what", "takes")))
    sides = pairs.groupBy(by, "side").agg(offer.alias("offers"))
    sides = sides.join(members.groupBy(by, "side").agg(F.array_sort(F.collect_list("who")).alias("members")), [by, "side"])
    sides = staging.write(sides.repartition(by, "side"))
    kinds = dict(pairs.dtypes) | {"who": dict(members.dtypes)["who"]}
    asked_for = f"{by} {kinds[by]}, what {kinds['what']}, who {kinds['who']}, takes boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = []
            for group, offers, who, held in pdf[[by, "offers", "members", "held"]].itertuples(index=False, name=None):
                first = {} if held is None else {h["what"]: h["holder"] for h in held}
                at = 0
                for w in who:
                    while at < len(offers) and first.get(offers[at]["what"], w) < w:
                        at += 1
                    if at == len(offers):
                        break
                    asked.append((group, offers[at]["what"], w, offers[at]["takes"]))
                    at += bool(offers[at]["takes"])
            yield pd.DataFrame(asked, columns=[by, "what", "who", "takes"])

    wanted = staging.write(pairs.select(by, "side", "what").distinct())
    holders, state = None, None
    while True:
        if holders is None:
            rows = sides.withColumn("held", F.lit(None).cast(f"array<struct<what: {kinds['what']}, holder: {kinds['who']}>>"))
        else:
            held = wanted.join(holders, [by, "what"]).groupBy(by, "side").agg(F.collect_list(F.struct("what", "holder")).alias("held"))
            rows = sides.join(held, [by, "side"], "left")
        asked = staging.write(rows.select(by, "offers", "members", "held").mapInPandas(run, asked_for))
        new = asked.where("takes").select(by, "what", F.col("who").alias("holder"))
        holders = staging.write((new if holders is None else new.unionByName(holders)).groupBy(by, "what").agg(F.min("holder").alias("holder")))
        before, state = state, holders.agg(F.count("*"), F.sum(F.xxhash64(by, "what", "holder").cast("decimal(38,0)"))).first()
        if state == before:
            return asked.where("takes").select(by, "who", "what")


def around_cell(reach: float, size: float) -> Column:
    """Cells (cx, cy) that may hold points within reach of a point in cell (cx, cy)."""
    span = math.ceil(reach / size)
    steps = [(i, j) for i in range(-span, span + 1) for j in range(-span, span + 1)]
    return F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in steps]))


def spread_out(rows: DataFrame, reach: float, size: float) -> DataFrame:
    """rows (by, ord, x, y, cx, cy) as (drawing_id, l_ord, lx, ly) in all cells within reach."""
    named = rows.select("drawing_id", F.col("ord").alias("l_ord"), F.col("x").alias("lx"), F.col("y").alias("ly"), around_cell(reach, size).alias("c"))
    return named.select("drawing_id", "l_ord", "lx", "ly", "c.cx", "c.cy")


def close(reach: float) -> Column:
    return F.sqrt((F.col("x") - F.col("lx")) ** 2 + (F.col("y") - F.col("ly")) ** 2) <= reach


def leaders(points: DataFrame, reach: float) -> DataFrame:
    """The points (drawing_id, ord, x, y) that have no leader before them within reach.

    Points of a cell are all within reach of one another, so only the first undecided of each can lead, and meets at most the
    points of 25 cells: it leads if none of those within reach comes before it.
    """
    staging, cell = Staging(points.sparkSession), ["drawing_id", "cx", "cy"]
    size = 0.7 * reach
    open_ = staging.write(points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)}))
    found = Collected(staging)
    while not open_.isEmpty():
        first = open_.groupBy(*cell).agg(F.min(F.struct("ord", "x", "y")).alias("f")).select("f.*", *cell)
        waiting = open_.join(spread_out(first, reach, size), cell).where(close(reach) & (F.col("ord") < F.col("l_ord"))).select("drawing_id", F.col("l_ord").alias("ord")).distinct()
        new = staging.write(first.join(waiting, ["drawing_id", "ord"], "left_anti"))
        found.add(new)
        covered = open_.join(spread_out(new, reach, size), cell).where(close(reach)).select("drawing_id", "ord").distinct()
        open_, before = staging.write(open_.join(covered, ["drawing_id", "ord"], "left_anti")), open_
        staging.drop(before)
    return found.all().select("drawing_id", "ord", "x", "y", "cx", "cy") if found.tables else open_.select("drawing_id", "ord", "x", "y", "cx", "cy")


def by_leader(points: DataFrame, reach: float) -> DataFrame:
    """points with home: the ord of the first leader within reach that comes before each, itself included."""
    size = 0.7 * reach
    near = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)}).join(spread_out(leaders(points, reach), reach, size), ["drawing_id", "cx", "cy"])
    homes = near.where(close(reach) & (F.col("l_ord") <= F.col("ord"))).groupBy("drawing_id", "ord").agg(F.min("l_ord").alias("home"))
    return points.join(homes, ["drawing_id", "ord"])


def islands(points: DataFrame, reach: float) -> DataFrame:
    """points with island: points within reach of one another, and whatever chains of them connect, share one."""
    staging = Staging(points.sparkSession)
    name = lambda cx, cy: F.concat_ws("/", "drawing_id", cx.cast("string"), cy.cast("string"))
    rows = points.withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach)})
    cells = rows.select("drawing_id", "cx", "cy").distinct()
    next_to = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("nx"), (F.col("cy") + j).alias("ny")) for i, j in ((1, 0), (0, 1), (1, 1), (1, -1))]))
    beside = cells.select("drawing_id", "cx", "cy", next_to.alias("n")).select("drawing_id", "cx", "cy", "n.*")
    links = beside.join(cells.select("drawing_id", F.col("cx").alias("nx"), F.col("cy").alias("ny")), ["drawing_id", "nx", "ny"])
    roots = components(links.select(name(F.col("cx"), F.col("cy")).alias("a"), name(F.col("nx"), F.col("ny")).alias("b")), staging)
    named = rows.withColumn("node", name(F.col("cx"), F.col("cy"))).join(roots, "node", "left")
    return named.select(*points.columns, F.coalesce("root", "node").alias("island"))


def by_last_member(points: DataFrame, reach: float) -> DataFrame:
    """points with home: the first member's ord of the first cluster whose last member is within reach, or the own.

    A cluster never leaves its island, so each island is gone through on its own; islands are as large as points lie
    densely, not as drawings are. An island is one row, so that a call of the function takes many of them.
    """

    def one(points: list[tuple[int, float, float]]) -> list[int]:
        ends: dict[int, tuple[float, float]] = {}
        homes = []
        for at, x, y in points:
            home = next((h for h, (lx, ly) in ends.items() if math.hypot(x - lx, y - ly) <= reach), at)
            ends[home] = (x, y)
            homes.append(home)
        return homes

    @F.pandas_udf("array<long>")
    def homes(ords: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([one(list(zip(*(v.tolist() for v in p)))) for p in zip(ords, xs, ys)], dtype=object)

    rows = islands(points.select("drawing_id", "ord", "x", "y"), reach)
    rows = rows.groupBy("drawing_id", "island").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("p"))
    rows = rows.withColumn("homes", homes("p.ord", "p.x", "p.y"))
    home = F.transform("p", lambda q, i: F.struct(q.ord.alias("ord"), q.x.alias("x"), q.y.alias("y"), F.get("homes", i).alias("home")))
    return rows.select("drawing_id", F.inline(home))
