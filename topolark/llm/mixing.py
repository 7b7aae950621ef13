"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Source k of the ordered sources has weight w_k and size S_k (its words). All sources share the total of
all sizes; a source's target stops at ``max_epochs`` times its size and the excess is reshared by weight
until no target is above its cap. The result is target = min(cap, level * weight) at one common level,
which is found by clamping rounds: each round is one aggregate over the table of sources.

The documents of a source are then taken whole: floor(target / S) times each, and once more those that fit when the
rest of the target is filled in a seeded hash order: a document that exceeds what is left is passed over, and the
filling goes on behind it until what is left is at most ``near`` of the target or no document fits. If more than that
is left, one further document is taken whose excess is smaller than the gap. Each round of the filling finds the next
document that doesn't fit, on words pre-summed by hash bucket, so that no source, however large, is sorted in one
task: only the bucket that holds that document is. Rounds are few, as what is left shrinks by a good part in each.

Nulls and ties: a null source is a source of its own and comes last; a null text has size 0; a null doc_id is
kept. The order is by (hash of seed, doc_id and text, doc_id, size); rows equal in all of these are all drawn
or none. Sizes of 0 give targets of 0. An empty table gives an empty result. Extra columns pass through mix()
untouched; columns named like those that it adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolark.llm.common import Scratch, packed, unpacked, word_count

#: Hash buckets of a source, of which one is sorted in a round.
BUCKETS = 1 << 12


def in_order(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources`` with position (from 0) by code points, null last: ranges are numbered apart and then joined up."""
    order = (F.col("source").isNull(), F.col("source"))
    ranges = scratch.write(sources.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    counts = ranges.groupBy("range_").agg(F.count("*").alias("n"))  # a row for each partition
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_"))
    within = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return ranges.withColumn("within_", within).join(F.broadcast(starts), "range_").withColumn("position", F.col("start_") + F.col("within_")).drop("range_", "within_", "start_")


def source_targets(sources: DataFrame, weights: list[float], max_epochs: float, scratch: Scratch) -> DataFrame:
    """``sources`` (source, key_, source_size) with target. Weights repeat along the order of the sources."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    every = F.array(*[F.lit(float(w)) for w in weights])
    ranked = in_order(sources, scratch).withColumn("weight", F.get(every, F.col("position") % len(weights))).withColumn("cap", cap)
    ranked = scratch.write(ranked.drop("position"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        below = F.col("cap") <= F.lit(level) * F.col("weight")
        sums = ranked.agg(F.count(F.when(below, 1)), F.sum(F.when(below, F.col("cap"))), F.sum(F.when(~below, F.col("weight")))).first()
        if sums[0] == clamped or not sums[2]:
            break
        clamped, level = sums[0], (total - (sums[1] or 0.0)) / sums[2]
    return ranked.select("source", "key_", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def keyed(df: DataFrame) -> DataFrame:
    """With a key that joins a null source as any other."""
    return df.withColumn("key_", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """docs with size, key_ and place_, the place in the order of drawing, by bucket first."""
    out = keyed(docs.withColumns({"size": word_count(F.col("text")), "draw_": F.xxhash64(F.lit(seed), "doc_id", "text")}))
    bucket = F.pmod(F.col("draw_"), F.lit(BUCKETS)).alias("bucket")
    return out.withColumn("place_", F.struct(bucket, "draw_", F.col("doc_id").isNull().alias("no_id"), "doc_id", "size"))


def drawn() -> Column:
    """Whether a row (place_, size) is drawn once more by its source's rounds and fill_."""
    place = F.col("place_")
    in_round = lambda r: (r.above.isNull() | (place > r.above)) & (r.below.isNull() | (place < r.below)) & (F.col("size") <= r.most)
    return F.exists("rounds_", in_round) | F.coalesce(place == F.col("fill_"), F.lit(False))


def next_round(short: DataFrame, plan: DataFrame, near: float) -> DataFrame:
    """plan after one more round of each source that is open and lacks more than ``near`` of its target."""
    active = plan.where(F.col("open_") & (F.col("gap_") > near * F.col("target"))).select("key_", "gap_", F.try_element_at("rounds_", F.lit(-1)).below.alias("above_"))
    left = short.join(active, "key_").where((F.col("above_").isNull() | (F.col("place_") > F.col("above_"))) & (F.col("size") <= F.col("gap_")))
    buckets = left.groupBy("key_", F.col("place_.bucket").alias("bucket"), "gap_").agg(F.sum("size").alias("words"))
    end = F.sum("words").over(Window.partitionBy("key_").orderBy("bucket"))
    fits = F.col("end") <= F.col("gap_")
    cut = buckets.withColumn("end", end).groupBy("key_").agg(F.max(F.when(fits, F.col("end"))).alias("whole_"), F.min(F.when(~fits, F.col("bucket"))).alias("cut_"))
    inside = left.withColumn("cut_", F.col("place_.bucket")).join(cut, ["key_", "cut_"])
    inside = inside.withColumn("end", F.coalesce("whole_", F.lit(0)) + F.sum("size").over(Window.partitionBy("key_").orderBy("place_")))
    edge = inside.groupBy("key_").agg(F.max(F.when(fits, F.col("end"))).alias("part_"), F.min(F.when(~fits, F.col("place_"))).alias("below_"))
    found = active.join(cut, "key_").join(edge, "key_", "left")
    taken = F.coalesce("part_", "whole_", F.lit(0))
    entry = F.struct(F.col("above_").alias("above"), F.col("below_").alias("below"), F.col("gap_").alias("most"))
    found = found.select(F.col("key_").alias("found_"), entry.alias("entry_"), (F.col("gap_") - taken).alias("new_gap_"), F.col("below_").isNotNull().alias("goes_on_"))
    both = plan.join(found, plan.key_ == found.found_, "left")
    rounds = F.when(F.col("found_").isNotNull(), F.array_append("rounds_", F.col("entry_"))).otherwise(F.col("rounds_"))
    return both.select(*[c for c in plan.columns if c not in ("gap_", "open_", "rounds_")], F.coalesce("new_gap_", "gap_").alias("gap_"), F.coalesce("goes_on_", F.lit(False)).alias("open_"), rounds.alias("rounds_"))


def filled(short: DataFrame, plan: DataFrame, near: float, scratch: Scratch) -> DataFrame:
    """plan with rounds_ (what to draw in the order of places) and fill_ (the place of a last document)."""
    place = dict(short.dtypes)["place_"]
    none = F.array().cast(f"array<struct<above: {place}, below: {place}, most: double>>")
    plan = scratch.write(plan.withColumns({"gap_": F.col("target") - F.col("whole") * F.col("source_size"), "open_": F.lit(True), "rounds_": none}))
    while not plan.where(F.col("open_") & (F.col("gap_") > near * F.col("target"))).isEmpty():
        plan = scratch.write(next_round(short, plan, near))
    lacking = plan.where(F.col("gap_") > near * F.col("target")).withColumn("fill_", F.lit(None).cast(place))
    left = short.join(lacking, "key_").where(~drawn() & (F.col("size") < 2 * F.col("gap_")) & (F.col("size") > 0))
    filler = left.groupBy("key_").agg(F.min_by("place_", F.struct(F.abs(F.col("size") - F.col("gap_")), "place_")).alias("fill_"), F.first("gap_").alias("gap_"))
    alike = short.join(filler, "key_").where("place_ = fill_").groupBy("key_", "fill_", "gap_").agg(F.sum("size").alias("words"))
    return scratch.write(plan.join(alike.where("words < 2 * gap_").select("key_", "fill_"), "key_", "left"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, seed: int = 7, near: float = 0.001, narrow: bool = False) -> DataFrame:
    """All rows with size, source_size, target (of the source), times (whole repetitions) and taken (words).

    narrow: return doc_id, source and these columns only, which saves a second pass over the texts.
    """
    scratch = Scratch(docs.sparkSession)
    rows = sized(packed(docs, "doc_id", "source", "text"), seed)
    short = scratch.write(rows.select("doc_id", "source", "key_", "size", "place_"))
    sources = short.groupBy("source", "key_").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, list(weights), max_epochs, scratch)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = filled(short, targets.drop("source").withColumn("whole", epochs), near, scratch)

    rows = short if narrow else rows
    added = ["source_size", "target", "times", "taken"]
    rows = rows.join(plan, "key_").withColumn("times", F.col("whole") + drawn().cast("long"))
    rows = rows.withColumn("taken", F.col("times") * F.col("size"))
    own = ["doc_id", "source"] if narrow else unpacked(docs.columns, ("size", *added))
    return rows.select(*own, "size", *added)
