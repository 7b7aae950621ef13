"""Merkle manifest of a dataset: an authentication path for every row, and checks of rows against it.

Every row is a leaf, the SHA-256 of its fields. The leaves of a group (``lang``) ascend by doc_id and are hashed up
eight at a time until one node is left, the group's subroot; the subroots, ordered by group, are hashed up likewise to
the root. A row is proved by the other nodes of its runs, from its own run up to the root.

Leaves are numbered over sorted ranges, so no group passes one task. A tree is cut into aligned blocks of 512 leaves
(three levels). Within a block the paths are found by Merkle traversal: each level has one treehash instance, whose
stacks build the level's next run from one new leaf a step, so that a path advances leaf by leaf and nothing is kept
beside the block's digests but a run and a stack a level. The tops of the blocks are the leaves of a tree 512 times
smaller, which is handled in the same way; its paths are shared by all leaves of a block and appended to theirs.

Nulls and ties: a null field is hashed as "-", so it differs from every value; a null lang is a group of its own and
comes first, as null doc_ids do within a group; rows with the same doc_id are ordered by their leaf digest, and equal
rows have equal leaves but a proof each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolark.llm.common import Scratch, bounded_batches

#: Nodes of a run, levels of a block and its leaves.
ARITY, HEIGHT = 8, 3
BLOCK = ARITY**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before: string, after: string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each as "-" or as its length in bytes, a colon and its value."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[said(f.cast("string")) for f in fields]), 256)


def digest(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run)).hexdigest().encode()


class Treehash:
    """Builds the runs of one level from leaves given one by one; keeps at most a run for every level below."""

    def __init__(self, level: int):
        self.stack: list[list[bytes]] = [[] for _ in range(level + 1)]

    def add(self, node: bytes) -> None:
        for run in self.stack[:-1]:
            run.append(node)
            if len(run) < ARITY:
                return
            node = digest(run)
            run.clear()
        self.stack[-1].append(node)

    def take(self) -> list[bytes]:
        """The run so far; a last run below it may be short."""
        carry: list[bytes] = []
        for run in self.stack[:-1]:
            run += carry
            carry = [digest(run)] if run else []
            run.clear()
        out, self.stack[-1] = self.stack[-1] + carry, []
        return out


def levels(n: int) -> int:
    """Rounds of hashing that leave one of n nodes."""
    k = 0
    while ARITY**k < n:
        k += 1
    return k


def block_height(block: int, leaves: int) -> int:
    """Levels of a block: the first may be the whole tree, any other goes up all levels even with one leaf."""
    return HEIGHT if block else levels(leaves)


def top(leaves: list[bytes], height: int) -> bytes:
    if not height:
        return leaves[0]
    tree = Treehash(height - 1)
    for leaf in leaves:
        tree.add(leaf)
    return digest(tree.take())


def traverse(leaves: list[bytes], height: int) -> Iterator[list[tuple[list[bytes], int]]]:
    """For each leaf its path: for each level the run that holds its node, and the node's place there.

    The level's next run is built meanwhile, by one leaf a step, and is ready when the leaf before it has been left.
    """
    spans = [ARITY ** (k + 1) for k in range(height)]
    ahead, runs = [Treehash(k) for k in range(height)], []
    for tree, span in zip(ahead, spans):
        for leaf in leaves[:span]:
            tree.add(leaf)
        runs.append(tree.take())
    for i in range(len(leaves)):
        yield [(run, i * ARITY // span % ARITY) for run, span in zip(runs, spans)]
        for k, span in enumerate(spans):
            if i + span < len(leaves):
                ahead[k].add(leaves[i + span])
            if (i + 1) % span == 0:
                runs[k] = ahead[k].take()


def steps_of(path: list[tuple[list[bytes], int]]) -> list[tuple[bytes, bytes]]:
    """(siblings before, siblings after) of each level."""
    return [(b"".join(run[:at]), b"".join(run[at + 1 :])) for run, at in path]


def fold(leaf: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    for before, after in steps:
        leaf = digest([before, leaf, after])
    return leaf


def numbered(rows: DataFrame, order: list[Column | str], scratch: Scratch) -> DataFrame:
    """rows (tree, ...) with rank, their place within tree in the order (tree first), from 0.

    Ranges are sorted apart; what stands before a range in its tree is summed over a row for each range and tree.
    """
    ranges = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranges = scratch.write(ranges.withColumns({"range_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}))
    counts = ranges.groupBy("tree", "range_").agg(F.count("*").alias("n"), F.min("at_").alias("first_"))
    before = Window.partitionBy("tree").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "range_", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_")).alias("shift_"))
    return ranges.join(starts, ["tree", "range_"]).withColumn("rank", F.col("at_") + F.col("shift_")).drop("range_", "at_", "shift_")


def blocks_of(nodes: DataFrame, *columns: str) -> DataFrame:
    """One row for each aligned block of nodes (tree, rank, ...): tree, block, nodes in order (512 at most)."""
    entry = F.struct("rank", *columns)
    return nodes.groupBy("tree", (F.expr(f"rank div {BLOCK}")).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("nodes"))


def tops(blocks: DataFrame, column: str) -> DataFrame:
    """(tree, rank, node): the top of every block, by treehash alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found.append(top([n.encode() for n in nodes], block_height(block, len(nodes))).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["tree", "rank", "node"])

    return blocks.select("tree", "block", F.col(f"nodes.{column}").alias("nodes")).mapInArrow(run, "tree string, rank long, node string")


def paths_to_top(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, rank, steps, top) of nodes (tree, rank from 0, node): siblings up to the top of the tree, level by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        for batch in batches:
            for tree, block, some in zip(*(batch.column(k).to_pylist() for k in range(3))):
                leaves = [n["node"].encode() for n in some]
                height = block_height(block, len(leaves))
                steps = [[{"before": b.decode(), "after": a.decode()} for b, a in steps_of(path)] for path in traverse(leaves, height)]
                size, above = len(leaves), top(leaves, height).decode()
                columns = [pa.array([tree] * size, pa.string()), pa.array([n["rank"] for n in some], pa.int64()), pa.array(steps, kind), pa.array([block] * size, pa.int64()), pa.array([above] * size, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "rank", "steps", "block", "top"])

    climbed = scratch.write(blocks_of(nodes, "node").mapInArrow(run, f"tree string, rank long, steps {STEPS}, block long, top string"))
    if climbed.where("block > 0").isEmpty():
        return climbed.drop("block")
    above = paths_to_top(climbed.where(f"rank % {BLOCK} = 0").select("tree", F.col("block").alias("rank"), F.col("top").alias("node")), scratch)
    above = above.select("tree", F.col("rank").alias("block"), F.col("steps").alias("more"), F.col("top").alias("last"))
    return climbed.join(above, ["tree", "block"]).select("tree", "rank", F.concat("steps", "more").alias("steps"), F.col("last").alias("top"))


def manifest(docs: DataFrame, shown: Column | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof, folded_root, verified.

    proof: the siblings' digests, level by level from the leaf's run to the root, left to right. shown: the text with
    which a row claims to be in the dataset (its own unless given); folded_root is what the claim and the row's own
    siblings fold to, and verified whether that is the root.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    own = leaf_digest(*[F.col(f) for f in FIELDS])
    claim = own if shown is None else leaf_digest(*[F.col(f) for f in FIELDS[:-1]], F.col("shown_"))
    # A claim equal to the text is hashed once.
    rows = docs.select(*FIELDS) if shown is None else docs.select(*FIELDS, shown.alias("shown_"))
    claimed = F.lit(None).cast("string") if shown is None else F.when(~F.col("text").eqNullSafe(F.col("shown_")), claim)
    tree = F.coalesce(F.concat(F.lit("s"), "lang"), F.lit("n")).alias("tree")  # "n", of null, precedes all others
    leaves = scratch.write(rows.select(F.col("doc_id").cast("long").alias("doc_id"), tree, own.alias("leaf"), claimed.alias("claim")))
    ranked = numbered(leaves, ["doc_id", "leaf"], scratch)
    blocks = scratch.write(blocks_of(ranked, "doc_id", "leaf", "claim"))

    groups = paths_to_top(tops(blocks, "leaf"), scratch)
    subroots = groups.where("rank = 0").select("tree", F.col("top").alias("node"))
    placed = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group_"), "node"), ["group_"], scratch)
    placed = scratch.write(placed)
    roots = paths_to_top(placed.select("tree", "rank", "node"), scratch).join(placed.select("rank", F.col("group_").alias("of_")), "rank")
    roots = roots.select(F.col("of_").alias("tree"), F.col("steps").alias("last_"), F.col("top").alias("root"))
    upper = groups.join(roots, "tree").select("tree", F.col("rank").alias("block"), F.concat("steps", "last_").alias("steps"), F.col("top").alias("subroot"), "root")

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    names = ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, nodes, more, subroot, root in zip(*(batch.column(k).to_pylist() for k in range(5))):
                leaves, out = [n["leaf"].encode() for n in nodes], []
                shared = [(s["before"].encode(), s["after"].encode()) for s in more]
                for node, path in zip(nodes, traverse(leaves, block_height(block, len(leaves)))):
                    steps = steps_of(path) + shared
                    folded = fold((node["claim"] or node["leaf"]).encode(), steps).decode()
                    out.append((node["doc_id"], node["leaf"], subroot, root, b"".join(b + a for b, a in steps).decode(), folded, folded == root))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

    whole = blocks.join(upper, ["tree", "block"]).select("block", "nodes", "steps", "subroot", "root")
    return whole.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")
