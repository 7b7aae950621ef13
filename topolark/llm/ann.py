"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Trees are fitted on a bounded sample: each node splits its points at the median along the line between two of
them. Vectors get one more coordinate that makes all lengths equal, so that the largest inner product is the
smallest distance. Every vector is routed to one leaf of each tree. A query searches all trees through one
priority queue ordered by the least margin on the way, until the leaves it has taken hold a share of all
vectors; that share is calibrated on the sample. The vectors of these leaves, and no others, are its candidates:
queries meet leaves in blocks of bounded size and all products are taken exactly in double precision. The first
leaves of a query are scored first; what the others hand on must reach the last place that these have found.

Equal vectors are indexed once, so that copies neither fill leaves nor multiply candidates; each keeps its
smallest ids, as many as can be asked for.

Nulls and ties: a row with a null id, or a vector that is null, empty, all zero, of another length than most (of
two lengths as frequent, the longer counts), or holds a null or a number that isn't finite takes no part. Ties go
to the smaller id. Rows that repeat both id and vector count once; a query id with several vectors takes the best
score that any of them has. With one row there are no results. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolark.llm.common import Scratch, bounded_batches

TREES = 4
#: Vectors that the forest is fitted on, vectors of a leaf, and rows of either side of a block.
SAMPLE, LEAF, BLOCK = 16384, 256, 8192
#: Share of the true neighbours that calibration on the sample asks for, and the queries it uses.
RECALL, TRIALS = 0.95, 256
#: Part of a query's leaves, by their vectors, that is scored first.
FIRST = 1 / 8


@dataclass
class Forest:
    """Nodes of all trees in one numbering; child >= 0 is a node, otherwise ~child is a leaf, numbered through all trees."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaves: int
    longest: float

    def widen(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0.0))
        return np.column_stack((x, extra))

    def margins(self, wide: np.ndarray) -> np.ndarray:
        return wide @ self.normals.T - self.cuts

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        wide, out = self.widen(x), np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (rows := np.flatnonzero(at >= 0)).size:
                node = at[rows]
                right = (wide[rows] * self.normals[node]).sum(1) > self.cuts[node]
                at[rows] = self.children[node, right.astype(int)]
            out[:, t] = ~at
        return out

    def search(self, margins: np.ndarray, sizes: np.ndarray, enough: float) -> list[int]:
        """Leaves in the order of the shared queue, until they hold enough vectors."""
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        found, held, children = [], 0, self.children
        while queue and held < enough:
            far, node = heapq.heappop(queue)
            if node < 0:
                found.append(~node)
                held += sizes[~node]
                continue
            m = margins[node]
            heapq.heappush(queue, (max(far, -m), int(children[node, 1])))
            heapq.heappush(queue, (max(far, m), int(children[node, 0])))
        return found


def fit(sample: np.ndarray, total: int, longest: float, trees: int, seed: int) -> Forest:
    rng, dims = np.random.default_rng(seed), sample.shape[1] + 1
    normals, cuts, children = [], [], []
    forest = Forest(np.zeros((0, dims)), np.zeros(0), np.zeros((0, 2), np.int64), [], 0, longest)
    wide = forest.widen(sample)
    least = max(8, LEAF * len(sample) // max(total, 1))

    def grow(rows: np.ndarray) -> int:
        for _ in range(3 if len(rows) > least else 0):
            a, b = wide[rng.choice(rows, 2, replace=False)]
            line = a - b if np.any(a != b) else rng.standard_normal(dims)
            line = line / np.linalg.norm(line)
            along = wide[rows] @ line
            cut = float(np.median(along))
            right = along > cut
            if 0 < right.sum() < len(rows):
                node = len(cuts)
                normals.append(line), cuts.append(cut), children.append([0, 0])
                children[node] = [grow(rows[~right]), grow(rows[right])]
                return node
        forest.leaves += 1
        return ~(forest.leaves - 1)

    forest.roots = [grow(np.arange(len(wide))) for _ in range(trees)]
    if cuts:
        forest.normals, forest.cuts, forest.children = np.array(normals), np.array(cuts), np.array(children)
    return forest


def calibrated(forest: Forest, sample: np.ndarray, k: int) -> float:
    """Share of all vectors that a search must take to find enough of the true neighbours of sample vectors."""
    routed, needs = forest.route(sample), []
    sizes = np.bincount(routed.ravel(), minlength=forest.leaves)
    trial = sample[: min(TRIALS, len(sample))]
    truth = np.argsort(-(trial @ sample.T), axis=1, kind="stable")[:, : k + 1]
    for true, margins in zip(truth, forest.margins(forest.widen(trial, query=True))):
        order = np.array(forest.search(margins, sizes, np.inf))
        held = np.empty(forest.leaves)
        held[order] = np.cumsum(sizes[order]) - sizes[order]  # taken as long as less than enough is held
        needs.append(held[routed[true]].min(1))
    return (float(np.quantile(np.concatenate(needs), RECALL, method="higher")) + 1) / len(sample)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    return rows.where(F.size("embedding") == F.lit(usual.dims)) if usual else rows.limit(0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def plain(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def cut_to_best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: largest score, then smallest id. Ids met in several trees count once."""
    order = np.lexsort((ids, -scores, q))
    order = order[(np.diff(q[order], prepend=-1) != 0) | (np.diff(ids[order], prepend=0) != 0)]
    starts = np.flatnonzero(np.diff(q[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[rank < k]


def scored(left: pa.Table, right: pa.Table, k: int, longest: float) -> pa.Table:
    """(query_id, rep, score) of a block's queries with the vectors of the leaves that they ask for, k each at most."""
    reps, leaf, x = plain(right.column("rep")), plain(right.column("leaf")), matrix(right.column("embedding"))
    ids, least, asked = plain(left.column("query_id")), plain(left.column("least")), left.column("leaves").combine_chunks()
    rows_of = {int(f): np.flatnonzero(leaf == f) for f in np.unique(leaf)}
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(ids), 512):
        some, q = asked.slice(at, 512), matrix(left.column("embedding").slice(at, 512))
        # Products of a block and of a pair may differ by rounding, which grows with the lengths.
        slack = 1e-15 * q.shape[1] * longest * np.sqrt((q * q).sum(1))
        floor = least[at : at + 512] - slack
        owner = np.repeat(np.arange(len(some)), some.value_lengths().to_numpy(zero_copy_only=False))
        wanted = some.flatten().to_numpy(zero_copy_only=False)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for f, rows in rows_of.items():
            who = owner[wanted == f]
            if not len(who):
                continue
            products = q[who] @ x[rows].T
            bound = floor[who]
            if len(rows) > k:
                bound = np.maximum(bound, np.partition(products, -k, axis=1)[:, -k] - 2 * slack[who])
            i, j = np.nonzero(products >= bound[:, None])
            i, j = who[i], rows[j]
            found.append((i, reps[j], (q[i] * x[j]).sum(1)))  # each product summed the same way
        i, rep, score = map(np.concatenate, zip(*found))
        best = cut_to_best(i, rep, score, k)
        out.append((ids[at + i[best]], rep[best], score[best]))
    return pa.table(dict(zip(("query_id", "rep", "score"), map(np.concatenate, zip(*out)))))


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found for each query row."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    rows = scratch.write(usable(vectors).withColumn("asks", F.coalesce(is_query, F.lit(False))))
    copies = Window.partitionBy("embedding")
    members = rows.withColumn("n", F.row_number().over(copies.orderBy("vec_id"))).where(f"n <= {k + 1}")
    members = scratch.write(members.withColumn("rep", F.min("vec_id").over(copies)).select("rep", "vec_id", "embedding").dropDuplicates(["rep", "vec_id"]))
    index = members.where("vec_id = rep").select("rep", "embedding")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    total, longest = index.agg(F.count("*"), F.max(length)).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = index.orderBy(F.xxhash64(F.lit(seed), "rep"), "rep").limit(SAMPLE).toArrow()  # at most SAMPLE vectors
    sample = matrix(drawn.column("embedding"))
    forest = fit(sample, total, longest, trees, seed)
    share = calibrated(forest, sample, k)
    shared = spark.sparkContext.broadcast(vars(forest))  # nodes of the trees over SAMPLE points

    kind = dict(index.dtypes)["embedding"]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_ = Forest(**shared.value)
        for batch in batches:
            if batch.num_rows:
                leaf = trees_.route(matrix(batch.column(1)))
                for t in range(leaf.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[:, t].astype(np.int32)), *batch.columns], ["leaf", "rep", "embedding"])

    placed = scratch.write(index.mapInArrow(routed, f"leaf int, rep long, embedding {kind}"))
    sizes = np.zeros(forest.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a row for each leaf of the forest
        sizes[r.leaf] = r["count"]
    # Leaves that follow one another share a block as long as it stays small; a leaf beyond a block is cut in parts.
    block_of, held = np.zeros(forest.leaves, np.int32), 0
    for leaf in range(1, forest.leaves):
        held += sizes[leaf - 1]
        new = held + sizes[leaf] > BLOCK
        block_of[leaf], held = block_of[leaf - 1] + new, 0 if new else held
    plan = spark.sparkContext.broadcast((sizes, block_of, share * total))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (held, blocks, enough), trees_ = plan.value, Forest(**shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                owner, block, first, leaves = [], [], [], []
                for i, m in enumerate(trees_.margins(trees_.widen(matrix(some.column(1)), query=True))):
                    taken = np.array(trees_.search(m, held, enough))
                    early = np.cumsum(held[taken]) - held[taken] < FIRST * enough
                    for part in (True, False):
                        mine = np.sort(taken[early == part])
                        for b in np.split(mine, np.flatnonzero(np.diff(blocks[mine])) + 1) if len(mine) else ():
                            owner.append(i), block.append(blocks[b[0]]), first.append(part), leaves.append(b)
                columns = some.take(pa.array(owner, pa.int32())).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(block, pa.int32()), pa.array(first, pa.bool_()), pa.array(leaves, pa.list_(pa.int32()))], ["query_id", "embedding", "block", "early", "leaves"])

    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    probes = scratch.write(asked.mapInArrow(searched, f"query_id long, embedding {kind}, block int, early boolean, leaves array<int>"))
    block_rows = np.bincount(block_of, sizes)
    parts = spark.createDataFrame([(b, max(1, -(-int(n) // BLOCK))) for b, n in enumerate(block_rows)], "block int, parts int")
    leaf_block = F.broadcast(spark.createDataFrame(list(enumerate(block_of.tolist())), "leaf int, block int").join(parts, "block"))  # a row for each leaf
    there = placed.join(leaf_block, "leaf")

    def met(some: DataFrame) -> DataFrame:
        """(query_id, rep, score) of probes with their leaves, dealt in blocks of bounded size."""
        cuts = some.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts")).collect()  # a row for each block
        cuts = F.broadcast(spark.createDataFrame([tuple(r) for r in cuts], "block int, cuts int"))
        key = ["block", "part", "cut"]
        x = there.join(cuts, "block").withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        q = some.join(F.broadcast(parts), "block").join(cuts, "block").withColumn("cut", F.pmod(F.xxhash64("query_id"), "cuts").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pairs = q.select(*key, "query_id", "embedding", "leaves", "least").groupBy(*key).cogroup(x.select(*key, "leaf", "rep", "embedding").groupBy(*key))
        return pairs.applyInArrow(lambda left, right: scored(left, right, k + 1, longest), "query_id long, rep long, score double")

    top = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    none = F.lit(float("-inf"))
    early = met(probes.where("early").withColumn("least", none)).groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    early = scratch.write(early.withColumn("n", top(F.desc("score"), "rep")).where(f"n <= {k + 1}"))
    last = early.where(f"n = {k + 1}").select("query_id", F.col("score").alias("last"))
    late = met(probes.where("not early").join(last, "query_id", "left").withColumn("least", F.coalesce("last", none)))
    found = early.drop("n").unionByName(late).groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    found = found.withColumn("n", top(F.desc("score"), "rep")).where(f"n <= {k + 1}")
    each = found.join(members.select("rep", "vec_id"), "rep").where("vec_id <> query_id")
    each = each.withColumn("rank", top(F.desc("score"), "vec_id")).where(f"rank <= {k}")
    return each.select("query_id", "rank", "vec_id", "score")
