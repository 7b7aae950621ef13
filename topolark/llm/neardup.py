"""SimHash near-dedup at a Jaccard similarity of word shingles, complete where Hamming balls can't reach.

Documents are sets of hashed shingles. Sets with a Jaccard similarity of ``least`` or more are linked, and one
document of each connected component stays. Equal sets are one node. Sets of similarity 0.8 differ by about ten and
up to some fourteen bits of their SimHash, which is too far for the balls of multi-index hashing; so the links
within ``simhash.hamming_links()``'s few bits come first, and what they leave out is found by common shingles:

1. By hash order, only sets stay that share enough of their leading members with other sets (``enough``): sets with m
   members or more in common share at least k of the first n - m + k members of each, in any order common to all.
2. Of the nodes left, fingerprints within a few bits are looked up by multi-index hashing; each node is compared with
   the one of its neighbours that has most members in common with other sets.
3. By rising frequency among the nodes left, so that common passages come last, candidates are nodes with a common
   member among the first n - ceil(least * n) + 1. Each is first compared with the best such node of each member, then
   with those that are still in another component; the complete fingerprints of both must be within REACH bits and
   the sketches of their sets alike, which the join itself decides.

So a large group of copies makes no square of pairs. Links are verified on the whole sets.

Nulls and ties: a null text counts as empty, and texts without a word are one class; a text shorter than a shingle
is one shingle. Of a class, drop_similar() keeps what simhash.keep_one_of_each() keeps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topolark.llm.common import Scratch, bounded_batches
from topolark.llm.simhash import components, hamming_links, keep_one_of_each, majority, shingle_hashes

#: Room for rounding in bounds on candidates; links are decided without it.
SLACK = 1e-9

#: Least hashes of a set that its sketch holds: so many, or this part of them if that is more.
SKETCH, SKETCH_PART = 512, 4


def enough(n: int, least: float) -> int:
    """Leading members of step 1 that sets of n members or more share at least: about a tenth of n for 0.8."""
    return max(1, math.floor(n * (1 - least) / 2))


def least_common(n: int, least: float) -> int:
    """Members that a set of n members has in common with any that it is linked to, and size of these, at least."""
    return math.ceil(n * least - SLACK)


def shingle_sets(docs: DataFrame, shingle: int = 5, seed: int = 42, leading: float | None = None) -> DataFrame:
    """(doc_id, text_hash, node, n, needed, fp, members): node is the hash of the whole set, n its size, fp the SimHash.

    leading: a similarity; members are then only those that step 1 compares, of which ``needed`` must be shared.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [list(shingle_hashes(t.as_py(), shingle, seed)) for t in batch.column(2)]
            fps = np.zeros(len(chunks), np.int64) if leading is not None else np.array([majority(c) for c in chunks], np.uint64).view(np.int64)
            sets = [np.unique(np.concatenate(c)).view(np.int64) if c else np.empty(0, np.int64) for c in chunks]
            nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets), np.uint64, len(sets)).view(np.int64)
            sizes, needed = np.fromiter(map(len, sets), np.int32, len(sets)), np.ones(len(sets), np.int32)
            if leading is not None:
                needed = np.array([enough(least_common(n, leading), leading) for n in sizes.tolist()], np.int32)
                sets = [s[: len(s) - least_common(len(s), leading) + enough(len(s), leading)] for s in sets]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            members = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
            columns = [batch.column(0), batch.column(1), *map(pa.array, (nodes, sizes, needed, fps)), members]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "n", "needed", "fp", "members"])

    return narrow.mapInArrow(hashed, "doc_id long, text_hash long, node long, n int, needed int, fp long, members array<long>")


def prefix_size(least: float):
    return (F.col("n") - F.ceil(F.col("n") * F.lit(least) - SLACK) + 1).cast("int")


def sharing(leading: DataFrame) -> DataFrame:
    """Nodes that share as many of their leading members with other nodes as a link needs."""
    rows = leading.select("node", "needed", F.explode("members").alias("key"))
    ends = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = rows.join(ends.where("low <> high").select("key"), "key")
    counts = shared.groupBy("node", "key").agg(F.first("needed").alias("needed")).groupBy("node").agg(F.count("*").alias("found"), F.first("needed").alias("needed"))
    return counts.where("found >= needed").select("node")


def rare_members(alive: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(node, n, fp, share, prefix): the prefix of members by rising frequency, without those of one node only.

    share: the part of the node's members that other nodes have too.
    """
    rows = alive.select("node", "n", "fp", F.explode("members").alias("key"))
    often = scratch.write(rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    known = rows.join(often, "key").groupBy("node", "n", "fp").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("m"))
    rest = F.greatest(prefix_size(least) - (F.col("n") - F.size("m")), F.lit(0))
    return known.select("node", "n", "fp", (F.size("m") / F.col("n")).alias("share"), F.transform(F.slice("m", F.lit(1), rest), lambda e: e.key).alias("prefix"))


def alike(pairs: DataFrame, alive: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of ``least`` or more."""
    left = alive.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    right = alive.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ma", "mb")))
    return both.where(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")) >= least).select("a", "b")


def near_fingerprints(rare: DataFrame, max_bits: int) -> DataFrame:
    """(node, other): each node with the best supported node among those whose fingerprints are within max_bits bits."""
    support = F.struct("share", "n", "node")
    of_fp = rare.groupBy("fp").agg(F.max(support).alias("best"))
    links = hamming_links(of_fp.select("fp"), max_bits)
    both = links.select(F.col("a").alias("fp"), F.col("b").alias("near")).union(links.select("b", "a")).union(of_fp.select("fp", "fp"))
    near = both.join(of_fp.select(F.col("fp").alias("near"), "best"), "near").groupBy("fp").agg(F.max("best").alias("best"))
    return rare.select("node", "fp").join(near, "fp").select("node", F.col("best.node").alias("other"))


def similar_links(alive: DataFrame, least: float, max_bits: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between the nodes, whose components are those of all pairs with that similarity."""
    rare = scratch.write(rare_members(alive, least, scratch))

    def fits(a: str, b: str):
        return F.least(f"{a}n", f"{b}n") >= F.greatest(f"{a}n", f"{b}n") * F.lit(least) - SLACK

    def pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
        return rows.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    by_key = rare.select("node", "n", "share", F.explode("prefix").alias("key"))
    best = by_key.groupBy("key").agg(F.max(F.struct("share", "n", "node")).alias("h"), F.min("node").alias("low"), F.max("node").alias("high"))
    best = best.where("low <> high").select("key", F.col("h.node").alias("h_node"), F.col("h.n").alias("h_n"))
    star = by_key.drop("share").join(best, "key").where(fits("", "h_"))
    first = pairs(near_fingerprints(rare, max_bits), "node", "other").union(pairs(star, "node", "h_node")).distinct()
    links = scratch.write(alike(first, alive, least))

    # What still lies in several components is compared inside the join, by the sketches of both sets. A pair that
    # shares several members meets at the first of them only.
    left = mixed(by_key.drop("share"), components(links, scratch), scratch)
    keys = left.groupBy("node", "n", "root").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    size = F.greatest(F.lit(SKETCH), F.ceil(F.col("n") / SKETCH_PART).cast("int"))
    sketches = alive.select("node", F.slice(F.sort_array("members"), F.lit(1), size).alias("sketch"))
    left = keys.join(sketches, "node").select("*", F.explode("keys").alias("key"))
    x, y = (left.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "n", "root", "keys", "sketch")]) for p in "xy")
    at = F.get(F.array_intersect("x_keys", "y_keys"), F.lit(0))
    # Up to the end of the shorter sketch both sets are known; what differs there differs in the whole.
    last = F.least(*[F.when(F.col(f"{p}_n") > F.size(f"{p}_sketch"), F.element_at(f"{p}_sketch", -1)).otherwise((1 << 63) - 1) for p in "xy"])
    common, every = (F.size(F.filter(f("x_sketch", "y_sketch"), lambda m: m <= last)) for f in (F.array_intersect, F.array_union))
    close = every - common <= (F.col("x_n") + F.col("y_n")) * F.lit((1 - least) / (1 + least)) + SLACK
    met = x.join(y, (x.key == y.key) & (F.col("x_root") < F.col("y_root")) & fits("x_", "y_") & (at == x.key) & close)
    return links.union(scratch.write(alike(pairs(met, "x_node", "y_node"), alive, least)))


def mixed(by_key: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (node, key) of members that nodes of several components have, with root."""
    homed = by_key.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = homed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return scratch.write(homed.join(ends.where("low <> high").select("key"), "key").select(*by_key.columns, "root"))


def similar_classes(docs: DataFrame, least: float = 0.8, shingle: int = 5, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """One row for each document: doc_id, text_hash and root, the node that names its class."""
    scratch = Scratch(docs.sparkSession)
    leading = scratch.write(shingle_sets(docs, shingle, seed, leading=least))
    narrow = scratch.write(leading.select("doc_id", "text_hash", "node"))
    nodes = scratch.write(sharing(leading))
    scratch.drop(leading)
    texts = scratch.write(narrow.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("own_hash")).select("own_hash"))
    again = docs.select("doc_id", "text").join(texts, F.xxhash64("text") == F.col("own_hash"), "left_semi")
    alive = scratch.write(shingle_sets(again, shingle, seed).select("node", "n", "fp", "members").dropDuplicates(["node"]))
    links = similar_links(alive, least, max_bits, scratch)
    roots = scratch.write(components(links, scratch))
    return narrow.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def drop_similar(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents without all but one of each class; all columns are kept."""
    return keep_one_of_each(docs, similar_classes(docs, least))
