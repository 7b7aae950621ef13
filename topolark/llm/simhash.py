"""SimHash near-dedup by multi-index hashing.

A document's fingerprint is the bitwise majority of its shingles' 64-bit hashes. Fingerprints within
``max_bits`` differing bits are linked. Candidate pairs come from multi-index hashing: the 64 bits are
cut into segments, a table holds every distinct fingerprint under each of its segment values, and each
fingerprint looks up the small Hamming ball around each of its segment values. The radii r_i of the
balls satisfy sum(r_i + 1) > max_bits, so by the pigeonhole principle no link is missed. Complete
distances are verified inside the join, so only true links leave it. Links run between distinct
fingerprints, never between copies; classes are the connected components, found by alternating
large-star and small-star rounds over tables in the shared folder.

Nulls and ties: a null text counts as empty; texts without a word have fingerprint zero and link like any
other; repeated rows stay repeated, a null doc_id gets a row but never names a class unless no member has an
id (then component_id is null). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topolark.functions.components import components
from topolark.llm.common import Scratch, bounded_batches, packed, unpacked

#: Bytes of A-Z lower-cased; bytes of other characters stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Shingles hashed at a time, which bounds the memory that a very long text takes.
CHUNK = 1 << 16

#: Up to so many distinct fingerprints three segments are used, beyond it two. Either finds every link.
THREE_SEGMENTS_MOST = 1 << 26


def shingle_hashes(text: bytes | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a UTF-8 text, repeats included, CHUNK of them at a time."""
    words = (text or b"").translate(LOWER).split()  # bytes.split() knows space and \x09-\x0d only
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), CHUNK):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])], np.uint64)


def majority(chunks: Iterable[np.ndarray]) -> int:
    """Unsigned 64-bit number whose bits are those set in over half of all hashes."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in chunks:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): a narrow row for each document; fp is the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return narrow.mapInArrow(hashed, "doc_id long, text_hash long, fp long")


def segment_plan(max_bits: int, segments: int) -> list[tuple[int, int, int]]:
    """(offset, width, radius) of each segment; radii are as small as the pigeonhole principle allows."""
    spare = max_bits + 1 - segments
    if spare < 0:
        segments, spare = max_bits + 1, 0
    plan, offset = [], 0
    for k in range(segments):
        width = 64 // segments + (k < 64 % segments)
        plan.append((offset, width, spare // segments + (k < spare % segments)))
        offset += width
    return plan


def ball(width: int, radius: int) -> list[int]:
    """Masks with at most so many of so many bits set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def hamming_links(fps: DataFrame, max_bits: int = 4, segments: int = 3) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct fingerprints ``fps.fp`` within max_bits bits."""
    plan = segment_plan(max_bits, segments)

    def value(offset: int, width: int):
        return F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))

    def key(k: int, v):
        return v * len(plan) + k  # segments are under 62 bits wide

    table = fps.select(F.explode(F.array(*[key(k, value(o, w)) for k, (o, w, _) in enumerate(plan)])).alias("seg"), F.col("fp").alias("b"))

    def around(k: int, offset: int, width: int, radius: int):
        masks = F.array(*[F.lit(m).cast("long") for m in ball(width, radius)])
        return F.transform(masks, lambda mask: key(k, value(offset, width).bitwiseXOR(mask)))

    probe = fps.select(F.explode(F.concat(*[around(k, *segment) for k, segment in enumerate(plan)])).alias("seg"), F.col("fp").alias("a"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return probe.join(table.hint("merge"), (probe.seg == table.seg) & near).select("a", "b")


def near_duplicate_classes(docs: DataFrame, max_bits: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """One row for each document: doc_id, text_hash, fp, root (of the class) and component_id."""
    scratch = Scratch(docs.sparkSession)
    narrow = scratch.write(fingerprints(docs, shingle, seed))
    fps = scratch.write(narrow.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    segments = 3 if fps.count() <= THREE_SEGMENTS_MOST else 2
    roots = components(hamming_links(fps.select("fp"), max_bits, segments), scratch)
    classed = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = classed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = scratch.write(classed.join(ids, "root").select("fp", "root", "component_id"))
    return narrow.join(of, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents that stay, by the root of each (doc_id, text_hash): of a class the smallest doc_id.

    A null doc_id stays only if no member of the class has an id; among equal ids the text with the smallest
    hash stays; of repeated rows one stays. All columns are kept. Texts are dealt once, by id and hash.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    own = ["id_", "text_hash_"]
    name = lambda doc_id: F.coalesce(doc_id.cast("string"), F.lit("none"))
    kept = classes.groupBy("root").agg(F.min(order).alias("k")).select(name(F.col("k.doc_id")).alias("id_"), F.col("k.text_hash").alias("text_hash_"))
    keyed = packed(docs, name(F.col("doc_id")).alias("id_"), F.xxhash64("text").alias("text_hash_"))
    return keyed.join(kept, own, "left_semi").dropDuplicates(own).select(*unpacked(docs.columns))


def drop_near_duplicates(docs: DataFrame, max_bits: int = 4) -> DataFrame:
    """The documents without all but one of each class, as keep_one_of_each() chooses."""
    return keep_one_of_each(docs, near_duplicate_classes(docs, max_bits))
