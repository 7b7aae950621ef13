"""Alignment of two tokenizers over a corpus: each distinct segment is encoded and aligned once.

A text, with a space in front, is cut before white space that follows something else, where neither vocabulary can
join the two sides: the byte-level one (A) never goes on from non-white-space into white space, and for the other
(B) the whole vocabulary is searched for pieces in which a character stands before a space or new line; behind such
characters, if there are any, no cut is made. Merges left and right of a cut then can't meet, so the ids of a text are
those of its segments in order, and as both vocabularies end a token at every cut, groups and links never span one.

Work goes in blocks of some 32 MB of text, each cut in one go. A block writes the distinct segments that it holds, with
their numbers of occurrences, and each text as a sequence of places in that list; texts go no further. The rows of a
segment come together from all blocks, and it is encoded and aligned once; the counts of id pairs follow from the
segments' own links times their occurrences. What a block needs of its segments is put together by block before it goes
back to it, and documents are composed block by block.

Texts null or empty, and those that B doesn't give back whole (they hold U+2581), have no tokens, and count nowhere.
Nulls and ties: every row is composed for itself, so repeated rows and null doc_ids keep their rows. An empty table
gives an empty result. Other columns are ignored. A text without spaces is one segment, whatever its length.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topolark.llm.common import Scratch, bounded_batches, squeezed, unsqueezed

#: Characters of text of a block, places that a task puts together at once, and id pairs whose counts are broadcast (17 bytes each).
BLOCK, PARCEL_ROWS, MOST_PAIRS = 32 << 20, 1 << 18, 1 << 22
SPACE = "▁"


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: itself if printable, else signs from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, the bytes of their ids and the places where texts may be cut."""

    def __init__(self, first: str, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(first), SentencePieceProcessor(model_proto=second)
        self.a.encode_special_tokens = True
        signs = byte_signs()
        self.a_bytes = {i: bytes(map(signs.__getitem__, piece)) for piece, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        whole = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        joined = {p[k - 1] for p in whole for k in range(1, len(p)) if p[k] in f"{SPACE}\n " and p[k - 1] not in f"{SPACE}\n "}
        held = "".join(map(re.escape, sorted(joined)))
        # A segment that starts with a new line is encoded behind B's own space, which must not join it.
        heads = " " if any(f"{SPACE}\n" in p for p in whole) else " \n"
        stays = rf"(?![{heads}])" + (f"|(?<=[{held}])" if held else "")
        self.segment = re.compile(rf"\s*\S+(?:(?:{stays})\s+\S*)*|\s+")
        if self.a.normalizer is not None or not self.b.id_to_piece(self.b.encode("\n")[0]) == SPACE:
            raise ValueError("the first vocabulary must not normalize, the second must add a space")

    def segments(self, text: str) -> list[str]:
        """The segments of a text with a space in front; none if B doesn't give the text back."""
        if not text or SPACE in text or self.b.normalize(text) != SPACE + text.replace(" ", SPACE):
            return []
        return self.segment.findall(" " + text)

    def encode(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """(ids of A, ids of B) of each segment."""
        a = self.a.encode_batch_fast(segments, add_special_tokens=False)
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for segment, one, two in zip(segments, a, b):
            if segment == " ":  # B adds no space to nothing
                two = [self.b.piece_to_id(SPACE)]
            yield one.ids, two if segment[0] == " " else two[1:]


def align(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int]) -> tuple[list[tuple[int, int]], list[tuple[list[int], list[int]]]]:
    """(links, groups) of two token sequences over the same bytes."""
    links, groups = [], []
    i = j = 0
    end_a, end_b, left, right = a_sizes[0], b_sizes[0], 0, 0
    while True:
        links.append((a[i], b[j]))
        if end_a == end_b:
            i, j = i + 1, j + 1
            groups.append((a[left:i], b[right:j]))
            if i == len(a) or j == len(b):
                if i != len(a) or j != len(b):
                    raise ValueError("tokens of different bytes")
                return links, groups
            left, right = i, j
            end_a, end_b = end_a + a_sizes[i], end_b + b_sizes[j]
        elif end_a < end_b:
            i += 1
            end_a += a_sizes[i]
        else:
            j += 1
            end_b += b_sizes[j]


def said(groups: list[tuple[list[int], list[int]]]) -> str:
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


PARTS = "block long, doc_id long, n_places long, places binary, place int, segment string, n long"
PART_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int64())


def cut(docs: DataFrame, shared) -> DataFrame:
    """Rows of two kinds: documents (block, doc_id, n_places, places), and a block's segments (block, place, segment, n)."""
    names = [p.split()[0] for p in PARTS.split(", ")]

    def rows(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(names, PART_KINDS)], names)

    def block_rows(block: int, ids: list, texts: list[np.ndarray], known: dict[str, int]) -> Iterator[pa.RecordBatch]:
        counts = np.bincount(np.concatenate(texts), minlength=len(known)) if known else np.zeros(0, np.int64)
        segments = list(known)
        for k in range(0, len(ids), 1000):
            some = texts[k : k + 1000]
            yield rows(block=[block] * len(some), doc_id=ids[k : k + 1000], n_places=[len(t) for t in some], places=[squeezed(t) for t in some])
        for k in range(0, len(segments), 20_000):
            some = segments[k : k + 20_000]
            yield rows(block=[block] * len(some), place=np.arange(k, k + len(some), dtype=np.int32), segment=some, n=counts[k : k + len(some)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = None, TaskContext.get().partitionId() << 32
        ids, texts, known, held = [], [], {}, 0
        for batch in batches:
            words = words or Vocabularies(*shared.value)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words.segments(text or "")
                places = np.fromiter((known.setdefault(s, len(known)) for s in found), np.uint32, len(found))
                ids.append(doc_id), texts.append(places)
                held += len(text or "")
                if held >= BLOCK:
                    yield from block_rows(block, ids, texts, known)
                    block, ids, texts, known, held = block + 1, [], [], {}, 0
        if ids:
            yield from block_rows(block, ids, texts, known)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PARTS)


def pieces(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of an array of lists."""
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


ALIGNED = "n long, n_a int, n_b int, n_groups int, groups string, links_a array<int>, links_b array<int>, blocks array<long>, places array<int>"


def aligned(held: DataFrame, shared) -> DataFrame:
    """Rows of each distinct segment: its occurrences n, alignment, and the blocks and places of their lists that hold it.

    held: segment, block, place, n, the rows of a segment together. A segment is encoded when it first comes; one with
    more rows than a batch goes on in a further row with the same alignment, so a row is bounded.
    """
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    words_of = lambda parts: pa.array([said(p) for p in parts], pa.string())

    def one(words: Vocabularies, segment: str, a: list[int], b: list[int]) -> tuple:
        raw = segment.encode()
        if b"".join(map(words.a_bytes.__getitem__, a)) != raw or b"".join(map(words.b_bytes.__getitem__, b)) != raw:
            raise ValueError(f"a vocabulary doesn't give back {segment[:80]!r}")
        return a, b, *align(a, b, [len(words.a_bytes[i]) for i in a], [len(words.b_bytes[i]) for i in b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, found = None, None, None
        for batch in batches:
            words = words or Vocabularies(*shared.value)
            segments = batch.column(0)
            starts = np.flatnonzero(np.concatenate(([True], pc.not_equal(segments[1:], segments[:-1]).to_numpy(zero_copy_only=False))))
            some = segments.take(pa.array(starts)).to_pylist()
            rows = [found] if some[0] == last else []
            fresh = some[len(rows) :]
            rows += [one(words, s, a, b) for s, (a, b) in zip(fresh, words.encode(fresh))]
            last, found = some[-1], rows[-1]
            ends = pa.array(np.append(starts, batch.num_rows), pa.int32())
            links = pa.array(np.cumsum([0, *(len(r[2]) for r in rows)]), pa.int32())
            flat = np.fromiter(chain.from_iterable(chain.from_iterable(r[2] for r in rows)), np.int32).reshape(-1, 2)
            columns = [pa.array(np.add.reduceat(batch.column(3).to_numpy(), starts), pa.int64()), *(pa.array([len(r[k]) for r in rows], pa.int32()) for k in (0, 1, 3)), words_of(r[3] for r in rows)]
            columns += [pa.ListArray.from_arrays(links, pa.array(np.ascontiguousarray(flat[:, k]))) for k in (0, 1)] + [pa.ListArray.from_arrays(ends, batch.column(k)) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, names)

    together = held.select("segment", "block", "place", "n").repartition("segment").sortWithinPartitions("segment")
    return together.mapInArrow(run, ALIGNED)


def pair_counts(known: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold each pair, and whether that is the most of any pair with its b."""
    links = known.select("n", F.explode(F.arrays_zip("links_a", "links_b")).alias("l"))
    counts = links.groupBy(F.col("l.links_a").alias("a"), F.col("l.links_b").alias("b")).agg(F.sum("n").alias("count"))
    return counts.join(counts.groupBy("b").agg(F.max("count").alias("most")), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(known: DataFrame, counts: DataFrame) -> DataFrame:
    """known (key, ...) with n_best and count_sum, by joins on the pairs."""
    links = known.select("key", F.explode(F.arrays_zip("links_a", "links_b")).alias("l")).select("key", F.col("l.links_a").alias("a"), F.col("l.links_b").alias("b"))
    sums = links.join(counts, ["a", "b"]).groupBy("key").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    return known.join(sums, "key")


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
PARCEL = "block long, rows int, figures binary, size int, groups binary"


def parcels(known: DataFrame, counts: DataFrame | None) -> DataFrame:
    """What each block needs of the segments, put together by block before it travels: places, figures and groups.

    counts: pair_counts() small enough for a broadcast; without it known has n_best and count_sum.
    """
    shared = None
    if counts is not None:
        table = counts.select(F.expr("shiftleft(cast(a as bigint), 32) + b").alias("pair"), "count", "best").toArrow().sort_by("pair")
        shared = known.sparkSession.sparkContext.broadcast([table.column(k).to_numpy() for k in range(3)])  # MOST_PAIRS rows at most
    columns = ["n_a", "n_b", "n_groups", "groups", "links_a", "links_b", "blocks", "places"] + ([] if shared else ["n_best", "count_sum"])

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        block, numbers = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)
        groups = pa.concat_arrays([h[2] for h in held])
        order, out = np.argsort(block, kind="stable"), []
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for some in np.split(order, cuts):
            text = "\n".join(groups.take(pa.array(some)).to_pylist()).encode()
            out.append((int(block[some[0]]), len(some), squeezed(numbers[:, some].ravel()), len(text), pa.compress(text, codec="zstd", asbytes=True)))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], [c.split()[0] for c in PARCEL.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            of = {c: batch.column(k) for k, c in enumerate(columns)}
            (a, cuts), (b, _) = pieces(of["links_a"]), pieces(of["links_b"])
            if shared:
                pairs, count, best = shared.value
                at = np.searchsorted(pairs, (a.astype(np.int64) << 32) + b)
                n_best, total = np.add.reduceat(best[at].astype(np.int64), cuts[:-1]), np.add.reduceat(count[at], cuts[:-1])
            else:
                n_best, total = of["n_best"].to_numpy(), of["count_sum"].to_numpy()
            (block, ends), (place, _) = pieces(of["blocks"]), pieces(of["places"])
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            figures = [*(of[c].to_numpy() for c in FIGURES[:3]), np.diff(cuts), n_best, total & 0xFFFFFFFF, total >> 32]
            held.append((block, np.stack([place, *(f[row] for f in figures)]).astype(np.uint32), of["groups"].take(pa.array(row))))
            size += len(row)
            if size >= PARCEL_ROWS:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    return known.select(*columns).mapInArrow(run, PARCEL)


def compose(key, docs: pa.Table, sent: pa.Table) -> pa.Table:
    """The documents of one block from its parcels."""
    rows = sent.column("rows").to_pylist()
    sums, groups = np.zeros((len(FIGURES), sum(rows)), np.int64), np.empty(sum(rows), object)
    for n, figures, size, text in zip(rows, *(sent.column(c).to_pylist() for c in ("figures", "size", "groups"))):
        numbers = unsqueezed(figures, 8 * n).reshape(8, n).astype(np.int64)
        sums[:, numbers[0]] = np.concatenate((numbers[1:6], numbers[6:7] + (numbers[7:] << 32)))
        groups[numbers[0]] = pa.decompress(text, size, codec="zstd", asbytes=True).split(b"\n")
    out = []
    for doc_id, n, blob in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "n_places", "places"))):
        at = unsqueezed(blob, n) if n else np.zeros(0, np.uint32)
        digest = hashlib.sha256(b";".join(groups[at].tolist())).hexdigest() if n else ""
        out.append((doc_id, *(int(s[at].sum()) if n else 0 for s in sums), digest))
    kinds = [pa.int64()] * 7 + [pa.string()]
    return pa.Table.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["doc_id", *FIGURES, "groups_sha256"])


def align_documents(docs: DataFrame, first: str, second: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    first: path of the byte-level vocabulary A, second: of the sentence-piece model B; both are read on the driver. Counts
    of up to most_pairs id pairs are looked up, more are joined, with the same result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((Path(first).read_text(), Path(second).read_bytes()))  # public vocabularies, a few MB
    parts = scratch.write(cut(docs, shared))
    texts = parts.where("segment is null").select("block", "doc_id", "n_places", "places")
    known = scratch.write(aligned(parts.where("segment is not null"), shared).withColumn("key", F.monotonically_increasing_id()))
    counts = scratch.write(pair_counts(known))
    few = counts.count() <= most_pairs
    sent = parcels(known, counts) if few else parcels(scored(known, counts), None)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in FIGURES) + ", groups_sha256 string"
    return texts.groupBy("block").cogroup(sent.select(F.col("block").alias("home"), "rows", "figures", "size", "groups").groupBy("home")).applyInArrow(compose, schema)
