"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and every run of other signs than letters and digits becomes one space. An item of m
characters may occur with up to k = floor(error_rate * m) edits. It is split into k + 1 pieces, one of which
must occur exactly wherever the item does; an Aho-Corasick automaton finds all pieces of all items in one
pass over a whole text, and Myers' bit-parallel algorithm verifies the edit distance around each hit.

Items are taken in blocks of bounded size, each broadcast as an automaton's input. A benchmark beyond one block
takes a pass over the texts for each, written to the shared folder, so that a worker holds one automaton at a time.
Nothing is shuffled, and long texts cost time in proportion to their length.

Nulls and ties: a null or empty text or item matches nothing; items too short for an edit must occur as whole
words; items with equal text are all reported; of several places of an item in a text the one with the least
distance is reported, the first of them on ties. Repeated rows stay repeated, a null doc_id keeps its row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from topolark.llm.common import Scratch, beside_text, bounded_batches, with_text

ERROR_RATE = 0.08
#: Bytes of item text in a block; its automaton takes some hundred times as much in a worker.
BLOCK_BYTES = 1 << 20

OTHER = re.compile(r"[\W_]+")
HITS = ArrayType(StructType().add("item_id", LongType()).add("distance", IntegerType()).add("start", IntegerType()).add("end", IntegerType()))


def normal(text: str | None) -> str:
    """Padded with a space on either side, so that pieces can ask for whole words."""
    return f" {OTHER.sub(' ', (text or '').lower()).strip()} "


def nearest(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of text nearest to a pattern of m signs, or None beyond most edits."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, most + 1, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, j
    return (best, end) if best <= most else None


class Item:
    def __init__(self, text: str, ids: list[int | None], error_rate: float):
        self.ids = ids
        self.edits = int(error_rate * (len(text) - 2))
        self.text = text.strip() if self.edits else text
        self.masks, self.back = self.of(self.text), self.of(self.text[::-1])

    @staticmethod
    def of(text: str) -> dict[str, int]:
        masks: dict[str, int] = defaultdict(int)
        for k, c in enumerate(text):
            masks[c] |= 1 << k
        return dict(masks)

    def pieces(self) -> list[tuple[int, str]]:
        cuts = [len(self.text) * j // (self.edits + 1) for j in range(self.edits + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]

    def find(self, text: str, starts: set[int]) -> tuple[int, int, int] | None:
        """(distance, start, end) of the nearest place around the possible starts."""
        m, k = len(self.text), self.edits
        exact = min((s for s in starts if text.startswith(self.text, max(s, 0)) and s >= 0), default=None)
        if exact is not None:
            return 0, exact, exact + m
        if not k:
            return None
        spans: list[list[int]] = []
        for s in sorted(starts):
            a, b = max(0, s - k), min(len(text), s + m + k)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        best = None
        for a, b in spans:
            if (hit := nearest(self.masks, m, text[a:b], k)) and (best is None or hit[0] < best[0]):
                best = (hit[0], a + hit[1])
        if best is None:
            return None
        low = max(0, best[1] - m - k)
        back = nearest(self.back, m, text[low : best[1]][::-1], k)
        return best[0], best[1] - (back[1] if back else m), best[1]


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], error_rate: float):
        same = defaultdict(list)
        for i, text in items:
            if len(n := normal(text)) > 2:
                same[n].append(i)
        self.items = [Item(text, sorted(ids, key=lambda i: (i is None, i or 0)), error_rate) for text, ids in sorted(same.items())]
        pieces = defaultdict(list)
        for k, item in enumerate(self.items):
            for at, piece in item.pieces():
                pieces[piece].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> list[dict]:
        if not self.items or not text:
            return []
        text, starts = normal(text), defaultdict(set)
        for last, (size, where) in self.automaton.iter(text):
            for k, at in where:
                starts[k].add(last + 1 - size - at)
        out = []
        for k in sorted(starts):
            if found := self.items[k].find(text, starts[k]):
                out += [dict(zip(("item_id", "distance", "start", "end"), (i, *found))) for i in self.items[k].ids]
        return out


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items (item_id, text) in blocks of about block_bytes, one on the driver at a time; one empty block if there is none."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()]


def passes(benchmark: DataFrame, block_bytes: int, one: Callable[[DataFrame | None, list], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """The result of the last block and the written results of those before it, each given to the next."""
    scratch, written, last = Scratch(benchmark.sparkSession), [], None
    for block in blocks_of(benchmark, block_bytes):
        if last is not None:
            written.append(scratch.write(last))
        last = one(written[-1] if written else None, block)
    return last, written


def with_hits(docs: DataFrame, block: list[tuple[int | None, str]], error_rate: float, keep: list[str]) -> DataFrame:
    """The columns to keep of docs, and hits: array of (item_id, distance, start, end in the normal text)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(block)  # about block_bytes
    text, own = docs.columns.index("text"), [docs.columns.index(c) for c in keep]
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, error_rate)
        for batch in batches:
            found = [matcher.hits(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in own), pa.array(found, kind)], [*keep, "hits"])

    return docs.mapInArrow(run, docs.select(*keep).schema.add("hits", HITS))


def contaminations(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item that occurs in it."""
    texts = docs.select("doc_id", "text")
    last, written = passes(benchmark, block_bytes, lambda _, block: with_hits(texts, block, error_rate, ["doc_id"]).select("doc_id", F.inline("hits")))
    return reduce(DataFrame.unionByName, written, last)


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no item occurs; all columns kept."""

    def clean(before: DataFrame | None, block: list) -> DataFrame:
        rows = before if before is not None else beside_text(docs)
        return with_hits(rows, block, error_rate, ["row_", "text"]).where(F.size("hits") == 0).drop("hits")

    return passes(benchmark, block_bytes, clean)[0].select(*with_text(docs.columns))
