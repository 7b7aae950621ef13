"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Documents are encoded once; the words of many texts at a time are told apart first and each distinct word is encoded
once. That is exact: the vocabulary's pre-tokenizer drops white space and never joins a letter to a full stop or comma,
so a text may be cut at both. The ids are counted over the whole corpus and the most frequent id gets rank 0.
Documents are sorted by doc_id over ranges, and each range becomes one file:

    magic | blocks | index | footer
    block: values (u32), bytes of data (u32), control bytes (four values each, two bits a value), data
    index: doc_id (i64), null doc_id (u8), ids (i64), an array each
    footer: documents (u64), ids (u64), where the index starts (u64), magic

A value is an id's rank in one to four bytes, the lower first; its two bits are the number of bytes less one. Blocks
hold 2^18 values whatever the documents are, so writing and reading take a block's memory however long a document
is. The ids by rank are one more file beside them. Files go to a folder of the store that spark.checkpoint.dir
names, under names of their own for every attempt; the manifest, a table that Spark commits, lists those of finished
tasks, so a lost executor leaves at most unlisted files.

Nulls and ties: a null text counts as empty and has only the end id; null doc_ids come first; rows with the same
doc_id are ordered by checksum and length of their ids, then by their place in the input. An empty table gives no
files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topolark.llm.common import Scratch, bounded_batches, squeezed, unsqueezed

MAGIC = b"TOPOIDS1"
#: Values of a block, bytes of text that are encoded together, files read by as many tasks at most.
VALUES, GATHERED, READERS = 1 << 18, 16 << 20, 1 << 14
#: Bytes of each of the four values of a control byte, looked up by it.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
BLOCK, FOOTER = "<II", "<QQQ"


def pack(values: np.ndarray) -> bytes:
    """A block of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    at = np.cumsum(size, dtype=np.int64) - size
    data = np.empty(int(size.sum(dtype=np.int64)), np.uint8)
    data[at] = v & 0xFF
    for k in (1, 2, 3):
        more = size > k
        data[at[more] + k] = v[more] >> (8 * k) & 0xFF
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return struct.pack(BLOCK, len(v), len(data)) + control.tobytes() + data.tobytes()


def unpack(n: int, control: bytes, data: bytes) -> np.ndarray:
    """The values of a block: the lengths by table, then one gather for each byte of a value."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    values = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = size > k
        if more.any():
            values[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the store that Spark takes it to be in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a qualified folder; s3a is the same store as s3."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", re.sub("^s3[an]:", "s3:", uri)))


def gathered(batches: Iterator[pa.RecordBatch], size: int = GATHERED) -> Iterator[pa.Table]:
    """Batches put together until they hold so many bytes."""
    some, held = [], 0
    for batch in batches:
        some.append(batch)
        held += batch.nbytes
        if held >= size:
            yield pa.Table.from_batches(some)
            some, held = [], 0
    if some:
        yield pa.Table.from_batches(some)


#: Letters that are one code point in every normal form and one lower-case letter when lowered.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"


def byte_table() -> dict[int, str]:
    """The sign by which a byte-level vocabulary writes each byte: itself if printable, else signs from 256 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + others.index(b)) for b in others}


class Encoder:
    """Ids of many texts at a time, each distinct word encoded once."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.coder, self.signs = Tokenizer.from_str(vocabulary), byte_table()

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each word, where they start)."""
        plain = pc.match_substring_regex(words, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        flat, sizes = array("I"), array("i")
        tokenize, sign = self.coder.model.tokenize, lambda word: word.encode().decode("latin-1").translate(self.signs)
        # Letters that normalizing but lowers and no pattern cuts go straight to the merges, once in whatever case; plain ASCII ones are their own signs.
        lowered = pc.utf8_lower(words.filter(pa.array(plain))).dictionary_encode()
        for at in range(0, len(lowered.dictionary), 4096):
            some = [tokenize(word if word.isascii() else sign(word)) for word in lowered.dictionary[at : at + 4096].to_pylist()]
            sizes.extend(list(map(len, some)))
            flat.extend([token.id for found in some for token in found])
        rest = words.filter(pa.array(~plain)).to_pylist()
        for at in range(0, len(rest), 4096):
            some = [found.ids for found in self.coder.encode_batch_fast(rest[at : at + 4096], add_special_tokens=False)]
            sizes.extend(list(map(len, some)))
            flat.extend(list(chain.from_iterable(some)))
        # From the order of encoding to that of the words.
        flat, sizes, place = np.frombuffer(flat, np.uint32), np.frombuffer(sizes, np.int32), np.empty(len(words), np.int64)
        place[plain] = lowered.indices.to_numpy()
        place[~plain] = len(lowered.dictionary) + np.arange(len(rest))
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        return flat, sizes[place], starts[place]

    def encode(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text's ids end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()).combine_chunks(), "")
        texts = pc.replace_substring_regex(texts, "[\\t\\n\\x0b\\x0c\\r]", " ")
        texts = pc.replace_substring_regex(texts, f"([{LETTERS}])([.,])", "\\1 \\2")
        lists = pc.split_pattern(texts, " ")
        found, bounds = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().copy()
        del texts, lists  # the words are held once from here on
        pa.default_memory_pool().release_unused()
        flat, sizes, starts = self.words(found.dictionary)
        at = found.indices.to_numpy()
        size = sizes[at]
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        place = np.arange(ends[-1], dtype=np.int32)
        place += np.repeat((starts[at] - ends[:-1]).astype(np.int32), size)
        return flat[place], ends[bounds[1:] - bounds[0]]


def encoded(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """doc_id, n_tokens, crc (of the ids as unsigned 32-bit integers) and ids (squeezed) of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())  # a public vocabulary, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for table in gathered(batches):
            coder = coder or Encoder(shared.value)
            ids, ends = coder.encode(table.column(1))
            sizes, crcs, blobs, start = [], [], [], 0
            for stop in ends.tolist():
                own = np.append(ids[start:stop], np.uint32(end)).astype("<u4")
                sizes.append(len(own))
                crcs.append(zlib.crc32(own.tobytes()))
                blobs.append(squeezed(own))
                start = stop
            columns = [table.column(0).combine_chunks(), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(blobs, pa.binary())]
            batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "crc", "ids"])
            yield from (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, crc long, ids binary")


def frequencies(tokens: DataFrame) -> DataFrame:
    """(id, n) over all ids of encoded()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.bincount(unsqueezed(blob, n))
                if len(found) > len(total):
                    total = np.concatenate((total, np.zeros(len(found) - len(total), np.int64)))
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return tokens.select("ids", "n_tokens").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


class Writer:
    """One file, a block at a time."""

    def __init__(self, folder: str, ranks: np.ndarray):
        system, path = store(folder)
        self.name, self.ranks = f"ids-{uuid.uuid4().hex}.bin", ranks
        self.sink = system.open_output_stream(f"{path}/{self.name}")
        self.at = self.sink.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= VALUES:
            self.flush(False)

    def flush(self, rest: bool) -> None:
        every = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        stop = len(every) if rest else len(every) // VALUES * VALUES
        for k in range(0, stop, VALUES):
            self.at += self.sink.write(pack(self.ranks[every[k : min(k + VALUES, stop)]]))
        self.waiting, self.held = [every[stop:]], len(every) - stop

    def close(self) -> tuple[str, int, int]:
        self.flush(True)
        ids = [d for d, _ in self.docs]
        for column in (np.array([d or 0 for d in ids], "<i8"), np.array([d is None for d in ids], np.uint8), np.array([n for _, n in self.docs], "<i8")):
            self.sink.write(column.tobytes())
        self.sink.write(struct.pack(FOOTER, len(self.docs), self.ids, self.at) + MAGIC)
        self.sink.close()
        return self.name, len(self.docs), self.ids


def read_file(folder: str, name: str, by_rank: np.ndarray) -> Iterator[tuple[int | None, int, int]]:
    """(doc_id, number of ids, checksum of the ids) of every document of a file, a block in memory at a time."""
    system, path = store(folder)
    with system.open_input_file(f"{path}/{name}") as source:
        source.seek(source.size() - struct.calcsize(FOOTER) - len(MAGIC))
        tail = source.read()
        docs, left, index = struct.unpack_from(FOOTER, tail)
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC or tail[struct.calcsize(FOOTER) :] != MAGIC:
            raise ValueError(f"{name} is no file of token ids")
        source.seek(index)
        ids, null, sizes = (np.frombuffer(source.read(docs * w), t) for w, t in ((8, "<i8"), (1, np.uint8), (8, "<i8")))
        source.seek(len(MAGIC))
        held = np.zeros(0, "<u4")
        for doc_id, none, size in zip(ids.tolist(), null.tolist(), sizes.tolist()):
            crc, need = 0, size
            while need:
                if not len(held):
                    n, length = struct.unpack(BLOCK, source.read(struct.calcsize(BLOCK)))
                    held = by_rank[unpack(n, source.read(-(-n // 4)), source.read(length))].astype("<u4")
                    left -= n
                crc = zlib.crc32(held[:need].tobytes(), crc)
                need, held = need - min(need, len(held)), held[need:]
            yield None if none else doc_id, size, crc
        if left or len(held):
            raise ValueError(f"{name} holds more ids than its documents")


def write_ids(docs: DataFrame, vocabulary: str, end: int, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes docs (doc_id, text) as files of ids, ascending by doc_id, and returns (manifest, folder).

    manifest: shard, name, docs, ids; shards ascend with the doc_ids. vocabulary: path of a tokenizers file, read on
    the driver; end: the id appended to every document.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    folder = qualified(spark, folder or f"{scratch.root}/files")
    tokens = scratch.write(encoded(docs, vocabulary, end).withColumn("row_", F.monotonically_increasing_id()))
    # One row for each id of the vocabulary at most: some 50,000.
    by_rank = np.array([r[0] for r in frequencies(tokens).orderBy(F.col("n").desc(), "id").select("id").collect()], np.uint32)
    system, path = store(folder)
    system.create_dir(path)
    with system.open_output_stream(f"{path}/codebook.bin") as sink:
        sink.write(by_rank.astype("<u4").tobytes())
    ranks = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 0, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = shard = None
        for batch in batches:
            for doc_id, n, blob, shard in zip(*(batch.column(k).to_pylist() for k in range(4))):
                writer = writer or Writer(folder, shared.value)
                writer.add(doc_id, unsqueezed(blob, n))
        if writer:
            row = (shard, *writer.close())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "name", "docs", "ids"])

    order = ["doc_id", "crc", "n_tokens", "row_"]
    ranges = tokens.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = scratch.write(ranges.select("doc_id", "n_tokens", "ids", F.spark_partition_id().alias("shard")).mapInArrow(run, "shard int, name string, docs long, ids long"))
    scratch.drop(tokens)
    return manifest, folder


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, from the files alone."""
    spark = manifest.sparkSession
    system, path = store(folder)
    with system.open_input_stream(f"{path}/codebook.bin") as source:
        shared = spark.sparkContext.broadcast(np.frombuffer(source.read(), "<u4"))  # within the vocabulary
    # A row for each file, of which a task wrote one.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    files = files.repartition(max(1, min(manifest.count(), READERS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = (pa.int64(),) * 4, ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                for doc_id, size, crc in read_file(folder, name, shared.value):
                    out.append((doc_id, start, size, crc))
                    start += size
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)
                        out = []
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
