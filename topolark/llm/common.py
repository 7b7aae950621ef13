"""Helpers shared by the corpus operators: session settings, staging, word tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that goes to Python at once.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20

#: White space of the contracts: space and the five control characters from tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, so that long texts don't fill a worker's memory.

    Spark reads these settings when a plan runs, after an operator has returned it, so they stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where the setting is absent, a local session gets a temporary folder; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = made.get() if made.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        own = tempfile.mkdtemp(prefix="topolark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive the loss of an executor.

    An operator returns a plan that reads them, so they outlive it; scratch_scope() deletes those made within it.
    """

    scopes: list[list[str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.made = 0
        for scope in self.scopes[-1:]:
            scope.append(self.root)

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of write() that no pending DataFrame reads any more."""
        delete(self.spark, df._scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the scratch tables of operators called within; their results must be written by then."""
    Scratch.scopes.append([])
    try:
        yield
    finally:
        for root in Scratch.scopes.pop():
            delete(spark, root)


def packed(rows: DataFrame, *names: str) -> DataFrame:
    """The whole row as one struct, row_, beside the columns that an operator reads: no other name can clash."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row_"), *names)


def unpacked(columns: list[str], without: tuple[str, ...] = ()) -> list[Column]:
    """The packed row's columns, but for those that the operator replaces."""
    return [F.col("row_")[c].alias(c) for c in columns if c not in without]


def beside_text(rows: DataFrame) -> DataFrame:
    """text, and the other columns as one struct, row_: a text goes to Python once and no name can clash."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c != "text"] or [F.lit(0).alias("none")]
    return rows.select(F.struct(*rest).alias("row_"), "text")


def with_text(columns: list[str]) -> list[Column]:
    """The columns of a table that beside_text() has packed."""
    return [F.col("text") if c == "text" else F.col("row_")[c].alias(c) for c in columns]


def word_count(text: Column) -> Column:
    """Number of words (runs of non-white-space); null counts as empty. Needs no array of the words."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]++", "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for rows no label of which may be learnt from: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_rows(docs: DataFrame, known: DataFrame, most: int, seed: int) -> DataFrame:
    """(doc_id, text in UTF-8, the other columns of known) of at most so many rows of known (doc_id once each).

    Taken in the order of a seeded hash. Of rows that repeat an id the smallest text counts.
    """
    sample = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)  # ids and labels, short rows
    rest = [c for c in known.columns if c != "doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", *rest).agg(F.min("text").alias("text"))


def word_chunks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text whose separators are spaces, some of them at a time."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def tally(chunks: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) over all chunks."""
    at, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for chunk in chunks:
        one, count = np.unique(chunk, return_counts=True)
        if len(at):
            one, place = np.unique(np.concatenate((at, one)), return_inverse=True)
            count = np.bincount(place, np.concatenate((n, count)), len(one)).astype(np.int64)
        at, n = one, count
    return at, n


def squeezed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte plane by byte plane, compressed."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(blob: bytes, n: int) -> np.ndarray:
    """The n integers of squeezed()."""
    planes = pa.decompress(blob, 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel()
