"""Tables written to the folder shared by driver and executors, to cut lineage in loops."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one in local sessions, else an error."""
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
    return folder.rstrip("/")


class Staging:
    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.numbers = spark, f"{shared_folder(spark)}/staging-{uuid.uuid4().hex}", itertools.count()

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{next(self.numbers)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged = path
        return out

    def write_all(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Independent tables written at the same time, a job for each."""
        with ThreadPoolExecutor(len(tables) or 1) as pool:
            return dict(zip(tables, pool.map(self.write, tables.values())))

    def drop(self, df: DataFrame) -> None:
        """Delete a staged table that no pending DataFrame reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, order: list[Column | str], staging: Staging, name: str = "idx") -> DataFrame:
    """rows with their place in the order, from 0. Ranges are sorted apart; what stands before a range is summed over a row for each."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = staging.write(ranges.withColumns({"range_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}))
    counts = ranges.groupBy("range_").agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))  # a row for each partition
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range_", (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("first_")).alias("shift_"))
    return ranges.join(F.broadcast(starts), "range_").withColumn(name, F.col("at_") + F.col("shift_")).drop("range_", "at_", "shift_")


def summed(rows: DataFrame, order: list[str], weight: str, staging: Staging, name: str) -> DataFrame:
    """rows with the sum of the weights of all rows before them in the order. Ranges are summed apart, as in numbered()."""
    ranges = staging.write(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    within = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("range_").agg(F.sum(weight).alias("n_")).select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("shift_"))  # a row for each partition
    return ranges.join(F.broadcast(starts), "range_").withColumn(name, F.coalesce(F.sum(weight).over(within), F.lit(0)) + F.col("shift_")).drop("range_", "shift_")
