"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run of characters that are neither space nor U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents whose crc32 of the id is divisible by this are never learned from.
FOLDS = 5


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; only where that is unset on a local master, to a folder of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stepgraph-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, with no lineage behind them."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, handing free memory back at its end: Python workers are kept for later tasks."""

    def inner(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(frames)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return inner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document belongs to the fold that nothing is learned from; a null id does."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def internal(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of df's, however cased."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "_rank") -> DataFrame:
    """df with the position (from 0) of each row in its group, in an order that must be total.

    Rows are dealt out in ranges of (group, order), so a group of any size is spread over tasks; only one
    count for each group and range meets in a window.
    """
    spark = df.sparkSession
    cut = df.repartitionByRange(shuffle_partitions(spark), *group, *order).sortWithinPartitions(*group, *order)
    rows = checkpoint(
        cut.withColumn("_range", F.spark_partition_id()).withColumn(
            "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
    )
    parts = rows.groupBy("_range", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_range", *group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(starts, ["_range", *group]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")
