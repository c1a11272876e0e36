"""Helpers that several operators share."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Rows that one rank bucket should hold on average.
BUCKET_ROWS = 4_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _settled(spark: SparkSession) -> str:
    """The folder for intermediate tables that the session names. Only on one machine, as
    in tests, may there be none: then a temporary folder is used."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(frame: DataFrame) -> DataFrame:
    """The frame computed once and kept in the shared checkpoint folder, so that
    a lost executor costs no second computation. The files go when nothing refers
    to them any longer, if spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    _settled(frame.sparkSession)
    return frame.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    return _settled(spark).rstrip("/")


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the files of shuffles and checkpoints that nothing
    refers to any longer. It learns of them when the driver's memory is collected, which
    a driver with little to do may put off until the disks are full."""
    gc.collect()
    spark._jvm.System.gc()


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from. A document without an id is none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bucket_bits(rows: int) -> int:
    """Bits of a hash that split so many rows into buckets of about BUCKET_ROWS."""
    return max(0, (rows // BUCKET_ROWS).bit_length())


def running(
    frame: DataFrame, group: Sequence[str], bucket: Sequence[str], order: Sequence[Column], **sums: Column
) -> DataFrame:
    """The frame with a running total per group for each of `sums`, this row excluded.

    Rows of a group come in the order of their buckets and then of `order`. Totals
    per bucket are summed first (aggregated before the shuffle) and run over the
    buckets; the rows only run within their bucket. So no task holds a group, only a
    bucket, and a group with a third of all rows is as many buckets as it needs.
    """
    keys = [*group, *bucket]
    amounts = {f"__{name}": amount for name, amount in sums.items()}
    totals = frame.withColumns(amounts).groupBy(*keys).agg(*(F.sum(name).alias(name) for name in amounts))
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *(F.col(key).alias(f"__key_{key}") for key in keys),
        *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"{name}_before") for name in amounts),
    )
    same = [F.col(key).eqNullSafe(F.col(f"__key_{key}")) for key in keys]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        frame.withColumns(amounts)
        .join(totals, same)
        .withColumns(
            {
                name: F.col(f"__{name}_before") + F.coalesce(F.sum(f"__{name}").over(inside), F.lit(0))
                for name in sums
            }
        )
        .drop(*(f"__key_{key}" for key in keys), *amounts, *(f"{name}_before" for name in amounts))
    )


def ranked(frame: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The frame with the rank (from 0) of each row in its group and the total of the group.

    Rows are dealt by range over group and order, counted per range, and then ranked
    within it; ranges before it add their counts. So a group that holds all rows is
    as many ranges as there are partitions. Rows that tie in everything come in the order
    of the frame. No column of `group` may be null.
    """
    dealt = cut(
        frame.withColumn("__mark", F.monotonically_increasing_id())
        .repartitionByRange(*(F.col(name) for name in group), *order, F.col("__mark"))
        .withColumn("__range", F.spark_partition_id())
    )
    counts = dealt.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *group,
        "__range",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("total"),
    )
    inside = Window.partitionBy("__range", *group).orderBy(*order, F.col("__mark"))
    return (
        dealt.join(counts, [*group, "__range"])
        .withColumn("rank", F.col("__before") + F.row_number().over(inside) - 1)
        .drop("__mark", "__range", "__before")
    )
