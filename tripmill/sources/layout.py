"""File names: {yellow,green}_tripdata_YYYY-MM.parquet, each a plain file or a
directory of part files written by Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripmill.sources.schema import COLOURS

# Fixed value: the name pattern of monthly files.
NAME_PATTERN = r"/(yellow|green)_tripdata_(\d{4}-\d{2})\.parquet(/[^/]*)?$"


def trip_path(data_dir: str, colour: str, month: str) -> str:
    return f"{data_dir.rstrip('/')}/{colour}_tripdata_{month}.parquet"


def colour_in(path: Column) -> Column:
    return F.regexp_extract(path, NAME_PATTERN, 1)


def month_in(path: Column) -> Column:
    return F.regexp_extract(path, NAME_PATTERN, 2)


def month_files(spark: SparkSession, data_dir: str) -> list[tuple[str, str]]:
    """(taxi_type, month) of every trip file, sorted, empty if there is none.

    The file system is asked once for the names directly in data_dir. What a month's
    folder holds is not listed, so this costs the months and not their part files, and
    no Spark job."""
    pattern = f"{data_dir.rstrip('/')}/{{{','.join(COLOURS)}}}_tripdata_*.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    names = (f"/{status.getPath().getName()}" for status in found or ())
    return sorted(match.group(1, 2) for match in map(re.compile(NAME_PATTERN).search, names) if match)


def file_hash() -> Column:
    """A whole number for the file of a row, cheap to group by."""
    return F.xxhash64("_metadata.file_path")


def hashed_files(raw: DataFrame) -> DataFrame:
    """(file, path) of the files that the scan's reader has listed, by file_hash. A path
    without a host is written with one or three slashes, depending on who writes it."""
    paths = raw.sparkSession.createDataFrame([(path,) for path in raw.inputFiles()], "path string")
    spelt = F.array_distinct(F.array("path", F.regexp_replace("path", "^([a-z0-9]+):///", "$1:/")))
    return paths.select(F.explode(spelt).alias("path")).withColumn("file", F.xxhash64("path"))


def listing(spark: SparkSession, found: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(found, "taxi_type string, monat string")
