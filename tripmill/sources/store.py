"""A folder of monthly trip files and a zone lookup."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripmill.operators import months
from tripmill.sources import layout
from tripmill.sources.schema import colours_of, instants_in_month, to_trip_schema


@dataclass(frozen=True)
class TripStore:
    spark: SparkSession
    data_dir: str
    zones_csv: str

    def files(self) -> DataFrame:
        """(taxi_type, monat) of every trip file."""
        return layout.listing(self.spark, layout.month_files(self.spark, self.data_dir))

    def available_months(self) -> DataFrame:
        """Months present for both colours, ascending, as column monat."""
        return months.on_both_sides(self.files()).orderBy("monat")

    def month_list(self) -> list[str]:
        """The available months as text: file names, not data, and needed on the
        driver because they decide which paths a plan reads."""
        return [row.monat for row in self.available_months().collect()]

    def raw(self, dataset: str, month: str) -> DataFrame:
        """The month as stored: one colour with all columns of its file, both
        colours with the combined columns."""
        colours = colours_of(dataset)
        if len(colours) > 1:
            return self.trips(dataset, [month])
        return self.spark.read.parquet(layout.trip_path(self.data_dir, colours[0], month))

    def trips(self, dataset: str, wanted: Iterable[str], month: str = "") -> DataFrame:
        """Trips of the named months' files in the combined schema, without the columns
        that some of the files lack: only a query that needs one fails. month narrows the
        scan to pickups in that month where a filter on the result could not, that is,
        where the pickup is stored as an instant."""
        parts = [
            to_trip_schema(instants_in_month(raw, colour, month) if month else raw, colour)
            for colour in colours_of(dataset)
            for raw in self._read(colour, list(wanted))
        ]
        if not parts:
            raise ValueError("no month to read")
        shared = [name for name in parts[0].columns if all(name in part.columns for part in parts)]
        return reduce(DataFrame.unionByName, (part.select(*shared) for part in parts))

    def _read(self, colour: str, wanted: list[str]) -> list[DataFrame]:
        """The months' files as stored, those with one schema in one scan. Months may
        store a column with different types, which one Parquet read refuses. Asking a
        file for its schema is a footer read, so these overlap."""

        def schema_of(month: str):
            path = layout.trip_path(self.data_dir, colour, month)
            return path, self.spark.read.parquet(path).schema

        alike: dict[str, tuple] = {}
        with ThreadPoolExecutor(max_workers=16) as pool:
            for path, schema in pool.map(schema_of, wanted):
                alike.setdefault(schema.json(), (schema, []))[1].append(path)
        return [self.spark.read.schema(schema).parquet(*paths) for schema, paths in alike.values()]

    def month_sums(self, dataset: str, wanted: Iterable[str]) -> DataFrame:
        """What the trend adds up, per file month and pickup month (whole numbers).

        One scan per stored schema, however many months: trips are summed per hash of
        their file's path and per pickup month, and only those few rows learn which
        month the path stands for. The path itself as a key, or a month cut from it,
        would cost more per trip than all the rest."""
        parts = []
        for colour in colours_of(dataset):
            for raw in self._read(colour, list(wanted)):
                trips = to_trip_schema(raw, colour, layout.file_hash().alias("file"))
                summed = months.month_sums(trips, "file")
                parts.append(summed.join(self._month_of(raw), "file").drop("file"))
        if not parts:
            return self.spark.createDataFrame([], months.SUMS)
        return reduce(DataFrame.unionByName, parts)

    def _month_of(self, raw: DataFrame) -> DataFrame:
        """(file, file_no) of the files of a scan, which the reader lists itself."""
        number = months.number_of(layout.month_in(F.col("path")))
        per_file = layout.hashed_files(raw).groupBy("file").agg(
            F.min(number).alias("file_no"), F.max(number).alias("other")
        )
        clash = F.raise_error(F.lit("two files share a hash: read fewer months at once"))
        alike = F.col("file_no").eqNullSafe(F.col("other"))
        return per_file.select("file", F.when(alike, F.col("file_no")).otherwise(clash.cast("int")).alias("file_no"))

    def trend(self, dataset: str, wanted: list[str]) -> DataFrame:
        """Key figures of each of the months from the trips of that month's files."""
        listed = self.spark.createDataFrame([(month,) for month in wanted], "monat string")
        return months.trend(self.month_sums(dataset, wanted), listed)

    def source_counts(self) -> DataFrame:
        """Rows per colour and month of all trip files; 0 where a month of the
        other colour has no file. No column is read; rows are counted per hash of
        their file's path."""
        found = layout.month_files(self.spark, self.data_dir)
        paths = [layout.trip_path(self.data_dir, *each) for each in found]
        # Zeros are added, not joined: a join on names cut from the path would
        # push a check of them down to every row.
        counts = layout.listing(self.spark, found).withColumn("n", F.lit(0).cast("bigint"))
        if paths:
            every = self.spark.read.parquet(*paths)
            path = F.col("path")
            per_file = every.groupBy(layout.file_hash().alias("file")).agg(F.count("*").alias("n"))
            named = per_file.join(layout.hashed_files(every), "file")
            counts = counts.union(named.select(layout.colour_in(path), layout.month_in(path), "n"))
        return months.source_counts(counts)

    def zones(self) -> DataFrame:
        """The zone lookup. Columns go by header name; every value is text but
        the id, so a zone named N/A stays one."""
        lookup = (
            self.spark.read.option("header", True).option("escape", '"').csv(self.zones_csv)
        )
        return lookup.select(F.col("LocationID").cast("int"), "Zone", "Borough")
