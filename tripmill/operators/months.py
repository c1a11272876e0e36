"""Months: which there are, how many trips each source has, and the trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripmill.functions import calendar
from tripmill.operators import metrics, selection
from tripmill.operators.selection import pickup
from tripmill.sources.schema import BOTH, COLOURS, dataset_name

# What a trend adds up: its key figures as tallies per file month and pickup month.
AMOUNTS = ("total_amount", "fare_amount", "trip_distance", "tip_amount")
SUMS = "pickup_no int, n bigint, n_tip bigint, file_no int, " + ", ".join(
    f"{name} double" for name in AMOUNTS
)


def month_number(moment: Column) -> Column:
    """Months since year 0: a whole number, cheaper per trip than a date or text."""
    return F.year(moment) * 12 + F.month(moment)


def number_of(monat: Column) -> Column:
    """The same of a month written YYYY-MM; NULL if there is no such month (2025-13)."""
    return month_number(F.concat(monat, F.lit("-01")).try_cast("date"))


def _seen(colour: str) -> Column:
    return F.bool_or(F.col("taxi_type") == colour)


def _seen_on_both_sides() -> Column:
    yellow, green = map(_seen, COLOURS)
    return yellow & green


def of_a_file(trips: DataFrame) -> DataFrame:
    """Trips without a file month are in no month's file."""
    return trips.where(F.col("file_month").isNotNull())


def on_both_sides(found: DataFrame, month: str | Column = "monat") -> DataFrame:
    """Months with rows of both colours, ascending. One aggregation instead of
    an intersection of two scans; month is what rows are counted by."""
    return found.groupBy(month).agg(_seen_on_both_sides().alias("complete")).where("complete").drop("complete")


def available_months(trips: DataFrame) -> DataFrame:
    """Months whose trips (with file_month) come from both colours."""
    first_days = on_both_sides(of_a_file(trips), "file_month")
    return first_days.select(calendar.month_text(F.col("file_month")).alias("monat")).orderBy("monat")


def source_counts(counts: DataFrame) -> DataFrame:
    """Trips per colour and month from rows (taxi_type, monat, n) that add up; a month
    that one colour lacks counts 0."""
    per_colour = (
        F.coalesce(F.sum(F.when(F.col("taxi_type") == colour, F.col("n"))), F.lit(0)).alias(colour)
        for colour in COLOURS
    )
    return (
        counts.groupBy("monat")
        .agg(*per_colour)
        .unpivot("monat", list(COLOURS), "taxi_type", "total")
        .select("taxi_type", "monat", "total")
        .orderBy("taxi_type", "monat")
    )


def counts_of_rows(trips: DataFrame) -> DataFrame:
    """(taxi_type, monat, n) of trips with file_month."""
    return (
        of_a_file(trips)
        .groupBy("taxi_type", "file_month")
        .agg(F.count("*").alias("n"))
        .select("taxi_type", calendar.month_text(F.col("file_month")).alias("monat"), "n")
    )


def _fit() -> Column:
    """Trips that the trend adds up."""
    return pickup().isNotNull() & selection.in_trend()


def month_sums(trips: DataFrame, *keys: str | Column) -> DataFrame:
    """What the trend adds up of fit trips, per key and pickup month."""
    by = month_number(pickup()).alias("pickup_no")
    return trips.where(_fit()).groupBy(*keys, by).agg(*metrics.sums("n", "n_tip", *AMOUNTS))


def sums_by_file_month(trips: DataFrame, dataset: str = BOTH) -> DataFrame:
    """The sums of a dataset's trips that have their file's month with them (file_month) and
    are of that month, for each month that has trips of both colours. One pass finds these
    months and their sums."""
    name = dataset_name(dataset)
    own = _fit() & (month_number(pickup()) == month_number(F.col("file_month")))
    if name != BOTH:
        own = own & (F.col("taxi_type") == name)
    summed = of_a_file(trips).withColumn("own", own).groupBy("file_month").agg(
        *metrics.sums("n", "n_tip", *AMOUNTS, counted=F.col("own")), _seen_on_both_sides().alias("complete")
    )
    number = month_number(F.col("file_month"))
    return summed.where("complete").select(
        number.alias("file_no"), number.alias("pickup_no"), "n", "n_tip", *AMOUNTS
    )


def month_name(number: Column) -> Column:
    """YYYY-MM of months since year 0."""
    year, month = (number - 1).cast("int"), (number - 1) % 12 + 1
    return F.format_string("%04d-%02d", F.floor(year / 12).cast("int"), month.cast("int"))


def trend(sums: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """Key figures of each listed month, or without a listing of each month of the sums,
    from the sums of its files. A month without a matching trip has count 0 and no other
    values; without any month there are no rows."""
    own = sums.where(F.col("pickup_no") == F.col("file_no"))
    figures = metrics.of_complete(own).groupBy("file_no").agg(*metrics.key_figures())
    if months is None:
        named = figures.withColumn("monat", month_name(F.col("file_no")))
    else:
        named = months.join(figures, number_of(F.col("monat")) == F.col("file_no"), "left").fillna(0, ["total_trips"])
    return named.select("monat", *FIGURES).orderBy("monat")


# The columns of key figures.
FIGURES = ("total_trips", "total_revenue", "avg_fare", "avg_distance", "avg_tip")
