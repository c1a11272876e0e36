"""The busiest zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripmill.operators import metrics

TOP_ZONES = 15


def top_pickup_zones(trips: DataFrame, zones: DataFrame, limit: int = TOP_ZONES) -> DataFrame:
    return _top(trips, zones, "PULocationID", limit)


def top_dropoff_zones(trips: DataFrame, zones: DataFrame, limit: int = TOP_ZONES) -> DataFrame:
    return _top(trips, zones, "DOLocationID", limit)


def _top(trips: DataFrame, zones: DataFrame, location: str, limit: int) -> DataFrame:
    return of_tallies(metrics.tallies(trips, location, "n"), zones, location, limit)


def of_tallies(rows: DataFrame, zones: DataFrame, location: str, limit: int) -> DataFrame:
    return rank_zones(metrics.counts_by(rows, location), zones, location, limit)


def rank_zones(counts: DataFrame, zones: DataFrame, location: str, limit: int) -> DataFrame:
    """Top zones by trips, from the trip count (n) of each location id.

    Trips are counted per id first and meet the lookup as one row per id, so
    the join never sees trips and a busy zone cannot skew it. The lookup is
    left to Spark's size check: broadcast below the threshold, shuffled with
    the counts beyond it. Ids that share a name add up; ids without a zone drop
    out.
    """
    return (
        counts.join(zones, F.col(location) == F.col("LocationID"))
        .groupBy("Zone", "Borough")
        .agg(F.sum("n").alias("fahrten"))
        .orderBy(F.desc("fahrten"), "Zone", "Borough")
        .limit(limit)
    )
