"""The filter state of the dashboard and the predicates of its metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tripmill.functions import calendar

def pickup() -> Column:
    return F.col("pickup_datetime")


@dataclass(frozen=True)
class TripFilter:
    """What the user has chosen. Without a month all months count; a month
    restricts the pickup time, on top of whichever files were read."""

    dataset: str = "both"
    month: str = ""
    max_dist: float = 50
    min_fare: float = 0.0

    def predicate(self) -> Column:
        distance = F.col("trip_distance")
        chosen = (
            pickup().isNotNull()
            & (distance > 0)
            & (distance <= self.max_dist)
            & (F.col("fare_amount") >= self.min_fare)
        )
        if self.month:
            chosen = chosen & calendar.in_month(pickup(), self.month)
        return chosen

    def apply(self, trips: DataFrame) -> DataFrame:
        return trips.where(self.predicate())


def known_payment() -> Column:
    code = F.col("payment_type")
    return code.isNotNull() & code.between(1, 6)


def in_histogram() -> Column:
    return F.col("trip_distance") < 30


def paid() -> Column:
    return F.col("fare_amount") > 0


def plausible_passengers() -> Column:
    """On the stored value, before it is rounded to a head count."""
    return F.col("passenger_count").between(1, 8)


def in_trend() -> Column:
    """The trend's own limits; those of the dashboard do not apply to it."""
    return (F.col("trip_distance") > 0) & (F.col("fare_amount") >= 0)
