"""Key figures and distributions over filtered trips.

A metric is defined over tallies. A tally stands for n trips with the same keys: it has the
keys, n, sums of amounts and how many trips each sum is of. A trip is a tally of one, so a
metric of trips and one of a summary of them are the same aggregation.

Every metric of trips is one scan, a partial aggregation in the scan's stage and one
shuffle of a few rows per task: the group keys are hours, days, codes and bins,
so a key that holds a third of all trips is reduced to one row before it moves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripmill.functions import calendar, labels
from tripmill.operators import selection
from tripmill.operators.selection import pickup


def _have(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.lit(1)).otherwise(F.lit(0))


# Of each column of a tally its value for one trip. A trip that a distribution leaves out
# has no key for it.
KEYS: dict[str, Callable[[], Column]] = {
    "tag": lambda: calendar.day(pickup()),
    "stunde": lambda: calendar.hour_of_day(pickup()),
    "payment_type": lambda: F.when(selection.known_payment(), F.col("payment_type")),
    "km_bin": lambda: F.when(selection.in_histogram(), labels.mile_bin(F.col("trip_distance"))),
    "passagiere": lambda: F.when(selection.plausible_passengers(), labels.head_count(F.col("passenger_count"))),
    "PULocationID": lambda: F.col("PULocationID"),
    "DOLocationID": lambda: F.col("DOLocationID"),
}
MEASURES: dict[str, Callable[[], Column]] = {
    "n": lambda: F.lit(1),
    "total_amount": lambda: F.col("total_amount"),
    "fare_amount": lambda: F.col("fare_amount"),
    "n_fare": lambda: _have("fare_amount"),
    "trip_distance": lambda: F.col("trip_distance"),
    "n_distance": lambda: _have("trip_distance"),
    "tip_amount": lambda: F.col("tip_amount"),
    "n_tip": lambda: _have("tip_amount"),
    "paid_fare": lambda: F.when(selection.paid(), F.col("fare_amount")),
    "n_paid": lambda: F.when(selection.paid(), 1).otherwise(0),
    "paid_tip": lambda: F.when(selection.paid(), F.col("tip_amount")),
    "n_paid_tip": lambda: F.when(selection.paid(), _have("tip_amount")).otherwise(0),
}
# What the fare and the distance of trips are counted by if all of them have both.
COUNTED_BY_N = ("n_fare", "n_distance")


def tallies(trips: DataFrame, *names: str) -> DataFrame:
    """Every trip as a tally of one with the named columns."""
    return trips.select(*((KEYS | MEASURES)[name]().alias(name) for name in names))


def sums(*names: str, counted: Column | None = None) -> list[Column]:
    """Of trips, the named measures summed up, of all trips or those where counted holds."""
    values = ((name, MEASURES[name]()) for name in names)
    return [F.sum(value if counted is None else F.when(counted, value)).alias(name) for name, value in values]


def of_complete(summed: DataFrame) -> DataFrame:
    """Tallies of trips that all have a fare and a distance, as filters see to, so n tells
    how many."""
    return summed.withColumns({name: F.col("n") for name in COUNTED_BY_N})


def _count() -> Column:
    return F.coalesce(F.sum("n"), F.lit(0))


def _mean(total: str, n: str) -> Column:
    return F.try_divide(F.sum(total), F.sum(n))


def key_figures() -> list[Column]:
    """The five key figures of tallies."""
    return [
        _count().alias("total_trips"),
        F.sum("total_amount").alias("total_revenue"),
        _mean("fare_amount", "n_fare").alias("avg_fare"),
        _mean("trip_distance", "n_distance").alias("avg_distance"),
        _mean("tip_amount", "n_tip").alias("avg_tip"),
    ]


@dataclass(frozen=True)
class Metric:
    """An aggregation of tallies, of whose columns it uses some: called with trips it gives
    its rows as the dashboard shows them, `of` gives those of any tallies without an order."""

    uses: Sequence[str]
    values: Callable[[], list[Column]]
    key: tuple[str, Callable[[], Column]] | None = None
    among: Callable[[], Column] | None = None
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows
    order: Callable[[], list] = field(default=lambda: [])

    def of(self, rows: DataFrame) -> DataFrame:
        if self.among:
            rows = rows.where(self.among())
        keys = [self.key[1]().alias(self.key[0])] if self.key else []
        return self.finish(rows.groupBy(*keys).agg(*self.values()))

    def sorted(self, rows: DataFrame) -> DataFrame:
        order = self.order()
        return rows.orderBy(*order) if order else rows

    def __call__(self, trips: DataFrame) -> DataFrame:
        return self.sorted(self.of(tallies(trips, *self.uses)))


def _counts(key: str, counted: str, **how) -> Metric:
    """Tallies with that key, counted by it."""
    how = {"among": lambda: F.col(key).isNotNull(), "order": lambda: [key]} | how
    return Metric((key, "n"), lambda: [_count().alias(counted)], (key, lambda: F.col(key)), **how)


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the tallies with that key."""
    return _counts(key, "n").of(rows)


def payment_shares(counts: DataFrame) -> DataFrame:
    """Label and share of total per payment code. The window spans the codes from 1
    to 6 that occur: six, unless files store fractions."""
    share = F.col("anzahl") / F.sum("anzahl").over(Window.partitionBy())
    return counts.select(
        "payment_type",
        "anzahl",
        labels.payment_label(F.col("payment_type")).alias("Zahlungsart"),
        share.alias("anteil"),
    )


def label_weekdays(stats: DataFrame) -> DataFrame:
    return stats.withColumn("Wochentag", labels.weekday_label(F.col("dow_num")))


kpis = Metric(
    ("n", "total_amount", "fare_amount", "n_fare", "trip_distance", "n_distance", "tip_amount", "n_tip"), key_figures
)
daily_trips = _counts("tag", "fahrten", among=None)
hourly_trips = _counts("stunde", "fahrten", among=None)
payment_dist = _counts(
    "payment_type", "anzahl", finish=payment_shares, order=lambda: [F.desc("anzahl"), "payment_type"]
)
# Trips per mile; the column is called km_bin but holds miles.
distance_dist = _counts("km_bin", "anzahl")
passenger_dist = _counts("passagiere", "fahrten")
hourly_fare_tip = Metric(
    ("stunde", "paid_fare", "n_paid", "paid_tip", "n_paid_tip"),
    lambda: [_mean("paid_fare", "n_paid").alias("avg_fare"), _mean("paid_tip", "n_paid_tip").alias("avg_tip")],
    ("stunde", lambda: F.col("stunde")),
    among=lambda: F.col("n_paid") > 0,
    order=lambda: ["stunde"],
)
weekday_stats = Metric(
    ("tag", "n", "fare_amount", "n_fare"),
    lambda: [_count().alias("fahrten"), _mean("fare_amount", "n_fare").alias("avg_fare")],
    ("dow_num", lambda: calendar.weekday(F.col("tag"))),
    finish=label_weekdays,
    order=lambda: [calendar.monday_first(F.col("dow_num"))],
)
METRICS: dict[str, Metric] = {
    "kpis": kpis,
    "daily_trips": daily_trips,
    "hourly_trips": hourly_trips,
    "payment_dist": payment_dist,
    "distance_dist": distance_dist,
    "hourly_fare_tip": hourly_fare_tip,
    "passenger_dist": passenger_dist,
    "weekday_stats": weekday_stats,
}
