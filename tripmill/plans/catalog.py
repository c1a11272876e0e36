"""The registered queries: each metric over the trips of the star schema.

Sums are rounded to 2 places, averages to 4 and shares to 6, here and in the
SQL, because a floating-point sum depends on the order of its terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripmill.operators import metrics, months, preview, zones as zone_ranks
from tripmill.operators.selection import TripFilter
from tripmill.plans import dashboard
from tripmill.sources import starview
from tripmill.sources.schema import BOTH, GREEN, TRIP_SCHEMA, YELLOW, to_trip_schema

Query = Callable[[SparkSession, str], DataFrame]

MAX_DIST = 35
MONTH = "1998-07"
PLACES = {
    "total_revenue": 2,
    "avg_fare": 4,
    "avg_distance": 4,
    "avg_tip": 4,
    "anteil": 6,
}


def rounded(result: DataFrame) -> DataFrame:
    return result.withColumns(
        {
            name: F.round(name, places)
            for name, places in PLACES.items()
            if name in result.columns
        }
    )


def _chosen(
    spark: SparkSession, sf_dir: str, dataset: str, *lookups: str, month: str = ""
) -> DataFrame:
    """Filtered trips. Both colours come as one pass; a single colour goes
    through its own column names, as its files would."""
    if dataset == BOTH:
        trips = starview.trips(spark, sf_dir, *lookups, month=month)
    else:
        raw = starview.raw_trips(spark, sf_dir, dataset, *lookups, month=month)
        trips = to_trip_schema(raw, dataset)
    return TripFilter(dataset, month, MAX_DIST).apply(trips)


def _metric(
    metric: Callable[[DataFrame], DataFrame], dataset: str, *lookups: str, month: str = ""
) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(metric(_chosen(spark, sf_dir, dataset, *lookups, month=month)))

    return run


def _zones(
    metric: Callable[[DataFrame, DataFrame], DataFrame], dataset: str, location: str
) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        trips = _chosen(spark, sf_dir, dataset, location)
        return metric(trips, starview.zones(spark, sf_dir))

    return run


def _by_month(metric: Callable[..., DataFrame], *arguments: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(metric(starview.trips(spark, sf_dir, "file_month"), *arguments))

    return run


def _trend(dataset: str) -> Query:
    return _by_month(lambda trips: months.trend(months.sums_by_file_month(trips, dataset)))


TRIP_LOOKUPS = ("payment_type", "PULocationID", "DOLocationID")


def raw_preview_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = starview.trips(spark, sf_dir, *TRIP_LOOKUPS, narrow=_first_of())
    return preview.first_rows(trips.select(*TRIP_SCHEMA.names))


def raw_preview_yellow(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = starview.raw_trips(spark, sf_dir, YELLOW, *TRIP_LOOKUPS, narrow=_first_of(YELLOW))
    return preview.first_rows(trips)


def _first_of(colour: str | None = None, limit: int = 30) -> Callable[[DataFrame], DataFrame]:
    """Of lineitem, the rows among which the preview's are: those whose leading columns,
    which need no lookup, are among the first. Only these few meet the lookups."""

    def narrow(rows: DataFrame) -> DataFrame:
        if colour:
            rows = rows.where(F.expr(starview.TRIP_COLUMNS["taxi_type"]) == colour)
        leading = TRIP_SCHEMA.names[: TRIP_SCHEMA.names.index("payment_type")]
        return preview.rows_of_the_first(
            rows, {name: F.expr(starview.TRIP_COLUMNS[name]) for name in leading}, limit
        )

    return narrow


def combined_trips_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the two colours, each under its own column names before,
    as counts, bounds and sums per colour of every combined column."""
    yellow, green = (
        to_trip_schema(starview.raw_trips(spark, sf_dir, colour, *TRIP_LOOKUPS), colour)
        for colour in (YELLOW, GREEN)
    )
    trips = yellow.unionByName(green)
    profile = [F.count("*").alias("trips")]
    for field in trips.schema:
        name = field.name
        if name == "taxi_type":
            continue
        profile.append(F.count(name).alias(f"n_{name}"))
        if name.endswith("_datetime"):
            profile += [F.min(name).alias(f"min_{name}"), F.max(name).alias(f"max_{name}")]
        elif field.dataType.typeName() == "double":
            profile.append(F.round(F.sum(name), 2).alias(f"sum_{name}"))
        else:
            profile.append(F.sum(name).alias(f"sum_{name}"))
    return trips.groupBy("taxi_type").agg(*profile)


def dashboard_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of one refresh, one row per entry: panel, key and values."""
    panels = dashboard.panels(
        starview.trips(spark, sf_dir, *TRIP_LOOKUPS),
        starview.zones(spark, sf_dir),
        TripFilter(BOTH, max_dist=MAX_DIST),
        # The warehouse is shared too, should the session name no folder for such work.
        folder=dashboard.work_folder(spark) or spark.conf.get("spark.sql.warehouse.dir"),
        ordered=False,
    )
    panels["monthly_kpis"] = months.trend(
        months.sums_by_file_month(starview.trips(spark, sf_dir, "file_month"))
    )
    entries = None
    for name, panel in panels.items():
        rows = _entries(name, rounded(panel))
        entries = rows if entries is None else entries.unionByName(rows)
    return entries


PANEL_KEYS = {
    "kpis": [],
    "daily_trips": ["tag"],
    "hourly_trips": ["stunde"],
    "payment_dist": ["payment_type", "Zahlungsart"],
    "distance_dist": ["km_bin"],
    "top_pickup_zones": ["Zone", "Borough"],
    "top_dropoff_zones": ["Zone", "Borough"],
    "hourly_fare_tip": ["stunde"],
    "passenger_dist": ["passagiere"],
    "weekday_stats": ["dow_num", "Wochentag"],
    "monthly_kpis": ["monat"],
}


def _entries(name: str, panel: DataFrame) -> DataFrame:
    counts = {"total_trips", "fahrten", "anzahl"} & set(panel.columns)
    count = F.col(counts.pop()) if counts else F.lit(None)
    return panel.select(
        F.lit(name).alias("panel"),
        F.concat_ws(" ", *(F.col(key).cast("string") for key in PANEL_KEYS[name])).alias(
            "eintrag"
        ),
        count.cast("bigint").alias("fahrten"),
        *(
            (F.col(value) if value in panel.columns else F.lit(None)).cast("double").alias(value)
            for value in PLACES
        ),
    )


QUERIES: dict[str, Query] = {
    "kpis_yellow": _metric(metrics.kpis, YELLOW),
    "kpis_green": _metric(metrics.kpis, GREEN),
    "kpis_both": _metric(metrics.kpis, BOTH),
    "kpis_both_month": _metric(metrics.kpis, BOTH, month=MONTH),
    "daily_trips_both": _metric(metrics.daily_trips, BOTH),
    "daily_trips_both_month": _metric(metrics.daily_trips, BOTH, month=MONTH),
    "hourly_trips_yellow": _metric(metrics.hourly_trips, YELLOW),
    "hourly_trips_green": _metric(metrics.hourly_trips, GREEN),
    "hourly_trips_both": _metric(metrics.hourly_trips, BOTH),
    "payment_dist_both": _metric(metrics.payment_dist, BOTH, "payment_type"),
    "distance_dist_both": _metric(metrics.distance_dist, BOTH),
    "top_pickup_zones_yellow": _zones(zone_ranks.top_pickup_zones, YELLOW, "PULocationID"),
    "top_pickup_zones_both": _zones(zone_ranks.top_pickup_zones, BOTH, "PULocationID"),
    "top_dropoff_zones_green": _zones(zone_ranks.top_dropoff_zones, GREEN, "DOLocationID"),
    "top_dropoff_zones_both": _zones(zone_ranks.top_dropoff_zones, BOTH, "DOLocationID"),
    "hourly_fare_tip_both": _metric(metrics.hourly_fare_tip, BOTH),
    "passenger_dist_both": _metric(metrics.passenger_dist, BOTH),
    "weekday_stats_both": _metric(metrics.weekday_stats, BOTH),
    "monthly_kpis_yellow": _trend(YELLOW),
    "monthly_kpis_green": _trend(GREEN),
    "monthly_kpis_both": _trend(BOTH),
    "available_months": _by_month(months.available_months),
    "source_counts": _by_month(lambda trips: months.source_counts(months.counts_of_rows(trips))),
    "raw_preview_yellow": raw_preview_yellow,
    "raw_preview_both": raw_preview_both,
    "combined_trips_profile": combined_trips_profile,
    "dashboard_both": dashboard_both,
}
