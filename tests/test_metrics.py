"""Every bound, bucket and label on hand-made trips."""

import datetime
import math

import pytest
from trip_files import at, trip

from tripmill.functions import calendar, labels
from tripmill.operators import metrics, zones as zone_ranks
from tripmill.operators.selection import TripFilter
from tripmill.sources.schema import TRIP_SCHEMA

NAN = float("nan")


@pytest.fixture
def trips(spark):
    def build(*made):
        tagged = [{**each, "taxi_type": "yellow"} for each in made]
        rows = [tuple(each[name] for name in TRIP_SCHEMA.names) for each in tagged]
        return spark.createDataFrame(rows, TRIP_SCHEMA)

    return build


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame(
        [
            (1, "Airport", "Queens"),
            (2, "Penn", "Manhattan"),
            (3, "Twin", "Manhattan"),
            (4, "Twin", "Manhattan"),
            (5, "Twin", "Bronx"),
            (6, "N/A", "Unknown"),
        ],
        "LocationID int, Zone string, Borough string",
    )


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def kept(trips, chosen, *made):
    """Which of the trips pass, told by their VendorID."""
    numbered = [{**each, "VendorID": i} for i, each in enumerate(made)]
    return sorted(row.VendorID for row in chosen.apply(trips(*numbered)).collect())


def test_distance_bounds(trips):
    made = [trip(trip_distance=d) for d in (0.0, 0.01, 50.0, 50.01, -1.0, None, NAN)]
    assert kept(trips, TripFilter(max_dist=50), *made) == [1, 2]


def test_fare_bounds(trips):
    made = [trip(fare_amount=f) for f in (4.99, 5.0, 0.0, -3.0, None, NAN)]
    assert kept(trips, TripFilter(min_fare=5.0), *made) == [1, 5]
    assert kept(trips, TripFilter(), *made) == [0, 1, 2, 5]


def test_pickup_must_be_known(trips):
    assert kept(trips, TripFilter(), trip(None), trip()) == [1]


def test_month_bounds(trips):
    made = [
        trip("2025-10-31 23:59:59.999999"),
        trip("2025-11-01 00:00:00"),
        trip("2025-11-30 23:59:59.999999"),
        trip("2025-12-01 00:00:00"),
        trip("2024-11-15 00:00:00"),
    ]
    assert kept(trips, TripFilter(month="2025-11"), *made) == [1, 2]
    assert kept(trips, TripFilter(month="2025-12"), *made) == [3]
    assert kept(trips, TripFilter(month="2025-13"), *made) == []
    assert kept(trips, TripFilter(month="2025-00"), *made) == []
    assert kept(trips, TripFilter(), *made) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("text", ["2025", "11-2025", "2025-11-01", "November"])
def test_month_text_is_checked(spark, text):
    with pytest.raises(ValueError):
        TripFilter(month=text).predicate()


def test_month_parsing():
    assert calendar.parse_month("2025-03") == (2025, 3)
    assert calendar.parse_month("2025-3") == (2025, 3)


def test_kpis(trips):
    some = trips(
        trip(fare_amount=10.0, tip_amount=None, total_amount=12.0, trip_distance=1.0),
        trip(fare_amount=20.0, tip_amount=4.0, total_amount=None, trip_distance=2.0),
    )
    assert rows(metrics.kpis(some)) == [(2, 12.0, 15.0, 1.5, 4.0)]
    assert rows(metrics.kpis(trips())) == [(0, None, None, None, None)]


def test_daily_trips(trips):
    some = trips(trip("2025-11-02 23:59:59"), trip("2025-11-01"), trip("2025-11-02 00:00:00"))
    assert rows(metrics.daily_trips(some)) == [
        (datetime.date(2025, 11, 1), 1),
        (datetime.date(2025, 11, 2), 2),
    ]


def test_hourly_trips_leave_out_empty_hours(trips):
    some = trips(trip("2025-11-02 23:59:59"), trip("2025-11-01 00:00:00"))
    assert rows(metrics.hourly_trips(some)) == [(0, 1), (23, 1)]


def test_payment_codes_labels_and_shares(trips):
    codes = [0, 7, None, 2, 1, 1, 3, 3, 4, 5, 6]
    result = metrics.payment_dist(trips(*(trip(payment_type=code) for code in codes)))
    assert rows(result) == [
        (1, 2, "Kreditkarte", 0.25),
        (3, 2, "Keine Gebühr", 0.25),
        (2, 1, "Bar", 0.125),
        (4, 1, "Streit", 0.125),
        (5, 1, "Unbekannt", 0.125),
        (6, 1, "Storniert", 0.125),
    ]


def test_unmapped_labels(spark):
    codes = spark.createDataFrame([(1,), (9,), (None,)], "code bigint")
    assert rows(codes.select(labels.payment_label(codes.code))) == [
        ("Kreditkarte",),
        ("Sonstige",),
        ("Sonstige",),
    ]
    assert rows(codes.select(labels.weekday_label(codes.code))) == [("Mo",), (None,), (None,)]


def test_distance_bins(trips):
    miles = [0.2, 0.99, 1.0, 29.99, 30.0, 31.0]
    result = metrics.distance_dist(trips(*(trip(trip_distance=each) for each in miles)))
    assert rows(result) == [(0, 2), (1, 1), (29, 1)]


def test_head_counts_round_half_to_even(trips):
    stored = [0.5, 1.0, 1.5, 2.5, 3.5, 7.6, 8.0, 8.5, 0.99, None, NAN]
    result = metrics.passenger_dist(trips(*(trip(passenger_count=each) for each in stored)))
    assert rows(result) == [(1, 1), (2, 2), (4, 1), (8, 2)]


def test_fares_and_tips_of_paid_trips(trips):
    some = trips(
        trip("2025-11-01 07:00:00", fare_amount=0.0, tip_amount=100.0),
        trip("2025-11-01 07:10:00", fare_amount=8.0, tip_amount=None),
        trip("2025-11-01 07:20:00", fare_amount=4.0, tip_amount=1.0),
        trip("2025-11-01 08:00:00", fare_amount=0.0),
    )
    assert rows(metrics.hourly_fare_tip(some)) == [(7, 6.0, 1.0)]


def test_weekdays_start_on_monday_and_number_from_sunday(trips):
    # 2025-11-02 is a Sunday.
    some = trips(*(trip(f"2025-11-0{day} 12:00:00", fare_amount=float(day)) for day in range(1, 9)))
    result = metrics.weekday_stats(some)
    assert rows(result) == [
        (1, 1, 3.0, "Mo"),
        (2, 1, 4.0, "Di"),
        (3, 1, 5.0, "Mi"),
        (4, 1, 6.0, "Do"),
        (5, 1, 7.0, "Fr"),
        (6, 2, 4.5, "Sa"),
        (0, 1, 2.0, "So"),
    ]


def test_nan_fare_makes_the_mean_nan(trips):
    some = TripFilter().apply(trips(trip(fare_amount=NAN), trip()))
    assert math.isnan(metrics.kpis(some).first().avg_fare)


def test_zones_merge_by_name_and_drop_unknown_ids(trips, zones):
    picked = [1, 1, 3, 4, 4, 5, 6, 99, None]
    some = trips(*(trip(PULocationID=each, DOLocationID=2) for each in picked))
    assert rows(zone_ranks.top_pickup_zones(some, zones)) == [
        ("Twin", "Manhattan", 3),
        ("Airport", "Queens", 2),
        ("N/A", "Unknown", 1),
        ("Twin", "Bronx", 1),
    ]
    assert rows(zone_ranks.top_pickup_zones(some, zones, 2)) == [
        ("Twin", "Manhattan", 3),
        ("Airport", "Queens", 2),
    ]
    assert rows(zone_ranks.top_dropoff_zones(some, zones)) == [("Penn", "Manhattan", 9)]


def test_a_zone_listed_twice_counts_twice(trips, spark):
    twice = spark.createDataFrame(
        [(1, "A", "X"), (1, "A", "X")], "LocationID int, Zone string, Borough string"
    )
    assert rows(zone_ranks.top_pickup_zones(trips(trip()), twice)) == [("A", "X", 2)]


def test_dataset_and_pickup_times_are_wall_clock(trips):
    assert trips(trip()).first().pickup_datetime == at("2025-11-05 10:30:00")
