"""Trip files: names, months, schemas, counts, the trend and the preview."""

import datetime
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from trip_files import arrow_table, at, trip, write, write_zones

from tripmill import TripFilter, TripStore, refresh
from tripmill.functions import calendar
from tripmill.operators import metrics, months, preview
from tripmill.plans import dashboard
from tripmill.sources import layout
from tripmill.sources.schema import TRIP_SCHEMA


@pytest.fixture
def store(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    return TripStore(spark, str(data), write_zones(tmp_path))


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def test_a_month_needs_both_colours(store):
    for colour in ("yellow", "green"):
        write(store.data_dir, colour, "2025-11", [trip()])
        write(store.data_dir, colour, "2025-02", [trip()])
    write(store.data_dir, "yellow", "2025-12", [trip()])
    assert store.month_list() == ["2025-02", "2025-11"]


def test_foreign_names_and_nested_folders_do_not_count(store, tmp_path):
    data = tmp_path / "data"
    for name in (
        "notes.parquet",
        "yellow_tripdata_2025.parquet",
        "green_tripdata_2025-11.parquet.bak",
        "old_yellow_tripdata_2025-11.parquet",
    ):
        pq.write_table(arrow_table("yellow", [trip()]), data / name)
    (data / "archive").mkdir()
    for colour in ("yellow", "green"):
        write(data / "archive", colour, "2025-11", [trip()])
    assert store.month_list() == []
    assert rows(store.source_counts()) == []


def test_missing_and_empty_folder(store, spark):
    assert store.month_list() == []
    assert TripStore(spark, store.data_dir + "-absent", store.zones_csv).month_list() == []
    with pytest.raises(ValueError, match="no month"):
        refresh(store, TripFilter())


def test_spark_written_folders_are_files(store, spark, tmp_path):
    for colour in ("yellow", "green"):
        plain = write(tmp_path, colour, "2025-11", [trip()] * 6)
        target = f"{store.data_dir}/{plain.name}"
        spark.read.parquet(str(plain)).repartition(3).write.parquet(target)
    assert store.month_list() == ["2025-11"]
    assert rows(store.source_counts()) == [("green", "2025-11", 6), ("yellow", "2025-11", 6)]
    trend = store.trend("both", ["2025-11"])
    assert trend.first().total_trips == 12


def test_source_counts(store):
    write(store.data_dir, "yellow", "2025-11", [trip()] * 3)
    write(store.data_dir, "green", "2025-11", [])
    write(store.data_dir, "yellow", "2025-12", [trip(None)] * 2)
    write(store.data_dir, "yellow", "2025-13", [trip()])
    counts = store.source_counts()
    assert counts.dtypes[2] == ("total", "bigint")
    assert rows(counts) == [
        ("green", "2025-11", 0),
        ("green", "2025-12", 0),
        ("green", "2025-13", 0),
        ("yellow", "2025-11", 3),
        ("yellow", "2025-12", 2),
        ("yellow", "2025-13", 1),
    ]


def test_months_may_store_columns_differently(store):
    write(
        store.data_dir,
        "yellow",
        "2025-10",
        [trip("2025-10-02 08:00:00", passenger_count=3)],
        passenger_count=pa.int64(),
        VendorID=pa.int64(),
        PULocationID=pa.int64(),
    )
    write(
        store.data_dir,
        "yellow",
        "2025-11",
        [
            trip(passenger_count=1.5, payment_type=2.0),
            trip(payment_type=float("nan"), PULocationID=3.5),
        ],
        payment_type=pa.float64(),
        PULocationID=pa.float64(),
    )
    trips = store.trips("yellow", ["2025-10", "2025-11"])
    wider = {"VendorID": "bigint", "payment_type": "double", "PULocationID": "double"}
    assert trips.dtypes == [
        (f.name, wider.get(f.name, f.dataType.simpleString())) for f in TRIP_SCHEMA
    ]
    seen = {
        (row.passenger_count, str(row.payment_type), row.PULocationID) for row in trips.collect()
    }
    assert seen == {(3.0, "1.0", 1.0), (1.5, "2.0", 1.0), (1.0, "nan", 3.5)}
    assert rows(store.source_counts())[-1] == ("yellow", "2025-11", 2)


def test_instants_become_utc_wall_clock(store, spark):
    instant = datetime.datetime(2025, 11, 2, 5, 30, tzinfo=datetime.timezone.utc)
    write(
        store.data_dir,
        "green",
        "2025-11",
        [trip(pickup_datetime=instant)],
        pickup_datetime=pa.timestamp("us", tz="UTC"),
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        trips = store.trips("green", ["2025-11"])
        assert trips.first().pickup_datetime == at("2025-11-02 05:30:00")
        assert metrics.hourly_trips(trips).first().stunde == 5
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_wall_clock_ignores_the_session_zone(store, spark):
    # 02:30 does not exist in New York on this day.
    write(store.data_dir, "yellow", "2025-03", [trip("2025-03-09 02:30:00")])
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        trips = TripFilter("yellow", "2025-03").apply(store.trips("yellow", ["2025-03"]))
        assert rows(metrics.hourly_trips(trips)) == [(2, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_column_a_file_lacks_only_matters_to_queries_on_it(store, tmp_path):
    table = arrow_table("yellow", [trip()]).drop_columns(["passenger_count"])
    pq.write_table(table, f"{store.data_dir}/yellow_tripdata_2025-11.parquet")
    trips = TripFilter("yellow").apply(store.trips("yellow", ["2025-11"]))
    assert metrics.kpis(trips).first().total_trips == 1
    with pytest.raises(AnalysisException):
        metrics.passenger_dist(trips)


def test_a_month_without_file_is_an_error(store):
    with pytest.raises(AnalysisException):
        store.trips("yellow", ["2031-01"])


def test_trend_counts_only_the_files_own_month(store):
    inside = [trip("2025-11-01 00:00:00"), trip("2025-11-30 23:59:59.999999")]
    outside = [trip("2025-10-31 23:59:59"), trip("2025-12-01 00:00:00"), trip("2024-11-05")]
    unfit = [trip(None), trip(trip_distance=0.0), trip(fare_amount=-0.01)]
    fit = [trip(trip_distance=500.0), trip(fare_amount=0.0)]
    write(store.data_dir, "yellow", "2025-11", inside + outside + unfit + fit)
    write(store.data_dir, "green", "2025-11", [trip()])
    write(store.data_dir, "yellow", "2025-12", outside[:1])
    write(store.data_dir, "green", "2025-12", [])
    write(store.data_dir, "yellow", "2026-01", [trip("2026-01-09")])

    def trend(dataset):
        return store.trend(dataset, store.month_list())

    assert trend("both").columns == [
        "monat", "total_trips", "total_revenue", "avg_fare", "avg_distance", "avg_tip",
    ]
    assert rows(trend("yellow")) == [
        ("2025-11", 4, 52.0, 7.5, pytest.approx(126.875), 2.0),
        ("2025-12", 0, None, None, None, None),
    ]
    assert [row.total_trips for row in trend("green").collect()] == [1, 0]
    assert [row.total_trips for row in trend("both").collect()] == [5, 0]


def test_trend_of_a_month_that_does_not_exist(store):
    for colour in ("yellow", "green"):
        write(store.data_dir, colour, "2025-13", [trip()])
    trend = store.trend("both", ["2025-13"])
    assert rows(trend) == [("2025-13", 0, None, None, None, None)]


def test_complete_months_in_one_pass_agree_with_the_listing(store):
    for month in ("2025-10", "2025-11"):
        write(store.data_dir, "yellow", month, [trip(f"{month}-03"), trip("2025-11-07")])
        write(store.data_dir, "green", month, [trip("2025-11-07 01:00:00"), trip(None)])
    write(store.data_dir, "yellow", "2025-12", [trip("2025-12-03")])
    wanted = store.month_list()
    with_month = None
    for month in wanted:
        of_month = store.trips("both", [month]).withColumn("file_month", calendar.first_day(month))
        with_month = with_month.unionByName(of_month) if with_month else of_month
    for dataset in ("yellow", "green", "both"):
        listed = store.trend(dataset, wanted)
        one_pass = months.trend(months.sums_by_file_month(with_month, dataset))
        assert one_pass.columns == listed.columns
        assert rows(one_pass) == rows(listed)


def test_month_names_go_back(spark):
    texts = [(f"{year:04d}-{month:02d}",) for year in (1, 1998, 2025) for month in (1, 2, 11, 12)]
    numbered = spark.createDataFrame(texts, "monat string").withColumn("no", months.number_of(F.col("monat")))
    assert [row[0] for row in numbered.select(months.month_name(F.col("no"))).collect()] == [text for text, in texts]


def test_the_month_of_stored_instants_reaches_the_reader(store, spark):
    made = [trip(f"2025-{month:02d}-{day:02d} {hour:02d}:00:00") for month, day, hour in
            [(10, 31, 23), (11, 1, 0), (11, 30, 23), (12, 1, 0)]]
    table = arrow_table("yellow", made)
    place = table.column_names.index("tpep_pickup_datetime")
    instants = table.column(place).cast(pa.timestamp("us", "UTC"))
    pq.write_table(table.set_column(place, "tpep_pickup_datetime", instants), f"{store.data_dir}/yellow_tripdata_2025-11.parquet")
    chosen = TripFilter("yellow", "2025-11")
    zone = spark.conf.get("spark.sql.session.timeZone")
    for other in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", other)
        try:
            whole = chosen.apply(store.trips("yellow", ["2025-11"]))
            trips = chosen.apply(store.trips("yellow", ["2025-11"], "2025-11"))
            assert rows(trips) == rows(whole)
            assert [row.pickup_datetime.day for row in trips.collect()] == [1, 30]
            mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
            plan = trips._jdf.queryExecution().explainString(mode)
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
        pushed = re.search(r"PushedFilters: (.*)", plan)[1]
        assert "GreaterThanOrEqual(tpep_pickup_datetime,2025-" in pushed
        assert "LessThan(tpep_pickup_datetime,2025-" in pushed
    none = store.trips("yellow", ["2025-11"], "2025-13")
    assert none.count() == 4


def test_trend_without_any_month(store):
    trend = store.trend("both", [])
    assert rows(trend) == []
    assert trend.columns == [
        "monat", "total_trips", "total_revenue", "avg_fare", "avg_distance", "avg_tip",
    ]


def test_a_month_may_lack_a_column_the_trend_does_not_use(store):
    for month in ("2025-10", "2025-11"):
        write(store.data_dir, "green", month, [trip(f"{month}-02")])
    write(store.data_dir, "yellow", "2025-10", [trip("2025-10-02")])
    table = arrow_table("yellow", [trip()]).drop_columns(["passenger_count"])
    pq.write_table(table, f"{store.data_dir}/yellow_tripdata_2025-11.parquet")
    trend = store.trend("both", store.month_list())
    assert [(row.monat, row.total_trips) for row in trend.collect()] == [("2025-10", 2), ("2025-11", 2)]
    trips = store.trips("yellow", store.month_list())
    assert metrics.kpis(trips).first().total_trips == 2
    with pytest.raises(AnalysisException):
        metrics.passenger_dist(trips)


def test_the_trend_scans_once_per_schema(store):
    for month in range(1, 13):
        for colour in ("yellow", "green"):
            write(store.data_dir, colour, f"2024-{month:02d}", [trip(f"2024-{month:02d}-05")])
    trend = store.trend("both", store.month_list())
    plan = trend._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 2
    assert [row.total_trips for row in trend.collect()] == [2] * 12


def test_paths_with_spaces(spark, tmp_path):
    data = tmp_path / "my data+1%"
    data.mkdir()
    for colour in ("yellow", "green"):
        write(data, colour, "2025-11", [trip()] * 2)
    store = TripStore(spark, str(data), write_zones(tmp_path))
    assert [row.total_trips for row in store.trend("both", store.month_list()).collect()] == [4]
    assert rows(store.source_counts()) == [("green", "2025-11", 2), ("yellow", "2025-11", 2)]


def test_months_are_listed_by_name_alone(store, spark, tmp_path):
    for colour in ("yellow", "green"):
        folder = tmp_path / "data" / f"{colour}_tripdata_2025-11.parquet"
        for part in range(40):
            (folder / f"sub={part % 4}").mkdir(parents=True, exist_ok=True)
            (folder / f"sub={part % 4}" / f"part-{part:05d}.parquet").touch()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    try:
        found = layout.month_files(spark, store.data_dir)
        assert tracker.getJobIdsForGroup("listing") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == [("green", "2025-11"), ("yellow", "2025-11")]


def test_codes_that_are_no_codes_are_counted_as_other(store):
    odd = [1.0, 1.5, 1.5, 7.0, float("nan"), None]
    made = [trip(payment_type=code) for code in odd]
    write(store.data_dir, "yellow", "2025-11", made, payment_type=pa.float64())
    write(store.data_dir, "green", "2025-11", [trip(payment_type=2)])
    trips = TripFilter("both", "2025-11").apply(store.trips("both", ["2025-11"]))
    wanted = [(1.5, 2, "Sonstige", 0.5), (1.0, 1, "Kreditkarte", 0.25), (2.0, 1, "Bar", 0.25)]
    assert rows(metrics.payment_dist(trips)) == wanted
    shown = refresh(store, TripFilter("both", "2025-11"))
    assert rows(shown["payment_dist"]) == wanted


def test_ids_too_large_for_the_schema_stay_what_they_are(store):
    far = 2**40
    made = [trip(PULocationID=far), trip(PULocationID=1)]
    write(store.data_dir, "yellow", "2025-11", made, PULocationID=pa.int64())
    write(store.data_dir, "green", "2025-11", [trip()])
    shown = refresh(store, TripFilter("both", "2025-11"))
    assert rows(shown["top_pickup_zones"]) == [("Airport", "Queens", 2)]
    assert far in {row.PULocationID for row in store.trips("yellow", ["2025-11"]).collect()}


def test_release_leaves_no_file(store, tmp_path):
    for colour in ("yellow", "green"):
        write(store.data_dir, colour, "2025-11", [trip()])
    work = tmp_path / "work"
    shown = refresh(store, TripFilter("both"), folder=str(work))
    assert shown["kpis"].first().total_trips == 2
    assert len(list(work.iterdir())) == 1
    shown.release()
    assert list(work.iterdir()) == []


def test_a_refresh_needs_a_shared_folder(store, monkeypatch):
    for colour in ("yellow", "green"):
        write(store.data_dir, colour, "2025-11", [trip()])
    monkeypatch.setattr(dashboard, "work_folder", lambda spark: None)
    with pytest.raises(ValueError, match="folder"):
        refresh(store, TripFilter("both"))


def test_preview_of_one_colour_shows_the_file(store):
    write(store.data_dir, "yellow", "2025-11", [trip(None, trip_distance=-1.0)] * 40)
    write(store.data_dir, "green", "2025-11", [trip()] * 40)
    one = preview.raw_preview(store.raw("Yellow Taxi", "2025-11"))
    assert one.columns[:3] == ["VendorID", "tpep_pickup_datetime", "tpep_dropoff_datetime"]
    assert one.count() == 30
    both = preview.raw_preview(store.raw("Beide", "2025-11"), 50)
    assert both.columns == TRIP_SCHEMA.names
    assert both.count() == 50


def test_zone_lookup_by_header_name(store, spark, tmp_path):
    zones = {row.LocationID: (row.Zone, row.Borough) for row in store.zones().collect()}
    assert zones[264] == ("N/A", "Unknown")
    assert zones[2] == ("Penn Station, Madison Sq West", "Manhattan")
    shuffled = 'Zone,LocationID,Borough\n"A ""quoted"" zone",7,Bronx\n'
    other = TripStore(spark, store.data_dir, write_zones(tmp_path, shuffled))
    assert rows(other.zones()) == [(7, 'A "quoted" zone', "Bronx")]


def test_unknown_dataset(store):
    with pytest.raises(ValueError, match="unknown dataset"):
        store.trips("purple", ["2025-11"])


def test_refresh(store):
    late = [trip("2025-12-06 09:00:00"), trip("2025-12-07 09:00:00", trip_distance=60.0)]
    for colour in ("yellow", "green"):
        write(store.data_dir, colour, "2025-11", [trip()] * 2)
        write(store.data_dir, colour, "2025-12", late)
    shown = refresh(store, TripFilter("Beide"))
    assert list(shown) == [
        "kpis", "daily_trips", "hourly_trips", "payment_dist", "distance_dist",
        "top_pickup_zones", "top_dropoff_zones", "hourly_fare_tip", "passenger_dist",
        "weekday_stats", "monthly_kpis", "raw_preview",
    ]
    assert shown["kpis"].first().total_trips == 2
    assert rows(shown["daily_trips"]) == [(datetime.date(2025, 12, 6), 2)]
    assert rows(shown["top_pickup_zones"]) == [("Airport", "Queens", 2)]
    assert [row.total_trips for row in shown["monthly_kpis"].collect()] == [4, 4]
    assert shown["raw_preview"].count() == 4
    earlier = refresh(store, TripFilter("yellow", "2025-11"))
    assert earlier["kpis"].first().total_trips == 2
