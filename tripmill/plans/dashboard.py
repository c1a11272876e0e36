"""One dashboard refresh.

Run one by one, the ten filtered metrics would scan the trips ten times, and
keeping the filtered trips for them would store a copy of the data. Instead one
pass counts and sums the trips along every key the panels use. That summary has
a few thousand rows per month however many trips there are; it is written to a
shared folder, so a lost executor cannot send a panel back to the trips, and the
panels are small aggregations over it. Panels.release() removes what was written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tripmill.operators import metrics, zones as zone_ranks
from tripmill.operators.preview import raw_preview
from tripmill.operators.selection import TripFilter
from tripmill.sources.store import TripStore

# What to summarise by: a kind and up to three whole-number keys. Keys with few
# values share a kind: hours of a month (744), code x mile x passengers (7 x 31
# x 10), zones (some hundred). Fewer kinds copy each trip less often.
TIME, CODES, PICKUP, DROPOFF = range(4)
FIRST_DAY = "DATE'1970-01-01'"
# What a panel over time adds up; the others count.
SUMMED = tuple(name for name in metrics.MEASURES if name not in ("n", *metrics.COUNTED_BY_N))
AMOUNTS = "total_amount, trip_distance, fare_amount, tip_amount"
SUMMARY = "kind int, key1 {kind}, key2 int, key3 int, n bigint, " + ", ".join(
    f"{name} {'bigint' if name.startswith('n_') else 'double'}" for name in SUMMED
)


def summarise(trips: DataFrame) -> DataFrame:
    """Tallies of filtered trips per kind and keys, in one pass.

    Each trip is spread over the kinds and aggregated at once in the scan's
    stage. A trip that a metric leaves out has a NULL key there.
    """
    kind = _key_type(trips)
    key = {name: value() for name, value in metrics.KEYS.items()}
    keyed = trips.select(
        F.datediff(key["tag"], F.expr(FIRST_DAY)).cast(kind).alias("day"),
        key["stunde"].cast("int").alias("hour"),
        key["payment_type"].cast(kind).alias("payment"),
        key["km_bin"].alias("mile"),
        key["passagiere"].alias("heads"),
        *(key[name].cast(kind).alias(name) for name in ("PULocationID", "DOLocationID")),
        *AMOUNTS.split(", "),
    )
    # Only the panels over time use sums; elsewhere NULL is copied and added up.
    none = "NULL, NULL, NULL, NULL"
    spread = keyed.select(
        F.expr(
            f"stack(4, {TIME}, day, hour, NULL, {AMOUNTS}, {CODES}, payment, mile, heads, {none}, "
            f"{PICKUP}, PULocationID, NULL, NULL, {none}, {DROPOFF}, DOLocationID, NULL, NULL, {none}) "
            f"AS (kind, key1, key2, key3, {AMOUNTS})"
        )
    )
    return spread.groupBy("kind", "key1", "key2", "key3").agg(*metrics.sums("n", *SUMMED))


def _key_type(trips: DataFrame) -> str:
    """What holds every code and id as it is stored: files may have wider ones."""
    stored = {field.name: field.dataType for field in trips.schema}
    if isinstance(stored["payment_type"], T.FractionalType):
        return "double"
    ids = [stored["PULocationID"], stored["DOLocationID"]]
    if any(isinstance(each, T.FractionalType) for each in ids):
        return "double"
    return "int" if all(isinstance(each, T.IntegerType) for each in ids) else "bigint"


def work_folder(spark: SparkSession) -> str | None:
    """The shared folder that the session names for intermediate results, if any."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()


# In the order of the dashboard.
PANELS = (
    "kpis", "daily_trips", "hourly_trips", "payment_dist", "distance_dist", "top_pickup_zones",
    "top_dropoff_zones", "hourly_fare_tip", "passenger_dist", "weekday_stats",
)


class Panels(dict[str, DataFrame]):
    """Panels by name, and the folder of the summary they read. The folder goes with
    release(), or else when the session's driver ends."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder
        system, path = self._files()
        system.deleteOnExit(path)

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def release(self) -> None:
        """Removes the summary; the filtered panels can't be computed after that."""
        system, path = self._files()
        system.delete(path, True)


def panels(
    trips: DataFrame,
    zones: DataFrame,
    chosen: TripFilter,
    limit: int = zone_ranks.TOP_ZONES,
    folder: str | None = None,
    ordered: bool = True,
) -> Panels:
    """The ten filtered metrics by name, equal to calling each on its own. The pass over
    the trips runs now and is written below `folder`, which all executors share (that of
    the session if not given); the panels are lazy. Without order they come as they are
    grouped, for a caller that goes on with them."""
    spark = trips.sparkSession
    folder = folder or work_folder(spark)
    if not folder:
        raise ValueError("name a folder that all executors share, or set spark.checkpoint.dir")
    shown = Panels(spark, f"{folder.rstrip('/')}/dashboard-{uuid.uuid4()}")
    filtered = chosen.apply(trips)
    summarise(filtered).write.parquet(shown.folder)
    schema = SUMMARY.format(kind=_key_type(filtered))
    summary = metrics.of_complete(spark.read.schema(schema).parquet(shown.folder))
    code = filtered.schema["payment_type"].dataType.simpleString()

    def kind(which: int, **keys: str) -> DataFrame:
        named = {name: F.expr(value) for name, value in keys.items()}
        return summary.where(F.col("kind") == which).withColumns(named)

    hours = kind(
        TIME, tag=f"date_add({FIRST_DAY}, CAST(key1 AS INT))", stunde="CAST(key2 AS BIGINT)"
    )
    codes = kind(CODES, payment_type=f"CAST(key1 AS {code})", km_bin="key2", passagiere="key3")
    pickups = kind(PICKUP, PULocationID="key1")
    dropoffs = kind(DROPOFF, DOLocationID="key1")

    rows_of = dict.fromkeys(metrics.METRICS, hours)
    rows_of |= dict.fromkeys(("payment_dist", "distance_dist", "passenger_dist"), codes)
    made = {name: metric.of(rows_of[name]) for name, metric in metrics.METRICS.items()}
    if ordered:
        made = {name: metrics.METRICS[name].sorted(panel) for name, panel in made.items()}
    made["top_pickup_zones"] = zone_ranks.of_tallies(pickups, zones, "PULocationID", limit)
    made["top_dropoff_zones"] = zone_ranks.of_tallies(dropoffs, zones, "DOLocationID", limit)
    shown.update((name, made[name]) for name in PANELS)
    return shown


def refresh(store: TripStore, chosen: TripFilter, folder: str | None = None) -> Panels:
    """Everything the dashboard shows, in its order. Without a chosen month the
    latest available one is shown. The trend has all available months; it says
    something from two rows on, which is the caller's to check. Release the panels
    when they are no longer needed."""
    available = store.month_list()
    month = chosen.month or (available[-1] if available else "")
    if not month:
        raise ValueError(f"no month with both colours in {store.data_dir}")
    chosen = TripFilter(chosen.dataset, month, chosen.max_dist, chosen.min_fare)
    shown = panels(store.trips(chosen.dataset, [month], month), store.zones(), chosen, folder=folder)
    shown["monthly_kpis"] = store.trend(chosen.dataset, available)
    shown["raw_preview"] = raw_preview(store.raw(chosen.dataset, month))
    return shown
