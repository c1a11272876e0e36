"""The combined trip schema and the way a raw file is brought to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tripmill.functions import calendar

YELLOW, GREEN = "yellow", "green"
COLOURS = (YELLOW, GREEN)
BOTH = "both"

# Dataset labels of the user interface, timestamp prefixes of the
# two file families, and the common columns in their order.
DATASET_LABELS = {"Yellow Taxi": YELLOW, "Green Taxi": GREEN, "Beide": BOTH}
TIMESTAMP_PREFIX = {YELLOW: "tpep", GREEN: "lpep"}
TRIP_SCHEMA = T.StructType(
    [
        T.StructField("VendorID", T.IntegerType()),
        T.StructField("pickup_datetime", T.TimestampNTZType()),
        T.StructField("dropoff_datetime", T.TimestampNTZType()),
        T.StructField("passenger_count", T.DoubleType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("payment_type", T.LongType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("PULocationID", T.IntegerType()),
        T.StructField("DOLocationID", T.IntegerType()),
        T.StructField("taxi_type", T.StringType()),
    ]
)


def dataset_name(dataset: str) -> str:
    """'yellow', 'green' or 'both', given either that or a display label."""
    name = DATASET_LABELS.get(dataset, dataset)
    if name not in (*COLOURS, BOTH):
        raise ValueError(f"unknown dataset {dataset!r}")
    return name


def colours_of(dataset: str) -> tuple[str, ...]:
    name = dataset_name(dataset)
    return COLOURS if name == BOTH else (name,)


def raw_name(column: str, colour: str) -> str:
    """Name of a combined column in the files of one colour."""
    if column in ("pickup_datetime", "dropoff_datetime"):
        return f"{TIMESTAMP_PREFIX[colour]}_{column}"
    return column


def _to_type(value: Column, stored: T.DataType, wanted: T.DataType) -> Column:
    """Months differ in how they store codes and ids. One that is stored as another
    numeric type than the schema's stays as it is, and a union takes the wider type: a
    code 1.5 or a very large id is counted and never changed."""
    if isinstance(stored, T.TimestampType) and isinstance(wanted, T.TimestampNTZType):
        # An instant: take its UTC wall clock, whatever the session zone is.
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_add("MICROSECOND", F.unix_micros(value), epoch)
    if isinstance(stored, T.NumericType) and isinstance(wanted, T.IntegralType):
        return value if _wider(stored, wanted) else value.cast(wanted)
    return value.cast(wanted)


def instants_in_month(raw: DataFrame, colour: str, month: str) -> DataFrame:
    """Of a raw file that stores pickups as instants the rows whose UTC wall clock is in the
    month, told by the stored column, so that the range reaches the Parquet reader. Other
    files as they are."""
    name = raw_name("pickup_datetime", colour)
    stored = {field.name.lower(): field.dataType for field in raw.schema}
    bounds = calendar.month_bounds(month)
    if bounds is None or not isinstance(stored.get(name.lower()), T.TimestampType):
        return raw
    # Constants, folded when planned; the session's zone has no part in them.
    low, high = (F.timestamp_micros(F.lit(micros)) for micros in calendar.month_micros(month))
    return raw.where((F.col(name) >= low) & (F.col(name) < high))


def _wider(stored: T.DataType, wanted: T.DataType) -> bool:
    return isinstance(stored, T.FractionalType) or (
        isinstance(stored, T.LongType) and isinstance(wanted, T.IntegerType)
    )


def to_trip_schema(raw: DataFrame, colour: str, *kept: str | Column) -> DataFrame:
    """Rename, cast and tag one colour's rows; further columns only if named.

    A column that the file lacks stays absent, so only a query that needs it
    fails, the way it would on the raw file.
    """
    stored = {field.name.lower(): field.dataType for field in raw.schema}
    columns = [
        _to_type(
            F.col(raw_name(field.name, colour)),
            stored[raw_name(field.name, colour).lower()],
            field.dataType,
        ).alias(field.name)
        for field in TRIP_SCHEMA
        if raw_name(field.name, colour).lower() in stored
    ]
    return raw.select(*columns, F.lit(colour).alias("taxi_type"), *kept)
