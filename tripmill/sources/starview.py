"""Trips and zones derived from a star schema (lineitem, orders, customer,
supplier, nation, region), for running the metrics on those tables.

lineitem holds most of a trip. Four columns need a lookup: payment_type and
file_month from orders, DOLocationID from the customer of the order,
PULocationID from supplier. A lookup adds columns by a unique key to rows that
stay whole with or without a match (left joins), so a query names the looked-up
columns it needs and pays for those joins alone. No side is broadcast by hand:
orders, customer and supplier grow with the data, so the choice is left to
Spark's size threshold, and a key that holds many trips to its skew-join split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripmill.functions import calendar
from tripmill.sources.schema import TRIP_SCHEMA, raw_name

# The columns read. Stating their types saves a footer read per query.
TABLES = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

# Each trip column over the joined tables. An order's values are reduced to
# order_code and order_month before the join, so little of orders moves.
HOUR = "CAST((l_orderkey * 7 + l_linenumber * 5) % 24 AS INT)"
PRICE = "l_extendedprice / 1000"
TRIP_COLUMNS = {
    "VendorID": "CAST(l_suppkey AS INT)",
    "pickup_datetime": f"IF(l_orderkey % 101 = 0, NULL, l_shipdate + make_dt_interval(0, {HOUR}))",
    "dropoff_datetime": f"l_shipdate + make_dt_interval(0, {HOUR} + 1)",
    "passenger_count": "CAST(l_linenumber AS DOUBLE) + l_orderkey % 5 * 0.5D - 0.5D",
    "trip_distance": "(l_quantity - 1) * 0.8D",
    "payment_type": (
        "CASE WHEN l_orderkey % 11 = 0 THEN 0 WHEN l_orderkey % 13 = 0 THEN 6 "
        "WHEN l_orderkey % 17 = 0 THEN NULL ELSE order_code END"
    ),
    "fare_amount": (
        "CASE WHEN l_orderkey % 19 = 0 THEN 0.0D "
        f"WHEN l_orderkey % 23 = 0 THEN -{PRICE} ELSE {PRICE} END"
    ),
    "tip_amount": f"{PRICE} * l_discount",
    "total_amount": f"{PRICE} * (1 + l_tax)",
    "PULocationID": "IF(l_partkey % 50 = 0, NULL, s_nationkey)",
    "DOLocationID": "IF(l_partkey % 47 = 0, NULL, c_nationkey)",
    "taxi_type": "IF(l_linestatus = 'O', 'yellow', 'green')",
    "file_month": "IF(l_orderkey % 7 = 0, order_month, trunc(l_shipdate, 'MM'))",
}
ORDER_LOOKUPS = {"payment_type", "file_month", "DOLocationID"}
LOOKUPS = ORDER_LOOKUPS | {"PULocationID"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, needed: set[str]) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS order_code",
        "trunc(o_orderdate, 'MM') AS order_month",
    )
    if "DOLocationID" in needed:
        customer = _table(spark, sf_dir, "customer")
        orders = orders.join(customer, F.expr("o_custkey = c_custkey"), "left")
    return orders


def trips(
    spark: SparkSession,
    sf_dir: str,
    *lookups: str,
    month: str = "",
    narrow: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Combined trips of both colours in one pass, in the combined schema
    without the looked-up columns that are not named.

    month narrows the scan to the ship dates that can yield a pickup in that
    month: a pickup follows its ship date by less than a day. The filter on the
    pickup time still decides. narrow takes rows out of lineitem before the lookups.
    """
    needed = set(lookups)
    if needed - LOOKUPS:
        raise ValueError(f"not a looked-up column: {sorted(needed - LOOKUPS)}")
    rows = _table(spark, sf_dir, "lineitem")
    bounds = calendar.month_bounds(month) if month else None
    if bounds:
        first, following = bounds
        shipped = F.col("l_shipdate")
        rows = rows.where(
            (shipped > first - F.expr("INTERVAL '1' DAY")) & (shipped < following)
        )
    if narrow:
        rows = narrow(rows)
    if needed & ORDER_LOOKUPS:
        orders = _orders(spark, sf_dir, needed)
        rows = rows.join(orders, F.expr("l_orderkey = o_orderkey"), "left")
    if "PULocationID" in needed:
        supplier = _table(spark, sf_dir, "supplier")
        rows = rows.join(supplier, F.expr("l_suppkey = s_suppkey"), "left")
    return rows.selectExpr(
        *(
            f"{value} AS {name}"
            for name, value in TRIP_COLUMNS.items()
            if name in needed or name not in LOOKUPS
        )
    )


def raw_trips(spark: SparkSession, sf_dir: str, colour: str, *lookups: str, **how) -> DataFrame:
    """One colour's trips under the column names of its own files."""
    tagged = trips(spark, sf_dir, *lookups, **how).where(f"taxi_type = '{colour}'")
    return tagged.drop("taxi_type").withColumnsRenamed(
        {name: raw_name(name, colour) for name in TRIP_SCHEMA.names}
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (_table(spark, sf_dir, name) for name in ("nation", "region"))
    return nation.join(region, F.expr("n_regionkey = r_regionkey")).selectExpr(
        "n_nationkey AS LocationID",
        "concat('ZONE_', CAST(n_nationkey % 20 AS STRING)) AS Zone",
        "r_name AS Borough",
    )
