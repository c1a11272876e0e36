"""The joined queries on tables where one order, one supplier and one customer
hold a third of the rows, some keys match nothing and some are NULL; no lookup
is small enough to broadcast and skewed partitions are split. The answers must
be those of the SQL."""

import duckdb
import pytest
from conftest import TABLES
from test_oracle_parity import plain, table

import __spark_entry__ as contract

QUERIES = [
    "payment_dist_both",
    "top_pickup_zones_both",
    "top_dropoff_zones_both",
    "monthly_kpis_green",
    "source_counts",
    "combined_trips_profile",
    "raw_preview_both",
    "dashboard_both",
]
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    date = "timestamp_ntz'1997-01-01 00:00:00' + make_dt_interval(CAST({} % 300 AS INT))"
    made = {
        "lineitem": spark.range(24_000, numPartitions=6).selectExpr(
            "IF(id % 3 = 0, 4242, id % 5000) AS l_orderkey",
            "id % 1111 AS l_partkey",
            "CASE WHEN id % 3 = 1 THEN 7 WHEN id % 101 = 0 THEN NULL ELSE id % 40 END AS l_suppkey",
            "CAST(1 + id % 7 AS INT) AS l_linenumber",
            "CAST(1 + id % 50 AS DOUBLE) AS l_quantity",
            "CAST(1000 + id * 7919 % 90000 AS DOUBLE) AS l_extendedprice",
            "id % 11 / 100D AS l_discount",
            "id % 9 / 100D AS l_tax",
            "IF(id % 5 < 2, 'O', 'F') AS l_linestatus",
            date.format("id * 31") + " AS l_shipdate",
        ),
        "orders": spark.range(4_900).selectExpr(
            "id AS o_orderkey",
            "CASE WHEN id % 3 = 0 THEN 5 WHEN id % 97 = 0 THEN NULL ELSE id % 300 END AS o_custkey",
            date.format("id * 17") + " AS o_orderdate",
            "concat(1 + id % 5, '-PRIORITY') AS o_orderpriority",
        ),
        "customer": spark.range(280).selectExpr(
            "id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey"
        ),
        "supplier": spark.range(35).selectExpr(
            "id AS s_suppkey", "CAST(id % 25 AS INT) AS s_nationkey"
        ),
    }
    for name, frame in made.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(
            f"{folder}/{name}.parquet"
        )
    return folder


@pytest.fixture
def small_memory(spark):
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("name", QUERIES)
def test_same_answer_on_skewed_tables(spark, skewed, small_memory, name):
    with duckdb.connect() as second:
        for each in TABLES:
            if each != "part":
                second.execute(f"CREATE VIEW {each} AS FROM '{skewed}/{each}.parquet/*.parquet'")
        relation = second.sql(contract.oracle_sql()[name])
        expected = table(relation.columns, relation.fetchall())
    result = contract.queries()[name](spark, str(skewed))
    assert table(result.columns, [tuple(row) for row in result.collect()]) == expected
    assert plain(expected[1])


@pytest.mark.parametrize("name", ["monthly_kpis_green", "top_pickup_zones_both"])
def test_a_hot_key_is_split(spark, skewed, small_memory, name):
    result = contract.queries()[name](spark, str(skewed))
    result.collect()
    final = result._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in final
