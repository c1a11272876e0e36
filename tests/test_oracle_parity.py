"""Every trip query against the same question in SQL on a second engine. The text
queries, if present, have tests of their own."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest
from conftest import TABLES

import __spark_entry__ as contract
from tripmill.plans import catalog

SCALES = [Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(body, key=lambda row: tuple(map(str, row)))


SPARK_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() <= contract.queries().keys()
    assert catalog.QUERIES.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("sf_dir", SCALES, ids=lambda path: path.name)
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_answer(spark, sf_dir, name):
    if not sf_dir.exists():
        pytest.skip(f"{sf_dir} is not here")
    with duckdb.connect() as second:
        for each in TABLES:
            second.execute(f"CREATE VIEW {each} AS FROM '{sf_dir}/{each}.parquet'")
        relation = second.sql(contract.oracle_sql()[name])
        types = dict(zip(relation.columns, (SPARK_TYPES[str(t)] for t in relation.types)))
        expected = table(relation.columns, relation.fetchall())
    result = contract.queries()[name](spark, str(sf_dir))
    assert dict(result.dtypes) == types
    assert table(result.columns, [tuple(row) for row in result.collect()]) == expected
    assert expected[1]


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert 0 < len(rows) <= 15
    assert [row.fahrten for row in rows] == sorted((row.fahrten for row in rows), reverse=True)
