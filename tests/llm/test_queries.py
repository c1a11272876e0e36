"""The registered queries over the smallest tables, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "labels", "benchmark", "embeddings")


def plain(value):
    if value is None or value != value:
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(set(contract.LLM_SQL)))
def test_query_equals_its_sql(spark, name):
    frame = contract.queries()[name](spark, SF)
    with duckdb.connect() as connection:
        for table in TABLES:
            connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        answer = connection.sql(contract.oracle_sql()[name])
        assert sorted(frame.columns) == sorted(answer.columns)
        columns = sorted(frame.columns)
        want = [tuple(map(plain, row)) for row in answer.select(*columns).fetchall()]
    got = [tuple(map(plain, row)) for row in frame.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("number", range(1, 14))
def test_each_operator_has_one_query(number):
    names = [name for name in contract.queries() if name.startswith(f"op{number}_")]
    assert len(names) == 1


def test_reshard_and_mix_give_every_document_a_place(spark):
    ids = sorted(row.doc_id for row in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    mixed = contract.queries()["op1_mix_sources"](spark, SF).collect()
    assert sorted(row.doc_id for row in mixed) == ids
    assert sorted(row.position for row in mixed) == list(range(len(ids)))
    placed = contract.queries()["op4_reshard"](spark, SF).collect()
    assert sorted(row.doc_id for row in placed) == ids
    assert {row.law for row in placed} == {"bytes"} and {row.grown_shard for row in placed} == {None}
    assert {row.shard for row in placed} <= set(range(16))
