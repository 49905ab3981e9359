"""Every registered query against its SQL, on the smallest data."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    connection = connect(small)
    yield connection
    connection.close()


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 5


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, small, name):
    status, _, message = compare(spark, con, name, QUERIES[name], SQL[name], small)
    assert status == "ok", message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_check(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_parts_with_a_header_alone(spark, con, small):
    """where the first task reads no rows, Spark writes a part that holds the header only."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert spark.read.parquet(f"{small}/orders.parquet").rdd.mapPartitionsWithIndex(lambda i, rows: [sum(1 for _ in rows)] if i == 0 else []).collect() == [0]
        for name in ("combine_cell_kinds", "combine_many_files"):
            status, _, message = compare(spark, con, name, QUERIES[name], SQL[name], small)
            assert status == "ok", message
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
