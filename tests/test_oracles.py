"""Registered pixel queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from pixelmill.plans import queries as Q

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, con, name):
    a, b = Q.queries()[name](spark, D).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert ((a == b) | (a.isna() & b.isna())).all().all()


def test_stream_debounce(spark, tmp_path):
    from pixelmill.streaming import events as E

    table = spark.read.parquet(f"{D}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = E.debounce(stream, late="1 hour").writeStream.outputMode("complete").format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("bursts").collect())) == sorted(map(tuple, E.debounce(table).collect()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
