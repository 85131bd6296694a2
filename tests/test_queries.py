"""Every core query at the smallest size, against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from tidemark import queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[k] for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, sf, name):
    got = queries.QUERIES[name](spark, sf)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1500
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_asof_of_events_that_are_there_several_times(spark, sf, tmp_path):
    """The SQL has one row for a purchase and user, whatever times the purchase has."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    later = events.selectExpr("event_id", "ts + INTERVAL 2 DAYS AS ts", "user_id", "event_type", "value", "props")
    events.unionByName(later).unionByName(events.where("event_id % 2 = 0")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = queries.asof_last_event(spark, str(tmp_path))
    assert rows(got.columns, map(tuple, got.collect())) == rows(got.columns, con.execute(queries.ORACLE_SQL["asof_last_event"]).fetchall())


def test_jobs_of_all_pages_do_not_grow_with_the_pages(spark, tmp_path):
    """40 pages of 25,000 rows in fewer jobs than pages, each row once."""
    keys = "id AS l_orderkey, int(id % 7) AS l_linenumber, id % 100 AS l_partkey, id % 10 AS l_suppkey"
    spark.range(1_000_000).selectExpr(*keys.split(", "), "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(int(id % 50)) AS l_shipdate", "double(id) AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sparkContext.setJobGroup("all pages", "")
    try:
        got = queries.pages_cover_source(spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("all pages")) < 20
    assert got.columns == ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    assert got.count() == 1_000_000 and got.exceptAll(spark.read.parquet(f"{tmp_path}/lineitem.parquet").select(*got.columns)).isEmpty()
