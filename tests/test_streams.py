"""Streams whose offset is a cursor, and what they tell of themselves."""

import datetime
import json
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.plans.metrics import StreamTotals, Totals
from tidemark.sources.snapshot import SnapshotTable
from tidemark.spec import Clause
from tidemark.streaming.cursor import CursorReader, CursorSource, offsets
from tidemark.streaming.upsert import upsert_stream

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, at timestamp_ntz, v string"


def rows(numbers):
    """Ten rows share each time."""
    return [(k, T0 + datetime.timedelta(minutes=k // 10), f"v{k}") for k in numbers]


def put(spark, at, made, files=2):
    spark.createDataFrame(made, SCHEMA).repartition(files).write.mode("append").option("parquet.block.size", 1024).parquet(f"file://{at}")


def run(spark, at, target, **more):
    spark.dataSource.register(CursorSource)
    stream = spark.readStream.format("cursor").schema(SCHEMA).options(path=str(at), watermark="at", keys="id").load()
    query = upsert_stream(stream, target, ["id"], f"file://{at.parent}/checkpoint", [Clause("not_matched", "insert")], **more)
    query.awaitTermination()
    return query


def test_stop_and_restart_loses_and_repeats_nothing(spark, tmp_path):
    at, target, seen = tmp_path / "source", SnapshotTable(spark, f"file://{tmp_path}/t", 2), Totals()
    for lot in (range(0, 55), range(55, 58), range(58, 200)):  # each begins among rows tied with the last one's end
        put(spark, at, rows(lot))
        run(spark, at, target, totals=seen, name="lots")
        assert sorted(r.id for r in target.read().collect()) == list(range(lot.stop))
    assert seen.counts["etl_rows_loaded_total", "lots", None] == 200 == seen.counts["etl_rows_merged_total", "lots", None]
    before = target.manifest()["version"]
    run(spark, at, target)
    assert target.manifest()["version"] == before  # nothing new


def test_cursors_and_ranges(spark, tmp_path):
    at = tmp_path / "source"
    put(spark, at, [*rows(range(100)), (None, T0 + datetime.timedelta(days=9), "no key"), (7, None, "no time")], files=3)
    reader = CursorReader(spark.read.parquet(f"file://{at}").schema, {"path": f"file://{at}", "watermark": "at", "keys": "id", "partBytes": "1"})
    end = json.loads(json.dumps(reader.latestOffset()))
    assert offsets(json.dumps(end)) == [T0 + datetime.timedelta(minutes=9), 99] and reader.initialOffset() == {"cursor": None}
    read = lambda a, b: sorted(x for p in reader.partitions(a, b) for batch in reader.read(p) for x in batch.column(0).to_pylist())
    middle = {"cursor": [{"ts": (T0 + datetime.timedelta(minutes=4)).isoformat()}, 44]}
    assert read({"cursor": None}, end) == list(range(100))
    assert read({"cursor": None}, middle) == list(range(45)) and read(middle, end) == list(range(45, 100)) == read(middle, end)
    assert reader.partitions(end, end) == [] and len(reader.partitions({"cursor": None}, end)) >= 3
    reader.commit(end)


def test_kinds_of_cursors(spark, tmp_path):
    made = [(Decimal(k) / 4, datetime.date(2024, 1, 1) + datetime.timedelta(days=k % 3), f"k{k}") for k in range(20)]
    spark.createDataFrame(made, "n decimal(10,2), d date, s string").write.parquet(f"file://{tmp_path}/kinds")
    schema = spark.read.parquet(f"file://{tmp_path}/kinds").schema
    reader = CursorReader(schema, {"path": f"{tmp_path}/kinds", "watermark": "d", "keys": "n, s"})
    end = json.loads(json.dumps(reader.latestOffset()))
    assert offsets(json.dumps(end)) == list(max((d, n, s) for n, d, s in made))
    assert sum(b.num_rows for p in reader.partitions({"cursor": None}, end) for b in reader.read(p)) == 20


def test_no_files_yet_and_missing_options(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    reader = CursorReader(schema, {"path": f"{tmp_path}/later", "watermark": "at", "keys": "id"})
    assert reader.latestOffset() == {"cursor": None} and reader.partitions({"cursor": None}, {"cursor": None}) == []
    with pytest.raises(ValueError, match="path, keys"):
        CursorReader(schema, {"watermark": "at"})
    with pytest.raises(Exception, match="schema"):
        spark.dataSource.register(CursorSource)
        spark.readStream.format("cursor").options(path=str(tmp_path), watermark="at", keys="id").load()


def test_streams_tell_their_batches(spark, tmp_path):
    at, target, totals = tmp_path / "source", SnapshotTable(spark, f"file://{tmp_path}/t", 2), Totals()
    listener = StreamTotals(totals)
    spark.streams.addListener(listener)
    try:
        put(spark, at, rows(range(30)))
        run(spark, at, target, totals=totals, name="told")
        until = time.time() + 20
        while time.time() < until and ("etl_runs_total", "told", "ok") not in totals.counts:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    lines = totals.lines()
    assert 'etl_stream_batches_total{target="told"} 1' in lines and 'etl_rows_loaded_total{target="told"} 30' in lines and 'etl_rows_merged_total{target="told"} 30' in lines
    assert any(x.startswith('etl_batch_duration_seconds_count{target="told"} 1') for x in lines) and any(x.startswith('etl_merge_duration_seconds_sum{target="told"}') for x in lines)
    assert 'etl_runs_total{target="told",status="ok"} 1' in lines


def test_a_batch_that_comes_again_is_left_out(spark, tmp_path):
    """The sink's state has a later batch than the checkpoint: the replay changes nothing and counts as a retry."""
    at, target, totals = tmp_path / "source", SnapshotTable(spark, f"file://{tmp_path}/t", 2), Totals()
    put(spark, at, rows(range(10)))
    target.merge(spark.createDataFrame(rows(range(10)), SCHEMA).withColumn("v", F.lit("kept")), ["id"], state={"batch": 5})
    run(spark, at, target, totals=totals, name="again")
    assert {r.v for r in target.read().collect()} == {"kept"} and totals.counts["etl_source_auth_retries_total", "again", None] == 1
