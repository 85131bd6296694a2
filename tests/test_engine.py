"""Merges, state, runs and streams on a session."""

import dataclasses
from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from tidemark.operators import merge as mg
from tidemark.operators import paging, staging
from tidemark.plans import metrics, validate
from tidemark.plans.pipeline import Engine
from tidemark.plans.runner import QueueFull, RunManager
from tidemark.sources import catalog, files, introspect, migrate
from tidemark.sources import state as st
from tidemark.sources.snapshot import ConcurrentUpdate, SnapshotTable
from tidemark.spec import Clause, PipelineSpec, TargetSpec

T = TargetSpec("t", "SELECT id, sub, updated_at, amount FROM t WHERE /*WM*/", "t", "updated_at", ("id", "sub"), pageSize=3)


def put(spark, rows, name="t"):
    spark.createDataFrame(rows, "id long, sub string, updated_at timestamp_ntz, amount double").createOrReplaceTempView(name)


def at(k):
    return datetime(2026, 1, 1, 0, 0, k)


ROWS = [(k, f"s{k % 2}", at(k // 4), float(k)) for k in range(11)]


def got(df):
    return sorted(map(tuple, df.select("id", "sub", "updated_at", "amount").collect()))


def test_pages_through_ties(spark, tmp_path):
    put(spark, ROWS)
    engine = Engine(spark, f"file://{tmp_path}")
    assert engine.run_target(T)
    assert got(engine.read(T)) == sorted(ROWS)
    state = engine.state(T)
    assert state["last_success_rows"] == 11 and state["current_run_started"] is None
    assert [e["rows"] for e in engine.events if e["event"] == "page"] == [3, 3, 3, 2]


def test_no_change_rerun_keeps_watermark(spark, tmp_path):
    put(spark, ROWS)
    engine = Engine(spark, f"file://{tmp_path}")
    engine.run_target(T)
    before = engine.state(T)["last_wm_timestamp"]
    assert engine.run_target(T) and engine.state(T)["last_wm_timestamp"] == before
    assert engine.state(T)["last_success_rows"] == 0


@pytest.mark.parametrize("resume, lost", [("tuple", 0), ("watermark", 2)])
def test_resume_after_a_stop(spark, tmp_path, resume, lost):
    put(spark, ROWS)
    engine, spec = Engine(spark, f"file://{tmp_path}"), dataclasses.replace(T, resume=resume)
    assert not engine.run_target(spec, stop_after=2)  # after row 5 of 11; rows 6 and 7 tie with it
    assert "stopped" in engine.state(spec)["last_failure_error"]
    assert engine.run_target(spec)
    assert len(got(engine.read(spec))) == 11 - lost
    assert engine.state(spec)["last_failure_error"] and engine.state(spec)["last_success_rows"]


def test_lookback_takes_late_updates(spark, tmp_path):
    put(spark, ROWS)
    engine, spec = Engine(spark, f"file://{tmp_path}"), dataclasses.replace(T, lookbackMinutes=1, pageSize=None)
    engine.run_target(spec)
    put(spark, [*ROWS[:-1], (10, "s0", at(1), -1.0), (99, "s1", at(0), 9.0)])
    assert engine.run_target(spec)
    assert (99, "s1", at(0), 9.0) in got(engine.read(spec)) and (10, "s0", at(1), -1.0) in got(engine.read(spec))


def test_monotonic_watermark(spark, tmp_path):
    put(spark, ROWS)
    engine, spec = Engine(spark, f"file://{tmp_path}"), dataclasses.replace(T, lookbackMinutes=1, monotonic=True)
    engine.run_target(spec)
    put(spark, ROWS[:4])
    engine.run_target(spec)
    assert engine.state(spec)["last_wm_timestamp"].startswith("2026-01-01 00:00:02")


def test_failure_is_recorded_and_contained(spark, tmp_path):
    put(spark, ROWS)
    engine, bad = Engine(spark, f"file://{tmp_path}"), dataclasses.replace(T, name="bad", group=1, sourceQuery="SELECT id, sub, updated_at, nope FROM t WHERE /*WM*/")
    assert engine.run_targets([bad, dataclasses.replace(T, group=2)]) == {"bad": False, "t": True}
    assert "nope" in engine.state(bad)["last_failure_error"] and engine.state(bad)["last_success_rows"] is None


def test_repeated_keys(spark, tmp_path):
    put(spark, [(1, "a", at(1), 1.0), (1, "a", at(2), 2.0), (2, "b", at(1), 3.0)])
    engine = Engine(spark, f"file://{tmp_path}")
    assert not engine.run_target(T) and "repeated keys" in engine.state(T)["last_failure_error"]
    assert engine.run_target(dataclasses.replace(T, dedupe="latest"))
    assert got(engine.read(T)) == [(1, "a", at(2), 2.0), (2, "b", at(1), 3.0)]


def test_null_keys_are_rejected(spark):
    with pytest.raises(mg.MergeCardinalityError):
        mg.check_keys(spark.createDataFrame([(None, 1)], "id long, v long"), ["id"])


def test_retry_only_for_auth_errors(spark, tmp_path, monkeypatch):
    put(spark, ROWS)
    left = [2]
    whole = catalog.rows_after

    def flaky(*a):
        if left[0]:
            left[0] -= 1
            raise RuntimeError("HTTP 401")
        return whole(*a)

    monkeypatch.setattr(catalog, "rows_after", flaky)
    engine = Engine(spark, f"file://{tmp_path}")
    assert engine.run_target(T) and [e["attempt"] for e in engine.events if e["event"] == "retry"] == [1, 2]
    left[0] = 1
    monkeypatch.setattr(engine, "classify", lambda e: False)
    assert not engine.run_target(T)


def test_stale_runs_are_reset(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    engine._store(T, lambda s: st.begin(s, T, "r", st.now()))
    assert engine.reset_stale([T]) == 1 and engine.reset_stale([T]) == 0
    assert engine.state(T)["last_failure_error"] == st.STALE


def test_state_transitions_keep_history():
    when = datetime(2026, 4, 17, 10, tzinfo=timezone.utc)
    s = st.fail(st.begin(None, T, "r1", when), T, "boom", when)
    s = st.finish(st.progress(st.begin(s, T, "r2", when), T, "2026-04-17 16:05:41.250017", 5), 5, 42, when)
    assert (s["last_failure_error"], s["last_success_rows"], s["last_wm_timestamp"]) == ("boom", 5, "2026-04-17 16:05:41.250017")
    with pytest.raises(ValueError):
        st.progress(s, T, "yesterday", 1)


def test_snapshot_rewrites_only_touched_buckets(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/x", buckets=8)
    table.merge(spark.range(100).selectExpr("id", "id * 2 AS v"), ["id"])
    before = table.manifest()
    did = table.merge(spark.createDataFrame([(5, -1), (1000, 7)], "id long, v long"), ["id"])
    after = table.manifest()
    assert (did["update"], did["insert"]) == (1, 1) and table.rows() == 101 == table.read().count()
    same = [k for k in before["buckets"] if before["buckets"][k] == after["buckets"].get(k)]
    assert len(same) >= 6 and before["n_buckets"] == 8 and SnapshotTable(spark, f"file://{tmp_path}/x", buckets=99).buckets == 8
    assert table.read(before).count() == 100  # the version that a reader opened
    with pytest.raises(ConcurrentUpdate):
        table.publish(before)
    for k in range(4):
        table.merge(spark.createDataFrame([(5, k)], "id long, v long"), ["id"])
    table.vacuum(kept=1)
    assert table.read().count() == 101 and len(files.names(spark, f"file://{tmp_path}/x/manifests")) == 1


def test_buckets_follow_the_rows(spark, tmp_path, monkeypatch):
    from tidemark.sources import snapshot

    monkeypatch.setattr(snapshot, "BUCKET_ROWS", 10)
    table = SnapshotTable(spark, f"file://{tmp_path}/x", buckets=2)
    table.merge(spark.range(15).selectExpr("id", "0 AS v"), ["id"])
    assert table.buckets == 2
    table.merge(spark.range(20, 40).selectExpr("id", "1 AS v"), ["id"])
    assert table.buckets == 2  # not yet four times too few
    table.merge(spark.range(60, 120).selectExpr("id", "2 AS v"), ["id"])
    assert table.buckets == 10 and table.rows() == 95 == table.read().select("id").distinct().count()
    did = table.merge(spark.range(0, 120).selectExpr("id", "9 AS v"), ["id"], [Clause("matched", "update", "tgt.v < 2"), Clause("matched", "delete")])
    assert (did["update"], did["delete"], did["insert"], table.rows()) == (35, 60, 0, 35)
    assert sorted(r.id for r in table.read().where("v = 9").collect()) == [*range(15), *range(20, 40)]


def test_merge_of_nothing(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/x", buckets=2)
    rows = spark.range(5).selectExpr("id", "1 AS v")
    assert table.merge(rows, ["id"], [Clause("matched", "update")]) == {"keep": 0, "update": 0, "insert": 0, "delete": 0}
    assert table.merge(rows.limit(0), ["id"])["insert"] == 0 and table.rows() == 0 == table.read().count()


def test_merge_that_deletes_everything(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/x", buckets=2)
    rows = spark.range(5).selectExpr("id", "1 AS v")
    table.merge(rows, ["id"])
    table.merge(rows, ["id"], [Clause("matched", "delete")])
    assert table.rows() == 0 and table.read().count() == 0


def test_clause_order_and_null_conditions(spark):
    tgt = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id long, v long")
    src = spark.createDataFrame([(1, 11), (2, 22), (4, 44)], "id long, v long")
    out = mg.apply_merge(tgt, src, ["id"], [Clause("matched", "delete", "tgt.v > 5"), Clause("matched", "update"), Clause("not_matched", "insert", columns={"id": "src.id"})])
    assert sorted(map(tuple, out.collect()), key=str) == [(2, 22), (3, 30), (4, None)]


@pytest.mark.parametrize("clauses", [mg.UPSERT, [Clause("matched", "delete")], [Clause("not_matched", "insert", columns={"id": "src.id"})]])
def test_merge_fails_for_repeated_and_null_keys(spark, clauses):
    tgt = spark.createDataFrame([(1, 10), (2, 20)], "id long, v long")
    for rows in ([(1, 5), (1, 6)], [(7, 5), (7, 6)], [(None, 1)], [(1, 5), (1, 5)]):
        for act in (mg.apply_merge, mg.affected):
            with pytest.raises(Exception, match="null or repeated keys in the source"):
                act(tgt, spark.createDataFrame(rows, "id long, v long"), ["id"], clauses).collect()


def test_merge_takes_any_column_names(spark):
    names = ["_t", "_s", "_which", "_action", "tgt", "src", "k0", "row", "n", "bucket", "_bucket", "a.b", "c`d"]
    make = lambda rows: spark.createDataFrame(rows, "`id.x` long, " + ", ".join("`" + n.replace("`", "``") + "` long" for n in names))
    one, two = (lambda k: (k, *range(13))), (lambda k: (k, *range(13, 26)))
    out = mg.apply_merge(make([one(1), one(2)]), make([two(2), two(3)]), ["id.x"], [Clause("matched", "update", "tgt.`a.b` = 11 AND src._s = 14"), Clause("not_matched", "insert")])
    assert out.columns == ["id.x", *names]
    assert sorted(map(tuple, out.collect())) == [one(1), two(2), two(3)]


def test_snapshot_takes_any_column_names(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/x", buckets=2)
    rows = spark.createDataFrame([(1, 2, 3)], "id long, _bucket long, bucket long")
    for _ in range(2):
        table.merge(rows, ["id"])
    assert [tuple(r) for r in table.read().collect()] == [(1, 2, 3)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(size=some.integers(1, 9), seed=some.integers(0, 5))
def test_pages_partition_the_scan(spark, tmp_path, size, seed):
    import random

    rows = [(k, f"s{k}", at(random.Random(seed + k).randrange(4)), 0.0) for k in range(13)]
    put(spark, rows, "p")
    spec = dataclasses.replace(T, sourceQuery="SELECT id, sub, updated_at, amount FROM p WHERE /*WM*/", pageSize=size)
    seen = []
    for page, found in paging.pages(spark, spec, datetime(2000, 1, 1), None, f"file://{tmp_path}/st"):
        seen += got(page)
        assert found["rows"] <= size
    assert sorted(seen) == sorted(rows)


def test_insert_columns_rename_staging(spark, tmp_path):
    put(spark, ROWS)
    spec = dataclasses.replace(T, insertColumns=("a", "b", "c", "d"))
    first, found = next(paging.pages(spark, spec, datetime(2000, 1, 1), None, f"file://{tmp_path}/st"))
    assert first.columns == ["a", "b", "c", "d"] and found["keys"] == (2, "s0")
    with pytest.raises(ValueError):
        staging.positional(first, ("x",))


def test_formats_apply_to_staged_text(spark, tmp_path):
    spark.createDataFrame([(1, "x", at(1), "02.03.2026", "1.234,5"), (2, "x", at(2), None, "7")], "id long, sub string, updated_at timestamp_ntz, day string, amount string").createOrReplaceTempView("t")
    spec = dataclasses.replace(T, sourceQuery="SELECT id, sub, updated_at, day, amount FROM t WHERE /*WM*/", types={"day": "date", "amount": "decimal(18,2)"}, formats={"NLS_DATE_FORMAT": "DD.MM.YYYY", "NLS_NUMERIC_CHARACTERS": ",."})
    for k, size in enumerate((None, 1, 5)):
        engine = Engine(spark, f"file://{tmp_path}/{k}")
        assert engine.run_target(dataclasses.replace(spec, pageSize=size)), engine.state(spec)
        out = engine.read(spec).orderBy("id")
        assert dict(out.dtypes)["day"] == "date" and [str(r.amount) for r in out.collect()] == ["1234.50", "7.00"]
        assert [str(r.day) for r in out.collect()] == ["2026-03-02", "None"]
    assert not Engine(spark, f"file://{tmp_path}/bad").run_target(dataclasses.replace(spec, types={"nope": "date"}))
    assert any("types must not name" in f.message for f in validate.findings([dataclasses.replace(spec, types={"ID": "long"})]))


def test_a_load_reads_its_source_once(spark, tmp_path):
    """However many pages: the fetch writes once, and each page costs the jobs of its merge."""
    spark.range(400).selectExpr("id", "'x' AS sub", "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS updated_at", "1.0D AS amount").createOrReplaceTempView("t")
    tracker = spark.sparkContext.statusTracker()

    def jobs(size):
        engine, seen = Engine(spark, f"file://{tmp_path}/{size}"), set()
        group = f"count-{size}"
        spark.sparkContext.setJobGroup(group, group)
        whole, engine._limited = engine._limited, lambda spec: __import__("contextlib").nullcontext()
        assert engine.run_target(dataclasses.replace(T, pageSize=size, buckets=2)) and engine.table(T).rows() == 400 and whole
        seen.update(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(seen)

    few, many = jobs(200), jobs(80)
    assert (many - few) / 3 <= 5


def test_old_versions_go(spark, tmp_path):
    put(spark, ROWS)
    engine = Engine(spark, f"file://{tmp_path}")
    assert engine.run_target(dataclasses.replace(T, pageSize=1))
    assert len(files.names(spark, f"file://{tmp_path}/t/manifests")) == 3 and got(engine.read(T)) == sorted(ROWS)


def test_one_of_two_publishers_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: files.publish(spark, f"file://{tmp_path}/m/1.json", str(k)), range(8)))
    assert sum(won) == 1 and files.read(spark, f"file://{tmp_path}/m/1.json") == str(won.index(True))
    assert files.names(spark, f"file://{tmp_path}/m") == ["1.json"]


def test_a_slow_page_is_cancelled(spark, tmp_path):
    spark.udf.register("slowly", lambda x: __import__("time").sleep(30) or x, "long")
    put(spark, ROWS)
    engine = Engine(spark, f"file://{tmp_path}", page_s=1.0)
    spec = dataclasses.replace(T, sourceQuery="SELECT slowly(id) AS id, sub, updated_at, amount FROM t WHERE /*WM*/")
    began = __import__("time").monotonic()
    assert not engine.run_target(spec) and __import__("time").monotonic() - began < 25
    assert "cancel" in engine.state(spec)["last_failure_error"].lower()


def test_a_failure_that_cannot_be_recorded(spark, tmp_path, monkeypatch):
    put(spark, ROWS)
    engine = Engine(spark, f"file://{tmp_path}")
    whole = engine._store
    monkeypatch.setattr(engine, "_store", lambda spec, change: (_ for _ in ()).throw(OSError("no storage")) if spec.name == "t" else whole(spec, change))
    assert engine.run_targets([dataclasses.replace(T, group=1), dataclasses.replace(T, name="u", group=1)]) == {"t": False, "u": True}


def test_state_and_dates_in_another_zone(spark):
    from tidemark.functions import render

    zone = spark.conf.get("spark.sql.session.timeZone")
    micros = [(1_772_960_400_500_000,), (1_773_026_999_999_999,), (0,), (-1,)]
    try:
        for z in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", z)
            rows = spark.createDataFrame(micros, "m long").select(render.iso_utc(F.timestamp_micros("m")).alias("iso")).collect()
            assert [r.iso for r in rows] == ["2026-03-08T09:00:00.500Z", "2026-03-09T03:29:59.999Z", "1970-01-01T00:00:00.000Z", "1969-12-31T23:59:59.999Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_analysis_findings(spark):
    put(spark, ROWS)
    assert validate.analysed(spark, [T]) == []
    wrong = dataclasses.replace(T, watermarkType="NUMBER", initialWm="0")
    gone = dataclasses.replace(T, sourceQuery="SELECT x FROM nowhere WHERE /*WM*/")
    assert len(validate.analysed(spark, [wrong])) == 1 and "does not analyse" in validate.analysed(spark, [gone])[0].message


def test_filters_reach_the_scan(spark, sf):
    found = catalog.SourceCatalog(spark).parquet("orders", f"{sf}/orders.parquet")
    assert found.ping()
    spec = TargetSpec("o", "SELECT o_orderkey, o_orderdate FROM orders WHERE /*WM*/", "o", "o_orderdate", ("o_orderkey",), pageSize=10)
    plan = catalog.page(spark, spec, datetime(1998, 1, 1), (5,))._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan and "TakeOrderedAndProject" in plan


def test_load_from_a_database(spark, tmp_path):
    """A table of an embedded database, read in parallel; the watermark is compared in the database."""
    url = "jdbc:derby:memory:loads;create=true"
    put(spark, ROWS, "seed")
    spark.table("seed").write.jdbc(url, "T_SRC", mode="overwrite")
    found = catalog.SourceCatalog(spark).jdbc("t", url, "T_SRC", partitionColumn='"id"', lowerBound="0", upperBound="11", numPartitions="3")
    assert found.ping() and spark.table("t").rdd.getNumPartitions() == 3
    plan = catalog.rows_after(spark, T, at(1))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(updated_at,2026-01-01" in plan.replace("*", "")
    engine = Engine(spark, f"file://{tmp_path}")
    assert engine.run_target(T), engine.state(T)
    assert got(engine.read(T)) == sorted(ROWS)
    spark.createDataFrame([(50, "s0", at(30), 5.0)], spark.table("seed").schema).write.jdbc(url, "T_SRC", mode="append")
    assert engine.run_target(T) and engine.state(T)["last_success_rows"] == 1 and engine.table(T).rows() == 12


def test_run_manager(spark, tmp_path):
    put(spark, ROWS)
    specs = (T, dataclasses.replace(T, name="u", group=3))
    manager = RunManager(Engine(spark, f"file://{tmp_path}"), PipelineSpec(specs), threads=1, queue=0)
    assert manager.submit_target("nope") is None and manager.submit_group(9) is None
    manager.reserve([T])
    assert manager.submit_target("t")["skipped"] == ["t"]
    manager.release([T])
    manager.slots.acquire()
    with pytest.raises(QueueFull):
        manager.submit_all()
    manager.slots.release()
    assert manager.running == set() and manager.submit_all()["targets"] == ["t", "u"]
    manager.shutdown()
    assert manager.running == set() and [manager.engine.table(x).rows() for x in specs] == [11, 11]


def test_row_counts_do_not_keep_waiting(spark):
    import threading
    import time

    from tidemark.plans.runner import RowCounts

    go, asked = threading.Event(), []

    def read(spec):
        asked.append(spec.name)
        go.wait(10)
        if len(asked) == 2:
            raise OSError("away")
        return 5 + len(asked)

    def settled():
        end = time.monotonic() + 5
        while counts.asked and time.monotonic() < end:
            time.sleep(0.01)

    counts = RowCounts(read, ttl_s=0.0)
    assert [counts.get(T) for _ in range(3)] == [None] * 3 and len(asked) <= 1
    go.set()
    settled()
    assert counts.get(T) == 6  # asks again behind the scenes, in vain
    settled()
    assert counts.get(T) == 6 and counts.known["t"][1] in (6, 8)
    settled()
    assert counts.get(T) == 8
    counts.shutdown(5)


def test_bounded_pool_runs_overflow_in_the_caller():
    import threading

    from tidemark.plans.pools import BoundedPool

    pool, go, names = BoundedPool(1, 1), threading.Event(), []

    def work(wait):
        names.append(threading.current_thread().name)
        return go.wait(10) if wait else True

    first, second = pool.submit(work, True), pool.submit(work, True)
    third = pool.submit(work, False)
    assert third.done() and threading.current_thread().name in names and pool.waiting() + pool.active() == 2
    go.set()
    assert first.result() and second.result() and pool.shutdown(5) and pool.active() == pool.waiting() == 0


def test_degraded_answers(spark, tmp_path, monkeypatch):
    from tidemark.plans import http_api

    put(spark, ROWS)
    gone = dataclasses.replace(T, name="gone", sourceQuery="SELECT id FROM nowhere WHERE /*WM*/")
    manager = RunManager(Engine(spark, f"file://{tmp_path}"), PipelineSpec((T, gone)))
    code, body = http_api.answer(manager, "GET", "/ready")
    assert code == 503 and "source of gone" in body["error"] and body["db"] == "ok"
    assert http_api.answer(manager, "GET", "/health")[0] == 200
    monkeypatch.setattr(manager.engine, "state", lambda s: (_ for _ in ()).throw(OSError("disk away")))
    code, body = http_api.answer(manager, "GET", "/ready")
    assert code == 503 and "disk away" in body["error"] and "source of gone" in body["error"] and ";" in body["error"]
    code, body = http_api.answer(manager, "GET", "/status")
    assert code == 200 and [x["watermark"] for x in body["targets"]] == [None, None]
    monkeypatch.setattr(manager.engine, "table", lambda s: (_ for _ in ()).throw(OSError("disk away")))
    assert http_api.answer(manager, "GET", "/api/targets/t/ddl")[1]["targetTableExists"] is False
    manager.shutdown(5, 5, 5)


def test_log_lines():
    import io
    import json
    import logging

    from tidemark.plans import logs

    for as_json in (False, True):
        out = io.StringIO()
        handler = logging.StreamHandler(out)
        logs.log_to(handler, as_json)
        logging.getLogger("tidemark").info("page %s", "t", extra={"target": "t", "runId": "r", "page": 3, "group": None, "told": {"rows": 5}})
        logging.getLogger("tidemark").removeHandler(handler)
        text = out.getvalue()
        if as_json:
            line = json.loads(text)
            assert (line["target"], line["runId"], line["page"], line["told"], line["message"]) == ("t", "r", 3, {"rows": 5}, "page t") and "group" not in line
        else:
            assert "[target=t runId=r page=3] page t" in text


def test_metrics_text(spark):
    log = spark.createDataFrame([("run", "a", "ok", 0, 0)], "event string, target string, status string, rows long, merged long")
    assert metrics.exposition(metrics.counters(log)) == 'etl_runs_total{target="a",status="ok"} 1\n'


def test_migrations(spark, tmp_path):
    ids = migrate.manifest_ids("# x\n\n 001.sql \n002.sql\n")
    ran = []
    read = lambda name: ran.append(name) or "SELECT 1;"
    assert migrate.migrate(spark, f"file://{tmp_path}/ledger", ids, read) == ["001.sql", "002.sql"]
    assert migrate.migrate(spark, f"file://{tmp_path}/ledger", [*ids, "003.sql"], read) == ["003.sql"]


def test_migrations_find_their_work_done(spark, tmp_path):
    spark.sql("DROP VIEW IF EXISTS done_before")
    text = "-- makes a view\nCREATE TEMPORARY VIEW done_before AS SELECT 1 AS x;\n"
    assert migrate.apply_once(spark, text) and not migrate.apply_once(spark, text)
    assert migrate.migrate(spark, f"file://{tmp_path}/ledger", ["001.sql"], lambda name: text) == ["001.sql"]
    with pytest.raises(Exception, match="nowhere"):
        migrate.migrate(spark, f"file://{tmp_path}/ledger", ["002.sql"], lambda name: "SELECT * FROM nowhere;")
    assert files.names(spark, f"file://{tmp_path}/ledger") == ["001.sql"]


def test_ddl(spark):
    schema = spark.createDataFrame([], "id long, amount decimal(18,2), n decimal(18,0), at timestamp_ntz, s string").schema
    text = introspect.ddl("T_X", schema, ["id"])
    assert "id NUMBER NOT NULL" in text and "amount NUMBER(18,2)" in text and "n NUMBER(18)" in text and text.endswith("PRIMARY KEY (id)\n)")
    from pyspark.sql import types as kinds

    assert introspect.rendered_type(kinds.VarcharType(40)) == "VARCHAR2(40)" and introspect.rendered_type(kinds.CharType(3)) == "CHAR(3)"


def test_stream_upsert_is_idempotent(spark, tmp_path):
    from tidemark.streaming.upsert import upsert_stream

    rows = spark.range(20).selectExpr("id % 10 AS id", "id AS v")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    table = SnapshotTable(spark, f"file://{tmp_path}/out", buckets=2)
    for _ in range(2):
        stream = spark.readStream.schema("id long, v long").parquet(f"{tmp_path}/in")
        upsert_stream(stream, table, ["id"], f"{tmp_path}/cp", latest_by=["v"]).awaitTermination()
    assert sorted(map(tuple, table.read().select("id", "v").collect())) == [(k, k + 10) for k in range(10)]


def test_core_does_not_import_llm():
    import os
    import subprocess
    import sys

    code = "import sys, tidemark.queries; assert not [m for m in sys.modules if m.startswith('tidemark.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_http(spark, tmp_path):
    import json
    import threading
    import urllib.request

    from tidemark.plans import http_api

    put(spark, ROWS)
    manager = RunManager(Engine(spark, f"file://{tmp_path}"), PipelineSpec((dataclasses.replace(T, group=1),)))
    ask = lambda method, path: http_api.answer(manager, method, path)
    assert ask("POST", "/run/group/x")[0] == 400 and ask("POST", "/run/group/7")[0] == 404 and ask("POST", "/run/target/nope")[0] == 404
    manager.reserve([manager.pipeline.targets[0]])
    assert ask("POST", "/run")[0] == 409
    manager.release([manager.pipeline.targets[0]])
    assert ask("GET", "/api/targets/t/ddl")[1]["targetTableExists"] is False
    code, body = ask("POST", "/run")
    assert code == 202 and body["targets"] == ["t"] and body["skipped"] == []
    manager.shutdown()
    server = http_api.server(manager, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/status") as r:
        assert json.load(r)["targets"][0]["targetRowCount"] in (None, 11)
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/metrics") as r:
        text = r.read().decode()
    assert 'etl_rows_loaded_total{target="t"} 11' in text and 'etl_runs_total{target="t",status="ok"} 1' in text
    assert 'etl_page_duration_seconds_count{target="t"} 4' in text and 'etl_merge_duration_seconds_bucket{target="t",le="+Inf"} 4' in text
    assert 'etl_run_duration_seconds_count{target="t",status="ok"} 1' in text and 'etl_page_duration_seconds_sum{target="t"} ' in text
    assert 'etl_pool_active{pool="etl"} 0' in text and 'etl_pool_queue{pool="runner"} 0' in text and "etl_runner_rejections_total 0" in text
    server.shutdown()
    assert [ask("GET", p)[0] for p in ("/live", "/ready", "/health", "/config", "/api/targets", "/api/targets/t", "/api/targets/t/ddl", "/nope")] == [200] * 7 + [404]
    assert "PRIMARY KEY (id, sub)" in ask("GET", "/api/targets/t/ddl")[1]["targetDdl"]
