"""Sources that gain columns and wider types; pages merged where the target lies; pages merged together."""

import dataclasses
import datetime
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import queries
from tidemark.operators import evolution
from tidemark.operators import merge as mg
from tidemark.operators.merge import MergeCardinalityError  # noqa: F401
from tidemark.plans.pipeline import Engine
from tidemark.sources import snapshot
from tidemark.sources.snapshot import SnapshotTable
from tidemark.spec import UPSERT, Clause, TargetSpec


def kind(text):
    return T.StructType.fromDDL(f"x {text}")["x"].dataType


@pytest.mark.parametrize(
    "a, b, both",
    [
        ("int", "bigint", "bigint"), ("tinyint", "smallint", "smallint"), ("int", "double", "double"), ("float", "double", "double"), ("date", "timestamp_ntz", "timestamp_ntz"),
        ("decimal(10,2)", "decimal(12,4)", "decimal(12,4)"), ("decimal(10,2)", "decimal(9,4)", "decimal(12,4)"), ("int", "decimal(12,2)", "decimal(12,2)"), ("bigint", "decimal(10,2)", "decimal(22,2)"),
        ("bigint", "double", None), ("int", "string", None), ("decimal(38,0)", "decimal(10,5)", None), ("float", "int", None), ("string", "string", "string"), ("timestamp", "timestamp_ntz", None),
    ],
)
def test_wider_types(spark, a, b, both):
    want = None if both is None else kind(both)
    assert evolution.widened(kind(a), kind(b)) == want == evolution.widened(kind(b), kind(a))


VALUES = {"tinyint": (1, 2), "int": (7, -7), "bigint": (2**40, -1), "float": (0.5, 1.5), "double": (0.1, 1e300), "date": (datetime.date(2020, 1, 2), datetime.date(1999, 1, 1))}
VALUES |= {"timestamp_ntz": (datetime.datetime(2020, 1, 2, 3, 4, 5, 6), datetime.datetime(2021, 1, 1)), "decimal(10,2)": (Decimal("1.25"), Decimal("-3.50")), "decimal(14,4)": (Decimal("1.2345"), Decimal("9.9999"))}


@pytest.mark.parametrize("old, new", [("tinyint", "int"), ("int", "bigint"), ("int", "double"), ("float", "double"), ("date", "timestamp_ntz"), ("decimal(10,2)", "decimal(14,4)"), ("int", "decimal(14,4)"), ("bigint", "decimal(10,2)"), ("bigint", "int")])
def test_stored_rows_are_read_as_the_wider_type(spark, tmp_path, old, new):
    """Untouched buckets keep their files, which hold the old type."""
    table = SnapshotTable(spark, f"file://{tmp_path}/t", 64)
    table.merge(spark.createDataFrame([(k, VALUES[old][k % 2]) for k in range(40)], f"id long, v {old}"), ["id"])
    table.merge(spark.createDataFrame([(100, VALUES[new][0]), (3, VALUES[new][1])], f"id long, v {new}"), ["id"])
    got = {r.id: r.v for r in table.read().collect()}
    assert table.read().schema["v"].dataType == evolution.widened(kind(old), kind(new))
    as_ = lambda v: datetime.datetime(*v.timetuple()[:3]) if new == "timestamp_ntz" and not isinstance(v, datetime.datetime) else v
    assert got == {k: as_(VALUES[old][k % 2]) for k in range(40)} | {100: VALUES[new][0], 3: VALUES[new][1]}


def test_new_and_missing_columns(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t", 8)
    table.merge(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string"), ["id"])
    table.merge(spark.createDataFrame([(2, "B", 5), (4, "d", 6)], "ID long, V string, extra int"), ["id"])
    table.merge(spark.createDataFrame([(1, 9), (5, 9)], "id long, extra int"), ["id"])
    assert table.read().columns == ["id", "v", "extra"]
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 9), (2, "B", 5), (3, "c", None), (4, "d", 6), (5, None, 9)]


def test_narrowing_and_fixed_columns_fail_and_change_nothing(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t", 2)
    table.merge(spark.createDataFrame([(1, 2.5)], "id long, v double"), ["id"])
    before = table.manifest()
    with pytest.raises(evolution.SchemaChanged, match="v is double, the page has bigint"):
        table.merge(spark.createDataFrame([(1, 2)], "id long, v long"), ["id"])
    with pytest.raises(evolution.SchemaChanged, match="v is double, the page has string; w is new"):
        table.merge(spark.createDataFrame([(1, "x", 1)], "id long, v string, w int"), ["id"], fixed=True)
    assert table.manifest() == before
    # Clauses that name their columns ask for no others.
    table.merge(spark.createDataFrame([(1, 7.5, "?")], "id long, v double, w string"), ["id"], [Clause("matched", "update", columns={"v": "src.v"})])
    assert [tuple(r) for r in table.read().collect()] == [(1, 7.5)]


def test_a_run_with_fixed_columns_fails(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), "a")], "id long, at timestamp_ntz, more string")
    rows.createOrReplaceTempView("gains")
    spec = TargetSpec("gains", "SELECT id, at FROM gains WHERE /*WM*/", "t", "at", ("id",), lookbackMinutes=60)
    wide = dataclasses.replace(spec, sourceQuery="SELECT id, at, more FROM gains WHERE /*WM*/")
    engine = Engine(spark, f"file://{tmp_path}")
    assert engine.run_target(spec) and not engine.run_target(dataclasses.replace(wide, schema="fixed"))
    assert "more is new" in engine.state(spec)["last_failure_error"]
    assert engine.run_target(wide) and engine.read(wide).first()["more"] == "a"


CLAUSES = [
    UPSERT, [Clause("matched", "delete", "tgt.v > 60"), *UPSERT], [Clause("matched", "update", "src.v < 0")], [Clause("not_matched", "insert", "src.v > 0")],
    [Clause("matched", "update", columns={"v": "tgt.v + src.v"}), Clause("not_matched", "insert", columns={"id": "src.id", "v": "0 - src.v"})],
]


@pytest.mark.parametrize("clauses", CLAUSES)
def test_in_place_is_the_same_merge(spark, clauses):
    target = spark.range(100).selectExpr("id", "id AS v")
    page = spark.range(90, 120).selectExpr("id", "if(id % 3 = 0, -1, id * 2) AS v")
    count = lambda *parts: sorted(tuple(r) for p in parts if p is not None for r in p.select("tgt.*", "action").collect())
    assert count(*mg.merged_in_place(target, page, ["id"], clauses)) == count(mg.merged(target, page, ["id"], clauses))


@pytest.mark.parametrize("keys", [[1, 1], [1, None]])
def test_in_place_rejects_null_and_repeated_keys(spark, tmp_path, keys):
    table = SnapshotTable(spark, f"file://{tmp_path}/t", 2)
    table.merge(spark.range(1000).selectExpr("id", "0 AS v"), ["id"])
    with pytest.raises(Exception, match=mg.REPEATED):
        table.merge(spark.createDataFrame([(k, 1) for k in keys], "id long, v int"), ["id"])
    assert table.rows() == 1000


def test_a_small_page_does_not_move_the_target(spark, tmp_path, monkeypatch):
    """The plan that is written has exchanges over the page alone."""
    table, seen = SnapshotTable(spark, f"file://{tmp_path}/t", 4), []
    table.merge(spark.range(50_000).selectExpr("id", "id AS v"), ["id"])
    page = spark.range(49_950, 50_050).selectExpr("id", "-id AS v").repartition(2)
    page.write.parquet(f"file://{tmp_path}/page")
    page = spark.read.parquet(f"file://{tmp_path}/page")
    real = snapshot.merged_in_place
    monkeypatch.setattr(snapshot, "merged_in_place", lambda *a: seen.append(real(*a)) or seen[-1])
    did = table.merge(page, ["id"])
    assert did == {"keep": 49_950, "update": 50, "insert": 50, "delete": 0} and table.rows() == 50_050 == table.read().count()
    known, new = seen[0]
    plan = known._jdf.queryExecution().executedPlan().toString()
    scans = plan.split("FileScan parquet")
    assert len(scans) == 3 and "BroadcastHashJoin" in plan
    # The target's scan is the first branch; only below the broadcast is anything shuffled.
    assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]
    keys_only = re.findall(r"ReadSchema: (\S+)", new._jdf.queryExecution().executedPlan().toString())
    assert "struct<id:bigint>" in keys_only
    # A page that is large beside the target takes the other way, with the same result.
    assert table.merge(spark.range(40_000, 60_000).selectExpr("id", "1 AS v"), ["id"])["insert"] == 9_950 and len(seen) == 1


def versions(engine, spec):
    return engine.table(spec).manifest()["version"]


def test_pages_of_a_first_load_grow(spark, sf, tmp_path):
    queries.sources(spark, sf, "orders")
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    grown, single = dataclasses.replace(queries.ORDERS, pageSize=50), dataclasses.replace(queries.ORDERS, pageSize=50, publish="page")
    engines = [Engine(spark, f"file://{tmp_path}/{k}") for k in (0, 1)]
    assert engines[0].run_target(grown) and engines[1].run_target(single)
    assert sorted(engines[0].read(grown).collect()) == sorted(engines[1].read(single).collect())
    # 1, 1, 2, 4, 8, ... pages are merged together: the merges' rows add up to a few times the source's.
    assert versions(engines[0], grown) < 12 and versions(engines[1], single) >= n // 50
    pages = [[e["rows"] for e in engine.events if e["event"] == "page"] for engine in engines]
    assert pages[0] == pages[1] and sum(pages[0]) == n
    assert [sum(e["merged"] for e in engine.events if e["event"] == "page") for engine in engines] == [n, n]
    assert engines[0].state(grown)["last_wm_timestamp"] == engines[1].state(single)["last_wm_timestamp"]


HISTORY = [(k % 7, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k), k) for k in range(40)]


@pytest.mark.parametrize("size", [1, 3, 7])
def test_keys_of_several_pages(spark, tmp_path, size):
    """The last row of a key counts, as if its pages were merged one after the other."""
    spark.createDataFrame(HISTORY, "id long, at timestamp_ntz, v long").createOrReplaceTempView("history")
    spec, got = TargetSpec("history", "SELECT id, at, v FROM history WHERE /*WM*/", "t", "at", ("id",), pageSize=size), []
    for publish in ("grow", "page"):
        engine = Engine(spark, f"file://{tmp_path}/{publish}")
        assert engine.run_target(dataclasses.replace(spec, publish=publish)), engine.state(spec)
        got.append(sorted(engine.read(spec).collect()))
    assert got[0] == got[1] and [r.v for r in got[0]] == [35, 36, 37, 38, 39, 33, 34]


def test_a_key_twice_in_a_page_still_fails(spark, tmp_path):
    spark.createDataFrame(HISTORY, "id long, at timestamp_ntz, v long").createOrReplaceTempView("history")
    spec = TargetSpec("history", "SELECT id, at, v FROM history WHERE /*WM*/", "t", "at", ("id",), pageSize=9)
    engine = Engine(spark, f"file://{tmp_path}")
    assert not engine.run_target(spec) and mg.REPEATED in engine.state(spec)["last_failure_error"]


def test_pages_together_and_their_columns(spark, tmp_path):
    """Positional names, types and a column called like the page's number."""
    rows = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k), f"{k},5") for k in range(20)]
    spark.createDataFrame(rows, "id long, at timestamp_ntz, _page string").createOrReplaceTempView("odd")
    spec = TargetSpec("odd", "SELECT id, at, _page FROM odd WHERE /*WM*/", "t", "at", ("id",), pageSize=2, insertColumns=("id", "at", "_place"), types={"_place": "decimal(6,1)"}, formats={"NLS_NUMERIC_CHARACTERS": ",."})
    engine = Engine(spark, f"file://{tmp_path}")
    assert engine.run_target(spec), engine.state(spec)
    assert sorted((r.id, str(r._place)) for r in engine.read(spec).collect()) == sorted((k, f"{k}.5") for k in range(20))
    assert engine.read(spec).columns == ["id", "at", "_place"]


def test_merge_text_names_the_targets_columns(spark, sf, tmp_path):
    queries.sources(spark, sf, "orders")
    engine, spec = Engine(spark, f"file://{tmp_path}"), TargetSpec(
        "text", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE /*WM*/", "T", "o_orderdate", ("o_orderkey",), stagingTable="S", pageSize=400,
        targetInsert="INSERT INTO S (K, D, P) VALUES (?, ?, ?)",
        targetMerge="MERGE INTO T t USING S s ON t.K = s.K WHEN MATCHED THEN UPDATE SET t.TOTAL = s.P WHEN NOT MATCHED THEN INSERT (K, TOTAL) VALUES (s.K, s.P)",
    )
    assert engine.run_target(spec)
    want = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    assert engine.read(spec).columns == ["K", "TOTAL"] and sorted(map(tuple, engine.read(spec).collect())) == sorted(map(tuple, want.collect()))
    assert engine.table(spec).read().where(F.col("TOTAL").isNull()).isEmpty()
