"""Proofs of coverage against rows compared one by one; quantiles from sketches."""

import datetime
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage
from tidemark.plans import metrics

DAY = datetime.datetime(2024, 1, 1)
KEYS = {
    "bigint": lambda k: k * 1000 - 500, "int": lambda k: k, "decimal(20,2)": lambda k: Decimal(k) * 7 / 4, "date": lambda k: DAY.date() + datetime.timedelta(days=k),
    "timestamp_ntz": lambda k: DAY + datetime.timedelta(seconds=k, microseconds=k), "timestamp": lambda k: DAY + datetime.timedelta(hours=k), "string": lambda k: f"key {k}", "double": lambda k: k / 3,
}


def by_hand(source, target):
    sides = defaultdict(lambda: (Counter(), Counter()))
    for k, rows in enumerate((source, target)):
        for key, v in rows:
            sides[key][k][v] += 1
    out = []
    for key, (s, t) in sides.items():
        if s != t:
            a, b = sum(s.values()), sum(t.values())
            out.append((key, "lost" if not b else "extra" if not a else "doubled" if b > a else "fewer" if b < a else "changed", a, b))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", sorted(KEYS))
@pytest.mark.parametrize("few", [1, 100_000])
def test_findings(spark, kind, few):
    key = KEYS[kind]
    source = [(key(k), f"v{k}") for k in range(400)] + [(None, "n"), (None, None), (key(5), "again"), (key(6), "a"), (key(6), "a")]
    target = [(x, "other" if x == key(77) else v) for x, v in source if x != key(123) and v != "again" and (x, v) != (None, None)]
    target += [(key(300), "v300"), (key(900), "extra"), (key(7), None)]
    made = [spark.createDataFrame(rows, f"k {kind}, v string").repartition(3) for rows in (source, target)]
    got = coverage.uncovered(*made, ["k"], n=4, few=few)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(source, target)
    assert coverage.differing(made[0], made[0].repartition(2), ["k"], n=4, few=few) == []


def test_ranges_narrow_down(spark):
    """One changed row of a hundred thousand: its range alone is read again."""
    source = spark.range(100_000).selectExpr("id", "id * 3 AS v")
    target = source.withColumn("v", F.when(F.col("id") == 77_777, 0).otherwise(F.col("v")))
    (r,) = coverage.differing(source, target, ["id"], few=100)
    assert r.low <= 77_777 < r.high and r.high - r.low <= 100 and r.source_rows == r.target_rows <= 100


def test_one_pass_when_nothing_differs(spark, sf, monkeypatch):
    seen, real = [], coverage._Sides.both
    monkeypatch.setattr(coverage._Sides, "both", lambda self, *a: seen.append(a) or real(self, *a))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert coverage.differing(rows, rows, ["l_orderkey", "l_linenumber"]) == []
    assert len(seen) == 2  # the bounds, and one aggregate over both sides
    plan = real(coverage._Sides(rows, rows, ["l_orderkey"], None)).groupBy(F.lit(1)).agg(*coverage._sums())._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Join" not in plan


def test_filters_of_differing_ranges_reach_the_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    sides = coverage._Sides(rows, rows, ["l_orderkey"], None)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = sides.both([coverage.Range(10, 20, 1, 1), coverage.Range(500, 600, 1, 1)], 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_orderkey,500)" in plan and "LessThan(l_orderkey,20)" in plan
    assert sides.both([coverage.Range(10, 20, 1, 1)], 0).count() == 2 * rows.where("l_orderkey >= 10 and l_orderkey < 20").count()


def test_hulls_keep_the_widest_gaps():
    ranges = [coverage.Range(a, a + 5, 0, 0) for a in (0, 10, 1000, 1010, 5000)]
    assert coverage._hulls(ranges, 3) == [(0, 15), (1000, 1015), (5000, 5005)]
    assert coverage._hulls(ranges[:1]) == [(0, 5)] and coverage._hulls(ranges, 1) == [(0, 5005)]


def test_columns_types_and_empty_tables(spark):
    source = spark.createDataFrame([(1, 2, "x")], "id int, v int, note string")
    target = spark.createDataFrame([(1, 2, "y")], "ID long, V long, note string")
    assert coverage.differing(source, target, ["id"], ["id", "v"]) == [] and coverage.uncovered(source, target, ["id"]).first()["finding"] == "changed"
    none = source.limit(0)
    assert coverage.differing(none, none, ["id"]) == [] and coverage.uncovered(none, none, ["id"]).count() == 0
    assert coverage.uncovered(source, none, ["id"]).first()["finding"] == "lost"


def test_keys_at_the_ends_of_their_type(spark):
    rows = spark.createDataFrame([(-(2**63), 1), (2**63 - 1, 2), (0, 3)], "id long, v int")
    assert coverage.differing(rows, rows, ["id"]) == []
    assert [tuple(r) for r in coverage.uncovered(rows, rows.where("id <= 0"), ["id"]).collect()] == [(2**63 - 1, "lost", 1, 0)]


def test_quantiles_of_many_runs(spark):
    """Sketches of 30 runs, merged: ranks within the stated error; few values exactly."""
    samples = spark.range(60_000).selectExpr("'t' || id % 2 AS target", "id % 30 AS run", "pow(rand(3), 4) * 100 AS seconds").persist()
    kept = metrics.sketches(samples, "seconds", "target", "run")
    assert kept.count() == 30 and max(len(r.sketch) for r in kept.collect()) < 20_000
    values = defaultdict(list)
    for r in samples.collect():
        values[r.target].append(r.seconds)
    got = metrics.quantiles(kept, "target").collect()
    assert len(got) == 6
    for r in got:
        rank = sum(v <= r.value for v in values[r.target]) / len(values[r.target])
        assert abs(rank - r.share) <= metrics.RANK_ERROR and r.n == 30_000
    few = spark.createDataFrame([("a", k % 3, float(k)) for k in range(1, 101)] + [("b", 1, 5.0), ("b", 1, None)], "target string, run long, seconds double")
    exact = {(r.target, r.share): r.value for r in metrics.quantiles(metrics.sketches(few, "seconds", "target", "run"), "target").collect()}
    assert exact["a", 0.5] == 50.0 and exact["a", 0.99] == 99.0 and exact["b", 0.95] == 5.0
