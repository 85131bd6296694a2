"""Joins by time against loops over all pairs."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals

T0 = datetime.datetime(2024, 1, 1)


def rows(seed, n):
    r = random.Random(seed)
    key = lambda: r.choice([None, "hot", "hot", "hot", "a", "b", "c"])
    return [(k, key(), r.choice([None] + [T0 + datetime.timedelta(seconds=s) for s in range(60)])) for k in range(n)]


def last_before(left, right):
    out = []
    for k, key, t in left:
        found = [(u, j) for j, other, u in right if key is not None and other == key and None not in (t, u) and u <= t]
        out.append((k, max(found)[1] if found else None))
    return sorted(out)


@pytest.mark.parametrize("piece", [1, 7, 40, 10_000])
def test_asof(spark, piece):
    left, right = rows(1, 150), rows(2, 200)
    l_ = spark.createDataFrame(left, "id long, key string, at timestamp_ntz").withColumn("t", F.lit("clash")).repartition(3)
    r_ = spark.createDataFrame(right, "id long, who string, at timestamp_ntz").withColumn("piece", F.lit("clash"))
    got = intervals.asof(l_, r_, [("key", "who")], ("at", "at"), ["id"], piece=piece)
    assert got.columns == ["id", "key", "at", "t", "last"]
    assert sorted((r.id, r.last and r.last.id) for r in got.collect()) == last_before(left, right)


def test_asof_with_whole_numbers_several_keys_and_nothing(spark):
    left = spark.createDataFrame([(1, "x", 5), (2, "x", 1), (1, "y", 9)], "a int, b string, n int")
    right = spark.createDataFrame([(1, "x", 5, "five"), (1, "x", 2, "two"), (1, "y", 10, "late")], "a long, b string, m long, v string")
    got = intervals.asof(left, right, [("a", "a"), ("b", "b")], ("n", "m"), alias="found")
    assert sorted((r.a, r.b, r.found and r.found.v) for r in got.collect()) == [(1, "x", "five"), (1, "y", None), (2, "x", None)]
    assert intervals.asof(left, right.limit(0), [("a", "a")], ("n", "m")).where("last is not null").count() == 0
    assert intervals.asof(left.limit(0), right, [("a", "a")], ("n", "m")).count() == 0


def test_a_hot_key_is_sorted_in_pieces(spark):
    """No task of the window has a whole hot key, and rows move once."""
    left = spark.range(3000).selectExpr("id", "if(id % 3 > 0, 'hot', string(id)) AS key", "id AS n")
    right = spark.range(3000).selectExpr("id", "if(id % 3 > 0, 'hot', string(id)) AS key", "id * 2 AS n")
    got = intervals.asof(left, right, [("key", "key")], ("n", "n"), ["id"], piece=300)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k0#" in plan and ", piece#" in plan
    want = {k: next((j for j in range(k // 2, -1, -1) if (j % 3 > 0 if k % 3 > 0 else j == k)), None) for k in range(3000)}
    assert {r.id: r.last and r.last.id for r in got.collect()} == want


def test_a_hot_key_is_cut_alike_wherever_the_cuts_are_used(spark):
    """Rows that are dealt to other tasks each time they are computed, as results of tasks meet in another order on a cluster."""
    def dealt(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([random.random() for _ in range(b.num_rows)])], ["id", "n", "deal"])

    left, right = [spark.range(n).selectExpr("id", time).mapInArrow(dealt, "id long, n long, deal double").repartition(4, "deal").selectExpr("id", "'hot' AS key", "n") for n, time in ((6000, "id * 7 % 6007 AS n"), (1500, "id * 4 AS n"))]
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = intervals.asof(left, right, [("key", "key")], ("n", "n"), ["id"], piece=50)
        assert {r.id: r.last.id for r in got.collect()} == {k: min(k * 7 % 6007 // 4, 1499) for k in range(6000)}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def spans(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        a = T0 + datetime.timedelta(seconds=r.randint(0, 5000))
        length = r.choice([0, 1, 5, 60, 900, 4000, -3])
        out.append((k, r.choice([None, "hot", "hot", "a"]), r.choice([None] + [a] * 9), a + datetime.timedelta(seconds=length)))
    return out


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "bigint", "date"])
def test_overlaps(spark, kind):
    one, other = spans(1, 90), spans(2, 110)
    as_ = {"bigint": lambda t: None if t is None else int((t - T0).total_seconds()) - 2000, "date": lambda t: t and (T0 + datetime.timedelta(days=int((t - T0).total_seconds() // 60))).date()}.get(kind, lambda t: t)
    one, other = ([(k, key, as_(a), as_(b)) for k, key, a, b in rows_] for rows_ in (one, other))
    made = [spark.createDataFrame(x, f"id long, key string, a {kind}, b {kind}").withColumn("bin", F.lit("clash")).repartition(2) for x in (one, other)]
    got = intervals.overlapping(*made, [("key", "key")], (("a", "b"), ("a", "b")))
    want = sorted((x[0], y[0]) for x in one for y in other if x[1] is not None and x[1] == y[1] and None not in (x[2], y[2]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r.l.id, r.r.id) for r in got.collect()) == want and len(want) > 200
    assert "Cartesian" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_a_span_has_few_bins_however_long(spark):
    long = spark.createDataFrame([(1, "k", 0, 2**40)], "id long, key string, a long, b long")
    short = spark.range(50).selectExpr("id", "'k' AS key", "id * 1000 AS a", "id * 1000 + 3 AS b")
    assert intervals.overlapping(long, short, [("key", "key")], (("a", "b"), ("a", "b"))).count() == 50
    assert intervals.overlapping(short, long, [("key", "key")], (("a", "b"), ("a", "b"))).count() == 50
    with pytest.raises(ValueError, match="spans are of"):
        intervals.overlapping(short.withColumn("a", F.col("a").cast("string")), long, [("key", "key")], (("a", "b"), ("a", "b")))
    assert intervals.overlapping(short.limit(0), long.limit(0), [("key", "key")], (("a", "b"), ("a", "b"))).count() == 0
