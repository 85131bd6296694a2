"""Balanced parts against counting by hand."""

import datetime
import random
from bisect import bisect_left
from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from tidemark.sources import catalog, splits

T0 = datetime.datetime(2024, 1, 1)


def asked(values):
    held = sorted(v for v in values if v is not None)
    ends = lambda: (held[0] if held else None, held[-1] if held else None, len(held), len(values) - len(held))
    return ends, lambda bounds: [bisect_left(held, b) for b in bounds]


def sizes(values, cuts):
    held = [v for v in values if v is not None]
    return [sum((a is None or v >= a) and (b is None or v < b) for v in held) for a, b in zip([None, *cuts], [*cuts, None])]


@pytest.mark.parametrize("name", ["even", "skewed", "late", "times", "dates", "decimals", "huge"])
def test_boundaries_balance(name):
    r = random.Random(1)
    values = {
        "even": list(range(20_000)), "skewed": [int(r.paretovariate(0.6) * 1000) for _ in range(20_000)], "late": [10**9 - int(r.expovariate(1e-4)) for _ in range(20_000)],
        "times": [T0 + datetime.timedelta(seconds=r.expovariate(1e-6)) for _ in range(20_000)], "dates": [T0.date() + datetime.timedelta(days=int(r.gauss(0, 3000))) for _ in range(20_000)],
        "decimals": [Decimal(int(r.gauss(0, 1e6))).scaleb(-2) for _ in range(20_000)], "huge": [r.choice([-1, 1]) * int(2 ** r.uniform(0, 62)) for _ in range(20_000)],
    }[name]
    cuts = splits.boundaries(*asked(values), 16)
    found = sizes(values, cuts)
    assert cuts == sorted(set(cuts)) and sum(found) == len(values)
    assert len(found) == 16 and max(found) < 1.3 * len(values) / 16 and min(found) > 0.7 * len(values) / 16


@settings(deadline=None, max_examples=60)
@given(some.lists(some.one_of(some.none(), some.integers(-50, 50)), max_size=200), some.integers(1, 12))
def test_boundaries_of_anything(values, parts):
    cuts = splits.boundaries(*asked(values), parts)
    found = sizes(values, cuts)
    assert cuts == sorted(set(cuts)) and len(found) <= max(parts, 1) and sum(found) == sum(v is not None for v in values)
    if cuts:
        # No part is larger than it must be: its share, and the most frequent value beside it.
        assert max(found) <= 1.1 * sum(found) / parts * 2 + max(Counter(v for v in values if v is not None).values()) + 1


def test_one_value_few_rows_and_none():
    assert splits.boundaries(*asked([5] * 100), 4) == [] == splits.boundaries(*asked([]), 4) == splits.boundaries(*asked([None]), 4) == splits.boundaries(*asked([1, 2]), 1)
    with pytest.raises(ValueError, match="parts are cut by"):
        splits.boundaries(*asked(["a", "b"]), 2)


def test_a_frequent_value_is_cut_by_the_next_column(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") % 10 < 7, F.lit(T0)).otherwise(F.lit(T0) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("at"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, 1), (T0, None), (None, None)], "at timestamp_ntz, id long"))
    spans = splits.predicates(splits.over_rows(rows), ["at", "id"], 10, splits.SPARK)
    got = [rows.where(s).count() for s in spans]
    assert sum(got) == 10_003 and max(got) < 1_500 and rows.where(" OR ".join(f"({s})" for s in spans)).count() == 10_003


def test_reads_of_a_database_are_parallel(spark, tmp_path):
    url = "jdbc:derby:memory:splits;create=true"
    rows = spark.range(3_000).select("id", F.when(F.col("id") < 1_500, F.lit(T0)).otherwise(F.lit(T0) + F.make_dt_interval(secs=F.col("id") * F.col("id"))).cast("timestamp_ntz").alias("at"))
    rows.unionByName(spark.createDataFrame([(-1, None)], "id long, at timestamp_ntz")).write.jdbc(url, "EVENTS_SRC", mode="overwrite")
    catalog.SourceCatalog(spark).jdbc("events_src", url, "EVENTS_SRC", split_by=["at", "id"], parts=6)
    read = spark.table("events_src")
    parts = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) >= 5 and sum(parts) == 3_001 and max(parts) < 800
    assert sorted(r.id for r in read.collect()) == list(range(-1, 3_000))
    late = read.where(F.col("at") > F.lit(T0) + F.expr("interval 2000000 seconds"))
    assert late.count() == sum(k >= 1_500 and k * k > 2_000_000 for k in range(3_000))
