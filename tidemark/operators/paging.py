"""Pages in watermark and key order: one after the other, or all at once.

A load's rows are dealt by ranges of the page order, sorted, and written once with their
places; page numbers follow from the ranges' counts, so no task holds more than a range,
the source is read once for all pages, and a page is a stretch of what was written.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import seek
from tidemark.operators.staging import positional, statistics, typed
from tidemark.sources import catalog, files
from tidemark.spec import TargetSpec


def _free(name: str, columns: list[str]) -> str:
    """A helper's name that no column has."""
    while name in {c.lower() for c in columns}:
        name = "_" + name
    return name


#: ``monotonically_increasing_id`` has the partition above these bits, and the place in it below.
_PLACE_BITS = 33


def _ranged(rows: DataFrame, order: list[Column], at: str) -> tuple[DataFrame, str, str, list[tuple[int, int]]]:
    """(``rows`` in ranges of ``order``, the name of the range's column and that of the place in it, from 0;
    (range, rows before it) of all ranges).  Dealt, sorted and written once below ``at``, a folder for each
    range, so that a task that runs again sees the same ones."""
    spark, part, place = rows.sparkSession, _free("_part", rows.columns), _free("_place", rows.columns)
    at_ = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, at_)
    ranged = ranged.withColumn(part, F.shiftright(place, _PLACE_BITS).cast("int")).withColumn(place, F.col(place).bitwiseAND((1 << _PLACE_BITS) - 1))
    ranged.write.mode("overwrite").partitionBy(part).parquet(at)
    ranged = spark.read.schema(T.StructType([*(f for f in ranged.schema if f.name != part), ranged.schema[part]])).parquet(at)
    # One row for each range: as many as shuffle partitions.
    counts = sorted(map(tuple, ranged.groupBy(part).agg(F.count(F.lit(1))).collect()))
    return ranged, part, place, [(k, before) for (k, _), before in zip(counts, itertools.accumulate((n for _, n in counts), initial=0))]


def _with_page(ranged: DataFrame, part: str, place: str, heads: list[tuple[int, int]], size: int, name: str) -> DataFrame:
    """``ranged`` with the page of each row, from 1."""
    before = ranged.sparkSession.createDataFrame(heads, f"`{part}` int, `{place}_before` long")
    rows = ranged.join(F.broadcast(before), part)
    return rows.withColumn(name, F.floor((F.col(place) + F.col(f"{place}_before")) / F.lit(size)).cast("long") + 1).drop(f"{place}_before")


def pages(spark: SparkSession, spec: TargetSpec, wm: object, keys: tuple | None, staging: str, least: Callable[[], int] = lambda: 1) -> Iterator[tuple[DataFrame, dict]]:
    """(staged page, its statistics) until a page is not full; a full last page is followed by
    one empty fetch.  ``staging`` holds what this load has written; the next one replaces it.

    With ``least`` pages come together until they have so many rows, asked each time; then the
    staged rows have their page's number in the column that the statistics name as ``page``."""
    # The seek compares source columns; staging may name and type them otherwise, in the same order.
    rows = catalog.rows_after(spark, spec, wm, keys)
    if not spec.pageSize:
        typed(positional(rows, spec.insertColumns), spec).write.mode("overwrite").parquet(f"{staging}/page")
        staged = spark.read.parquet(f"{staging}/page")
        found = statistics(staged.toDF(*rows.columns), spec)
        yield staged, found | {"pages": [found["rows"]], "page": None}
        return
    files.delete(spark, staging)
    ranged, part, place, heads = _ranged(rows, seek.order(spec), f"{staging}/ranges")
    nothing = {"rows": 0, "wm": None, "keys": None, "pages": [0], "page": None}
    none = typed(positional(spark.createDataFrame([], rows.schema), spec.insertColumns), spec)
    if not heads:
        yield none, nothing
        return
    number = _free("_page", [*rows.columns, *spec.insertColumns])
    last = F.max(F.struct(spec.watermarkColumn, *spec.keyColumns)).alias("last")
    numbered = _with_page(ranged, part, place, heads, spec.pageSize, number)
    # One row for each page, which the loop has to go through anyway.
    found = numbered.groupBy(number).agg(F.count(F.lit(1)).alias("rows"), last).orderBy(number).collect()
    at = 0
    while at < len(found):
        to, held, want = at, 0, least()
        while to < len(found) and (to == at or held < want):
            held, to = held + found[to]["rows"], to + 1
        one = _read_pages(spark, f"{staging}/ranges", ranged, part, place, heads, at * spec.pageSize, to * spec.pageSize)
        together = to - at > 1
        if together:
            one = _with_page(one, part, place, heads, spec.pageSize, number)
        names = [*spec.insertColumns, *([number] if together else [])] if spec.insertColumns else ()
        one = one.select(*rows.columns, *([number] if together else []))
        end = found[to - 1]["last"]
        told = {"rows": held, "wm": end[spec.watermarkColumn], "keys": tuple(end[k] for k in spec.keyColumns)}
        yield typed(positional(one, names), spec), told | {"pages": [f["rows"] for f in found[at:to]], "page": number if together else None}
        at = to
    if found[-1]["rows"] == spec.pageSize:
        yield none, nothing


def _read_pages(spark: SparkSession, at: str, ranged: DataFrame, part: str, place: str, heads: list[tuple[int, int]], begin: int, end: int) -> DataFrame:
    """The rows of the places from ``begin`` up to ``end``: only their ranges' folders are opened."""
    befores = [before for _, before in heads]
    own = heads[bisect.bisect_right(befores, begin) - 1 : bisect.bisect_left(befores, end)]
    rows = spark.read.schema(ranged.schema).option("basePath", at).parquet(*[f"{at}/{part}={k}" for k, _ in own])
    (first, before), (final, ahead) = own[0], own[-1]
    rows = rows.where((F.col(part) > first) | (F.col(place) >= begin - before))
    return rows.where((F.col(part) < final) | (F.col(place) < end - ahead))


def page_trace(rows: DataFrame, spec: TargetSpec) -> DataFrame:
    """What the page loop over ``rows`` does, in one pass: per page its number, rows,
    running rows, last watermark and last keys."""
    ranged, part, place, heads = _ranged(rows.select(spec.watermarkColumn, *spec.keyColumns), seek.order(spec), files.fresh(rows.sparkSession, "ranges"))
    last = F.max(F.struct(spec.watermarkColumn, *spec.keyColumns)).alias("last")
    found = _with_page(ranged, part, place, heads, spec.pageSize, "page").groupBy("page").agg(F.count(F.lit(1)).alias("rows"), last)
    so_far = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    keys = [F.col(f"last.{k}").alias(f"last_{k}") for k in spec.keyColumns]
    return found.select("page", "rows", F.sum("rows").over(so_far).alias("rows_so_far"), F.col(f"last.{spec.watermarkColumn}").alias("last_wm"), *keys)
