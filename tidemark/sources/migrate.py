"""Forward-only migrations with a ledger of those applied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.sqltext import statement
from tidemark.sources import files


def manifest_ids(text: str) -> list[str]:
    """Ids in order: blank lines and lines that begin with # do not count."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]


def listed(lines: DataFrame) -> DataFrame:
    """``manifest_ids`` of a table of lines (line, place): (id, place)."""
    ids = lines.select(F.trim("line").alias("id"), "place")
    return ids.where((F.col("id") != "") & ~F.col("id").startswith("#"))


def pending(ids: DataFrame, applied: DataFrame) -> DataFrame:
    """(id, place) of the manifest that the ledger lacks, in manifest order."""
    return ids.join(applied, "id", "left_anti").orderBy("place")


#: What a statement may find already done: it counts as applied.
THERE = ("TABLE_OR_VIEW_ALREADY_EXISTS", "SCHEMA_ALREADY_EXISTS", "FIELD_ALREADY_EXISTS", "TEMP_TABLE_OR_VIEW_ALREADY_EXISTS")


def apply_once(spark: SparkSession, text: str) -> bool:
    """Run a statement; False if what it makes is there already.  Any other error is raised."""
    try:
        spark.sql(statement(text))
    except AnalysisException as e:
        if e.getCondition() not in THERE:
            raise
        return False
    return True


def migrate(spark: SparkSession, folder: str, ids: list[str], read: Callable[[str], str]) -> list[str]:
    """Apply what the ledger in ``folder`` lacks, in order; each is recorded before the next runs.
    One that was run but not recorded finds its work done and is recorded now."""
    done = set(files.names(spark, folder))
    ran = []
    for name in ids:
        if name not in done:
            apply_once(spark, read(name))
            files.publish(spark, f"{folder}/{name}", name)
            ran.append(name)
    return ran
