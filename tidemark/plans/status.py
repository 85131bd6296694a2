"""What is known of all targets, as joins on their states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.render import rows_shown, run_status


def status(config: DataFrame, states: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Configured targets (name, group_id) with their state, status and row count."""
    at = config.join(states, config["name"] == states["target_name"], "left")
    if counts is not None:
        at = at.join(counts.withColumnRenamed("name", "_n"), F.col("name") == F.col("_n"), "left").drop("_n")
    columns = ("current_run_started", "last_success_finished", "last_failure_finished")
    return at.withColumn("status", run_status(*map(F.col, columns))).withColumn("rows_shown", rows_shown(F.col("current_run_started"), F.col("current_run_rows"), F.col("last_success_rows")))


def named_like(targets: DataFrame, part: str) -> DataFrame:
    return targets.where(F.contains(F.lower("name"), F.lit(part.lower())))


def reserved(asked: DataFrame, running: DataFrame) -> DataFrame:
    """(name, decision) of the targets asked for: run, or skipped where one runs already."""
    busy = running.select("name", F.lit(True).alias("busy")).distinct()
    return asked.join(busy, "name", "left").select("name", F.when(F.col("busy"), "skipped").otherwise("run").alias("decision"))


def group_rollup(targets: DataFrame) -> DataFrame:
    """Per group of (group_id, status, finished): its worst status, last finish, targets."""
    running, failed = F.bool_or(F.col("status") == "RUNNING"), F.bool_or(F.col("status") == "FAILED")
    return targets.groupBy(F.coalesce(F.col("group_id").cast("string"), F.lit("Ungrouped")).alias("group_name")).agg(
        F.when(running, "Running").when(failed, "Failed").otherwise("OK").alias("status"),
        F.max("finished").alias("finished"), F.count(F.lit(1)).alias("targets"),
    )


def schedule(config: DataFrame) -> DataFrame:
    """(step, name): groups ascending, then each target without one in configured order (place)."""
    from pyspark.sql import Window

    alone = F.col("group_id").isNull()
    order = Window.orderBy(alone, F.coalesce(F.col("group_id"), F.col("place")))
    return config.select(F.dense_rank().over(order).cast("long").alias("step"), "name")
