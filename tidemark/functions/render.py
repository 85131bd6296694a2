"""Columns for display: run status, times and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTH_WORDS = ("401", "unauthorized", "authentication", "token", "session", "login")


def run_status(current: Column, success: Column, failure: Column) -> Column:
    """RUNNING, NEW, FAILED or OK; a failure counts if it is later than the last success."""
    failed = failure.isNotNull() & (success.isNull() | (failure > success))
    never = success.isNull() & failure.isNull()
    return F.when(current.isNotNull(), "RUNNING").when(never, "NEW").when(failed, "FAILED").otherwise("OK")


def rows_shown(current: Column, current_rows: Column, success_rows: Column) -> Column:
    return F.when(current.isNotNull(), current_rows).otherwise(success_rows)


def iso_utc(at: Column) -> Column:
    """An instant in UTC.  It goes through its microseconds, so the session's zone plays no part."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_micros(at).cast("decimal(20,0)") / 1_000_000)
    text = F.rpad(utc.cast("string"), 23, "0")
    whole = F.concat(F.substring(utc.cast("string"), 1, 19), F.lit(".000"))
    return F.concat(F.replace(F.when(F.length(utc.cast("string")) == 19, whole).otherwise(text), F.lit(" "), F.lit("T")), F.lit("Z"))


def duration(ms: Column) -> Column:
    """``5s`` below a minute, else ``2m 05s``."""
    seconds = F.floor(ms / 1000).cast("long")
    minutes = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.lpad((seconds % 60).cast("string"), 2, "0"), F.lit("s"))
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(minutes)


def ago(seconds: Column) -> Column:
    part = lambda by, unit: F.concat(F.floor(seconds / by).cast("long").cast("string"), F.lit(unit + " ago"))
    return F.when(seconds < 60, part(1, "s")).when(seconds < 3600, part(60, "m")).when(seconds < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def looks_like_auth(message: Column) -> Column:
    low, out = F.lower(F.coalesce(message, F.lit(""))), F.lit(False)
    for word in AUTH_WORDS:
        out = out | low.contains(word)
    return out
