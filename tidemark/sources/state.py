"""Run state: one row per target, and the transitions of a run.

An engine's own state is a plain dict with the fields of ``SCHEMA``; a transition
returns a new one, and each is published in the target's manifest, together with the
data it is about.  The same transitions over a table of states (``SCHEMA``) take the
rows of all targets that they are about at once, as a merge by target_name.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.watermark import parse, parsed, render, rendered
from tidemark.operators.merge import apply_merge
from tidemark.spec import NUMBER, TIMESTAMP, Clause, TargetSpec

SCHEMA = """target_name string, wm_column string, last_wm_timestamp timestamp_ntz, last_wm_number decimal(38,10),
current_run_started timestamp, current_run_id string, current_run_rows long,
last_success_finished timestamp, last_success_rows long, last_success_duration_ms long,
last_failure_finished timestamp, last_failure_error string, last_keys string"""
FIELDS = [part.split()[0] for part in SCHEMA.replace("\n", " ").replace("decimal(38,10)", "decimal").split(",")]
LONGEST_ERROR = 4000
STALE = "Auto-reset: the run was still open when the service started"


def now() -> datetime:
    return datetime.now(timezone.utc)


def _iso(at: datetime) -> str:
    return at.astimezone(timezone.utc).isoformat()


def new(spec: TargetSpec) -> dict:
    return dict.fromkeys(FIELDS) | {"target_name": spec.name, "wm_column": spec.watermarkColumn}


def read_watermark(state: dict | None, spec: TargetSpec):
    """The stored watermark, typed; None without a run that got that far."""
    text = (state or {}).get("last_wm_number" if spec.watermarkType == NUMBER else "last_wm_timestamp")
    return parse(text, spec.watermarkType) if text is not None else None


def begin(state: dict | None, spec: TargetSpec, run_id: str, at: datetime) -> dict:
    """Open a run; earlier outcomes stay."""
    started = {"wm_column": spec.watermarkColumn, "current_run_started": _iso(at), "current_run_id": run_id, "current_run_rows": 0}
    return {**(state or new(spec)), **started}


def progress(state: dict, spec: TargetSpec, wm, rows: int, keys: tuple | None = None) -> dict:
    """The typed watermark and the rows of the run so far; text that is no watermark is an error."""
    text = render(parse(wm, spec.watermarkType) if isinstance(wm, str) else wm)
    column = "last_wm_number" if spec.watermarkType == NUMBER else "last_wm_timestamp"
    return {**state, column: text, "current_run_rows": rows, "last_keys": keys}


CLOSED = {"current_run_started": None, "current_run_id": None, "current_run_rows": 0}


def finish(state: dict, rows: int, duration_ms: int, at: datetime) -> dict:
    """Success; failure history and watermark stay."""
    return {**state, **CLOSED, "last_success_finished": _iso(at), "last_success_rows": rows, "last_success_duration_ms": duration_ms, "last_keys": None}


def fail(state: dict | None, spec: TargetSpec, error: str, at: datetime) -> dict:
    """Failure; success history stays.  Recorded even if the run never began."""
    return {**(state or new(spec)), **CLOSED, "last_failure_finished": _iso(at), "last_failure_error": error[:LONGEST_ERROR]}


def frame(spark: SparkSession, states: list[dict]) -> DataFrame:
    """States as rows with typed columns."""
    texts = [tuple(None if s[f] is None else str(s[f]) for f in FIELDS) for s in states]
    rows = spark.createDataFrame(texts, ", ".join(f"{f} string" for f in FIELDS))
    kinds = dict(zip(FIELDS, ("string", "string", "timestamp_ntz", "decimal(38,10)", "timestamp", "string", "bigint", "timestamp", "bigint", "bigint", "timestamp", "string", "string")))
    return rows.select(*[F.col(f).cast(kinds[f]).alias(f) for f in FIELDS])


KEY, CLOSE = ["target_name"], {"current_run_started": "NULL", "current_run_id": "NULL", "current_run_rows": "0L"}


def begun(states: DataFrame, runs: DataFrame) -> DataFrame:
    """``states`` with the runs (target_name, wm_column, run_id, at) open; earlier outcomes stay."""
    opened = {"wm_column": "src.wm_column", "current_run_started": "src.at", "current_run_id": "src.run_id", "current_run_rows": "0L"}
    clauses = [Clause("matched", "update", columns=opened), Clause("not_matched", "insert", columns=opened | {"target_name": "src.target_name"})]
    return apply_merge(states, runs, KEY, clauses)


def progressed(states: DataFrame, marks: DataFrame) -> DataFrame:
    """``states`` with the typed watermarks and the rows so far of ``marks`` (target_name, kind, wm, rows);
    text that is no watermark of its kind fails the job."""
    kind, wm = F.col("kind"), F.col("wm")
    mark = F.when(kind == NUMBER, parsed(wm, NUMBER).isNotNull()).otherwise(parsed(wm, TIMESTAMP).isNotNull())
    right = F.when(mark, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no watermark: "), F.coalesce(wm, F.lit("null")))).cast("boolean"))
    typed = marks.select("target_name", "rows", *[F.when((kind == k) & right, parsed(wm, k)).alias(n) for k, n in ((TIMESTAMP, "wm_t"), (NUMBER, "wm_n"))])
    changes = {"last_wm_timestamp": "coalesce(src.wm_t, tgt.last_wm_timestamp)", "last_wm_number": "coalesce(src.wm_n, tgt.last_wm_number)", "current_run_rows": "src.rows"}
    return apply_merge(states, typed, KEY, [Clause("matched", "update", columns=changes)])


def finished(states: DataFrame, ends: DataFrame) -> DataFrame:
    """``states`` with the runs of ``ends`` (target_name, rows, ms, at) successful; failure history stays."""
    changes = {"last_success_finished": "src.at", "last_success_rows": "src.rows", "last_success_duration_ms": "src.ms", "last_keys": "NULL"}
    return apply_merge(states, ends, KEY, [Clause("matched", "update", columns=CLOSE | changes)])


def failed(states: DataFrame, errors: DataFrame) -> DataFrame:
    """``states`` with the failures (target_name, wm_column, error, at), also of runs that never began;
    success history stays."""
    changes = CLOSE | {"last_failure_finished": "src.at", "last_failure_error": f"left(src.error, {LONGEST_ERROR})"}
    new = changes | {"target_name": "src.target_name", "wm_column": "src.wm_column"}
    return apply_merge(states, errors, KEY, [Clause("matched", "update", columns=changes), Clause("not_matched", "insert", columns=new)])


def watermarks(states: DataFrame) -> DataFrame:
    """(target_name, wm): the stored watermarks as text, null before a run got that far."""
    return states.select("target_name", F.coalesce(rendered(F.col("last_wm_timestamp")), F.col("last_wm_number").cast("string")).alias("wm"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def reset_stale(states: DataFrame, at: Column) -> DataFrame:
    """Every open run of a state table becomes a failure, in one projection."""
    stale = F.col("current_run_started").isNotNull()
    changed = {
        "last_failure_finished": F.when(stale, at).otherwise(F.col("last_failure_finished")),
        "last_failure_error": F.when(stale, F.lit(STALE)).otherwise(F.col("last_failure_error")),
        "current_run_rows": F.when(stale, F.lit(0)).otherwise(F.col("current_run_rows")).cast("long"),
        "current_run_id": F.when(~stale, F.col("current_run_id")),
        "current_run_started": F.when(~stale, F.col("current_run_started")),
    }
    return states.select(*[changed.get(c, F.col(c)).alias(c) for c in states.columns])
