"""The staged page: positional columns, formats, statistics in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.spec import TargetSpec

#: Session format names to the type that they parse.
FORMATS = {"NLS_DATE_FORMAT": "date", "NLS_TIMESTAMP_FORMAT": "timestamp_ntz"}
_PATTERN = (("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("HH24", "HH"), ("MI", "mm"), ("SS", "ss"), (".FF6", ".SSSSSS"), (".FF", ".SSSSSS"))


def positional(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The i-th column under the i-th name, whatever it was called."""
    if columns and len(columns) != len(df.columns):
        raise ValueError(f"{len(columns)} insert columns for {len(df.columns)} selected")
    return df.toDF(*columns) if columns else df


def pattern(session_format: str) -> str:
    """A date pattern of a session format such as ``YYYY-MM-DD HH24:MI:SS``."""
    for theirs, ours in _PATTERN:
        session_format = session_format.replace(theirs, ours)
    return session_format


def coerced(text: Column, to: str, formats: dict[str, str]) -> Column:
    """A text column as ``to``, read by explicit formats instead of session state."""
    if to == "date" and "NLS_DATE_FORMAT" in formats:
        return F.to_date(text, pattern(formats["NLS_DATE_FORMAT"]))
    if to.startswith("timestamp") and "NLS_TIMESTAMP_FORMAT" in formats:
        return F.to_timestamp_ntz(text, F.lit(pattern(formats["NLS_TIMESTAMP_FORMAT"])))
    if to.startswith("decimal") and "NLS_NUMERIC_CHARACTERS" in formats:
        point, group = formats["NLS_NUMERIC_CHARACTERS"]
        return F.replace(F.replace(text, F.lit(group), F.lit("")), F.lit(point), F.lit(".")).cast(to)
    return text.cast(to)


def typed(staged: DataFrame, spec: TargetSpec) -> DataFrame:
    """A staged page with the columns of ``spec.types`` read by the target's formats."""
    if unknown := sorted(set(spec.types) - set(staged.columns)):
        raise ValueError(f"types of columns that are not staged: {', '.join(unknown)}")
    kinds = dict(staged.dtypes)
    made = {c: coerced(F.col(c), to, spec.formats) if kinds[c] == "string" else F.col(c).cast(to) for c, to in spec.types.items()}
    return staged.withColumns(made) if made else staged


def statistics(staged: DataFrame, spec: TargetSpec) -> dict:
    """rows, the largest watermark, and the last row's keys, in one aggregate."""
    last = F.max(F.struct(spec.watermarkColumn, *spec.keyColumns)).alias("last")
    row = staged.agg(F.count(F.lit(1)).alias("rows"), F.max(spec.watermarkColumn).alias("wm"), last).first()
    keys = tuple(row["last"][k] for k in spec.keyColumns) if row["rows"] else None
    return {"rows": row["rows"], "wm": row["wm"], "keys": keys}


def latest_per_key(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The last row of each key in the order of ``by``; aggregates, so hot keys combine early."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in by], *[F.col(c) for c in rest if c not in by])
    best = df.groupBy(*keys).agg(F.max(order).alias("best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"best.{c}").alias(c) for c in df.columns])
