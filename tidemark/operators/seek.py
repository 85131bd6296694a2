"""Keyset predicates and order: the rows after a cursor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.watermark import TYPES, render
from tidemark.spec import TargetSpec


def literal(value: object, kind: str) -> str:
    """A typed SQL literal of a cursor's value."""
    if value is None:
        return f"CAST(NULL AS {kind})"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST('{text}' AS {kind})"


def after(spec: TargetSpec, wm: object, keys: tuple | None = None, types: dict[str, str] | None = None) -> str:
    """``wm > w``, or with keys ``(wm, k1, ..., kn) > (w, v1, ..., vn)`` in lexicographic
    order, written out as ORs of ANDs so that the scan can use it; a null is never after.
    ``types`` has the keys' types; without a page size keys play no part."""
    mark = (spec.watermarkColumn, literal(render(wm), TYPES[spec.watermarkType]))
    if keys is None or spec.pageSize is None:
        return f"{mark[0]} > {mark[1]}"
    pairs = [mark, *((k, literal(v, (types or {}).get(k, "string"))) for k, v in zip(spec.keyColumns, keys))]
    steps = [" AND ".join([*(f"{c} = {v}" for c, v in pairs[:n]), f"{pairs[n][0]} > {pairs[n][1]}"]) for n in range(len(pairs))]
    return " OR ".join(f"({s})" for s in steps)


def order(spec: TargetSpec) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in (spec.watermarkColumn, *spec.keyColumns)]
