"""Findings about a configuration, all in one pass; no job runs."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import statements
from tidemark.functions.sqltext import first_word, select_columns
from tidemark.functions.watermark import parse, parsed
from tidemark.sources.catalog import source
from tidemark.spec import MARKER, NUMBER, TIMESTAMP, TargetSpec


@dataclass(frozen=True)
class Finding:
    target: str | None
    message: str


def repeated_names(config: DataFrame) -> DataFrame:
    """(name) of targets that a configuration (name) has more than once."""
    return config.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")


def findings_table(config: DataFrame) -> DataFrame:
    """(target, about) for a table of targets (name, watermark_type, initial_wm, n_keys, page_size, lookback,
    source_query): what ``findings`` says of their ranges and queries, in one projection."""
    kind, text, lookback = F.col("watermark_type"), F.col("initial_wm"), F.col("lookback")
    marks = F.size(F.split("source_query", re.escape(MARKER), -1)) - 1
    wrong = [
        ("watermarkType", ~kind.isin(TIMESTAMP, NUMBER)),
        ("initialWm", F.when(kind == NUMBER, parsed(text, NUMBER).isNull()).when(kind == TIMESTAMP, parsed(text, TIMESTAMP).isNull())),
        ("keyColumns", F.col("n_keys") == 0), ("pageSize", F.col("page_size") <= 0), ("lookbackMinutes", (lookback < 0) | ((lookback > 0) & (kind == NUMBER))),
        ("sourceQuery", ~F.upper(F.ltrim("source_query")).startswith("SELECT")), ("sourceQuery", marks != 1),
    ]
    about = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in wrong]))
    return config.select(F.col("name").alias("target"), F.explode(about).alias("about"))


def findings(specs: list[TargetSpec]) -> list[Finding]:
    """From the text alone.  Where there is a session, its parser reads the queries; INSERT and
    MERGE texts need one."""
    found = [Finding(None, f"duplicate target name '{n}'") for n, k in Counter(s.name for s in specs).items() if k > 1]
    for s in specs:
        found += [Finding(s.name, m) for m in [*_ranges(s), *_query(s), *_insert(s), *_merge(s)]]
    return found


def _ranges(s: TargetSpec):
    if s.watermarkType not in (TIMESTAMP, NUMBER):
        yield f"watermarkType must be 'TIMESTAMP' or 'NUMBER', not '{s.watermarkType}'"
    else:
        try:
            parse(s.initialWm, s.watermarkType)
        except ValueError as e:
            yield f"initialWm {e}"
    if not s.keyColumns:
        yield "keyColumns must contain at least one column"
    if s.pageSize is not None and s.pageSize <= 0:
        yield "pageSize must be positive"
    if s.lookbackMinutes is not None and s.lookbackMinutes < 0:
        yield "lookbackMinutes must be >= 0"
    if s.lookbackMinutes and s.watermarkType == NUMBER:
        yield "lookbackMinutes needs a TIMESTAMP watermark"


def _query(s: TargetSpec):
    if not s.sourceQuery.lstrip().upper().startswith("SELECT"):
        yield "sourceQuery must begin with SELECT"
    if MARKER not in s.sourceQuery:
        yield f"sourceQuery must contain '{MARKER}'"
    elif s.sourceQuery.count(MARKER) > 1:
        yield f"sourceQuery must contain '{MARKER}' once"
    names = _selected(s)
    if names is None:
        yield "could not parse SELECT column list"
        return
    if "*" in names:
        return
    have = {n.upper() for n in names}
    for kind, column in [("watermarkColumn", s.watermarkColumn), *(("keyColumn", k) for k in s.keyColumns)]:
        if column.upper() not in have:
            yield f"{kind} '{column}' is not in sourceQuery SELECT list"
    if s.insertColumns and len(s.insertColumns) != len(names):
        yield f"insertColumns count {len(s.insertColumns)} does not match sourceQuery SELECT count {len(names)}"


def _selected(s: TargetSpec) -> list[str] | None:
    """Names that the source query selects, or None."""
    if SparkSession.getActiveSession() is None or s.sourceQuery.count(MARKER) != 1:
        return select_columns(s.sourceQuery)
    try:
        return statements.select_list(s.sourceQuery)
    except statements.StatementError:
        return None


def _insert(s: TargetSpec):
    if not s.targetInsert:
        return
    if first_word(s.targetInsert) != "INSERT":
        yield "targetInsert must be an INSERT statement"
        return
    try:
        found = statements.insert(s.targetInsert)
    except statements.StatementError as e:
        yield f"could not parse column list from targetInsert: {e}"
        return
    if found.table.upper() != s.stagingTable.upper():
        yield f"targetInsert should reference stagingTable '{s.stagingTable}'"
    if not found.columns:
        yield "could not parse column list from targetInsert"
        return
    if found.placeholders != len(found.columns):
        yield f"targetInsert placeholder count ({found.placeholders}) does not match column list size ({len(found.columns)})"
    names = _selected(s)
    if names and "*" not in names and len(names) != len(found.columns):
        yield f"targetInsert column count ({len(found.columns)}) does not match sourceQuery SELECT count ({len(names)})"


def _merge_text(s: TargetSpec):
    if first_word(s.targetMerge) != "MERGE":
        yield "targetMerge must be a MERGE statement"
        return
    try:
        found = statements.merge(s.targetMerge)
    except statements.StatementError as e:
        yield f"targetMerge: {e}"
        return
    for kind, want, got in (("stagingTable", s.stagingTable, found.staging), ("targetTable", s.targetTable, found.target)):
        if want.upper() != got.upper():
            yield f"targetMerge should reference {kind} '{want}'"


def _merge(s: TargetSpec):
    if s.targetMerge:
        yield from _merge_text(s)
    if not s.merge:
        yield "merge must have at least one clause"
    for c in s.merge:
        if (c.when, c.do) not in {("matched", "update"), ("matched", "delete"), ("not_matched", "insert")}:
            yield f"merge cannot {c.do} when {c.when}"
    if any(c.upper() in (s.watermarkColumn.upper(), *map(str.upper, s.keyColumns)) for c in s.types):
        yield "types must not name the watermark column or a key: pages are cut by them as the source has them"
    if s.resume not in ("watermark", "tuple"):
        yield "resume must be 'watermark' or 'tuple'"
    if s.dedupe not in (None, "latest"):
        yield "dedupe must be null or 'latest'"
    if s.publish not in ("grow", "page"):
        yield "publish must be 'grow' or 'page'"
    if s.schema not in ("evolve", "fixed"):
        yield "schema must be 'evolve' or 'fixed'"


def analysed(spark: SparkSession, specs: list[TargetSpec]) -> list[Finding]:
    """From Spark's analysis of the queries: columns and types that really come out."""
    found = []
    for s in specs:
        try:
            types = {n.upper(): t for n, t in source(spark, s).dtypes}
        except (AnalysisException, ValueError) as e:
            found.append(Finding(s.name, f"sourceQuery does not analyse: {str(e).splitlines()[0]}"))
            continue
        for column in (s.watermarkColumn, *s.keyColumns):
            if column.upper() not in types:
                found.append(Finding(s.name, f"'{column}' is not among the columns of sourceQuery"))
        kind = types.get(s.watermarkColumn.upper(), "")
        if kind and (s.watermarkType == TIMESTAMP) != (kind.startswith("timestamp") or kind == "date"):
            found.append(Finding(s.name, f"watermarkColumn is {kind}, watermarkType {s.watermarkType}"))
    return found
