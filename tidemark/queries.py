"""Queries of the library's own operators, and independent SQL for their answers."""

from __future__ import annotations

import dataclasses
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import render, sqltext, statements, watermark
from tidemark.operators import coverage, intervals, paging, staging
from tidemark.operators import merge as mg
from tidemark.plans import metrics, status, validate
from tidemark.plans.pipeline import Engine, is_auth_error  # noqa: F401
from tidemark.sources import catalog, files, introspect, migrate, splits
from tidemark.sources import state as st
from tidemark.sources.snapshot import SnapshotTable
from tidemark.spec import NUMBER, Clause, TargetSpec, load
from tidemark.streaming import cursor
from tidemark.streaming.upsert import upsert_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ORDERS = TargetSpec("orders", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE /*WM*/", "t_orders", "o_orderdate", ("o_orderkey",), pageSize=1000)
LINES = TargetSpec("lines", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM lineitem WHERE /*WM*/", "t_lines", "l_shipdate", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), pageSize=1000)
EVENTS = TargetSpec("events", "SELECT event_id, ts, user_id, event_type, value FROM events WHERE /*WM*/", "t_events", "ts", ("event_id",), lookbackMinutes=60)
NUMBERED = TargetSpec("numbered", "SELECT event_id, user_id, value FROM events WHERE /*WM*/", "t_numbered", "event_id", ("event_id",), watermarkType=NUMBER, initialWm="0")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None):
    """Enter a query under its function's name, with its SQL where there is some."""
    def enter(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return enter


def sources(spark: SparkSession, sf_dir: str, *names: str) -> catalog.SourceCatalog:
    found = catalog.SourceCatalog(spark)
    for n in names:
        found.parquet(n, f"{sf_dir}/{n}.parquet")
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scans, seeks and pages.


@register("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1998-04-25 00:00:00'")
def inc_scan_first_page(spark, sf_dir):
    sources(spark, sf_dir, "orders")
    spec = dataclasses.replace(ORDERS, pageSize=None, initialWm="1998-04-25 00:00:00")
    return catalog.page(spark, spec, watermark.effective(spec, None))


@register("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1970-01-01' ORDER BY o_orderdate NULLS LAST, o_orderkey NULLS LAST LIMIT 1000")
def page_first(spark, sf_dir):
    sources(spark, sf_dir, "orders")
    return catalog.page(spark, ORDERS, watermark.effective(ORDERS, None))


@register("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1998-04-25', 500) ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def seek_page_single_key(spark, sf_dir):
    sources(spark, sf_dir, "orders")
    return catalog.page(spark, ORDERS, datetime(1998, 4, 25), (500,))


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM lineitem WHERE (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) > (TIMESTAMP '1998-04-25', 700, 3, 100, 5) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000")
def seek_page_composite_key(spark, sf_dir):
    sources(spark, sf_dir, "lineitem")
    return catalog.page(spark, LINES, datetime(1998, 4, 25), (700, 3, 100, 5))


_TRACE = "SELECT ceil(row_number() OVER (ORDER BY o_orderdate, o_orderkey) / 1000.0)::BIGINT AS page, o_orderdate, o_orderkey FROM orders"


@register(f"SELECT page, count(*) AS rows, (sum(count(*)) OVER (ORDER BY page))::BIGINT AS rows_so_far, max(o_orderdate) AS last_wm, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_o_orderkey FROM ({_TRACE}) GROUP BY page")
def page_trace(spark, sf_dir):
    sources(spark, sf_dir, "orders")
    return paging.page_trace(catalog.rows_after(spark, dataclasses.replace(ORDERS, pageSize=None), watermark.effective(ORDERS, None)), ORDERS)


@register(f"SELECT page, count(*) AS rows FROM ({_TRACE}) GROUP BY page UNION ALL SELECT count(*) // 1000 + 1, 0 FROM orders HAVING count(*) % 1000 = 0")
def page_trace_exact_multiple(spark, sf_dir):
    """A full last page is followed by an empty fetch."""
    sources(spark, sf_dir, "orders")
    rows = catalog.rows_after(spark, dataclasses.replace(ORDERS, pageSize=None), watermark.effective(ORDERS, None))
    trace = paging.page_trace(rows, ORDERS).select("page", "rows")
    last = trace.agg(F.max("page").alias("page"), F.max_by("rows", "page").alias("rows"))
    return trace.unionByName(last.where(F.col("rows") == ORDERS.pageSize).select((F.col("page") + 1).alias("page"), F.lit(0).cast("long").alias("rows")))


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM lineitem")
def pages_cover_source(spark, sf_dir):
    """Pages one after the other, together as a load publishes them: each time as many rows as there were before."""
    sources(spark, sf_dir, "lineitem")
    spec, parts, held = dataclasses.replace(LINES, pageSize=25_000), [], 0
    for page, found in paging.pages(spark, spec, watermark.effective(spec, None), None, files.fresh(spark, "pages"), lambda: held):
        parts.append(page.select(*[c for c in page.columns if c != found["page"]]))
        held += found["rows"]
    return reduce(DataFrame.unionAll, parts)


@register("SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1998-04-25' AND o_totalprice > 1000")
def marker_mid_predicate(spark, sf_dir):
    sources(spark, sf_dir, "orders")
    spec = dataclasses.replace(ORDERS, sourceQuery="SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND /*WM*/ AND o_totalprice > 1000", pageSize=None)
    return catalog.page(spark, spec, datetime(1998, 4, 25))


@register("SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts > (SELECT date_trunc('second', max(ts)) - INTERVAL 60 MINUTE FROM events)")
def lookback_rescan(spark, sf_dir):
    sources(spark, sf_dir, "events")
    last = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return catalog.page(spark, EVENTS, watermark.effective(EVENTS, last))


@register("SELECT count(*) AS n, '1970-01-01 00:00:00.000000' AS begins FROM events WHERE ts > TIMESTAMP '1970-01-01'")
def initial_wm_fallback(spark, sf_dir):
    sources(spark, sf_dir, "events")
    begins = watermark.effective(EVENTS, None)
    return catalog.page(spark, EVENTS, begins).agg(F.count(F.lit(1)).alias("n"), F.lit(watermark.render(begins)).alias("begins"))


@register("SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS wm FROM events")
def max_watermark_ts(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(watermark.rendered(F.max("ts")).alias("wm"))


@register("SELECT CAST(CAST(max(event_id) AS DECIMAL(38,10)) AS VARCHAR) AS wm FROM events")
def max_watermark_number(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max("event_id").cast(watermark.TYPES[NUMBER]).cast("string").alias("wm"))


@register("SELECT event_id, user_id, value FROM events WHERE event_id > 4321")
def number_watermark_incremental(spark, sf_dir):
    sources(spark, sf_dir, "events")
    return catalog.page(spark, NUMBERED, watermark.parse("4321", NUMBER))


@register("SELECT CAST(max(CAST(o_orderkey AS DECIMAL(38,10))) AS VARCHAR) AS wm FROM orders")
def string_staging_typed_max(spark, sf_dir):
    """The largest of numbers that are staged as text: 9 is before 10."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("n")).agg(F.max(watermark.parsed(F.col("n"), NUMBER)).cast("string").alias("wm"))


@register("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 600 OFFSET 600")
def staging_replace(spark, sf_dir):
    """After two pages staging has the second alone."""
    sources(spark, sf_dir, "orders")
    loop = paging.pages(spark, dataclasses.replace(ORDERS, pageSize=600), watermark.effective(ORDERS, None), None, files.fresh(spark, "staging"))
    next(loop)
    return next(loop)[0]


@register("SELECT c_custkey AS id, c_name AS label, c_acctbal AS amount FROM customer")
def staging_positional_map(spark, sf_dir):
    return staging.positional(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), ("id", "label", "amount"))


@register("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, o_orderdate AS t, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS n FROM orders")
def nls_coercion(spark, sf_dir):
    """Dates, times and numbers of orders as text in other formats, read back by them."""
    formats = {"NLS_DATE_FORMAT": "DD.MM.YYYY", "NLS_TIMESTAMP_FORMAT": "DD/MM/YYYY HH24:MI:SS", "NLS_NUMERIC_CHARACTERS": ",."}
    price = F.translate(F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), ",.", ".,")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("d"), F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss").alias("t"), price.alias("n"))
    typed = {c: staging.coerced(F.col(c), k, formats) for c, k in (("d", "date"), ("t", "timestamp_ntz"), ("n", "decimal(18,2)"))}
    return rows.select("o_orderkey", typed["d"].cast("string").alias("d"), typed["t"].alias("t"), typed["n"].cast("string").alias("n"))


_TEXTUAL = TargetSpec(
    "textual", "SELECT o_orderkey, o_orderdate, date_format(o_orderdate, 'dd.MM.yyyy') AS day, date_format(o_orderdate, 'dd/MM/yyyy HH:mm:ss') AS moment, translate(format_number(CAST(o_totalprice AS DECIMAL(18,2)), 2), ',.', '.,') AS price FROM orders WHERE /*WM*/",
    "t_textual", "o_orderdate", ("o_orderkey",), pageSize=50_000, types={"day": "date", "moment": "timestamp_ntz", "price": "decimal(18,2)"},
    formats={"NLS_DATE_FORMAT": "DD.MM.YYYY", "NLS_TIMESTAMP_FORMAT": "DD/MM/YYYY HH24:MI:SS", "NLS_NUMERIC_CHARACTERS": ",."},
)


@register("SELECT o_orderkey, o_orderdate, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderdate AS moment, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM orders")
def e2e_formats(spark, sf_dir):
    """A target whose source has dates and numbers as text, loaded with its own formats."""
    sources(spark, sf_dir, "orders")
    engine = Engine(spark, files.fresh(spark, "formats"))
    _must(engine.run_target(_TEXTUAL))
    return engine.read(_TEXTUAL).withColumns({"day": F.col("day").cast("string"), "price": F.col("price").cast("string")})


# Merges.


def _orders_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rows.where("o_orderkey % 3 <> 0"), rows.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)


@register("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def merge_upsert_single_key(spark, sf_dir):
    return mg.apply_merge(*_orders_merge(spark, sf_dir), ["o_orderkey"])


@register("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'seen' ELSE role END AS role, text FROM conversations WHERE conv_id % 3 <> 0 OR turn % 2 = 0")
def merge_upsert_composite_key(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return mg.apply_merge(rows.where("conv_id % 3 <> 0"), rows.where("turn % 2 = 0").withColumn("role", F.lit("seen")), ["conv_id", "turn"])


def _customers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return rows.where("c_custkey % 3 <> 0"), rows.where("c_custkey % 2 = 0").withColumn("c_acctbal", -F.col("c_acctbal"))


@register("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0")
def merge_matched_only(spark, sf_dir):
    return mg.apply_merge(*_customers(spark, sf_dir), ["c_custkey"], [Clause("matched", "update", columns={"c_acctbal": "src.c_acctbal"})])


@register("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def merge_insert_only(spark, sf_dir):
    return mg.apply_merge(*_customers(spark, sf_dir), ["c_custkey"], [Clause("not_matched", "insert")])


@register("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal FROM customer WHERE (c_custkey % 3 <> 0 OR (c_custkey % 2 = 0 AND -c_acctbal > 0)) AND NOT (c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AND c_acctbal > 5000)")
def merge_conditional_delete(spark, sf_dir):
    clauses = [Clause("matched", "delete", "tgt.c_acctbal > 5000"), Clause("matched", "update"), Clause("not_matched", "insert", "src.c_acctbal > 0")]
    return mg.apply_merge(*_customers(spark, sf_dir), ["c_custkey"], clauses)


@register("SELECT CASE WHEN o_orderkey % 3 <> 0 THEN 'update' ELSE 'insert' END AS action, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def merge_affected_counts(spark, sf_dir):
    return mg.affected(*_orders_merge(spark, sf_dir), ["o_orderkey"])


def _by_text(text: str, target: DataFrame, page: DataFrame) -> DataFrame:
    found = statements.merge(text, target.sparkSession)
    return mg.apply_merge(target, page, found.keys, found.clauses)


@register("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def merge_text_upsert(spark, sf_dir):
    """A configured MERGE text, as it stands."""
    text = """MERGE INTO T_ORDERS tgt USING STG_ORDERS src ON (tgt.O_ORDERKEY = src.O_ORDERKEY)
      WHEN MATCHED THEN UPDATE SET tgt.O_CUSTKEY = src.O_CUSTKEY, tgt.O_TOTALPRICE = src.O_TOTALPRICE
      WHEN NOT MATCHED THEN INSERT (O_ORDERKEY, O_CUSTKEY, O_TOTALPRICE) VALUES (src.O_ORDERKEY, src.O_CUSTKEY, src.O_TOTALPRICE)"""
    return _by_text(text, *_orders_merge(spark, sf_dir))


@register("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE -c_acctbal + c_acctbal END ELSE c_acctbal END AS c_acctbal FROM customer WHERE (c_custkey % 3 <> 0 OR (c_custkey % 2 = 0 AND -c_acctbal > 0)) AND NOT (c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AND c_acctbal > 5000)")
def merge_text_conditional(spark, sf_dir):
    """Conditions, a delete, expressions over both sides, other table names, and an insert whose values name no table."""
    text = """MERGE INTO crm.customers t USING staging AS s ON s.c_custkey = t.c_custkey
      WHEN MATCHED AND t.c_acctbal > 5000 THEN DELETE
      WHEN MATCHED THEN UPDATE SET c_name = upper(s.c_name), t.c_acctbal = s.c_acctbal + t.c_acctbal
      WHEN NOT MATCHED AND c_acctbal > 0 THEN INSERT (c_custkey, c_name, c_acctbal) VALUES (c_custkey, upper(c_name), s.c_acctbal)"""
    return _by_text(text, *_customers(spark, sf_dir))


@register("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def merge_idempotent_rerun(spark, sf_dir):
    target, page = _orders_merge(spark, sf_dir)
    return mg.apply_merge(mg.apply_merge(target, page, ["o_orderkey"]), page, ["o_orderkey"])


@register("SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedupe_latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return staging.latest_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


# Whole runs.


def _must(ok: bool) -> None:
    if not ok:
        raise RuntimeError("the run failed")


def flagship(spark: SparkSession, sf_dir: str, page_size: int) -> DataFrame:
    """All orders through scan, pages, staging, merge and published state."""
    sources(spark, sf_dir, "orders")
    engine, spec = Engine(spark, files.fresh(spark, "flagship")), dataclasses.replace(ORDERS, pageSize=page_size)
    _must(engine.run_target(spec))
    return engine.read(spec)


@register("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def e2e_first_load(spark, sf_dir):
    return flagship(spark, sf_dir, page_size=50_000)


@register("SELECT event_id, ts, user_id, event_type, value FROM events")
def e2e_incremental_two_runs(spark, sf_dir):
    """A run over what was there by the 15th, then one with lookback over everything."""
    engine, found = Engine(spark, files.fresh(spark, "e2e")), sources(spark, sf_dir, "events")
    whole = table(spark, sf_dir, "events")
    found.add("events", lambda: whole.where("ts <= TIMESTAMP_NTZ '2024-01-15 12:00:00'"))
    _must(engine.run_target(EVENTS))
    found.add("events", lambda: whole)
    _must(engine.run_target(EVENTS))
    return engine.read(EVENTS)


_AS_TEXT = """{"targets": [{
  "name": "orders_text", "stagingTable": "STG_ORDERS", "targetTable": "T_ORDERS", "watermarkColumn": "O_ORDERDATE", "watermarkType": "TIMESTAMP",
  "keyColumns": ["O_ORDERKEY"], "initialWm": "1970-01-01 00:00:00", "pageSize": 20000, "lookbackMinutes": 60, "group": 1,
  "sourceQuery": "SELECT O_ORDERKEY, O_CUSTKEY, O_TOTALPRICE, O_ORDERDATE FROM orders WHERE /*WM*/",
  "targetInsert": "INSERT /*+ APPEND_VALUES */ INTO STG_ORDERS (O_ORDERKEY, CUSTOMER, O_TOTALPRICE, O_ORDERDATE) VALUES (?, ?, ?, ?)",
  "targetMerge": "MERGE INTO T_ORDERS tgt USING STG_ORDERS src ON (tgt.O_ORDERKEY = src.O_ORDERKEY) WHEN MATCHED THEN UPDATE SET tgt.BUYER = src.CUSTOMER, tgt.PRICE = src.O_TOTALPRICE, tgt.ORDERED = src.O_ORDERDATE WHEN NOT MATCHED THEN INSERT (O_ORDERKEY, BUYER, PRICE, ORDERED) VALUES (src.O_ORDERKEY, src.CUSTOMER, src.O_TOTALPRICE, src.O_ORDERDATE)",
  "nlsSettings": {"NLS_DATE_FORMAT": "YYYY-MM-DD", "NLS_TIMESTAMP_FORMAT": "YYYY-MM-DD HH24:MI:SS.FF", "NLS_NUMERIC_CHARACTERS": ".,"}
}]}"""


@register("SELECT o_orderkey AS O_ORDERKEY, o_custkey AS BUYER, o_totalprice AS PRICE, o_orderdate AS ORDERED FROM orders")
def e2e_config_as_text(spark, sf_dir):
    """A configuration with INSERT and MERGE texts and session settings, loaded twice in pages."""
    sources(spark, sf_dir, "orders")
    (spec,), engine = load(_AS_TEXT).targets, Engine(spark, files.fresh(spark, "text"))
    _must(not validate.findings([spec]) and engine.run_target(spec) and engine.run_target(spec))
    return engine.read(spec)


@register("""SELECT event_id, ts, user_id, event_type, value::DOUBLE AS value, CASE WHEN ts > (SELECT date_trunc('second', max(ts)) - INTERVAL 60 MINUTE FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00') THEN props END AS props FROM events""")
def e2e_schema_evolution(spark, sf_dir):
    """A source that gains a column and wider types between two runs; what was loaded before has no value for it."""
    engine, found, whole = Engine(spark, files.fresh(spark, "evolution")), sources(spark, sf_dir, "events"), table(spark, sf_dir, "events")
    narrow = whole.where("ts <= TIMESTAMP_NTZ '2024-01-15 12:00:00'").withColumn("event_id", F.col("event_id").cast("int"))
    found.add("events", lambda: narrow)
    _must(engine.run_target(EVENTS))
    found.add("events", lambda: whole)
    _must(engine.run_target(dataclasses.replace(EVENTS, sourceQuery="SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE /*WM*/")))
    return engine.read(EVENTS)


@register("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL")
def e2e_stream_by_cursor(spark, sf_dir):
    """A stream whose offset is the cursor: orders arrive in two lots, with ties across them; it is stopped and started again between."""
    at = files.fresh(spark, "cursor")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    middle = orders.agg(F.percentile_approx("o_orderdate", 0.5)).first()[0]
    early = (F.col("o_orderdate") < F.lit(middle)) | ((F.col("o_orderdate") == F.lit(middle)) & (F.col("o_orderkey") <= 20_000))
    target = SnapshotTable(spark, f"{at}/target", 4)
    spark.dataSource.register(cursor.CursorSource)
    for rows in (orders.where(early), orders.where(~early)):
        rows.coalesce(2).write.mode("append").parquet(f"{at}/source")
        stream = spark.readStream.format("cursor").schema(orders.schema).options(path=f"{at}/source", watermark="o_orderdate", keys="o_orderkey").load()
        upsert_stream(stream, target, ["o_orderkey"], f"{at}/checkpoint", [Clause("not_matched", "insert")]).awaitTermination()
    return target.read()


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem")
def splits_cover_source(spark, sf_dir):
    """All rows, read through the disjoint predicates of sixteen balanced parts, cut by date and then by key."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    spans = splits.predicates(splits.over_rows(rows), ["l_shipdate", "l_orderkey"], 16, splits.SPARK)
    _must(len(spans) > 8)
    return reduce(DataFrame.unionAll, [rows.where(s) for s in spans])


def _crashed(spark, sf_dir, resume: str):
    """Stop after two pages of 1000, then run again in large pages."""
    sources(spark, sf_dir, "orders")
    engine, spec = Engine(spark, files.fresh(spark, "e2e")), dataclasses.replace(ORDERS, resume=resume)
    _must(not engine.run_target(spec, stop_after=2) and engine.table(spec).rows() <= 2000)
    _must(engine.run_target(dataclasses.replace(spec, pageSize=50_000)))
    return engine.read(spec)


@register("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def e2e_resume_after_crash(spark, sf_dir):
    return _crashed(spark, sf_dir, "tuple")


@register("""
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM o
WHERE k <= 2000 OR o_orderdate > (SELECT max(o_orderdate) FROM o WHERE k <= 2000)""")
def e2e_watermark_resume_tie_loss(spark, sf_dir):
    """Resuming by watermark alone, without lookback: rows tied with the last page's end stay out."""
    return _crashed(spark, sf_dir, "watermark")


# Run state.

_AT = "2026-04-17 10:00:00"
_COLUMNS = "target_name, wm_column, CAST(last_wm_timestamp AS STRING) AS wm, CAST(current_run_started AS TIMESTAMP_NTZ) AS started, current_run_id AS run_id, current_run_rows AS run_rows, CAST(last_success_finished AS TIMESTAMP_NTZ) AS success, last_success_rows AS success_rows, last_success_duration_ms AS ms, CAST(last_failure_finished AS TIMESTAMP_NTZ) AS failure, last_failure_error AS error"


def _at(minute: int):
    return F.lit(f"2026-04-17 10:{minute:02d}:00").cast("timestamp")


def _loads(spark, sf_dir) -> DataFrame:
    """One load a nation: its name and key, the rows and the last date of its customers' orders (null without any)."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = orders.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("rows"), watermark.rendered(F.max("o_orderdate")).alias("wm"))
    loads = table(spark, sf_dir, "nation").join(found, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return loads.select(F.col("n_name").alias("target_name"), F.col("n_nationkey").cast("long").alias("k"), F.coalesce("rows", F.lit(0)).alias("rows"), "wm")


def _states_of(loads: DataFrame, *steps: str) -> DataFrame:
    return _held(loads, *steps).selectExpr(*[c.strip() for c in _COLUMNS.split(", ")])


def _held(loads: DataFrame, *steps: str) -> DataFrame:
    """The loads' states after steps: every third fails before it ever began; all begin; those with
    rows make progress; even ones finish."""
    held, wm_column = st.empty(loads.sparkSession), F.lit("updated_at").alias("wm_column")
    for step in steps:
        if step == "fail":
            error = F.concat(F.lit("ORA-00942 "), F.expr("repeat('x', 3900 + 20 * int(k))")).alias("error")
            held = st.failed(held, loads.where("k % 3 = 0").select("target_name", wm_column, error, _at(7).alias("at")))
        elif step == "begin":
            held = st.begun(held, loads.select("target_name", wm_column, F.concat(F.lit("r"), "k").alias("run_id"), _at(0).alias("at")))
        elif step == "progress":
            held = st.progressed(held, loads.where("rows > 0").select("target_name", F.lit("TIMESTAMP").alias("kind"), "wm", "rows"))
        else:
            held = st.finished(held, loads.where("k % 2 = 0").select("target_name", "rows", (F.col("k") * 1000).alias("ms"), _at(5).alias("at")))
    return held


_LOADS_SQL = """
WITH loads AS (
  SELECT n_name AS target_name, n_nationkey AS k, count(o_orderkey)::BIGINT AS rows, max(o_orderdate) AS wm
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _states_sql(running: str, progressed: str, finished: str, failed: str) -> str:
    """The states' columns as CASEs over the loads; each argument says for which loads it holds."""
    when = lambda cond, value: f"CASE WHEN {cond} THEN {value} END"
    columns = {
        "wm": when(progressed, "strftime(wm, '%Y-%m-%d %H:%M:%S')"), "started": when(running, f"TIMESTAMP '{_AT}'"), "run_id": when(running, "'r' || k"),
        "run_rows": f"(CASE WHEN ({running}) AND ({progressed}) THEN rows ELSE 0 END)::BIGINT", "success": when(finished, "TIMESTAMP '2026-04-17 10:05:00'"),
        "success_rows": when(finished, "rows"), "ms": when(finished, "(k * 1000)::BIGINT"), "failure": when(failed, "TIMESTAMP '2026-04-17 10:07:00'"),
        "error": when(failed, "left('ORA-00942 ' || repeat('x', (3900 + 20 * k)::INT), 4000)"),
    }
    return f"{_LOADS_SQL} SELECT target_name, 'updated_at' AS wm_column, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM loads"


@register(f"{_LOADS_SQL} SELECT target_name, strftime(wm, '%Y-%m-%d %H:%M:%S.%f') AS wm FROM loads")
def watermark_read(spark, sf_dir):
    """What a next run of every target goes on from."""
    loads = _loads(spark, sf_dir)
    held = st.begun(st.empty(spark), loads.select("target_name", F.lit("updated_at").alias("wm_column"), F.lit("r").alias("run_id"), _at(0).alias("at")))
    return st.watermarks(st.progressed(held, loads.where("rows > 0").select("target_name", F.lit("TIMESTAMP").alias("kind"), "wm", "rows")))


@register(_states_sql("true", "false", "false", "k % 3 = 0"))
def state_begin_run(spark, sf_dir):
    return _states_of(_loads(spark, sf_dir), "fail", "begin")


@register(_states_sql("true", "rows > 0", "false", "false"))
def state_progress(spark, sf_dir):
    return _states_of(_loads(spark, sf_dir), "begin", "progress")


@register(_states_sql("k % 2 <> 0", "rows > 0", "k % 2 = 0", "k % 3 = 0"))
def state_finish_ok(spark, sf_dir):
    return _states_of(_loads(spark, sf_dir), "fail", "begin", "progress", "finish")


@register(_states_sql("k % 2 <> 0 AND k % 3 <> 0", "rows > 0", "k % 2 = 0", "k % 3 = 0"))
def state_fail(spark, sf_dir):
    """A failure closes the run; watermark and earlier success stay."""
    return _states_of(_loads(spark, sf_dir), "begin", "progress", "finish", "fail")


@register("SELECT n_name AS target_name, least(4000, 10 + 3900 + 20 * n_nationkey)::BIGINT AS n FROM nation WHERE n_nationkey % 3 = 0")
def fail_error_truncation(spark, sf_dir):
    return _states_of(_loads(spark, sf_dir), "fail").select("target_name", F.length("error").cast("long").alias("n"))


@register(f"""{_LOADS_SQL} SELECT target_name, 'updated_at' AS wm_column, CASE WHEN rows > 0 THEN strftime(wm, '%Y-%m-%d %H:%M:%S') END AS wm, NULL::TIMESTAMP AS started, NULL::VARCHAR AS run_id, 0::BIGINT AS run_rows,
  CASE WHEN k % 2 = 0 THEN TIMESTAMP '2026-04-17 10:05:00' END AS success, CASE WHEN k % 2 = 0 THEN rows END AS success_rows, CASE WHEN k % 2 = 0 THEN (k * 1000)::BIGINT END AS ms,
  CASE WHEN k % 2 <> 0 THEN TIMESTAMP '2026-04-17 12:00:00' WHEN k % 3 = 0 THEN TIMESTAMP '2026-04-17 10:07:00' END AS failure,
  CASE WHEN k % 2 <> 0 THEN '{st.STALE}' WHEN k % 3 = 0 THEN left('ORA-00942 ' || repeat('x', (3900 + 20 * k)::INT), 4000) END AS error FROM loads""")
def stale_reset(spark, sf_dir):
    """Runs that are still open when a service starts become failures; the others stay."""
    held = _held(_loads(spark, sf_dir), "fail", "begin", "progress", "finish")
    return st.reset_stale(held, F.lit("2026-04-17 12:00:00").cast("timestamp")).selectExpr(*[c.strip() for c in _COLUMNS.split(", ")])


# Status.

_PER_TARGET = """SELECT n_name AS name, CASE WHEN n_nationkey % 6 <> 5 THEN n_nationkey % 4 END AS group_id, n_nationkey AS place,
    max(CASE WHEN n_nationkey % 5 = 0 AND o_orderstatus = 'P' THEN o_orderdate END) AS current_run_started, max(CASE WHEN n_nationkey % 3 <> 0 AND o_orderstatus = 'F' THEN o_orderdate END) AS last_success_finished,
    max(CASE WHEN n_nationkey % 2 = 0 AND o_orderstatus = 'O' THEN o_orderdate END) AS last_failure_finished, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS current_run_rows,
    CASE WHEN n_nationkey % 3 <> 0 THEN count(CASE WHEN o_orderstatus = 'F' THEN 1 END) END AS last_success_rows
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name, n_nationkey"""
_STATUS = "CASE WHEN current_run_started IS NOT NULL THEN 'RUNNING' WHEN last_success_finished IS NULL AND last_failure_finished IS NULL THEN 'NEW' WHEN last_failure_finished > coalesce(last_success_finished, TIMESTAMP '0001-01-01') THEN 'FAILED' ELSE 'OK' END"
_VALUES = f"({_PER_TARGET}) t"


def _targets(spark, sf_dir) -> DataFrame:
    """A target a nation: its runs are its customers' orders, of which some are open, done or failed."""
    sources(spark, sf_dir, "nation", "customer", "orders")
    return spark.sql(_PER_TARGET)


def _states(spark, sf_dir) -> DataFrame:
    return _targets(spark, sf_dir).withColumn("status", render.run_status(*map(F.col, ("current_run_started", "last_success_finished", "last_failure_finished"))))


@register(f"SELECT name, {_STATUS} AS status FROM {_VALUES}")
def run_status(spark, sf_dir):
    return _states(spark, sf_dir).select("name", "status")


@register(f"SELECT name, CAST(CASE WHEN current_run_started IS NOT NULL THEN current_run_rows ELSE last_success_rows END AS BIGINT) AS rows_shown FROM {_VALUES}")
def status_display(spark, sf_dir):
    return _states(spark, sf_dir).select("name", render.rows_shown(*map(F.col, ("current_run_started", "current_run_rows", "last_success_rows"))).alias("rows_shown"))


@register(f"""SELECT coalesce(CAST(group_id AS VARCHAR), 'Ungrouped') AS group_name, CASE WHEN bool_or(s = 'RUNNING') THEN 'Running' WHEN bool_or(s = 'FAILED') THEN 'Failed' ELSE 'OK' END AS status,
  max(greatest(last_success_finished, last_failure_finished)) AS finished, count(*) AS targets FROM (SELECT *, {_STATUS} AS s FROM {_VALUES}) GROUP BY 1""")
def group_rollup(spark, sf_dir):
    return status.group_rollup(_states(spark, sf_dir).withColumn("finished", F.greatest("last_success_finished", "last_failure_finished")))


@register(f"""{_LOADS_SQL}, held AS (SELECT *, k % 2 <> 0 AS running, k % 2 = 0 AS ok, k % 3 = 0 AS failed FROM loads WHERE k % 7 <> 0)
SELECT n_name AS name, CASE WHEN h.k IS NULL THEN 'NEW' WHEN running THEN 'RUNNING' WHEN failed THEN 'FAILED' ELSE 'OK' END AS status,
  CASE WHEN running THEN h.rows WHEN ok THEN h.rows END AS rows_shown, CASE WHEN n_nationkey % 5 <> 0 THEN coalesce(l.rows, 0) END::BIGINT AS row_count
FROM nation LEFT JOIN held h ON h.target_name = n_name LEFT JOIN loads l ON l.k = n_nationkey""")
def status_join(spark, sf_dir):
    """Configured targets, their states and counts; a target without a state is NEW."""
    loads = _loads(spark, sf_dir)
    held = _held(loads.where("k % 7 <> 0"), "begin", "progress", "finish", "fail").where("target_name is not null")
    # What failed before it began runs again: as after a new begin.
    open_ = loads.where("k % 7 <> 0 and k % 2 <> 0").select("target_name", F.lit("updated_at").alias("wm_column"), F.lit("r").alias("run_id"), _at(9).alias("at"))
    held = st.progressed(st.begun(held, open_), loads.where("k % 7 <> 0 and k % 2 <> 0 and rows > 0").select("target_name", F.lit("TIMESTAMP").alias("kind"), "wm", "rows"))
    config = loads.select(F.col("target_name").alias("name"), (F.col("k") % 4).alias("group_id"))
    counts = loads.where("k % 5 <> 0").select(F.col("target_name").alias("name"), F.col("rows").alias("row_count"))
    return status.status(config, held, counts).select("name", "status", "rows_shown", "row_count")


@register(f"{_LOADS_SQL} SELECT target_name AS name, CASE WHEN k % 4 <> 0 THEN strftime(wm, '%Y-%m-%d %H:%M:%S.%f') END AS wm FROM loads WHERE rows > 0")
def status_unknown_target(spark, sf_dir):
    """A state whose target is not configured shows no watermark and is no error."""
    loads = _loads(spark, sf_dir).where("rows > 0")
    kinds = loads.where("k % 4 <> 0").select(F.col("target_name").alias("name"), F.lit("TIMESTAMP").alias("kind"))
    rows = _held(loads, "begin", "progress").join(kinds, F.col("target_name") == F.col("name"), "left")
    mark = F.when(F.col("kind") == "TIMESTAMP", watermark.rendered(F.col("last_wm_timestamp"))).when(F.col("kind") == NUMBER, F.col("last_wm_number").cast("string"))
    return rows.select(F.col("target_name").alias("name"), mark.alias("wm"))


@register(f"SELECT name FROM {_VALUES} WHERE contains(lower(name), 'ion_1')")
def status_name_filter(spark, sf_dir):
    return status.named_like(_states(spark, sf_dir), "IoN_1").select("name")


@register(f"SELECT dense_rank() OVER (ORDER BY group_id IS NULL, coalesce(group_id, place))::BIGINT AS step, name FROM {_VALUES}")
def group_schedule(spark, sf_dir):
    return status.schedule(_states(spark, sf_dir))


@register(f"SELECT name FROM {_VALUES} WHERE group_id = 1")
def group_filter(spark, sf_dir):
    return _states(spark, sf_dir).where("group_id = 1").select("name")


@register("SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'skipped' ELSE 'run' END AS decision FROM nation WHERE n_nationkey < 20")
def lock_partition(spark, sf_dir):
    """Of the targets asked for, those that run already are skipped."""
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_name", "name")
    return status.reserved(nations.where("n_nationkey < 20"), nations.where("n_nationkey % 4 = 0"))


# Configuration, errors, migrations.


_CONFIG = """SELECT 't' || c_custkey AS name, CASE WHEN c_custkey % 11 = 0 THEN 'OTHER' WHEN c_custkey % 3 = 0 THEN 'NUMBER' ELSE 'TIMESTAMP' END AS watermark_type,
    CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN CAST(c_acctbal AS DECIMAL(18,2))::STRING ELSE '2026-04-17 10:00:00' END AS initial_wm, c_custkey % 5 AS n_keys, c_custkey % 9 - 1 AS page_size,
    c_nationkey - 3 AS lookback, CASE WHEN c_custkey % 13 = 0 THEN 'DELETE FROM t' ELSE 'SELECT id FROM t WHERE ' END || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/*WM*/ AND /*WM*/' ELSE '/*WM*/' END AS source_query FROM customer"""


@register(f"""WITH c AS ({_CONFIG.replace('::STRING', '::VARCHAR')})
SELECT name AS target, 'watermarkType' AS about FROM c WHERE watermark_type = 'OTHER'
UNION ALL SELECT name, 'initialWm' FROM c WHERE watermark_type = 'TIMESTAMP' AND NOT regexp_full_match(initial_wm, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9:]{{8}}') OR watermark_type = 'NUMBER' AND TRY_CAST(initial_wm AS DECIMAL(38,10)) IS NULL
UNION ALL SELECT name, 'keyColumns' FROM c WHERE n_keys = 0
UNION ALL SELECT name, 'pageSize' FROM c WHERE page_size <= 0
UNION ALL SELECT name, 'lookbackMinutes' FROM c WHERE lookback < 0 OR lookback > 0 AND watermark_type = 'NUMBER'
UNION ALL SELECT name, 'sourceQuery' FROM c WHERE source_query LIKE 'DELETE%'
UNION ALL SELECT name, 'sourceQuery' FROM c WHERE (length(source_query) - length(replace(source_query, '/*WM*/', ''))) // 6 <> 1""")
def config_validate(spark, sf_dir):
    """Findings about a table of targets, one customer each."""
    sources(spark, sf_dir, "customer")
    return validate.findings_table(spark.sql(_CONFIG)).select("target", "about")


@register("SELECT 't' || (c_custkey * 7 % 100) AS name FROM customer GROUP BY 1 HAVING count(*) > 1")
def config_duplicate_names(spark, sf_dir):
    return validate.repeated_names(table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), (F.col("c_custkey") * 7 % 100).cast("string")).alias("name")))


@register("""WITH t AS (SELECT c_custkey, [x for x in ['A' || c_custkey, 'B', c_mktsegment] if c_custkey % 3 > 0 OR x <> 'B'] AS cols FROM customer WHERE c_custkey % 5 <> 0)
SELECT c_custkey, cols[i] AS column_name, i::BIGINT AS place FROM (SELECT *, unnest(range(1, len(cols) + 1)) AS i FROM t)""")
def insert_columns_extract(spark, sf_dir):
    """The columns of INSERT texts, one a customer; every fifth has no list."""
    key = F.col("c_custkey").cast("string")
    listed = F.concat(F.lit("(A"), key, F.when(F.col("c_custkey") % 3 > 0, ", B").otherwise(""), F.lit(" ,"), F.col("c_mktsegment"), F.lit(")"))
    text = F.concat(F.lit("INSERT /*+ APPEND_VALUES */ INTO STG_"), key, F.when(F.col("c_custkey") % 5 == 0, "").otherwise(listed), F.lit(" VALUES (?, ?)"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(sqltext.inserted_columns(text)).alias("k", "column_name"))
    return rows.select("c_custkey", "column_name", (F.col("k") + 1).cast("long").alias("place"))


@register("""SELECT o_orderkey, text, CASE WHEN regexp_full_match(text, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}(\\.\\d{1,6})?') THEN TRY_CAST(text AS TIMESTAMP) END AS mark FROM (
  SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.1234567' WHEN 4 THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS text FROM orders)""")
def parse_watermark_text(spark, sf_dir):
    """Order dates as text in right and wrong forms."""
    sources(spark, sf_dir, "orders")
    forms = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss'.1234567'", None, "yyyy-MM-dd HH:mm:ss"]
    text = F.col("o_orderpriority")
    for k, form in enumerate(forms):
        text = F.when(F.col("o_orderkey") % 6 == k, F.date_format("o_orderdate", form)).otherwise(text) if form else text
    return spark.table("orders").select("o_orderkey", text.alias("text")).withColumn("mark", watermark.parsed(F.col("text"), "TIMESTAMP"))


_MESSAGE = "CASE event_id % 8 WHEN 0 THEN 'HTTP 401 for ' || event_type WHEN 1 THEN 'Token of ' || user_id || ' expired' WHEN 2 THEN 'exceeded SESSION time' WHEN 3 THEN 'Login required: ' || event_type WHEN 4 THEN 'ORA-00904: ' || event_type WHEN 5 THEN props WHEN 6 THEN '' END"


@register(f"SELECT event_id, message, " + " OR ".join(f"contains(lower(coalesce(message, '')), '{w}')" for w in ("401", "unauthorized", "authentication", "token", "session", "login")) + f" AS is_auth FROM (SELECT event_id, {_MESSAGE} AS message FROM events)")
def auth_error_classify(spark, sf_dir):
    sources(spark, sf_dir, "events")
    return spark.sql(f"SELECT event_id, {_MESSAGE} AS message FROM events").withColumn("is_auth", render.looks_like_auth(F.col("message")))


@register("SELECT trim(c_name) AS id, c_custkey AS place FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def migrations_pending(spark, sf_dir):
    """A manifest with a line a customer, every fourth a comment, without those that some order has applied."""
    line = F.concat(F.when(F.col("c_custkey") % 4 == 0, "# ").otherwise("  "), F.col("c_name"), F.lit(" "))
    lines = table(spark, sf_dir, "customer").select(line.alias("line"), F.col("c_custkey").alias("place"))
    blank = lines.select(F.lit(" ").alias("line"), "place").limit(3)
    done = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("id"))
    return migrate.pending(migrate.listed(lines.unionByName(blank)), done)


@register(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count FROM {t}" for t in TABLES))
def target_row_counts(spark, sf_dir):
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("name"), "row_count") for t in TABLES])


_LOADS = {"orders": 1000, "orders_large": 2500}


def _log(spark, sf_dir) -> DataFrame:
    """The log of two loads of all orders: their pages, a retry before every fifth, and a run each."""
    sources(spark, sf_dir, "orders")
    rows = catalog.rows_after(spark, dataclasses.replace(ORDERS, pageSize=None), watermark.effective(ORDERS, None))
    traces = [paging.page_trace(rows, dataclasses.replace(ORDERS, pageSize=n)).select(F.lit(t).alias("target"), "page", "rows") for t, n in _LOADS.items()]
    pages = traces[0].unionByName(traces[1]).withColumn("seconds", F.col("page") % 10 * F.lit(0.25))
    none = F.lit(None).cast("string").alias("status")
    log = pages.select(F.lit("page").alias("event"), "target", none, "rows", F.col("rows").alias("merged"), "seconds")
    log = log.unionByName(pages.where("page % 5 = 0").select(F.lit("retry").alias("event"), "target", none, *[F.lit(0).cast(k).alias(c) for c, k in (("rows", "long"), ("merged", "long"), ("seconds", "double"))]))
    runs = pages.groupBy("target").agg(F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"))
    return log.unionByName(runs.select(F.lit("run").alias("event"), "target", F.lit("ok").alias("status"), "rows", F.lit(0).cast("long").alias("merged"), "seconds"))


_LOG_SQL = """
WITH o AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
p AS (SELECT target, page, rows, (page % 10) * 0.25::DOUBLE AS seconds FROM (""" + " UNION ALL ".join(f"SELECT '{t}' AS target, ceil(k / {n}.0)::BIGINT AS page, count(*) AS rows FROM o GROUP BY ALL" for t, n in _LOADS.items()) + """)),
log AS (
  SELECT 'page' AS event, target, NULL AS status, rows, rows AS merged, seconds FROM p
  UNION ALL SELECT 'retry', target, NULL, 0, 0, 0.0 FROM p WHERE page % 5 = 0
  UNION ALL SELECT 'run', target, 'ok', sum(rows), 0, sum(seconds) FROM p GROUP BY target
)"""


@register(f"""{_LOG_SQL}
SELECT 'etl_runs_total' AS series, target, status, count(*)::BIGINT AS value FROM log WHERE event = 'run' GROUP BY target, status
UNION ALL SELECT 'etl_rows_loaded_total', target, NULL, sum(rows)::BIGINT FROM log WHERE event = 'page' AND rows > 0 GROUP BY target
UNION ALL SELECT 'etl_rows_merged_total', target, NULL, sum(merged)::BIGINT FROM log WHERE event = 'page' AND merged > 0 GROUP BY target
UNION ALL SELECT 'etl_source_auth_retries_total', target, NULL, count(*)::BIGINT FROM log WHERE event = 'retry' GROUP BY target""")
def metrics_counters(spark, sf_dir):
    return metrics.counters(_log(spark, sf_dir))


@register(f"""{_LOG_SQL},
b(le, most) AS (VALUES ('0.1', 0.1), ('0.5', 0.5), ('1.0', 1.0), ('5.0', 5.0), ('10.0', 10.0), ('60.0', 60.0), ('600.0', 600.0), ('+Inf', 1e300)), s AS (SELECT * FROM log WHERE event = 'page')
SELECT t.target, b.le, count(s.seconds)::BIGINT AS n, t.total FROM (SELECT target, sum(seconds) AS total FROM s GROUP BY target) t CROSS JOIN b LEFT JOIN s ON s.target = t.target AND s.seconds <= b.most GROUP BY 1, 2, 4""")
def metrics_histogram(spark, sf_dir):
    return metrics.histogram(_log(spark, sf_dir).where("event = 'page'"), "seconds", "target")


@register("""SELECT row_number() OVER () AS place, column_name, CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'NUMBER' WHEN column_type = 'VARCHAR' THEN 'VARCHAR2' ELSE column_type END AS column_type,
  CASE WHEN column_name = 'o_orderkey' THEN 1::BIGINT END AS key_place FROM (DESCRIBE orders)""")
def ddl_columns(spark, sf_dir):
    return introspect.columns(spark, table(spark, sf_dir, "orders"), ["o_orderkey"])


@register(_LOG_SQL + " UNION ALL ".join(f" SELECT target, {p}::DOUBLE AS share, quantile_disc(seconds, {p}) AS value, count(*)::BIGINT AS n FROM log WHERE event = 'page' GROUP BY target" for p in (0.5, 0.95, 0.99)))
def metrics_quantiles(spark, sf_dir):
    """Quantiles of page times a target, merged from one sketch for each run (here: for each of seven stretches of its pages)."""
    pages = _log(spark, sf_dir).where("event = 'page'").withColumn("run", F.col("rows") % 3 + F.floor(F.col("seconds") * 4) % 7)
    return metrics.quantiles(metrics.sketches(pages, "seconds", "target", "run"), "target")


# Proofs of coverage, and joins by time.

_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_DAMAGED = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_orderkey % 1000 = 9 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_extendedprice, l_shipdate FROM lineitem WHERE NOT (l_orderkey % 1000 = 7 AND l_linenumber % 2 = 1)
  UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem WHERE l_orderkey % 1000 = 8
  UNION ALL SELECT -l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem WHERE l_orderkey % 2000 = 10"""
_LINE_COLUMNS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate"


@register(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n, list_sort(list(x::VARCHAR)) AS all_rows FROM (SELECT {_LINE_COLUMNS} FROM lineitem) x GROUP BY 1, 2, 3, 4),
t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n, list_sort(list(x::VARCHAR)) AS all_rows FROM ({_DAMAGED}) x GROUP BY 1, 2, 3, 4)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN t.n IS NULL THEN 'lost' WHEN s.n IS NULL THEN 'extra' WHEN t.n > s.n THEN 'doubled' WHEN t.n < s.n THEN 'fewer' ELSE 'changed' END AS finding,
  coalesce(s.n, 0)::BIGINT AS source_rows, coalesce(t.n, 0)::BIGINT AS target_rows
FROM s FULL JOIN t USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) WHERE s.all_rows IS DISTINCT FROM t.all_rows""")
def coverage_findings(spark, sf_dir):
    """Lost, doubled, changed and extra rows of a damaged copy, named by their keys."""
    sources(spark, sf_dir, "lineitem")
    return coverage.uncovered(spark.sql(f"SELECT {_LINE_COLUMNS} FROM lineitem"), spark.sql(_DAMAGED), _LINE_KEYS, few=1000)


@register("SELECT o_orderkey, 'lost' AS finding, 1::BIGINT AS source_rows, 0::BIGINT AS target_rows FROM orders WHERE o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '1995-06-01'")
def coverage_of_a_load(spark, sf_dir):
    """A target loaded from a later initial watermark, held against its source."""
    sources(spark, sf_dir, "orders")
    engine, spec = Engine(spark, files.fresh(spark, "coverage")), dataclasses.replace(ORDERS, initialWm="1995-06-01 00:00:00", pageSize=None)
    _must(engine.run_target(spec))
    return coverage.uncovered(catalog.source(spark, spec), engine.read(spec), spec.keyColumns, few=500)


@register("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), o AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase')
SELECT e.event_id, e.user_id, arg_max(o.event_id, (o.ts, o.event_id)) AS last_id, max(o.ts) AS last_ts FROM e LEFT JOIN o ON o.user_id = e.user_id AND o.ts <= e.ts GROUP BY 1, 2""")
def asof_last_event(spark, sf_dir):
    """For each purchase what its user did last before it; users of more than 50 events are cut into pieces of time."""
    kinds = table(spark, sf_dir, "events")
    bought, other = (kinds.where(w).select("event_id", "user_id", "ts") for w in ("event_type = 'purchase'", "event_type <> 'purchase'"))
    # A purchase that is there several times is one, at its last time.
    bought = bought.groupBy("event_id", "user_id").agg(F.max("ts").alias("ts"))
    found = intervals.asof(bought, other, [("user_id", "user_id")], ("ts", "ts"), ["event_id"], piece=50)
    return found.select("event_id", "user_id", F.col("last.event_id").alias("last_id"), F.col("last.ts").alias("last_ts"))


_SPANS = "SELECT o_custkey, o_orderkey, min(l_shipdate) AS begins, max(l_shipdate) AS ends FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey"


@register(f"WITH s AS ({_SPANS}) SELECT x.o_custkey, x.o_orderkey AS one, y.o_orderkey AS other FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.begins <= y.ends AND y.begins <= x.ends")
def overlapping_spans(spark, sf_dir):
    """Orders of one customer whose shipping times overlap."""
    sources(spark, sf_dir, "orders", "lineitem")
    spans = spark.sql(_SPANS)
    found = intervals.overlapping(spans, spans, [("o_custkey", "o_custkey")], (("begins", "ends"), ("begins", "ends")))
    return found.where("l.o_orderkey < r.o_orderkey").select("l.o_custkey", F.col("l.o_orderkey").alias("one"), F.col("r.o_orderkey").alias("other"))


@register("SELECT event_id, strftime(moment, '%Y-%m-%dT%H:%M:%S.') || lpad((date_part('millisecond', moment)::BIGINT % 1000)::VARCHAR, 3, '0') || 'Z' AS iso FROM (SELECT event_id, ts + to_milliseconds(event_id % 1000) AS moment FROM events)")
def iso_utc_format(spark, sf_dir):
    """Events' instants, made from their microseconds: the same text in any session zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) + F.col("event_id") % 1000 * 1000
    return table(spark, sf_dir, "events").select("event_id", render.iso_utc(F.timestamp_micros(micros)).alias("iso"))


@register("SELECT o_orderkey, ms, CASE WHEN ms // 1000 < 60 THEN (ms // 1000)::VARCHAR || 's' ELSE (ms // 60000)::VARCHAR || 'm ' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || 's' END AS shown FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 37 % 5000000)::BIGINT AS ms FROM orders)")
def format_duration(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 37 % 5_000_000).alias("ms"))
    return rows.withColumn("shown", render.duration(F.col("ms")))


@register("SELECT o_orderkey, s, CASE WHEN s < 60 THEN s::VARCHAR || 's ago' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm ago' WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'h ago' ELSE (s // 86400)::VARCHAR || 'd ago' END AS shown FROM (SELECT o_orderkey, (o_orderkey * o_orderkey % CASE WHEN o_orderkey % 2 = 0 THEN 4000 ELSE 1000000 END)::BIGINT AS s FROM orders)")
def format_relative(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") % F.when(F.col("o_orderkey") % 2 == 0, 4_000).otherwise(1_000_000)).alias("s"))
    return rows.withColumn("shown", render.ago(F.col("s")))


# Any SELECT with a marker is a source.


def _through(name: str, marked: str, duck: str | None = None) -> None:
    """A source query that is run as it stands, from the epoch."""
    mark = "ts" if "FROM events" in marked else "o_orderdate"
    spec = dataclasses.replace(ORDERS, name=name, sourceQuery=marked, watermarkColumn=mark, pageSize=None)
    used = [t for t in TABLES if t in marked]

    def run(spark, sf_dir):
        sources(spark, sf_dir, *used)
        return catalog.page(spark, spec, watermark.effective(spec, None))

    run.__name__ = name
    register((duck or marked).replace("/*WM*/", f"{mark} > TIMESTAMP '1970-01-01'"))(run)


_through("passthrough_join", "SELECT n_name, c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE /*WM*/")
_through("passthrough_semi_anti", "SELECT o_orderkey FROM orders WHERE /*WM*/ AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
_through("passthrough_agg", "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE /*WM*/ GROUP BY o_orderstatus")
_through("passthrough_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE /*WM*/ GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_through("passthrough_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE /*WM*/")
_through("passthrough_window", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders WHERE /*WM*/")
_through("passthrough_setops", "SELECT k FROM (SELECT o_custkey AS k FROM orders WHERE /*WM*/ EXCEPT SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0) x")
_through("passthrough_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events WHERE /*WM*/", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE /*WM*/")
_through("passthrough_string_date_math", "SELECT o_orderkey, upper(substring(o_orderpriority, 3)) AS p, year(o_orderdate) AS y, CAST(floor(o_totalprice / 1000) AS BIGINT) AS k FROM orders WHERE /*WM*/", "SELECT o_orderkey, upper(substring(o_orderpriority, 3)) AS p, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(floor(o_totalprice / 1000) AS BIGINT) AS k FROM orders WHERE /*WM*/")
_through("passthrough_time_window", "SELECT CAST(window(ts, '1 hour').start AS TIMESTAMP_NTZ) AS hour, count(*) AS n FROM events WHERE /*WM*/ GROUP BY window(ts, '1 hour')", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM events WHERE /*WM*/ GROUP BY 1")
