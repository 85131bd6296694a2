"""Audit of how a language's sources differ in their vocabulary: shards counted in DuckDB, merged by Spark.

Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased.  A
language keeps the terms that at least ``LEAST_DOCS`` of its documents have; V is their
number.  A source's (or the whole language's) smoothed share of a term is
``p = 1 + floor(SCALE * (count + PLUS) / (N + PLUS * V))``, N the count of all its kept terms.

1. Every input task counts its texts' terms in DuckDB: (lang, source, term) with
   occurrences and documents.
2. The counts are dealt by a hash of lang and term.  A shard, again in DuckDB, adds
   them up and keeps the terms with enough documents, whole languages being there for
   every term.  Spark adds up N and V.
3. The kept counts are dealt the same way, with one row for each group (lang, source)
   sent to every shard.  A shard's SQL gives its part of each pair's distance and each
   group's best terms.
4. Spark adds up the distances and ranks both.

The distance of two sources is the sum of ``|p - q|`` over all kept terms.  Most terms
are in neither; so with z, a group's share of a term that it has not, a shard sums
what its terms add to ``|z1 - z2|``: for terms of one of the two by (group, count), for
terms of both by their join.  V times ``|z1 - z2|`` is added in the end.  All of it is
integers.

Memory: a task holds texts of ``SLICE`` bytes and ``HELD`` counts, a shard its share of
the counts; DuckDB spills beyond ``MEMORY`` to a folder of its own, which it clears.
Nothing passes through the driver.

Defined cases: null text, lang and source count as empty; repeated rows are documents
of their own; a group without terms has N = 0 and is compared like any other; where V is
0 distances are 0 and there are no terms; a language of one source has no pairs; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import drop, materialised, shared_path

LEAST_DOCS, TOP, PLUS, SCALE = 30, 50, 5, 1_000_000_000
#: Bytes of text that are counted at a time, and the length beyond which a text is cut between terms.
SLICE = LONG = 4 << 20
#: Counts that a task holds before it passes them on, merged.
HELD = 1_500_000
MEMORY = "400MB"
#: What stands between terms, as the text of a character class.
BETWEEN = r"\x00-\x40\x5B-\x60\x7B-\x7F"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = re.compile(f"[{BETWEEN}]")

COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long, first int"
PARTS = "part string, lang string, source string, item string, value long"

_COUNT = f"""
INSERT INTO held SELECT lang, source, term, sum(n)::BIGINT, count(*) FROM (
  SELECT r, lang, source, term, count(*) AS n FROM (
    SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^{BETWEEN}]+')) AS term FROM texts)
  GROUP BY ALL)
GROUP BY lang, source, term"""

_ADDED_UP = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL"

_KEEP = """
SELECT lang, source, term, n, (row_number() OVER (PARTITION BY lang, term) = 1)::INT AS first FROM (
  SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS in_docs FROM ({added_up}))
WHERE in_docs >= {least}"""

_SHARES = """
CREATE TEMP VIEW z AS SELECT *, (1 + {plus} * {scale}::HUGEINT // (n + {plus} * v))::BIGINT AS z FROM (SELECT DISTINCT lang, source, n, v, total FROM groups) WHERE v > 0;
CREATE TEMP TABLE p AS SELECT k.lang, k.source, k.term, z.z, (1 + {scale}::HUGEINT * (k.n + {plus}) // (z.n + {plus} * z.v))::BIGINT AS p FROM kept k JOIN z USING (lang, source);
CREATE TEMP TABLE q AS SELECT lang, term, (1 + {scale}::HUGEINT * (sum(k.n) + {plus}) // (any_value(z.total) + {plus} * any_value(z.v)))::BIGINT AS q FROM kept k JOIN z USING (lang, source) GROUP BY ALL;
"""

_PAIRS = """
WITH alone AS (
  SELECT a.lang, a.source AS s, b.source AS o, sum(m * (abs(a.p - b.z) - abs(a.z - b.z))) AS d
  FROM (SELECT lang, source, z, p, count(*) AS m FROM p GROUP BY ALL) a JOIN z b ON a.lang = b.lang AND a.source <> b.source GROUP BY ALL
), shared AS (
  SELECT a.lang, a.source AS s, b.source AS o, sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(b.p - a.z) + abs(a.z - b.z)) AS d
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
)
SELECT 'pair' AS part, lang, least(s, o) AS source, greatest(s, o) AS item, sum(d)::BIGINT AS value
FROM (FROM alone UNION ALL FROM shared) GROUP BY ALL"""

_TERMS = """
SELECT 'term' AS part, lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}"""


@contextmanager
def _duck():
    """A database of this task: one thread, bounded memory, spilling to a folder that goes with it."""
    import duckdb

    at = tempfile.mkdtemp(prefix="duck-")
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": at, "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()
        shutil.rmtree(at, ignore_errors=True)


def _do(con, sql: str) -> list[tuple]:
    """Run to the end: an open result keeps a connection from its next statement."""
    return con.execute(sql).fetchall()


def _batches(con, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_reader(50_000)


def _cut(text: str) -> Iterator[str]:
    """A long text in parts, none of which ends within a term."""
    at = 0
    while len(text) - at > LONG and (gap := _GAP.search(text, at + LONG)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """(r, lang, source, text) of a batch's rows, some at a time; long texts come in parts, with their row's number."""
    rows, held = [], 0
    for r, (lang, source, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
        for part in _cut(text):
            rows.append((r, lang, source, part))
            held += len(part)
        if held > SLICE:
            yield _table(rows)
            rows, held = [], 0
    if rows:
        yield _table(rows)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string()))], ["r", "lang", "source", "text"])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to counts; a document's rows are counted together."""
    with _duck() as con:
        _do(con, "CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for batch in batches:
            for texts in _slices(batch):
                con.register("texts", texts)
                _do(con, _COUNT)
                con.unregister("texts")
                if _do(con, "SELECT count(*) FROM held")[0][0] > HELD:
                    yield from _batches(con, _ADDED_UP)
                    _do(con, "TRUNCATE held")
        yield from _batches(con, _ADDED_UP)


def _keeper(least: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _duck() as con:
            _do(con, "CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            for batch in batches:
                con.register("counts", pa.Table.from_batches([batch]))
                _do(con, "INSERT INTO held SELECT * FROM counts")
                con.unregister("counts")
            yield from _batches(con, _KEEP.format(added_up=_ADDED_UP, least=least))

    return keep


def _comparer(top: int, plus: int, scale: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _duck() as con:
            _do(con, "CREATE TABLE dealt (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, v BIGINT, total BIGINT)")
            for batch in batches:
                con.register("more", pa.Table.from_batches([batch]))
                _do(con, "INSERT INTO dealt SELECT * FROM more")
                con.unregister("more")
            _do(con, "CREATE TEMP VIEW groups AS SELECT * FROM dealt WHERE term IS NULL; CREATE TEMP VIEW kept AS SELECT * FROM dealt WHERE term IS NOT NULL")
            _do(con, _SHARES.format(plus=plus, scale=scale))
            yield from _batches(con, _PAIRS)
            yield from _batches(con, _TERMS.format(top=top))

    return compare


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, plus: int = PLUS, scale: int = SCALE) -> DataFrame:
    """lang, source, part, item, value and rank of ``docs`` (lang, source, text): each source's
    distance to every other of its language, and the terms that it has more than its language."""
    spark, at = docs.sparkSession, shared_path(docs.sparkSession, "divergence")
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = texts.mapInArrow(count_terms, COUNTS).repartition("lang", "term")
    kept = materialised(counts.mapInArrow(_keeper(least_docs), KEPT), f"{at}/kept")

    by_lang = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("total"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = texts.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = materialised(groups.select("lang", "source", *map(zero, ("n", "v", "total"))), f"{at}/groups")

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("long")
    rows = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), "lang", "source", "term", "n", none.alias("v"), none.alias("total"))
    told = groups.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), "n", "v", "total")
    dealt = rows.unionByName(told).repartition(shards, "shard").drop("shard")
    parts = materialised(dealt.mapInArrow(_comparer(top, plus, scale), PARTS), f"{at}/parts")
    drop(spark, f"{at}/kept")

    share = F.expr(f"{plus * scale} div (n + {plus} * v) + 1")
    z = groups.select("lang", "source", "v", F.when(F.col("v") > 0, share).alias("z"))
    summed = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("d")).alias("d")
    pairs = z.alias("a").join(z.alias("b"), F.expr("a.lang = b.lang and a.source < b.source"))
    pairs = pairs.join(summed, F.expr("d.lang = a.lang and d.source = a.source and d.item = b.source"), "left")
    value = F.expr("if(a.v = 0, 0, a.v * abs(a.z - b.z) + coalesce(d.d, 0))")
    pairs = pairs.select("a.lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), value.cast("long").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    best = _ranked(parts.where("part = 'term'").select("lang", "source", "item", "value")).where(F.col("rank") <= top)
    out = _ranked(pairs).withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


def _ranked(rows: DataFrame) -> DataFrame:
    order: list[Column] = [F.col("value").desc(), F.col("item").asc()]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
