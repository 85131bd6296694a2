"""Balanced parts of a table for a parallel read: boundaries found by counting, disjoint predicates.

A database reads a table in parallel only by predicates that somebody gives.  Here they come from
the data: a boundary is narrowed down by asking how many rows lie before some values, for all
boundaries in one query a round; where the column has an index, that is what the query reads.
Comparisons and counts are all that is asked, so any database can answer.  A value that has more
rows than a part is cut by the next column.

Parts cover the table and do not overlap, whatever the counts were when they were taken: rows that
come later fall into a part like others.  Null values lie in the first part of their column.
"""

from __future__ import annotations

import bisect
import datetime
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values between the ends of each boundary that a round asks about; a part's size against the mean that is good enough; rounds at most.
PROBES, TOLERANCE, ROUNDS = 4, 0.1, 40
#: Boundaries asked about in one query.
_AT_ONCE = 200

#: Asks for (least value, greatest value, rows with a value, rows without).
Ends = Callable[[], tuple]
#: Asks how many rows have a value below each given one.
Below = Callable[[Sequence[object]], list[int]]


def _number(value):
    """A value as a number that can be halved, and the way back."""
    if isinstance(value, datetime.datetime):
        zero = datetime.datetime(1970, 1, 1, tzinfo=value.tzinfo)
        return (value - zero) // datetime.timedelta(microseconds=1), lambda n: zero + datetime.timedelta(microseconds=n)
    if isinstance(value, datetime.date):
        return value.toordinal(), datetime.date.fromordinal
    if isinstance(value, Decimal):
        unit = value.as_tuple().exponent
        return int(value.scaleb(-unit)), lambda n: Decimal(n).scaleb(unit)
    if isinstance(value, int):
        return value, lambda n: n
    raise ValueError(f"parts are cut by whole numbers, decimals, dates and timestamps, not {type(value).__name__}")


def boundaries(ends: Ends, below: Below, parts: int) -> list:
    """Ascending values that cut a column's rows into ``parts`` of about equal size; fewer where values are too frequent."""
    low, high, rows, _ = ends()
    if not rows or parts < 2 or low == high:
        return []
    if isinstance(low, Decimal):  # one unit for both ends
        unit = min(low.as_tuple().exponent, high.as_tuple().exponent)
        low, high = (x.quantize(Decimal(1).scaleb(unit)) for x in (low, high))
    (a, back), (b, _) = _number(low), _number(high)
    known = {a: 0, b + 1: rows}
    wanted = [rows * k / parts for k in range(1, parts)]
    good = TOLERANCE * rows / parts
    for _ in range(ROUNDS):
        at, asked = sorted(known), set()
        for want in wanted:
            k = bisect.bisect_left([known[x] for x in at], want)
            begin, end = at[max(0, k - 1)], at[min(k, len(at) - 1)]
            if min(abs(known[begin] - want), abs(known[end] - want)) <= good:
                continue
            asked |= {begin + (end - begin) * j // (PROBES + 1) for j in range(1, PROBES + 1)} - {begin, end}
        asked = sorted(asked - known.keys())
        if not asked:
            break
        for k in range(0, len(asked), _AT_ONCE):
            some = asked[k : k + _AT_ONCE]
            known |= dict(zip(some, below([back(x) for x in some])))
    nearest = {min(known, key=lambda x: (abs(known[x] - want), x)) for want in wanted}
    return [back(x) for x in sorted(nearest) if a < x <= b]


@dataclass(frozen=True)
class Dialect:
    """Names and values as a database's SQL has them."""

    name: Callable[[str], str]
    literal: Callable[[object], str]


def _escape(value) -> str:
    """JDBC's own notation of times, which every driver translates."""
    if isinstance(value, datetime.datetime):
        return "{ts '" + value.strftime("%Y-%m-%d %H:%M:%S.%f") + "'}"
    return "{d '" + value.isoformat() + "'}" if isinstance(value, datetime.date) else str(value)


def _typed(value) -> str:
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP{'_NTZ' if value.tzinfo is None else ''} '{value.replace(tzinfo=None)}'"
    return f"DATE '{value}'" if isinstance(value, datetime.date) else str(value)


JDBC = Dialect(lambda n: '"' + n.replace('"', '""') + '"', _escape)
SPARK = Dialect(lambda n: "`" + n.replace("`", "``") + "`", _typed)


def predicates(ask: Callable[[list[str], str], tuple], columns: Sequence[str], parts: int, dialect: Dialect = JDBC, where: str = "1 = 1") -> list[str]:
    """Disjoint predicates that cover all rows of ``where``.  ``ask`` answers a list of aggregates over the rows of a predicate."""
    name = dialect.name(columns[0])
    ends = lambda: ask([f"MIN({name})", f"MAX({name})", f"COUNT({name})", f"COUNT(*) - COUNT({name})"], where)
    below = lambda values: [n or 0 for n in ask([f"SUM(CASE WHEN {name} < {dialect.literal(v)} THEN 1 ELSE 0 END)" for v in values], where)]
    cuts = boundaries(ends, below, parts)
    if not cuts:
        return [where]
    shown = [dialect.literal(v) for v in cuts]
    spans = [f"({name} < {shown[0]} OR {name} IS NULL)", *(f"({name} >= {a} AND {name} < {b})" for a, b in zip(shown, shown[1:])), f"{name} >= {shown[-1]}"]
    spans = spans if where == "1 = 1" else [f"{where} AND {s}" for s in spans]
    if len(columns) == 1:
        return spans
    # A part that is much too large holds a frequent value, which the next column cuts.
    sizes = ask([f"SUM(CASE WHEN {s} THEN 1 ELSE 0 END)" for s in spans], where)
    share, out = sum(n or 0 for n in sizes) / parts, []
    for span, n in zip(spans, sizes):
        more = round((n or 0) / share) if share else 1
        out += predicates(ask, columns[1:], more, dialect, span) if more > 1 else [span]
    return out


def over_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> Callable[[list[str], str], tuple]:
    """Asks a database, one query each time."""
    def ask(aggregates: list[str], where: str) -> tuple:
        # Names of the columns do not matter, but there must be some.
        named = ", ".join(f"{a} AS c{k}" for k, a in enumerate(aggregates))
        query = f"SELECT {named} FROM {table} WHERE {where}"
        return tuple(spark.read.format("jdbc").options(url=url, query=query, preferTimestampNTZ="true", **options).load().first())

    return ask


def over_rows(rows: DataFrame) -> Callable[[list[str], str], tuple]:
    """Asks a DataFrame."""
    return lambda aggregates, where: tuple(rows.where(where).agg(*[F.expr(a).alias(f"c{k}") for k, a in enumerate(aggregates)]).first())
