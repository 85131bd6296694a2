"""Proof that a target has its source's rows: sums of row hashes by key range.

Every row has two hashes of all its columns.  Their sums, and the numbers of rows, do not
depend on any order, so a range of keys that has the same rows on both sides has the same
sums, and one that has not differs but for a chance of about 2**-128.  Both sides are read
once for the sums of ``RANGES`` ranges.  Where all agree that is all; else only the ranges
that differ are read again, by filters on the key that reach the scan, and cut finer, until
few enough rows are left to be told apart by key.

Defined cases: the first key's values are cut into ranges if they are whole numbers, decimals,
dates or timestamps, else by a hash of all keys; null keys are keys like others and lie in
the first range; keys may repeat, and their rows are compared as a multiset; columns are
compared as the source has their types; two empty tables agree.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.merge import quoted

RANGES = 64
#: Rows of differing ranges that are compared key by key, and halvings of the ranges before they are in any case.
FEW_ROWS, MOST_LEVELS = 1_000_000, 6
_HASHES = ("a", "b")
#: Positions lie less than this apart.
_SPAN = 1 << 62


@dataclass(frozen=True)
class Range:
    """Positions from ``low`` up to ``high``, exclusive, and the rows of both sides in it."""

    low: int
    high: int
    source_rows: int
    target_rows: int


def _position(kind: T.DataType, keys: Sequence[str]) -> tuple[Column, bool]:
    """(a whole number for each row, in the order of the first key if it has one; whether it has)."""
    first = quoted(keys[0])
    if isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.precision - kind.scale <= 18:
        return F.floor(first).cast("long"), True
    if isinstance(kind, T.DateType):
        return F.unix_date(first).cast("long"), True
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(first), True
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), first), True
    return F.pmod(F.xxhash64(*map(quoted, keys)), F.lit(_SPAN)), False


def _literal(kind: T.DataType, position: int) -> Column:
    """The key's value at a position: what a filter compares with."""
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.lit(position))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(position))
    if isinstance(kind, T.TimestampNTZType):
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(position).cast("decimal(38,6)") / 1_000_000)
    return F.lit(position).cast("decimal(20,0)") if isinstance(kind, T.DecimalType) else F.lit(position)


class _Sides:
    """Both tables as one: signed numbers of rows, and signed hashes."""

    def __init__(self, source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None, hashed: bool = False):
        columns = list(columns or source.columns)
        self.keys, self.kind = list(keys), source.schema[keys[0]].dataType
        kinds = {c: source.schema[c].dataType for c in {*columns, *keys}}
        parts = []
        for df, sign in ((source, 1), (target, -1)):
            df = df.select(*[quoted(c).cast(t).alias(c) for c, t in kinds.items()])
            at, self.ordered = _position(T.NullType() if hashed else self.kind, keys)
            hashes = [F.xxhash64(F.lit(h), *[quoted(c) for c in columns], *[quoted(c).isNull() for c in columns]).alias(f"#{h}") for h in _HASHES]
            parts.append(df.select(*map(quoted, keys), at.alias("#at"), F.lit(sign).alias("#sign"), *hashes))
        self.source, self.target = parts

    def both(self, ranges: Sequence[Range] | None = None, low: int = 0) -> DataFrame:
        rows = [self.source, self.target]
        if ranges is not None:
            rows = [df.where(self._within(ranges, low)) for df in rows]
        return rows[0].unionByName(rows[1])

    def _within(self, ranges: Sequence[Range], low: int) -> Column:
        """A few ranges of the key around the given ones, which the scan can use, and the given ones."""
        key = quoted(self.keys[0])
        begin = _last_begun([r.low for r in ranges], low)
        exact = F.coalesce(F.coalesce("#at", F.lit(low)) < F.get(_numbers([r.high for r in ranges]), begin), F.lit(False))
        if not self.ordered:
            return exact
        hulls = [((key >= _literal(self.kind, a)) & (key < _literal(self.kind, b))) | (key.isNull() if a == low else F.lit(False)) for a, b in _hulls(ranges)]
        return reduce(Column.__or__, hulls) & exact


def _numbers(values: Sequence[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def _last_begun(begins: Sequence[int], low: int) -> Column:
    """Place of the last of ascending ``begins`` that a row's position is not before; -1 without one."""
    return F.size(F.filter(_numbers(begins), lambda b: b <= F.coalesce("#at", F.lit(low)))) - 1


def _hulls(ranges: Sequence[Range], most: int = 8) -> list[tuple[int, int]]:
    """At most so many ranges that hold all given ones: the widest gaps stay open."""
    gaps = sorted(range(1, len(ranges)), key=lambda k: ranges[k - 1].high - ranges[k].low)[: most - 1]
    ends = [0, *sorted(gaps), len(ranges)]
    return [(ranges[a].low, ranges[b - 1].high) for a, b in zip(ends, ends[1:])]


def _sums() -> list[Column]:
    """Rows of each side, and the signed sums of the halves of both hashes, which cannot overflow below 2**31 rows."""
    n = lambda sign: F.count_if(F.col("#sign") == sign)
    halves = [F.sum(F.col("#sign") * part).alias(f"{h}{k}") for h in _HASHES for k, part in enumerate((F.col(f"#{h}").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(F.col(f"#{h}"), 32)))]
    return [n(1).alias("source_rows"), n(-1).alias("target_rows"), *halves]


def _differs() -> Column:
    return reduce(Column.__or__, [F.col(f"{h}{k}") != 0 for h in _HASHES for k in (0, 1)], F.col("source_rows") != F.col("target_rows"))


def _merged(found: Sequence[Range]) -> list[Range]:
    """Ranges that follow each other as one."""
    out: list[Range] = []
    for r in found:
        if out and out[-1].high == r.low:
            p = out.pop()
            r = Range(p.low, r.high, p.source_rows + r.source_rows, p.target_rows + r.target_rows)
        out.append(r)
    return out


def _differing(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None, n: int, few: int) -> tuple[_Sides, list[Range], int]:
    """(both tables, the ranges in which they differ, the least position)."""
    sides = _Sides(source, target, keys, columns)
    low, high = sides.both().agg(F.min("#at"), F.max("#at")).first() if sides.ordered else (0, _SPAN - 1)
    if low is not None and high - low >= _SPAN:
        sides, low, high = _Sides(source, target, keys, columns, hashed=True), 0, _SPAN - 1
    low, high, ranges, level, held = low or 0, high or 0, None, 0, None
    spans = [(low, high + 1)]
    while True:
        found, width = [], max(1, -(-sum(b - a for a, b in spans) // n))
        cuts = [(a, min(a + width, to)) for begin, to in spans for a in range(begin, to, width)]
        # Spans are cut evenly: a row's range follows from its span's first range and its place in the span.
        firsts = list(itertools.accumulate((-(-(to - begin) // width) for begin, to in spans), initial=0))
        begins, span = [begin for begin, _ in spans], _last_begun([begin for begin, _ in spans], low)
        place = F.coalesce("#at", F.lit(low)) - F.get(_numbers(begins), span)
        number = (F.get(_numbers(firsts), span) + F.call_function("div", place, F.lit(width))).cast("int")
        for r in sides.both(ranges, low).groupBy(number.alias("#range")).agg(*_sums()).where(_differs()).orderBy("#range").collect():
            found.append(Range(*cuts[r["#range"]], r.source_rows, r.target_rows))
        ranges, level = _merged(found), level + 1
        rows = sum(r.source_rows + r.target_rows for r in ranges)
        # Differences all over are not narrowed down by cutting finer.
        if not ranges or rows <= few or width == 1 or level == MOST_LEVELS or held is not None and 2 * rows > held:
            return sides, ranges, low
        held = rows
        spans = [(r.low, r.high) for r in ranges]


def differing(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, n: int = RANGES, few: int = FEW_ROWS) -> list[Range]:
    """Ranges of the keys in which the two differ; none is the proof that the target covers its source."""
    return _differing(source, target, keys, columns, n, few)[1]


def uncovered(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, n: int = RANGES, few: int = FEW_ROWS) -> DataFrame:
    """(keys, finding, source_rows, target_rows) of all keys whose rows differ: lost and extra rows of
    a key that one side lacks, fewer or doubled ones where the numbers differ, else changed ones."""
    sides, ranges, low = _differing(source, target, keys, columns, n, few)
    s, t = F.col("source_rows"), F.col("target_rows")
    finding = F.when(t == 0, "lost").when(s == 0, "extra").when(t > s, "doubled").when(t < s, "fewer").otherwise("changed")
    rows = sides.both(ranges, low) if ranges else sides.both().where("false")
    found = rows.groupBy(*map(quoted, keys)).agg(*_sums()).where(_differs())
    return found.select(*map(quoted, keys), finding.alias("finding"), "source_rows", "target_rows")
