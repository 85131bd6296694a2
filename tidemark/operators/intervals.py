"""Joins by time: the last row before each row, and spans that overlap.

``asof`` sorts both sides together within a key and carries the last right row onward.  A key with
more than ``PIECE`` rows is cut into pieces of time, which are sorted apart; what the earlier pieces
end with is carried over.  A row is shuffled once, whatever its key.  The cuts are written once: they are
approximate quantiles, which come out otherwise when tasks' results meet in another order, and the rows
and what is carried over must be cut alike.

``overlapping`` gives every span a level, the power of two that its length does not exceed, so that
it lies in two bins of its level at most, and meets spans of its own and of longer levels there.
However long or short spans are, a row gets two bins for each level that occurs, and no pair is
found twice.  Adaptive execution splits bins that very many spans share.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.merge import quoted
from tidemark.sources import files

#: Rows of a key, of both sides, that are sorted in one piece.
PIECE = 1_000_000
#: Cuts of large keys that are sent to every task; beyond them they are joined.
MOST_CUTS = 500_000
_MOST_PIECES = 4_096


def asof(left: DataFrame, right: DataFrame, by: Sequence[tuple[str, str]], on: tuple[str, str], ties: Sequence[str] = (), alias: str = "last", piece: int = PIECE) -> DataFrame:
    """``left`` with ``alias``, a struct of the columns of the last row of ``right`` that has the same key
    and is not later; null where there is none.  ``by`` pairs key columns, ``on`` the times; of rows
    of one time the greatest in ``ties`` is the last.  Null keys and times meet nothing."""
    names = [f"k{i}" for i in range(len(by))]
    kinds = [left.schema[a].dataType for a, _ in by]
    when = left.schema[on[0]].dataType
    value = F.struct(*map(quoted, right.columns))
    tie = F.struct(*map(quoted, ties)) if ties else F.lit(None).cast("string")
    key = lambda side: [quoted(pair[side]).cast(k).alias(n) for pair, k, n in zip(by, kinds, names)]
    rows_l = left.select(F.struct(*map(quoted, left.columns)).alias("row"), *key(0), quoted(on[0]).alias("t"), F.lit(1).alias("side"))
    rows_r = right.select(*key(1), quoted(on[1]).cast(when).alias("t"), F.lit(0).alias("side"), tie.alias("tie"), value.alias("value")).dropna(subset=[*names, "t"])
    both = rows_l.dropna(subset=[*names, "t"]).unionByName(rows_r, allowMissingColumns=True)
    known = both.select(*names, "t")
    large = known.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece)
    most, count = large.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    carried = None
    if count:
        pieces = min(_MOST_PIECES, -(-most // piece))
        spread = lambda df: F.broadcast(df) if count * pieces <= MOST_CUTS else df
        shares = [k / pieces for k in range(1, pieces)]
        cuts = known.join(spread(large.select(*names)), names).groupBy(*names).agg(F.array_distinct(F.percentile_approx("t", shares, 10 * pieces)).alias("cuts"))
        at = files.fresh(left.sparkSession, "cuts")
        cuts.write.parquet(at)
        cuts = left.sparkSession.read.schema(cuts.schema).parquet(at)
        both = both.join(spread(cuts), names, "left").withColumn("piece", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("t"))), F.lit(0)))
        ends = both.where("side = 0 and cuts is not null").groupBy(*names, "piece").agg(F.max_by("value", F.struct("t", "tie")).alias("end"))
        # Every piece of a large key, also one that ends nothing.
        grid = cuts.select(*names, F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("piece"))
        before = Window.partitionBy(*names).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        carried = grid.join(ends, [*names, "piece"], "left").select(*names, "piece", F.last("end", True).over(before).alias("carried"))
        both = both.drop("cuts")
    else:
        both, spread = both.withColumn("piece", F.lit(0)), None
    so_far = Window.partitionBy(*names, "piece").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("own", F.last("value", True).over(so_far)).where("side = 1")
    last = F.col("own")
    if carried is not None:
        found = found.join(spread(carried), [*names, "piece"], "left")
        last = F.coalesce("own", "carried")
    found = found.select("row", last.alias(alias))
    # Rows that meet nothing share no key: they are not sorted.
    alone = rows_l.where(reduce(Column.__or__, [F.col(n).isNull() for n in (*names, "t")]))
    return found.unionByName(alone.select("row", F.lit(None).cast(found.schema[alias].dataType).alias(alias))).select("row.*", alias)


def _micros(at: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(at)
    if isinstance(kind, T.DateType):
        return F.unix_date(at).cast("long")
    if isinstance(kind, T.IntegralType):
        return at.cast("long")
    raise ValueError(f"spans are of dates, timestamps or whole numbers, not {kind.simpleString()}")


def overlapping(left: DataFrame, right: DataFrame, by: Sequence[tuple[str, str]], spans: tuple[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """(l, r): structs of the rows of both sides with the same key whose closed spans have a point in common.
    ``by`` pairs key columns, ``spans`` has the begin and end of each side.  Spans with a null or that end before
    they begin meet nothing."""
    names = [f"k{i}" for i in range(len(by))]

    def side(df: DataFrame, k: int, name: str) -> DataFrame:
        begin, end = (_micros(quoted(c), df.schema[c].dataType) for c in spans[k])
        rows = df.select(F.struct(*map(quoted, df.columns)).alias(name), *[quoted(p[k]).cast(left.schema[p[0]].dataType).alias(n) for p, n in zip(by, names)], begin.alias("a"), end.alias("b"))
        # The level's power of two is more than the length: binary digits of it.
        return rows.where("a <= b").withColumn("level", F.when(F.col("a") == F.col("b"), 0).otherwise(F.length(F.bin(F.col("b") - F.col("a")))))

    ls, rs = side(left, 0, "l"), side(right, 1, "r")
    levels = sorted(r[0] for r in ls.select("level").union(rs.select("level")).distinct().collect())  # 65 at most
    bins = lambda level: F.sequence(F.shiftright("a", level), F.shiftright("b", level))

    def at(rows: DataFrame, level: Column, which: Column, name: str, prefix: str) -> DataFrame:
        """Rows with the bins that they have at a level, one or two."""
        rows = rows.withColumn("at", which).select("*", F.explode("at").alias("on")).withColumn("first", F.expr("shiftright(a, int(on))"))
        rows = rows.select("*", F.explode(F.expr("sequence(shiftright(a, int(on)), shiftright(b, int(on)))")).alias("bin"))
        return rows.select(name, *names, "on", "bin", *[F.col(c).alias(prefix + c) for c in ("a", "b", "first")])

    every = F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")
    own = F.array("level")
    met = []
    for (home, home_name), (probe, probe_name), longer in (((rs, "r"), (ls, "l"), lambda v: v >= F.col("level")), ((ls, "l"), (rs, "r"), lambda v: v > F.col("level"))):
        a = at(home, F.col("level"), own, home_name, "h_")
        b = at(probe, F.col("level"), F.filter(every, longer), probe_name, "p_")
        # A pair that shares two bins is found in the later of the two that it shares first.
        same = F.expr("h_a <= p_b and p_a <= h_b and bin = greatest(h_first, p_first)")
        met.append(a.join(b, [*names, "on", "bin"]).where(same).select("l", "r"))
    return met[0].unionByName(met[1])
