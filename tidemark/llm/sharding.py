"""Shards of exact sizes, filled by a uniform shuffle through a hypergeometric communication matrix.

1. Permute locally: every input partition is written once as a run in random order;
   a row's partition and its place in the run name it from then on.
2. The matrix: how many rows each run gives to each shard.  Had all rows been
   shuffled, these counts would follow a multivariate hypergeometric law, so they are
   drawn from it, exactly: the runs are halved again and again, and the rows that a half
   gives to each shard are drawn one shard after the other.  Row sums are the runs'
   lengths and column sums the shards' sizes, whatever is drawn.
3. Exchange: the first rows of a run go to shard 0, as many as the matrix says, and so on.
4. Permute again: within its shard every row draws a random key, whose equal ranges
   are pieces of bounded size; a row's slot is its rank by key, counted over the pieces.

No Python runs in tasks.  What is sent to all executors is the matrix, up to
``MOST_CELLS`` numbers (beyond that it is joined), and the piece counts, one for each
``PIECE_ROWS`` rows.  A shard is never one task, and copies of a row, however many, are
dealt like any other rows.

Defined cases: shard sizes differ by one row at most, the larger ones first; more
shards than rows leave the last ones empty; null and empty texts, null ids and repeated
rows are rows like others; columns ``shard`` and ``slot`` of the input are replaced; an
empty table gives no rows.  The same table, read in the same partitions, is shuffled
the same way again; another seed gives another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import materialised, own, shared_path

SHARDS, SEED = 8, 11
PIECE_ROWS = 200_000
#: Numbers of a matrix that is sent to every executor: 16 MB.
MOST_CELLS = 2_000_000
#: Halvings after which the runs of a large matrix are dealt out.
_DEALT_AT = 6
#: ``monotonically_increasing_id`` has the partition above these bits, and the place below.
_PLACE_BITS = 33


def uniform(*parts) -> Column:
    """A number in [0, 1) that the given values decide."""
    h = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _steps(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(u: Column, whole: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``marked`` items are among ``drawn`` ones out of ``whole``, by inversion at ``u``.

    The probabilities' ratios are walked from near the mode in both directions, first for
    their sum and then up to ``u`` of it; no factorial is needed, so large numbers lose no
    digits.  The walk ends nine deviations and 24 steps away, where what is left is below
    the last digit of the sum."""

    def draw(x: Column) -> Column:
        whole, marked, drawn = (x[c].cast("double") for c in ("whole", "marked", "drawn"))
        rest, start = whole - marked - drawn, x["start"]
        up = lambda k: (marked - k) * (drawn - k) / ((k + 1) * (rest + k + 1))
        down = lambda k: k * (rest + k) / ((marked - k + 1) * (drawn - k + 1))
        above, below = _steps(start, x["high"] - 1), _steps(1 - start, -x["low"])

        def total(steps, ratio):
            zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
            return F.aggregate(steps, zero, lambda a, k: _let(a["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"))))["s"]

        def walk(steps, ratio, found, to, so_far, until):
            """(w, s, found): the sum of probabilities, and the first number at which it exceeds ``until``."""
            zero = F.struct(F.lit(1.0).alias("w"), so_far.alias("s"), found.cast("bigint").alias("found"))
            step = lambda a, k, w: F.struct(w.alias("w"), (a["s"] + w).alias("s"), F.coalesce(a["found"], F.when(a["s"] + w > until, to(k))).alias("found"))
            return F.aggregate(steps, zero, lambda a, k: _let(a["w"] * ratio(k), lambda w: step(a, k, w)))

        # Downward the numbers 1 - k, 2 - k, ... stand for k, k - 1, ...
        back, one = lambda k: down(F.lit(1) - k), F.lit(1.0)

        def pick(until):
            high = walk(above, up, F.when(until < one, start), lambda k: k + 1, one, until)
            both = _let(high, lambda h: walk(below, back, h["found"], lambda k: -k, h["s"], until))
            return F.coalesce(both["found"], start)

        return _let(u * (one + total(above, up) + total(below, back)), pick)

    def ranged(x: Column) -> Column:
        n, m, d = (F.greatest(x[c], F.lit(0)).cast("double") for c in ("whole", "marked", "drawn"))
        low, high = F.greatest(F.lit(0), x["drawn"] - (x["whole"] - x["marked"])), F.least(x["drawn"], x["marked"])
        mode = F.least(F.greatest(F.floor((d + 1) * (m + 1) / (n + 2)), low), high).cast("bigint")
        share = m / F.greatest(n, F.lit(1.0))
        reach = (F.ceil(9 * F.sqrt(d * share * (1 - share) * (n - d) / F.greatest(n - 1, F.lit(1.0)))) + 24).cast("bigint")
        out = [x["whole"].alias("whole"), x["marked"].alias("marked"), x["drawn"].alias("drawn"), mode.alias("start")]
        return F.struct(*out, F.greatest(low, mode - reach).cast("bigint").alias("low"), F.least(high, mode + reach).cast("bigint").alias("high"))

    given = F.struct(*[c.cast("bigint").alias(n) for c, n in ((whole, "whole"), (marked, "marked"), (drawn, "drawn"))])
    return _let(_let(given, ranged), draw)


def drawn_from(sizes: Column, drawn: Column, *seed) -> Column:
    """How many of ``drawn`` items come from each of some urns of given ``sizes``: an array."""
    zero = F.struct(F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("whole"), drawn.cast("bigint").alias("drawn"), F.array().cast("array<bigint>").alias("out"))

    def one(a: Column, x: Column) -> Column:
        took = hypergeometric(uniform(*seed, x["k"]), a["whole"], x["size"], a["drawn"])
        return _let(took, lambda k: F.struct((a["whole"] - x["size"]).alias("whole"), (a["drawn"] - k).alias("drawn"), F.array_append(a["out"], k).alias("out")))

    return F.aggregate(F.transform(sizes, lambda x, k: F.struct(x.alias("size"), k.alias("k"))), zero, one)["out"]


def matrix(runs: DataFrame, n_runs: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(run, counts): the communication matrix of ``runs`` (run, n), a row for each."""
    total = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    sizes = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.expr(f"total div {shards}") + (s < F.col("total") % shards).cast("bigint"))
    nodes = runs.agg(F.sort_array(F.collect_list(F.struct("run", "n"))).alias("runs")).where(F.size("runs") > 0)
    nodes = nodes.withColumn("total", total).select(F.lit(1).cast("bigint").alias("node"), "runs", sizes.alias("sizes"))
    for level in range((n_runs - 1).bit_length()):
        half = F.expr("size(runs) div 2")
        nodes = nodes.withColumn("left", F.slice("runs", F.lit(1), half)).withColumn("right", F.slice("runs", half + 1, F.size("runs") - half))
        given = F.aggregate("left", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
        nodes = nodes.withColumn("took", F.when(F.size("left") > 0, drawn_from(F.col("sizes"), given, seed, "node", F.col("node"))))
        child = lambda k, runs, sizes: F.struct((F.col("node") * 2 + k).alias("node"), F.col(runs).alias("runs"), sizes.alias("sizes"))
        rest = F.zip_with("sizes", "took", lambda a, b: a - b)
        halves = F.when(F.size("left") > 0, F.array(child(0, "left", F.col("took")), child(1, "right", rest))).otherwise(F.array(child(0, "runs", F.col("sizes"))))
        nodes = nodes.select(F.explode(halves).alias("x")).select("x.*")
        if level == _DEALT_AT:
            nodes = nodes.repartition("node")
    return nodes.select(F.col("runs")[0]["run"].alias("run"), F.col("sizes").alias("counts"))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``docs`` with shard and slot; slots of a shard go from 0 to its size less one."""
    spark, at = docs.sparkSession, shared_path(docs.sparkSession, "shards")
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(F.struct(*own(names)).alias("row"), F.rand(seed).alias("r")).sortWithinPartitions("r")
    rows = materialised(rows.select(F.monotonically_increasing_id().alias("at"), "row"), f"{at}/runs")
    run, place = F.shiftright("at", _PLACE_BITS).alias("run"), F.col("at").bitwiseAND((1 << _PLACE_BITS) - 1).alias("place")
    runs = materialised(rows.select(run).groupBy("run").agg(F.count(F.lit(1)).alias("n")), f"{at}/lengths")
    n_runs, total = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    drawn = matrix(runs, n_runs, shards, seed)
    ends = F.transform("counts", lambda _, k: F.aggregate(F.slice("counts", F.lit(1), k + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    drawn = materialised(drawn.select("run", ends.alias("ends")), f"{at}/matrix")
    drawn = F.broadcast(drawn) if n_runs * shards <= MOST_CELLS else drawn
    shard = F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int").alias("shard")
    # Several pieces a task even out what a hash deals to the tasks.
    pieces = max(1, -(-total // (shards * piece_rows)), -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))

    def dealt(rows: DataFrame, *more: str) -> DataFrame:
        """shard, key and piece of rows (at)."""
        rows = rows.select(run, place, *more).join(drawn, "run").select(shard, uniform(seed, "again", F.col("run"), F.col("place")).alias("key"), "run", "place", *more)
        return rows.withColumn("piece", F.floor(F.col("key") * pieces).cast("int"))

    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    heads = dealt(rows.select("at")).groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("shard", "piece").orderBy("key", "run", "place")
    placed = dealt(rows, "row").withColumn("nth", F.row_number().over(within))
    # One row for each piece, and no piece is smaller than a task's share or ``piece_rows``.
    placed = placed.join(F.broadcast(materialised(heads, f"{at}/heads")), ["shard", "piece"])
    return placed.select("row.*", "shard", (F.col("ahead") + F.col("nth") - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Write ``docs`` as shards below ``folder``, one folder each, every file a stretch of slots in order; reads them back."""
    placed = shuffled(docs, shards, seed).sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(placed.schema).parquet(folder)
