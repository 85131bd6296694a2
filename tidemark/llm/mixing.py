"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies,
``target / source_size``.  Documents of a source stand in order of size, then
``doc_id``; the prefix sum of expected copies plus one random offset per source
crosses some integers, and a document is emitted once for each that it crosses.
The order by size keeps the words taken within about one document of the target.

The prefix sum is distributed: rows are dealt by ranges of (source, size,
doc_id), so a source with a third of all rows is spread over many ranges; only
the counts per range and source are summed ahead, and each range adds its own
part.  The text itself never moves for the decision.

Defined cases: null text has size 0 and is never emitted; a null source is a
source of its own, last in the order of weights; rows that are the same in
(doc_id, source, size) share their copies, in the order of their texts' hashes and
then of all they hold, so reruns agree; doc_id may have any type that can be
ordered; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import drop, materialised, own, shared_path

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> the same with target: weights repeat over the
    sources by code point, all sizes are shared out, no target exceeds ``cap``
    times its source's size, and what a source cannot take goes to the others by weight.

    Sources in order of cap/weight: those that are capped come first, so running
    sums over that order tell for each whether it is.  One row per source, after
    aggregation; integers stay exact as decimals.
    """
    big = "decimal(38,0)"
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    place = (F.row_number().over(by_name) - 1) % len(weights) + 1
    sizes = (
        sizes.withColumn("weight", F.element_at(F.array(*(F.lit(int(w)) for w in weights)), place).cast(big))
        .withColumn("most", (F.col("source_size") * cap).cast(big))
        .withColumn("ratio", F.col("most").cast("double") / F.col("weight").cast("double"))
        .withColumn("total", F.sum("source_size").over(everything).cast(big))
        .withColumn("weights", F.sum("weight").over(everything).cast(big))
        .withColumn("most_before", F.coalesce(F.sum("most").over(before), F.lit(0)).cast(big))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)).cast(big))
    )
    left, free = F.col("total") - F.col("most_before"), F.col("weights") - F.col("weight_before")
    sizes = sizes.withColumn("capped", (F.col("most") * free).cast(big) < (F.col("weight") * left).cast(big))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0))
    share = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.lit(0))
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(
        (F.col("weight") * rest).cast(big).cast("double") / F.nullif(share, F.lit(0)).cast("double")
    )
    return sizes.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only the seed and the source's name decide."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), name)), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix_copies(
    docs: DataFrame, size: Column | None = None, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED
) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, source, size, source_size, target, copies."""
    spark = docs.sparkSession
    sized, dealt = shared_path(spark, "mix-sized"), shared_path(spark, "mix-dealt")
    size = word_count(F.col("text")) if size is None else size
    rows = materialised(docs.select("doc_id", "source", size.alias("size")), sized)
    # The ranges differ from run to run; written down, all later steps see the same ones.
    ranged = rows.repartitionByRange("source", "size", "doc_id").withColumn("part", F.spark_partition_id())
    rows = materialised(ranged, dealt)
    drop(spark, sized)
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    heads = heads.alias("h").join(targets.alias("t"), F.expr("h.source <=> t.source"))
    heads = heads.select("h.source", "h.part", "h.ahead", "t.source_size", "t.target")
    within = Window.partitionBy("r.source", "r.part").orderBy("r.size", "r.doc_id")
    rows = rows.alias("r").join(heads.alias("h"), F.expr("r.source <=> h.source and r.part = h.part"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        rows.withColumn("rank", F.col("ahead") + F.row_number().over(within))
        .select("r.doc_id", "r.source", "r.size", "source_size", "target", "rank", rate.alias("rate"), offset(F.col("r.source"), seed).alias("u"))
        .withColumn("copies", F.floor(F.col("rank") * F.col("rate") + F.col("u")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("u")))
        .select("doc_id", "source", "size", "source_size", "target", F.least("copies", F.ceil("rate")).cast("long").alias("copies"))
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as they are, each as often as the mix takes it.

    The texts are dealt once, by a hash of what names a row, to meet their decisions;
    these grow with the documents, so the join is a sort-merge join at every size.
    Rows that are the same in (doc_id, source, size) are numbered there, by the same
    dealing, to share out their copies."""
    names = docs.columns
    spark, at = docs.sparkSession, shared_path(docs.sparkSession, "mix-copies")
    kept = mix_copies(docs, None, weights, cap, seed).where("size > 0")
    kept = kept.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("of"))
    kept = materialised(kept.where("copies > 0").withColumn("h", F.xxhash64("doc_id", "source", "size")), at)
    whole = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.struct(*own(names)).alias("row"))
    whole = whole.withColumn("h", F.xxhash64("doc_id", "source", "size"))
    # Null-safe comparisons would be join keys of their own, and a second dealing; wrapped they only check.
    same = F.expr("d.h = k.h and if(d.doc_id <=> k.doc_id and d.source <=> k.source and d.size = k.size, true, false)")
    both = whole.alias("d").join(kept.alias("k").hint("merge"), same)
    share = F.col("k.copies")
    if kept.where("of > 1").limit(1).count():
        rows = Window.partitionBy("d.h", "d.doc_id", "d.source", "d.size").orderBy(F.xxhash64("row.text"), F.to_json("row"))
        both = both.select("row", "copies", "of", F.row_number().over(rows).alias("nth"))
        share = F.expr("copies div of + int(nth <= copies % of)")
    return both.withColumn("share", share).where("share > 0").select("row", F.explode(F.expr("sequence(1, share)"))).select("row.*")
