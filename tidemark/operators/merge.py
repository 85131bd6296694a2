"""Merging a staged page into a target as one join.

Both sides travel as one struct each, ``tgt`` and ``src``, so clauses name their
columns as SQL does and no column of a table can clash with a name of the merge's own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.evolution import match
from tidemark.spec import UPSERT, Clause

REPEATED = "null or repeated keys in the source"


class MergeCardinalityError(ValueError):
    """A key is null or occurs more than once in what is merged."""


def quoted(name: str) -> Column:
    """A column by its whole name, whatever dots it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(Column.__or__, [quoted(k).isNull() for k in keys])


def check_keys(source: DataFrame, keys: Sequence[str]) -> None:
    """Reject null and repeated keys at once; one aggregate, combined before its shuffle.
    A merge tests the same as it runs; this is for callers that want to know before."""
    n, null = F.count(F.lit(1)), _any_null(keys)
    bad = source.groupBy(*map(quoted, keys)).agg(n.alias("_n")).where((F.col("_n") > 1) | null).limit(3).collect()
    if bad:
        raise MergeCardinalityError(f"{REPEATED}: {[r.asDict() for r in bad]}")


def _one_each(source: DataFrame, keys: Sequence[str], page: str | None = None) -> DataFrame:
    """(src, k0, k1, ...): a source's rows and their keys.  A key that is null or there twice
    fails the job.  With ``page``, a column with the number of a row's page, a key may come again
    in a later page, and its last row counts.  The numbering has the dealing of the merge's join,
    which needs no other."""
    names = [f"k{i}" for i in range(len(keys))]
    columns = [c for c in source.columns if c != page]
    rows = source.select(F.struct(*map(quoted, columns)).alias("row"), *[quoted(k).alias(n) for k, n in zip(keys, names)], *([quoted(page).alias("page")] if page else []))
    order = Window.partitionBy(*names).orderBy(F.col("page").desc()) if page else Window.partitionBy(*names).orderBy(*names)
    rows = rows.withColumn("n", F.row_number().over(order))
    again = F.lag("page").over(order) == F.col("page") if page else F.col("n") > 1
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False)))
    told = F.concat(F.lit(REPEATED + ": "), F.to_json(F.struct(*[F.col(n).alias(k) for k, n in zip(keys, names)])))
    bad = F.col("again") | _any_null(names)
    if page:
        rows = rows.where(F.when(bad, F.raise_error(told).cast("boolean")).otherwise(F.col("n") == 1))
        return rows.select(F.col("row").alias("src"), *names)
    return rows.select(F.when(bad, F.raise_error(told)).otherwise(F.col("row")).alias("src"), *names)


def repeatable(clauses: Sequence[Clause], keys: Sequence[str]) -> bool:
    """Whether merging pages one after the other gives what the last row of each key gives at
    once: an update and an insert without conditions, of the same columns, from the source alone."""
    if sorted(c.do for c in clauses) != ["insert", "update"] or any(c.condition for c in clauses):
        return False
    named = {c.do: None if c.columns is None else {n.lower() for n in c.columns} for c in clauses}
    if any("tgt" in v.lower() for c in clauses for v in (c.columns or {}).values()):
        return False
    if None in named.values():
        return named["insert"] == named["update"]
    return named["insert"] ^ named["update"] <= {k.lower() for k in keys}


def merged(target: DataFrame, source: DataFrame, keys: Sequence[str], clauses: Sequence[Clause] = UPSERT) -> DataFrame:
    """(tgt, action): the target's rows after the merge as structs, and what was done:
    keep, update, insert or delete.

    One full outer join on the keys.  The first clause that applies to a row acts on
    it; rows to delete are still there, for counting."""
    tgt, src = _sides(target, source, keys)
    return _acted(tgt.join(src, _same(len(keys)), "full_outer"), target, source, clauses)


def merged_in_place(target: DataFrame, source: DataFrame, keys: Sequence[str], clauses: Sequence[Clause] = UPSERT, page: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """What ``merged`` gives, for a source of a checked size, without dealing out the target.

    The source is sent to the target's rows, which stay where they are read; that is the first
    table.  The second has the rows to insert: those of the source whose keys the target does
    not have, of which it only reads its keys."""
    tgt, src = _sides(target, source, keys, page)
    known = _acted(tgt.join(F.broadcast(src), _same(len(keys)), "left"), target, source, clauses)
    if all(c.do != "insert" for c in clauses):
        return known, None
    names = [f"k{i}" for i in range(len(keys))]
    own = target.select(*[quoted(k).alias(f"t{i}") for i, k in enumerate(keys)])
    met = own.join(F.broadcast(src.select(*names)), _same(len(keys)), "left_semi")
    new = src.join(met, _same(len(keys)), "left_anti").select(F.lit(None).cast(tgt.schema["tgt"].dataType).alias("tgt"), "src")
    return known, _acted(new, target, source, clauses)


def merged_pages(target: DataFrame, source: DataFrame, keys: Sequence[str], clauses: Sequence[Clause], page: str) -> DataFrame:
    """``merged`` for several pages at once, told apart by the column ``page``; ``repeatable`` clauses."""
    tgt, src = _sides(target, source, keys, page)
    return _acted(tgt.join(src, _same(len(keys)), "full_outer"), target, source.drop(page), clauses)


def _sides(target: DataFrame, source: DataFrame, keys: Sequence[str], page: str | None = None) -> tuple[DataFrame, DataFrame]:
    tgt = target.select(F.struct(*map(quoted, target.columns)).alias("tgt"), *[quoted(k).alias(f"t{i}") for i, k in enumerate(keys)])
    return tgt, _one_each(source, keys, page)


def _same(n: int) -> list[Column]:
    return [F.col(f"t{i}") == F.col(f"k{i}") for i in range(n)]


def _acted(both: DataFrame, target: DataFrame, source: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """(tgt, action) of joined rows (tgt, src)."""
    in_t, in_s = F.col("tgt").isNotNull(), F.col("src").isNotNull()
    which = F.lit(-1)
    for k, c in reversed(list(enumerate(clauses))):
        which = F.when(_applies(c, in_t, in_s), F.lit(k)).otherwise(which)
    both = both.select("tgt", "src", which.alias("which"))
    action = F.lit(None).cast("string")
    for k, c in enumerate(clauses):
        action = F.when(F.col("which") == k, c.do).otherwise(action)
    action = F.coalesce(action, F.when(in_t, "keep"))
    columns = []
    for field in target.schema:
        kept = F.col("tgt").getField(field.name)
        value = kept
        for k, c in enumerate(clauses):
            if c.do != "delete":
                value = F.when(F.col("which") == k, _value(c, field.name, kept, source.columns).cast(field.dataType)).otherwise(value)
        columns.append(value.cast(field.dataType).alias(field.name))
    return both.select(F.struct(*columns).alias("tgt"), action.alias("action")).where("action is not null")


def _applies(c: Clause, in_t: Column, in_s: Column) -> Column:
    side = in_t & in_s if c.when == "matched" else ~in_t & in_s
    return F.coalesce(side & F.expr(c.condition), F.lit(False)) if c.condition else side


def _value(c: Clause, name: str, kept: Column, source: list[str]) -> Column:
    if c.columns is not None:
        if (own := match(name, c.columns)) is not None:
            return F.expr(c.columns[own])
        return kept if c.do == "update" else F.lit(None)
    return F.col("src").getField(own) if (own := match(name, source)) is not None else kept


def apply_merge(target: DataFrame, source: DataFrame, keys: Sequence[str], clauses: Sequence[Clause] = UPSERT) -> DataFrame:
    """The target after the merge.  Null and repeated keys of the source fail the job that runs it."""
    return merged(target, source, keys, clauses).where("action != 'delete'").select("tgt.*")


def affected(target: DataFrame, source: DataFrame, keys: Sequence[str], clauses: Sequence[Clause] = UPSERT) -> DataFrame:
    """(action, n) of the rows that a merge changes."""
    rows = merged(target, source, keys, clauses).where("action != 'keep'")
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
