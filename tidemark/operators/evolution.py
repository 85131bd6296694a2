"""What a target's columns become when its source gains columns or wider types."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.spec import Clause

#: Whole numbers by width, with the decimal digits that each needs.
_WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
_MOST_DIGITS = 38


class SchemaChanged(ValueError):
    """A column's type has no common type with the target's, or may not change it."""


def _digits(kind: T.DataType) -> tuple[int, int] | None:
    """(digits before the point, digits behind it) of whole numbers and decimals."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    return (_WHOLE[type(kind)], 0) if type(kind) in _WHOLE else None


def widened(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The narrower of the types that hold every value of both, or None.  Files written with either can be
    read as that type, so nothing that is stored has to be written again."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _WHOLE and type(b) in _WHOLE:
        return a if _WHOLE[type(a)] > _WHOLE[type(b)] else b
    pair = {type(a), type(b)}
    if pair == {T.FloatType, T.DoubleType}:
        return T.DoubleType()
    if T.DoubleType in pair and pair & {T.ByteType, T.ShortType, T.IntegerType}:
        return T.DoubleType()  # 53 bits hold them exactly; they do not hold a long
    if pair == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    x, y = _digits(a), _digits(b)
    if x and y:
        before, behind = max(x[0], y[0]), max(x[1], y[1])
        return T.DecimalType(before + behind, behind) if before + behind <= _MOST_DIGITS else None
    return None


def match(name: str, names: Iterable[str]) -> str | None:
    """The name in ``names`` that stands for ``name``: the same, or the same but for case."""
    names = list(names)
    return name if name in names else next((n for n in names if n.lower() == name.lower()), None)


def takes_all(clauses: Sequence[Clause]) -> bool:
    return any(c.do != "delete" and c.columns is None for c in clauses)


def first_schema(page: DataFrame, clauses: Sequence[Clause], keys: Sequence[str]) -> T.StructType:
    """Columns of a new target: those that its inserts name, else the page's."""
    inserts = [c for c in clauses if c.do == "insert"]
    if not inserts or any(c.columns is None for c in inserts):
        return page.schema
    named = {n: v for c in reversed(inserts) for n, v in c.columns.items()}
    if missing := [k for k in keys if match(k, named) is None]:
        raise SchemaChanged(f"the insert has no {', '.join(missing)}, which the merge joins by")
    src = page.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in page.columns]).alias("src"))
    return src.select(*[F.expr(v).alias(n) for n, v in named.items()]).schema


def evolved(target: T.StructType, page: T.StructType, fixed: bool = False) -> T.StructType:
    """``target`` with the page's new columns behind its own and with wider types where the page has them.
    A page's narrower type changes nothing, and neither does a column that it lacks."""
    fields, problems = [], []
    for f in target:
        kind, name = f.dataType, match(f.name, page.names)
        if name is not None:
            kind = widened(f.dataType, page[name].dataType)
            if kind is None or fixed and kind != f.dataType:
                problems.append(f"{f.name} is {f.dataType.simpleString()}, the page has {page[name].dataType.simpleString()}")
        fields.append(T.StructField(f.name, kind or f.dataType))
    new = [f for f in page if match(f.name, target.names) is None]
    problems += [f"{f.name} is new" for f in new if fixed]
    if problems:
        raise SchemaChanged("; ".join(problems))
    return T.StructType([*fields, *(T.StructField(f.name, f.dataType) for f in new)])
