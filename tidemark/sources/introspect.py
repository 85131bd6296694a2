"""Table definitions as text and as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def rendered_type(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"NUMBER({kind.precision},{kind.scale})" if kind.scale else f"NUMBER({kind.precision})"
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType)):
        return "NUMBER"
    if isinstance(kind, (T.VarcharType, T.CharType)):
        return f"{'VARCHAR2' if isinstance(kind, T.VarcharType) else 'CHAR'}({kind.length})"
    if isinstance(kind, T.StringType):
        return "VARCHAR2"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    return kind.simpleString().upper()


def ddl(name: str, schema: T.StructType, keys: list[str] | tuple[str, ...] = ()) -> str:
    """CREATE TABLE with columns in order and the primary key."""
    lines = [f"  {f.name} {rendered_type(f.dataType)}{' NOT NULL' if f.name in keys or not f.nullable else ''}" for f in schema]
    if keys:
        lines.append(f"  PRIMARY KEY ({', '.join(keys)})")
    return f"CREATE TABLE {name} (\n" + ",\n".join(lines) + "\n)"


def columns(spark: SparkSession, table: DataFrame, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(place, column_name, column_type, key_place) of a table."""
    rows = [(k + 1, f.name, rendered_type(f.dataType), list(keys).index(f.name) + 1 if f.name in keys else None) for k, f in enumerate(table.schema)]
    return spark.createDataFrame(rows, "place long, column_name string, column_type string, key_place long")
