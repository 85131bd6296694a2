"""Named sources, as views that source queries select from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.sqltext import with_predicate
from tidemark.operators import seek
from tidemark.sources import splits
from tidemark.spec import TargetSpec

FETCH_ROWS, TIMEOUT_S, PARTS = 10_000, 600, 16


class SourceCatalog:
    """Tables by name.  A source is a DataFrame, Parquet, or a table of a database.  Names are
    those of a session's views: engines with different sources of one name have sessions of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.makers = spark, {}

    def add(self, name: str, make: Callable[[], DataFrame]) -> SourceCatalog:
        self.makers[name] = make
        make().createOrReplaceTempView(name)
        return self

    def parquet(self, name: str, path: str) -> SourceCatalog:
        return self.add(name, lambda: self.spark.read.parquet(path))

    def jdbc(self, name: str, url: str, table: str, fetch_rows: int = FETCH_ROWS, timeout_s: int = TIMEOUT_S, split_by: Sequence[str] = (), parts: int = PARTS, **options: str) -> SourceCatalog:
        """With ``split_by``, columns such as the watermark and the keys, the table is read in ``parts`` of
        about equal size at once, whose bounds are found by counting; options such as partitionColumn, lowerBound,
        upperBound and numPartitions give bounds by hand.  Filters and columns are pushed to the database.  Timestamps
        are read without a zone, as watermarks are, so a watermark's filter needs no cast."""
        held = {"fetchsize": str(fetch_rows), "queryTimeout": str(timeout_s), "preferTimestampNTZ": "true"} | options
        if not split_by:
            return self.add(name, self.spark.read.format("jdbc").options(url=url, dbtable=table, **held).load)
        spans = splits.predicates(splits.over_jdbc(self.spark, url, table, **options), split_by, parts)
        return self.add(name, lambda: self.spark.read.jdbc(url, table, predicates=spans, properties=held))

    def ping(self) -> bool:
        return self.spark.sql("SELECT 1").first()[0] == 1


def source(spark: SparkSession, spec: TargetSpec) -> DataFrame:
    """The source query's whole relation."""
    return spark.sql(with_predicate(spec.sourceQuery, "1 = 1"))


def rows_after(spark: SparkSession, spec: TargetSpec, wm: object, keys: tuple | None = None) -> DataFrame:
    """Rows after a cursor.  The predicate stands where the query's marker is, and the
    optimizer takes it into the scan."""
    types = dict(source(spark, spec).dtypes) if keys else None
    return spark.sql(with_predicate(spec.sourceQuery, seek.after(spec, wm, keys, types)))


def page(spark: SparkSession, spec: TargetSpec, wm: object, keys: tuple | None = None) -> DataFrame:
    """The one page after a cursor, in page order; without a page size all rows after it."""
    rows = rows_after(spark, spec, wm, keys)
    return rows.orderBy(*seek.order(spec)).limit(spec.pageSize) if spec.pageSize else rows
