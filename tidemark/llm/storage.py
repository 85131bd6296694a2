"""Places that the driver and all executors share, and plain files in them.

Everything an operator keeps between two jobs goes below the folder that the
cluster names in ``spark.checkpoint.dir``.  Where that is unset on one machine (unit
tests) a folder of this process stands in for it; on a cluster that is an error.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A path of its own, not yet in use, that every executor can reach."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or _own_root()
    if "://" not in root and root.startswith("/"):
        root = "file://" + root
    return f"{root.rstrip('/')}/tidemark-{tag}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write once, read back: cuts the lineage, and every later job sees the same rows."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no DataFrame still in use reads."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def own(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, whatever dots and quotes these have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def typed(df: DataFrame, name: str, alias: str | None = None) -> str:
    """A column's name and type as schema text: ids keep the type that the table gives them."""
    return f"{alias or name} {df.schema[name].dataType.simpleString()}"


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a file or folder, on an executor.  What Hadoop
    names ``s3a`` and ``s3n`` pyarrow names ``s3``."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


class CommittedFile:
    """A binary file that appears under its name only when complete.

    A task that runs again writes the same bytes to a temporary name of its own
    and moves it over the old file, so lost executors and duplicate attempts
    leave one whole file.
    """

    def __init__(self, folder: str, name: str):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.name = f"{base}/{name}", name
        self.temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.temporary), 0

    def write(self, data: bytes) -> int:
        """Append; returns the offset at which the data begin."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def commit(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.temporary, self.final)
        except OSError:
            # Some file systems keep an earlier attempt's file: it has the same bytes.
            if self.fs.get_file_info(self.final).size != self.size:
                raise
            self.fs.delete_file(self.temporary)
