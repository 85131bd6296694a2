"""Small text files on any file system that Spark reaches."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def fresh(spark: SparkSession, tag: str) -> str:
    """A folder of its own that all executors share; on one machine, where the session names none, of this process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or _own_root()
    root = "file://" + root if root.startswith("/") else root
    return f"{root.rstrip('/')}/tidemark-{tag}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that is there whole or not at all; False if the name is taken.

    Of two publishers of one name one wins where the file system has a rename or link that
    does not overwrite (HDFS, local disks); stores without one must have a single writer."""
    fs, at = _at(spark, path)
    if fs.exists(at):
        return False
    draft = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.getScheme() == "file":
        try:
            os.link(draft.toUri().getPath(), at.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)
    return bool(fs.rename(draft, at))


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)
