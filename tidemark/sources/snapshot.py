"""Targets as bucketed Parquet snapshots, published with their run state.

A target's rows lie in buckets by a hash of their keys.  A merge reads and writes
only the buckets that its page touches, each as a folder of a new version; the
others stay where they are.  A version is one manifest file that names the folder
of every bucket and holds the number of rows and the target's run state, so data and
progress become visible together, and readers keep the version that they opened.
The number of buckets follows the rows: a table that has outgrown its buckets is
dealt anew by the merge that finds it so.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.evolution import evolved, first_schema, takes_all
from tidemark.operators.merge import merged, merged_in_place, merged_pages, quoted
from tidemark.sources import files
from tidemark.spec import UPSERT, Clause

BUCKETS = 16
#: Rows that a bucket is made for; at ``GROWN`` times that on average there are too few buckets.
BUCKET_ROWS, GROWN = 2_000_000, 4
#: A page of up to so many rows and bytes of files, and a target of so many times its rows: the page goes to the target.
SMALL_ROWS, SMALL_BYTES, SMALL_SHARE = 200_000, 16 << 20, 4
KEPT = 3


class ConcurrentUpdate(RuntimeError):
    """Another process published a version meanwhile."""


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.least = buckets

    @property
    def buckets(self) -> int:
        return self.manifest().get("n_buckets") or self.least

    def manifest(self) -> dict:
        """The newest version; without one an empty version 0."""
        found = [n for n in files.names(self.spark, f"{self.path}/manifests") if n.endswith(".json") and n[0] != "."]
        if not found:
            return {"version": 0, "keys": [], "schema": None, "n_buckets": None, "rows": 0, "buckets": {}, "state": None}
        return json.loads(files.read(self.spark, f"{self.path}/manifests/{found[-1]}"))

    def publish(self, manifest: dict, **changes) -> dict:
        new = {**manifest, **changes, "version": manifest["version"] + 1}
        name = f"{self.path}/manifests/{new['version']:010d}.json"
        if not files.publish(self.spark, name, json.dumps(new)):
            raise ConcurrentUpdate(f"{name} exists")
        return new

    def rows(self) -> int:
        """Row count from the manifest; no job."""
        return self.manifest()["rows"]

    def read(self, manifest: dict | None = None, only: Sequence[int] | None = None, schema: T.StructType | None = None) -> DataFrame:
        """The rows of a version; with a later ``schema`` its new columns are null and its wider types are read as such."""
        manifest = manifest or self.manifest()
        schema = schema or T.StructType.fromJson(manifest["schema"])
        paths = [p for k, p in sorted(manifest["buckets"].items()) if only is None or int(k) in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def merge(self, page: DataFrame, keys: Sequence[str], clauses: Sequence[Clause] = UPSERT, schema: T.StructType | None = None, state: dict | None = None, page_rows: int | None = None, fixed: bool = False, pages: str | None = None) -> dict:
        """Merge a staged page and publish it together with ``state``; returns the counts.

        ``page_rows``, where it is known, saves a pass over the page.  New columns and wider types of
        the page become the target's, or fail the merge if its columns are ``fixed``.  Several pages,
        whose numbers the column ``pages`` has, merge at once as if one after the other; their clauses
        must be ``repeatable``.  A page that is small beside the target is sent to the target's rows,
        which then are not shuffled."""
        manifest = self.manifest()
        page_rows = page.count() if page_rows is None else page_rows
        had, whole = manifest["n_buckets"], manifest["rows"] + page_rows
        n = had or self.least
        if whole > GROWN * BUCKET_ROWS * n or not had:
            n = max(n, -(-whole // BUCKET_ROWS))
        bucket = lambda cols: F.pmod(F.xxhash64(*[c.cast("string") for c in cols]), F.lit(n)).cast("int")
        # A page much larger than the number of buckets touches them all; a small one tells which.
        if n != had or page_rows >= 8 * n:
            touched = None
        else:
            touched = {r[0] for r in page.select(bucket(map(quoted, keys))).distinct().collect()}  # at most ``n`` numbers
        rows = page.drop(pages) if pages else page
        if not manifest["schema"]:
            schema = schema or first_schema(rows, clauses, keys)
        else:
            schema = T.StructType.fromJson(manifest["schema"])
            schema = evolved(schema, rows.schema, fixed) if takes_all(clauses) else schema
        target = self.read(manifest, touched, schema)
        where, name = bucket([F.col("tgt").getField(k) for k in keys]), self._bucket_column(schema)
        # A shuffle by keys is not one by bucket.  A rebalance brings a bucket's rows together
        # for few files, and splits what is too much for one task.
        gathered = lambda rows: rows.withColumn("bucket", where).hint("rebalance", "bucket")
        if n == had and self._is_small(page, page_rows, manifest["rows"]):
            known, new = merged_in_place(target, page, keys, clauses, pages)
            rows = known.withColumn("bucket", where)  # as they are read: bucket by bucket
            rows = rows if new is None else rows.unionByName(gathered(new))
        else:
            rows = gathered(merged_pages(target, page, keys, clauses, pages) if pages else merged(target, page, keys, clauses))
        # What was done is counted in the tasks that write, whose counts are taken once however often they run.
        seen, actions = Observation(), ("keep", "update", "insert", "delete")
        rows = rows.observe(seen, *[F.count_if(F.col("action") == a).alias(a) for a in actions])
        folder = f"{self.path}/data/{manifest['version'] + 1:010d}-{uuid.uuid4().hex[:12]}"
        rows = rows.where("action != 'delete'").select("tgt.*", F.col("bucket").alias(name))
        rows.write.partitionBy(name).parquet(folder)
        did = dict(seen.get)
        held = {x.rpartition("=")[2]: f"{folder}/{x}" for x in files.names(self.spark, folder) if "=" in x}
        buckets = {k: p for k, p in manifest["buckets"].items() if touched is not None and int(k) not in touched} | held
        self.publish(manifest, keys=list(keys), schema=schema.jsonValue(), n_buckets=n, rows=manifest["rows"] + did["insert"] - did["delete"], buckets=buckets, state=state if state is not None else manifest["state"])
        return did

    @staticmethod
    def _is_small(page: DataFrame, page_rows: int, rows: int) -> bool:
        """Whether a page can be sent to every task: few rows, few bytes as Spark's statistics have them, and few beside the target."""
        if page_rows > SMALL_ROWS or rows < SMALL_SHARE * page_rows:
            return False
        return int(str(page._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES

    @staticmethod
    def _bucket_column(schema: T.StructType) -> str:
        name = "_bucket"
        while name in {f.name.lower() for f in schema}:
            name = "_" + name
        return name

    def vacuum(self, kept: int = KEPT) -> None:
        """Delete the data and manifests of all but the last ``kept`` versions."""
        found = [n for n in files.names(self.spark, f"{self.path}/manifests") if n.endswith(".json") and n[0] != "."]
        held = [json.loads(files.read(self.spark, f"{self.path}/manifests/{n}")) for n in found[-kept:]]
        used = {p.rsplit("/", 2)[-2] for m in held for p in m["buckets"].values()}
        for name in files.names(self.spark, f"{self.path}/data"):
            if name not in used and int(name[:10]) <= held[-1]["version"]:
                files.delete(self.spark, f"{self.path}/data/{name}")
        for name in found[:-kept]:
            files.delete(self.spark, f"{self.path}/manifests/{name}")
