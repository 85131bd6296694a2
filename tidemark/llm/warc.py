"""WARC archives with a globally ordered capture index.

Pages become WARC 1.1 records, one gzip member each, in files of bounded size.
Every file closes with its captures sorted by URL key and timestamp: a local run.
Runs are merged externally: captures are dealt by ranges of (URL key, timestamp,
page), as many as it takes for ``RANGE`` captures each; a range takes its slice of
every run, still sorted and in Arrow's compact form, and a loser tree merges the
slices as streams, so the ranges one after the other are the capture histories of
all URLs.  A URL with very many captures spans several ranges.

Of records with equal payloads of at least ``REVISIT_FROM`` bytes, that with the
largest page_id is the response; the others are revisits, which keep the HTTP
header and refer to it.  Shorter payloads are always responses.  Only ids and digests
of the long payloads meet by digest; the pages themselves meet their decisions by
page_id, so a payload that a third of all pages share gathers in no task.

Defined cases: null html is an empty payload, null url an empty URL key; a null
page_id is smaller than any other; rows repeated with the largest page_id are all
responses; page_id may have any type that can be ordered and written as text (numbers,
strings, dates), which results and index keep; an empty table writes no file; without a
``captured`` column a page's date follows from its page_id (of whole numbers their value,
else a digest) and lies within one year, in UTC whatever the session's zone; other columns
play no part.  File names are new for each attempt of a task, and only what a
finished attempt reports is indexed, so a lost executor leaves stray files, not
wrong offsets.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import re
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.storage import CommittedFile, drop, filesystem, materialised, shared_path, typed

REVISIT_FROM = 1000
#: Captures that a range of the merged index holds, about.
RANGE = 200_000
FILE_BYTES = 32 << 20
READ_BYTES = 4 << 20
#: Rows of a slice that the merge has as Python values at a time.
STREAMED = 500
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:tidemark:page:"

YEAR_S = 365 * 86_400
_RUN = (("url_key", pa.string()), ("captured", pa.string()), ("page_id", None), ("run", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("length", pa.int64()))
#: Ids as text, as the records have them.
RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
_RECORD = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])


def _run_schemas(pages: DataFrame) -> tuple[str, pa.Schema]:
    """A capture's columns, as SQL and for Arrow; page_id has the type that it has in ``pages``."""
    from pyspark.sql.pandas.types import to_arrow_type

    text = f"url_key string, captured string, {typed(pages, 'page_id')}, run string, path string, at long, length long"
    return text, pa.schema([(n, t or to_arrow_type(pages.schema["page_id"].dataType)) for n, t in _RUN])


def _named(page_id) -> str:
    """An id in a record's header: null is left out, and an empty one is told from it."""
    return ID if page_id is None else ID + (quote(str(page_id), safe="") or "%")


def _id(uri: str) -> str | None:
    text = uri.strip("<>").removeprefix(ID)
    return None if not text else "" if text == "%" else unquote(text)


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query: ``org,example)/a?b``."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url or "")
    if not m:
        return (url or "").partition("#")[0].lower()
    host = m[1].rpartition("@")[2].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def record(page_id, url: str | None, captured: str, payload: bytes, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = re.sub(r"[\s\x00-\x1f]", lambda c: "%%%02X" % ord(c[0]) if ord(c[0]) < 256 else c[0], url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_named(page_id)}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {captured}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_named(refers_to)}>"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record as its row; a payload that its digest does not fit is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    size = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    if not version.startswith("WARC/") or kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return {"page_id": _id(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest.hex(), "record_type": kind, "refers_to": _id(fields.get("WARC-Refers-To", ""))}


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, so the next
    winner costs one match per level."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(self.runs)
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[winner := self.losers[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def default_date(page_id: Column) -> Column:
    """A date of 2024 for any page_id, put together from whole numbers: no session zone plays a part."""
    second = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(YEAR_S))
    part = lambda by, most: F.lpad((F.floor(second / by) % most).cast("string"), 2, "0")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(second / 86_400).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60), F.lit("Z"))


def planned(pages: DataFrame, captured: Column | None = None, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, html, captured, refers_to, revisit of every page (page_id, url, html)."""
    spark, at = pages.sparkSession, shared_path(pages.sparkSession, "warc-plan")
    if captured is None:
        whole = isinstance(pages.schema["page_id"].dataType, (T.IntegralType, T.DecimalType))
        captured = default_date(F.floor("page_id") if whole else F.crc32(F.col("page_id").cast("string").cast("binary")))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), captured.alias("captured"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= revisit_from, F.sha1("html")))
    long = materialised(rows.where("digest is not null").select("page_id", "digest"), f"{at}/long")
    groups = long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Written down, both sides of these joins are plain scans: a digest or page_id that very many rows share is split.
    groups = materialised(groups.where("n > 1 and first is not null").select("digest", "first"), f"{at}/groups")
    again = long.join(groups, "digest").where("not (page_id <=> first)").distinct()
    again = materialised(again.select("page_id", "digest", "first"), f"{at}/again")
    drop(spark, f"{at}/long", f"{at}/groups")
    rows = rows.alias("p").join(again.alias("a"), F.expr("p.page_id <=> a.page_id and p.digest = a.digest"), "left")
    return rows.select("p.page_id", "url", "html", "captured", F.col("first").alias("refers_to"), F.col("first").isNotNull().alias("revisit"))


def write_runs(plan: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all records below ``folder``; the captures of each file, sorted, are a run."""
    columns, schema = _run_schemas(plan)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, run = TaskContext.get().partitionId(), None, []

        def closed() -> pa.RecordBatch:
            out.commit()
            run.sort(key=order)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run), schema)], schema=schema)

        for batch in batches:
            for page_id, url, html, captured, refers_to, revisit in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if out is not None and out.size >= file_bytes:
                    yield closed()
                    out = None
                if out is None:
                    out, run = CommittedFile(folder, f"capture-{task:06d}-{uuid.uuid4().hex}.warc.gz"), []
                member = gzip.compress(record(page_id, url, captured, html.encode(), refers_to, revisit), 6, mtime=0)
                run.append((url_key(url), captured, page_id, out.name, f"{folder}/{out.name}", out.write(member), len(member)))
        if out is not None:
            yield closed()

    plan.select("page_id", "url", "html", "captured", "refers_to", "revisit").mapInArrow(write, columns).write.parquet(f"{folder}/_runs")
    return plan.sparkSession.read.schema(columns).parquet(f"{folder}/_runs")


def order(row: tuple) -> tuple:
    """URL key, timestamp, then page and place, so that equal captures have one order."""
    return (row[0].encode(), row[1], row[2] is not None, 0 if row[2] is None else row[2], row[3], row[5])


def merge_runs(runs: DataFrame, folder: str) -> DataFrame:
    """The capture histories in global order: parts of the table follow each other."""
    columns, schema = _run_schemas(runs)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            names, starts = np.unique(batch.column("run").to_numpy(zero_copy_only=False), return_index=True)
            for name, a, b in zip(names, starts, [*starts[1:], batch.num_rows]):
                slices.setdefault(name, []).append(batch.slice(a, b - a))

        def rows(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
            for part in parts:
                for at in range(0, part.num_rows, STREAMED):
                    for row in zip(*(c.to_pylist() for c in part.slice(at, STREAMED).columns)):
                        yield order(row), row

        merged = (row for _, row in LoserTree([rows(slices[k]) for k in sorted(slices)]))
        while some := list(itertools.islice(merged, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE))
    dealt = runs.repartitionByRange(n, "url_key", "captured", "page_id", "run", "at").sortWithinPartitions("run", "url_key", "captured", "page_id", "at")
    dealt.mapInArrow(merge, columns).write.parquet(f"{folder}/_history")
    return runs.sparkSession.read.schema(columns).parquet(f"{folder}/_history")


def read_records(history: DataFrame) -> DataFrame:
    """Every record that the index names, read from the archives and checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, data, begin = None, None, b"", 0
        for batch in batches:
            rows = []
            for path, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    fs, inner = filesystem(path)
                    name, file, data, begin = path, fs.open_input_file(inner), b"", 0
                if at < begin or at + length > begin + len(data):
                    data, begin = file.read_at(max(length, READ_BYTES), at), at
                rows.append(parse(gzip.decompress(data[at - begin : at - begin + length])))
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    n = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = history.select("path", "at", "length").repartition(n, "path").sortWithinPartitions("path", "at").mapInArrow(read, RECORD)
    as_given = lambda c: F.col(c).cast(history.schema["page_id"].dataType).alias(c)
    return found.select(as_given("page_id"), "payload_bytes", "payload_digest", "record_type", as_given("refers_to"))


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives, merge the index, and describe every record read back."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    return read_records(merge_runs(write_runs(planned(pages, **options), folder), folder))
