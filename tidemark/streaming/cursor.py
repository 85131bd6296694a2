"""A table that grows by watermark as the source of a stream: the offset is the load's own cursor.

``CursorSource`` reads a folder of Parquet files.  A batch is what lies after the last cursor
(watermark, keys) and not after the new one, so a stream that stops and starts again, or repeats a
batch after a failure, sees every row once and the same rows for the same offsets.  The new cursor is
the last row that there is; the files' statistics tell which row groups can hold it, and only
their watermarks and keys are read.  A batch's partitions are row groups that reach into its range;
each is filtered where it is read.

Defined cases: rows without a watermark or a key are never read; rows that arrive later with a cursor
at or before the last one are not seen, as in a load without lookback; an empty folder has no offset
yet and gives no rows; files that come and go between batches must not hold rows of a batch that is
repeated.

    spark.dataSource.register(CursorSource)
    spark.readStream.format("cursor").schema(...).options(path=..., watermark="ts", keys="id").load()
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of row groups, about, that a partition reads.
PART_BYTES = 128 << 20


@dataclass
class Groups(InputPartition):
    """Row groups of a file, and the cursors between which rows count."""

    path: str
    groups: list[int]
    start: list | None
    end: list


def _shown(value) -> object:
    """A cursor's value as JSON, with its kind where JSON has none."""
    if isinstance(value, datetime.datetime):
        return {"ts": value.isoformat()}
    if isinstance(value, datetime.date):
        return {"d": value.isoformat()}
    return {"n": str(value)} if isinstance(value, Decimal) else value


def _read(value: object) -> object:
    if not isinstance(value, dict):
        return value
    (kind, text), = value.items()
    return {"ts": datetime.datetime.fromisoformat, "d": datetime.date.fromisoformat, "n": Decimal}[kind](text)


def _after(columns: list[str], cursor: list, schema):
    """Rows after a cursor in lexicographic order, as an expression that a scan can use."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out = None
    for name, value in reversed(list(zip(columns, cursor))):
        at, value = pc.field(name), pa.scalar(_read(value), schema.field(name).type)
        out = at > value if out is None else (at > value) | ((at == value) & out)
    return out


class CursorReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        if missing := [o for o in ("path", "watermark", "keys") if not options.get(o)]:
            raise ValueError(f"a cursor needs the options {', '.join(missing)}")
        self.names, self.path = schema.names, options["path"]
        self.columns = [options["watermark"], *[k.strip() for k in options["keys"].split(",")]]
        self.part_bytes = int(options.get("partBytes", PART_BYTES))

    def _files(self):
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return system, []
        found = ds.dataset(path, format="parquet", filesystem=system, exclude_invalid_files=False)
        return system, sorted(found.get_fragments(), key=lambda f: f.path)

    def _greatest(self, group) -> object | None:
        """The greatest watermark of a row group, by its statistics; None where there are none."""
        held = (group.statistics or {}).get(self.columns[0])
        return None if held is None else held.get("max")

    def initialOffset(self) -> dict:
        return {"cursor": None}

    def latestOffset(self) -> dict:
        """The last cursor that there is."""
        import pyarrow.compute as pc

        _, files = self._files()
        groups = [(f, g, self._greatest(g)) for f in files for g in f.row_groups if g.num_rows]
        told = [m for _, _, m in groups if m is not None]
        most = max(told, default=None)
        last = None
        for f, g, m in groups:
            if m is not None and m != most:
                continue
            table = f.subset(row_group_ids=[g.id]).to_table(columns=self.columns).drop_null()
            if table.num_rows:
                place = pc.sort_indices(table, [(c, "descending") for c in self.columns])[0].as_py()
                own = [table[c][place].as_py() for c in self.columns]
                last = own if last is None else max(last, own)
        return {"cursor": None if last is None else [_shown(v) for v in last]}

    def partitions(self, start: dict, end: dict) -> list[Groups]:
        if end["cursor"] is None or start == end:
            return []
        after = _read(start["cursor"][0]) if start["cursor"] else None
        out: list[Groups] = []
        for f in self._files()[1]:
            held, size = [], 0
            for g in f.row_groups:
                most = self._greatest(g)
                if after is not None and most is not None and most < after:
                    continue
                held.append(g.id)
                size += g.total_byte_size
                if size >= self.part_bytes:
                    out.append(Groups(f.path, held, start["cursor"], end["cursor"]))
                    held, size = [], 0
            if held:
                out.append(Groups(f.path, held, start["cursor"], end["cursor"]))
        return out

    def read(self, partition: Groups) -> Iterator:
        import pyarrow.compute as pc

        f = next(f for f in self._files()[1] if f.path == partition.path)
        schema = f.physical_schema
        wanted = ~_after(self.columns, partition.end, schema)
        for c in self.columns:
            wanted = wanted & pc.field(c).is_valid()
        if partition.start is not None:
            wanted = wanted & _after(self.columns, partition.start, schema)
        for batch in f.subset(row_group_ids=partition.groups).to_batches(columns=self.names, filter=wanted):
            if batch.num_rows:
                yield batch

    def commit(self, end: dict) -> None:
        """Nothing is kept for a batch."""


class CursorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self):
        raise ValueError("a cursor's columns are given with .schema(...)")

    def streamReader(self, schema: StructType) -> CursorReader:
        return CursorReader(schema, dict(self.options))


def offsets(text: str) -> list | None:
    """The cursor in an offset's JSON text, as values."""
    cursor = json.loads(text)["cursor"]
    return None if cursor is None else [_read(v) for v in cursor]
