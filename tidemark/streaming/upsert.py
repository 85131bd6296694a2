"""The same merge as the sink of a stream."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.staging import latest_per_key
from tidemark.plans.metrics import Totals
from tidemark.sources.snapshot import SnapshotTable
from tidemark.spec import UPSERT, Clause


def upsert_stream(stream: DataFrame, table: SnapshotTable, keys: Sequence[str], checkpoint: str, clauses: Sequence[Clause] = UPSERT, latest_by: Sequence[str] = (), totals: Totals | None = None, name: str | None = None) -> StreamingQuery:
    """Merge everything that is there into ``table`` and stop.

    Each micro-batch is one published version that holds its batch number as state; a
    batch that comes again after a failure is recognised and left out, so replays are
    exactly once.  With ``totals`` a batch counts as a page of the target ``name``, and one that
    comes again as a retry; ``StreamTotals`` adds the stream's own times."""

    def merge(batch: DataFrame, number: int) -> None:
        done = (table.manifest()["state"] or {}).get("batch", -1)
        if number <= done:
            if totals is not None and not batch.isEmpty():
                totals.add({"event": "retry", "target": name})
            return
        if batch.isEmpty():
            return
        began = time.monotonic()
        rows = (latest_per_key(batch, keys, latest_by) if latest_by else batch).persist()
        try:
            n = rows.count()
            did = table.merge(rows, keys, clauses, state={"batch": number}, page_rows=n)
        finally:
            rows.unpersist()
        if totals is not None:
            totals.add({"event": "page", "target": name, "rows": n, "merged": did["update"] + did["insert"] + did["delete"], "merge_seconds": time.monotonic() - began})

    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge)
    return (writer.queryName(name) if name else writer).start()
