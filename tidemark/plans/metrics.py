"""Counters and histograms: as aggregates over a log of runs and pages, and as the running
totals of one engine, which scrapers read."""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

BOUNDS = (0.1, 0.5, 1.0, 5.0, 10.0, 60.0, 600.0)


def counters(events: DataFrame) -> DataFrame:
    """(series, target, status, value) from events (event, target, status, rows, merged)."""
    one = lambda series, value, where, status="": events.where(where).groupBy("target", (F.col("status") if status else F.lit(None).cast("string")).alias("status")).agg(value.cast("long").alias("value")).select(F.lit(series).alias("series"), "target", "status", "value")
    runs = one("etl_runs_total", F.count(F.lit(1)), "event = 'run'", "status")
    loaded = one("etl_rows_loaded_total", F.sum("rows"), "event = 'page' and rows > 0")
    merged = one("etl_rows_merged_total", F.sum("merged"), "event = 'page' and merged > 0")
    retries = one("etl_source_auth_retries_total", F.count(F.lit(1)), "event = 'retry'")
    return runs.unionByName(loaded).unionByName(merged).unionByName(retries)


def histogram(samples: DataFrame, value: str, by: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Cumulative buckets: (by, le, n, total), the last ``+Inf``; ``total`` is the sum of all values
    of ``by``.  One row per sample and no bucket is shuffled: all buckets are sums of one aggregate."""
    counts = [F.count(F.when(F.col(value) <= b, 1)).alias(f"b{k}") for k, b in enumerate(bounds)]
    wide = samples.groupBy(by).agg(*counts, F.count(F.lit(1)).alias("all"), F.sum(value).alias("total"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)]
    return wide.select(by, F.inline(F.array(*pairs, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))), "total")


#: Values of a sketch that keep a rank's error below ``RANK_ERROR`` with 99 % probability.
SKETCH_K, RANK_ERROR = 400, 0.009


def sketches(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, sketch, n): one small sketch of the values of each run and target, to be kept with the runs."""
    return samples.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_K).alias("sketch"), F.count(value).alias("n"))


def quantiles(kept: DataFrame, by: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(by, share, value, n): quantiles over many runs, from their sketches alone.  Exact up to ``SKETCH_K`` values;
    beyond that a value's rank is within ``RANK_ERROR`` of its share."""
    merged = kept.groupBy(by).agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"), F.sum("n").alias("n"))
    one = [F.struct(F.lit(p).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("value")) for p in shares]
    return merged.select(by, F.inline(F.array(*one)), "n")


#: Timers: series, event and field that they measure, further labels.  A page's fetch is timed with its page, an empty one alone.
TIMERS = (("etl_page_duration_seconds", "page", "page_seconds", ()), ("etl_page_duration_seconds", "fetch", "page_seconds", ()), ("etl_merge_duration_seconds", "page", "merge_seconds", ()), ("etl_run_duration_seconds", "run", "seconds", ("status",)), ("etl_batch_duration_seconds", "batch", "seconds", ()))


class StreamTotals(StreamingQueryListener):
    """Adds streams to an engine's totals: batches and their times by the stream's name, and how a stream ended.
    Rows are told by the sink: a stream's own number counts those that a batch reads twice."""

    def __init__(self, totals: Totals):
        self.totals, self.names = totals, {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.names.setdefault(str(p.id), p.name or str(p.id))
        if p.numInputRows:
            self.totals.add({"event": "batch", "target": p.name or str(p.id), "seconds": p.batchDuration / 1000})

    def onQueryIdle(self, event) -> None:
        """A stream that waits changes nothing."""

    def onQueryTerminated(self, event) -> None:
        name = self.names.get(str(event.id), str(event.id))
        self.totals.add({"event": "run", "target": name, "status": "failed" if event.exception else "ok"})


class Totals:
    """What one engine's events add up to since it began; its size follows the targets, not the events."""

    def __init__(self):
        self.counts: Counter = Counter()
        self.times: dict[tuple, list[float]] = defaultdict(lambda: [0.0] * (len(BOUNDS) + 2))

    def add(self, event: dict) -> None:
        kind, target = event["event"], event["target"]
        if kind == "run":
            self.counts["etl_runs_total", target, event["status"]] += 1
        elif kind == "batch":
            self.counts["etl_stream_batches_total", target, None] += 1
        elif kind == "retry":
            self.counts["etl_source_auth_retries_total", target, None] += 1
        elif kind == "page":
            for series, n in (("etl_rows_loaded_total", event["rows"]), ("etl_rows_merged_total", event["merged"])):
                if n > 0:
                    self.counts[series, target, None] += n
        for series, of, value, labels in TIMERS:
            if kind == of and value in event:
                held = self.times[(series, target, *(event[x] for x in labels))]
                held[bisect.bisect_left(BOUNDS, event[value])] += 1
                held[-1] += event[value]

    def lines(self) -> list[str]:
        out = [_line(*key, value) for key, value in sorted(self.counts.items(), key=str)]
        for (series, target, *status), held in sorted(self.times.items()):
            label, n = f'target="{target}"' + "".join(f',status="{x}"' for x in status), 0
            for bound, own in zip((*map(str, BOUNDS), "+Inf"), held):
                n += int(own)
                out.append(f'{series}_bucket{{{label},le="{bound}"}} {n}')
            out += [f"{series}_sum{{{label}}} {held[-1]}", f"{series}_count{{{label}}} {n}"]
        return out


def gauges(pools: dict[str, tuple[Callable[[], int], Callable[[], int]]]) -> list[str]:
    """Threads at work and calls that wait, of each pool, as they are now."""
    return [f'etl_pool_{what}{{pool="{name}"}} {ask()}' for name, asked in sorted(pools.items()) for what, ask in zip(("active", "queue"), asked)]


def _line(series: str, target: str, status: str | None, value: int) -> str:
    return f'{series}{{target="{target}"' + (f',status="{status}"' if status else "") + f"}} {value}"


def exposition(rows: DataFrame) -> str:
    """Counters in the text format that scrapers read; one line per series and label."""
    return "".join(_line(*r) + "\n" for r in rows.orderBy("series", "target", "status").toLocalIterator())
