"""Submitting runs: one run of a target at a time, a bounded queue in front."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from tidemark.plans import metrics
from tidemark.plans.pipeline import Engine
from tidemark.spec import PipelineSpec, TargetSpec

THREADS, QUEUE, TTL_S = 4, 16, 60.0
#: Seconds that a shutdown waits for runs, row counts and targets at work.
RUNS_S, COUNTS_S, TARGETS_S = 300.0, 5.0, 300.0
log = logging.getLogger("tidemark")


class QueueFull(RuntimeError):
    pass


class RowCounts:
    """Row counts that never keep their asker waiting: null until first known, then the last
    known one.  One that is older than ``ttl_s`` is read again behind the scenes, by one reader
    at a time for each target; if that fails the old one stays."""

    def __init__(self, read: Callable[[TargetSpec], int], ttl_s: float = TTL_S):
        self.read, self.ttl_s, self.lock = read, ttl_s, threading.Lock()
        self.known: dict[str, tuple[float, int]] = {}
        self.asked: set[str] = set()
        self.pool = ThreadPoolExecutor(1)

    def get(self, spec: TargetSpec) -> int | None:
        with self.lock:
            at, n = self.known.get(spec.name, (None, None))
            stale = at is None or time.monotonic() - at >= self.ttl_s
            if stale and spec.name not in self.asked:
                try:
                    self.pool.submit(self._refresh, spec)
                    self.asked.add(spec.name)
                except RuntimeError:  # shut down: what is known stays
                    pass
        return n

    def _refresh(self, spec: TargetSpec) -> None:
        try:
            n = self.read(spec)
            with self.lock:
                self.known[spec.name] = (time.monotonic(), n)
        except Exception:
            log.warning("rows of %s could not be counted", spec.name, exc_info=True)
        finally:
            with self.lock:
                self.asked.discard(spec.name)

    def shutdown(self, wait_s: float) -> None:
        _end(self.pool, wait_s)


def _end(pool: ThreadPoolExecutor, wait_s: float) -> None:
    """No more work for a pool; what waits is dropped after ``wait_s``."""
    pool.shutdown(wait=False)
    waiting = threading.Thread(target=pool.shutdown, daemon=True)
    waiting.start()
    waiting.join(wait_s)
    pool.shutdown(wait=False, cancel_futures=True)


class RunManager:
    """Reserves targets, runs what is free in the background and says what it skipped."""

    def __init__(self, engine: Engine, pipeline: PipelineSpec, threads: int = THREADS, queue: int = QUEUE, ttl_s: float = TTL_S):
        self.engine, self.pipeline = engine, pipeline
        self.pool, self.slots = ThreadPoolExecutor(threads), threading.Semaphore(threads + queue)
        self.running: set[str] = set()
        self.lock, self.rejected, self.busy, self.waiting = threading.Lock(), 0, 0, 0
        self.counts = RowCounts(lambda spec: self.engine.table(spec).rows(), ttl_s)

    def reserve(self, specs: list[TargetSpec]) -> tuple[list[TargetSpec], list[str]]:
        """(targets now reserved, names of those that run already)."""
        with self.lock:
            free = [s for s in specs if s.name not in self.running]
            self.running.update(s.name for s in free)
        return free, [s.name for s in specs if s not in free]

    def submit(self, specs: list[TargetSpec]) -> dict | None:
        """The answer to a request; None if nothing is configured under that name."""
        if not specs:
            return None
        free, skipped = self.reserve(specs)
        if not free:
            return {"runId": "", "targets": [], "skipped": skipped, "message": "all targets are running"}
        if not self.slots.acquire(blocking=False):
            self.release(free)
            self.rejected += 1
            raise QueueFull("too many runs are waiting")
        run_id = str(uuid.uuid4())
        with self.lock:
            self.waiting += 1
        self.pool.submit(self._run, free, run_id)
        return {"runId": run_id, "targets": [s.name for s in free], "skipped": skipped, "message": "accepted"}

    def _run(self, specs: list[TargetSpec], run_id: str) -> None:
        with self.lock:
            self.waiting, self.busy = self.waiting - 1, self.busy + 1
        try:
            self.engine.run_targets(specs, run_id)
        finally:
            with self.lock:
                self.busy -= 1
            self.release(specs)
            self.slots.release()

    def release(self, specs: list[TargetSpec]) -> None:
        with self.lock:
            self.running.difference_update(s.name for s in specs)

    def submit_all(self) -> dict | None:
        return self.submit(list(self.pipeline.targets))

    def submit_group(self, group: int) -> dict | None:
        return self.submit([s for s in self.pipeline.targets if s.group == group])

    def submit_target(self, name: str) -> dict | None:
        return self.submit([s for s in self.pipeline.targets if s.name == name])

    def status(self) -> list[dict]:
        """Every configured target; one whose state cannot be read has none, and the rest is still there."""
        out = []
        for s in self.pipeline.targets:
            try:
                state = self.engine.state(s)
            except Exception:
                log.warning("the state of %s could not be read", s.name, exc_info=True)
                state = None
            out.append({"name": s.name, "running": s.name in self.running, "watermark": state, "targetRowCount": self.counts.get(s)})
        return out

    def exposition(self) -> str:
        """Counters, timers and gauges in the text format that scrapers read."""
        engine = self.engine.pool
        pools = {"runner": (lambda: self.busy, lambda: self.waiting), "etl": (engine.active, engine.waiting)}
        return "\n".join([*self.engine.totals.lines(), f"etl_runner_rejections_total {self.rejected}", *metrics.gauges(pools)]) + "\n"

    def shutdown(self, runs_s: float = RUNS_S, counts_s: float = COUNTS_S, targets_s: float = TARGETS_S) -> None:
        """Runs first, since they use the others; each within its time."""
        _end(self.pool, runs_s)
        self.counts.shutdown(counts_s)
        self.engine.shutdown(targets_s)
