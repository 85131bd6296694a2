"""Runs: the life of one target's load, groups of targets, retries."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable
from concurrent.futures import wait
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.render import AUTH_WORDS
from tidemark.functions.statements import resolved
from tidemark.functions.watermark import effective
from tidemark.operators.merge import repeatable
from tidemark.operators.paging import pages
from tidemark.operators.staging import latest_per_key
from tidemark.plans.metrics import Totals
from tidemark.plans.pools import BoundedPool
from tidemark.sources import state as st
from tidemark.sources.snapshot import SnapshotTable
from tidemark.spec import TargetSpec

ATTEMPTS, WORKERS, QUEUE, PAGE_S = 3, 8, 32, 600.0
#: Events that an engine can still show; totals hold what came before.
EVENTS = 10_000
log = logging.getLogger("tidemark")


def texts_of(error: BaseException | None) -> list[str]:
    """Messages along the chain of causes, a Spark error's own causes among them."""
    texts, seen = [], set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        texts.append(str(error) or type(error).__name__)
        error = error.__cause__ or getattr(error, "cause", None) or error.__context__
    return texts


def is_auth_error(error: BaseException | None, kinds: tuple[type, ...] = ()) -> bool:
    """A given kind anywhere on the chain of causes, or a telling word in its messages."""
    at, seen = error, set()
    while at is not None and id(at) not in seen:
        seen.add(id(at))
        if isinstance(at, kinds):
            return True
        at = at.__cause__ or getattr(at, "cause", None) or at.__context__
    low = " ".join(texts_of(error)).lower()
    return any(w in low for w in AUTH_WORDS)


def groups(specs: Iterable[TargetSpec]) -> list[list[TargetSpec]]:
    """Groups by ascending number, each to run together; then targets without one, in
    configured order, each alone."""
    by_id: dict[int, list[TargetSpec]] = {}
    alone = []
    for s in specs:
        (by_id.setdefault(s.group, []) if s.group is not None else alone).append(s)
    return [by_id[g] for g in sorted(by_id)] + [[s] for s in alone]


@dataclass
class Engine:
    """Loads targets into snapshot tables below ``warehouse``."""

    spark: SparkSession
    warehouse: str
    clock: Callable[[], datetime] = st.now
    classify: Callable[[BaseException], bool] = is_auth_error
    workers: int = WORKERS
    queue: int = QUEUE
    #: Seconds after which the jobs of a page's fetch are cancelled.
    page_s: float = PAGE_S
    events: deque[dict] = field(default_factory=lambda: deque(maxlen=EVENTS))
    totals: Totals = field(default_factory=Totals)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def __post_init__(self):
        #: Targets of a group that run together; what does not fit the queue runs in the caller.
        self.pool = BoundedPool(self.workers, self.queue)

    def table(self, spec: TargetSpec) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.warehouse}/{spec.name}", spec.buckets)

    def read(self, spec: TargetSpec) -> DataFrame:
        return self.table(spec).read()

    def state(self, spec: TargetSpec) -> dict | None:
        return self.table(spec).manifest()["state"]

    def _store(self, spec: TargetSpec, change: Callable[[dict | None], dict]) -> dict:
        table = self.table(spec)
        manifest = table.manifest()
        return table.publish(manifest, state=change(manifest["state"]))["state"]

    def _tell(self, spec: TargetSpec, run_id: str, event: str, **values) -> None:
        told = {"target": spec.name, "run_id": run_id, "event": event, **values}
        with self._lock:
            self.events.append(told)
            self.totals.add(told)
        log.info("%s %s", event, spec.name, extra={"target": spec.name, "runId": run_id, "group": spec.group, "page": values.get("page"), "told": values})

    def run_target(self, spec: TargetSpec, run_id: str | None = None, stop_after: int | None = None) -> bool:
        """One run; True if it finished.  Failures are recorded, not raised, unless they
        end the process.  ``stop_after`` breaks off after so many pages, for tests."""
        run_id, began = run_id or str(uuid.uuid4()), self.clock()
        # A scheduler pool of its own lets targets share the cluster fairly.
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", spec.name)
        try:
            last = self._store(spec, lambda s: st.begin(s, spec, run_id, began))
            spec = resolved(spec, self.spark)
            stored = st.read_watermark(last, spec)
            tuple_resume = spec.resume == "tuple" and last.get("last_keys") and stored is not None
            wm = stored if tuple_resume else effective(spec, stored)
            keys = tuple(last["last_keys"]) if tuple_resume else None
            rows = self._pages(spec, run_id, wm, keys, stored, stop_after)
            ended = self.clock()
            ms = int((ended - began).total_seconds() * 1000)
            self._store(spec, lambda s: st.finish(s, rows, ms, ended))
            self.table(spec).vacuum()
            self._tell(spec, run_id, "run", status="ok", seconds=ms / 1000, rows=rows)
            return True
        except Exception as error:
            ended, text = self.clock(), "\n".join(texts_of(error))
            try:
                self._store(spec, lambda s: st.fail(s, spec, text, ended))
            except Exception:
                log.exception("the failure of %s could not be recorded: %s", spec.name, text)
            self._tell(spec, run_id, "run", status="failed", seconds=(ended - began).total_seconds(), rows=0)
            return False
        finally:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    def _pages(self, spec: TargetSpec, run_id: str, wm, keys, stored, stop_after: int | None) -> int:
        table, rows, n = self.table(spec), 0, 0
        staging = f"{self.warehouse}/_staging/{spec.name}"
        began = time.monotonic()
        # As many rows as the target has: the whole load costs no more than a few times its rows.
        together = spec.publish == "grow" and spec.dedupe != "latest" and repeatable(spec.merge, spec.joined_by)
        least = (lambda: table.rows()) if together else (lambda: 1)
        for staged, found in self._fetched(spec, run_id, wm, keys, staging, least):
            if not found["rows"]:
                # A fetch that finds nothing takes its time, too.
                self._tell(spec, run_id, "fetch", page_seconds=time.monotonic() - began)
                break
            rows, fetched = rows + found["rows"], time.monotonic()
            mark = max(found["wm"], stored) if spec.monotonic and stored is not None else found["wm"]
            # The merge itself fails for null and repeated keys.
            page = latest_per_key(staged, spec.joined_by, (spec.watermarkColumn,)) if spec.dedupe == "latest" else staged
            after = st.progress(table.manifest()["state"], spec, mark, rows, found["keys"] if spec.resume == "tuple" else None)
            did = table.merge(page, spec.joined_by, spec.merge, state=after, page_rows=found["rows"], fixed=spec.schema == "fixed", pages=found["page"])
            merged, ended = did["update"] + did["insert"] + did["delete"], time.monotonic()
            # Pages that were merged together share what that took.
            for k, own in enumerate(found["pages"], 1):
                n, of = n + 1, len(found["pages"])
                self._tell(spec, run_id, "page", page=n, rows=own, merged=merged if k == of else 0, page_seconds=(fetched - began) / of, merge_seconds=(ended - fetched) / of)
            began = ended
            if stop_after is not None and n >= stop_after:
                raise RuntimeError(f"stopped after page {n}")
        return rows

    def _fetched(self, spec: TargetSpec, run_id: str, wm, keys, staging: str, least: Callable[[], int]):
        """Pages; a failure that looks like one of authentication is tried again from the last page's end."""
        loop, failed = None, 0
        while True:
            try:
                with self._limited(spec):
                    loop = loop or pages(self.spark, spec, wm, keys, staging, least)
                    got = next(loop, None)
            except Exception as error:
                failed += 1
                if failed == ATTEMPTS or not self.classify(error):
                    raise
                self._tell(spec, run_id, "retry", attempt=failed)
                loop = None
                continue
            if got is None:
                return
            yield got
            failed = 0
            if got[1]["rows"]:
                wm, keys = got[1]["wm"], got[1]["keys"]

    @contextmanager
    def _limited(self, spec: TargetSpec):
        """Jobs in here are cancelled after ``page_s``, whatever their source."""
        context, group = self.spark.sparkContext, f"{spec.name}-{uuid.uuid4().hex}"
        context.setJobGroup(group, f"page of {spec.name}", True)
        timer = threading.Timer(self.page_s, context.cancelJobGroup, [group])
        timer.daemon = True
        timer.start()
        try:
            yield
        finally:
            timer.cancel()
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(name, None)

    def run_targets(self, specs: Iterable[TargetSpec], run_id: str | None = None) -> dict[str, bool]:
        """Groups one after the other, the targets of a group together.  A failed target
        does not hold up the next group."""
        run_id, done = run_id or str(uuid.uuid4()), {}
        for together in groups(specs):
            futures = {s.name: self.pool.submit(self.run_target, s, run_id) for s in together}
            wait(futures.values())
            # A target that raised all the same failed; the others' results stand.
            done |= {name: f.exception() is None and f.result() for name, f in futures.items()}
        return done

    def shutdown(self, wait_s: float) -> None:
        self.pool.shutdown(wait_s)

    def reset_stale(self, specs: Iterable[TargetSpec]) -> int:
        """At start: runs that a dead process left open become failures."""
        n, at = 0, self.clock()
        for s in specs:
            if (self.state(s) or {}).get("current_run_started"):
                self._store(s, lambda old, s=s: st.fail(old, s, st.STALE, at))
                n += 1
        return n
