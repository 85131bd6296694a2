"""Thread pools with a bounded queue, for loads that run side by side."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, wait


class BoundedPool:
    """``threads`` at work and ``queue`` waiting; what comes beyond that runs in its caller."""

    def __init__(self, threads: int, queue: int):
        self.threads, self.pool = threads, ThreadPoolExecutor(threads)
        self.free, self.open, self.lock = threading.Semaphore(threads + queue), set(), threading.Lock()

    def submit(self, f: Callable, *args) -> Future:
        if self.free.acquire(blocking=False):
            future = self.pool.submit(f, *args)
            with self.lock:
                self.open.add(future)
            future.add_done_callback(self._done)
            return future
        future = Future()
        try:
            future.set_result(f(*args))
        except Exception as error:
            future.set_exception(error)
        return future

    def _done(self, future: Future) -> None:
        with self.lock:
            self.open.discard(future)
        self.free.release()

    def active(self) -> int:
        with self.lock:
            return sum(f.running() for f in self.open)

    def waiting(self) -> int:
        with self.lock:
            return sum(not f.running() and not f.done() for f in self.open)

    def shutdown(self, wait_s: float) -> bool:
        """No more work; True if all that was open ended within ``wait_s``."""
        self.pool.shutdown(wait=False)
        began = time.monotonic()
        with self.lock:
            open_ = list(self.open)
        left = wait(open_, timeout=wait_s - (time.monotonic() - began)).not_done
        for future in left:
            future.cancel()
        return not left
