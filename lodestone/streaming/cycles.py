"""Cycles with a fixed delay after completion, admission to one slot, loading once."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


def run_cycles(cycle: Callable[[int], object], interval_s: float, stop: Callable[[], bool], sleep: Callable[[float], object] = time.sleep, clock: Callable[[], float] = time.time) -> list[dict]:
    """Runs cycle(0) at once and each next one `interval_s` after the one before
    has ended; cycles never overlap and an error ends only its own cycle. A
    stream's processing-time trigger has a fixed rate instead, so each cycle
    runs its queries with `availableNow`. Returns the log."""
    log: list[dict] = []
    while not stop():
        start, error = clock(), None
        try:
            cycle(len(log))
        except Exception as e:
            error = str(e)
        log.append({"cycle": len(log), "started_at": start, "ended_at": clock(), "error": error})
        if stop():
            break
        sleep(interval_s)
    return log


def check_interval(seconds: int) -> int:
    if not 60 <= seconds <= 2_592_000:
        raise ValueError(f"an interval must be within 60 and 2592000 seconds, not {seconds}")
    return seconds


class CapacityError(RuntimeError):
    """No slot became free in time; unlike a failure of the model."""


class Admission:
    """A bounded number of slots that are waited for at most `timeout_s`."""

    def __init__(self, slots: int = 1, timeout_s: float = 0.2):
        self._slots, self.timeout_s = threading.BoundedSemaphore(slots), timeout_s

    def run(self, work: Callable[[], object]) -> tuple[object, float]:
        """(result, seconds waited)."""
        start = time.monotonic()
        if not self._slots.acquire(timeout=self.timeout_s):
            raise CapacityError("no capacity within the admission timeout")
        waited = time.monotonic() - start
        try:
            return work(), waited
        finally:
            self._slots.release()


class Once:
    """Loads a resource once per process; a failure is remembered and raised again."""

    def __init__(self, load: Callable[[], object]):
        self._load, self._lock, self._state = load, threading.Lock(), None

    def get(self):
        with self._lock:
            if self._state is None:
                try:
                    self._state = (self._load(), None)
                except Exception as e:
                    self._state = (None, e)
        value, error = self._state
        if error is not None:
            raise error
        return value
