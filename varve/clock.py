"""Hybrid logical clock: BIGINT nanoseconds whose low 16 bits count."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGICAL_BITS = 16
LOGICAL_MASK = (1 << LOGICAL_BITS) - 1
MAX_OFFSET_NS = 500_000_000


class ClockError(RuntimeError):
    """The wall clock went back, or a peer's clock is ahead, by more than the allowed offset."""


def nanos(ts: Column) -> Column:
    """A TIMESTAMP or TIMESTAMP_NTZ column as nanoseconds (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000).cast("bigint")


def whole(x: Column, n: int) -> Column:
    """``x`` div ``n`` for longs, rounded down, with all digits."""
    return F.call_function("div", x - F.pmod(x, F.lit(n).cast("bigint")), F.lit(n).cast("bigint"))


def physical(ts: Column) -> Column:
    """The wall-clock part of a clock value."""
    return ts.bitwiseAND(F.lit(~LOGICAL_MASK).cast("bigint"))


def logical(ts: Column) -> Column:
    """The counter part of a clock value."""
    return ts.bitwiseAND(F.lit(LOGICAL_MASK).cast("bigint"))


def subtract(a: Column, b: Column) -> Column:
    """Nanoseconds between the wall-clock parts of two values."""
    return physical(a) - physical(b)


def as_timestamp(ts: Column) -> Column:
    """For display only: a TIMESTAMP has microseconds."""
    return F.timestamp_micros(whole(ts, 1000))


def offset(t1: Column, t2: Column, t4: Column) -> Column:
    """Clock offset from a request sent at t1, seen by the peer at t2 and answered at t4."""
    return whole(F.abs((t2 - t1) + (t2 - t4)), 2)


class Clock:
    """Driver-side clock that stamps commits: strictly increasing, and never behind what it has seen."""

    def __init__(self, wall: Callable[[], int] = time.time_ns, max_offset: int = MAX_OFFSET_NS):
        self._wall, self._max, self._last, self._lock = wall, max_offset, 0, threading.Lock()

    def _tick(self, wall: int) -> int:
        self._last = max(wall, self._last + 1)
        return self._last

    def now(self) -> int:
        """The next timestamp."""
        with self._lock:
            wall = self._wall() & ~LOGICAL_MASK
            if (self._last & ~LOGICAL_MASK) - wall > self._max:
                raise ClockError("the wall clock went back")
            return self._tick(wall)

    def update(self, incoming: int) -> int:
        """A timestamp after ``incoming``, which may be ahead by the allowed offset at most."""
        with self._lock:
            wall = self._wall() & ~LOGICAL_MASK
            if (incoming & ~LOGICAL_MASK) - wall > self._max:
                raise ClockError("the incoming timestamp is out of range")
            self._last = max(self._last, incoming)
            return self._tick(wall)
