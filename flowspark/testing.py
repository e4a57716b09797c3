"""Helpers for tests of flows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from typing import Any

from .sinks import TestingSink
from .sources import TestingSource

__all__ = ["TestingSink", "TestingSource", "TimeTestingGetter", "ffwd_iter", "poll_next_batch"]


class TimeTestingGetter:
    """A clock that a test sets."""

    def __init__(self, now: datetime):
        self.now = now

    def advance(self, by: timedelta) -> None:
        self.now += by

    def get(self) -> datetime:
        return self.now


def ffwd_iter(it: Iterator, n: int) -> None:
    """Skips n items."""
    next(islice(it, n, n), None)


def poll_next_batch(part: Any, timeout: timedelta = timedelta(seconds=5)) -> list:
    """Asks a part until it gives a batch with something in it."""
    import time

    until = time.monotonic() + timeout.total_seconds()
    while time.monotonic() < until:
        if got := list(part.next_batch()):
            return got
        time.sleep(0.001)
    raise TimeoutError("no batch came")
