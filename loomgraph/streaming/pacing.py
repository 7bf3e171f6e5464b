"""Pacing of calls to outside services, on the driver or inside one task."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

R = TypeVar("R")

# fixed values: repeats, first pause and longest pause in seconds
RETRIES, FIRST_PAUSE, LONGEST_PAUSE = 3, 1.0, 30.0


class FixedInterval:
    """At most ``per_minute`` calls a minute, evenly spaced; none or fewer means no limit."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap = 60.0 / per_minute if per_minute > 0 else 0.0
        self.clock, self.sleep = clock, sleep
        self.next = float("-inf")

    def wait(self) -> float:
        """Wait for the turn; returns the seconds waited."""
        now = self.clock()
        pause = max(0.0, self.next - now)
        if pause:
            self.sleep(pause)
        self.next = max(now, self.next) + self.gap
        return pause


def pauses(retries: int = RETRIES, first: float = FIRST_PAUSE, longest: float = LONGEST_PAUSE) -> list[float]:
    """The pauses between attempts, each twice the one before, none longer than ``longest``."""
    return [min(longest, first * 2**k) for k in range(retries)]


def retried(call: Callable[[], R], retry_on: tuple[type[Exception], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep, **shape: float) -> R:
    """The result of ``call``, repeated after a pause where it fails in a way that may pass; the last failure is raised."""
    for pause in pauses(**shape):
        try:
            return call()
        except retry_on:
            sleep(pause)
    return call()
