"""Runs of a job on a schedule, and what happens to it on a signal."""

from __future__ import annotations

import logging
import signal
import threading
from collections.abc import Callable
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

log = logging.getLogger(__name__)
# The bounds of the fields of a cron expression, seconds first, and the names in them.
_BOUNDS = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
_NAMES = {n: str(i) for names, at in (("jan feb mar apr may jun jul aug sep oct nov dec", 1), ("sun mon tue wed thu fri sat", 0)) for i, n in enumerate(names.split(), at)}


def _field(text: str, low: int, high: int) -> frozenset[int]:
    out: set[int] = set()
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        first, dash, last = span.partition("-")
        a, b = (low, high) if first in ("*", "?") else (int(_NAMES.get(first, first)), int(_NAMES.get(last, last)) if dash else high if step else int(_NAMES.get(first, first)))
        if not low <= a <= high or not low <= b <= high or a > b or (step and int(step) < 1):
            raise ValueError(f"{part} is not within {low}-{high}")
        out.update(range(a, b + 1, int(step) if step else 1))
    return frozenset(out)


class Cron:
    """A cron expression of five fields, or of six with seconds first, in a time zone. If both day fields
    are given, either may fit, as is usual."""

    def __init__(self, text: str, zone: str | None = None) -> None:
        parts = text.split()
        if len(parts) not in (5, 6):
            raise ValueError(f"a cron expression has five or six fields: {text}")
        parts = ["0", *parts] if len(parts) == 5 else parts
        self.fields = [_field(p, *b) for p, b in zip(parts, _BOUNDS)]
        self.fields[5] = frozenset(d % 7 for d in self.fields[5])
        self.any_day, self.any_week = parts[3] in ("*", "?"), parts[5] in ("*", "?")
        self.zone = ZoneInfo(zone or "UTC")

    def _day(self, t: datetime) -> bool:
        by_day, by_week = t.day in self.fields[3], t.isoweekday() % 7 in self.fields[5]
        return t.month in self.fields[4] and ((by_day or by_week) if not (self.any_day or self.any_week) else (by_day and by_week))

    def after(self, moment: datetime) -> datetime:
        """The first time after ``moment`` that fits; an error if there is none in eight years."""
        t = (moment.astimezone(self.zone) + timedelta(seconds=1)).replace(microsecond=0)
        end = t + timedelta(days=8 * 366)
        while t < end:
            if not self._day(t):
                t = (t + timedelta(days=1)).replace(hour=0, minute=0, second=0)
            elif t.hour not in self.fields[2]:
                t = (t + timedelta(hours=1)).replace(minute=0, second=0)
            elif t.minute not in self.fields[1]:
                t = (t + timedelta(minutes=1)).replace(second=0)
            elif t.second not in self.fields[0]:
                t += timedelta(seconds=1)
            else:
                return t
        raise ValueError("the expression fits no time")


def run_scheduled(job: Callable[[], object], cron: Cron, stop: threading.Event | None = None, now: Callable[[], datetime] | None = None, most: int | None = None) -> int:
    """Runs ``job`` at the times of ``cron`` until ``stop`` is set, ``most`` times at most; how often it ran. A
    failure is logged and does not end the schedule. A run that takes longer than the gap skips times."""
    stop, runs = stop or threading.Event(), 0
    now = now or (lambda: datetime.now(cron.zone))
    while not stop.is_set() and (most is None or runs < most):
        wait = (cron.after(now()) - now()).total_seconds()
        if stop.wait(max(0.0, wait)):
            break
        try:
            job()
        except Exception:
            log.exception("a scheduled run failed")
        runs += 1
    return runs


def on_signals(clean_up: Callable[[], None]) -> Callable[[], None]:
    """Cleans up and exits with 1 on SIGTERM and SIGINT; returns what restores the handlers before."""
    before = {s: signal.getsignal(s) for s in (signal.SIGTERM, signal.SIGINT)}

    def handle(number: int, frame: object) -> None:
        log.warning("signal %s", number)
        clean_up()
        raise SystemExit(1)

    for s in before:
        signal.signal(s, handle)
    return lambda: [signal.signal(s, h) for s, h in before.items()] and None
