"""What a run tells under -v: its options, and each step with counts and times."""

from __future__ import annotations

import logging
import time
from dataclasses import fields

from hopwise.plans.options import Options

log = logging.getLogger("hopwise")


def grouped(n: int) -> str:
    """A whole number with a space between thousands."""
    return f"{n:,}".replace(",", " ")


def ratio(a: int, b: int) -> str:
    """a / b with two decimals, cut off."""
    hundredths = 100 * a // b
    return f"{hundredths // 100}.{hundredths % 100:02d}"


def duration(seconds: float) -> str:
    """The two largest units, or seconds with milliseconds."""
    whole = int(seconds)
    units = ((whole // 86400, "d"), (whole // 3600 % 24, "h"), (whole // 60 % 60, "m"), (whole % 60, "s"))
    for (n, name), (rest, below) in zip(units, units[1:], strict=False):
        if n:
            return f"{n}{name} {rest}{below}"
    return f"{int(seconds * 1000) / 1000:.3f}s"


class RunLog:
    """Logs steps with the time since the start and what they took. Nothing is counted or logged unless wanted, as a count is a job."""

    def __init__(self, wanted: bool) -> None:
        self.wanted, self.start = wanted, time.monotonic()
        self.mark = self.start

    def options(self, o: Options) -> None:
        if self.wanted:
            for f in fields(o):
                log.info("%-20s %s", f.name, getattr(o, f.name))
            log.info("%-20s %s", "mode", o.mode)

    def step(self, what: str, *counts) -> None:
        """what, with a place for each of the counts; those are numbers or called for them."""
        if self.wanted:
            now = time.monotonic()
            said = what.format(*[grouped(c() if callable(c) else c) for c in counts])
            log.info("[%s] %s (%s)", duration(now - self.start), said, duration(now - self.mark))
            self.mark = time.monotonic()
