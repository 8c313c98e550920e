"""Event-time helpers. The current time is always passed in, never read from a clock."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, functions as F

_WINDOW = re.compile(r"(\d+)([hd])")


def window_length(text: str) -> dt.timedelta:
    """``"1h"`` or ``"7d"``; any other text means 24 hours."""
    found = _WINDOW.fullmatch(text)
    if not found:
        return dt.timedelta(hours=24)
    amount = int(found[1])
    return dt.timedelta(hours=amount) if found[2] == "h" else dt.timedelta(days=amount)


def before(now: dt.datetime, length: dt.timedelta) -> Column:
    """Literal ``now - length`` so that the comparison is pushed into the scan."""
    return F.lit(now - length)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def to_micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def slot(us: Column, length_sec: float) -> Column:
    """Index of the time slot of ``length_sec`` that holds a microsecond stamp.

    The remainder is taken off first, so the division is exact, also for negative stamps.
    """
    length = F.lit(to_micros(length_sec)).cast("long")
    return ((us - F.pmod(us, length)) / length).cast("long")
