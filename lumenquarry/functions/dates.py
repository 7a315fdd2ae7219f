"""Points in time: ISO dates, or so long before now."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenquarry.schema import ExitCode, IndexError_

# Seconds of a unit; m is months of 30 days here, as in file searches
AGO = {"h": 3600, "d": 86_400, "w": 604_800, "m": 2_592_000, "y": 31_536_000}


def parse_when(text: str, now_ns: int) -> int:
    """'2w' -> nanoseconds of two weeks before now; '2024-05-01' or '2024-05-01T10:00:00Z' -> of that time, UTC if it names no zone."""
    m = re.fullmatch(r"([0-9]+)([hdwmy])", text.strip())
    if m:
        return now_ns - int(m[1]) * AGO[m[2]] * 10**9
    try:
        t = datetime.fromisoformat(text.strip())
    except ValueError as e:
        raise IndexError_(f"not a date: {text!r}", ExitCode.CONFIG) from e
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return int(t.timestamp() * 1_000_000) * 1000


def timestamp_of_ns(ns: Column) -> Column:
    """Nanoseconds as a timestamp, cut to microseconds."""
    return F.timestamp_micros(F.floor(ns / 1000).cast("long"))


def now_ns() -> Column:
    return F.unix_micros(F.current_timestamp()) * 1000
