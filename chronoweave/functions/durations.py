"""Durations: parsing, printing, and one Spark interval literal for each."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError

_TEXT = re.compile(r"(?:(\d+)d)?\s*(?:(\d+)h)?\s*(?:(\d+)m)?\s*(?:(\d+)s)?", re.ASCII)
_US = timedelta(microseconds=1)


def parse_duration(value: str | timedelta | None) -> timedelta | None:
    """A timedelta from ``"30d"``, ``"1d6h"``, ``"15m"``, ``"0"``, a timedelta, or None; never negative."""
    if value is None:
        return None
    if isinstance(value, timedelta):
        if value < timedelta(0):
            raise ConfigError(f"A duration must not be negative: {value}.")
        return value
    if not isinstance(value, str):
        raise ConfigError(f"A duration is a string such as '1d6h' or a timedelta, not {type(value).__name__}.")
    text = value.strip().lower()
    if text == "0":
        return timedelta(0)
    m = _TEXT.fullmatch(text)
    if not text or not m or not any(g is not None for g in m.groups()):
        raise ConfigError(f"Cannot read the duration {value!r}. Write days, hours, minutes and seconds in this order, such as '30d', '1d6h' or '15m'.")
    d, h, mi, s = (int(g or 0) for g in m.groups())
    return timedelta(days=d, hours=h, minutes=mi, seconds=s)


def format_duration(value: timedelta | None) -> str:
    """The shortest text that :func:`parse_duration` reads back; seconds may have a fraction."""
    if value is None:
        return "none"
    if value == timedelta(0):
        return "0"
    if value < timedelta(0):
        return "-" + format_duration(-value)
    seconds, us = value.seconds, value.microseconds
    parts = [(value.days, "d"), (seconds // 3600, "h"), (seconds // 60 % 60, "m")]
    out = "".join(f"{n}{unit}" for n, unit in parts if n)
    last = seconds % 60
    if us:
        out += f"{last + us / 1e6:.6f}".rstrip("0") + "s"
    elif last:
        out += f"{last}s"
    return out


def microseconds(value: timedelta) -> int:
    return value // _US


def interval(value: timedelta) -> Column:
    """One day-time interval, so that it can be added or taken away as a whole."""
    seconds = value.seconds % 60
    return F.make_dt_interval(
        F.lit(value.days), F.lit(value.seconds // 3600), F.lit(value.seconds // 60 % 60), F.lit(f"{seconds}.{value.microseconds:06d}").cast("decimal(18,6)")
    )


def days_between(earlier: str | Column, later: str | Column) -> Column:
    """Midnights from ``earlier`` to ``later``, as a long; negative the other way round."""
    return F.datediff(later, earlier).cast("long")


def day(time: str | Column) -> Column:
    """The midnight before a time without a zone, which it stays."""
    return F.to_date(time).cast("timestamp_ntz")
