"""Errors. Each says what is wrong, where, and what to do about it."""

from __future__ import annotations

import difflib
from collections.abc import Iterable


class ChronoweaveError(Exception):
    """Base of all errors of this library."""


class SchemaError(ChronoweaveError):
    """A table lacks a column, or a column has an unusable type."""


class DuplicateError(ChronoweaveError):
    """A source has several rows of one key and timestamp."""


class TimezoneError(ChronoweaveError):
    """Timestamps with and without a time zone meet."""


class ConfigError(ChronoweaveError):
    """Parameters are missing, unknown or contradict each other."""


class LeakageError(ChronoweaveError):
    """A dataset holds feature values from the future."""


class ValidationError(ChronoweaveError):
    """Data of an unusable kind."""


def closest(name: str, among: Iterable[str]) -> str | None:
    """The one of ``among`` that ``name`` was most likely meant to be."""
    among = list(among)
    by_low = {a.lower(): a for a in among}
    if name.lower() in by_low:
        return by_low[name.lower()]
    found = difflib.get_close_matches(name, among, 1, 0.6)
    return found[0] if found else None


def missing_columns(what: str, missing: Iterable[str], columns: Iterable[str]) -> SchemaError:
    missing, columns = list(missing), list(columns)
    hints = [f"{m} (did you mean {c}?)" if (c := closest(m, columns)) else m for m in missing]
    return SchemaError(f"{what} lacks the column(s) {', '.join(hints)}. It has: {', '.join(columns)}. Correct the name, or map it with key_mapping or columns.")


def duplicates(name: str, groups: int, keys: list[str], timestamp: str, examples: list[str]) -> DuplicateError:
    shown = "".join(f"\n  {e}" for e in examples)
    return DuplicateError(
        f"Source {name!r} has {groups} group(s) of rows with equal ({', '.join([*keys, timestamp])}).{shown}\n"
        "Which row is right cannot be told. Remove the duplicates, or set on_duplicate='keep_any' to take one of each."
    )


def timezone_mix(feature: str, feature_type: str, label_type: str) -> TimezoneError:
    return TimezoneError(f"The times of feature {feature!r} are {feature_type}, those of the labels {label_type}. Cast one of them, so that both have a time zone or neither has.")
