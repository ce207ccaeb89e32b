"""Checks of schemas, time zones, duplicates, parameters and splits."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from ..errors import ConfigError, SchemaError, duplicates, missing_columns, timezone_mix
from ..model import Feature, Labels
from .asof import q

TIMES = (TimestampType, TimestampNTZType, DateType)


def need_columns(what: str, df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise missing_columns(what, missing, df.columns)


def source_schema(feature: Feature, source: DataFrame) -> None:
    s = feature.source
    wanted = [*s.keys, s.timestamp, *(feature.columns if feature.kind == "columns" else ())]
    need_columns(f"Source {s.name!r} of feature {feature.name!r}", source, wanted)
    if not isinstance(source.schema[s.timestamp].dataType, TIMES):
        raise SchemaError(f"Column {s.timestamp!r} of source {s.name!r} is {source.schema[s.timestamp].dataType.simpleString()}, not a time. Cast it to a timestamp.")


def label_schema(labels: Labels, df: DataFrame) -> None:
    need_columns("The label table", df, [*labels.keys, labels.label_time, *labels.target])
    if not isinstance(df.schema[labels.label_time].dataType, TIMES):
        raise SchemaError(f"Column {labels.label_time!r} of the labels is {df.schema[labels.label_time].dataType.simpleString()}, not a time. Cast it to a timestamp.")


def time_zones(feature: str, feature_type: object, label_type: object) -> None:
    """Both times must have a zone or neither; dates count as having none."""
    said = {True: "with a time zone", False: "without a time zone"}
    a, b = isinstance(feature_type, TimestampType), isinstance(label_type, TimestampType)
    if a != b:
        raise timezone_mix(feature, said[a], said[b])


def duplicate_groups(source: DataFrame, keys: Sequence[str], timestamp: str) -> DataFrame:
    """(keys, timestamp, n_rows) of every group of two rows or more."""
    by = [q(c) for c in [*keys, timestamp]]
    return source.groupBy(*by).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def duplicate_examples(source: DataFrame, keys: Sequence[str], timestamp: str, n: int = 3) -> DataFrame:
    """The ``n`` largest groups, ties in order of key and time."""
    return duplicate_groups(source, keys, timestamp).orderBy(F.desc("n_rows"), *[q(c) for c in [*keys, timestamp]]).limit(n)


def no_duplicates(feature: Feature, source: DataFrame, groups: int) -> None:
    """``groups`` of rows with equal key and time: an error, or with ``keep_any`` a warning."""
    s = feature.source
    if groups and feature.on_duplicate == "keep_any":
        warnings.warn(f"Source {s.name!r} has {groups} group(s) of rows with equal ({', '.join([*s.keys, s.timestamp])}); feature {feature.name!r} takes the greatest row of each.", stacklevel=3)
    elif groups:
        worst = duplicate_examples(source, s.keys, s.timestamp).collect()
        raise duplicates(s.name, groups, s.keys, s.timestamp, [str(r.asDict()) for r in worst])


def parameters(features: Sequence[Feature], max_lookback: timedelta, max_staleness: timedelta | None, join: str, on_missing: str) -> None:
    if join not in ("strict", "inclusive"):
        raise ConfigError(f"join may be 'strict' or 'inclusive', not {join!r}.")
    if on_missing not in ("null", "skip"):
        raise ConfigError(f"on_missing may be 'null' or 'skip', not {on_missing!r}.")
    seen: dict[str, str] = {}
    for f in features:
        plain = "".join(c if c.isalnum() or c == "_" else "_" for c in f.name)
        if plain in seen:
            raise ConfigError(f"Features {seen[plain]!r} and {f.name!r} have the same name once other characters become '_'. Rename one.")
        seen[plain] = f.name
        if f.embargo >= max_lookback:
            raise ConfigError(f"Feature {f.name!r}: the embargo ({f.embargo}) leaves nothing of the lookback ({max_lookback}).")
        if max_staleness is not None and max_staleness <= f.embargo:
            raise ConfigError(f"Feature {f.name!r}: the staleness limit ({max_staleness}) does not exceed the embargo ({f.embargo}).")
    by_name: dict[str, object] = {}
    for f in features:
        other = by_name.setdefault(f.source.name, f.source)
        if other is not f.source and other.definition() != f.source.definition():
            raise ConfigError(f"Two different sources are called {f.source.name!r}. Give one another name.")


def parse_time(value: str | datetime) -> datetime:
    try:
        return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
    except ValueError as e:
        raise ConfigError(f"Cannot read the time {value!r} of a split; write it as 2024-01-31 or 2024-01-31T12:00:00.") from e


def splits(given: Mapping[str, Sequence[str | datetime]], first: datetime | None, last: datetime | None) -> dict[str, tuple[datetime, datetime]]:
    """The splits in order of time; overlaps are errors, gaps and uncovered labels warnings."""
    out = {}
    for name, pair in given.items():
        if len(pair) != 2:
            raise ConfigError(f"Split {name!r} needs a start and an end.")
        a, b = map(parse_time, pair)
        if a >= b:
            raise ConfigError(f"Split {name!r} ends before it starts.")
        out[name] = (a, b)
    ordered = sorted(out.items(), key=lambda x: x[1])
    for (n1, (_, e1)), (n2, (s2, _)) in zip(ordered, ordered[1:], strict=False):
        if s2 < e1:
            raise ConfigError(f"Splits {n1!r} and {n2!r} overlap.")
        if s2 > e1:
            warnings.warn(f"Labels from {e1} to {s2} are in no split ({n1!r}, {n2!r}).", stacklevel=3)
    if ordered and first is not None and last is not None:
        if first.replace(tzinfo=None) < ordered[0][1][0].replace(tzinfo=None):
            warnings.warn(f"The first label ({first}) lies before the first split.", stacklevel=3)
        if last.replace(tzinfo=None) >= ordered[-1][1][1].replace(tzinfo=None):
            warnings.warn(f"The last label ({last}) lies after the last split.", stacklevel=3)
    return dict(ordered)
