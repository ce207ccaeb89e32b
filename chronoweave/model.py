"""What users declare: sources, features, feature sets and labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import timedelta
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError
from .functions.durations import parse_duration
from .sources import readers

#: Suffixes by which a path's format is known.
FORMATS = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv"}
Rows = Any  # a DataFrame, a pandas DataFrame, or an Arrow table


def _keys(keys: str | Sequence[str]) -> list[str]:
    out = [keys] if isinstance(keys, str) else list(keys)
    if not out or not all(isinstance(k, str) and k for k in out):
        raise ConfigError("keys must name at least one column.")
    return out


@dataclass(eq=False)
class Source:
    """Timestamped rows of entities: a path or a table of rows.

    A source is told apart by being another object, not by its name.
    """

    path: str | Path | None = None
    keys: str | Sequence[str] = ()
    timestamp: str = ""
    df: Rows = None
    name: str | None = None
    format: str | None = None
    delimiter: str = ","
    timestamp_format: str | None = None
    #: Column types of a CSV, as a Spark schema; inferred by a scan of its own if not given.
    schema: Any = None

    def __post_init__(self) -> None:
        if (self.path is None) == (self.df is None):
            raise ConfigError("A source needs exactly one of path and df.")
        self.keys = _keys(self.keys)
        if not self.timestamp:
            raise ConfigError("A source needs the name of its timestamp column.")
        self.name = self.name or (Path(str(self.path)).stem if self.path is not None else "dataframe")
        if self.df is not None:
            self.format = "dataframe"
        elif self.format is None:
            suffix = Path(str(self.path)).suffix.lower()
            if suffix not in FORMATS and suffix:
                raise ConfigError(f"The format of {str(self.path)!r} is not known by its suffix. Set format='parquet' or format='csv'.")
            self.format = FORMATS.get(suffix, "parquet")
        elif self.format not in ("parquet", "csv"):
            raise ConfigError(f"Unknown format {self.format!r}; it may be 'parquet' or 'csv'.")

    def load(self, spark: SparkSession) -> DataFrame:
        if self.df is not None:
            return readers.rows(spark, self.df)
        if self.format == "csv":
            return readers.csv(spark, str(self.path), self.delimiter, self.timestamp_format, self.schema)
        return readers.parquet(spark, str(self.path))

    def definition(self) -> dict[str, Any]:
        """What identifies the source, for caches; data given as rows cannot be identified."""
        return {"kind": type(self).__name__, "path": None if self.path is None else str(self.path), "keys": list(self.keys), "timestamp": self.timestamp, "format": self.format, "delimiter": self.delimiter, "timestamp_format": self.timestamp_format, "schema": None if self.schema is None else str(self.schema)}


def ParquetSource(path: str | Path, keys: str | Sequence[str], timestamp: str, name: str | None = None) -> Source:  # noqa: N802
    return Source(path=path, keys=keys, timestamp=timestamp, name=name, format="parquet")


def CSVSource(path: str | Path, keys: str | Sequence[str], timestamp: str, name: str | None = None, delimiter: str = ",", timestamp_format: str | None = None) -> Source:  # noqa: N802
    return Source(path=path, keys=keys, timestamp=timestamp, name=name, format="csv", delimiter=delimiter, timestamp_format=timestamp_format)


@dataclass(eq=False)
class SQLSource:
    """Timestamped rows that a Spark SQL query gives; ``views`` names DataFrames it may refer to."""

    query: str
    keys: str | Sequence[str]
    timestamp: str
    name: str
    views: Mapping[str, DataFrame] = field(default_factory=dict)
    format: str = "sql"

    def __post_init__(self) -> None:
        self.keys = _keys(self.keys)
        if not self.query.strip() or not self.name or not self.timestamp:
            raise ConfigError("A SQL source needs a query, a name and a timestamp column.")

    def load(self, spark: SparkSession) -> DataFrame:
        return readers.sql(spark, self.query, self.views, self.timestamp)

    def definition(self) -> dict[str, Any]:
        return {"kind": "SQLSource", "query": self.query, "keys": list(self.keys), "timestamp": self.timestamp}


Columns = str | Sequence[str] | Mapping[str, str]
Transform = Callable[[SparkSession, DataFrame], DataFrame]


@dataclass(eq=False)
class Feature:
    """Named columns derived from one source: by selection, by SQL or by a function."""

    source: Source | SQLSource
    columns: Columns | None = None
    sql: str | Path | None = None
    transform: Transform | None = None
    name: str | None = None
    embargo: str | timedelta | None = None
    key_mapping: Mapping[str, str] | None = None
    on_duplicate: str = "error"

    def __post_init__(self) -> None:
        given = [k for k in ("columns", "sql", "transform") if getattr(self, k) is not None]
        if len(given) != 1:
            raise ConfigError(f"A feature needs exactly one of columns, sql and transform; given: {', '.join(given) or 'none'}.")
        self.kind = given[0]
        self.sql_text: str | None = None
        own: str | None = None
        if self.kind == "columns":
            self.columns = self._column_map(self.columns)
            own = "_".join(self.columns.values())
        elif self.kind == "sql":
            if isinstance(self.sql, Path):
                self.sql_text, own = self.sql.read_text(), self.sql.stem
            else:
                self.sql_text = str(self.sql)
            if not self.sql_text.strip():
                raise ConfigError("A feature's sql must not be empty.")
        else:
            if not callable(self.transform):
                raise ConfigError("transform must be a function of (spark, source DataFrame).")
            own = getattr(self.transform, "__name__", None)
        self.name = self.name or own
        if not self.name:
            raise ConfigError("A feature of inline SQL needs a name.")
        self.embargo = parse_duration(self.embargo) or timedelta(0)
        self.key_mapping = dict(self.key_mapping or {})
        if self.on_duplicate not in ("error", "keep_any"):
            raise ConfigError(f"on_duplicate may be 'error' or 'keep_any', not {self.on_duplicate!r}.")

    @staticmethod
    def _column_map(columns: Columns) -> dict[str, str]:
        if isinstance(columns, str):
            out = {columns: columns}
        elif isinstance(columns, Mapping):
            out = dict(columns)
        else:
            out = {c: c for c in columns}
        if not out or not all(k and v for k, v in out.items()):
            raise ConfigError("A feature's columns must name at least one column.")
        if len(set(out.values())) < len(out):
            raise ConfigError("A feature's columns must have different names.")
        return out

    def definition(self) -> dict[str, Any]:
        how: Any = self.columns if self.kind == "columns" else self.sql_text if self.kind == "sql" else self._code()
        return {"name": self.name, "kind": self.kind, "how": how, "embargo": str(self.embargo), "key_mapping": self.key_mapping, "on_duplicate": self.on_duplicate, "source": self.source.definition()}

    def _code(self) -> str:
        code = getattr(self.transform, "__code__", None)
        return f"{getattr(self.transform, '__qualname__', '')}:{code.co_code.hex() if code else ''}:{code.co_consts if code else ''}"


@dataclass(eq=False)
class FeatureSet:
    """A named list of features."""

    name: str
    features: Sequence[Feature]

    def __post_init__(self) -> None:
        self.features = list(self.features)
        if not all(isinstance(f, Feature) for f in self.features):
            raise ConfigError("A feature set holds features only.")


def flatten(features: Feature | FeatureSet | Iterable[Feature | FeatureSet]) -> list[Feature]:
    """All features in order, those of feature sets included."""
    if isinstance(features, Feature | FeatureSet):
        features = [features]
    out: list[Feature] = []
    for f in features:
        if isinstance(f, FeatureSet):
            out.extend(f.features)
        elif isinstance(f, Feature):
            out.append(f)
        else:
            raise ConfigError(f"Expected a Feature or FeatureSet, got {type(f).__name__}.")
    return out


@dataclass(eq=False)
class Labels:
    """The spine: entity keys, the time of the label, and at least one target."""

    path: str | Path | None = None
    keys: str | Sequence[str] = ()
    label_time: str = ""
    target: str | Sequence[str] = ()
    df: Rows = None
    delimiter: str = ","

    def __post_init__(self) -> None:
        if (self.path is None) == (self.df is None):
            raise ConfigError("Labels need exactly one of path and df.")
        self.keys = _keys(self.keys)
        self.target = [self.target] if isinstance(self.target, str) and self.target else list(self.target)
        if not self.label_time:
            raise ConfigError("Labels need the name of their time column.")
        if not self.target:
            raise ConfigError("Labels need at least one target column.")

    def load(self, spark: SparkSession) -> DataFrame:
        if self.df is not None:
            return readers.rows(spark, self.df)
        if str(self.path).lower().endswith(".csv"):
            return readers.csv(spark, str(self.path), self.delimiter)
        return readers.parquet(spark, str(self.path))
