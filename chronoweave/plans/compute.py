"""From a feature's declaration to its rows."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, missing_columns
from ..model import Feature
from ..operators.asof import Branch, q
from ..operators.checks import need_columns, source_schema
from ..sources.readers import zoneless

TIME = "feature_time"


class Sources:
    """The loaded sources of one call; a source shared by features is loaded once."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._by_object: dict[int, DataFrame] = {}

    def load(self, feature: Feature) -> DataFrame:
        key = id(feature.source)
        if key not in self._by_object:
            self._by_object[key] = feature.source.load(self.spark)
        return self._by_object[key]


def feature_rows(spark: SparkSession, feature: Feature, source: DataFrame) -> DataFrame:
    """The source's keys, ``feature_time`` and the feature's columns."""
    source_schema(feature, source)
    s = feature.source
    if feature.kind == "columns":
        return source.select(*[q(k) for k in s.keys], q(s.timestamp).alias(TIME), *[q(c).alias(n) for c, n in feature.columns.items()])
    if feature.kind == "sql":
        view = f"source_{uuid.uuid4().hex}"
        source.createOrReplaceTempView(view)
        try:
            # quoted identifiers as in standard SQL; the plan is bound to the view here
            before = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
            spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
            rows = spark.sql(feature.sql_text.replace("{source}", view))
        finally:
            spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", before)
            spark.catalog.dropTempView(view)
    else:
        rows = feature.transform(spark, source)
    need_columns(f"The result of feature {feature.name!r}", rows, [*s.keys, TIME])
    return zoneless(rows, TIME) if feature.kind == "sql" else rows


def output_columns(feature: Feature, rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c != TIME and c not in feature.source.keys]


def branch(feature: Feature, rows: DataFrame, label_keys: list[str], unique: bool = False) -> Branch:
    """The feature's rows under the labels' key names."""
    to_source = {k: feature.key_mapping.get(k, k) for k in label_keys}
    missing = [v for v in to_source.values() if v not in rows.columns]
    if missing:
        raise missing_columns(f"Feature {feature.name!r}", missing, rows.columns)
    columns = output_columns(feature, rows)
    clash = [c for c in columns if c in to_source]
    if clash:
        raise ConfigError(f"Feature {feature.name!r} has a column {clash[0]!r}, which is also a key of the labels. Rename it with columns={{...}}.")
    out = rows.select(*[q(v).alias(k) for k, v in to_source.items()], q(TIME), *[q(c) for c in columns])
    return Branch(feature.name, out, tuple(columns), feature.embargo, unique and feature.kind == "columns" and set(to_source.values()) == set(feature.source.keys))


def prune(rows: DataFrame, feature: Feature, first: object, last: object, lookback: timedelta) -> DataFrame:
    """Only rows that some label may see, as two literal bounds that reach the scan.

    For selected columns only: SQL and functions may need history.
    """
    if feature.kind != "columns" or first is None or last is None:
        return rows
    return rows.where((F.col(TIME) >= F.lit(first - lookback)) & (F.col(TIME) <= F.lit(last - feature.embargo)))
