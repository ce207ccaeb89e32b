"""``audit``: does a dataset hold values that were not available at its label times?"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.durations import parse_duration
from ..model import Feature, FeatureSet, Labels, flatten
from ..sources.readers import resolve
from . import checks
from .asof import joined_names, q, time_name
from .build import join_features, lookback, session
from .compare import ATOL, RTOL, differs
from .results import AuditReport, FeatureAuditDetail, severity

SAMPLE = 1000


def temporal_summary(data: DataFrame, feature_time_columns: Mapping[str, str], label_time: str) -> DataFrame:
    """One row: n, and for column i leaky_i, max_i, median_i (feature_time - label_time of leaky rows), null_i."""
    cells = [F.count("*").alias("n")]
    for i, (_, ft) in enumerate(feature_time_columns.items()):
        leaky = q(ft).isNotNull() & (q(ft) >= q(label_time))
        span = F.when(leaky, q(ft) - q(label_time))
        cells += [F.count_if(leaky).alias(f"leaky_{i}"), F.max(span).alias(f"max_{i}"), F.median(span).alias(f"median_{i}"), F.count_if(q(ft).isNull()).alias(f"null_{i}")]
    return data.agg(*cells)


def audit_temporal(data: Any, feature_time_columns: Mapping[str, str], label_time: str = "label_time", spark: SparkSession | None = None) -> AuditReport:
    """Judge a dataset by the feature times that it holds itself: leaky where feature_time >= label_time."""
    spark = session(spark)
    df = resolve(spark, data)
    checks.need_columns("The dataset", df, [label_time, *feature_time_columns.values()])
    r = temporal_summary(df, feature_time_columns, label_time).first()
    out = AuditReport(total_rows=r["n"], mode="temporal")
    for i, (name, ft) in enumerate(feature_time_columns.items()):
        n = r[f"leaky_{i}"]
        share = n / r["n"] if r["n"] else 0.0
        rows = df.where(q(ft) >= q(label_time)).limit(SAMPLE) if n else None
        out.features[name] = FeatureAuditDetail(name, n, share, r[f"max_{i}"], r[f"median_{i}"], severity(share, r[f"max_{i}"]) if n else "OK", r["n"], r[f"null_{i}"], n == 0, rows)
    return out


def rebuilt(spark: SparkSession, data: DataFrame, features: Sequence[Feature], keys: Sequence[str], label_time: str, back: timedelta, stale: timedelta | None, inclusive: bool) -> tuple[DataFrame, list[dict[str, Any]]]:
    """``data`` with the right values beside its own, and which columns to compare.

    The data's own values ride on the spine: no row numbers, no second join.
    """
    names = {c: f"__d{i}" for i, c in enumerate(data.columns) if c not in keys and c != label_time}
    spine = data.select(*[q(c).alias(names.get(c, c)) for c in data.columns])
    stand_in = next(iter(names.values()), None) or label_time
    joined, branches = join_features(spark, Labels(df=spine, keys=list(keys), label_time=label_time, target=stand_in), features, back, stale, inclusive, spine=spine)
    plan = []
    for f, b in zip(features, branches, strict=True):
        pairs = []
        for c, right in zip(b.columns, joined_names(b), strict=True):
            own = f"{f.name}__{c}" if f"{f.name}__{c}" in names else c if c in names else None
            if own:
                pairs.append((names[own], right))
        plan.append({"name": f.name, "pairs": pairs, "time": time_name(b)})
    return joined, plan


def rebuild_summary(joined: DataFrame, plan: Sequence[Mapping[str, Any]], label_time: str, atol: float = ATOL, rtol: float = RTOL) -> DataFrame:
    """One row: n, and for feature i leaky_i (most over its columns), unsupported_i, max_i, median_i (age), null_i."""
    types = {f.name: f.dataType for f in joined.schema}
    cells = [F.count("*").alias("n")]
    for i, p in enumerate(plan):
        counts = [F.count_if(differs(q(a), q(b), types[a], types[b], atol, rtol)) for a, b in p["pairs"]]
        lost = [F.count_if(q(a).isNotNull() & q(b).isNull()) for a, b in p["pairs"]]
        age = q(label_time) - q(p["time"])

        def most(cols: list) -> Any:
            return F.greatest(*cols) if len(cols) > 1 else cols[0] if cols else F.lit(0).cast("long")

        first = q(p["pairs"][0][1]) if p["pairs"] else F.lit(None)
        cells += [most(counts).alias(f"leaky_{i}"), most(lost).alias(f"unsupported_{i}"), F.max(age).alias(f"max_{i}"), F.median(age).alias(f"median_{i}"), F.count_if(first.isNull()).alias(f"null_{i}")]
    return joined.agg(*cells)


def audit(
    data: Any,
    features: Feature | FeatureSet | Iterable[Feature | FeatureSet] | None = None,
    *,
    keys: str | Sequence[str] | None = None,
    label_time: str = "label_time",
    feature_time_columns: Mapping[str, str] | None = None,
    max_lookback: str | timedelta | None = "365d",
    max_staleness: str | timedelta | None = None,
    join: str = "strict",
    count_unsupported: bool = False,
    spark: SparkSession | None = None,
) -> AuditReport:
    """Rebuild the features and compare, or, with ``feature_time_columns``, judge by the times given.

    ``count_unsupported``: rows whose value no available feature row supports
    make a feature leaky too.
    """
    if feature_time_columns is not None:
        return audit_temporal(data, feature_time_columns, label_time, spark)
    if features is None or keys is None:
        raise ConfigError("An audit needs features and keys, or feature_time_columns.")
    spark = session(spark)
    flat, keys = flatten(features), [keys] if isinstance(keys, str) else list(keys)
    back, stale = lookback(max_lookback), parse_duration(max_staleness)
    checks.parameters(flat, back, stale, join, "null")
    df = resolve(spark, data)
    checks.need_columns("The dataset", df, [*keys, label_time])
    joined, plan = rebuilt(spark, df, flat, keys, label_time, back, stale, join == "inclusive")
    r = rebuild_summary(joined, plan, label_time).first()
    types = {f.name: f.dataType for f in joined.schema}
    out = AuditReport(total_rows=r["n"], mode="rebuild")
    for i, p in enumerate(plan):
        n, lost = r[f"leaky_{i}"], r[f"unsupported_{i}"]
        bad = n + lost if count_unsupported else n
        share = bad / r["n"] if r["n"] else 0.0
        rows = None
        if bad:
            hit = F.lit(False)
            for a, b in p["pairs"]:
                hit = hit | differs(q(a), q(b), types[a], types[b], ATOL, RTOL)
                if count_unsupported:
                    hit = hit | (q(a).isNotNull() & q(b).isNull())
            rows = joined.where(hit).select(*[q(k) for k in keys], q(label_time), *[q(c) for pair in p["pairs"] for c in pair], q(p["time"])).limit(SAMPLE)
        out.features[p["name"]] = FeatureAuditDetail(p["name"], bad, share, r[f"max_{i}"], r[f"median_{i}"], severity(share, r[f"max_{i}"]) if bad else "OK", r["n"], r[f"null_{i}"], bad == 0, rows, lost)
    return out


audit.temporal = audit_temporal
