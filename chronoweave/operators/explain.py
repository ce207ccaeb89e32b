"""``explain``: what will be joined to what, in words, as SQL and as a Spark plan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import timedelta
from typing import Any

from pyspark.sql import SparkSession

from ..functions.durations import format_duration, parse_duration
from ..model import Feature, FeatureSet, Labels, flatten
from . import checks, planner
from .results import ExplainResult


def plan_rows(features: Sequence[Feature], back: timedelta, stale: timedelta | None, inclusive: bool, plans: Sequence[str] | None = None) -> list[dict[str, Any]]:
    out = []
    for i, f in enumerate(features):
        op, close = ("<=", "]") if inclusive else ("<", ")")
        minus = f" - INTERVAL '{format_duration(f.embargo)}'" if f.embargo else ""
        limit = back if stale is None else min(back, stale)
        source = str(getattr(f.source, "path", None) or f.source.name)
        keys = " AND ".join(f"{f.key_mapping.get(k, k)} = :{k}" for k in (list(f.key_mapping) or f.source.keys))
        if f.kind == "columns":
            rows = f"SELECT {', '.join([*f.source.keys, f.source.timestamp + ' AS feature_time', *(c if c == n else f'{c} AS {n}' for c, n in f.columns.items())])}\nFROM '{source}'"
        elif f.kind == "sql":
            rows = f.sql_text.strip()
        else:
            rows = f"-- transform {getattr(f.transform, '__name__', 'function')}(spark, source)"
        sql = f"SELECT * FROM (\n{rows}\n)\nWHERE {keys}\n  AND feature_time {op} :label_time{minus}\n  AND feature_time >= :label_time - INTERVAL '{format_duration(limit)}'\nORDER BY feature_time DESC LIMIT 1"
        out.append({
            "name": f.name, "source": source, "join_condition": f"{keys} and feature_time {op} label_time{minus}",
            "window": f"[label_time - {format_duration(limit)}, label_time{' - ' + format_duration(f.embargo) if f.embargo else ''}{close}",
            "embargo_str": format_duration(f.embargo) if f.embargo else "none", "strategy": plans[i] if plans else "by measured counts", "sql": sql,
        })
    return out


def explain(
    labels: Labels,
    features: Feature | FeatureSet | Iterable[Feature | FeatureSet],
    *,
    max_lookback: str | timedelta | None = "365d",
    max_staleness: str | timedelta | None = None,
    join: str = "strict",
    measure: bool = False,
    limits: planner.Limits = planner.Limits(),
    spark: SparkSession | None = None,
) -> ExplainResult:
    """The plan; only the labels are counted.

    ``measure``: also measure the sources as a build does, one job each, and
    name the plan that it would choose.
    """
    from .build import join_features, lookback, session

    spark, flat = session(spark), flatten(features)
    back, stale = lookback(max_lookback), parse_duration(max_staleness)
    checks.parameters(flat, back, stale, join, "null")
    counts = planner.label_counts(labels.load(spark), labels.keys, labels.label_time).first()
    plans: list[str] = []
    joined, _ = join_features(spark, labels, flat, back, stale, join == "inclusive", counts=counts if measure else None, limits=limits, check=measure, plans=plans)
    plan = joined._jdf.queryExecution().explainString(joined._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return ExplainResult(plan_rows(flat, back, stale, join == "inclusive", plans if measure else None), counts["n"], plan)
