"""Which plan joins a feature: a broadcast lookup, the fused window, or the window cut at hot keys.

The choice rests on counts that the checks measure anyway: rows, and rows of the
most frequent key. A feature of few rows, few of them a key, whose measured size
is below the session's broadcast threshold, is looked up, and the labels are not
shuffled for it. All others share one window; where one key would give a task
too many rows to sort, each key's axis is cut into buckets of time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import interval
from .asof import Branch, as_of, common_key_types, joined_names, known, orderable, q, time_name

LOOKUP, FUSED, BUCKETED = "lookup", "fused", "bucketed"


@dataclass(frozen=True)
class Limits:
    """From when on another plan is better."""

    #: Rows of a feature, and of its most frequent key, up to which it is looked up.
    lookup_rows: int = 50_000
    lookup_depth: int = 64
    #: Rows of one key, labels and features together, that one task may sort.
    hot_rows: int = 4_000_000


@dataclass(frozen=True)
class Measured:
    rows: int
    most: int
    duplicate_groups: int = 0


def source_counts(source: DataFrame, keys: Sequence[str], timestamp: str) -> DataFrame:
    """One row: rows, most (of one key), groups (of rows with equal key and time)."""
    by = [q(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    at = source.groupBy(*by, q(timestamp).alias("__t")).agg(F.count("*").alias("n"))
    a_key = at.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("twice"))
    return a_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("twice"), F.lit(0)).alias("groups"))


def label_counts(labels: DataFrame, keys: Sequence[str], label_time: str) -> DataFrame:
    """One row: n, first and last label time, most (labels of one key)."""
    t = q(label_time)
    a_key = labels.groupBy(*[q(k) for k in keys]).agg(F.count("*").alias("n"), F.min(t).alias("first"), F.max(t).alias("last"))
    return a_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def threshold(spark: SparkSession) -> int:
    """The session's broadcast threshold in bytes; negative where it is switched off."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def is_small(branch: Branch, measured: Measured | None, limits: Limits) -> bool:
    """May the branch be looked up? Its size in bytes is measured once its row counts allow it."""
    if measured is None or measured.rows > limits.lookup_rows or measured.most > limits.lookup_depth:
        return False
    if not all(orderable(branch.rows.schema[c].dataType) for c in branch.columns):
        return False
    size = branch.rows.select(F.sum(F.length(F.to_json(F.struct("*"))).cast("long")).alias("n")).first()["n"] or 0
    return size <= threshold(branch.rows.sparkSession)


def bucket_width(labels: Measured, branches: Sequence[Measured | None], span: timedelta | None, limits: Limits) -> timedelta | None:
    """Length of the buckets if a key may have more rows than a task should sort; None if not."""
    most = labels.most + sum(m.most for m in branches if m)
    if most <= limits.hot_rows or not span:
        return None
    return max(timedelta(seconds=1), span / (2 * -(-most // limits.hot_rows)))


def lookup(labels: DataFrame, keys: Sequence[str], label_time: str, branch: Branch, max_lookback: timedelta, max_staleness: timedelta | None = None, inclusive: bool = False) -> DataFrame:
    """The feature's columns and time from a broadcast table of one sorted list a key.

    Of rows tied in time the one with the greatest payload comes last, and wins.
    """
    limit = max_lookback if max_staleness is None else min(max_lookback, max_staleness)
    types = common_key_types(labels, keys, [branch])
    at = [f"__k{i}" for i in range(len(keys))]
    rows = branch.rows.where(known([*keys, "feature_time"]))
    row = F.struct(F.col("feature_time").alias("ft"), *[q(c).alias(f"c{i}") for i, c in enumerate(branch.columns)])
    lists = rows.groupBy(*[q(k).cast(types[k]).alias(a) for k, a in zip(keys, at, strict=True)]).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    on = F.lit(True)
    for k, a in zip(keys, at, strict=True):
        on = on & (q(k).cast(types[k]) == F.col(a))
    bound = q(label_time) - interval(branch.embargo) if branch.embargo else q(label_time)
    seen = F.filter("__rows", lambda x: ((x["ft"] <= bound) if inclusive else (x["ft"] < bound)) & (x["ft"] >= q(label_time) - interval(limit)))
    met = labels.join(F.broadcast(lists), on, "left").withColumn("__best", F.try_element_at(seen, F.lit(-1)))
    best = F.col("__best")
    values = [best[f"c{i}"].alias(n) for i, n in enumerate(joined_names(branch))]
    return met.select(*[q(c) for c in labels.columns], *values, best["ft"].alias(time_name(branch)))


def join(
    labels: DataFrame,
    keys: Sequence[str],
    label_time: str,
    branches: Sequence[Branch],
    plans: Sequence[str],
    max_lookback: timedelta,
    max_staleness: timedelta | None = None,
    inclusive: bool = False,
    bucket: timedelta | None = None,
) -> DataFrame:
    """``labels`` with the columns of all branches, in their order, each by its plan."""
    out = labels
    for b, p in zip(branches, plans, strict=True):
        if p == LOOKUP:
            out = lookup(out, keys, label_time, b, max_lookback, max_staleness, inclusive)
    rest = [b for b, p in zip(branches, plans, strict=True) if p != LOOKUP]
    out = as_of(out, keys, label_time, rest, max_lookback, max_staleness, inclusive, bucket)
    return out.select(*[q(c) for c in labels.columns], *[q(n) for b in branches for n in [*joined_names(b), time_name(b)]])
