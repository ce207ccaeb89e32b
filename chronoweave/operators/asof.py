"""The fused as-of join: one shuffle, one sort and one window for all features.

Labels and the rows of every feature are laid on one time axis a key: a label
at its own time, a feature row at its time plus its embargo. One window over
the key, ordered by that time, carries each feature's newest row forward to the
labels. A row older than the lookback or staleness limit is masked afterwards;
if the newest row is too old, every other one is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType

from ..errors import SchemaError
from ..functions.durations import interval, microseconds


@dataclass(frozen=True)
class Branch:
    """A feature's rows: label-named ``keys``, ``feature_time`` and ``columns``.

    ``unique``: no two rows have the same key and time, so no tie is to be settled.
    """

    name: str
    rows: DataFrame
    columns: tuple[str, ...]
    embargo: timedelta = timedelta(0)
    unique: bool = False


def q(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def known(columns: Sequence[str]) -> Column:
    """None of the columns is null."""
    out = F.lit(True)
    for c in columns:
        out = out & q(c).isNotNull()
    return out


def joined_names(branch: Branch) -> list[str]:
    return [f"{branch.name}__{c}" for c in branch.columns]


def time_name(branch: Branch) -> str:
    return f"{branch.name}__feature_time"


def _common_key_type(key: str, a: DataType, b: DataType) -> DataType:
    if a == b:
        return a
    if isinstance(a, IntegralType) and isinstance(b, IntegralType):
        return a if a.jsonValue() == "long" else b
    if isinstance(a, StringType) != isinstance(b, StringType):
        raise SchemaError(f"Key {key!r} is {a.simpleString()} in the labels and {b.simpleString()} in a feature. Cast one of them.")
    return a


def common_key_types(labels: DataFrame, keys: Sequence[str], branches: Sequence[Branch]) -> dict[str, DataType]:
    """The type in which each key is compared."""
    types = {f.name: f.dataType for f in labels.schema}
    for b in branches:
        kinds = {f.name: f.dataType for f in b.rows.schema}
        for k in keys:
            types[k] = _common_key_type(k, types[k], kinds[k])
    return types


def orderable(kind: DataType) -> bool:
    """Can values of the type be sorted? Those that hold maps or variants cannot."""
    return not any(x in kind.simpleString() for x in ("map<", "variant", "interval"))


def as_of(
    labels: DataFrame,
    keys: Sequence[str],
    label_time: str,
    branches: Sequence[Branch],
    max_lookback: timedelta,
    max_staleness: timedelta | None = None,
    inclusive: bool = False,
    skew_bucket: timedelta | None = None,
) -> DataFrame:
    """``labels`` with ``{feature}__{column}`` and ``{feature}__feature_time`` of each branch.

    Every label row comes out once, duplicates too. Rows with a null key or
    time match nothing. Of rows tied in time the one with the greatest payload
    wins, whatever the plan. ``skew_bucket``: cut each key's axis into pieces of
    that length, so that a hot key spreads over many tasks.
    """
    if not branches:
        return labels
    label_cols = labels.columns
    names = {c: f"__l{i}" for i, c in enumerate(label_cols)}
    label_types = {f.name: f.dataType for f in labels.schema}
    key_types = common_key_types(labels, keys, branches)
    at = [f"__k{i}" for i in range(len(keys))]

    spine = labels.select(
        *[q(k).cast(key_types[k]).alias(a) for k, a in zip(keys, at, strict=True)],
        q(label_time).alias("__t"),
        F.lit(1 if inclusive else 0).alias("__side"),
        F.struct(*[q(c).alias(names[c]) for c in label_cols]).alias("__label"),
    )
    union = spine
    payloads = [f"__p{i}" for i in range(len(branches))]
    for b, p in zip(branches, payloads, strict=True):
        own = F.struct(F.col("feature_time").alias("ft"), *[q(c).alias(f"c{i}") for i, c in enumerate(b.columns)])
        rows = b.rows.where(known([*keys, "feature_time"]))
        when = F.col("feature_time") + interval(b.embargo) if b.embargo else F.col("feature_time")
        side = rows.select(
            *[q(k).cast(key_types[k]).alias(a) for k, a in zip(keys, at, strict=True)],
            when.alias("__t"), F.lit(0 if inclusive else 1).alias("__side"), own.alias(p),
        )
        union = union.unionByName(side, allowMissingColumns=True)

    # a tie in time is settled by the payload itself, or where it has no order by
    # its text: by nothing that depends on the plan
    ties = {p: F.col(p) if all(orderable(b.rows.schema[c].dataType) for c in b.columns) else F.to_json(p) for b, p in zip(branches, payloads, strict=True) if not b.unique}
    order = ["__t", "__side", *ties.values()]
    if skew_bucket:
        found = _bucketed(union, at, order, payloads, ties, skew_bucket)
    else:
        axis = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = union.select("*", *[F.last(p, ignorenulls=True).over(axis).alias(f"{p}_at") for p in payloads])
    found = found.where("__label is not null")

    limit = max_lookback if max_staleness is None else min(max_lookback, max_staleness)
    t = F.col("__label")[names[label_time]]
    keyed = known(at)
    out = [F.col("__label")[names[c]].alias(c) for c in label_cols]
    for b, p in zip(branches, payloads, strict=True):
        got = F.col(f"{p}_at")
        valid = keyed & (got["ft"] >= t - interval(limit))
        out += [F.when(valid, got[f"c{i}"]).alias(n) for i, n in enumerate(joined_names(b))]
        out.append(F.when(valid, got["ft"]).alias(time_name(b)))
    return found.select(*out)


def _bucketed(union: DataFrame, at: list[str], order: list, payloads: list[str], ties: dict[str, Column], width: timedelta) -> DataFrame:
    """The same in two steps: newest row within the bucket, else the newest of the buckets before."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("__t").cast("timestamp_ntz"))
    cut = union.withColumn("__b", F.floor(us / microseconds(width)))
    inside = Window.partitionBy(*at, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = cut.select("*", *[F.last(p, ignorenulls=True).over(inside).alias(f"{p}_in") for p in payloads]).where("__label is not null")
    newest = [F.max_by(p, F.when(F.col(p).isNotNull(), F.struct("__t", *([ties[p]] if p in ties else [])))).alias(p) for p in payloads]
    per_bucket = cut.groupBy(*at, "__b").agg(*newest)
    earlier = Window.partitionBy(*at).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(*[F.col(a).alias(f"{a}_c") for a in at], F.col("__b").alias("__b_c"), *[F.last(p, ignorenulls=True).over(earlier).alias(f"{p}_before") for p in payloads])
    same = F.col("__b") == F.col("__b_c")
    for a in at:
        same = same & (F.col(a) == F.col(f"{a}_c"))
    both = near.join(carried, same, "left")
    return both.select(*union.columns, *[F.coalesce(f"{p}_in", f"{p}_before").alias(f"{p}_at") for p in payloads])


def newest_per_key(rows: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key, of rows tied in time the first by ``ties``."""
    newest = Window.partitionBy(*[q(k) for k in keys]).orderBy(q(time).desc(), *[q(c) for c in ties])
    return rows.withColumn("__nth", F.row_number().over(newest)).where("__nth = 1").drop("__nth")


def range_join(labels: DataFrame, keys: Sequence[str], label_time: str, branch: Branch, max_lookback: timedelta, max_staleness: timedelta | None = None, inclusive: bool = False) -> DataFrame:
    """The plain plan for one feature: a band join, then the newest row of each label.

    Right for few rows a key; it makes a row for every pair within the window.
    """
    limit = max_lookback if max_staleness is None else min(max_lookback, max_staleness)
    spine = labels.select(F.struct(*[q(c) for c in labels.columns]).alias("l"), F.monotonically_increasing_id().alias("id"))
    rows = branch.rows.select(F.struct(*[q(c) for c in branch.rows.columns]).alias("f"))
    bound = F.col("l")[label_time] - interval(branch.embargo)
    on = (F.col("f")["feature_time"] <= bound) if inclusive else (F.col("f")["feature_time"] < bound)
    on = on & (F.col("f")["feature_time"] >= F.col("l")[label_time] - interval(limit))
    for k in keys:
        on = on & (F.col("l")[k] == F.col("f")[k])
    best = spine.join(rows, on, "left").groupBy("id").agg(F.first("l").alias("l"), F.max_by("f", F.struct(F.col("f")["feature_time"], F.to_json("f"))).alias("f"))
    got = [F.col("f")[c].alias(n) for c, n in zip(branch.columns, joined_names(branch), strict=True)]
    return best.select(*[F.col("l")[c].alias(c) for c in labels.columns], *got, F.col("f")["feature_time"].alias(time_name(branch)))
