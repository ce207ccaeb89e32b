"""``diff``: two versions of a dataset in one join and one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import resolve
from . import checks
from .asof import q
from .build import session
from .compare import ATOL, RTOL, as_number, differs, flips, is_number
from .results import DiffResult


def schema_changes(old: DataFrame, new: DataFrame, meta: Sequence[str]) -> tuple[list[dict[str, str]], list[str]]:
    """Changes with markers (+ added, - removed, ? another type), and the common value columns."""
    a, b = {f.name: f.dataType for f in old.schema}, {f.name: f.dataType for f in new.schema}
    out = [{"type": "+", "column": c, "detail": f"{b[c].simpleString()}, new"} for c in sorted(b.keys() - a.keys())]
    out += [{"type": "-", "column": c, "detail": f"{a[c].simpleString()}, removed"} for c in sorted(a.keys() - b.keys())]
    common = [c for c in old.columns if c in b and c not in meta]
    out += [{"type": "?", "column": c, "detail": f"{a[c].simpleString()} -> {b[c].simpleString()}"} for c in common if a[c] != b[c]]
    return out, common


def joined(old: DataFrame, new: DataFrame, keys: Sequence[str], label_time: str, common: Sequence[str]) -> DataFrame:
    """Full outer join: structs ``o`` and ``n`` of the common columns, null where a row is missing."""
    meta = [*keys, label_time]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[q(c).alias(f"__{name}{i}") for i, c in enumerate(meta)], F.struct(F.lit(1).alias("__here"), *[q(c) for c in common]).alias(name))

    on = F.lit(True)
    for i in range(len(meta)):
        on = on & (F.col(f"__o{i}") == F.col(f"__n{i}"))
    return side(old, "o").join(side(new, "n"), on, "full_outer")


def summary(both: DataFrame, old: DataFrame, new: DataFrame, common: Sequence[str], atol: float, rtol: float) -> DataFrame:
    """One row: joined, only_old, only_new, and of common column i changed_i, mean_i, max_i."""
    a, b = {f.name: f.dataType for f in old.schema}, {f.name: f.dataType for f in new.schema}
    met = F.col("o").isNotNull() & F.col("n").isNotNull()
    cells = [F.count_if(met).alias("joined"), F.count_if(F.col("n").isNull()).alias("only_old"), F.count_if(F.col("o").isNull()).alias("only_new")]
    for i, c in enumerate(common):
        x, y = F.col("o")[c], F.col("n")[c]
        cells.append(F.count_if(met & (differs(x, y, a[c], b[c], atol, rtol) | flips(x, y))).alias(f"changed_{i}"))
        if is_number(a[c], b[c]):
            delta = F.when(met & ~as_number(x).eqNullSafe(as_number(y)), as_number(y) - as_number(x))
            cells += [F.avg(delta).alias(f"mean_{i}"), F.max(F.abs(delta)).alias(f"max_{i}")]
    return both.agg(*cells)


def diff(old: Any, new: Any, *, keys: str | Sequence[str], label_time: str = "label_time", atol: float = ATOL, rtol: float = RTOL, spark: SparkSession | None = None) -> DiffResult:
    spark = session(spark)
    keys = [keys] if isinstance(keys, str) else list(keys)
    a, b = resolve(spark, old), resolve(spark, new)
    for what, df in (("The old dataset", a), ("The new dataset", b)):
        checks.need_columns(what, df, [*keys, label_time])
    changes, common = schema_changes(a, b, [*keys, label_time])
    r = summary(joined(a, b, keys, label_time, common), a, b, common, atol, rtol).first().asDict()
    n_old, n_new = a.count(), b.count()
    least = min(n_old, n_new)
    out = DiffResult(n_old, n_new, changes, {}, r["joined"], r["only_old"], r["only_new"])
    for i, c in enumerate(common):
        n = r[f"changed_{i}"]
        if n:
            out.value_changes[c] = {"changed_count": n, "changed_pct": n / least if least else 0.0} | ({"mean_delta": r[f"mean_{i}"], "max_delta": r[f"max_{i}"]} if f"mean_{i}" in r else {})
            out.schema_changes.append({"type": "~", "column": c, "detail": f"{n} values changed"})
        elif not any(x["column"] == c for x in changes):
            out.schema_changes.append({"type": "=", "column": c, "detail": "unchanged"})
    return out
