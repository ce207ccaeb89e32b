"""``build``: one lazy plan from labels and features to a training set."""

from __future__ import annotations

import platform
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import UTC, datetime, timedelta
from pathlib import Path
from typing import Any

import pyspark
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.durations import format_duration, interval, parse_duration
from ..model import Feature, FeatureSet, Labels, flatten
from ..plans import compute
from ..store import Store, content_hash, definition_hash, file_size
from . import checks, planner
from .asof import joined_names, q, time_name
from .results import BuildResult, BuildStats

DEFAULT_LOOKBACK = timedelta(days=365)
VERSION = "0.1.0"


def session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def lookback(value: str | timedelta | None) -> timedelta:
    """Only None means the default; "0d" is a lookback of nothing."""
    parsed = parse_duration(value)
    return DEFAULT_LOOKBACK if parsed is None else parsed


def label_times(labels: DataFrame, label_time: str) -> DataFrame:
    """One row: n, first and last label time."""
    return labels.agg(F.count("*").alias("n"), F.min(q(label_time)).alias("first"), F.max(q(label_time)).alias("last"))


def flat_names(columns: Sequence[str], features: Sequence[str]) -> dict[str, str]:
    """Feature columns without their prefix, unless any two names would then be the same."""
    out = {}
    for c in columns:
        name = next((c[len(f) + 2 :] for f in features if c.startswith(f + "__")), c)
        out[c] = name
    return out if len(set(out.values())) == len(out) else {c: c for c in columns}


def keep_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every one of ``columns`` is known (a NaN is a known value)."""
    for c in columns:
        df = df.where(q(c).isNotNull())
    return df


def split_rows(df: DataFrame, label_time: str, start: datetime, end: datetime) -> DataFrame:
    """Rows with start <= label_time < end."""
    kind = df.schema[label_time].dataType
    return df.where((q(label_time) >= F.lit(start).cast(kind)) & (q(label_time) < F.lit(end).cast(kind)))


def statistics(joined: DataFrame, label_time: str, branches: Sequence[Any], inclusive: bool) -> DataFrame:
    """One row: n, and for feature i missing_i (first column null) and violations_i (invariant broken)."""
    return joined.agg(*_statistics(label_time, branches, inclusive))


def _statistics(label_time: str, branches: Sequence[Any], inclusive: bool) -> list[Column]:
    cells = [F.count("*").alias("n")]
    for i, b in enumerate(branches):
        first = joined_names(b)[0] if b.columns else time_name(b)
        bound = q(label_time) - interval(b.embargo)
        ft = q(time_name(b))
        late = (ft > bound) if inclusive else (ft >= bound)
        cells.append(F.count_if(q(first).isNull()).alias(f"missing_{i}"))
        cells.append(F.count_if(ft.isNotNull() & late).alias(f"violations_{i}"))
    return cells


def join_features(
    spark: SparkSession,
    labels: Labels,
    features: Sequence[Feature],
    max_lookback: timedelta,
    max_staleness: timedelta | None = None,
    inclusive: bool = False,
    spine: DataFrame | None = None,
    counts: Any = None,
    store: Store | None = None,
    cached: dict[str, bool] | None = None,
    skew_bucket: timedelta | None = None,
    told: Callable[[str], None] = lambda _: None,
    limits: planner.Limits = planner.Limits(),
    check: bool = True,
    plans: list[str] | None = None,
) -> tuple[DataFrame, list[Any]]:
    """The spine's keys, time and targets with all features' columns and times; and the branches.

    ``counts``: the labels' row of :func:`planner.label_counts`. ``check``: look
    for duplicates and measure the sources, one job each; without it nothing
    runs, and features go through the window. ``plans`` is filled with each
    feature's plan.
    """
    whole = labels.load(spark) if spine is None else spine
    checks.label_schema(labels, whole)
    spine = whole.select(*[q(c) for c in [*labels.keys, labels.label_time, *labels.target]]) if spine is None else spine
    sources, branches, measured, found = compute.Sources(spark), [], {}, []
    for i, f in enumerate(features, 1):
        told(f"Computing feature {i}/{len(features)}: {f.name}")
        source = sources.load(f)
        checks.source_schema(f, source)
        size = None
        if check:
            if id(f.source) not in measured:
                r = planner.source_counts(source, f.source.keys, f.source.timestamp).first()
                measured[id(f.source)] = planner.Measured(r["rows"], r["most"], r["groups"])
            size = measured[id(f.source)]
            checks.no_duplicates(f, source, size.duplicate_groups)
        key = store.feature_cache_key(f) if store else None
        if key and store.has_feature_cache(f.name, key):
            rows = spark.read.parquet(store.feature_cache_path(f.name, key))
            (cached if cached is not None else {})[f.name] = True
        else:
            rows = compute.feature_rows(spark, f, source)
            if key:
                path = store.feature_cache_path(f.name, key)
                rows.write.mode("overwrite").parquet(path)
                rows = spark.read.parquet(path)
        checks.time_zones(f.name, rows.schema[compute.TIME].dataType, spine.schema[labels.label_time].dataType)
        if counts:
            rows = compute.prune(rows, f, counts["first"], counts["last"], max_lookback)
        branches.append(compute.branch(f, rows, labels.keys, unique=size is not None and not size.duplicate_groups))
        found.append(size if f.kind == "columns" else None)
    told(f"Joining {len(features)} feature(s)")
    how = [planner.LOOKUP if not skew_bucket and planner.is_small(b, m, limits) else planner.FUSED for b, m in zip(branches, found, strict=True)]
    if counts and not skew_bucket:
        rest = [measured.get(id(f.source)) for f, p in zip(features, how, strict=True) if p == planner.FUSED]
        span = counts["last"] - counts["first"] + max_lookback if counts["n"] and counts["first"] is not None else None
        skew_bucket = planner.bucket_width(planner.Measured(counts["n"], counts["most"]), rest, span, limits) if rest else None
    if skew_bucket:
        how = [planner.BUCKETED if p == planner.FUSED else p for p in how]
    if plans is not None:
        plans += how
    return planner.join(spine, labels.keys, labels.label_time, branches, how, max_lookback, max_staleness, inclusive, skew_bucket), branches


def write(df: DataFrame, path: str, single_file: bool = False, order: Sequence[str] = ()) -> str:
    """Write Parquet, replacing ``path``; as one file if asked, sorted if asked."""
    if order:
        df = df.orderBy(*[q(c) for c in order])
    if not single_file:
        df.write.mode("overwrite").parquet(path)
        return path
    folder = f"{path}.parts-{uuid.uuid4().hex[:8]}"
    df.coalesce(1).write.mode("overwrite").parquet(folder)
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    part = next(str(s.getPath()) for s in fs.globStatus(hadoop.Path(f"{folder}/part-*.parquet")))
    fs.delete(hadoop.Path(path), True)
    fs.rename(hadoop.Path(part), hadoop.Path(path))
    fs.delete(hadoop.Path(folder), True)
    return path


def build(
    labels: Labels,
    features: Feature | FeatureSet | Iterable[Feature | FeatureSet],
    output: str | Path | None = None,
    *,
    max_lookback: str | timedelta | None = "365d",
    max_staleness: str | timedelta | None = None,
    join: str = "strict",
    on_missing: str = "null",
    splits: Mapping[str, Sequence[str]] | None = None,
    store: Store | None = None,
    flatten_columns: bool = False,
    progress: Callable[[str], None] | None = None,
    spark: SparkSession | None = None,
    single_file: bool = False,
    ordered: bool = False,
    skew_bucket: str | timedelta | None = None,
    limits: planner.Limits = planner.Limits(),
) -> BuildResult:
    """Join every label row to the newest feature rows that were available at its time.

    ``output`` becomes a directory of part files, or one file with
    ``single_file``. Without ``output`` the result's ``df`` is the lazy frame, and
    the join runs for its statistics and manifest only once these are asked for.
    How each feature is joined follows from measured counts (:mod:`.planner`).
    """
    spark, began, told = session(spark), time.time(), progress or (lambda _: None)
    flat = flatten(features)
    if not flat:
        raise ConfigError("A build needs at least one feature.")
    back, stale = lookback(max_lookback), parse_duration(max_staleness)
    checks.parameters(flat, back, stale, join, on_missing)
    inclusive = join == "inclusive"
    options = {"max_lookback": format_duration(back), "max_staleness": format_duration(stale), "join": join, "on_missing": on_missing}

    key = None
    if store is not None and output is not None:
        key = store.build_cache_key(labels, flat, options | {"output": str(output), "splits": {k: [str(x) for x in v] for k, v in (splits or {}).items()}, "flatten": flatten_columns, "single_file": single_file})
        if key and (found := store.find_cached_build(key)):
            stats = BuildStats(found["output"]["row_count"], found["output"]["column_count"], {n: {"matched": f["matched_rows"], "missing": f["missing_rows"]} for n, f in found["features"].items()}, time.time() - began)
            return BuildResult(found["output"]["path"], found, stats, found.get("splits"), found.get("sql", ""), spark.read.parquet(found["output"]["path"]))

    told("Loading labels")
    loaded = labels.load(spark)
    checks.label_schema(labels, loaded)
    times = planner.label_counts(loaded, labels.keys, labels.label_time).first()
    parts = checks.splits(splits, times["first"], times["last"]) if splits else {}
    cached: dict[str, bool] = {}
    plans: list[str] = []
    joined, branches = join_features(spark, labels, flat, back, stale, inclusive, counts=times, store=store, cached=cached, skew_bucket=parse_duration(skew_bucket), told=told, limits=limits, plans=plans)
    values = [n for b in branches for n in joined_names(b)]
    if on_missing == "skip":
        joined = keep_complete(joined, values)
    shown = [*labels.keys, labels.label_time, *labels.target, *values]
    names = flat_names(values, [f.name for f in flat]) if flatten_columns else {}
    if len({names.get(c, c) for c in shown}) < len(shown):
        names = {}
    order = [*labels.keys, labels.label_time] if ordered or single_file else []
    # one unsorted output: its tasks count what they write. A stage before a sort
    # might run twice and count twice, and splits read the join again
    seen = Observation() if output is not None and not parts and not order else None
    if seen is not None:
        joined = joined.observe(seen, *_statistics(labels.label_time, branches, inclusive))
    elif output is not None:
        joined = joined.persist(StorageLevel.MEMORY_AND_DISK)
    result = joined.select(*[q(c).alias(names.get(c, c)) for c in shown])

    def verified() -> dict[str, Any]:
        told("Verifying")
        return statistics(joined, labels.label_time, branches, inclusive).first().asDict()

    counts = None
    if seen is not None:
        told("Verifying")
    elif output is not None or store is not None:
        counts = verified()
    split_paths: dict[str, str] | None = None
    if output is not None:
        told("Writing")
        write(result, str(output), single_file, order)
        if parts:
            o = Path(str(output))
            split_paths = {}
            for name, (a, b) in parts.items():
                target = str(o.with_name(f"{o.stem}_{name}{o.suffix}"))
                split_paths[name] = write(split_rows(result, labels.label_time, a, b), target, single_file, order)
        if seen is None:
            joined.unpersist()
        else:
            counts = seen.get
        result = spark.read.parquet(str(output))
    took = time.time() - began
    from .explain import plan_rows

    text = "\n\n".join(p["sql"] for p in plan_rows(flat, back, stale, inclusive))
    now = datetime.now(UTC)

    def report() -> tuple[BuildStats, dict[str, Any]]:
        s = counts or verified()
        n = s["n"]
        per = {f.name: {"matched": n - s[f"missing_{i}"], "missing": s[f"missing_{i}"], "violations": s[f"violations_{i}"]} for i, f in enumerate(flat)}
        # The names of a manifest's entries.
        manifest: dict[str, Any] = {
            "version": VERSION,
            "build_id": f"{now:%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:6]}",
            "created_at": now.isoformat(),
            "duration_seconds": took,
            "labels": {"path": None if labels.path is None else str(labels.path), "content_hash": content_hash(labels.path), "row_count": times["n"], "time_range": [str(times["first"]), str(times["last"])], "keys": labels.keys, "label_time_column": labels.label_time, "target_columns": labels.target},
            "features": {
                f.name: {"definition_hash": definition_hash(f), "source_content_hash": content_hash(getattr(f.source, "path", None)), "embargo": format_duration(f.embargo), "matched_rows": per[f.name]["matched"], "missing_rows": per[f.name]["missing"], "output_columns": list(b.columns), "cached": cached.get(f.name, False), "plan": p}
                for f, b, p in zip(flat, branches, plans, strict=True)
            },
            "parameters": options,
            "output": {"path": None if output is None else str(output), "content_hash": content_hash(output), "row_count": n, "column_count": len(shown), "file_size_bytes": file_size(output)},
            "audit": {"passed": all(x["violations"] == 0 for x in per.values()), "invariant": f"feature_time {'<=' if inclusive else '<'} label_time - embargo", "rows_checked": n},
            "environment": {"python_version": platform.python_version(), "spark_version": pyspark.__version__, "os": platform.platform()},
            "splits": split_paths,
            "sql": text,
        }
        return BuildStats(n, len(shown), per, took), manifest

    if counts is None:
        return BuildResult(None, None, None, None, text, result, report)
    stats, manifest = report()
    if store is not None:
        manifest["build_cache_key"] = key
        manifest["manifest_path"] = str(store.save_build(manifest))
    return BuildResult(None if output is None else str(output), manifest, stats, split_paths, text, result)
