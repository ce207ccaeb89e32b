"""Command line: inspect, audit, build, explain, diff, catalog, doctor, init, quickstart."""

from __future__ import annotations

import argparse
import importlib.util
import json
import logging
import re
import runpy
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, TimestampNTZType, TimestampType

from .errors import ChronoweaveError, ConfigError
from .model import Feature, FeatureSet, Labels
from .operators.asof import q
from .operators.build import DEFAULT_LOOKBACK, VERSION
from .sources.readers import resolve

CONFIG = ("chronoweave.yaml", "chronoweave.yml")


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column, n_distinct, n_rows of each column.

    Exact counts shuffle each column's values; ``approximate`` counts by sketches
    of a fixed size in one pass, within 2 %.
    """
    count = (lambda c: F.approx_count_distinct(c, 0.02)) if approximate else F.count_distinct
    counts = df.agg(F.count("*").alias("__n"), *[count(q(c)).alias(f"__c{i}") for i, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"__c{i}").alias("n_distinct"), F.col("__n").alias("n_rows")) for i, c in enumerate(df.columns)]
    return counts.select(F.inline(F.array(*cells)))


def inspect_table(df: DataFrame, approximate: bool = False) -> dict[str, Any]:
    """Types, distinct counts, and which columns look like a key and a timestamp."""
    found = {r["column"]: r for r in distinct_counts(df, approximate).collect()}
    out: dict[str, Any] = {"columns": [], "keys": [], "timestamps": [], "row_count": 0}
    for f in df.schema:
        r = found[f.name]
        share = r["n_distinct"] / r["n_rows"] if r["n_rows"] else 0.0
        out["row_count"] = r["n_rows"]
        out["columns"].append({"name": f.name, "type": f.dataType.simpleString(), "distinct": r["n_distinct"], "distinct_pct": share})
        if isinstance(f.dataType, IntegralType) and share > 0.99:
            out["keys"].append(f.name)
        if isinstance(f.dataType, TimestampType | TimestampNTZType | DateType) and share > 0.1:
            out["timestamps"].append(f.name)
    return out


def load_config(folder: Path = Path(".")) -> dict[str, Any]:
    """The YAML settings; nothing where there is no file, or none that holds a mapping."""
    import yaml

    for name in CONFIG:
        if (folder / name).exists():
            try:
                got = yaml.safe_load((folder / name).read_text())
            except yaml.YAMLError:
                return {}
            return got if isinstance(got, dict) else {}
    return {}


def load_features(spec: str) -> list[Feature]:
    """Features and feature sets of a Python file in order of name; ``file.py:name`` takes one."""
    path, _, only = spec.partition(".py:")
    path = path + ".py" if only else spec
    if not Path(path).exists():
        raise ConfigError(f"There is no features file {path!r}.")
    names = runpy.run_path(path)
    out: list[Feature] = []
    for n in sorted(names):
        v = names[n]
        if isinstance(v, Feature | FeatureSet) and only in ("", n, getattr(v, "name", None)):
            out += [f for f in (v.features if isinstance(v, FeatureSet) else [v]) if f not in out]
    if not out:
        raise ConfigError(f"No feature {only or ''} in {path!r}.")
    return out


def parse_split(text: str) -> tuple[str, tuple[str, str]]:
    """``name:start:end``; times may hold colons themselves."""
    moment = r"\d{4}-\d\d-\d\d(?:[T ]\d\d(?::\d\d(?::\d\d(?:\.\d+)?)?)?)?"
    m = re.fullmatch(rf"([^:]+):({moment}):({moment})", text)
    if not m:
        raise ConfigError(f"Write a split as name:start:end, such as train:2024-01-01:2024-02-01; got {text!r}.")
    return m[1], (m[2], m[3])


def _spark() -> SparkSession:
    return SparkSession.builder.appName("chronoweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _labels(args: argparse.Namespace, config: dict[str, Any], spark: SparkSession) -> Labels:
    c = config.get("labels") or {}
    path = args.labels or c.get("path")
    if not path:
        raise ConfigError("Name the labels by --labels or in the configuration.")
    df = resolve(spark, path)
    times = [f.name for f in df.schema if isinstance(f.dataType, TimestampType | TimestampNTZType)]
    label_time = args.label_time or c.get("label_time") or ("label_time" if "label_time" in df.columns else next(iter(times), None))
    keys = (args.keys.split(",") if args.keys else None) or c.get("keys") or [x for x in df.columns if x.endswith("_id")][:1]
    target = c.get("target") or [x for x in df.columns if x not in keys and x != label_time]
    return Labels(path=path, keys=keys, label_time=label_time, target=target)


def _features(args: argparse.Namespace, config: dict[str, Any]) -> list[Feature]:
    specs = args.features or config.get("features")
    if not specs:
        raise ConfigError("Name a features file by --features or in the configuration.")
    return [f for s in ([specs] if isinstance(specs, str) else specs) for f in load_features(s)]


def _setting(args: argparse.Namespace, config: dict[str, Any], name: str, default: Any) -> Any:
    """Command line before configuration before default."""
    got = getattr(args, name, None)
    if got is not None:
        return got
    return (config.get("defaults") or {}).get(name, config.get(name, default))


def doctor(folder: Path, spark: SparkSession) -> list[dict[str, Any]]:
    from .operators import checks
    from .operators.planner import source_counts

    out = []

    def note(what: str, ok: bool, detail: str = "") -> None:
        out.append({"check": what, "ok": ok, "detail": detail})

    for package in ("pyspark", "pyarrow", "pandas", "yaml"):
        found = importlib.util.find_spec(package)
        note(f"package {package}", bool(found), "" if found else "not installed")
    config = load_config(folder)
    note("configuration", bool(config), "" if config else "no readable chronoweave.yaml")
    specs = config.get("features") or []
    every: list[Feature] = []
    for s in [specs] if isinstance(specs, str) else specs:
        try:
            features = load_features(str(folder / s))
            note(f"features {s}", True, f"{len(features)} feature(s)")
        except Exception as e:
            note(f"features {s}", False, str(e))
            continue
        every += [f for f in features if f not in every]
        for f in features:
            try:
                rows = f.source.load(spark)
                checks.source_schema(f, rows)
                n = source_counts(rows, f.source.keys, f.source.timestamp).first()["groups"]
                note(f"source of {f.name}", n == 0 or f.on_duplicate == "keep_any", f"{n} duplicate group(s)" if n else "")
            except Exception as e:
                note(f"source of {f.name}", False, str(e))
    if every:
        try:
            checks.parameters(every, DEFAULT_LOOKBACK, None, "strict", "null")
            note("features together", True)
        except ConfigError as e:
            note("features together", False, str(e))
    labels = config.get("labels") or {}
    if labels.get("path"):
        try:
            df = resolve(spark, labels["path"])
            keys = labels.get("keys") or []
            target = labels.get("target") or [c for c in df.columns if c not in keys][:1]
            checks.label_schema(Labels(df=df, keys=keys, label_time=labels.get("label_time") or "label_time", target=target), df)
            note("labels", True)
        except Exception as e:
            note("labels", False, str(e))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("chronoweave", description=__doc__)
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--debug", action="store_true")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)

    def cmd(name: str, *more: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("--json", action="store_true")
        if "labels" in more:
            c.add_argument("--labels")
        if "features" in more:
            c.add_argument("--features", action="append")
        if "keys" in more:
            c.add_argument("--keys")
            c.add_argument("--label-time")
        if "window" in more:
            c.add_argument("--max-lookback")
            c.add_argument("--max-staleness")
            c.add_argument("--join-mode", dest="join", choices=["strict", "inclusive"])
        return c

    c = cmd("inspect")
    c.add_argument("path")
    c.add_argument("--approximate", action="store_true", help="count distinct values by sketches")
    c = cmd("audit", "features", "keys", "window")
    c.add_argument("data")
    c.add_argument("--html")
    c.add_argument("--strict", action="store_true")
    c = cmd("build", "labels", "features", "keys", "window")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--on-missing", choices=["null", "skip"])
    c.add_argument("--split", action="append", default=[])
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--flatten", action="store_true")
    c.add_argument("--store", help="folder of manifests and caches, .chronoweave unless named here or in the configuration")
    cmd("explain", "labels", "features", "keys", "window")
    c = cmd("diff", "keys")
    c.add_argument("old")
    c.add_argument("new")
    c.add_argument("--atol", type=float)
    c.add_argument("--rtol", type=float)
    cmd("catalog", "features")
    cmd("doctor")
    c = cmd("init")
    c.add_argument("path", nargs="?", default=".")
    c = cmd("quickstart")
    c.add_argument("name", nargs="?", default="chronoweave-demo")
    c.add_argument("--minimal", action="store_true")
    c.add_argument("--template", default="churn")
    return p


def run(args: argparse.Namespace) -> int:
    from .operators.audit import audit
    from .operators.build import build
    from .operators.compare import ATOL, RTOL
    from .operators.diff import diff
    from .operators.explain import explain
    from .store import Store

    def show(text: Any, data: Any) -> None:
        print(json.dumps(data, indent=2, default=str) if args.json else text)

    if args.command == "init":
        folder = Path(args.path)
        folder.mkdir(parents=True, exist_ok=True)
        target = folder / CONFIG[0]
        if not target.exists():
            target.write_text("# Settings of chronoweave; the command line goes before them.\nlabels:\n  path: data/labels.parquet\n  keys: [user_id]\n  label_time: label_time\nfeatures: [features.py]\ndefaults:\n  max_lookback: 365d\n  join: strict\n  on_missing: 'null'\n")
        (folder / "features.py").touch()
        show(f"Project in {folder}", {"path": str(folder)})
        return 0
    config = load_config()
    spark = _spark()
    if args.command == "quickstart":
        from .quickstart import create

        show(f"Demo in {create(spark, args.name, args.minimal, args.template)}", {"path": args.name})
    elif args.command == "inspect":
        got = inspect_table(resolve(spark, args.path), args.approximate)
        lines = [f"{c['name']:30} {c['type']:16} {c['distinct']:>10} distinct ({c['distinct_pct']:.1%})" for c in got["columns"]]
        show("\n".join([*lines, f"key: {', '.join(got['keys']) or '-'}; time: {', '.join(got['timestamps']) or '-'}"]), got)
    elif args.command == "doctor":
        notes = doctor(Path("."), spark)
        show("\n".join(f"{'ok  ' if n['ok'] else 'FAIL'} {n['check']} {n['detail']}" for n in notes), notes)
        return int(not all(n["ok"] for n in notes))
    elif args.command == "catalog":
        rows = [{"name": f.name, "kind": f.kind, "source": f.source.name, "keys": f.source.keys, "embargo": str(f.embargo)} for f in _features(args, config)]
        show("\n".join(f"{r['name']:24} {r['kind']:10} {r['source']:20} {r['embargo']}" for r in rows), rows)
    elif args.command == "diff":
        keys = (args.keys or "").split(",") if args.keys else config.get("keys")
        got = diff(args.old, args.new, keys=keys, label_time=args.label_time or "label_time", atol=ATOL if args.atol is None else args.atol, rtol=RTOL if args.rtol is None else args.rtol, spark=spark)
        show(got, got.to_dict())
    else:
        window = {"max_lookback": _setting(args, config, "max_lookback", "365d"), "max_staleness": _setting(args, config, "max_staleness", None), "join": _setting(args, config, "join", "strict")}
        features = _features(args, config)
        if args.command == "audit":
            c = config.get("labels") or {}
            keys = args.keys.split(",") if args.keys else c.get("keys")
            report = audit(args.data, features, keys=keys, label_time=args.label_time or c.get("label_time", "label_time"), spark=spark, **window)
            if args.html:
                report.to_html(args.html)
            show(report, report.to_dict())
            return int(args.strict and report.has_leakage)
        labels = _labels(args, config, spark)
        if args.command == "explain" or args.dry_run:
            got = explain(labels, features, spark=spark, **window)
            show(got, {"label_count": got.label_count, "plan": got.plan})
        else:
            got = build(labels, features, args.output, spark=spark, on_missing=_setting(args, config, "on_missing", "null"), splits=dict(map(parse_split, args.split)) or config.get("splits"), store=Store(_setting(args, config, "store", ".chronoweave")), flatten_columns=args.flatten, **window)
            show(got, got.manifest)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.debug else logging.INFO if args.verbose else logging.WARNING)
    try:
        return run(args)
    except ChronoweaveError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
