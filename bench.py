"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, seconds a query.

Each query runs twice, every output column consumed by a noop write; the second
run counts (the verbs over a million rows and more run once). Beside the driver's tables the verbs run on the shapes of the
published baseline (100 K and 1 M labels, 1 and 10 features, two rows a label of
each): ``build_*`` reads Parquet, checks, joins, verifies and writes Parquet,
``audit_*`` rebuilds and compares what was built. ``*_published`` have the
published times (all labels in one day, all features in one day a year before);
the others spread both over one interleaved year.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import chronoweave as cw
from chronoweave import queries as core

NAMES = ["asof_strict", "asof_inclusive", "asof_embargo", "asof_multi_feature", "feature_sql_rolling_30d", "audit_temporal", "audit_rebuild_numeric", "diff_numeric", "duplicate_groups", "inspect_columns"]
SHAPES = ((100_000, 1), (100_000, 10), (1_000_000, 1), (1_000_000, 10))
LOOKBACK = "366d"


def written(spark: SparkSession, folder: str, n: int, m: int, published: bool) -> tuple[cw.Labels, list[cw.Feature]]:
    """Labels and features as Parquet, on n / 5 keys; no two rows of a feature have the same key and time."""
    keys, us = max(1000, n // 5), 1_000_000

    def table(name: str, rows: int, start: str, days: int, seed: int, value: str) -> str:
        at = (F.rand(seed) * (days * 86400)).cast("decimal(18,6)")
        # the row's number in the last digits keeps a key's times apart
        when = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.floor(at) + F.floor(F.col("id") / keys) / us).cast("decimal(18,6)"))
        path = f"{folder}/{name}"
        spark.range(rows).select((F.col("id") % keys).alias("user_id"), when.alias("at"), F.rand(seed + 50).alias(value)).write.parquet(path)
        return path

    labels = table("labels", n, "2024-01-01" if published else "2023-01-01", 1 if published else 365, 1, "y")
    paths = [table(f"f{i}", 2 * n, "2023-01-01", 1 if published else 365, i + 2, "v") for i in range(m)]
    features = [cw.Feature(cw.Source(p, keys="user_id", timestamp="at", name=f"s{i}"), "v", name=f"f{i}") for i, p in enumerate(paths)]
    return cw.Labels(labels, keys="user_id", label_time="at", target="y"), features


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}

    def timed(name: str, run, runs: int = 2) -> None:
        for _ in range(runs):
            t = time.time()
            run()
            took[name] = round(time.time() - t, 3)

    for name in NAMES:
        timed(name, lambda name=name: core.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    for published in (False, True):
        for n, m in SHAPES:
            folder = tempfile.mkdtemp(prefix="bench-")
            labels, features = written(spark, folder, n, m, published)
            shape = f"{n}x{m}" + ("_published" if published else "")
            runs = 2 if n * m < 10**6 else 1  # the small shapes have warmed up the large ones
            timed(f"build_{shape}", lambda: cw.build(labels, features, f"{folder}/out", max_lookback=LOOKBACK, spark=spark), runs)
            if not published:
                timed(f"audit_{shape}", lambda: cw.audit(f"{folder}/out", features, keys="user_id", label_time="at", max_lookback=LOOKBACK, spark=spark).assert_clean(), runs)
            shutil.rmtree(folder)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
