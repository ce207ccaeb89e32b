"""Laziness, plans, edge tables, odd names, settings, store keys, and the invariant on random tables."""

import argparse
import random
import warnings
from datetime import datetime, timedelta

import pytest

import chronoweave as cw
from chronoweave import cli
from chronoweave.operators import planner
from chronoweave.operators.asof import Branch, as_of
from chronoweave.operators.build import flat_names
from chronoweave.sources import files, readers

T = datetime(2024, 1, 10)
D = timedelta(days=1)


def source(spark, rows, name="s", schema="k long, at timestamp_ntz, v double, w string"):
    return cw.Source(df=spark.createDataFrame(rows, schema), keys="k", timestamp="at", name=name)


def labels(spark, rows):
    return cw.Labels(df=spark.createDataFrame(rows, "k long, t timestamp_ntz, y int"), keys="k", label_time="t", target="y")


def jobs(spark, run):
    """How many jobs ``run`` starts."""
    sc = spark.sparkContext
    group = f"g{random.random()}"
    sc.setJobGroup(group, "")
    try:
        out = run()
        return out, len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setJobGroup("", "")


def test_a_lazy_build_runs_no_join(spark):
    src, lab = source(spark, [(1, T, 1.0, "a")]), labels(spark, [(1, T + D, 0)])
    r, n = jobs(spark, lambda: cw.build(lab, cw.Feature(src, ["v", "w"], name="f"), spark=spark, limits=planner.Limits(lookup_rows=0)))
    # label counts and the source's check: under adaptive execution each shuffle is a job
    assert n <= 7
    stats, more = jobs(spark, lambda: r.stats)
    assert more >= 1
    assert stats.feature_stats["f"] == {"matched": 1, "missing": 0, "violations": 0}
    assert r.manifest["output"]["row_count"] == 1
    assert jobs(spark, lambda: r.stats)[1] == 0


def test_explain_counts_labels_only(spark):
    src, lab = source(spark, [(1, T, 1.0, "a"), (1, T, 2.0, "b")]), labels(spark, [(1, T + D, 0)])
    _, n = jobs(spark, lambda: lab.load(spark).groupBy("k").count().agg({"count": "sum"}).first())
    got, m = jobs(spark, lambda: cw.explain(lab, cw.Feature(src, "v"), spark=spark))
    assert m <= n
    assert got.label_count == 1
    assert "Window" in got.spark_plan


def test_no_text_key_without_ties(spark):
    spine = spark.createDataFrame([(1, T, "y")], "k int, t timestamp_ntz, y string")
    rows = spark.createDataFrame([(1, T, 1.0)], "k int, feature_time timestamp_ntz, v double")
    plan = lambda unique: as_of(spine, ["k"], "t", [Branch("f", rows, ("v",), unique=unique)], D)._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan(True) + plan(False)
    columns = [max(line.count(" ASC NULLS FIRST") for line in plan(unique).splitlines()) for unique in (True, False)]
    assert columns[0] < columns[1]


def test_a_hot_key_spreads_over_tasks(spark):
    src = source(spark, [(1, T + i * timedelta(minutes=1), float(i), "a") for i in range(400)])
    lab = labels(spark, [(1, T + i * timedelta(minutes=1), 0) for i in range(5, 400, 3)])
    limits = planner.Limits(lookup_rows=0, hot_rows=50)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = cw.build(lab, cw.Feature(src, "v", name="f"), spark=spark, limits=limits, max_lookback="1d")
        parts = [n for n in r.df.rdd.glom().map(len).collect() if n]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(parts) > 1
    assert r.manifest["features"]["f"]["plan"] == "bucketed"
    assert all(x["f__v"] == (x["t"] - T) / timedelta(minutes=1) - 1 for x in r.df.collect())


@pytest.mark.parametrize("inclusive", [False, True])
def test_the_lookup_agrees_with_the_window(spark, inclusive):
    rng = random.Random(1)
    hour = timedelta(hours=1)
    rows = [(rng.choice([1, 2, None]), T + rng.randrange(60) * hour, rng.choice([None, float(i)]), str(i)) for i in range(60)]
    lab = [(rng.choice([1, 2, 3, None]), T + rng.randrange(70) * hour, i) for i in range(50)]
    got = []
    for limits in (planner.Limits(), planner.Limits(lookup_rows=0)):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            r = cw.build(labels(spark, lab), cw.Feature(source(spark, rows), ["v", "w"], name="f", embargo="3h", on_duplicate="keep_any"), join="inclusive" if inclusive else "strict", max_lookback="1d", spark=spark, limits=limits)
        got.append(sorted(map(str, r.df.collect())))
        assert r.manifest["features"]["f"]["plan"] == ("lookup" if limits.lookup_rows else "fused")
    assert got[0] == got[1]


def test_flat_names_are_all_or_none():
    assert flat_names(["a__x", "b__y"], ["a", "b"]) == {"a__x": "x", "b__y": "y"}
    assert flat_names(["a__x", "b__x"], ["a", "b"]) == {"a__x": "a__x", "b__x": "b__x"}


def test_flattening_stops_at_a_name_of_the_labels(spark):
    src = source(spark, [(1, T, 1.0, "a")])
    r = cw.build(labels(spark, [(1, T + D, 0)]), cw.Feature(src, {"v": "y", "w": "z"}, name="f"), flatten_columns=True, spark=spark)
    assert r.df.columns == ["k", "t", "y", "f__y", "f__z"]


def test_empty_labels_empty_source_and_all_null_feature(spark, tmp_path):
    src = source(spark, [(1, T, None, None)])
    f = cw.Feature(src, ["v", "w"], name="f")
    r = cw.build(labels(spark, []), f, tmp_path / "a", spark=spark)
    assert (r.stats.row_count, spark.read.parquet(str(tmp_path / "a")).columns) == (0, ["k", "t", "y", "f__v", "f__w"])
    r = cw.build(labels(spark, [(1, T + D, 0)]), f, tmp_path / "b", spark=spark)
    assert r.stats.feature_stats["f"] == {"matched": 0, "missing": 1, "violations": 0}
    assert not cw.audit(tmp_path / "b", f, keys="k", label_time="t", spark=spark).has_leakage
    r = cw.build(labels(spark, [(1, T + D, 0)]), cw.Feature(source(spark, []), "v", name="f"), spark=spark)
    assert r.df.first()["f__v"] is None


def test_an_audit_takes_the_worst_column(spark):
    src = source(spark, [(k, T, 1.0, "a") for k in range(10)])
    f = cw.Feature(src, ["v", "w"], name="f")
    data = spark.createDataFrame([(k, T + D, 1.0 + (k < 2), "a" if k < 5 else "b") for k in range(10)], "k long, label_time timestamp_ntz, f__v double, f__w string")
    assert cw.audit(data, f, keys="k", spark=spark)["f"].leaky_row_count == 5


@pytest.mark.parametrize("name", ["a.b", "a b", "a`b", 'a"b', "a;drop table x", "select", "ü", "a--b", "a'b"])
def test_odd_names_are_names(spark, name):
    src = cw.Source(df=spark.createDataFrame([(1, T, 5.0)], ["k", "at", "v"]).withColumnsRenamed({"k": name, "v": name + "v"}).withColumn("at", cast_ntz("at")), keys=name, timestamp="at", name="s")
    lab = cw.Labels(df=spark.createDataFrame([(1, T + D, 0)], ["k", "t", "y"]).withColumnRenamed("k", name).withColumn("t", cast_ntz("t")), keys=name, label_time="t", target="y")
    r = cw.build(lab, cw.Feature(src, name + "v", name="f"), spark=spark)
    assert r.df.first()[f"f__{name}v"] == 5.0
    assert not cw.audit(r.df, cw.Feature(src, name + "v", name="f"), keys=name, label_time="t", spark=spark).has_leakage


def cast_ntz(column):
    from pyspark.sql import functions as F

    return F.col(column).cast("timestamp_ntz")


def test_views_do_not_outlive_the_query(spark):
    mine, own = spark.range(3), spark.range(7)
    own.createOrReplaceTempView("shared_name")
    got = readers.sql(spark, "SELECT count(*) AS n FROM shared_name JOIN other_name USING (id)", {"shared_name": mine, "other_name": mine})
    assert got.first()["n"] == 3
    assert spark.table("shared_name").count() == 7
    assert not spark.catalog.tableExists("other_name")
    spark.catalog.dropTempView("shared_name")


def test_settings_command_line_before_file_before_default():
    args = argparse.Namespace(join="inclusive", max_lookback=None)
    config = {"join": "strict", "defaults": {"max_lookback": "7d"}, "max_lookback": "9d"}
    assert cli._setting(args, config, "join", "x") == "inclusive"
    assert cli._setting(args, config, "max_lookback", "x") == "7d"
    assert cli._setting(args, {"max_lookback": "9d"}, "max_lookback", "x") == "9d"
    assert cli._setting(args, {}, "on_missing", "null") == "null"


def test_store_keys_follow_what_shapes_the_output(spark, tmp_path):
    spark.createDataFrame([(1, T, 1.0)], "k long, at timestamp_ntz, v double").write.parquet(str(tmp_path / "s"))
    s = cw.Store(tmp_path / "store")
    f = lambda **more: cw.Feature(cw.Source(tmp_path / "s", keys="k", timestamp="at"), "v", name="f", **more)
    key = s.feature_cache_key(f())
    assert s.feature_cache_key(f()) == key
    assert s.feature_cache_key(f(embargo="1d")) != key
    assert s.feature_cache_key(cw.Feature(source(spark, []), "v")) is None
    spark.createDataFrame([(1, T, 2.0)], "k long, at timestamp_ntz, v double").write.mode("overwrite").parquet(str(tmp_path / "s"))
    assert s.feature_cache_key(f()) != key
    assert files.content_hash(tmp_path / "nothing") is None
    for i in (1, 2, 3):
        s.save_build({"build_id": f"b{i}", "created_at": f"2024-01-0{i}", "output": {"path": None}})
    assert [b["build_id"] for b in s.list_builds()] == ["b3", "b2", "b1"]
    assert s.get_build("b2")["created_at"] == "2024-01-02"
    assert s.get_build("b9") is None


def test_a_store_through_a_path_of_another_scheme(spark, tmp_path):
    """Only Spark's file systems open it; Python's do not."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.box.link./d", f"file://{tmp_path}")
    base = "viewfs://box/d"
    spark.createDataFrame([(1, T, 1.0, "a")], "k long, at timestamp_ntz, v double, w string").write.parquet(f"{base}/s")
    spark.createDataFrame([(1, T + D, 0)], "k long, t timestamp_ntz, y int").write.parquet(f"{base}/l")
    lab = cw.Labels(f"{base}/l", keys="k", label_time="t", target="y")
    f = cw.Feature(cw.Source(f"{base}/s", keys="k", timestamp="at"), "v", name="f")
    s = cw.Store(f"{base}/store")
    first = cw.build(lab, f, f"{base}/out", store=s, spark=spark)
    assert cw.build(lab, f, f"{base}/out", store=s, spark=spark).manifest["build_id"] == first.manifest["build_id"]
    assert cw.build(lab, f, f"{base}/more", store=s, spark=spark).manifest["features"]["f"]["cached"]


@pytest.mark.parametrize("seed", range(4))
def test_no_value_comes_from_the_future(spark, seed):
    rng = random.Random(seed)
    hour = timedelta(hours=1)
    times = rng.sample(range(500), 120)
    rows = [(rng.randrange(5), T + h * hour, float(h), str(h)) for h in times]
    lab = [(rng.randrange(6), T + rng.randrange(500) * hour, i) for i in range(80)]
    embargo, back = rng.choice([0, 5, 30]), rng.choice([40, 200])
    inclusive = rng.random() < 0.5
    limits = planner.Limits(lookup_rows=rng.choice([0, 10**6]), lookup_depth=10**6, hot_rows=rng.choice([20, 10**6]))
    r = cw.build(labels(spark, lab), cw.Feature(source(spark, rows), "v", name="f", embargo=f"{embargo}h"), max_lookback=f"{back}h", join="inclusive" if inclusive else "strict", spark=spark, limits=limits)
    got = {x["y"]: x["f__v"] for x in r.df.collect()}
    matched = 0
    for k, t, y in lab:
        ok = [v for fk, ft, v, _ in rows if fk == k and t - back * hour <= ft and (ft <= t - embargo * hour if inclusive else ft < t - embargo * hour)]
        assert got[y] == max(ok, default=None)
        matched += bool(ok)
    assert matched > 0
    assert r.stats.feature_stats["f"]["violations"] == 0
