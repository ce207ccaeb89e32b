"""The verbs, their checks, sinks and reports as queries, with the same in SQL.

What a verb says or writes is turned into rows: files are read back, reports and
manifests give their fields, errors their class.
"""

from __future__ import annotations

import contextlib
import io
import shutil
import tempfile
import warnings
from datetime import timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli, quickstart, store
from .errors import ChronoweaveError
from .functions.durations import day
from .model import Feature, Labels, Source, SQLSource
from .operators import audit as au
from .operators import build as bu
from .operators import checks, planner
from .operators import diff as di
from .operators.explain import explain
from .operators.results import said, severity
from .queries import _L, _add, _others, _purchases, _range_sql, _t
from .sources import files, readers

_STRICT = _range_sql("value AS f__value, event_type AS f__event_type", "< l.label_time")
_VALUES = "SELECT * FROM (VALUES {}) t({})"


def _feature(spark: SparkSession, d: str, **more: object) -> Feature:
    return Feature(_others(spark, d), ["value", "event_type"], name="f", **more)


def _stored(spark: SparkSession, d: str) -> tuple[Labels, Feature, str]:
    """Purchases and the other events as files, and the folder that holds them."""
    base = files.scratch(spark, "stored")
    _purchases(spark, d).df.write.parquet(f"{base}/labels")
    _others(spark, d).df.write.parquet(f"{base}/others")
    labels = Labels(path=f"{base}/labels", keys="user_id", label_time="label_time", target=["event_id", "target"])
    return labels, Feature(Source(path=f"{base}/others", keys="user_id", timestamp="ts"), ["value", "event_type"], name="f"), base


# -- plans ---------------------------------------------------------------------------


@_add("asof_auto_skew", _STRICT)
def asof_auto_skew(spark: SparkSession, d: str) -> DataFrame:
    """Keys with more rows than a task should sort are cut into buckets of time without being asked."""
    limits = planner.Limits(lookup_rows=0, hot_rows=20)
    r = bu.build(_purchases(spark, d), _feature(spark, d), spark=spark, limits=limits)
    return r.df


@_add("asof_auto_lookup", _STRICT)
def asof_auto_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A feature of few rows a key is looked up; the labels are not shuffled for it."""
    limits = planner.Limits(lookup_rows=10**7, lookup_depth=10**4)
    return bu.build(_purchases(spark, d), _feature(spark, d), spark=spark, limits=limits).df


@_add("plan_choice", _VALUES.format("('skew', 'bucketed'), ('small', 'lookup'), ('usual', 'fused')", '"case", plan'))
def plan_choice(spark: SparkSession, d: str) -> DataFrame:
    cases = {"skew": planner.Limits(lookup_rows=0, hot_rows=20), "small": planner.Limits(lookup_rows=10**7, lookup_depth=10**4), "usual": planner.Limits(lookup_rows=0)}
    rows = [(k, explain(_purchases(spark, d), _feature(spark, d), measure=True, limits=x, spark=spark).plan[0]["strategy"]) for k, x in cases.items()]
    return spark.createDataFrame(rows, "case string, plan string")


@_add("source_counts", """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(max(n) AS BIGINT) AS most, CAST(sum(twice) AS BIGINT) AS groups FROM (
SELECT l_suppkey, sum(n) AS n, count(*) FILTER (n > 1) AS twice FROM (SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey)""")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return planner.source_counts(_t(spark, d, "lineitem"), ["l_suppkey"], "l_shipdate")


@_add("label_counts", "SELECT CAST(sum(n) AS BIGINT) AS n, min(a) AS first, max(z) AS last, max(n) AS most FROM (SELECT user_id, count(*) AS n, min(ts) AS a, max(ts) AS z FROM events WHERE event_type = 'purchase' GROUP BY user_id)")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return planner.label_counts(_purchases(spark, d).df, ["user_id"], "label_time")


@_add("explain_rows", _VALUES.format("('f', 'user_id = :user_id and feature_time < label_time - INTERVAL ''1d''', '[label_time - 7d, label_time - 1d)', '1d')", "name, join_condition, \"window\", embargo"))
def explain_rows(spark: SparkSession, d: str) -> DataFrame:
    got = explain(_purchases(spark, d), _feature(spark, d, embargo="1d"), max_lookback="7d", spark=spark)
    return spark.createDataFrame([(p["name"], p["join_condition"], p["window"], p["embargo_str"]) for p in got.plan], "name string, join_condition string, window string, embargo string")


# -- sources -------------------------------------------------------------------------


@_add("scan_pandas", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_pandas(spark: SparkSession, d: str) -> DataFrame:
    return readers.rows(spark, _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").toPandas())


@_add("scan_arrow", "SELECT r_regionkey, r_name FROM region")
def scan_arrow(spark: SparkSession, d: str) -> DataFrame:
    return readers.rows(spark, _t(spark, d, "region").select("r_regionkey", "r_name").toArrow())


@_add("scan_glob", "SELECT event_id, user_id, ts FROM events")
def scan_glob(spark: SparkSession, d: str) -> DataFrame:
    """Two folders of part files by one pattern."""
    base = files.scratch(spark, "glob")
    rows = _t(spark, d, "events").select("event_id", "user_id", "ts")
    rows.where("event_id % 2 = 0").write.parquet(f"{base}/part-even")
    rows.where("event_id % 2 = 1").write.parquet(f"{base}/part-odd")
    return Source(path=f"{base}/part-*", keys="user_id", timestamp="ts", format="parquet").load(spark)


@_add("resolved_data", "SELECT count(*) AS joined, CAST(0 AS BIGINT) AS only_old, CAST(0 AS BIGINT) AS only_new, CAST(0 AS BIGINT) AS changed FROM customer")
def resolved_data(spark: SparkSession, d: str) -> DataFrame:
    """The data of audit and diff may be a path of either format: a CSV equals the Parquet it was made of."""
    base = files.scratch(spark, "data")
    rows = _t(spark, d, "customer").select("c_custkey", F.lit("2024-01-01").cast("timestamp_ntz").alias("label_time"), "c_name")
    rows.write.parquet(f"{base}/a")
    rows.write.option("header", True).csv(f"{base}/a.csv")
    r = di.diff(f"{base}/a", f"{base}/a.csv", keys="c_custkey", spark=spark)
    return spark.createDataFrame([(r.joined_rows, r.rows_only_old, r.rows_only_new, sum(v["changed_count"] for v in r.value_changes.values()))], "joined long, only_old long, only_new long, changed long")


@_add("date_trunc_source", _range_sql("total AS daily__total", "< l.label_time", "f AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS feature_time, round(sum(value), 6) AS total FROM events WHERE event_type <> 'purchase' GROUP BY ALL)"))
def date_trunc_source(spark: SparkSession, d: str) -> DataFrame:
    """Daily sums by SQL: the day has no zone, as the events have none."""
    s = SQLSource("SELECT user_id, date_trunc('day', ts) AS at, round(sum(value), 6) AS total FROM raw WHERE event_type <> 'purchase' GROUP BY user_id, date_trunc('day', ts)", "user_id", "at", "daily", {"raw": _t(spark, d, "events")})
    return bu.build(_purchases(spark, d), Feature(s, "total", name="daily"), spark=spark).df


@_add("day_of_time", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS at FROM events")
def day_of_time(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", day("ts").alias("at"))


@_add("quoted_names", "SELECT user_id AS \"user.id\", label_time AS \"at`x\", event_id, target, f__value AS \"f__a b.c\" FROM (" + _range_sql("value AS f__value", "< l.label_time") + ")")
def quoted_names(spark: SparkSession, d: str) -> DataFrame:
    """Names with dots, blanks and back ticks."""
    lab = _purchases(spark, d).df.withColumnsRenamed({"user_id": "user.id", "label_time": "at`x"})
    rows = _others(spark, d).df.select(F.col("user_id").alias("user.id"), F.col("ts").alias("t.s"), F.col("value").alias("a b.c"))
    labels = Labels(df=lab, keys="user.id", label_time="at`x", target=["event_id", "target"])
    return bu.build(labels, Feature(Source(df=rows, keys="user.id", timestamp="t.s", name="q"), "a b.c", name="f"), spark=spark).df


# -- sinks, manifest, cache ------------------------------------------------------------


@_add("split_sink", f"SELECT CASE WHEN label_time < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS split, * FROM ({_STRICT}) WHERE label_time >= TIMESTAMP '2024-01-01' AND label_time < TIMESTAMP '2024-02-01'")
def split_sink(spark: SparkSession, d: str) -> DataFrame:
    """The splits of a build, read back from their own files."""
    target = files.scratch(spark, "splits")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        r = bu.build(_purchases(spark, d), _feature(spark, d), target, splits={"train": ("2024-01-01", "2024-01-20"), "test": ("2024-01-20", "2024-02-01")}, spark=spark)
    a, b = (spark.read.parquet(p).select(F.lit(n).alias("split"), "*") for n, p in r.splits.items())
    return a.union(b)


_MATCHED = f"SELECT count(*) AS n, count(f__value) AS matched FROM ({_STRICT})"


@_add("manifest", f"SELECT n AS row_count, 6 AS column_count, matched AS matched_rows, n - matched AS missing_rows, TRUE AS passed, 'feature_time < label_time - embargo' AS invariant FROM ({_MATCHED})")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest that the store keeps, read back from it."""
    labels, f, base = _stored(spark, d)
    s = store.Store(f"{base}/store")
    built = bu.build(labels, f, f"{base}/out", store=s, spark=spark).manifest["build_id"]
    m = s.get_build(built)
    x = m["features"]["f"]
    row = (m["output"]["row_count"], m["output"]["column_count"], x["matched_rows"], x["missing_rows"], m["audit"]["passed"], m["audit"]["invariant"])
    return spark.createDataFrame([row], "row_count long, column_count int, matched_rows long, missing_rows long, passed boolean, invariant string")


@_add("caches", _VALUES.format("(1, FALSE, 1), (2, FALSE, 1), (3, TRUE, 2)", "run, feature_cached, builds"))
def caches(spark: SparkSession, d: str) -> DataFrame:
    """A build, the same again (found whole), and one elsewhere (its feature found)."""
    labels, f, base = _stored(spark, d)
    s = store.Store(f"{base}/store")
    rows = []
    for run, target in ((1, "out"), (2, "out"), (3, "other")):
        m = bu.build(labels, f, f"{base}/{target}", store=s, spark=spark).manifest
        rows.append((run, m["features"]["f"]["cached"], len(s.list_builds())))
    return spark.createDataFrame(rows, "run int, feature_cached boolean, builds int")


@_add("feature_cache", "SELECT user_id, ts AS feature_time, value, event_type FROM events WHERE event_type <> 'purchase'")
def feature_cache(spark: SparkSession, d: str) -> DataFrame:
    """A feature's rows as the cache holds them."""
    labels, f, base = _stored(spark, d)
    s = store.Store(f"{base}/store")
    bu.build(labels, f, f"{base}/out", store=s, spark=spark)
    return spark.read.parquet(s.feature_cache_path("f", s.feature_cache_key(f)))


@_add("content_hashes", _VALUES.format("('other content', FALSE), ('other name', TRUE), ('same', TRUE)", '"case", equal'))
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    base = files.scratch(spark, "hashes")
    one = _t(spark, d, "region").select("r_regionkey", "r_name").coalesce(1)
    for name, df in (("a", one), ("b", one), ("c", one.where("r_regionkey > 0"))):
        df.write.parquet(f"{base}/{name}")
    a, again, b, c = (store.content_hash(f"{base}/{x}") for x in "aabc")
    return spark.createDataFrame([("same", a == again), ("other name", a == b), ("other content", a == c)], "case string, equal boolean")


@_add("progress", _VALUES.format("(1, 'Loading labels'), (2, 'Computing feature 1/1: f'), (3, 'Joining 1 feature(s)'), (4, 'Verifying'), (5, 'Writing')", "n, said"))
def progress(spark: SparkSession, d: str) -> DataFrame:
    told: list[str] = []
    bu.build(_purchases(spark, d), _feature(spark, d), files.scratch(spark, "out"), progress=told.append, spark=spark)
    return spark.createDataFrame(list(enumerate(told, 1)), "n int, said string")


# -- reports ------------------------------------------------------------------------


def _report(spark: SparkSession, d: str) -> au.AuditReport:
    rows = _purchases(spark, d).df.withColumn("ft", F.when(F.col("event_id") % 5 == 0, F.col("label_time") + F.expr("INTERVAL 3 DAY")).otherwise(F.col("label_time") - F.expr("INTERVAL 1 DAY")))
    return au.audit(rows, feature_time_columns={"a<b": "ft"}, label_time="label_time", spark=spark)


@_add("report_json", f"WITH {_L} SELECT 'a<b' AS feature, count(*) FILTER (event_id % 5 = 0) AS leaky_row_count, count(*) AS total_rows, count(*) FILTER (event_id % 5 = 0) = 0 AS clean, 'HIGH' AS severity, CAST(259200 AS DOUBLE) AS max_leakage_seconds, 'temporal' AS mode FROM l")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    """The fields of an audit's JSON report."""
    r = _report(spark, d).to_dict()
    rows = [(n, x["leaky_row_count"], x["total_rows"], x["clean"], x["severity"], x["max_leakage_seconds"], r["mode"]) for n, x in r["features"].items()]
    return spark.createDataFrame(rows, "feature string, leaky_row_count long, total_rows long, clean boolean, severity string, max_leakage_seconds double, mode string")


@_add("report_html", f"WITH {_L}, s AS (SELECT count(*) FILTER (event_id % 5 = 0) AS k, count(*) AS n FROM l) SELECT '<h3>Audit (temporal) of ' || n || ' rows</h3><table><tr><th>feature</th><th>verdict</th><th>leaky rows</th><th>share</th><th>most</th><th>severity</th></tr><tr><td>a&lt;b</td><td>LEAKY</td><td>' || k || '</td><td>' || printf('%.1f', 100.0 * k / n) || '%</td><td>3 days</td><td>HIGH</td></tr></table>' AS html FROM s")
def report_html(spark: SparkSession, d: str) -> DataFrame:
    """The HTML report, names escaped."""
    return spark.createDataFrame([(_report(spark, d)._repr_html_(),)], "html string")


@_add("leakage_text", _VALUES.format("(1, '1 second', 'LOW'), (2, '1 minute', 'LOW'), (3, '23 hours', 'LOW'), (4, '1 day', 'MEDIUM'), (5, '8 days', 'HIGH')", "n, said, severity"))
def leakage_text(spark: SparkSession, d: str) -> DataFrame:
    spans = [timedelta(seconds=1), timedelta(seconds=119), timedelta(hours=23, minutes=59), timedelta(days=1), timedelta(days=8)]
    return spark.createDataFrame([(i, said(x), severity(0.0, x)) for i, x in enumerate(spans, 1)], "n int, said string, severity string")


# -- checks -------------------------------------------------------------------------


@_add("refused", _VALUES.format(", ".join(f"('{c}', '{e}')" for c, e in (
    ("column missing", "SchemaError"), ("duplicates", "DuplicateError"), ("embargo over lookback", "ConfigError"), ("join unknown", "ConfigError"), ("names alike", "ConfigError"), ("no feature", "ConfigError"),
    ("not a time", "SchemaError"), ("on_missing unknown", "ConfigError"), ("split overlaps", "ConfigError"), ("split reversed", "ConfigError"), ("staleness within embargo", "ConfigError"), ("time zones mixed", "TimezoneError"))), '"case", error'))
def refused(spark: SparkSession, d: str) -> DataFrame:
    """What a build refuses, and by which error."""
    labels, f, e = _purchases(spark, d), _feature(spark, d), _t(spark, d, "events")
    source = lambda df, ts="ts": Feature(Source(df=df, keys="user_id", timestamp=ts, name="s"), "value", name="g")
    late = Feature(_others(spark, d), "value", name="late", embargo="3d")
    cases = {
        "column missing": lambda: bu.build(labels, Feature(_others(spark, d), "valeu"), spark=spark),
        "duplicates": lambda: bu.build(labels, source(e.union(e)), spark=spark),
        "embargo over lookback": lambda: bu.build(labels, late, max_lookback="2d", spark=spark),
        "join unknown": lambda: bu.build(labels, f, join="loose", spark=spark),
        "names alike": lambda: bu.build(labels, [Feature(_others(spark, d), "value", name="a b"), Feature(_others(spark, d), "value", name="a_b")], spark=spark),
        "no feature": lambda: bu.build(labels, [], spark=spark),
        "not a time": lambda: bu.build(labels, source(e, "event_type"), spark=spark),
        "on_missing unknown": lambda: bu.build(labels, f, on_missing="drop", spark=spark),
        "split overlaps": lambda: checks.splits({"a": ("2024-01-01", "2024-02-01"), "b": ("2024-01-31", "2024-03-01")}, None, None),
        "split reversed": lambda: checks.splits({"a": ("2024-02-01", "2024-01-01")}, None, None),
        "staleness within embargo": lambda: bu.build(labels, late, max_staleness="3d", spark=spark),
        "time zones mixed": lambda: bu.build(labels, source(e.withColumn("ts", F.col("ts").cast("timestamp"))), spark=spark),
    }
    rows = []
    for name, run in cases.items():
        try:
            run()
            rows.append((name, "none"))
        except ChronoweaveError as x:
            rows.append((name, type(x).__name__))
    return spark.createDataFrame(rows, "case string, error string")


@_add("warned", _VALUES.format("('duplicates taken', 1), ('label after splits', 1), ('nothing odd', 0), ('splits apart', 1)", '"case", warnings'))
def warned(spark: SparkSession, d: str) -> DataFrame:
    """What is done all the same, but said."""
    e = _t(spark, d, "events")
    twice = Source(df=e.union(e), keys="user_id", timestamp="ts", name="s")
    cases = {
        "duplicates taken": lambda: bu.build(_purchases(spark, d), Feature(twice, "value", name="g", on_duplicate="keep_any"), spark=spark),
        "label after splits": lambda: checks.splits({"a": ("2024-01-01", "2024-02-01")}, checks.parse_time("2024-01-01"), checks.parse_time("2024-02-01")),
        "nothing odd": lambda: bu.build(_purchases(spark, d), _feature(spark, d), spark=spark),
        "splits apart": lambda: checks.splits({"a": ("2024-01-01", "2024-02-01"), "b": ("2024-02-02", "2024-03-01")}, None, None),
    }
    rows = []
    for name, run in cases.items():
        with warnings.catch_warnings(record=True) as got:
            warnings.simplefilter("always")
            run()
        rows.append((name, sum(issubclass(w.category, UserWarning) and "chronoweave" in w.filename for w in got)))
    return spark.createDataFrame(rows, "case string, warnings int")


# -- demo and command line ---------------------------------------------------------------


@_add("demo_tables", _VALUES.format("('labels', 50), ('train_LEAKY', 50), ('transactions', 2000), ('users', 400)", '"table", n'))
def demo_tables(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, df.count()) for n, df in quickstart.tables(spark, 100).items()], "table string, n int")


@_add("demo_leaks", _VALUES.format("('last_amount', FALSE, TRUE), ('rolling_spend', FALSE, TRUE), ('user_country', FALSE, TRUE), ('user_tier', FALSE, TRUE)", "feature, leaky_in_build, leaky_in_demo"))
def demo_leaks(spark: SparkSession, d: str) -> DataFrame:
    """The demo's features: a build of them is clean, and each is planted with leakage in its leaky dataset."""
    t = quickstart.tables(spark, 100)
    users, paid = Source(df=t["users"], keys="user_id", timestamp="updated_at", name="users"), Source(df=t["transactions"], keys="user_id", timestamp="created_at", name="paid")
    spend = "SELECT user_id, created_at AS feature_time, SUM(amount) OVER (PARTITION BY user_id ORDER BY created_at RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS spend_30d FROM {source}"
    features = [Feature(users, "country", name="user_country"), Feature(users, "tier", name="user_tier"), Feature(paid, sql=spend, name="rolling_spend", embargo="1d"), Feature(paid, "amount", name="last_amount")]
    built = bu.build(Labels(df=t["labels"], keys="user_id", label_time="label_time", target="churned"), features, spark=spark).df
    clean, leaky = (au.audit(x, features, keys="user_id", spark=spark) for x in (built, t["train_LEAKY"]))
    return spark.createDataFrame([(f.name, not clean[f.name].clean, not leaky[f.name].clean) for f in features], "feature string, leaky_in_build boolean, leaky_in_demo boolean")


_CALLS = ("audit", 0), ("audit strict, leaky", 1), ("build", 0), ("catalog", 0), ("diff", 0), ("explain", 0), ("inspect", 0), ("unknown features", 2)


@_add("cli_exit_codes", _VALUES.format(", ".join(f"('{c}', {e})" for c, e in _CALLS), "call, code"))
def cli_exit_codes(spark: SparkSession, d: str) -> DataFrame:
    """The commands over the demo's tables, and how they end."""
    base = files.scratch(spark, "cli")
    for n, df in quickstart.tables(spark, 100).items():
        df.write.parquet(f"{base}/{n}.parquet")
    leaky, built = f"{base}/train_LEAKY.parquet", f"{base}/built"
    # the driver alone reads the feature definitions
    folder = Path(tempfile.mkdtemp())
    (folder / "features.py").write_text(quickstart._FEATURES.format(data=base))
    spec = ["--features", str(folder / "features.py")]
    calls = {
        "inspect": ["inspect", f"{base}/users.parquet"],
        "catalog": ["catalog", *spec],
        "explain": ["explain", "--labels", f"{base}/labels.parquet", *spec],
        "build": ["build", "--labels", f"{base}/labels.parquet", *spec, "-o", built, "--store", f"{base}/store"],
        "audit": ["audit", built, *spec, "--keys", "user_id", "--strict"],
        "audit strict, leaky": ["audit", leaky, *spec, "--keys", "user_id", "--strict"],
        "diff": ["diff", built, leaky, "--keys", "user_id"],
        "unknown features": ["catalog", "--features", f"{base}/none.py"],
    }
    rows = []
    for name, args in calls.items():
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            rows.append((name, cli.main(args)))
    shutil.rmtree(folder)
    return spark.createDataFrame(rows, "call string, code int")
