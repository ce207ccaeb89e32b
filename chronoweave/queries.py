"""Every operator as a query over the driver's tables, with the same in SQL.

Labels are purchase events, or orders; features are the other events of the
same user, or daily sums of the customer's line items.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.durations import days_between
from .model import Feature, FeatureSet, Labels, Source, SQLSource
from .operators import audit as au
from .operators import build as bu
from .operators import checks
from .operators import diff as di
from .operators.asof import Branch, as_of, newest_per_key, range_join
from .operators.compare import ATOL, RTOL
from .sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- inputs ------------------------------------------------------------------


def _purchases(spark: SparkSession, d: str) -> Labels:
    rows = _t(spark, d, "events").where("event_type = 'purchase'")
    return Labels(df=rows.select("event_id", "user_id", F.col("ts").alias("label_time"), F.col("value").alias("target")), keys="user_id", label_time="label_time", target=["event_id", "target"])


def _others(spark: SparkSession, d: str, kind: str | None = None) -> Source:
    rows = _t(spark, d, "events").where(f"event_type = '{kind}'" if kind else "event_type <> 'purchase'")
    return Source(df=rows.select("user_id", "ts", "value", "event_type", "event_id"), keys="user_id", timestamp="ts", name=kind or "others")


_L = "l AS (SELECT event_id, user_id, ts AS label_time, value AS target FROM events WHERE event_type = 'purchase')"
_F = "f AS (SELECT user_id, ts AS feature_time, value, event_type FROM events WHERE event_type <> 'purchase')"


def _range_sql(select: str, bound: str, f: str = _F, lower: str = "INTERVAL 365 DAY") -> str:
    return f"""WITH {_L}, {f}, j AS (
  SELECT l.*, f.* EXCLUDE (user_id), row_number() OVER (PARTITION BY l.event_id ORDER BY f.feature_time DESC) AS rn
  FROM l LEFT JOIN f ON l.user_id = f.user_id AND f.feature_time {bound} AND f.feature_time >= l.label_time - {lower}
) SELECT user_id, label_time, event_id, target, {select} FROM j WHERE rn = 1"""


def _build(spark: SparkSession, labels: Labels, features: object, **options: object) -> DataFrame:
    return bu.build(labels, features, spark=spark, **options).df


# -- as-of joins ---------------------------------------------------------------

_VALUES = "value AS f__value, event_type AS f__event_type"


@_add("asof_strict", f"WITH {_L}, {_F} SELECT l.user_id, label_time, event_id, target, f.value AS f__value, f.event_type AS f__event_type FROM l ASOF LEFT JOIN f ON l.user_id = f.user_id AND l.label_time > f.feature_time")
def asof_strict(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, _purchases(spark, d), Feature(_others(spark, d), ["value", "event_type"], name="f"))


def _orders(spark: SparkSession, d: str) -> Labels:
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return Labels(df=o, keys="o_custkey", label_time="o_orderdate", target=["o_orderkey", "o_totalprice"])


def _daily(spark: SparkSession, d: str) -> DataFrame:
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    both = o.join(li, o.o_orderkey == li.l_orderkey)
    return both.groupBy("o_custkey", "l_shipdate").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n_lines"))


_DAILY = "f AS (SELECT o_custkey, l_shipdate AS feature_time, sum(l_quantity) AS qty, count(*) AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


def _orders_sql(op: str, lower: str = "INTERVAL 365 DAY", embargo: str = "") -> str:
    return f"""WITH {_DAILY}, j AS (
  SELECT o.*, f.qty, f.n_lines, row_number() OVER (PARTITION BY o_orderkey ORDER BY f.feature_time DESC) AS rn
  FROM orders o LEFT JOIN f ON o.o_custkey = f.o_custkey AND f.feature_time {op} o_orderdate{embargo} AND f.feature_time >= o_orderdate - {lower}
) SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, qty AS lines__qty, n_lines AS lines__n_lines FROM j WHERE rn = 1"""


def _lines(spark: SparkSession, d: str, **more: object) -> Feature:
    return Feature(Source(df=_daily(spark, d), keys="o_custkey", timestamp="l_shipdate", name="daily"), ["qty", "n_lines"], name="lines", **more)


@_add("asof_inclusive", _orders_sql("<="))
def asof_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, _orders(spark, d), _lines(spark, d), join="inclusive")


@_add("asof_strict_ties", _orders_sql("<"))
def asof_strict_ties(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, _orders(spark, d), _lines(spark, d))


@_add("asof_embargo", _range_sql(_VALUES, "< l.label_time - INTERVAL 1 DAY"))
def asof_embargo(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, _purchases(spark, d), Feature(_others(spark, d), ["value", "event_type"], name="f", embargo="1d"))


@_add("asof_compound_embargo", _range_sql(_VALUES, "< l.label_time - INTERVAL 30 HOUR"))
def asof_compound_embargo(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, _purchases(spark, d), Feature(_others(spark, d), ["value", "event_type"], name="f", embargo="1d6h"))


@_add("asof_lookback", _range_sql(_VALUES, "< l.label_time", lower="INTERVAL 12 HOUR"))
def asof_lookback(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, _purchases(spark, d), Feature(_others(spark, d), ["value", "event_type"], name="f"), max_lookback="12h")


@_add("asof_staleness", _range_sql(_VALUES, "< l.label_time - INTERVAL 6 HOUR", lower="INTERVAL 36 HOUR"))
def asof_staleness(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, _purchases(spark, d), Feature(_others(spark, d), ["value", "event_type"], name="f", embargo="6h"), max_staleness="1d12h")


@_add("asof_range_plan", _range_sql("value AS f__value, feature_time AS f__feature_time", "< l.label_time - INTERVAL 1 DAY", lower="INTERVAL 7 DAY"))
def asof_range_plan(spark: SparkSession, d: str) -> DataFrame:
    labels, s = _purchases(spark, d), _others(spark, d)
    rows = s.df.select("user_id", F.col("ts").alias("feature_time"), "value")
    return range_join(labels.df, ["user_id"], "label_time", Branch("f", rows, ("value",), timedelta(days=1)), timedelta(days=7))


@_add("asof_skew_bucket", _range_sql("value AS f__value, feature_time AS f__feature_time", "< l.label_time - INTERVAL 1 DAY", lower="INTERVAL 7 DAY"))
def asof_skew_bucket(spark: SparkSession, d: str) -> DataFrame:
    labels, s = _purchases(spark, d), _others(spark, d)
    rows = s.df.select("user_id", F.col("ts").alias("feature_time"), "value")
    return as_of(labels.df, ["user_id"], "label_time", [Branch("f", rows, ("value",), timedelta(days=1))], timedelta(days=7), skew_bucket=timedelta(days=3))


_MULTI = f"""WITH {_L}, a AS (SELECT user_id, ts AS ft, value FROM events WHERE event_type = 'view'),
b AS (SELECT user_id, ts AS ft, value FROM events WHERE event_type = 'click'),
x AS (SELECT l.event_id, arg_max(a.value, a.ft) AS v FROM l JOIN a ON l.user_id = a.user_id AND a.ft < l.label_time GROUP BY ALL),
y AS (SELECT l.event_id, arg_max(b.value, b.ft) AS v FROM l JOIN b ON l.user_id = b.user_id AND b.ft < l.label_time - INTERVAL 2 DAY GROUP BY ALL)
SELECT user_id, label_time, l.event_id, target, x.v AS viewed__value, y.v AS clicked__value FROM l LEFT JOIN x USING (event_id) LEFT JOIN y USING (event_id)"""


@_add("asof_multi_feature", _MULTI)
def asof_multi_feature(spark: SparkSession, d: str) -> DataFrame:
    both = FeatureSet("activity", [Feature(_others(spark, d, "view"), "value", name="viewed"), Feature(_others(spark, d, "click"), "value", name="clicked", embargo="2d")])
    return _build(spark, _purchases(spark, d), both)


@_add(
    "asof_multi_key",
    """WITH l AS (SELECT event_id, user_id, event_type, ts AS label_time FROM events), j AS (
  SELECT l.*, f.value AS v, row_number() OVER (PARTITION BY l.event_id ORDER BY f.ts DESC) AS rn
  FROM l LEFT JOIN events f ON l.user_id = f.user_id AND l.event_type = f.event_type AND f.ts < l.label_time
) SELECT user_id, event_type, label_time, event_id, v AS previous__value FROM j WHERE rn = 1""",
)
def asof_multi_key(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    labels = Labels(df=e.withColumnRenamed("ts", "label_time"), keys=["user_id", "event_type"], label_time="label_time", target="event_id")
    source = Source(df=e, keys=["user_id", "event_type"], timestamp="ts", name="events")
    return _build(spark, labels, Feature(source, "value", name="previous"))


@_add("asof_key_mapping", _range_sql("value AS f__value", "< l.label_time"))
def asof_key_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = _others(spark, d).df.select(F.col("user_id").cast("int").alias("uid"), "ts", "value")
    return _build(spark, _purchases(spark, d), Feature(Source(df=rows, keys="uid", timestamp="ts", name="m"), "value", name="f", key_mapping={"user_id": "uid"}))


@_add("on_missing_skip", f"SELECT * FROM ({_range_sql(_VALUES, '< l.label_time', lower='INTERVAL 6 HOUR')}) WHERE f__value IS NOT NULL AND f__event_type IS NOT NULL")
def on_missing_skip(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, _purchases(spark, d), Feature(_others(spark, d), ["value", "event_type"], name="f"), max_lookback="6h", on_missing="skip")


@_add("feature_columns", "SELECT user_id, ts AS feature_time, value, event_type FROM events WHERE event_type <> 'purchase'")
def feature_columns(spark: SparkSession, d: str) -> DataFrame:
    from .plans.compute import feature_rows

    s = _others(spark, d)
    return feature_rows(spark, Feature(s, ["value", "event_type"]), s.df)


@_add("feature_rename", _range_sql("value AS f__amount", "< l.label_time"))
def feature_rename(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, _purchases(spark, d), Feature(_others(spark, d), {"value": "amount"}, name="f"))


_ROLLING = "SELECT user_id, ts AS feature_time, SUM(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS spend FROM {source}"


@_add("feature_sql_rolling_30d", "SELECT user_id, label_time, event_id, target, round(spend, 6) AS rolling__spend FROM (" + _range_sql("spend", "< l.label_time - INTERVAL 1 DAY", f"f AS ({_ROLLING.format(source='(SELECT * FROM events WHERE event_type <> $$purchase$$)')})") + ")")
def feature_sql_rolling_30d(spark: SparkSession, d: str) -> DataFrame:
    f = Feature(_others(spark, d), sql=_ROLLING, name="rolling", embargo="1d")
    return _build(spark, _purchases(spark, d), f).withColumn("rolling__spend", F.round("rolling__spend", 6))


@_add("feature_sql_source", _range_sql("value AS f__value", "< l.label_time", "f AS (SELECT user_id, ts AS feature_time, value FROM events WHERE event_type = 'view')"))
def feature_sql_source(spark: SparkSession, d: str) -> DataFrame:
    s = SQLSource("SELECT user_id, ts, value FROM all_events WHERE event_type = 'view'", "user_id", "ts", "views", {"all_events": _t(spark, d, "events")})
    return _build(spark, _purchases(spark, d), Feature(s, "value", name="f"))


@_add("feature_transform", _range_sql("doubled AS f__doubled", "< l.label_time", "f AS (SELECT user_id, ts AS feature_time, value * 2 AS doubled FROM events WHERE event_type <> 'purchase')"))
def feature_transform(spark: SparkSession, d: str) -> DataFrame:
    def doubled(_: SparkSession, source: DataFrame) -> DataFrame:
        return source.select("user_id", F.col("ts").alias("feature_time"), (F.col("value") * 2).alias("doubled"))

    return _build(spark, _purchases(spark, d), Feature(_others(spark, d), transform=doubled, name="f"))


@_add("flatten", _range_sql("value, event_type", "< l.label_time"))
def flatten(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, _purchases(spark, d), Feature(_others(spark, d), ["value", "event_type"], name="f"), flatten_columns=True)


def _split(name: str, a: str, b: str) -> None:
    @_add(name, f"SELECT * FROM ({_SQL['asof_strict']}) WHERE label_time >= TIMESTAMP '{a}' AND label_time < TIMESTAMP '{b}'")
    def split(spark: SparkSession, d: str) -> DataFrame:
        parts = checks.splits({name: (a, b)}, None, None)
        return bu.split_rows(asof_strict(spark, d), "label_time", *parts[name])


_split("split_train", "2024-01-01", "2024-01-20")
_split("split_test", "2024-01-20", "2024-02-01")


# -- checks and statistics -------------------------------------------------------

_DUPLICATES = "SELECT l_suppkey, l_shipdate, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1"


@_add("duplicate_groups", _DUPLICATES)
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicate_groups(_t(spark, d, "lineitem"), ["l_suppkey"], "l_shipdate")


@_add("duplicate_examples", _DUPLICATES + " ORDER BY n_rows DESC, l_suppkey, l_shipdate LIMIT 3")
def duplicate_examples(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicate_examples(_t(spark, d, "lineitem"), ["l_suppkey"], "l_shipdate")


@_add("label_time_range", "SELECT count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE event_type = 'purchase'")
def label_time_range(spark: SparkSession, d: str) -> DataFrame:
    return bu.label_times(_purchases(spark, d).df, "label_time")


def _joined(spark: SparkSession, d: str, back: str = "12h") -> tuple[DataFrame, list]:
    f = Feature(_others(spark, d), ["value", "event_type"], name="f", embargo="1h")
    return bu.join_features(spark, _purchases(spark, d), [f], bu.lookback(back))


_JOINED = _range_sql("value AS f__value, feature_time", "< l.label_time - INTERVAL 1 HOUR", lower="INTERVAL 12 HOUR")


@_add("feature_stats", f"SELECT count(*) AS n, count(*) FILTER (f__value IS NULL) AS missing_0, count(*) FILTER (feature_time >= label_time - INTERVAL 1 HOUR) AS violations_0 FROM ({_JOINED})")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    joined, branches = _joined(spark, d)
    return bu.statistics(joined, "label_time", branches, False)


@_add("verify_violations", f"WITH {_L} SELECT count(*) AS n, CAST(0 AS BIGINT) AS missing_0, count(*) FILTER (event_id % 3 = 0) AS violations_0 FROM l")
def verify_violations(spark: SparkSession, d: str) -> DataFrame:
    """The check finds what is planted: every third row's feature time is its label time."""
    rows = _purchases(spark, d).df
    late = F.when(F.col("event_id") % 3 == 0, F.col("label_time")).otherwise(F.col("label_time") - F.expr("INTERVAL 2 DAY"))
    planted = rows.select("*", F.lit(1.0).alias("f__value"), late.alias("f__feature_time"))
    return bu.statistics(planted, "label_time", [Branch("f", rows, ("value",), timedelta(days=1))], False)


# -- audit ---------------------------------------------------------------------------


def _claimed(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with a claimed feature time: some too late, some missing."""
    e = F.col("event_id")
    shift = F.when(e % 5 == 0, F.expr("INTERVAL 3 DAY")).when(e % 5 == 1, F.expr("INTERVAL 0 DAY")).otherwise(F.expr("INTERVAL -4 DAY"))
    return _purchases(spark, d).df.withColumn("ft", F.when(e % 7 != 0, F.col("label_time") + shift))


_CLAIMED = f"""WITH {_L}, c AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN label_time + CASE WHEN event_id % 5 = 0 THEN INTERVAL 3 DAY WHEN event_id % 5 = 1 THEN INTERVAL 0 DAY ELSE INTERVAL (-4) DAY END END AS ft FROM l),
s AS (SELECT count(*) AS n, count(*) FILTER (ft >= label_time) AS leaky, CAST(max(date_diff('microsecond', label_time, ft)) FILTER (ft >= label_time) AS BIGINT) AS max_us,
CAST(median(date_diff('microsecond', label_time, ft)) FILTER (ft >= label_time) AS BIGINT) AS median_us, count(*) FILTER (ft IS NULL) AS nulls FROM c)"""
_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2000-01-01', TIMESTAMP_NTZ'2000-01-01' + {0})"


@_add("audit_temporal", _CLAIMED + " SELECT * FROM s")
def audit_temporal(spark: SparkSession, d: str) -> DataFrame:
    r = au.temporal_summary(_claimed(spark, d), {"x": "ft"}, "label_time")
    return r.select("n", F.col("leaky_0").alias("leaky"), F.expr(_US.format("max_0")).alias("max_us"), F.expr(_US.format("median_0")).alias("median_us"), F.col("null_0").alias("nulls"))


@_add("audit_severity", _CLAIMED + " SELECT 'x' AS feature, CASE WHEN max_us // 86400000000 > 7 OR leaky / n > 0.05 THEN 'HIGH' WHEN leaky / n > 0.01 OR max_us // 86400000000 >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity, leaky AS leaky_row_count FROM s")
def audit_severity(spark: SparkSession, d: str) -> DataFrame:
    report = au.audit(_claimed(spark, d), feature_time_columns={"x": "ft"}, label_time="label_time", spark=spark)
    rows = [(n, f.severity, f.leaky_row_count) for n, f in report.features.items()]
    return spark.createDataFrame(rows, "feature string, severity string, leaky_row_count bigint")


def _tampered(spark: SparkSession, d: str) -> DataFrame:
    df = asof_strict(spark, d)
    e = F.col("event_id")
    return df.select(
        "user_id", "label_time", "event_id",
        F.when(e % 4 == 0, F.col("f__value") + 1).when(e % 4 == 1, F.col("f__value") * (1 + 1e-9)).when(e % 4 == 2, F.coalesce("f__value", F.lit(5.0))).otherwise(F.col("f__value")).alias("f__value"),
        F.when(e % 6 == 0, F.lit("tampered")).otherwise(F.col("f__event_type")).alias("f__event_type"),
    )


def _rebuild(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    f = Feature(_others(spark, d), columns, name="f")
    joined, plan = au.rebuilt(spark, _tampered(spark, d), [f], ["user_id"], "label_time", bu.DEFAULT_LOOKBACK, None, False)
    return au.rebuild_summary(joined, plan, "label_time")


_STRICT = f"SELECT user_id, label_time, event_id, feature_time, value AS v, event_type AS s FROM ({_range_sql('value, event_type, feature_time', '< l.label_time')})"


@_add("audit_rebuild_numeric", f"SELECT count(*) AS n, count(*) FILTER (event_id % 4 = 0 AND v IS NOT NULL) AS leaky, count(*) FILTER (event_id % 4 = 2 AND v IS NULL) AS unsupported FROM ({_STRICT})")
def audit_rebuild_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _rebuild(spark, d, ["value"]).select("n", F.col("leaky_0").alias("leaky"), F.col("unsupported_0").alias("unsupported"))


@_add("audit_rebuild_string", f"SELECT count(*) AS n, count(*) FILTER (event_id % 6 = 0 AND s IS NOT NULL) AS leaky, count(*) FILTER (event_id % 6 = 0 AND s IS NULL) AS unsupported FROM ({_STRICT})")
def audit_rebuild_string(spark: SparkSession, d: str) -> DataFrame:
    return _rebuild(spark, d, ["event_type"]).select("n", F.col("leaky_0").alias("leaky"), F.col("unsupported_0").alias("unsupported"))


@_add("audit_age_stats", f"SELECT CAST(max(date_diff('microsecond', feature_time, label_time)) AS BIGINT) AS max_us, CAST(median(date_diff('microsecond', feature_time, label_time)) AS BIGINT) AS median_us, count(*) FILTER (v IS NULL) AS nulls FROM ({_STRICT})")
def audit_age_stats(spark: SparkSession, d: str) -> DataFrame:
    r = _rebuild(spark, d, ["value"])
    return r.select(F.expr(_US.format("max_0")).alias("max_us"), F.expr(_US.format("median_0")).alias("median_us"), F.col("null_0").alias("nulls"))


# -- diff -------------------------------------------------------------------------------


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = F.col("c_custkey")
    old = _t(spark, d, "customer").select(c, F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("at"), "c_acctbal", "c_mktsegment", "c_name", F.lit(1).alias("gone"))
    bal = F.when(c % 10 == 0, F.col("c_acctbal") + 5).when(c % 10 == 1, F.lit(None)).when(c % 10 == 2, F.col("c_acctbal") + 1e-12).otherwise(F.col("c_acctbal"))
    new = old.where(c % 50 != 7).select("c_custkey", "at", bal.alias("c_acctbal"), F.when(c % 9 == 0, F.lit("NEW")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), "c_name", F.lit("x").alias("fresh"))
    return old, new


def _diff(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    old, new = _versions(spark, d)
    _, common = di.schema_changes(old, new, ["c_custkey", "at"])
    return di.summary(di.joined(old, new, ["c_custkey"], "at", common), old, new, common, ATOL, RTOL), common


_MET = "FROM customer WHERE c_custkey % 50 <> 7"


@_add("diff_numeric", f"SELECT count(*) AS joined, (SELECT count(*) FROM customer WHERE c_custkey % 50 = 7) AS only_old, CAST(0 AS BIGINT) AS only_new, count(*) FILTER (c_custkey % 10 IN (0, 1)) AS changed {_MET}")
def diff_numeric(spark: SparkSession, d: str) -> DataFrame:
    r, common = _diff(spark, d)
    return r.select("joined", "only_old", "only_new", F.col(f"changed_{common.index('c_acctbal')}").alias("changed"))


@_add("diff_string", f"SELECT count(*) FILTER (c_custkey % 9 = 0) AS changed, CAST(0 AS BIGINT) AS changed_name {_MET}")
def diff_string(spark: SparkSession, d: str) -> DataFrame:
    r, common = _diff(spark, d)
    return r.select(F.col(f"changed_{common.index('c_mktsegment')}").alias("changed"), F.col(f"changed_{common.index('c_name')}").alias("changed_name"))


@_add("diff_null_flip", f"SELECT count(*) AS flipped {_MET} AND c_custkey % 10 = 1")
def diff_null_flip(spark: SparkSession, d: str) -> DataFrame:
    from .operators.compare import flips

    old, new = _versions(spark, d)
    both = di.joined(old, new, ["c_custkey"], "at", ["c_acctbal"]).where("o is not null and n is not null")
    return both.agg(F.count_if(flips(F.col("o")["c_acctbal"], F.col("n")["c_acctbal"])).alias("flipped"))


@_add("diff_deltas", f"""SELECT round(avg(delta), 6) AS mean_delta, round(max(abs(delta)), 6) AS max_delta FROM (
SELECT CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 5 - c_acctbal WHEN c_custkey % 10 = 2 AND c_acctbal + 1e-12 <> c_acctbal THEN c_acctbal + 1e-12 - c_acctbal END AS delta {_MET})""")
def diff_deltas(spark: SparkSession, d: str) -> DataFrame:
    r, common = _diff(spark, d)
    i = common.index("c_acctbal")
    return r.select(F.round(f"mean_{i}", 6).alias("mean_delta"), F.round(f"max_{i}", 6).alias("max_delta"))


@_add("diff_schema", "SELECT * FROM (VALUES ('+', 'fresh'), ('-', 'gone')) t(type, \"column\")")
def diff_schema(spark: SparkSession, d: str) -> DataFrame:
    changes, _ = di.schema_changes(*_versions(spark, d), ["c_custkey", "at"])
    return spark.createDataFrame([(c["type"], c["column"]) for c in changes], "type string, column string")


# -- inspection, scans, scalar functions ---------------------------------------------


@_add("inspect_columns", "SELECT " + " UNION ALL SELECT ".join(f"'{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows FROM events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")))
def inspect_columns(spark: SparkSession, d: str) -> DataFrame:
    from .cli import distinct_counts

    return distinct_counts(_t(spark, d, "events"))


@_add("latest_per_key", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return newest_per_key(_t(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", ["event_id"])


@_add("date_diff_days", "SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_diff_days(spark: SparkSession, d: str) -> DataFrame:
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", days_between("o_orderdate", "l_shipdate").alias("days"))


@_add("build_sink", _SQL["asof_strict"])
def build_sink(spark: SparkSession, d: str) -> DataFrame:
    """The whole verb with Parquet output in the shared folder, read back."""
    target = files.scratch(spark, "build")
    f = Feature(_others(spark, d), ["value", "event_type"], name="f")
    return bu.build(_purchases(spark, d), f, target, spark=spark).df


@_add("csv_round_trip", "SELECT event_id, user_id, ts, event_type FROM events")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Events through the CSV source, times without a zone kept as such."""
    target = files.scratch(spark, "events") + ".csv"
    _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type").write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(target)
    return Source(path=target, keys="user_id", timestamp="ts", schema="event_id long, user_id long, ts timestamp_ntz, event_type string").load(spark)


from . import verb_queries  # noqa: E402, F401  registers the queries of the verbs
