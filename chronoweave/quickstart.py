"""A demo project: churn labels, user snapshots, transactions, and a dataset with planted leakage."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError

TEMPLATES = ("churn",)
_FEATURES = '''"""Features of the demo."""
from chronoweave import Feature, FeatureSet, Source

users = Source("{data}/users.parquet", keys="user_id", timestamp="updated_at")
transactions = Source("{data}/transactions.parquet", keys="user_id", timestamp="created_at")

user_country = Feature(users, "country", name="user_country")
user_tier = Feature(users, {{"tier": "tier"}}, name="user_tier")
rolling_spend = Feature(
    transactions,
    sql="""SELECT user_id, created_at AS feature_time, SUM(amount) OVER (
             PARTITION BY user_id ORDER BY created_at
             RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS spend_30d FROM {{source}}""",
    name="rolling_spend", embargo="1d",
)
last_amount = Feature(transactions, {{"amount": "amount"}}, name="last_amount")
churn = FeatureSet("churn", [user_country, user_tier, rolling_spend, last_amount])
'''
_CONFIG = "labels:\n  path: {data}/labels.parquet\n  keys: [user_id]\n  label_time: label_time\n  target: [churned]\nfeatures: ['features.py:churn']\ndefaults:\n  max_lookback: 365d\n"


def tables(spark: SparkSession, users: int) -> dict[str, DataFrame]:
    """users (four snapshots each), transactions (20 a user), labels of every other user, and leaky training data.

    Of ``train_LEAKY`` every feature knows too much: country and tier are those of
    the user's last snapshot ever, the spend reaches 14 days and the last amount 2
    days beyond the label.
    """
    start = F.lit("2023-01-01").cast("timestamp_ntz")

    def after(days: F.Column, hours: F.Column | int = 0) -> F.Column:
        return start + F.make_dt_interval(days.cast("int"), F.lit(hours) if isinstance(hours, int) else hours.cast("int"))

    i = F.col("id")
    user, n = i % users, F.floor(i / users)
    pick = lambda k, *of: F.element_at(F.array(*map(F.lit, of)), (k % len(of) + 1).cast("int"))
    snapshots = spark.range(users * 4).select(
        user.alias("user_id"), pick(user + n, "US", "UK", "DE", "FR", "JP").alias("country"), after(user % 200).alias("signup_date"),
        after(n * 150 + user % 30).alias("updated_at"), pick(user + 2 * n, "free", "pro", "enterprise").alias("tier"),
    )
    # a user's transactions lie 25 days apart, each at its own hour
    paid = spark.range(users * 20).select(user.alias("user_id"), after(n * 25 + user % 25, n).alias("created_at"), ((user * 7 + n * 13) % 200 / 10 + 1).alias("amount"))
    labels = spark.range(max(1, users // 2)).select((i * 2).alias("user_id"), after(380 + i * 5 % 60, 12).alias("label_time"), (i % 4 == 0).alias("churned"))
    last = snapshots.groupBy("user_id").agg(F.max_by(F.struct("country", "tier"), "updated_at").alias("u"))
    days = lambda d: F.expr(f"INTERVAL {d} DAY")
    near = labels.join(paid, "user_id").where(F.col("created_at") < F.col("label_time") + days(14))
    bought = near.groupBy("user_id", "label_time").agg(
        F.sum(F.when(F.col("created_at") >= F.col("label_time") - days(30), F.col("amount"))).alias("rolling_spend__spend_30d"),
        F.max_by("amount", F.when(F.col("created_at") < F.col("label_time") + days(2), F.col("created_at"))).alias("last_amount__amount"),
    )
    leaky = labels.join(last, "user_id", "left").join(bought, ["user_id", "label_time"], "left")
    leaky = leaky.select("user_id", "label_time", "churned", F.col("u.country").alias("user_country__country"), F.col("u.tier").alias("user_tier__tier"), "rolling_spend__spend_30d", "last_amount__amount")
    return {"users": snapshots, "transactions": paid, "labels": labels, "train_LEAKY": leaky}


def create(spark: SparkSession, name: str = "chronoweave-demo", minimal: bool = False, template: str = "churn") -> Path:
    """Write the project of ``template`` into a new folder ``name``; ``minimal``: a tenth of the users."""
    if template not in TEMPLATES:
        raise ConfigError(f"There is no template {template!r}; there is {', '.join(TEMPLATES)}.")
    folder = Path(name).resolve()
    (folder / "data").mkdir(parents=True, exist_ok=True)
    for t, df in tables(spark, 1000 if minimal else 10_000).items():
        df.write.mode("overwrite").parquet(str(folder / "data" / f"{t}.parquet"))
    (folder / "features.py").write_text(_FEATURES.format(data=folder / "data"))
    (folder / "chronoweave.yaml").write_text(_CONFIG.format(data=folder / "data"))
    return folder
