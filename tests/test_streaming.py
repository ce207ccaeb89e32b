from datetime import datetime, timedelta

import pytest

from chronoweave.cli import doctor, load_features
from chronoweave.errors import ConfigError
from chronoweave.operators.audit import audit
from chronoweave.quickstart import create
from chronoweave.streaming.audit import leaks_by_window, leaky_rows

T = datetime(2024, 1, 10)


def test_leaks_on_a_stream(spark, tmp_path):
    rows = [(i, T + timedelta(days=i % 3), T + timedelta(days=1)) for i in range(9)]
    spark.createDataFrame(rows, "i int, label_time timestamp_ntz, ft timestamp_ntz").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i int, label_time timestamp_ntz, ft timestamp_ntz").parquet(str(tmp_path / "in"))
    for name, df, mode in (("leaky", leaky_rows(stream, "ft"), "append"), ("counts", leaks_by_window(stream, "ft"), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("leaky").count() == 6
    assert [(r["n_rows"], r["n_leaky"]) for r in spark.table("counts").orderBy("window_start").collect()] == [(3, 3), (3, 3), (3, 0)]


def test_quickstart(spark, tmp_path):
    folder = create(spark, str(tmp_path / "demo"), minimal=True)
    assert spark.read.parquet(str(folder / "data/users.parquet")).count() == 4000
    features = load_features(str(folder / "features.py:churn"))
    assert [f.name for f in features] == ["user_country", "user_tier", "rolling_spend", "last_amount"]
    report = audit(str(folder / "data/train_LEAKY.parquet"), features, keys="user_id", spark=spark)
    assert report.leaky_features == [f.name for f in features]
    notes = doctor(folder, spark)
    assert {n["check"] for n in notes if not n["ok"]} == set()
    assert {"labels", "features together", "package pyspark", "source of last_amount"} <= {n["check"] for n in notes}
    with pytest.raises(ConfigError):
        create(spark, str(tmp_path / "other"), template="fraud")
