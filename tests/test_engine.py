"""build, audit, diff, explain, store and command line on small tables."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest

import chronoweave as cw
from chronoweave import cli
from chronoweave.operators.results import severity

T = datetime(2024, 1, 10)
D = timedelta(days=1)


@pytest.fixture
def tables(spark, tmp_path):
    src = spark.createDataFrame([(u, T - n * D, float(10 * u + n)) for u in (1, 2, 3) for n in (1, 3, 40)], "uid bigint, at timestamp_ntz, v double")
    lab = spark.createDataFrame([(u, T + u * D, u % 2) for u in (1, 2, 3, 4)], "user_id bigint, label_time timestamp_ntz, y int")
    for name, df in (("src", src), ("lab", lab)):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    s = cw.Source(tmp_path / "src.parquet", keys="uid", timestamp="at")
    f = cw.Feature(s, {"v": "value"}, name="f", key_mapping={"user_id": "uid"})
    labels = cw.Labels(tmp_path / "lab.parquet", keys="user_id", label_time="label_time", target="y")
    return labels, f, tmp_path


def test_build_writes_splits_and_caches(spark, tables):
    labels, f, tmp = tables
    store = cw.Store(tmp / "store")
    said = []
    options = {"splits": {"a": ("2024-01-01", "2024-01-12"), "b": ("2024-01-12", "2024-02-01")}, "store": store, "spark": spark, "progress": said.append}
    r = cw.build(labels, f, tmp / "out.parquet", **options)
    assert r.stats.row_count == 4
    assert r.stats.feature_stats["f"] == {"matched": 3, "missing": 1, "violations": 0}
    assert r.validate()
    assert said[0] == "Loading labels"
    got = {x["user_id"]: x["f__value"] for x in spark.read.parquet(r.output_path).collect()}
    assert got == {1: 11.0, 2: 21.0, 3: 31.0, 4: None}
    assert [spark.read.parquet(p).count() for p in r.splits.values()] == [1, 3]
    again = cw.build(labels, f, tmp / "out.parquet", **options)
    assert again.manifest["build_id"] == r.manifest["build_id"]
    assert len(store.list_builds()) == 1
    assert cw.build(labels, f, tmp / "other.parquet", **options).manifest["features"]["f"]["cached"]


def test_single_file_and_flatten(spark, tables):
    labels, f, tmp = tables
    r = cw.build(labels, f, tmp / "one.parquet", single_file=True, flatten_columns=True, spark=spark)
    assert (tmp / "one.parquet").is_file()
    assert list(pd.read_parquet(tmp / "one.parquet").columns) == ["user_id", "label_time", "y", "value"]
    assert r.manifest["output"]["file_size_bytes"] > 0


def test_skip_keeps_nan(spark):
    src = cw.Source(df=spark.createDataFrame([(1, T, float("nan")), (2, T, None)], "k int, ft timestamp_ntz, v double"), keys="k", timestamp="ft")
    lab = cw.Labels(df=spark.createDataFrame([(1, T + D, 0), (2, T + D, 0)], "k int, lt timestamp_ntz, y int"), keys="k", label_time="lt", target="y")
    assert [r["k"] for r in cw.build(lab, cw.Feature(src, "v"), on_missing="skip", spark=spark).df.collect()] == [1]


def test_errors(spark, tables):
    labels, f, _ = tables
    twice = cw.Source(df=spark.createDataFrame([(1, T, 1.0), (1, T, 2.0)], "user_id bigint, at timestamp_ntz, v double"), keys="user_id", timestamp="at")
    with pytest.raises(cw.DuplicateError):
        cw.build(labels, cw.Feature(twice, "v"), spark=spark)
    assert cw.build(labels, cw.Feature(twice, "v", on_duplicate="keep_any"), spark=spark).df.where("v__v = 2.0").count() == 4 - 3
    zoned = cw.Source(df=twice.df.selectExpr("user_id", "cast(at as timestamp) at", "v").limit(1), keys="user_id", timestamp="at")
    with pytest.raises(cw.TimezoneError):
        cw.build(labels, cw.Feature(zoned, "v"), spark=spark)
    with pytest.raises(cw.SchemaError, match="did you mean"):
        cw.build(labels, cw.Feature(cw.Source(df=twice.df, keys="user_id", timestamp="At"), "v"), spark=spark)
    for bad in ({"max_lookback": "0d"}, {"join": "loose"}, {"on_missing": "drop"}, {"max_staleness": "0"}):
        with pytest.raises(cw.ConfigError):
            cw.build(labels, f, spark=spark, **bad)
    with pytest.raises(cw.ConfigError):
        cw.build(labels, [cw.Feature(f.source, "v", name="a-b"), cw.Feature(f.source, "v", name="a_b")], spark=spark)
    with pytest.raises(cw.ConfigError):
        cw.Feature(f.source, sql="select 1")


def test_audit_finds_the_future_and_passes_a_build(spark, tables):
    labels, f, tmp = tables
    df = cw.build(labels, f, spark=spark).df
    assert not cw.audit(df, f, keys="user_id", spark=spark).has_leakage
    bad = df.selectExpr("user_id", "label_time", "y", "coalesce(f__value, 0) + if(user_id = 2, 5, 0) as f__value")
    report = cw.audit(bad, f, keys="user_id", spark=spark)
    d = report["f"]
    assert (d.leaky_row_count, d.unsupported_row_count, d.severity) == (1, 1, "HIGH")
    assert d.leaky_rows.first()["user_id"] == 2
    report.to_json(tmp / "r.json")
    assert json.loads((tmp / "r.json").read_text())["has_leakage"]
    report.to_html(tmp / "r.html")
    with pytest.raises(cw.LeakageError):
        report.assert_clean()
    assert cw.audit(bad, f, keys="user_id", spark=spark, count_unsupported=True)["f"].leaky_row_count == 2


@pytest.mark.parametrize(("share", "days", "want"), [(0.06, 0, "HIGH"), (0.05, 0, "MEDIUM"), (0.01, 0, "LOW"), (0.0, 8, "HIGH"), (0.0, 7, "MEDIUM"), (0.0, 1, "MEDIUM"), (0.001, 0.9, "LOW")])
def test_severity(share, days, want):
    assert severity(share, timedelta(days=days)) == want


def test_diff(spark):
    old = spark.createDataFrame([(1, T, 1.0, "a", 1), (2, T, 2.0, "b", 1), (3, T, None, "c", 1), (4, T, 4.0, "d", 1)], "k int, label_time timestamp_ntz, x double, s string, gone int")
    new = spark.createDataFrame([(1, T, 1.0 + 1e-12, "a", 1), (2, T, 2.5, "z", 1), (3, T, 3.0, "c", 1), (5, T, 4.0, "d", 1)], "k int, label_time timestamp_ntz, x double, s string, fresh int")
    r = cw.diff(old, new, keys="k", spark=spark)
    assert (r.joined_rows, r.rows_only_old, r.rows_only_new) == (3, 1, 1)
    assert {c: v["changed_count"] for c, v in r.value_changes.items()} == {"x": 2, "s": 1}
    assert {(c["type"], c["column"]) for c in r.schema_changes} == {("+", "fresh"), ("-", "gone"), ("~", "x"), ("~", "s")}


def test_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("k;ft;v\n1;2024-01-09T10:00:00;5\n")
    src = cw.CSVSource(tmp_path / "s.csv", "k", "ft", delimiter=";")
    assert dict(src.load(spark).dtypes)["ft"] == "timestamp_ntz"
    pdf = pd.DataFrame({"k": [1], "lt": [T], "y": [True]})
    r = cw.build(cw.Labels(df=pdf, keys="k", label_time="lt", target="y"), cw.Feature(src, "v"), spark=spark)
    assert r.df.first()["v__v"] == 5
    with pytest.raises(cw.ConfigError):
        cw.Source("x.json", keys="k", timestamp="t")
    with pytest.raises(cw.ValidationError):
        cw.Source(df=[1], keys="k", timestamp="t").load(spark)


def test_explain_and_cli(spark, tables, capsys, monkeypatch):
    labels, f, tmp = tables
    text = str(cw.explain(labels, f, max_staleness="2d", spark=spark))
    assert "[label_time - 2d, label_time)" in text
    assert "uid = :user_id" in text
    monkeypatch.chdir(tmp)
    assert cli.main(["init"]) == 0
    (tmp / "features.py").write_text(f"from chronoweave import *\ns = Source({str(tmp / 'src.parquet')!r}, keys='uid', timestamp='at')\nf = Feature(s, {{'v': 'value'}}, name='f', key_mapping={{'user_id': 'uid'}})\n")
    lab, built = str(tmp / "lab.parquet"), str(tmp / "built.parquet")
    base = ["--labels", lab, "--features", "features.py"]
    assert cli.main(["build", *base, "-o", built, "--split", "a:2024-01-01T00:00:2024-01-12"]) == 0
    assert cli.main(["explain", *base]) == 0
    assert cli.main(["audit", built, "--features", "features.py", "--keys", "user_id", "--strict"]) == 0
    assert cli.main(["diff", built, built, "--keys", "user_id"]) == 0
    assert cli.main(["inspect", lab]) == 0
    assert cli.main(["catalog", "--features", "features.py:f"]) == 0
    capsys.readouterr()
    assert cli.main(["inspect", lab, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["keys"] == ["user_id"]
    assert cli.main(["audit", built, "--features", "none.py", "--keys", "user_id"]) == 2


def test_splits(spark):
    from chronoweave.operators.checks import splits

    with pytest.raises(cw.ConfigError):
        splits({"a": ("2024-01-01", "2024-02-01"), "b": ("2024-01-31", "2024-03-01")}, None, None)
    with pytest.warns(UserWarning):
        splits({"a": ("2024-01-01", "2024-02-01"), "b": ("2024-02-02", "2024-03-01")}, None, None)
