"""The fused join against hand-made values and against brute force."""

import random
from datetime import datetime, timedelta

import pytest

from chronoweave.operators.asof import Branch, as_of, range_join

T = datetime(2024, 1, 10)
US = timedelta(microseconds=1)
D = timedelta(days=1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def run(spark, features, embargo=timedelta(0), lookback=5 * D, staleness=None, inclusive=False, labels=None, **more):
    spine = frame(spark, labels or [(1, T, "y")], "k int, t timestamp_ntz, y string")
    rows = frame(spark, features, "k bigint, feature_time timestamp_ntz, v double")
    b = Branch("f", rows, ("v",), embargo)
    return as_of(spine, ["k"], "t", [b], lookback, staleness, inclusive, **more).orderBy("k", "t", "y").collect()


@pytest.mark.parametrize("embargo", [timedelta(0), D, timedelta(days=1, hours=6)])
@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize(("shift", "strict", "incl"), [(-US, True, True), (timedelta(0), False, True), (US, False, False)])
def test_upper_bound(spark, embargo, inclusive, shift, strict, incl):
    (r,) = run(spark, [(1, T - embargo + shift, 3.0)], embargo, inclusive=inclusive)
    assert (r["f__v"] == 3.0) == (incl if inclusive else strict)


@pytest.mark.parametrize("limit", ["lookback", "staleness"])
@pytest.mark.parametrize(("shift", "found"), [(-US, False), (timedelta(0), True), (US, True)])
def test_lower_bound(spark, limit, shift, found):
    more = {"lookback": 3 * D} if limit == "lookback" else {"staleness": 3 * D}
    (r,) = run(spark, [(1, T - 3 * D + shift, 3.0)], **more)
    assert (r["f__v"] is not None) == found


def test_newest_wins_even_if_null_and_nulls_match_nothing(spark):
    rows = [(1, T - 2 * D, 1.0), (1, T - D, None), (None, T - D, 5.0), (1, None, 6.0)]
    labels = [(1, T, "a"), (1, T, "a"), (None, T, "b"), (1, None, "c")]
    got = run(spark, rows, labels=labels)
    assert len(got) == 4
    assert all(r["f__v"] is None for r in got)
    assert sum(r["f__feature_time"] == T - D for r in got) == 2


@pytest.mark.parametrize("bucket", [None, 2 * D, timedelta(hours=7)])
@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("embargo", [timedelta(0), timedelta(days=1, hours=6)])
def test_brute_force(spark, bucket, inclusive, embargo):
    rng = random.Random(5)
    hour = timedelta(hours=1)
    some = lambda: T + rng.randrange(200) * hour if rng.random() > 0.05 else None
    labels = [(rng.choice([1, 2, 3, None]), some(), str(i)) for i in range(80)]
    features = [(rng.choice([1, 2, 3, None]), some(), rng.choice([None, float(i)])) for i in range(150)]
    got = {r["y"]: r for r in run(spark, features, embargo, 4 * D, None, inclusive, labels, skew_bucket=bucket)}
    for k, t, y in labels:
        ok = [(ft, v) for fk, ft, v in features if k is not None and fk == k and t and ft and (ft <= t - embargo if inclusive else ft < t - embargo) and ft >= t - 4 * D]
        best = max((ft for ft, _ in ok), default=None)
        assert got[y]["f__feature_time"] == best
        if best is not None:
            assert got[y]["f__v"] in [v for ft, v in ok if ft == best]


def test_range_plan_agrees(spark):
    spine = frame(spark, [(1, T + i * D, str(i)) for i in range(9)], "k int, t timestamp_ntz, y string")
    rows = frame(spark, [(1, T + i * D, float(i)) for i in range(0, 9, 2)], "k int, feature_time timestamp_ntz, v double")
    b = Branch("f", rows, ("v",), D)
    one = as_of(spine, ["k"], "t", [b], 3 * D).orderBy("y").collect()
    assert one == range_join(spine, ["k"], "t", b, 3 * D).orderBy("y").collect()


def test_one_exchange_for_many_features(spark):
    spine = frame(spark, [(1, T, "y")], "k int, t timestamp_ntz, y string")
    branches = [Branch(f"f{i}", frame(spark, [(1, T, 1.0)], "k int, feature_time timestamp_ntz, v double"), ("v",), i * D) for i in range(4)]
    plan = as_of(spine, ["k"], "t", branches, 9 * D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 or plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    assert "NestedLoop" not in plan
