from datetime import timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st

from chronoweave import ConfigError
from chronoweave.functions.durations import format_duration, interval, parse_duration


@pytest.mark.parametrize(("text", "want"), [("30d", timedelta(30)), ("1d6h", timedelta(hours=30)), ("15m", timedelta(minutes=15)), ("1d 2h 3m 4s", timedelta(1, 4, 0, 0, 3, 2)), ("0", timedelta(0)), (None, None), (timedelta(5), timedelta(5))])
def test_parse(text, want):
    assert parse_duration(text) == want


@pytest.mark.parametrize("text", ["", "d", "6h1d", "-1d", "1w", "1.5d", 3, timedelta(-1)])
def test_refused(text):
    with pytest.raises(ConfigError):
        parse_duration(text)


@given(st.integers(0, 10**8))
def test_round_trip(seconds):
    t = timedelta(seconds=seconds)
    assert parse_duration(format_duration(t)) == t


def test_interval_is_one_value(spark):
    t = timedelta(days=1, hours=6, microseconds=7)
    assert spark.range(1).select(interval(t).alias("i")).first()["i"] == t
