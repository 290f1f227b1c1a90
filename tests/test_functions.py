from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barline import functions as fn


def _one(spark, values, column, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema).coalesce(1)
    return [r[0] for r in df.select(column).collect()]


def test_epoch_units_and_bad_cells(spark):
    values = ["1730419200", "1730419200123", "1730419200123456", "1730419200123456789", "-1", "1730419200.5", "x", "", None]
    expected = [1730419200000, 1730419200123, 1730419200123, 1730419200123, -1000, 1730419200500, None, None, None]
    assert _one(spark, values, fn.epoch_ms("v")) == expected


def test_epoch_boundaries_and_floor(spark):
    values = [10**11 - 1, 10**11, 10**14, 10**17, -(10**14) - 1]
    expected = [(10**11 - 1) * 1000, 10**11, 10**11, 10**11, -(10**11) - 1]
    assert _one(spark, values, fn.epoch_ms("v"), "v bigint") == expected


def test_booleans(spark):
    values = ["true", "FALSE", " t ", "no", "1", "0", "0.5", "2", "-1", "y", "", "nan", None]
    expected = [True, False, True, False, True, False, False, True, True, None, None, None, None]
    assert _one(spark, values, fn.to_bool("v")) == expected


def test_numbers(spark):
    values = [" 1.5 ", "1e3", "abc", "", "1.5d", "2f", "7", None]
    assert _one(spark, values, fn.to_double("v")) == [1.5, 1000.0, None, None, None, None, 7.0, None]
    assert _one(spark, ["3.0", "3.5", "9007199254740993", "x"], fn.to_long("v")) == [3, None, 9007199254740993, None]


def test_finite(spark):
    values = [1.0, float("nan"), float("inf"), float("-inf"), None]
    assert _one(spark, values, fn.finite("v"), "v double") == [1.0, None, None, None, None]


def test_floor_division_of_large_and_negative(spark):
    values = [-1, 0, 1, 1730419200123456789]
    assert _one(spark, values, fn.div("v", 1_000_000), "v bigint") == [-1, 0, 0, 1730419200123]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_open_time_of_every_type(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ms = 1730419200123
        df = spark.range(1).select(
            F.timestamp_millis(F.lit(ms)).alias("a"),
            F.expr("timestamp_ntz'2024-11-01 00:00:00.123'").alias("b"),
            F.lit(ms).alias("c"),
            (F.lit(ms) + F.lit(0.4)).alias("d"),
            F.lit(str(ms)).alias("e"),
            F.lit(dt.date(2024, 11, 1)).alias("f"),
        )
        row = df.select(*[fn.open_time_ms(df, c).alias(c) for c in "abcdef"]).first()
        assert tuple(row) == (ms, ms, ms, ms, ms, ms - 123)
        days = df.select(fn.date_text("c"), fn.date_text(F.lit(-1).cast("bigint"))).first()
        assert tuple(days) == ("2024-11-01", "1969-12-31")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_day_bounds():
    assert fn.day_bounds_ms("2024-10-01", "2024-10-02") == (1727740800000, 1727913599999)


def test_lists_and_label_names():
    assert fn.positive_ints("240, 1440") == [240, 1440]
    assert fn.unit_floats("0.3,0.5") == [0.3, 0.5]
    assert fn.parse_grid("0.0, 0.1,") == [0.0, 0.1]
    for bad in (lambda: fn.positive_ints("0"), lambda: fn.unit_floats("1.0"), lambda: fn.parse_grid(" , ")):
        with pytest.raises(ValueError):
            bad()
    assert list(fn.drawdown_names([240], [0.3, 0.5])[240][2]) == ["y_dd_30p_H240m", "y_dd_50p_H240m"]
    with pytest.raises(ValueError, match="share"):
        fn.drawdown_names([3], [0.001, 0.002])


def test_feature_choice(spark):
    df = spark.createDataFrame(
        [], "symbol string, open_time bigint, ret_1m double, flag boolean, z_a double, y_dd_30p_H3m double, dd_min_H3m double, note string"
    )
    assert fn.base_feature_columns(df) == ["ret_1m", "flag", "z_a"]
    assert fn.training_columns(df, "scalefree") == ["ret_1m"]
    assert fn.training_columns(df, z_only=True) == ["z_a"]
    with pytest.raises(ValueError):
        fn.training_columns(df, "other")
    with pytest.raises(ValueError, match="close"):
        fn.require_columns(df, ["close"], "table")
