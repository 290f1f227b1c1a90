"""What the plans must look like at any size."""

from __future__ import annotations

import pytest
from conftest import BASE, MINUTE
from pyspark.sql import functions as F

from barline.operators import backtest as bt
from barline.operators import dedup
from barline.operators.bars import trade_bars
from barline.operators.features import bar_features
from barline.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trade_bars_push_the_range_and_read_five_columns(spark, tmp_path):
    rows = [("a", BASE + i * 1000, 1.0, 1.0, True, i, "unused") for i in range(10)]
    schema = "symbol string, time bigint, price double, qty double, isBuyerMaker boolean, trade_id bigint, note string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/t")
    bars = trade_bars(spark.read.parquet(f"{tmp_path}/t"), bounds_ms=(BASE, BASE + MINUTE))
    plan = bars._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThanOrEqual(time," in plan and "LessThanOrEqual(time," in plan
    assert "ReadSchema: struct<symbol:string,time:bigint,price:double,qty:double,isBuyerMaker:boolean>" in plan
    assert plan.count("\n+- ") and _plan(bars).count("Exchange hashpartitioning") == 1
    assert "partial_sum" in plan


def test_copies_are_dropped_before_the_shuffle(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    plan = _plan(dedup.keep_first(events, ["user_id"], ["ts", "event_id"]))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning")
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")


def test_features_of_a_grid_need_one_shuffle(spark):
    schema = "symbol string, open_time bigint, open double, high double, low double, close double, volume double, trade_vol double, trade_dollar_vol double, n_trades bigint, buy_vol double, sell_vol double"
    plan = _plan(bar_features(spark.createDataFrame([], schema)))
    assert plan.count("Exchange") == 1


def test_backtest_shuffles_rows_once_per_branch(spark):
    df = spark.range(10).select(
        F.col("id").alias("row_id"), F.lit(1).alias("signal"), F.lit(1).alias("realized_direction")
    )
    plan = _plan(bt.backtest(df))
    # two branches for the rows, two for the chunk totals of the first scan
    assert plan.count("Exchange hashpartitioning(_chunk") <= 4


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_query_pairs_all_rows(spark, name):
    if name.startswith("hazard_") and name != "hazard_diagnostics":
        pytest.skip("fits a model to build its plan")
    plan = _plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
