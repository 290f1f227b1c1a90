"""The literal cases: features, labels and causal scores on six minutes."""

from __future__ import annotations

import json
import math
import os

import pytest
from conftest import BASE, MINUTE

from barline.operators.bars import TRADE_AGG_COLUMNS
from barline.operators.features import DERIVED_COLUMNS, FEATURE_COLUMNS
from barline.plans import jobs

SYMBOL = "ABCUSDT"
DAY = {"start_date": "2024-10-01", "end_date": "2024-10-01"}


def _klines(spark, path, closes, first=BASE):
    rows = [
        (first + i * MINUTE, c * 0.99, c * 1.01, c * 0.98, float(c), 100.0 + i, SYMBOL)
        for i, c in enumerate(closes)
    ]
    spark.createDataFrame(
        rows,
        "open_time bigint, open double, high double, low double, close double, volume double, symbol string",
    ).coalesce(1).write.parquet(path)


def _trades(spark, path):
    rows = [
        (BASE + 10_000, 10.0, 2.0, False),
        (BASE + 20_000, 10.2, 1.0, True),
        (BASE + 150_000, 11.0, 3.0, False),
        (BASE + 345_000, 12.0, 4.0, True),
    ]
    spark.createDataFrame(
        rows, "time bigint, price double, qty double, isBuyerMaker boolean"
    ).write.parquet(path)


def _features(spark, folder, name, closes):
    _klines(spark, f"{folder}/{name}_klines", closes)
    config = jobs.FeatureConfig(
        klines=f"{folder}/{name}_klines",
        trades=f"{folder}/trades",
        out=f"{folder}/{name}.parquet",
        symbol=SYMBOL,
        **DAY,
    )
    return jobs.build_features_1m(spark, config).orderBy("open_time")


def _same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_features_of_six_minutes(spark, tmp_path):
    folder = str(tmp_path)
    _trades(spark, f"{folder}/trades")
    base = _features(spark, folder, "base", [100, 101, 102, 103, 104, 105])
    changed = _features(spark, folder, "changed", [100, 101, 102, 103, 104, 10_000])
    assert base.columns == list(FEATURE_COLUMNS)
    assert base.schema["open_time"].dataType.simpleString() == "bigint"
    assert base.schema["n_trades"].dataType.simpleString() == "bigint"
    rows, others = base.collect(), changed.collect()
    assert [rows[1][c] for c in TRADE_AGG_COLUMNS] == [0] * 5
    first = rows[0]
    assert (first.trade_vol, first.n_trades, first.buy_vol, first.sell_vol) == (3.0, 2, 2.0, 1.0)
    assert first.trade_dollar_vol == pytest.approx(30.2)
    for a, b in zip(rows[:5], others[:5]):
        assert all(_same(a[c], b[c]) for c in DERIVED_COLUMNS)
    assert rows[5].ret_1m == pytest.approx(math.log(105 / 104))
    assert rows[5].rv_5m is not None and rows[4].rv_5m is None
    assert all(r.rv_30m is None and r.vol_z_30m is None for r in rows)
    meta = json.load(open(f"{folder}/base.meta.json"))
    assert meta["symbol"] == SYMBOL and len(meta["feature_columns"]) == 20


def test_last_of_repeated_candles_wins_and_gaps_fail(spark, tmp_path):
    folder = str(tmp_path)
    _trades(spark, f"{folder}/trades")
    rows = _features(spark, folder, "one", [1, 2]).count()
    assert rows == 2
    config = jobs.FeatureConfig(f"{folder}/twice", f"{folder}/trades", f"{folder}/twice.parquet", symbol=SYMBOL, **DAY)
    schema = "open_time bigint, open double, high double, low double, close double, volume double"
    data = [(BASE, 1.0, 1.0, 1.0, 1.0, 1.0), (BASE, 1.0, 1.0, 1.0, 7.0, 1.0)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/twice")
    assert jobs.load_grid(spark, config).first().close == 7.0
    data.append((BASE + 2 * MINUTE, 1.0, 1.0, 1.0, 1.0, 1.0))
    spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/twice")
    with pytest.raises(ValueError, match=f"{BASE} and {BASE + 2 * MINUTE}"):
        jobs.load_grid(spark, config)
    empty = jobs.FeatureConfig(
        f"{folder}/twice", f"{folder}/trades", f"{folder}/x", "2030-01-01", "2030-01-01", SYMBOL
    )
    with pytest.raises(ValueError, match="no rows"):
        jobs.load_grid(spark, empty)


def test_labels_of_a_known_fall(spark, tmp_path):
    folder = str(tmp_path)
    closes = [100, 98, 70, 95, 96, 97]
    _klines(spark, f"{folder}/features", closes)
    config = jobs.LabelConfig(
        features=f"{folder}/features",
        out=f"{folder}/labels.parquet",
        horizons=(3,),
        thresholds=(0.30, 0.50),
        symbol=SYMBOL,
        **DAY,
    )
    rows = jobs.build_labels_drawdown(spark, config).orderBy("open_time").collect()
    assert [r.y_dd_30p_H3m for r in rows] == [1.0, 0.0, 0.0, None, None, None]
    assert [r.y_dd_50p_H3m for r in rows] == [0.0, 0.0, 0.0, None, None, None]
    assert rows[0].dd_min_H3m == pytest.approx(-0.30)
    assert [r.future_min_close_H3m for r in rows] == [70.0, 70.0, 95.0, None, None, None]
    assert json.load(open(f"{folder}/labels.meta.json"))["label_columns"] == ["y_dd_30p_H3m", "y_dd_50p_H3m"]


def _z_input(spark, path, values):
    rows = [(BASE + i * MINUTE, SYMBOL, v, 0.0, -0.1, 100.0) for i, v in enumerate(values)]
    spark.createDataFrame(
        rows,
        "open_time bigint, symbol string, imbalance double, y_dd_30p_H3m double, "
        "dd_min_H3m double, future_min_close_H3m double",
    ).write.parquet(path)


@pytest.mark.parametrize("mode", ["expanding", "rolling"])
def test_scores_do_not_see_the_future(spark, tmp_path, mode):
    results = []
    for name, last in (("base", 2.5), ("changed", 250.0)):
        path = f"{tmp_path}/{name}"
        _z_input(spark, path, [1.0, 1.2, 1.4, 1.6, 2.0, last])
        out = f"{tmp_path}/{name}_z.parquet"
        config = jobs.ZScoreConfig(path, out, mode=mode, window=4, min_periods=2, eps=1e-12)
        df = jobs.build_dataset_zscore_1m(spark, config).orderBy("open_time")
        assert df.columns == [
            "open_time", "symbol", "y_dd_30p_H3m", "dd_min_H3m", "future_min_close_H3m", "z_imbalance",
        ]
        results.append([r.z_imbalance for r in df.collect()])
        assert os.path.exists(f"{out}.meta.json")
    assert results[0][:5] == results[1][:5]
    assert all(math.isfinite(z) for z in results[0] + results[1])
    assert results[0][:2] == [0.0, 0.0]
    assert results[0][2] == pytest.approx((1.4 - 1.1) / (0.1 + 1e-12))


def test_grouped_scores_write_their_sidecar(spark, tmp_path):
    _z_input(spark, f"{tmp_path}/in", [1.0, 1.2, 1.4, 1.6, 2.0, 2.5])
    config = jobs.ZScoreConfig(f"{tmp_path}/in", f"{tmp_path}/z.parquet", min_periods=2, **DAY)
    df = jobs.build_features_zscore_1m(spark, config)
    assert df.columns == [
        "symbol", "open_time", "y_dd_30p_H3m", "dd_min_H3m", "future_min_close_H3m", "z_imbalance",
    ]
    meta = json.load(open(f"{tmp_path}/z.meta.json"))
    assert meta["defaulted_rows_per_z_feature"] == {"z_imbalance": 2}
    assert meta["window"] is None
