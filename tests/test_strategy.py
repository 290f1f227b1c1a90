from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import backtest as bt
from barline.operators import evaluate, signals
from barline.plans import jobs
from barline.sources import tables


def _brute(signal, direction, cost):
    position = [0, *signal[:-1]]
    before = [0, *position[:-1]]
    pnl = [p * d - cost * abs(p - b) for p, d, b in zip(position, direction, before)]
    equity = np.cumsum(pnl)
    return position, pnl, equity, equity - np.maximum.accumulate(equity)


@pytest.mark.parametrize("span", [1, 3, 64, 10_000])
def test_backtest_against_a_loop(spark, span):
    rng = np.random.default_rng(3)
    n = 200
    signal, direction = rng.integers(-1, 2, n).tolist(), rng.integers(-1, 2, n).tolist()
    keys = np.cumsum(rng.integers(1, 4, n)).tolist()
    df = spark.createDataFrame(
        list(zip(keys, signal, direction)), "row_id bigint, signal int, realized_direction int"
    ).repartition(4)
    table = bt.backtest(df, 0.01, span=span)
    rows = table.orderBy("row_id").collect()
    position, pnl, equity, drawdown = _brute(signal, direction, 0.01)
    assert [r.position for r in rows] == position
    np.testing.assert_allclose([r.pnl for r in rows], pnl, atol=1e-12)
    np.testing.assert_allclose([r.equity for r in rows], equity, atol=1e-9)
    np.testing.assert_allclose([r.drawdown for r in rows], drawdown, atol=1e-9)
    assert not any(bt.domain_violations(table).first())

    m = bt.strategy_metrics(table, annualization=4.0).first()
    exposed = [x for x, p in zip(pnl, position) if p]
    assert m.num_trades == sum(a != b for a, b in zip(position, [0, *position[:-1]]))
    assert m.sharpe_per_step == pytest.approx(2 * np.mean(pnl) / np.std(pnl))
    assert m.max_drawdown == pytest.approx(drawdown.min())
    assert m.win_rate_exposed == pytest.approx(sum(x > 0 for x in exposed) / len(exposed))
    assert m.avg_trade_return == pytest.approx(sum(pnl) / m.num_trades)


def test_many_series_at_once(spark):
    rows = [(s, i, (i + s) % 3 - 1, 1) for s in (0, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "s int, row_id bigint, signal int, realized_direction int")
    table = bt.backtest(df, 0.0, series=["s"], span=4)
    got = {r.s: r.total_pnl for r in bt.strategy_metrics(table, ["s"]).collect()}
    for s in (0, 1):
        signal = [(i + s) % 3 - 1 for i in range(20)]
        assert got[s] == pytest.approx(sum(_brute(signal, [1] * 20, 0.0)[1]))


def test_flat_strategy_has_zero_metrics(spark):
    df = spark.createDataFrame([(i, 0, 1) for i in range(5)], "row_id bigint, signal int, realized_direction int")
    m = bt.strategy_metrics(bt.backtest(df)).first()
    assert (m.total_pnl, m.sharpe_per_step, m.win_rate_exposed, m.avg_trade_return, m.num_trades) == (0, 0, 0, 0, 0)


def test_unknown_class_fails(spark):
    for bad in (4, None):
        df = spark.createDataFrame([(1,), (bad,)], "c int")
        with pytest.raises(Exception, match="unexpected class"):
            df.select(signals.class_direction("c")).collect()
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "c double")
    assert [r[0] for r in df.select(signals.class_direction("c")).collect()] == [-1, 0, 1]


def test_thresholds_are_strict_and_missing_scores_flat(spark):
    df = spark.createDataFrame([(0.2,), (-0.2,), (0.21,), (-0.21,), (None,)], "score double")
    got = [r[0] for r in df.select(signals.threshold_signal("score", 0.2)).collect()]
    assert got == [0, 0, 1, -1, 0]


def test_search_equals_single_backtests_and_first_of_ties_wins(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(s), int(d)) for i, (s, d) in enumerate(zip(rng.normal(size=300), rng.integers(-1, 2, 300)))]
    df = spark.createDataFrame(rows, "row_id bigint, score double, realized_direction int").repartition(3)
    grid = [0.5, 0.0, 0.5, 50.0, 60.0]
    found = bt.threshold_sensitivity(df, grid, 0.01, span=32)
    for r in found.collect():
        single = df.withColumn("signal", signals.threshold_signal("score", grid[r.place]))
        m = bt.strategy_metrics(bt.backtest(single)).first()
        for c in ("total_pnl", "sharpe_per_step", "num_trades", "win_rate_exposed"):
            assert r[c] == pytest.approx(m[c])
    flat = found.where("place >= 3")
    assert bt.best_threshold(flat).first().threshold == 50.0


def test_correlations_of_constant_and_missing_values(spark):
    rng = np.random.default_rng(1)
    x, t = rng.normal(size=50), rng.integers(-1, 2, 50)
    rows = [(float(a), 2.0, float(a) if i % 3 else float("nan"), int(d)) for i, (a, d) in enumerate(zip(x, t))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int")
    got = {r.feature: r["corr"] for r in signals.feature_correlations(df, ["a", "b", "c"], "d").collect()}
    assert got["a"] == pytest.approx(np.corrcoef(x, t)[0, 1])
    assert got["b"] == 0.0
    part = np.arange(50) % 3 > 0
    cov = ((x[part] - x[part].mean()) * (t[part] - t.mean())).mean()
    assert got["c"] == pytest.approx(cov / (x[part].std() * t.std()))
    top = signals.top_features(signals.feature_correlations(df, ["b", "a"], "d"), 1).first()
    assert top.feature == "a"
    flat = signals.feature_correlations(df.withColumn("d", F.lit(1)), ["a"], "d").first()
    assert flat["corr"] == 0.0


def test_standardize_and_feature_stats(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = signals.standardize(df, ["a", "b"]).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]
    stats = signals.feature_stats(df, ["a", "b"]).first()
    assert tuple(stats) == (3.5, 0.5)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 4)], "v double")
    got = [r.n_rows for r in evaluate.histogram(df, "v", 4).orderBy("bin").collect()]
    assert got == np.histogram([0, 1, 2, 3, 4, 4], 4)[0].tolist()
    one = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    rows = evaluate.histogram(one, "v", 4).orderBy("bin").collect()
    assert [r.n_rows for r in rows] == np.histogram([2.0, 2.0], 4)[0].tolist()
    assert (rows[0].bin_low, rows[-1].bin_high) == (1.5, 2.5)


def test_full_experiment_from_csv(spark, tmp_path):
    rng = np.random.default_rng(11)
    names = [str(k) for k in range(149)]

    def write(path, n):
        x = rng.normal(size=(n, 144)).round(4)
        y = np.where(x[:, 3] > 0.4, 3, np.where(x[:, 3] < -0.4, 1, 2))
        with open(path, "w") as f:
            f.write("," + ",".join(names) + "\n")
            for i in range(n):
                f.write(",".join([str(i), *map(str, x[i]), *[f"{float(y[i])}"] * 5]) + "\n")
        return x, y

    x, y = write(f"{tmp_path}/train.csv", 300)
    write(f"{tmp_path}/test.csv", 100)
    config = jobs.ExperimentConfig(thresholds=(0.0, 0.2, 5.0), top_k=3, standardize=True)
    report = jobs.run_experiment(spark, f"{tmp_path}/train.csv", f"{tmp_path}/test.csv", f"{tmp_path}/out", config)
    direction = (y - 2).tolist()
    _, pnl, _, drawdown = _brute(direction, direction, 0.01)
    assert report["oracle_train"]["total_pnl"] == pytest.approx(sum(pnl))
    assert report["oracle_train"]["max_drawdown"] == pytest.approx(drawdown.min())
    assert report["rule"]["selected_features"][0] == "3"
    assert len(report["rule"]["threshold_sensitivity"]) == 3
    assert report["rule"]["selected_threshold"] in (0.0, 0.2, 5.0)
    assert report["train_features"]["std_avg"] == pytest.approx(1.0)
    saved = json.load(open(f"{tmp_path}/out/report.json"))
    assert saved["rule"]["test_metrics"]["num_trades"] == report["rule"]["test_metrics"]["num_trades"]
    assert spark.read.parquet(f"{tmp_path}/out/rule_test").count() == 100

    wide = tables.read_wide_csv(spark, f"{tmp_path}/train.csv")
    features, labels = tables.split_features_labels(wide)
    assert len(features.columns) == 145 and len(labels.columns) == 6
    with pytest.raises(ValueError):
        tables.split_features_labels(wide.drop("7"))
    assert math.isclose(features.orderBy("row_id").first()["0"], x[0, 0])
