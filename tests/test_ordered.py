"""Chunked scans against the same thing computed plainly in pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import ordered
from barline.operators.labels import drawdown_labels
from barline.operators.sliding import previous_moments
from barline.operators.zscore import causal_z

ROWS = 700


@pytest.fixture(scope="module")
def data():
    """Two series, one of them with three quarters of the rows, gaps in the key, missing values."""
    rng = np.random.default_rng(7)
    long, short = ROWS * 3 // 4, ROWS // 4
    keys = [np.cumsum(rng.choice([1, 1, 1, 5, 60], n)) for n in (long, short)]
    df = pd.DataFrame(
        {
            "symbol": ["hot"] * long + ["cold"] * short,
            "k": np.concatenate(keys),
            "x": np.round(rng.normal(size=long + short), 2),
        }
    )
    df.loc[rng.random(len(df)) < 0.1, "x"] = np.nan
    df.loc[100:160, "x"] = 3.3
    df.loc[df.index[-1], "x"] = 1.0
    return df


def _spark(spark, data):
    return spark.createDataFrame(data.astype({"x": object}).where(data.notna(), None), "symbol string, k bigint, x double").repartition(5)


def _pandas(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


@pytest.mark.parametrize("span", [1, 17, 10_000])
def test_row_index(spark, data, span):
    out = _pandas(ordered.with_row_index(_spark(spark, data), ["symbol"], ["k"], span), "symbol", "k")
    assert (out["row_index"] == out.groupby("symbol").cumcount()).all()
    assert len(out) == len(data)


@pytest.mark.parametrize("span", [1, 17, 10_000])
def test_previous(spark, data, span):
    df = ordered.with_previous(_spark(spark, data), "x", ["a", "b"], ["symbol"], ["k"], span)
    out = _pandas(df, "symbol", "k")
    shifted = out.groupby("symbol")["x"]
    pd.testing.assert_series_equal(out["a"], shifted.shift(1), check_names=False)
    pd.testing.assert_series_equal(out["b"], shifted.shift(2), check_names=False)


@pytest.mark.parametrize("span", [1, 17, 10_000])
def test_running_total_and_peak(spark, data, span):
    df = _spark(spark, data).withColumn("x", F.coalesce("x", F.lit(0.0)))
    out = _pandas(ordered.with_running_total(df, "x", "t", ["symbol"], ["k"], span, peak="p"), "symbol", "k")
    total = out.groupby("symbol")["x"].cumsum()
    np.testing.assert_allclose(out["t"], total, atol=1e-9)
    np.testing.assert_allclose(out["p"], total.groupby(out["symbol"]).cummax(), atol=1e-9)


def test_running_total_without_series(spark, data):
    df = _spark(spark, data[data["symbol"] == "hot"]).withColumn("x", F.lit(1.0))
    out = _pandas(ordered.with_running_total(df, "x", "t", [], ["k"], 13), "k")
    assert list(out["t"]) == list(range(1, len(out) + 1))


@pytest.mark.parametrize("width,size", [(5, 50), (80, 100), (80, 80), (80, 100_000), (600, 50)])
def test_rolling_moments(spark, data, width, size):
    df = ordered.with_row_index(_spark(spark, data), ["symbol"], ["k"], 40)
    work = ordered.with_halo(df, "row_index", back=width - 1, size=size)
    work = ordered.rolling_moments(work, {"x": "m"}, ["symbol"], "row_index", width)
    work = work.selectExpr("*", f"{ordered.mean_of('m')} AS mean", f"{ordered.std_of('m')} AS std")
    out = _pandas(ordered.without_halo(work), "symbol", "k")
    assert len(out) == len(data)
    for c, expected in _rolling(out, width).items():
        np.testing.assert_allclose(out[c].astype(float), expected, atol=1e-9)
    assert (out.loc[out["m_lo"] == out["m_hi"], "std"] == 0).all()


def _rolling(out, width):
    windows = out.groupby("symbol")["x"].rolling(width, min_periods=1)
    plain = {"m_n": windows.count(), "mean": windows.mean(), "std": windows.std(ddof=0), "m_hi": windows.max()}
    order = out.groupby("symbol", sort=True).indices
    position = np.concatenate([order[s] for s in sorted(order)])
    return {c: pd.Series(v.to_numpy(), index=position).sort_index().to_numpy() for c, v in plain.items()}


@pytest.mark.parametrize("span", [1, 29, 10_000])
def test_expanding_moments(spark, data, span):
    df = ordered.expanding_moments(_spark(spark, data), {"x": "m"}, ["symbol"], ["k"], span)
    df = df.selectExpr("*", f"{ordered.mean_of('m')} AS mean", f"{ordered.std_of('m')} AS std")
    out = _pandas(df, "symbol", "k")
    grouped = out.groupby("symbol")["x"]
    assert (out["_seen"] == out.groupby("symbol").cumcount()).all()
    mean = grouped.transform(lambda s: s.expanding(1).mean().shift(1))
    std = grouped.transform(lambda s: s.expanding(1).std(ddof=0).shift(1))
    np.testing.assert_allclose(out["mean"].astype(float), mean, atol=1e-9)
    np.testing.assert_allclose(out["std"].astype(float), std, atol=1e-7)


@pytest.mark.parametrize("width", [1, 2, 7, 64, 1000])
def test_sliding_kernel(data, width):
    values = data[["x"]].assign(y=5.1, z=np.nan).to_numpy()
    n, mean, std = previous_moments(values, width)
    for i in range(len(values)):
        window = values[max(0, i - width) : i]
        known = np.isfinite(window).sum(axis=0)
        assert (n[i] == known).all()
        for c in range(2):
            part = window[np.isfinite(window[:, c]), c]
            if len(part):
                assert mean[i, c] == pytest.approx(part.mean(), abs=1e-12)
                assert std[i, c] == pytest.approx(part.std(), abs=1e-9)
    assert (std[1:, 1] == 0).all() and (mean[1:, 1] == 5.1).all()


@pytest.mark.parametrize("mode", ["expanding", "rolling"])
def test_scores_do_not_depend_on_chunks(spark, data, mode):
    df = _spark(spark, data).withColumnRenamed("k", "open_time")
    kept = []
    for size in (40, 10_000):
        options = dict(mode=mode, window=30, min_periods=5, step_ms=1, rows_per_chunk=size)
        out = _pandas(causal_z(df, ["x"], **options), "symbol", "open_time")
        kept.append(out)
        assert len(out) == len(data)
    np.testing.assert_allclose(kept[0]["z_x"], kept[1]["z_x"], rtol=1e-7, atol=1e-7)
    assert (kept[0]["defaulted_x"] == kept[1]["defaulted_x"]).all()


def test_flat_history_scores_zero(spark):
    """Equal values must not turn rounding into a score, whatever their size."""
    rows = [("s", i, 60_000.1) for i in range(50)]
    df = spark.createDataFrame(rows, "symbol string, open_time bigint, x double")
    for mode in ("expanding", "rolling"):
        out = causal_z(df, ["x"], mode=mode, window=20, min_periods=2, step_ms=1, rows_per_chunk=7)
        assert {r.z_x for r in out.collect()} == {0.0}


@pytest.mark.parametrize("horizon,size", [(3, 10), (100, 50), (100, 10_000)])
def test_forward_minimum(spark, data, horizon, size):
    df = _spark(spark, data).where("x IS NOT NULL").select(
        "symbol", F.col("k").alias("open_time"), (F.col("x") + 10).alias("close")
    )
    labels = drawdown_labels(df, [horizon], [0.1], step_ms=1, rows_per_chunk=size)
    out = _pandas(labels, "symbol", "open_time")

    def ahead(close):
        values = close.to_numpy()
        return pd.Series(
            [values[i + 1 : i + 1 + horizon].min() if i + horizon < len(values) else np.nan for i in range(len(values))],
            index=close.index,
        )

    expected = out.groupby("symbol")["close"].transform(ahead)
    np.testing.assert_allclose(out[f"future_min_close_H{horizon}m"].astype(float), expected)


@pytest.mark.parametrize("rows_per_chunk", [3, 10_000])
def test_quantiles_of_ranked_values(spark, data, rows_per_chunk):
    counts = _spark(spark, data).where("x IS NOT NULL").groupBy("symbol", "x").agg(F.count(F.lit(1)).alias("rows"))
    ranked = ordered.with_sums_below(counts, ["symbol"], "x", ["rows"], rows_per_chunk)
    totals = counts.groupBy("symbol").agg(F.sum("rows").alias("_n"))
    found = ordered.quantiles(ranked.join(totals, "symbol"), ["symbol"], "x", "rows", [0, 0.1, 0.5, 0.77, 1])
    for row in found.collect():
        values = data.loc[data["symbol"] == row.symbol, "x"].dropna()
        np.testing.assert_allclose(row.quantiles, np.quantile(values, [0, 0.1, 0.5, 0.77, 1]))


@pytest.mark.parametrize("mode", ["expanding", "rolling"])
def test_pooled_scores_cut_chunks_by_rows(spark, data, mode):
    """All symbols in one series, many rows per time."""
    df = _spark(spark, data).withColumn("open_time", F.floor(F.col("k") / 50))
    df = df.withColumn("tie", F.concat("symbol", F.lpad(F.col("k").cast("string"), 9, "0")))
    kept = []
    for size in (40, 10_000):
        options = dict(mode=mode, window=30, min_periods=5, step_ms=1, rows_per_chunk=size)
        z = causal_z(df, ["x"], by_symbol=False, order=["open_time", "tie"], **options)
        kept.append(_pandas(z, "open_time", "tie"))
    assert len(kept[0]) == len(data)
    np.testing.assert_allclose(kept[0]["z_x"], kept[1]["z_x"], rtol=1e-7, atol=1e-7)
    x = kept[0]["x"]
    history = x.expanding(5) if mode == "expanding" else x.rolling(30, min_periods=5)
    z = ((x - history.mean().shift(1)) / (history.std(ddof=0).shift(1) + 1e-12)).fillna(0.0)
    moving = history.std(ddof=0).shift(1) > 1e-3
    np.testing.assert_allclose(kept[0].loc[moving, "z_x"], z[moving], rtol=1e-6, atol=1e-6)
