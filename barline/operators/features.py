"""Backward-looking bar features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import MINUTE_MS, div, finite, ratio
from .bars import TRADE_AGG_COLUMNS
from .ordered import ROWS_PER_CHUNK, mean_of, rolling_moments, std_of, with_halo, without_halo

EPS = 1e-12
SHORT, MEDIUM, LONG = 5, 30, 240

GRID_COLUMNS = ("symbol", "open_time", "open", "high", "low", "close", "volume")
DERIVED_COLUMNS = (
    "ret_1m",
    "rv_5m",
    "rv_30m",
    "rv_4h",
    "spread_proxy",
    "imbalance",
    "buyer_aggressor_ratio",
    "vol_z_30m",
    "peak_close_4h",
    "drawdown_4h",
)
FEATURE_COLUMNS = (*GRID_COLUMNS, *TRADE_AGG_COLUMNS, *DERIVED_COLUMNS)


def row_features() -> dict:
    """Features of a row on its own."""
    buy, sell = F.col("buy_vol"), F.col("sell_vol")
    return {
        "spread_proxy": ratio(F.col("high") - F.col("low"), F.col("close")),
        "imbalance": (buy - sell) / (buy + sell + EPS),
        "buyer_aggressor_ratio": buy / (F.col("trade_vol") + EPS),
    }


def bar_features(
    joined: DataFrame, step_ms: int = MINUTE_MS, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """All features of a strict grid that carries its trade aggregates.

    On a strict grid the bar number is ``open_time / step``, so chunks and their
    halo need no counting pass: one shuffle by symbol and chunk serves every
    window, and frames stay row-based as they are defined.
    """
    # one more row than the longest frame: its first return needs a predecessor
    work = with_halo(
        joined.withColumn("_bar", div("open_time", step_ms)),
        "_bar",
        back=LONG,
        size=rows_per_chunk,
    )
    keys = ["symbol", "_chunk"]
    walk = Window.partitionBy(*keys).orderBy("_bar")
    log_close = finite(F.ln("close"))
    work = work.withColumn("ret_1m", log_close - F.lag(log_close).over(walk))

    def frame(width: int):
        return walk.rowsBetween(-(width - 1), 0)

    def full(column: str, width: int, value):
        return F.when(F.count(column).over(frame(width)) >= width, value)

    ret, vol = "ret_1m", "trade_dollar_vol"
    work = rolling_moments(work, {ret: "_long", "close": "_peak"}, ["symbol"], "_bar", LONG)
    work = rolling_moments(work, {vol: "_vol"}, ["symbol"], "_bar", MEDIUM)
    work = work.withColumns(
        {
            "rv_5m": full(ret, SHORT, F.stddev_pop(ret).over(frame(SHORT))),
            "rv_30m": full(ret, MEDIUM, F.stddev_pop(ret).over(frame(MEDIUM))),
        }
    )
    peak = F.col("_peak_hi")
    work = work.withColumns(
        {
            "rv_4h": F.when(F.col("_long_n") >= LONG, F.expr(std_of("_long"))),
            "vol_z_30m": F.when(
                F.col("_vol_n") >= MEDIUM,
                (F.col(vol) - F.expr(mean_of("_vol"))) / (F.expr(std_of("_vol")) + EPS),
            ),
            "peak_close_4h": peak,
            "drawdown_4h": ratio(F.col("close"), peak) - 1.0,
            **row_features(),
        }
    )
    return without_halo(work).select(*FEATURE_COLUMNS)
