"""Trades to bars, and checks of the bar grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import MINUTE_MS, finite, minute_floor
from .ordered import ROWS_PER_CHUNK, with_previous

TRADE_AGG_COLUMNS = ("trade_vol", "trade_dollar_vol", "n_trades", "buy_vol", "sell_vol")


def side_columns(price: str = "price", qty: str = "qty") -> dict[str, Column]:
    """Notional and quantity by aggressor: a maker on the buy side means a sell."""
    maker = F.col("isBuyerMaker")
    return {
        "dollar": F.col(price) * F.col(qty),
        "buy_qty": F.when(~maker, F.col(qty)).otherwise(0.0),
        "sell_qty": F.when(maker, F.col(qty)).otherwise(0.0),
    }


def bar_aggregates() -> list[Column]:
    return [
        F.sum("qty").alias("trade_vol"),
        F.sum("dollar").alias("trade_dollar_vol"),
        F.count(F.lit(1)).alias("n_trades"),
        F.sum("buy_qty").alias("buy_vol"),
        F.sum("sell_qty").alias("sell_vol"),
    ]


def usable_trades(trades: DataFrame) -> DataFrame:
    """Trades with a time, a side and finite price and quantity."""
    return trades.withColumns(
        {"price": finite("price"), "qty": finite("qty")}
    ).na.drop(subset=["time", "price", "qty", "isBuyerMaker"])


def trade_bars(
    trades: DataFrame, step_ms: int = MINUTE_MS, bounds_ms: tuple[int, int] | None = None
) -> DataFrame:
    """One row per symbol and bar with at least one trade.

    The bounds filter stays on the plain ``time`` column, so it reaches the scan,
    and the aggregation is partial before its only shuffle.
    """
    if bounds_ms:
        trades = trades.where(F.col("time").between(*bounds_ms))
    return (
        usable_trades(trades)
        .withColumns(side_columns())
        .groupBy("symbol", minute_floor("time", step_ms).alias("open_time"))
        .agg(*bar_aggregates())
    )


def join_bars(grid: DataFrame, bars: DataFrame) -> DataFrame:
    """Grid rows with their trade aggregates, 0 where there was no trade."""
    columns = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in TRADE_AGG_COLUMNS]
    return grid.join(bars, ["symbol", "open_time"], "left").select(*grid.columns, *columns)


def grid_violations(
    grid: DataFrame, step_ms: int = MINUTE_MS, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Rows that do not follow their predecessor by exactly one step."""
    walked = with_previous(
        grid.select("symbol", "open_time"),
        "open_time",
        ["previous_open_time"],
        ["symbol"],
        ["open_time"],
        rows_per_chunk * step_ms,
    )
    return walked.where(F.col("open_time") - F.col("previous_open_time") != step_ms).select(
        "symbol", "previous_open_time", "open_time"
    )


def check_grid(grid: DataFrame, step_ms: int = MINUTE_MS) -> None:
    """Raise on the first violation; costs one aggregation when there is none."""
    spread = F.max("open_time") - F.min("open_time")
    uneven = (
        grid.groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            spread.alias("spread"),
            F.max(F.pmod("open_time", F.lit(step_ms))).alias("most"),
            F.min(F.pmod("open_time", F.lit(step_ms))).alias("least"),
        )
        .where((F.col("spread") != (F.col("rows") - 1) * step_ms) | (F.col("most") != F.col("least")))
    )
    if uneven.isEmpty():
        return
    bad = grid_violations(grid, step_ms).orderBy("symbol", "open_time").first()
    raise ValueError(
        f"open_time of {bad.symbol} is no strict {step_ms} ms grid; first violation "
        f"between {bad.previous_open_time} and {bad.open_time}"
    )
