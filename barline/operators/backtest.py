"""Positions against realised directions: PnL, equity, drawdown, metrics, threshold search."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import chunked, even_span, with_previous, with_running_total
from .signals import positions, threshold_signal

METRICS = (
    "total_pnl",
    "mean_pnl",
    "std_pnl",
    "sharpe_per_step",
    "max_drawdown",
    "win_rate_exposed",
    "avg_trade_return",
    "num_trades",
)


def _step_pnl(position: Column, previous: Column, direction: Column, cost: float) -> dict:
    size = F.abs(position - previous)
    return {
        "trade_size": size,
        "trade": (size > 0).cast("int"),
        "pnl": position * direction - F.lit(float(cost)) * size,
    }


def backtest(
    df: DataFrame,
    cost: float = 0.01,
    series: Sequence[str] = (),
    order: Sequence[str] = ("row_id",),
    span: int | None = None,
) -> DataFrame:
    """The PnL table of a ``signal`` and a ``realized_direction``, both in {-1, 0, 1}.

    Adds position, trade size and flag, PnL, equity, its running peak, drawdown.
    Without a ``span`` a small job measures how far apart the keys lie.
    """
    span = span or even_span(df, order[0])
    table = positions(chunked(df, order, span), "signal", series, order, span)
    table = table.withColumns(
        _step_pnl(
            F.col("position"), F.col("previous_position"), F.col("realized_direction"), cost
        )
    ).drop("previous_position")
    table = with_running_total(table, "pnl", "equity", series, order, span, peak="peak")
    return table.withColumn("drawdown", F.col("equity") - F.col("peak")).drop("_chunk")


def domain_violations(table: DataFrame) -> DataFrame:
    """Rows that break the value rules of a PnL table; all counts should be 0."""

    def outside(c: str) -> Column:
        return F.count_if(~F.coalesce(F.col(c).isin(-1, 0, 1), F.lit(False)))

    missing = [F.col(c).isNull() for c in ("position", "realized_direction", "pnl", "equity")]
    return table.agg(
        outside("signal").alias("bad_signal"),
        outside("position").alias("bad_position"),
        outside("realized_direction").alias("bad_direction"),
        F.count_if(missing[0] | missing[1] | missing[2] | missing[3]).alias("missing_key"),
        F.count_if((F.col("trade") == 1) != (F.col("trade_size") > 0)).alias("bad_trade_flag"),
    )


def _sharpe(mean: Column, std: Column, annualization: float | None) -> Column:
    scale = math.sqrt(annualization) if annualization and annualization > 0 else 1.0
    return F.when(std == 0, F.lit(0.0)).otherwise(mean / std * F.lit(scale))


def _summaries() -> list[Column]:
    exposed = F.col("position") != 0
    return [
        F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("mean_pnl"),
        F.stddev_pop("pnl").alias("std_pnl"),
        F.count_if(exposed).alias("_exposed"),
        F.count_if(exposed & (F.col("pnl") > 0)).alias("_wins"),
        F.sum("trade").alias("num_trades"),
    ]


def _finished(annualization: float | None) -> dict[str, Column]:
    return {
        "sharpe_per_step": _sharpe(F.col("mean_pnl"), F.col("std_pnl"), annualization),
        "win_rate_exposed": F.coalesce(F.try_divide("_wins", "_exposed"), F.lit(0.0)),
        "avg_trade_return": F.coalesce(F.try_divide("total_pnl", "num_trades"), F.lit(0.0)),
    }


def strategy_metrics(
    table: DataFrame, series: Sequence[str] = (), annualization: float | None = None
) -> DataFrame:
    """One row of metrics per series, in a single aggregation of the PnL table."""
    rows = table.groupBy(*series).agg(*_summaries(), F.min("drawdown").alias("max_drawdown"))
    return rows.withColumns(_finished(annualization)).select(*series, *METRICS)


def threshold_sensitivity(
    scored: DataFrame,
    thresholds: Sequence[float],
    cost: float = 0.01,
    annualization: float | None = None,
    order: Sequence[str] = ("row_id",),
    span: int | None = None,
) -> DataFrame:
    """Metrics of every threshold of the grid, all but the drawdown, in one pass.

    A row's position follows from the previous score, whatever the threshold, so
    the scores are lagged once and the copies per threshold meet a partial
    aggregation before any shuffle.
    """
    grid = F.array(
        *[F.struct(F.lit(k).alias("place"), F.lit(t).alias("threshold")) for k, t in enumerate(thresholds)]
    )
    span = span or even_span(scored, order[0])
    lagged = with_previous(scored, "score", ["_score1", "_score2"], [], order, span)
    tried = lagged.select(
        "realized_direction", "_score1", "_score2", F.inline(grid)
    )
    tried = tried.select(
        "place",
        "threshold",
        "realized_direction",
        threshold_signal("_score1", F.col("threshold")).alias("position"),
        threshold_signal("_score2", F.col("threshold")).alias("_previous"),
    ).withColumns(
        _step_pnl(F.col("position"), F.col("_previous"), F.col("realized_direction"), cost)
    )
    rows = tried.groupBy("place", "threshold").agg(*_summaries())
    return rows.withColumns(_finished(annualization)).drop("_exposed", "_wins")


def best_threshold(sensitivity: DataFrame) -> DataFrame:
    """The row with the largest Sharpe ratio, the earliest of the grid on ties."""
    columns = [c for c in sensitivity.columns if c != "place"]
    preferred = F.struct("sharpe_per_step", -F.col("place"))
    return sensitivity.agg(F.max_by(F.struct(*columns), preferred).alias("best")).select("best.*")
