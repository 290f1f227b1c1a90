"""DuckDB texts for the stand-in views that many registered queries share."""

from __future__ import annotations

from collections.abc import Sequence

MINUTE, HOUR = 60_000, 3_600_000


def rounded(columns: Sequence[str], digits: int = 6) -> str:
    """Rounded columns; adding 0 turns a negative zero into zero."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)



TRADES = """
trades AS (
  SELECT event_type AS symbol, event_id AS trade_id, epoch_us(ts) // 1000 AS time, value + 1 AS price,
         CAST(event_id % 7 + 1 AS DOUBLE) AS qty, event_id % 2 = 1 AS isBuyerMaker
  FROM events)"""


def bars(step: int) -> str:
    return f"""{TRADES},
bars AS (
  SELECT symbol, time // {step} * {step} AS open_time,
         sum(qty) AS trade_vol, sum(price * qty) AS trade_dollar_vol, count(*) AS n_trades,
         sum(CASE WHEN NOT isBuyerMaker THEN qty ELSE 0 END) AS buy_vol,
         sum(CASE WHEN isBuyerMaker THEN qty ELSE 0 END) AS sell_vol
  FROM trades GROUP BY ALL)"""


def grid(step: int) -> str:
    return f"""{bars(step)},
candles AS (
  SELECT symbol, time // {step} * {step} AS open_time,
         arg_min(price, struct_pack(t := time, i := trade_id)) AS open,
         max(price) AS high, min(price) AS low,
         arg_max(price, struct_pack(t := time, i := trade_id)) AS close, sum(qty) AS volume
  FROM trades GROUP BY ALL),
spans AS (
  SELECT *, coalesce(lead(open_time) OVER (PARTITION BY symbol ORDER BY open_time) - {step},
                     open_time) AS until
  FROM candles),
grid AS (
  SELECT symbol, t AS open_time,
         CASE WHEN t = open_time THEN open ELSE close END AS open,
         CASE WHEN t = open_time THEN high ELSE close END AS high,
         CASE WHEN t = open_time THEN low ELSE close END AS low,
         close, CASE WHEN t = open_time THEN volume ELSE 0 END AS volume
  FROM spans, unnest(range(open_time, until + 1, {step})) AS u(t))"""


def features(step: int) -> str:
    return f"""{grid(step)},
joined AS (
  SELECT g.*, coalesce(trade_vol, 0) AS trade_vol, coalesce(trade_dollar_vol, 0) AS trade_dollar_vol,
         coalesce(n_trades, 0) AS n_trades, coalesce(buy_vol, 0) AS buy_vol,
         coalesce(sell_vol, 0) AS sell_vol
  FROM grid g LEFT JOIN bars b USING (symbol, open_time)),
returns AS (
  SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY open_time) AS ret_1m
  FROM joined),
features AS (
  SELECT symbol, open_time, open, high, low, close, volume,
         trade_vol, trade_dollar_vol, n_trades, buy_vol, sell_vol, ret_1m,
         CASE WHEN count(ret_1m) OVER w5 >= 5 THEN stddev_pop(ret_1m) OVER w5 END AS rv_5m,
         CASE WHEN count(ret_1m) OVER w30 >= 30 THEN stddev_pop(ret_1m) OVER w30 END AS rv_30m,
         CASE WHEN count(ret_1m) OVER w240 >= 240 THEN stddev_pop(ret_1m) OVER w240 END AS rv_4h,
         (high - low) / nullif(close, 0) AS spread_proxy,
         (buy_vol - sell_vol) / (buy_vol + sell_vol + 1e-12) AS imbalance,
         buy_vol / (trade_vol + 1e-12) AS buyer_aggressor_ratio,
         CASE WHEN count(*) OVER w30 < 30 THEN NULL
              WHEN min(trade_dollar_vol) OVER w30 = max(trade_dollar_vol) OVER w30 THEN 0
              ELSE (trade_dollar_vol - avg(trade_dollar_vol) OVER w30)
                   / (stddev_pop(trade_dollar_vol) OVER w30 + 1e-12) END AS vol_z_30m,
         max(close) OVER w240 AS peak_close_4h,
         close / max(close) OVER w240 - 1 AS drawdown_4h
  FROM returns
  WINDOW w5 AS (PARTITION BY symbol ORDER BY open_time ROWS 4 PRECEDING),
         w30 AS (PARTITION BY symbol ORDER BY open_time ROWS 29 PRECEDING),
         w240 AS (PARTITION BY symbol ORDER BY open_time ROWS 239 PRECEDING))"""


def drawdowns(source: str, horizons: Sequence[int], thresholds: Sequence[float]) -> str:
    """A ``labelled`` view over ``source`` with future minimum, drawdown and labels."""
    windows, lows, falls, flags = [], [], [], []
    for h in horizons:
        low, fall = f"future_min_close_H{h}m", f"dd_min_H{h}m"
        windows.append(
            f"f{h} AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        )
        lows.append(f"CASE WHEN count(close) OVER f{h} >= {h} THEN min(close) OVER f{h} END AS {low}")
        falls.append(f"{low} / close - 1 AS {fall}")
        for t in thresholds:
            flags.append(
                f"CASE WHEN {fall} IS NOT NULL THEN CAST({fall} <= -CAST({t} AS DOUBLE) AS DOUBLE) END"
                f" AS y_dd_{round(t * 100)}p_H{h}m"
            )
    return f"""
lows AS (SELECT *, {", ".join(lows)} FROM {source} WINDOW {", ".join(windows)}),
falls AS (SELECT *, {", ".join(falls)} FROM lows),
labelled AS (SELECT *, {", ".join(flags)} FROM falls)"""


def z_column(column: str, frame: str, history: str, min_periods: int, eps: float = 1e-12) -> str:
    """A causal z-score over a named window of earlier rows."""
    c = f"CAST({column} AS DOUBLE)"
    return f"""CASE WHEN {column} IS NULL OR {history} < {min_periods}
       OR count({column}) OVER {frame} < {min_periods} THEN 0.0
     WHEN min({c}) OVER {frame} = max({c}) OVER {frame}
       THEN ({c} - min({c}) OVER {frame}) / (0 + CAST({eps} AS DOUBLE))
     ELSE ({c} - avg({c}) OVER {frame}) / (stddev_pop({c}) OVER {frame} + CAST({eps} AS DOUBLE))
     END AS z_{column}"""


ROWS = """
labelled_rows AS (
  SELECT o_orderkey AS row_id,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS class,
         (o_totalprice - 250000) / 250000 AS score
  FROM orders)"""


def pnl_table(signal: str, source: str = "labelled_rows") -> str:
    """A ``pnl_table`` view over a source with ``row_id`` and ``class``."""
    return f"""
signals AS (SELECT row_id, {signal} AS signal, class - 2 AS realized_direction FROM {source}),
held AS (
  SELECT *, coalesce(lag(signal) OVER (ORDER BY row_id), 0) AS position,
         coalesce(lag(signal, 2) OVER (ORDER BY row_id), 0) AS previous
  FROM signals),
steps AS (
  SELECT *, abs(position - previous) AS trade_size,
         CAST(position <> previous AS INTEGER) AS trade,
         position * realized_direction - CAST(0.01 AS DOUBLE) * abs(position - previous) AS pnl
  FROM held),
curves AS (SELECT *, sum(pnl) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS equity FROM steps),
pnl_table AS (
  SELECT *, max(equity) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS peak,
         equity - max(equity) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS drawdown
  FROM curves)"""


def summary(group: str = "") -> str:
    """Metrics of PnL rows, to stand after SELECT."""
    return f"""{group} sum(pnl) AS total_pnl, avg(pnl) AS mean_pnl, stddev_pop(pnl) AS std_pnl,
       CASE WHEN stddev_pop(pnl) = 0 THEN 0 ELSE avg(pnl) / stddev_pop(pnl) END AS sharpe_per_step,
       coalesce(count(*) FILTER (position <> 0 AND pnl > 0)
                / nullif(count(*) FILTER (position <> 0), 0), 0) AS win_rate_exposed,
       coalesce(sum(pnl) / nullif(sum(trade), 0), 0) AS avg_trade_return,
       CAST(sum(trade) AS BIGINT) AS num_trades"""


def vectors(width: int = 64) -> str:
    columns = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS f{k}" for k in range(width))
    return f"""
wide AS (SELECT vec_id AS row_id, label % 3 + 1 AS class, {columns} FROM embeddings),
long AS (
  UNPIVOT wide ON {", ".join(f"f{k}" for k in range(width))} INTO NAME feature VALUE x),
correlations AS (
  SELECT feature, CAST(substr(feature, 2) AS INTEGER) AS position,
         coalesce(covar_pop(x, class - 2)
                  / nullif(stddev_pop(x) * stddev_pop(class - 2), 0), 0) AS corr
  FROM long GROUP BY feature),
rule AS (SELECT * FROM correlations ORDER BY abs(corr) DESC, position LIMIT 10),
scores AS (
  SELECT row_id, class, sum(x * corr) AS score
  FROM long JOIN rule USING (feature) GROUP BY row_id, class)"""


SCORED = """
scored AS (
  SELECT l_orderkey, CAST(l_returnflag = 'R' AS INTEGER) AS y_true,
         l_extendedprice / 110000 AS y_prob
  FROM lineitem)"""
