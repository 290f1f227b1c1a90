"""Every registered query over the given tables, with its DuckDB text where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..functions.schema import SCALE_FREE_FEATURES
from ..operators import backtest as bt
from ..operators import bars as bar_ops
from ..operators import dedup, evaluate, model, profile, signals, zscore
from ..operators.features import DERIVED_COLUMNS, FEATURE_COLUMNS, bar_features
from ..operators.labels import drawdown_labels
from ..session import shared_dir, tune, written
from ..sources import raw_files, tables
from ..streaming import read_trade_stream, streaming_trade_bars, write_bars
from . import inputs, jobs, oracle
from .inputs import HOUR_MS, table
from .oracle import HOUR, MINUTE, rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    """Register a query under its function name; doubles are rounded for comparison."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _rounded(build(tune(spark), folder), digits)

        QUERIES[build.__name__] = run
        if sql:
            SQL[build.__name__] = sql.strip()
        return build

    return register


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + 0.0).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _features(spark: SparkSession, folder: str, step: int) -> DataFrame:
    bars = bar_ops.trade_bars(inputs.trades(spark, folder), step)
    return bar_features(bar_ops.join_bars(inputs.grid(spark, folder, step), bars), step)


# --- parsing and normalising -------------------------------------------------------------

_EPOCHS = """
raw AS (
  SELECT event_id,
         CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 WHEN 1 THEN epoch_us(ts) // 1000
              WHEN 2 THEN epoch_us(ts) ELSE epoch_us(ts) * 1000 END AS x
  FROM events)"""


def _epoch_text(events: DataFrame) -> Column:
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    unit = F.col("event_id") % 4
    return (
        F.when(unit == 0, fn.div(micros, 1_000_000))
        .when(unit == 1, fn.div(micros, 1_000))
        .when(unit == 2, micros)
        .otherwise(micros * 1_000)
        .cast("string")
    )


@query(f"""
WITH {_EPOCHS}
SELECT event_id, CASE WHEN abs(x) >= 1e17 THEN x // 1000000 WHEN abs(x) >= 1e14 THEN x // 1000
                      WHEN abs(x) < 1e11 THEN x * 1000 ELSE x END AS epoch_ms
FROM raw""")
def epoch_normalise(spark, folder):
    events = table(spark, folder, "events")
    return events.select("event_id", fn.epoch_ms(_epoch_text(events)).alias("epoch_ms"))


_BOOL_TEXTS = ("true", " False ", "1", "0", "T", "f", "YES", "no", "2", "0.5", "y", "")


@query(f"""
WITH raw AS (SELECT event_id, [{", ".join(repr(t) for t in _BOOL_TEXTS)}][event_id % 12 + 1] AS t
             FROM events)
SELECT event_id, CASE WHEN lower(trim(t)) IN ('true', '1', 't', 'yes') THEN true
                      WHEN lower(trim(t)) IN ('false', '0', 'f', 'no') THEN false
                      ELSE trunc(TRY_CAST(t AS DOUBLE)) <> 0 END AS flag
FROM raw""")
def lenient_booleans(spark, folder):
    texts = F.array(*[F.lit(t) for t in _BOOL_TEXTS])
    text = F.get(texts, (F.col("event_id") % 12).cast("int"))
    return table(spark, folder, "events").select("event_id", fn.to_bool(text).alias("flag"))


@query("""
WITH raw AS (
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN '  12.5 '
         WHEN 2 THEN 'n/a' WHEN 3 THEN '' ELSE CAST(event_id AS VARCHAR) END AS t
  FROM events)
SELECT event_id, round(TRY_CAST(trim(t) AS DOUBLE), 6) + 0.0 AS number,
       CASE WHEN TRY_CAST(trim(t) AS DOUBLE) = trunc(TRY_CAST(trim(t) AS DOUBLE))
            THEN CAST(TRY_CAST(trim(t) AS DOUBLE) AS BIGINT) END AS whole
FROM raw""")
def lenient_numbers(spark, folder):
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.col("value").cast("string"))
        .when(kind == 1, "  12.5 ")
        .when(kind == 2, "n/a")
        .when(kind == 3, "")
        .otherwise(F.col("event_id").cast("string"))
    )
    return table(spark, folder, "events").select(
        "event_id", fn.to_double(text).alias("number"), fn.to_long(text).alias("whole")
    )


@query("""
SELECT event_id, epoch_us(ts) // 1000 AS from_timestamp, epoch_us(ts) // 1000 AS from_number,
       strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) // 60000000 * 60000 AS minute
FROM events""")
def open_time_forms(spark, folder):
    """The same instant read from a timestamp and from a fractional number of milliseconds."""
    events = table(spark, folder, "events")
    timed = events.select("event_id", fn.open_time_ms(events, "ts").alias("ms"))
    numbers = timed.withColumn("number", F.col("ms").cast("double") + 0.25)
    return numbers.select(
        "event_id",
        F.col("ms").alias("from_timestamp"),
        fn.open_time_ms(numbers, "number").alias("from_number"),
        fn.date_text("ms").alias("day"),
        fn.minute_floor("ms").alias("minute"),
    )


@query("""
SELECT event_id, regexp_replace(lower(trim(event_type || ' ' || props)), '[^a-z0-9]+', '', 'g') AS cleaned
FROM events""")
def cleaned_names(spark, folder):
    text = F.concat_ws(" ", "event_type", "props")
    return table(spark, folder, "events").select("event_id", fn.clean_name(text).alias("cleaned"))


_LINE_FILES = ("view", "click", "error", "purchase", "signup")


def _trade_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Trades as lines of one file per symbol, each file with another layout and time unit.

    Every tenth trade is there twice.  ``signup`` has a header with other names,
    ``purchase`` no ids.
    """
    t = inputs.trades(spark, folder)
    ms, price, qty = (F.col(c).cast("string") for c in ("time", "price", "qty"))
    number, maker = F.col("trade_id").cast("string"), F.col("isBuyerMaker")
    flag = F.when(maker, "True").otherwise("False")
    bit = maker.cast("int").cast("string")
    micros = (F.col("time") * 1_000).cast("string")
    by_layout = {
        "view": [number, price, qty, F.lit("0"), ms, flag, F.lit("True")],
        "click": [number, price, qty, micros, bit, F.lit("True")],
        "error": [number, price, qty, ms, flag],
        "purchase": [price, qty, ms, flag],
        "signup": [ms, bit, F.concat(F.lit('"'), price, F.lit('"')), qty, number],
    }
    line = F
    for symbol, fields in by_layout.items():
        line = line.when(F.col("symbol") == symbol, F.concat_ws(",", *fields))
    copies = F.when(F.col("trade_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    data = t.withColumn("copy", F.explode(copies)).select(
        F.col("symbol").alias("source_file"),
        F.lit(0).cast("bigint").alias("split_start"),
        (F.col("trade_id") * 2 + F.col("copy")).alias("nth"),
        line.otherwise(F.lit(None)).alias("line"),
        F.lit(None).cast("string").alias("error"),
    )
    header = t.where(F.col("symbol") == "signup").select(
        F.col("symbol").alias("source_file"),
        F.lit(0).cast("bigint").alias("split_start"),
        F.lit(-1).cast("bigint").alias("nth"),
        F.lit("Timestamp,is_buyer_maker,Price,Quantity,trade ID").alias("line"),
        F.lit(None).cast("string").alias("error"),
    ).distinct()
    return data.unionByName(header)


@query(f"""
WITH {oracle.TRADES}
SELECT symbol AS source_file, time, round(min(price), 6) + 0.0 AS price, min(qty) AS qty, isBuyerMaker,
       CASE WHEN symbol <> 'purchase' THEN trade_id END AS trade_id
FROM trades
GROUP BY symbol, time, isBuyerMaker, trade_id""")
def normalised_trade_lines(spark, folder):
    """Lines of five layouts to one schema, repeats within a file removed."""
    lines = _trade_lines(spark, folder)
    files = len(_LINE_FILES)
    parsed = written(raw_files.normalize_trades(lines, files), "parsed_trades")
    trades = dedup.dedup_trades(parsed, files=files)
    return trades.select(
        "source_file", "time", "price", "qty", "isBuyerMaker", "trade_id"
    )


@query(f"""
WITH {oracle.grid(HOUR)}
SELECT symbol AS source_file, open_time * 1000 AS open_time_raw, open_time,
       round(open, 6) + 0.0 AS open, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume,
       open_time + 3599999 AS close_time, CAST(NULL AS BIGINT) AS number_of_trades
FROM candles""")
def normalised_kline_lines(spark, folder):
    """Candle lines with a header, microsecond times and eight of twelve columns."""
    c = inputs.candles(spark, folder, HOUR_MS)
    fields = ["open", "high", "low", "close", "volume"]
    line = F.concat_ws(
        ",",
        F.col("open_time") * 1_000,
        *fields,
        F.col("open_time") + HOUR_MS - 1,
        F.lit("1.5"),
    )
    empty = F.lit(None).cast("string").alias("error")
    start = F.lit(0).cast("bigint").alias("split_start")
    data = c.select(
        F.col("symbol").alias("source_file"), start, F.col("open_time").alias("nth"), line.alias("line"), empty
    )
    header = c.select(
        F.col("symbol").alias("source_file"),
        start,
        F.lit(-1).cast("bigint").alias("nth"),
        F.lit("Open time,Open,High,Low,Close,Volume,Close time,Quote volume").alias("line"),
        empty,
    ).distinct()
    return raw_files.normalize_klines(data.unionByName(header), len(_LINE_FILES)).select(
        "source_file",
        "open_time_raw",
        "open_time",
        "open",
        "close",
        "volume",
        "close_time",
        "number_of_trades",
    )


# --- the experiment job over wide files --------------------------------------------------------


def _oracle_report(part: int) -> str:
    return f"""
SELECT '{("oracle_train", "oracle_test")[part]}' AS name, * FROM (
  WITH vector_rows AS (SELECT vec_id AS row_id, label % 3 + 1 AS class FROM embeddings WHERE vec_id % 2 = {part}),
  {oracle.pnl_table("class - 2", "vector_rows")},
  whole AS (SELECT {oracle.summary()}, min(drawdown) AS max_drawdown FROM pnl_table)
  SELECT {rounded(["total_pnl", "mean_pnl", "std_pnl", "sharpe_per_step", "max_drawdown", "win_rate_exposed", "avg_trade_return"])}, num_trades
  FROM whole)"""


@query(f"{_oracle_report(0)} UNION ALL {_oracle_report(1)}")
def experiment_oracle_report(spark, folder):
    """Two wide CSV files written from the vectors, the experiment job over them, and its report read back."""
    place = f"{shared_dir(spark)}/experiment-{uuid.uuid4().hex}"
    vectors = table(spark, folder, "embeddings")
    features = [F.get("embedding", F.lit(int(c) % inputs.EMBEDDING_WIDTH)).cast("double").alias(c) for c in tables.WIDE_FEATURES]
    labels = [(F.col("label") % 3 + 1).alias(c) for c in tables.WIDE_LABELS]
    for k, part in enumerate(("train", "test")):
        rows = vectors.where(F.col("vec_id") % 2 == k).select(F.col("vec_id").alias("Unnamed: 0"), *features, *labels)
        tables.write_csv(rows, f"{place}/{part}")
    jobs.run_experiment(spark, f"{place}/train", f"{place}/test", f"{place}/out", jobs.ExperimentConfig(strategy="oracle"))
    report = spark.read.json(f"{place}/out/report.json", multiLine=True)
    metrics = ["total_pnl", "mean_pnl", "std_pnl", "sharpe_per_step", "max_drawdown", "win_rate_exposed", "avg_trade_return", "num_trades"]
    rows = [report.select(F.lit(n).alias("name"), *[F.col(f"{n}.{m}").alias(m) for m in metrics]) for n in ("oracle_train", "oracle_test")]
    return rows[0].unionByName(rows[1])


# --- raw files, written from the given tables and merged again ------------------------------


def _merge_job(spark: SparkSession, folder: str, trades_only: bool = False) -> str:
    """Folder of the merged tables; files and tables lie in the shared folder."""
    root = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    inputs.write_raw_files(spark, folder, root)
    jobs.merge_raw(spark, jobs.MergeConfig(root, f"{root}/merged", _LINE_FILES, trades_only))
    return f"{root}/merged"


_FILED = f"""{oracle.TRADES},
filed AS (
  SELECT *, CASE WHEN symbol = 'click' THEN 0 WHEN day >= 21 THEN 21 WHEN day >= 11 THEN 11 ELSE 1 END AS file
  FROM (SELECT *, day(make_timestamp(time * 1000)) AS day FROM trades)),
readable AS (SELECT * FROM filed WHERE symbol <> 'error' OR file <> 21),
merged AS (
  SELECT symbol, file, time, price, qty, isBuyerMaker, CASE WHEN symbol <> 'purchase' THEN trade_id END AS trade_id
  FROM readable GROUP BY ALL),
hours AS (
  SELECT symbol, open_time, close, volume, day(make_timestamp(open_time * 1000)) AS day FROM candles)"""
_MERGE = f"WITH {oracle.grid(HOUR).strip()}," + _FILED.replace(oracle.TRADES, "").lstrip(", \n")


@query(f"{_MERGE} SELECT symbol, time, round(price, 6) + 0.0 AS price, qty, isBuyerMaker, trade_id FROM merged")
def merged_trades(spark, folder):
    """Daily, monthly, zipped, headed and spoilt trade files of five symbols through the merge job."""
    return spark.read.parquet(f"{_merge_job(spark, folder, trades_only=True)}/trades.parquet")


@query(f"""{_MERGE}
SELECT symbol, open_time, open_time AS open_time_raw, round(close + CASE WHEN day > 20 THEN 1000 ELSE 0 END, 6) + 0.0 AS close,
       volume, open_time AS utc_ms
FROM hours""")
def merged_klines(spark, folder):
    """Monthly and then daily candle files, of which the first candle of a time stays."""
    merged = spark.read.parquet(f"{_merge_job(spark, folder)}/klines_1m.parquet")
    return merged.select("symbol", "open_time", "open_time_raw", "close", "volume", F.unix_millis("open_time_utc").alias("utc_ms"))


@query(f"""{_MERGE},
numbered AS (
  SELECT 'trades' AS kind, symbol, count(*) FILTER (symbol <> 'error' OR file <> 21) AS rows_read,
         count(DISTINCT file) AS files, count(DISTINCT file) FILTER (symbol = 'error' AND file = 21) AS failed_files
  FROM (SELECT * FROM filed UNION ALL SELECT * FROM filed WHERE trade_id % 10 = 0) GROUP BY symbol),
kept AS (SELECT symbol, count(*) AS rows_kept FROM merged GROUP BY symbol)
SELECT kind, symbol, CASE WHEN symbol = 'click' THEN 0 ELSE files END AS daily_files,
       CASE WHEN symbol = 'click' THEN files ELSE 0 END AS monthly_files, failed_files, rows_read, rows_kept
FROM numbered JOIN kept USING (symbol)
UNION ALL
SELECT 'klines', symbol, CAST(max(day) >= 15 AS BIGINT), CAST(min(day) <= 20 AS BIGINT), 0,
       count(*) FILTER (day <= 20) + count(*) FILTER (day >= 15), count(*)
FROM hours GROUP BY symbol""")
def merge_report(spark, folder):
    """Files and rows of each symbol, read and kept."""
    return jobs.merge_counts(spark.read.parquet(f"{_merge_job(spark, folder)}/files.parquet"))


@query(f"{_MERGE} SELECT 0 AS files_out_of_order, count(*) AS n_rows FROM merged")
def merged_file_order(spark, folder):
    """Files of the merged table that begin before the one before them ends: none."""
    bounds = tables.file_bounds(spark, f"{_merge_job(spark, folder, trades_only=True)}/trades.parquet", ["symbol", "time"])
    before = Window.orderBy("first", "last")  # one row for each file
    ordered = bounds.withColumn("wrong", F.lag("last").over(before) > F.col("first"))
    return ordered.agg(F.count_if("wrong").cast("int").alias("files_out_of_order"), F.sum("n_rows").alias("n_rows"))


@query("""
WITH lines AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Trade ID, Price ,QTY,extra'
                        WHEN event_id % 3 = 1 THEN 'price,price,price,' || event_type
                        ELSE event_id || ',' || value END AS line
  FROM events)
SELECT event_id, len(list_intersect(
         list_distinct([regexp_replace(lower(trim(f)), '[^a-z0-9]+', '', 'g') FOR f IN string_split(line, ',')]),
         ['id', 'tradeid', 'price', 'qty', 'quantity', 'quoteqty', 'time', 'timestamp', 'isbuyermaker'])) >= 3
       AS header_like
FROM lines""")
def header_detection(spark, folder):
    kind = F.col("event_id") % 3
    line = (
        F.when(kind == 0, "Trade ID, Price ,QTY,extra")
        .when(kind == 1, F.concat(F.lit("price,price,price,"), "event_type"))
        .otherwise(F.concat_ws(",", "event_id", "value"))
    )
    fields = raw_files.split_fields(line)
    return table(spark, folder, "events").select(
        "event_id", raw_files.header_like(fields, raw_files.TRADE_HEADER).alias("header_like")
    )


@query("""
SELECT user_id, event_type, event_id, round(value, 6) + 0.0 AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
WHERE n = 1""")
def dedup_keep_first(spark, folder):
    first = dedup.keep_first(table(spark, folder, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return first.select("user_id", "event_type", "event_id", "value")


@query("""
SELECT user_id, event_type, event_id, round(value, 6) + 0.0 AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n
  FROM events)
WHERE n = 1""")
def dedup_keep_last(spark, folder):
    last = dedup.keep_last(table(spark, folder, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return last.select("user_id", "event_type", "event_id", "value")


@query("""
WITH symbols AS (SELECT DISTINCT o_orderpriority AS symbol FROM orders),
months AS (SELECT strftime(m, '%Y-%m') AS month_key
           FROM range(DATE '1995-03-01', DATE '2002-06-02', INTERVAL 1 MONTH) AS r(m)),
present AS (SELECT DISTINCT o_orderpriority AS symbol, strftime(o_orderdate, '%Y-%m') AS month_key FROM orders)
SELECT s.symbol, m.month_key, CASE WHEN p.symbol IS NULL THEN 'missing' ELSE 'existing' END AS status
FROM symbols s CROSS JOIN months m LEFT JOIN present p ON p.symbol = s.symbol AND p.month_key = m.month_key""")
def month_coverage(spark, folder):
    """Expected months of every order priority, and whether an order falls in them."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.date_format("o_orderdate", "yyyy-MM").alias("month_key")
    )
    expected = tables.month_windows(spark, "1995-03-15", "2002-06-01")
    return tables.month_coverage(expected, orders, orders)


# --- bars, grid, features ----------------------------------------------------------------

_BAR = ["trade_vol", "trade_dollar_vol", "buy_vol", "sell_vol"]


@query(f"""
WITH {oracle.bars(MINUTE)}
SELECT symbol, open_time, n_trades, {rounded(_BAR)} FROM bars""")
def trade_bars(spark, folder):
    return bar_ops.trade_bars(inputs.trades(spark, folder))


@query(f"""
WITH {oracle.bars(MINUTE)}
SELECT symbol, open_time, n_trades, {rounded(_BAR)} FROM bars
WHERE open_time BETWEEN epoch_ms(TIMESTAMP '2024-01-08') AND epoch_ms(TIMESTAMP '2024-01-14 23:59:59.999')""")
def trade_bars_in_range(spark, folder):
    bounds = fn.day_bounds_ms("2024-01-08", "2024-01-14")
    return bar_ops.trade_bars(inputs.trades(spark, folder), bounds_ms=bounds)


_GRID = ["open", "high", "low", "close", "volume"]


@query(f"""
WITH {oracle.grid(MINUTE)}
SELECT symbol, open_time, {rounded(_GRID)} FROM grid""")
def minute_grid(spark, folder):
    return inputs.grid(spark, folder)


@query(f"""
WITH {oracle.grid(HOUR)},
walk AS (SELECT symbol, open_time,
                lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS previous_open_time FROM candles)
SELECT symbol, previous_open_time, open_time FROM walk
WHERE open_time - previous_open_time <> {HOUR}""")
def grid_violations(spark, folder):
    return bar_ops.grid_violations(inputs.candles(spark, folder, HOUR_MS), HOUR_MS)


@query(f"""
WITH {oracle.features(MINUTE)}
SELECT symbol, open_time, n_trades, {rounded([*_GRID, *_BAR])} FROM joined""")
def grid_with_bars(spark, folder):
    bars = bar_ops.trade_bars(inputs.trades(spark, folder))
    return bar_ops.join_bars(inputs.grid(spark, folder), bars)


_DOUBLES = [c for c in FEATURE_COLUMNS if c not in ("symbol", "open_time", "n_trades")]


@query(
    f"""
WITH {oracle.features(MINUTE)}
SELECT symbol, open_time, n_trades, {rounded(_DOUBLES, 5)} FROM features""",
    digits=5,
)
def features_1m(spark, folder):
    """All 22 columns of the feature table on the minute grid."""
    return _features(spark, folder, MINUTE)


def _some_features(name: str, columns: Sequence[str]) -> None:
    def build(spark, folder):
        return _features(spark, folder, HOUR_MS).select("symbol", "open_time", *columns)

    build.__name__ = name
    query(f"WITH {oracle.features(HOUR)} SELECT symbol, open_time, {rounded(columns)} FROM features")(build)


_some_features("log_returns", ["ret_1m"])
_some_features("rolling_volatility", ["rv_5m", "rv_30m", "rv_4h"])
_some_features("volume_zscore", ["vol_z_30m"])
_some_features("drawdown_from_peak", ["peak_close_4h", "drawdown_4h"])
_some_features("row_features", ["spread_proxy", "imbalance", "buyer_aggressor_ratio"])


# --- labels ------------------------------------------------------------------------------

_TARGETS = [
    *[f"future_min_close_H{h}m" for h in (30, 240)],
    *[f"dd_min_H{h}m" for h in (30, 240)],
    *[f"y_dd_{p}p_H{h}m" for h in (30, 240) for p in (30, 50)],
]


@query(f"""
WITH {oracle.grid(MINUTE)}, {oracle.drawdowns("grid", (30, 240), (0.3, 0.5))}
SELECT symbol, open_time, {rounded(["close", *_TARGETS])} FROM labelled""")
def forward_drawdown_labels(spark, folder):
    rows = inputs.grid(spark, folder).select("symbol", "open_time", "close")
    return drawdown_labels(rows, [30, 240], [0.3, 0.5], strict_grid=True)


_COUNTED = ["future_min_close_H24m", "dd_min_H24m", "y_dd_30p_H24m", "future_min_close_H100m", "dd_min_H100m", "y_dd_30p_H100m"]


@query(f"""
WITH {oracle.grid(HOUR)}, {oracle.drawdowns("candles", (24, 100), (0.3,))}
SELECT symbol, open_time, {rounded(["close", *_COUNTED])} FROM labelled""")
def forward_drawdown_labels_by_row(spark, folder):
    """Horizons count rows where bars are missing: rows are numbered first."""
    rows = inputs.candles(spark, folder, HOUR_MS).select("symbol", "open_time", "close")
    return drawdown_labels(rows, [24, 100], [0.3], step_ms=HOUR_MS)


# --- z-scores ----------------------------------------------------------------------------

_BASE = [c for c in FEATURE_COLUMNS if c not in ("symbol", "open_time")]
_BEFORE = "b AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_EXPANDING = ", ".join(oracle.z_column(c, "b", "count(*) OVER b", 24) for c in _BASE)
_ROLLING = ", ".join(oracle.z_column(c, "r", f"count({c}) OVER r", 24) for c in _BASE)
_WEEK = "r AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)"
_Z = [f"z_{c}" for c in _BASE]


def _written_features(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly features as a table: an expanding score reads them twice."""
    return written(_features(spark, folder, HOUR_MS), "features")


@query(
    f"""
WITH {oracle.features(HOUR)}, z AS (SELECT symbol, open_time, {_EXPANDING} FROM features WINDOW {_BEFORE})
SELECT symbol, open_time, {rounded(_Z, 4)} FROM z""",
    digits=4,
)
def causal_z_expanding(spark, folder):
    rows = _written_features(spark, folder)
    return zscore.zscore_features(rows, min_periods=24, step_ms=HOUR_MS)


@query(
    f"""
WITH {oracle.features(HOUR)}, z AS (SELECT symbol, open_time, {_ROLLING} FROM features WINDOW {_WEEK})
SELECT symbol, open_time, {rounded(_Z, 4)} FROM z""",
    digits=4,
)
def causal_z_rolling(spark, folder):
    return zscore.zscore_features(
        _features(spark, folder, HOUR_MS),
        mode="rolling",
        window=168,
        min_periods=24,
        step_ms=HOUR_MS,
        strict_grid=True,
    )


def _modelling(spark: SparkSession, folder: str) -> DataFrame:
    labelled = drawdown_labels(
        _features(spark, folder, HOUR_MS), [24], [0.5], step_ms=HOUR_MS, strict_grid=True
    )
    return labelled


@query(
    f"""
WITH {oracle.features(HOUR)}, {oracle.drawdowns("features", (24,), (0.5,))},
z AS (SELECT symbol, open_time, y_dd_50p_H24m, dd_min_H24m, future_min_close_H24m, {_EXPANDING}
      FROM labelled WINDOW {_BEFORE})
SELECT symbol, open_time, {rounded(["y_dd_50p_H24m", "dd_min_H24m", "future_min_close_H24m", *_Z], 4)} FROM z""",
    digits=4,
)
def zscore_dataset(spark, folder):
    """Targets and z columns alone, ready for a model."""
    rows = written(_modelling(spark, folder), "modelling")
    return zscore.zscore_dataset(rows, min_periods=24, step_ms=HOUR_MS)


_POOLED = ["ret_1m", "imbalance", "trade_dollar_vol"]
_POOLED_WINDOW = (
    "b AS (ORDER BY open_time, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)


@query(
    f"""
WITH {oracle.features(HOUR)},
z AS (SELECT symbol, open_time, {", ".join(oracle.z_column(c, "b", "count(*) OVER b", 24) for c in _POOLED)}
      FROM features WINDOW {_POOLED_WINDOW})
SELECT symbol, open_time, {rounded([f"z_{c}" for c in _POOLED], 4)} FROM z""",
    digits=4,
)
def causal_z_pooled(spark, folder):
    """One series over all symbols: no grouping by symbol."""
    rows = _written_features(spark, folder).select("symbol", "open_time", *_POOLED)
    return zscore.zscore_dataset(
        rows, min_periods=24, step_ms=HOUR_MS, by_symbol=False, order=["open_time", "symbol"]
    )


_DEFAULTED = " UNION ALL ".join(
    f"SELECT 'z_{c}' AS z_column, count(*) FILTER (h_{c} < 24) AS defaulted_rows FROM h" for c in _BASE
)


@query(f"""
WITH {oracle.features(HOUR)},
h AS (SELECT {", ".join(f"count({c}) OVER r AS h_{c}" for c in _BASE)} FROM features WINDOW {_WEEK})
{_DEFAULTED}""")
def zscore_defaulted_rows(spark, folder):
    return zscore.defaulted_rows(
        _features(spark, folder, HOUR_MS),
        mode="rolling",
        window=168,
        min_periods=24,
        step_ms=HOUR_MS,
        strict_grid=True,
    )


# --- signals and backtest ----------------------------------------------------------------


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as labelled rows: class from the status, score from the price."""
    status = F.col("o_orderstatus")
    label = F.when(status == "F", 1).when(status == "O", 2).when(status == "P", 3)
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        label.alias("class"),
        ((F.col("o_totalprice") - 250_000) / 250_000).alias("score"),
        signals.class_direction(label).alias("realized_direction"),
    )


def _pnl(spark: SparkSession, folder: str, threshold: float | None = None) -> DataFrame:
    rows = _rows(spark, folder)
    signal = (
        F.col("realized_direction")
        if threshold is None
        else signals.threshold_signal("score", threshold)
    )
    return bt.backtest(rows.select("row_id", signal.alias("signal"), "realized_direction"))


_ORACLE_PNL = f"WITH {oracle.ROWS}, {oracle.pnl_table('class - 2')}"
_RULE_SIGNAL = "CASE WHEN score > 0.2 THEN 1 WHEN score < -0.2 THEN -1 ELSE 0 END"
_RULE_PNL = f"WITH {oracle.ROWS}, {oracle.pnl_table(_RULE_SIGNAL)}"
_SUMMARY = [
    "total_pnl",
    "mean_pnl",
    "std_pnl",
    "sharpe_per_step",
    "win_rate_exposed",
    "avg_trade_return",
]


@query(f"""
WITH {oracle.ROWS}
SELECT class - 2 AS realized_direction, count(*) AS n_rows FROM labelled_rows GROUP BY ALL""")
def class_directions(spark, folder):
    return _rows(spark, folder).groupBy("realized_direction").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"{_RULE_PNL} SELECT row_id, signal, position, previous AS previous_position FROM pnl_table")
def lagged_positions(spark, folder):
    rows = _rows(spark, folder).select("row_id", signals.threshold_signal("score", 0.2).alias("signal"))
    return signals.positions(rows)


@query(f"""{_ORACLE_PNL}
SELECT row_id, signal, realized_direction, position, trade_size, trade, {rounded(["pnl", "equity"])}
FROM pnl_table""")
def position_pnl(spark, folder):
    """The label itself as signal, one row late: the ceiling of any strategy."""
    return _pnl(spark, folder).drop("peak", "drawdown")


@query(f"{_RULE_PNL} SELECT row_id, {rounded(['equity', 'peak', 'drawdown'])} FROM pnl_table")
def drawdown_curve(spark, folder):
    return _pnl(spark, folder, 0.2).select("row_id", "equity", "peak", "drawdown")


@query(f"""{_ORACLE_PNL},
s AS (SELECT {oracle.summary()}, min(drawdown) AS max_drawdown FROM pnl_table)
SELECT num_trades, {rounded([*_SUMMARY, "max_drawdown"])} FROM s""")
def strategy_metrics(spark, folder):
    return bt.strategy_metrics(_pnl(spark, folder))


@query(f"""{_RULE_PNL}
SELECT count(*) FILTER (signal NOT IN (-1, 0, 1)) AS bad_signal,
       count(*) FILTER (position NOT IN (-1, 0, 1)) AS bad_position,
       count(*) FILTER (realized_direction NOT IN (-1, 0, 1)) AS bad_direction,
       count(*) FILTER (pnl IS NULL OR equity IS NULL) AS missing_key,
       count(*) FILTER ((trade = 1) <> (trade_size > 0)) AS bad_trade_flag
FROM pnl_table""")
def domain_violations(spark, folder):
    return bt.domain_violations(_pnl(spark, folder, 0.2))


_THRESHOLDS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)
_GRID_VALUES = ", ".join(f"({k}, CAST({t} AS DOUBLE))" for k, t in enumerate(_THRESHOLDS))
_SEARCH = f"""
WITH {oracle.ROWS},
lags AS (SELECT row_id, class - 2 AS d, lag(score) OVER (ORDER BY row_id) AS s1,
                lag(score, 2) OVER (ORDER BY row_id) AS s2 FROM labelled_rows),
tries AS (
  SELECT place, threshold, d,
         CASE WHEN s1 > threshold THEN 1 WHEN s1 < -threshold THEN -1 ELSE 0 END AS position,
         CASE WHEN s2 > threshold THEN 1 WHEN s2 < -threshold THEN -1 ELSE 0 END AS previous
  FROM lags, (VALUES {_GRID_VALUES}) AS g(place, threshold)),
tried AS (
  SELECT place, threshold, position, CAST(position <> previous AS INTEGER) AS trade,
         position * d - CAST(0.01 AS DOUBLE) * abs(position - previous) AS pnl FROM tries),
sensitivity AS (SELECT {oracle.summary("place, threshold,")} FROM tried GROUP BY place, threshold)"""


@query(f"{_SEARCH} SELECT place, threshold, num_trades, {rounded(_SUMMARY)} FROM sensitivity")
def threshold_sensitivity(spark, folder):
    return bt.threshold_sensitivity(_rows(spark, folder), _THRESHOLDS)


@query(f"""{_SEARCH}
SELECT threshold, num_trades, {rounded(_SUMMARY)} FROM sensitivity ORDER BY sharpe_per_step DESC, place LIMIT 1""")
def best_threshold(spark, folder):
    return bt.best_threshold(bt.threshold_sensitivity(_rows(spark, folder), _THRESHOLDS))


@query(f"""{_ORACLE_PNL}, lim AS (SELECT min(pnl) AS lo, max(pnl) AS hi FROM pnl_table),
binned AS (SELECT CAST(least(floor((pnl - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n
           FROM pnl_table, lim GROUP BY 1)
SELECT CAST(r AS INTEGER) AS bin, round(lo + (hi - lo) / 50 * r, 6) + 0.0 AS bin_low,
       round(lo + (hi - lo) / 50 * (r + 1), 6) + 0.0 AS bin_high, coalesce(n, 0) AS n_rows
FROM range(50) AS t(r) CROSS JOIN lim LEFT JOIN binned ON bin = r""")
def pnl_histogram(spark, folder):
    return evaluate.histogram(written(_pnl(spark, folder).select("pnl"), "pnl"), "pnl", 50)


# --- wide features and the linear rule ---------------------------------------------------

_F = [f"f{k}" for k in range(inputs.EMBEDDING_WIDTH)]


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as wide labelled rows."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") % 3 + 1).alias("class"),
        *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(_F)],
    )


@query(f"""
WITH {oracle.vectors()}, s AS (SELECT abs(avg(x)) AS m, stddev_pop(x) AS s FROM long GROUP BY feature)
SELECT round(avg(m), 6) + 0.0 AS mean_abs, round(avg(s), 6) + 0.0 AS std_avg FROM s""")
def feature_stats(spark, folder):
    return signals.feature_stats(_wide(spark, folder), _F)


@query(f"""
WITH {oracle.vectors()}, s AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY feature),
z AS (SELECT row_id, feature, (x - m) / CASE WHEN s = 0 THEN 1e-8 ELSE s END AS z FROM long JOIN s USING (feature))
SELECT row_id, {", ".join(f"round(max(z) FILTER (feature = '{c}'), 6) + 0.0 AS {c}" for c in _F)}
FROM z GROUP BY row_id""")
def standardized_features(spark, folder):
    return signals.standardize(_wide(spark, folder), _F).drop("class")


@query(f"WITH {oracle.vectors()} SELECT feature, position, round(corr, 6) + 0.0 AS corr FROM correlations")
def feature_correlations(spark, folder):
    rows = _wide(spark, folder).withColumn("direction", signals.class_direction("class"))
    return signals.feature_correlations(rows, _F, "direction")


@query(f"WITH {oracle.vectors()} SELECT feature, position, round(corr, 6) + 0.0 AS corr FROM rule")
def feature_correlation_topk(spark, folder):
    rows = _wide(spark, folder).withColumn("direction", signals.class_direction("class"))
    return signals.top_features(signals.feature_correlations(rows, _F, "direction"), 10)


@query(f"""
WITH {oracle.vectors()}
SELECT row_id, round(score, 6) + 0.0 AS score,
       CASE WHEN score > 0.02 THEN 1 WHEN score < -0.02 THEN -1 ELSE 0 END AS signal FROM scores""")
def rule_signals(spark, folder):
    wide = _wide(spark, folder)
    rule = signals.fit_rule(wide, _F, "class", 10)
    scored = wide.select("row_id", signals.rule_score(rule).alias("score"))
    return scored.withColumn("signal", signals.threshold_signal("score", 0.02))


_WIDE_RULE = "CASE WHEN score > 0.02 THEN 1 WHEN score < -0.02 THEN -1 ELSE 0 END"


@query(f"""
WITH {oracle.vectors()}, {oracle.pnl_table(_WIDE_RULE, "scores")},
s AS (SELECT {oracle.summary()}, min(drawdown) AS max_drawdown FROM pnl_table)
SELECT num_trades, {rounded([*_SUMMARY, "max_drawdown"])} FROM s""")
def rule_strategy_metrics(spark, folder):
    """Fit on all rows, hold the thresholded score one row late, measure the result."""
    wide = _wide(spark, folder)
    config = jobs.ExperimentConfig(label="class", features=tuple(_F))
    rule = signals.fit_rule(wide, _F, "class", config.top_k)
    return bt.strategy_metrics(jobs.rule_backtest(wide, rule, 0.02, config))


_TUNED_GRID = (0.0, 0.01, 0.02, 0.03)
_TUNED_VALUES = ", ".join(f"({k}, CAST({t} AS DOUBLE))" for k, t in enumerate(_TUNED_GRID))


@query(f"""
WITH {oracle.vectors()},
lags AS (SELECT class - 2 AS d, lag(score) OVER (ORDER BY row_id) AS s1,
                lag(score, 2) OVER (ORDER BY row_id) AS s2 FROM scores),
tries AS (
  SELECT place, threshold, d,
         CASE WHEN s1 > threshold THEN 1 WHEN s1 < -threshold THEN -1 ELSE 0 END AS position,
         CASE WHEN s2 > threshold THEN 1 WHEN s2 < -threshold THEN -1 ELSE 0 END AS previous
  FROM lags, (VALUES {_TUNED_VALUES}) AS g(place, threshold)),
tried AS (
  SELECT place, threshold, position, CAST(position <> previous AS INTEGER) AS trade,
         position * d - CAST(0.01 AS DOUBLE) * abs(position - previous) AS pnl FROM tries),
sensitivity AS (SELECT {oracle.summary("place, threshold,")} FROM tried GROUP BY place, threshold)
SELECT place, threshold, num_trades, {rounded(_SUMMARY)} FROM sensitivity""")
def rule_threshold_search(spark, folder):
    config = jobs.ExperimentConfig(label="class", features=tuple(_F), thresholds=_TUNED_GRID)
    return jobs.tune_rule(_wide(spark, folder), config)[2]


# --- evaluation of scores ----------------------------------------------------------------


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as scored rows: returned or not, scored by price."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        (F.col("l_extendedprice") / 110_000).alias("y_prob"),
    )


_RANKED = f"""
WITH {oracle.SCORED},
by_score AS (SELECT y_prob, CAST(sum(y_true) AS DOUBLE) AS p, CAST(sum(1 - y_true) AS DOUBLE) AS q
             FROM scored GROUP BY y_prob),
ranked AS (SELECT p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM by_score
           WINDOW w AS (ORDER BY y_prob DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"{_RANKED} SELECT round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) + 0.0 AS roc_auc FROM ranked")
def roc_auc(spark, folder):
    return evaluate.rank_metrics(_scored(spark, folder)).select("roc_auc")


@query(f"{_RANKED} SELECT round(sum(p * tp / (tp + fp)) / sum(p), 6) + 0.0 AS pr_auc FROM ranked")
def average_precision(spark, folder):
    return evaluate.rank_metrics(_scored(spark, folder)).select("pr_auc")


_GAPS = f"""
WITH {oracle.SCORED.replace("l_extendedprice / 110000 AS y_prob", "CASE WHEN l_partkey % 9 <> 0 THEN l_extendedprice / 110000 END AS y_prob")},
by_score AS (SELECT y_prob, CAST(sum(y_true) AS DOUBLE) AS p, CAST(sum(1 - y_true) AS DOUBLE) AS q
             FROM scored WHERE y_prob IS NOT NULL GROUP BY y_prob),
ranked AS (SELECT p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM by_score
           WINDOW w AS (ORDER BY y_prob DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"""{_GAPS}
SELECT round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) + 0.0 AS roc_auc,
       round(sum(p * tp / (tp + fp)) / sum(p), 6) + 0.0 AS pr_auc,
       (SELECT count(*) FILTER (y_prob IS NULL) FROM scored) AS n_missing_scores FROM ranked""")
def rank_metrics_with_missing_scores(spark, folder):
    """Rows without a score are left out, and counted."""
    rows = table(spark, folder, "lineitem")
    score = F.when(F.col("l_partkey") % 9 != 0, F.col("l_extendedprice") / 110_000)
    scored = rows.select((F.col("l_returnflag") == "R").cast("int").alias("y_true"), score.alias("y_prob"))
    missing = evaluate.missing_scores(scored).select("n_missing_scores").scalar()
    return evaluate.rank_metrics(scored).withColumn("n_missing_scores", missing)


@query(f"""
WITH {oracle.SCORED},
c AS (SELECT count(*) AS n_rows, avg(y_true) AS base_rate,
             count(*) FILTER (y_true = 0 AND y_prob < 0.5) AS tn, count(*) FILTER (y_true = 0 AND y_prob >= 0.5) AS fp,
             count(*) FILTER (y_true = 1 AND y_prob < 0.5) AS fn, count(*) FILTER (y_true = 1 AND y_prob >= 0.5) AS tp
      FROM scored)
SELECT n_rows, tn, fp, fn, tp, round(base_rate, 6) + 0.0 AS base_rate,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) + 0.0 AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS f1
FROM c""")
def threshold_metrics(spark, folder):
    return evaluate.threshold_metrics(_scored(spark, folder), 0.5)


@query(f"""
WITH {oracle.SCORED}
SELECT round(avg(y_prob) FILTER (y_true = 0), 6) + 0.0 AS mean_prob_when_y0,
       round(avg(y_prob) FILTER (y_true = 1), 6) + 0.0 AS mean_prob_when_y1
FROM scored""")
def mean_prob_by_class(spark, folder):
    return evaluate.mean_prob_by_class(_scored(spark, folder))


@query(f"""
WITH {oracle.SCORED},
edges AS (SELECT quantile_cont(y_prob, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM scored)
SELECT CAST(len(list_filter(e, lambda v : v < y_prob)) AS INTEGER) AS bin, count(*) AS n_rows,
       round(avg(y_prob), 6) + 0.0 AS mean_predicted, round(avg(y_true), 6) + 0.0 AS observed_rate
FROM scored, edges GROUP BY 1""")
def calibration_bins(spark, folder):
    return evaluate.calibration_bins(_scored(spark, folder))


@query(f"""
WITH {oracle.SCORED}, lim AS (SELECT min(y_prob) AS lo, max(y_prob) AS hi FROM scored),
binned AS (SELECT CAST(least(floor((y_prob - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS n
           FROM scored, lim GROUP BY 1)
SELECT CAST(r AS INTEGER) AS bin, round(lo + (hi - lo) / 40 * r, 6) + 0.0 AS bin_low,
       round(lo + (hi - lo) / 40 * (r + 1), 6) + 0.0 AS bin_high, coalesce(n, 0) AS n_rows
FROM range(40) AS t(r) CROSS JOIN lim LEFT JOIN binned ON bin = r""")
def probability_histogram(spark, folder):
    return evaluate.histogram(_scored(spark, folder), "y_prob", 40)


_DIRTY = """
dirty AS (
  SELECT CASE WHEN l_partkey % 11 = 0 THEN CAST('nan' AS DOUBLE) WHEN l_partkey % 11 = 1 THEN NULL
              WHEN l_partkey % 11 = 2 THEN CAST('inf' AS DOUBLE) ELSE l_quantity END AS a,
         CASE WHEN l_suppkey % 7 = 0 THEN CAST('-inf' AS DOUBLE) ELSE l_tax END AS b,
         CASE WHEN l_partkey % 5 <> 0 THEN l_linenumber > 3 END AS late
  FROM lineitem)"""


@query(f"""
WITH {_DIRTY}
SELECT count(*) FILTER (isinf(a)) + count(*) FILTER (isinf(b)) AS inf_count_before,
       count(*) FILTER (a IS NULL OR isnan(a)) + count(*) FILTER (b IS NULL OR isnan(b)) AS nan_count_before,
       count(*) FILTER (a IS NULL OR NOT isfinite(a)) + count(*) FILTER (b IS NULL OR NOT isfinite(b))
         AS nan_count_after_inf_replace,
       CAST(0 AS BIGINT) AS nan_count_after_fill
FROM dirty""")
def cleaning_counts(spark, folder):
    return model.cleaning_counts(_dirty(spark, folder), ["a", "b"])


def _dirty(spark: SparkSession, folder: str) -> DataFrame:
    rest, seventh = F.col("l_partkey") % 11, F.col("l_suppkey") % 7
    a = (
        F.when(rest == 0, float("nan"))
        .when(rest == 1, None)
        .when(rest == 2, float("inf"))
        .otherwise(F.col("l_quantity"))
    )
    b = F.when(seventh == 0, float("-inf")).otherwise(F.col("l_tax"))
    urgent = F.when(F.col("l_partkey") % 5 != 0, F.col("l_linenumber") > 3)
    return table(spark, folder, "lineitem").select(a.alias("a"), b.alias("b"), urgent.alias("late"))


@query(f"""
WITH {_DIRTY}
SELECT round(CASE WHEN isfinite(a) THEN a ELSE 0 END, 6) + 0.0 AS a,
       round(CASE WHEN isfinite(b) THEN b ELSE 0 END, 6) + 0.0 AS b, CAST(0 AS DOUBLE) AS absent,
       CASE WHEN late THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS late, count(*) AS n_rows
FROM dirty GROUP BY ALL""")
def cleaned_features(spark, folder):
    """Gaps and infinities to 0, booleans to 0 and 1, an absent manifest column added as 0."""
    clean = model.clean_features(_dirty(spark, folder), ["a", "b", "late", "absent"])
    return clean.groupBy("a", "b", "late", "absent").agg(F.count(F.lit(1)).alias("n_rows"))


# --- the risk model ----------------------------------------------------------------------

_LABEL = "y_dd_50p_H24m"


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled hours, written once: a fit reads its input many times."""
    return written(model.labelled_rows(_modelling(spark, folder), _LABEL), "labelled")


@query(f"""
WITH {oracle.features(HOUR)}, {oracle.drawdowns("features", (24,), (0.5,))},
n AS (SELECT symbol, open_time, row_number() OVER (ORDER BY open_time, symbol) AS k, count(*) OVER () AS total
      FROM labelled WHERE {_LABEL} IS NOT NULL)
SELECT symbol, open_time, k <= greatest(least(CAST(floor(total * CAST(0.7 AS DOUBLE)) AS BIGINT), total - 1), 1)
         AS is_train
FROM n""")
def temporal_split(spark, folder):
    train, test = model.temporal_split(_labelled(spark, folder), 0.7)
    keys = ["symbol", "open_time"]
    return (
        train.select(*keys, F.lit(True).alias("is_train"))
        .unionByName(test.select(*keys, F.lit(False).alias("is_train")))
    )


def _price_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled hours, scored by the drawdown so far."""
    rows = _labelled(spark, folder)
    return rows.select("symbol", "open_time", "close", "ret_1m", "y_true", (-F.col("drawdown_4h")).alias("y_prob"))


_PRICE_SCORED = f"""
{oracle.features(HOUR)}, {oracle.drawdowns("features", (24,), (0.5,))},
price_scored AS (
  SELECT symbol, open_time, CAST({_LABEL} AS INTEGER) AS y_true, -drawdown_4h AS y_prob
  FROM labelled WHERE {_LABEL} IS NOT NULL)"""


@query(f"""
WITH {_PRICE_SCORED},
joined_rows AS (SELECT symbol, open_time, f.close, f.ret_1m, y_prob, CAST(y_true AS BIGINT) AS y_true
                FROM features f JOIN price_scored USING (symbol, open_time)),
sums AS (SELECT *, CASE WHEN count(ret_1m) OVER w >= 30 THEN sum(ret_1m) OVER w END AS cumret_30m
         FROM joined_rows WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS 29 PRECEDING))
SELECT symbol, open_time, y_true, {rounded(["close", "ret_1m", "y_prob", "cumret_30m"])} FROM sums""")
def hazard_diagnostics(spark, folder):
    features = _features(spark, folder, HOUR_MS)
    scored = _price_scored(spark, folder).select("symbol", "open_time", "y_prob", "y_true")
    return evaluate.hazard_diagnostics(features, scored, step_ms=HOUR_MS)


@query(f"""
WITH {_PRICE_SCORED}
SELECT symbol, open_time, y_true, round(y_prob, 6) + 0.0 AS y_prob, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred
FROM price_scored ORDER BY open_time DESC, symbol DESC LIMIT 1000""")
def last_predictions(spark, folder):
    scored = _price_scored(spark, folder).select("symbol", "open_time", "y_true", "y_prob")
    return model.last_predictions(scored, 0.5, 1000)


def _fitted(names: Sequence[str], steps: int = 12) -> str:
    """A fit on any number of features: Newton steps, each from one Gram matrix, solved by elimination."""
    k = len(names)
    values = ", ".join(f"CASE WHEN isfinite({c}) THEN {c} ELSE 0 END" for c in names)
    parts = [f"""
WITH RECURSIVE {oracle.features(HOUR)}, {oracle.drawdowns("features", (24,), (0.5,))},
numbered AS (
  SELECT symbol, open_time, CAST({_LABEL} AS INTEGER) AS y, [{values}] AS v,
         row_number() OVER (ORDER BY open_time, symbol) AS n, count(*) OVER () AS total
  FROM labelled WHERE {_LABEL} IS NOT NULL),
halves AS (SELECT *, n <= greatest(least(CAST(floor(total * CAST(0.7 AS DOUBLE)) AS BIGINT), total - 1), 1) AS is_train FROM numbered),
scale AS (
  SELECT i, avg(v[i]) AS m, CASE WHEN stddev_pop(v[i]) = 0 THEN 1 ELSE stddev_pop(v[i]) END AS s
  FROM halves, range(1, {k + 1}) AS u(i) WHERE is_train GROUP BY i),
scales AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM scale),
scaled AS MATERIALIZED (
  SELECT symbol, open_time, y, is_train, list_prepend(CAST(1 AS DOUBLE), [(v[i] - m[i]) / s[i] FOR i IN range(1, {k + 1})]) AS x
  FROM halves, scales),
w0 AS (SELECT [CAST(0 AS DOUBLE) FOR i IN range({k + 1})] AS w)"""]
    for t in range(1, steps + 1):
        parts.append(f"""
p{t} AS MATERIALIZED (SELECT y, x, w, 1 / (1 + exp(-list_dot_product(x, w))) AS p FROM scaled, w{t - 1} WHERE is_train),
g{t} AS (
  SELECT r, c, CASE WHEN c <= {k + 1} THEN sum(p * (1 - p) * x[r] * x[least(c, {k + 1})]) ELSE sum((p - y) * x[r]) + CASE WHEN r > 1 THEN any_value(w[r]) ELSE 0 END END
               + CASE WHEN r = c AND r > 1 THEN 1 ELSE 0 END AS v
  FROM p{t}, range(1, {k + 2}) AS a(r), range(1, {k + 3}) AS b(c) GROUP BY r, c),
lines{t} AS (SELECT r, list(v ORDER BY c) AS line FROM g{t} GROUP BY r),
solve{t} AS (
  SELECT CAST(1 AS BIGINT) AS m, list(line ORDER BY r) AS a FROM lines{t}
  UNION ALL
  SELECT m + 1, [[CASE WHEN r = m THEN a[m][c] / a[m][m] ELSE a[r][c] - a[r][m] * a[m][c] / a[m][m] END FOR c IN range(1, {k + 3})] FOR r IN range(1, {k + 2})]
  FROM solve{t} WHERE m <= {k + 1}),
w{t} AS MATERIALIZED (SELECT [w[i] - a[i][{k + 2}] FOR i IN range(1, {k + 2})] AS w FROM solve{t}, w{t - 1} WHERE m = {k + 2})""")
    parts.append(f"""
coefs AS (SELECT [{", ".join(repr(c) for c in names)}][i] AS feature, w[i + 1] AS coef FROM w{steps}, range(1, {k + 1}) AS u(i)),
scored AS (SELECT symbol, open_time, is_train, y AS y_true, 1 / (1 + exp(-list_dot_product(x, w))) AS y_prob FROM scaled, w{steps})""")
    return ",".join(parts)


_FULL = _fitted(SCALE_FREE_FEATURES)


@query(
    f"""{_FULL}
SELECT feature, round(coef, 3) + 0.0 AS coef, round(abs(coef), 3) + 0.0 AS abs_coef,
       CAST(row_number() OVER (ORDER BY abs(coef) DESC) AS INTEGER) AS rank FROM coefs""",
    digits=3,
)
def hazard_coefficients(spark, folder):
    """Train on the first 70 % of labelled hours; coefficients by absolute value."""
    train, _ = model.temporal_split(_labelled(spark, folder), 0.7)
    names = list(SCALE_FREE_FEATURES)
    return model.coefficient_ranking(model.fit_logistic(train, names), names, spark)


@query(f"{_FULL} SELECT symbol, open_time, y_true, round(y_prob, 3) + 0.0 AS y_prob FROM scored WHERE NOT is_train", digits=3)
def hazard_out_of_sample(spark, folder):
    """Train on the first 70 % of labelled hours and score the rest."""
    train, test = model.temporal_split(_labelled(spark, folder), 0.7)
    names = list(SCALE_FREE_FEATURES)
    return model.predict(model.fit_logistic(train, names), test, names)


_RANKED_SCORES = """
per_score AS (SELECT y_prob AS s, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM tested GROUP BY ALL),
ranked_scores AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM per_score),
ranks AS (SELECT sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc FROM ranked_scores)"""


@query(
    f"""{_FULL}, tested AS (SELECT * FROM scored WHERE NOT is_train), {_RANKED_SCORES},
cells AS (
  SELECT count(*) AS n_rows, avg(y_true) AS base_rate, count(*) FILTER (y_true = 0 AND y_prob < 0.5) AS tn,
         count(*) FILTER (y_true = 0 AND y_prob >= 0.5) AS fp, count(*) FILTER (y_true = 1 AND y_prob < 0.5) AS fn,
         count(*) FILTER (y_true = 1 AND y_prob >= 0.5) AS tp
  FROM tested)
SELECT n_rows, round(base_rate, 3) + 0.0 AS base_rate, tn, fp, fn, tp,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 3) + 0.0 AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 3) + 0.0 AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 3) + 0.0 AS f1,
       round(roc_auc, 3) + 0.0 AS roc_auc, round(pr_auc, 3) + 0.0 AS pr_auc
FROM cells, ranks""",
    digits=3,
)
def hazard_test_metrics(spark, folder):
    """Rank and threshold metrics of the out-of-sample scores."""
    scored = written(hazard_out_of_sample(spark, folder), "scored")
    ranks = evaluate.rank_metrics(scored)
    row = ranks.select(F.struct(*ranks.columns)).scalar()
    return evaluate.threshold_metrics(scored, 0.5).withColumn("_ranks", row).select("*", "_ranks.*").drop("_ranks")


def _trained(spark: SparkSession, folder: str, ratio: float) -> tuple[str, dict]:
    """The labelled hours as a table, and what the training job says of them."""
    place = f"{shared_dir(spark)}/hazard-{uuid.uuid4().hex}"
    tables.write_table(_modelling(spark, folder), f"{place}/hours")
    config = jobs.TrainConfig(f"{place}/hours", _LABEL, f"{place}/models", "ALL", ratio, feature_set="scalefree")
    return place, jobs.train_hazard_logistic(spark, config)


@query(f"{_FULL} SELECT symbol, open_time, y_true, round(y_prob, 3) + 0.0 AS y_prob FROM scored", digits=3)
def hazard_saved_scores(spark, folder):
    """A model trained, saved with its manifest, loaded by the scoring job, and its scores read from CSV."""
    place, done = _trained(spark, folder, 0.7)
    config = jobs.InferConfig(f"{place}/hours", _LABEL, done["label_dir"], f"{place}/scores", feature_set="scalefree")
    jobs.infer_hazard(spark, config)
    return spark.read.csv(f"{place}/scores/oos_probs", header=True, schema="symbol string, open_time bigint, y_true int, y_prob double")


@query(
    f"""{_FULL}
SELECT count(*) AS n_rows_total_labeled, count(*) FILTER (is_train) AS n_rows_train, count(*) FILTER (NOT is_train) AS n_rows_test,
       count(DISTINCT y_true) AS classes, round(avg(y_true) FILTER (NOT is_train), 3) + 0.0 AS base_rate_test FROM scored""",
    digits=3,
)
def hazard_run_counts(spark, folder):
    """Counts of the training job, read back from its metrics file."""
    place, done = _trained(spark, folder, 0.7)
    metrics = spark.read.json(f"{done['run_dir']}/metrics.json", multiLine=True)
    labels = spark.read.parquet(f"{place}/hours").select(F.count_distinct(_LABEL).alias("classes"))
    return metrics.select(
        "n_rows_total_labeled", "n_rows_train", "n_rows_test", labels.scalar().alias("classes"), "base_rate_test"
    )


_TWO = ("drawdown_4h", "imbalance")


def _newton(steps: int) -> str:
    """Newton steps of the penalised likelihood of a constant and two scaled features, each a query."""
    parts = ["w0 AS (SELECT CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS v)"]
    for k in range(1, steps + 1):
        parts.append(f"""
q{k} AS (SELECT y, a, b, c, u, v, 1 / (1 + exp(-(c + u * a + v * b))) AS p FROM fit_rows, w{k - 1}),
g{k} AS (SELECT c, u, v, sum(p - y) AS g0, sum((p - y) * a) + u AS g1, sum((p - y) * b) + v AS g2,
                sum(p * (1 - p)) AS h00, sum(p * (1 - p) * a) AS h01, sum(p * (1 - p) * b) AS h02,
                sum(p * (1 - p) * a * a) + 1 AS h11, sum(p * (1 - p) * a * b) AS h12, sum(p * (1 - p) * b * b) + 1 AS h22
         FROM q{k} GROUP BY c, u, v),
d{k} AS (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM g{k}),
w{k} AS MATERIALIZED (
  SELECT c - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS c,
         u - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS u,
         v - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS v
  FROM d{k})""")
    return ",".join(parts)


_FITTED = f"""
WITH {oracle.features(HOUR)}, {oracle.drawdowns("features", (24,), (0.5,))},
numbered AS (
  SELECT symbol, open_time, CAST({_LABEL} AS INTEGER) AS y,
         CASE WHEN isfinite({_TWO[0]}) THEN {_TWO[0]} ELSE 0 END AS x1,
         CASE WHEN isfinite({_TWO[1]}) THEN {_TWO[1]} ELSE 0 END AS x2,
         row_number() OVER (ORDER BY open_time, symbol) AS k, count(*) OVER () AS total
  FROM labelled WHERE {_LABEL} IS NOT NULL),
halves AS (SELECT *, k <= greatest(least(CAST(floor(total * CAST(0.7 AS DOUBLE)) AS BIGINT), total - 1), 1) AS is_train FROM numbered),
scale AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM halves WHERE is_train),
scaled AS MATERIALIZED (SELECT symbol, open_time, y, is_train, (x1 - m1) / s1 AS a, (x2 - m2) / s2 AS b FROM halves, scale),
fit_rows AS MATERIALIZED (SELECT y, a, b FROM scaled WHERE is_train),
{_newton(10)}"""


@query(
    f"""{_FITTED}, coefs AS (SELECT '{_TWO[0]}' AS feature, u AS coef FROM w10 UNION ALL SELECT '{_TWO[1]}', v FROM w10)
SELECT feature, round(coef, 3) + 0.0 AS coef, round(abs(coef), 3) + 0.0 AS abs_coef,
       CAST(row_number() OVER (ORDER BY abs(coef) DESC) AS INTEGER) AS rank FROM coefs""",
    digits=3,
)
def hazard_two_coefficients(spark, folder):
    """A fit on two features, which SQL can follow step by step."""
    train, _ = model.temporal_split(_labelled(spark, folder), 0.7)
    return model.coefficient_ranking(model.fit_logistic(train, _TWO), _TWO, spark)


_TWO_SCORED = f"""{_FITTED},
scored AS (SELECT symbol, open_time, y AS y_true, 1 / (1 + exp(-(c + u * a + v * b))) AS y_prob FROM scaled, w10 WHERE NOT is_train)"""


@query(f"{_TWO_SCORED} SELECT symbol, open_time, y_true, round(y_prob, 3) + 0.0 AS y_prob FROM scored", digits=3)
def hazard_two_scores(spark, folder):
    """The scaler, the fit and the scores of the rows after the split."""
    train, test = model.temporal_split(_labelled(spark, folder), 0.7)
    return model.predict(model.fit_logistic(train, _TWO), test, _TWO)


# --- profile -----------------------------------------------------------------------------

_PROFILED = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
)
_LONG = f"""
long AS (UNPIVOT (SELECT {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _PROFILED)} FROM lineitem)
         ON {", ".join(_PROFILED)} INTO NAME "column" VALUE x),
prof AS (
  SELECT "column", count(x) AS "count", count(*) - count(x) AS missing, count(DISTINCT x) AS "distinct",
         avg(x) AS mean, stddev_samp(x) AS std, min(x) AS "min", quantile_cont(x, 0.25) AS q25,
         quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS "max"
  FROM long GROUP BY "column")"""


@query(f"""
WITH {_LONG}
SELECT "column", "count", missing, "distinct", {rounded(["mean", "std", '"min"', "q25", "q50", "q75", '"max"'])}
FROM prof""")
def profile_columns(spark, folder):
    """All numeric columns."""
    return profile.describe(table(spark, folder, "lineitem"))


@query(f"""
WITH {_LONG}
SELECT "column", "distinct" FROM prof WHERE "distinct" <= 60 ORDER BY "distinct", "column" LIMIT 30""")
def profile_few_values(spark, folder):
    return profile.few_values(profile.describe(table(spark, folder, "lineitem")), 60)


_EVENT_COLUMNS = (
    ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
    ("value", "double"), ("props", "string"),
)
_EVERY = " UNION ALL ".join(
    f"SELECT CAST({k} AS INTEGER) AS position, '{c}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, "
    f"count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\" FROM events"
    for k, (c, kind) in enumerate(_EVENT_COLUMNS)
)


@query(_EVERY)
def profile_all_columns(spark, folder):
    """Texts and times too."""
    return profile.all_columns(table(spark, folder, "events"))


@query(f"""SELECT "column", missing FROM ({_EVERY}) ORDER BY missing DESC, "column" LIMIT 20""")
def profile_most_missing(spark, folder):
    return profile.most_missing(profile.all_columns(table(spark, folder, "events")))


@query(f"""SELECT position, "column", type, n_rows FROM ({_EVERY})""")
def profile_shape(spark, folder):
    return profile.table_shape(table(spark, folder, "events"))


@query("""
SELECT 'l_linenumber' AS "column", CAST(l_linenumber AS DOUBLE) AS value, count(*) AS n_rows FROM lineitem GROUP BY ALL
UNION ALL
SELECT 'l_discount', l_discount, count(*) FROM lineitem GROUP BY ALL""")
def label_value_counts(spark, folder):
    return profile.value_counts(table(spark, folder, "lineitem"), ["l_linenumber", "l_discount"])


# --- streaming ---------------------------------------------------------------------------


@query(f"""
WITH {oracle.bars(MINUTE)},
mark AS (SELECT max(time) - 600000 AS final_until FROM trades)
SELECT symbol, open_time, n_trades, {rounded(_BAR)} FROM bars, mark
WHERE open_time + {MINUTE} <= final_until""")
def streaming_minute_bars(spark, folder):
    """Trades read as a stream; bars are final once the watermark has passed them."""
    schema = table(spark, folder, "events").schema
    events = read_trade_stream(spark, folder, schema, "events.parquet")
    run = f"{shared_dir(spark)}/minute_bars-{uuid.uuid4().hex}"
    bars = streaming_trade_bars(inputs.as_trades(events))
    write_bars(bars, f"{run}/bars", f"{run}/checkpoint").awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{run}/bars")


@query(f"""
WITH {oracle.bars(MINUTE)},
mark AS (SELECT max(time) - 600000 AS final_until FROM trades)
SELECT symbol, open_time, n_trades, {rounded(_BAR)} FROM bars, mark
WHERE open_time + {MINUTE} <= final_until""")
def streaming_bars_without_ids(spark, folder):
    """Trades of a layout without ids: each counts."""
    schema = table(spark, folder, "events").schema
    events = read_trade_stream(spark, folder, schema, "events.parquet")
    run = f"{shared_dir(spark)}/minute_bars-{uuid.uuid4().hex}"
    trades = inputs.as_trades(events).withColumn("trade_id", F.lit(None).cast("long"))
    bars = streaming_trade_bars(trades)
    write_bars(bars, f"{run}/bars", f"{run}/checkpoint").awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{run}/bars")
