"""The user-facing jobs: read tables, run the operators, write tables and sidecars."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    MINUTE_MS,
    as_double,
    base_feature_columns,
    day_bounds_ms,
    drawdown_names,
    finite,
    open_time_ms,
    parse_grid,
    positive_ints,
    require_columns,
    training_columns,
    unit_floats,
)
from ..operators import backtest as bt
from ..operators import evaluate, model, signals, zscore
from ..operators.bars import check_grid, join_bars, trade_bars
from ..operators.dedup import keep_last
from ..operators.features import FEATURE_COLUMNS, GRID_COLUMNS, LONG, MEDIUM, SHORT, bar_features
from ..operators.labels import drawdown_labels
from ..session import owned_tables, written
from ..sources import raw_files, tables


@dataclass(frozen=True)
class MergeConfig:
    root: str  # holds spot/<daily|monthly>/<trades|klines>/<symbol>
    out: str
    symbols: tuple[str, ...]
    trades_only: bool = False


@dataclass(frozen=True)
class FeatureConfig:
    klines: str
    trades: str
    out: str
    start_date: str
    end_date: str
    symbol: str | None = None  # for tables without one
    step_ms: int = MINUTE_MS
    by_date: bool = False  # partitioned by symbol and day; a later run replaces its own days only


@dataclass(frozen=True)
class LabelConfig:
    features: str
    out: str
    start_date: str
    end_date: str
    horizons: tuple[int, ...]
    thresholds: tuple[float, ...]
    symbol: str | None = None
    step_ms: int = MINUTE_MS


@dataclass(frozen=True)
class ZScoreConfig:
    table: str
    out: str
    mode: str = "expanding"
    window: int = 1440
    min_periods: int = 60
    eps: float = 1e-12
    start_date: str | None = None
    end_date: str | None = None
    by_symbol: bool = True
    step_ms: int = MINUTE_MS


@dataclass(frozen=True)
class TrainConfig:
    dataset: str
    label: str
    out: str
    symbol: str
    train_ratio: float
    feature_set: str = "all"
    z_only: bool = False
    threshold: float = 0.5


@dataclass(frozen=True)
class InferConfig:
    dataset: str
    label: str
    model_dir: str
    out: str
    feature_set: str = "all"
    z_only: bool = False


@dataclass(frozen=True)
class ExperimentConfig:
    label: str = "148"
    cost: float = 0.01
    strategy: str = "both"
    thresholds: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)
    top_k: int = 10
    annualization: float | None = None
    standardize: bool = False
    features: tuple[str, ...] = field(default=tables.WIDE_FEATURES, repr=False)


def job(work: Callable) -> Callable:
    """A job on a session: the tables it writes in between go when it ends, or fails."""

    @functools.wraps(work)
    def run(spark: SparkSession, *args, **options):
        with owned_tables(spark):
            return work(spark, *args, **options)

    return run


@job
def merge_raw(spark: SparkSession, config: MergeConfig) -> dict:
    """Raw candle and trade files of all symbols to one sorted table each, and a row for each file.

    ``<out>/klines_1m.parquet`` and ``<out>/trades.parquet`` are in order of symbol and time over
    all their files.  ``<out>/files.parquet`` tells of every file how many rows it held and how many
    were kept, or why it was left out.  Symbols without files are listed, not an error.
    """
    if not config.symbols:
        raise ValueError("no symbols to merge")
    reports, written_to = [], {}
    if not config.trades_only:
        files = raw_files.kline_files(spark, config.root, config.symbols)
        if files:
            merged = raw_files.merge_kline_files(spark, files)
            written_to["klines"] = f"{config.out}/klines_1m.parquet"
            tables.write_sorted(merged.rows, written_to["klines"], ["symbol", "open_time"], ["symbol", *raw_files.KLINE_OUTPUT])
            reports.append(merged.report)
    files = raw_files.trade_files(spark, config.root, config.symbols)
    if files:
        merged = raw_files.merge_trade_files(spark, files)
        written_to["trades"] = f"{config.out}/trades.parquet"
        tables.write_trades(merged.rows, written_to["trades"])
        reports.append(merged.report)
    if not reports:
        raise ValueError(f"no raw files of {', '.join(config.symbols)} below {config.root}")
    tables.write_table(functools.reduce(DataFrame.unionByName, reports), f"{config.out}/files.parquet")
    report = spark.read.parquet(f"{config.out}/files.parquet")
    counts = merge_counts(report)
    summary = {
        **asdict(config),
        "tables": written_to,
        "counts": [r.asDict() for r in counts.orderBy("kind", "symbol").collect()],
        "symbols_without_files": sorted(set(config.symbols) - {r.symbol for r in counts.collect()}),
        "created_utc": tables.now_utc(),
    }
    tables.write_json(spark, f"{config.out}/merge.meta.json", summary)
    return summary


def merge_counts(report: DataFrame) -> DataFrame:
    """Files and rows of each kind and symbol, before and after repeats were dropped."""
    return report.groupBy("kind", "symbol").agg(
        F.count_if(F.col("grain") == "daily").alias("daily_files"),
        F.count_if(F.col("grain") == "monthly").alias("monthly_files"),
        F.count_if(F.col("error").isNotNull()).alias("failed_files"),
        F.sum("rows_read").alias("rows_read"),
        F.sum("rows_kept").alias("rows_kept"),
    )


def _check_symbols(candles: DataFrame, trades: DataFrame, symbol: str | None) -> None:
    """Tables of which only one has symbols would join nothing."""
    sides = ["symbol" in df.columns for df in (candles, trades)]
    if symbol is None and sides[0] != sides[1]:
        raise ValueError("only one of candles and trades has a symbol column: name the symbol")


def _with_symbol(df: DataFrame, symbol: str | None) -> DataFrame:
    fallback = F.lit(symbol or zscore.MISSING_SYMBOL)
    if "symbol" not in df.columns:
        return df.withColumn("symbol", fallback)
    return df.withColumn("symbol", F.coalesce(F.col("symbol").cast("string"), fallback))


def _in_range(df: DataFrame, start: str | None, end: str | None, what: str) -> DataFrame:
    """Rows of the inclusive range of days; a missing end leaves that side open."""
    work = df
    if start:
        work = work.where(F.col("open_time") >= day_bounds_ms(start, start)[0])
    if end:
        work = work.where(F.col("open_time") <= day_bounds_ms(end, end)[1])
    if work.isEmpty():
        raise ValueError(f"{what} has no rows from {start} to {end}")
    return work


def load_grid(spark: SparkSession, config: FeatureConfig) -> DataFrame:
    """Candles of the range as a checked strict grid; the last of repeated rows wins."""
    raw = tables.read_parquet_with_position(spark, config.klines)
    require_columns(raw, [c for c in GRID_COLUMNS if c != "symbol"], "candle table")
    prices = {c: finite(as_double(raw, c)) for c in ("open", "high", "low", "close", "volume")}
    work = _with_symbol(raw, config.symbol).withColumns({**prices, "open_time": open_time_ms(raw)})
    work = _in_range(work.na.drop(subset=["open_time"]), config.start_date, config.end_date, "candle table")
    grid = written(keep_last(work, ["symbol", "open_time"], ["position"]).select(*GRID_COLUMNS), "grid")
    check_grid(grid, config.step_ms)
    return grid


@job
def build_features_1m(spark: SparkSession, config: FeatureConfig) -> DataFrame:
    trades = spark.read.parquet(config.trades)
    _check_symbols(spark.read.parquet(config.klines), trades, config.symbol)
    grid = load_grid(spark, config)
    trades = _with_symbol(trades, config.symbol)
    bars = trade_bars(trades, config.step_ms, day_bounds_ms(config.start_date, config.end_date))
    features = bar_features(join_bars(grid, bars), config.step_ms)
    if config.by_date:
        tables.write_by_date(features, config.out)
        features = tables.read_by_date(spark, config.out)
    else:
        tables.write_table(features, config.out)
        features = spark.read.parquet(config.out)
    tables.write_json(
        spark,
        tables.sidecar_path(config.out),
        {
            **asdict(config),
            **_as_dict(time_span(features)),
            "windows_used": {
                "ret_1m_diff": 1,
                "rv_minutes": [SHORT, MEDIUM, LONG],
                "vol_z_30m": MEDIUM,
                "peak_close_4h": LONG,
            },
            "feature_columns": [c for c in FEATURE_COLUMNS if c not in ("symbol", "open_time")],
            "build_timestamp_utc": tables.now_utc(),
        },
    )
    return features


def time_span(table: DataFrame) -> DataFrame:
    """Number of rows, and first and last time, of a written table."""
    return table.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("open_time").alias("first_open_time"), F.max("open_time").alias("last_open_time")
    )


@job
def build_labels_drawdown(spark: SparkSession, config: LabelConfig) -> DataFrame:
    raw = spark.read.parquet(config.features)
    require_columns(raw, ["open_time", "close", "symbol"], "feature table")
    horizons, thresholds = positive_ints(config.horizons), unit_floats(config.thresholds)
    work = _with_symbol(raw, config.symbol).withColumns(
        {"open_time": open_time_ms(raw), "close": finite(as_double(raw, "close"))}
    ).na.drop(subset=["open_time", "close"])
    work = _in_range(work, config.start_date, config.end_date, "feature table")
    tables.write_table(
        drawdown_labels(work, horizons, thresholds, step_ms=config.step_ms), config.out
    )
    names = drawdown_names(horizons, thresholds)
    tables.write_json(
        spark,
        tables.sidecar_path(config.out),
        {
            **asdict(config),
            "label_columns": [c for n in names.values() for c in n[2]],
            "continuous_target_columns": [c for n in names.values() for c in n[:2]],
            "tail_behavior": "the last H rows of each horizon are NULL: their future is incomplete",
            "build_timestamp_utc": tables.now_utc(),
        },
    )
    return spark.read.parquet(config.out)


def _z_options(config: ZScoreConfig, has_symbol: bool) -> dict:
    return {
        "mode": config.mode,
        "window": config.window,
        "min_periods": config.min_periods,
        "eps": config.eps,
        "by_symbol": config.by_symbol,
        # rows of one time need an order where symbols form one series
        "order": ("open_time",) if config.by_symbol or not has_symbol else ("open_time", "symbol"),
        "step_ms": config.step_ms,
    }


def _timed(df: DataFrame, what: str) -> DataFrame:
    require_columns(df, ["open_time"], what)
    return df.withColumn("open_time", open_time_ms(df)).na.drop(subset=["open_time"])


@job
def build_features_zscore_1m(spark: SparkSession, config: ZScoreConfig) -> DataFrame:
    work = _timed(spark.read.parquet(config.table), "feature table")
    if config.start_date or config.end_date:
        work = _in_range(work, config.start_date, config.end_date, "feature table")
    columns = base_feature_columns(work)
    # scored once: the flags are counted from the written scores
    scored = written(zscore.causal_z(work, columns, **_z_options(config, "symbol" in work.columns)), "scored")
    tables.write_table(zscore.score_table(scored, columns), config.out)
    defaulted = {r.z_column: r.defaulted_rows for r in zscore.count_defaulted(scored, columns).collect()}
    tables.write_json(
        spark,
        tables.sidecar_path(config.out),
        {
            **asdict(config),
            "window": config.window if config.mode == "rolling" else None,
            "base_feature_columns": columns,
            "z_feature_columns": [f"z_{c}" for c in columns],
            "defaulted_rows_per_z_feature": defaulted,
            "created_utc": tables.now_utc(),
        },
    )
    return spark.read.parquet(config.out)


@job
def build_dataset_zscore_1m(spark: SparkSession, config: ZScoreConfig) -> DataFrame:
    work = _timed(spark.read.parquet(config.table), "feature table")
    scored = zscore.zscore_dataset(work, **_z_options(config, "symbol" in work.columns))
    tables.write_table(scored, config.out)
    columns = [c for c in scored.columns if c.startswith("z_")]
    tables.write_json(
        spark,
        tables.sidecar_path(config.out, replace=False),
        {
            **asdict(config),
            "base_feature_columns": [c[2:] for c in columns],
            "z_feature_columns": columns,
            "build_timestamp": tables.now_utc(),
        },
    )
    return spark.read.parquet(config.out)


def _as_dict(metrics: DataFrame) -> dict:
    return metrics.first().asDict()


@job
def train_hazard_logistic(spark: SparkSession, config: TrainConfig) -> dict:
    """Fit, save and evaluate; a ratio of 1 fits and scores all rows without a test."""
    if not 0.0 < config.train_ratio <= 1.0 or not 0.0 <= config.threshold <= 1.0:
        raise ValueError("train_ratio must be in (0, 1] and threshold in [0, 1]")
    raw = spark.read.parquet(config.dataset)
    require_columns(raw, [config.label, "open_time"], "dataset")
    names = training_columns(raw, config.feature_set, config.z_only)
    if not names:
        raise ValueError("the dataset has no usable feature columns")
    rows = model.labelled_rows(raw, config.label)
    full_fit = config.train_ratio == 1.0
    train, test = (rows, rows) if full_fit else model.temporal_split(rows, config.train_ratio)
    fitted = model.fit_logistic(train, names)

    label_dir, run = tables.run_dir(config.out, config.symbol, config.label, full_fit)
    model_name, manifest = tables.artifact_names(config.feature_set)
    fitted.write().overwrite().save(f"{label_dir}/{model_name}")
    tables.write_json(spark, f"{label_dir}/{manifest}", names)
    ranking = model.coefficient_ranking(fitted, names, spark)
    tables.write_csv(ranking.coalesce(1).orderBy("rank"), f"{run}/coefficients")

    # the scores are read many times below, so they are written once
    tables.write_table(model.predict(fitted, test, names), f"{run}/scored")
    scored = spark.read.parquet(f"{run}/scored")
    at_cut = _as_dict(evaluate.threshold_metrics(scored, config.threshold))
    total = rows.count()
    metrics = {
        **asdict(config),
        "full_fit": full_fit,
        "n_rows_total_labeled": total,
        "n_rows_train": total if full_fit else total - at_cut["n_rows"],
        "n_rows_test": 0 if full_fit else at_cut["n_rows"],
        "feature_cleaning": _as_dict(model.cleaning_counts(rows, names)),
    }
    if full_fit:
        tables.write_csv(scored.orderBy("open_time"), f"{run}/full_fit_probs")
        metrics["base_rate"] = at_cut["base_rate"]
    else:
        tables.write_csv(
            model.last_predictions(scored, config.threshold), f"{run}/predictions_sample"
        )
        tables.write_table(evaluate.calibration_bins(scored), f"{run}/calibration")
        tables.write_table(evaluate.histogram(scored, "y_prob", 40), f"{run}/prob_hist")
        metrics |= {
            "base_rate_test": at_cut["base_rate"],
            **_as_dict(evaluate.rank_metrics(scored)),
            **_as_dict(evaluate.missing_scores(scored)),
            "precision_at_threshold": at_cut["precision"],
            "recall_at_threshold": at_cut["recall"],
            "f1_at_threshold": at_cut["f1"],
            "confusion_matrix_labels_0_1": [
                [at_cut["tn"], at_cut["fp"]],
                [at_cut["fn"], at_cut["tp"]],
            ],
        }
    tables.write_json(spark, f"{run}/metrics.json", metrics)
    tables.write_json(
        spark,
        f"{run}/meta.json",
        {**asdict(config), "feature_list": names, "created_utc": tables.now_utc()},
    )
    return {"run_dir": run, "label_dir": label_dir, "metrics": metrics}


@job
def infer_hazard(spark: SparkSession, config: InferConfig) -> dict:
    """Score labelled rows of another table with a saved model."""
    model_name, manifest = tables.artifact_names(config.feature_set)
    path = f"{config.model_dir}/{manifest}"
    names = tables.feature_manifest(tables.read_json(spark, path), path)
    if config.z_only and any(not c.startswith("z_") for c in names):
        raise ValueError("z_only needs a model that was fitted on z_ columns alone")
    raw = spark.read.parquet(config.dataset)
    require_columns(raw, [config.label, "open_time"], "dataset")
    fitted = PipelineModel.load(f"{config.model_dir}/{model_name}")
    rows = model.labelled_rows(raw, config.label)
    tables.write_csv(model.predict(fitted, rows, names), f"{config.out}/oos_probs")
    scored = spark.read.csv(
        f"{config.out}/oos_probs",
        header=True,
        schema=_scored_schema(raw),
    )
    metrics = {
        "base_rate": scored.agg(F.avg("y_true")).first()[0],
        **_as_dict(evaluate.rank_metrics(scored)),
        **_as_dict(evaluate.mean_prob_by_class(scored)),
    }
    if metrics["base_rate"] is None:
        raise ValueError("no labelled rows to score")
    tables.write_json(spark, f"{config.out}/oos_metrics.json", metrics)
    return {
        "out": config.out,
        "metrics": metrics,
        "missing_columns": [c for c in names if c not in raw.columns],
    }


def _scored_schema(raw: DataFrame) -> str:
    symbol = "symbol string, " if "symbol" in raw.columns else ""
    return f"{symbol}open_time bigint, y_true int, y_prob double"


@job
def hazard_diagnostics(
    spark: SparkSession, features: str, probabilities: str, out: str, keys: tuple[str, ...] | None = None
) -> DataFrame:
    """Write the table behind the diagnostic charts; fails when nothing joins.

    Without ``keys`` rows join by symbol and time if both tables have symbols, by time if
    neither has; one table alone with symbols is an error.
    """
    left, right = tables.read_parquet_with_position(spark, features), tables.read_probabilities(spark, probabilities)
    if keys is None:
        sides = ["symbol" in df.columns for df in (left, right)]
        if sides[0] != sides[1]:
            raise ValueError("only one of features and probabilities has a symbol column: name the keys")
        keys = ("symbol",) if all(sides) else ()
    table = evaluate.hazard_diagnostics(left, right, keys)
    tables.write_table(table, out)
    written = spark.read.parquet(out)
    if written.isEmpty():
        raise ValueError("features and probabilities share no open_time")
    return written


def oracle_backtest(df: DataFrame, config: ExperimentConfig, **scan) -> DataFrame:
    """The label itself as signal: a ceiling, not a strategy."""
    direction = signals.class_direction(config.label)
    rows = df.select("row_id", direction.alias("signal"), direction.alias("realized_direction"))
    return bt.backtest(rows, config.cost, **scan)


def rule_rows(df: DataFrame, rule: signals.RuleModel, label: str) -> DataFrame:
    return df.select(
        "row_id",
        signals.rule_score(rule).alias("score"),
        signals.class_direction(label).alias("realized_direction"),
    )


def rule_backtest(
    df: DataFrame, rule: signals.RuleModel, threshold: float, config: ExperimentConfig, **scan
) -> DataFrame:
    rows = rule_rows(df, rule, config.label).withColumn(
        "signal", signals.threshold_signal("score", threshold)
    )
    return bt.backtest(written(rows, "signals"), config.cost, **scan)


def tune_rule(train: DataFrame, config: ExperimentConfig, **scan):
    """Fit the rule and pick its threshold on training rows alone."""
    rule = signals.fit_rule(train, config.features, config.label, config.top_k)
    sensitivity = bt.threshold_sensitivity(
        written(rule_rows(train, rule, config.label), "scores"),
        parse_grid(config.thresholds),
        config.cost,
        config.annualization,
        **scan,
    )
    best = bt.best_threshold(sensitivity).first().threshold
    return rule, best, sensitivity


@job
def run_experiment(
    spark: SparkSession, train: str, test: str, out: str, config: ExperimentConfig
) -> dict:
    """Oracle and rule strategy on train and test rows: PnL tables, chart tables, report."""
    if config.strategy not in ("oracle", "rule", "both"):
        raise ValueError("strategy must be oracle, rule or both")
    frames = {}
    for name, path in (("train", train), ("test", test)):
        # every step below reads the wide rows again, so their text is parsed once
        df = written(tables.read_wide_csv(spark, path), name)
        require_columns(df, [config.label, *config.features], f"{name} table")
        frames[name] = signals.standardize(df, config.features) if config.standardize else df
    stats = _as_dict(signals.feature_stats(frames["train"], config.features))
    report = {"config": {**asdict(config), "features": len(config.features)}, "train_features": stats}

    def evaluated(name: str, table: DataFrame) -> dict:
        tables.write_table(table, f"{out}/{name}")
        written = spark.read.parquet(f"{out}/{name}")
        if any(_as_dict(bt.domain_violations(written)).values()):
            raise ValueError(f"{name} breaks the value rules of a PnL table")
        tables.write_table(evaluate.histogram(written, "pnl", 50), f"{out}/{name}_pnl_hist")
        return _as_dict(bt.strategy_metrics(written, annualization=config.annualization))

    if config.strategy in ("oracle", "both"):
        for name, df in frames.items():
            report[f"oracle_{name}"] = evaluated(f"oracle_{name}", oracle_backtest(df, config))
    if config.strategy in ("rule", "both"):
        rule, best, sensitivity = tune_rule(frames["train"], config)
        shown = sensitivity.orderBy("threshold").select(
            "threshold", "sharpe_per_step", "total_pnl", "num_trades"
        )
        report["rule"] = {
            "selected_threshold": best,
            "selected_features": list(rule.features),
            "threshold_sensitivity": [r.asDict() for r in shown.collect()],
            **{
                f"{name}_metrics": evaluated(f"rule_{name}", rule_backtest(df, rule, best, config))
                for name, df in frames.items()
            },
        }
    tables.write_json(spark, f"{out}/report.json", report)
    return report
