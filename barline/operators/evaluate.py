"""Evaluation of scored rows: ``y_true`` in {0, 1} and ``y_prob``.

Everything that needs an order works on distinct scores with their class counts,
which a partial aggregation shrinks before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_double, finite, open_time_ms, require_columns
from ..session import written
from .dedup import keep_last
from .ordered import (
    ROWS_PER_CHUNK,
    quantiles,
    with_halo,
    with_previous,
    with_row_index,
    with_sums_below,
    without_halo,
)


def known_scores(scored: DataFrame) -> DataFrame:
    """Rows with a finite score and a class; no measure here is defined for others."""
    return scored.where(finite(F.col("y_prob").cast("double")).isNotNull() & F.col("y_true").isin(0, 1))


def missing_scores(scored: DataFrame) -> DataFrame:
    """How many rows ``known_scores`` leaves out."""
    known = finite(F.col("y_prob").cast("double")).isNotNull() & F.col("y_true").isin(0, 1)
    return scored.agg(F.count_if(~F.coalesce(known, F.lit(False))).alias("n_missing_scores"))


def score_counts(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct known score."""
    return known_scores(scored).groupBy("y_prob").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"),
        F.count_if(F.col("y_true") == 0).alias("neg"),
    )


def rank_metrics(scored: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """ROC AUC (ties count half) and average precision (step sum); NULL if undefined.

    Rows without a score or a class are left out; ``missing_scores`` counts them.
    """
    counts = score_counts(scored).withColumn("_down", -F.col("y_prob"))
    # smaller negative scores are larger scores: the sums cover all rows ranked above
    ranked = with_sums_below(counts, [], "_down", ["pos", "neg"], rows_per_chunk)
    pos, neg = F.col("pos"), F.col("neg")
    hits = F.col("pos_below") + pos
    shown = hits + F.col("neg_below") + neg
    return ranked.agg(
        F.sum(pos).alias("_p"),
        F.sum(neg).alias("_n"),
        F.sum(neg * (F.col("pos_below") + pos / 2)).alias("_pairs"),
        F.sum(pos * hits / shown).alias("_precision"),
    ).select(
        F.try_divide("_pairs", F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"),
        F.when(F.col("_n") + F.col("_p") > 0, F.coalesce(F.try_divide("_precision", "_p"), F.lit(0.0))).alias(
            "pr_auc"
        ),
    )


def threshold_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion matrix, precision, recall and F1 at a cut of ``y_prob >= threshold``."""
    cut = F.col("y_prob") >= F.lit(threshold)
    true = F.col("y_true") == 1

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        scored.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg(F.col("y_true").cast("double")).alias("base_rate"),
            F.count_if(~true & ~cut).alias("tn"),
            F.count_if(~true & cut).alias("fp"),
            F.count_if(true & ~cut).alias("fn"),
            F.count_if(true & cut).alias("tp"),
        )
        .withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn)})
        .withColumn("f1", share(2 * tp, 2 * tp + fp + fn))
    )


def mean_prob_by_class(scored: DataFrame) -> DataFrame:
    """Mean probability of true negatives and positives, NULL for an absent class."""
    return scored.agg(
        F.avg(F.when(F.col("y_true") == 0, F.col("y_prob"))).alias("mean_prob_when_y0"),
        F.avg(F.when(F.col("y_true") == 1, F.col("y_prob"))).alias("mean_prob_when_y1"),
    )


def calibration_bins(
    scored: DataFrame, bins: int = 10, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Mean predicted against observed rate in quantile bins; empty bins are absent.

    The bin edges are exact quantiles, found from cumulative counts of distinct scores,
    which are written once and read by every step.  Rows without a score or a class are left out.
    """
    counts = written(score_counts(scored).withColumn("rows", F.col("pos") + F.col("neg")), "counts")
    total = counts.agg(F.sum("rows").alias("n")).select("n").scalar()
    ranked = with_sums_below(counts, [], "y_prob", ["rows"], rows_per_chunk)
    inner = [k / bins for k in range(1, bins)]
    edges = quantiles(ranked.withColumn("_n", total), [], "y_prob", "rows", inner).scalar()
    bin_no = F.size(F.filter(F.col("_edges"), lambda e: e < F.col("y_prob")))
    return (
        counts.withColumn("_edges", edges)
        .groupBy(bin_no.alias("bin"))
        .agg(
            F.sum("rows").alias("n_rows"),
            (F.sum(F.col("y_prob") * F.col("rows")) / F.sum("rows")).alias("mean_predicted"),
            (F.sum("pos") / F.sum("rows")).alias("observed_rate"),
        )
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal-width bins from minimum to maximum; the last bin is closed.

    A single value gets a range of width 1 around it, as does numpy's histogram.
    """
    values = df.select(finite(F.col(value).cast("double")).alias("x")).where("x IS NOT NULL")
    flat = F.when(F.min("x") == F.max("x"), F.lit(0.5)).otherwise(F.lit(0.0))
    limits = values.agg(
        F.struct((F.min("x") - flat).alias("low"), (F.max("x") + flat).alias("high")).alias("l")
    ).scalar()
    low, width = F.col("l.low"), (F.col("l.high") - F.col("l.low")) / bins
    number = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("int")
    counted = (
        values.withColumn("l", limits)
        .groupBy(number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.withColumn("l", limits).join(counted, "bin", "left").select(
        "bin",
        (low + width * F.col("bin")).alias("bin_low"),
        (low + width * (F.col("bin") + 1)).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n_rows"),
    )


def hazard_diagnostics(
    features: DataFrame,
    scored: DataFrame,
    keys: tuple[str, ...] = ("symbol",),
    window: int = 30,
    step_ms: int = 60_000,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Close, probability, return and ``window``-row return sum per scored minute.

    The sum counts joined rows, not minutes, so rows are numbered after the join.
    """
    require_columns(features, [*keys, "open_time", "close"], "feature table")
    require_columns(scored, [*keys, "open_time", "y_prob", "y_true"], "probability table")
    left = one_row_per_time(features, ["close"], keys)
    right = one_row_per_time(scored, ["y_prob", "y_true"], keys)
    span = rows_per_chunk * step_ms
    if "ret_1m" in left.columns:
        left = left.withColumn("ret_1m", finite(F.col("ret_1m").cast("double")))
    else:
        left = with_log_return(left, keys, span)
    left = left.select(*keys, "open_time", "close", "ret_1m")
    right = right.select(*keys, "open_time", "y_prob", F.col("y_true").cast("bigint").alias("y_true"))
    joined = left.join(right, [*keys, "open_time"])
    numbered = with_row_index(joined, keys, ["open_time"], span)
    work = with_halo(numbered, "row_index", back=window - 1, size=rows_per_chunk)
    frame = (
        Window.partitionBy(*keys, "_chunk").orderBy("row_index").rowsBetween(-(window - 1), 0)
    )
    known = F.count("ret_1m").over(frame)
    work = work.withColumn(
        f"cumret_{window}m", F.when(known >= window, F.sum("ret_1m").over(frame))
    )
    return without_halo(work).drop("row_index")


def one_row_per_time(
    df: DataFrame, needed: list[str], keys: tuple[str, ...], position: str = "position"
) -> DataFrame:
    """Rows with a time and all needed values, one per time: the last by position where rows have one,
    else the one of the greatest values, so that a repeated time never multiplies in a join."""
    clean = df.withColumns(
        {
            "open_time": open_time_ms(df),
            **{c: finite(as_double(df, c)) for c in needed},
        }
    ).na.drop(subset=["open_time", *needed])
    if position in clean.columns:
        return keep_last(clean, [*keys, "open_time"], [position])
    return keep_last(clean, [*keys, "open_time"], needed)


def with_log_return(df: DataFrame, keys: tuple[str, ...], span: int) -> DataFrame:
    lagged = with_previous(
        df.withColumn("_ln", finite(F.ln("close"))), "_ln", ["_ln_before"], keys, ["open_time"], span
    )
    return lagged.withColumn("ret_1m", F.col("_ln") - F.col("_ln_before")).drop("_ln", "_ln_before")
