"""Causal z-scores: every row is measured against earlier rows only."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import MINUTE_MS, base_feature_columns, div, finite, numeric_columns
from ..functions.schema import TARGET_PREFIXES
from .sliding import previous_moments
from .ordered import (
    ROWS_PER_CHUNK,
    chunked_by_rows,
    expanding_moments,
    mean_of,
    std_of,
    with_halo,
    with_row_index,
)

MODES = ("expanding", "rolling")
# Group names for rows without a symbol and tables without the column.
MISSING_SYMBOL = "__MISSING_SYMBOL__"
ALL_ROWS = "__ALL__"


def _check(mode: str, window: int, min_periods: int, eps: float) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if window <= 0 or min_periods <= 0 or eps <= 0:
        raise ValueError("window, min_periods and eps must be greater than 0")


def causal_z(
    df: DataFrame,
    columns: Sequence[str],
    mode: str = "expanding",
    window: int = 1440,
    min_periods: int = 60,
    eps: float = 1e-12,
    by_symbol: bool = True,
    order: Sequence[str] = ("open_time",),
    step_ms: int = MINUTE_MS,
    strict_grid: bool = False,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add ``z_<c>`` and ``defaulted_<c>`` (too little history) for every column.

    ``z`` is 0 where the history is shorter than ``min_periods`` or the score is
    undefined.  An expanding history counts every earlier row, a rolling one the
    known values among the ``window`` earlier rows.  Without ``by_symbol`` all
    rows form one series, ordered by time over all symbols.
    """
    _check(mode, window, min_periods, eps)
    if not columns:
        raise ValueError("no numeric base feature columns")
    span = rows_per_chunk * step_ms
    if by_symbol and "symbol" in df.columns:
        work = df.withColumn("_series", F.coalesce(F.col("symbol").cast("string"), F.lit(MISSING_SYMBOL)))
    else:  # many symbols may share a time: chunks are cut by rows, not by time
        work = chunked_by_rows(df.withColumn("_series", F.lit(ALL_ROWS)), order, rows_per_chunk)
    if mode == "rolling":
        if strict_grid:
            work = work.withColumn("_row", div("open_time", step_ms))
        else:
            work = with_row_index(work, ["_series"], order, span, name="_row")
        work = with_halo(work, "_row", back=window, size=rows_per_chunk)
        return _rolling_z(work, columns, window, min_periods, eps).select(
            *df.columns, *[f"{kind}_{c}" for c in columns for kind in ("z", "defaulted")]
        )

    kinds = {c: k for k, c in enumerate(columns)}
    values = [_finite_text(c, f"_x{k}") for c, k in kinds.items()]
    moments = {f"_x{k}": f"_m{k}" for k in kinds.values()}
    work = work.selectExpr("*", *values)
    work = expanding_moments(work, moments, ["_series"], order, span, seen="_seen")
    raw = [
        f"CASE WHEN _m{k}_n >= {min_periods}"
        f" THEN (_x{k} - {mean_of(f'_m{k}')}) / ({std_of(f'_m{k}')} + {eps!r}D) END AS _z{k}"
        for k in kinds.values()
    ]
    out = []
    for c, k in kinds.items():
        out += [
            f"CASE WHEN abs(_z{k}) < double('infinity') THEN _z{k} ELSE 0.0D END AS `z_{c}`",
            f"_seen < {min_periods} AS `defaulted_{c}`",
        ]
    return work.selectExpr("*", *raw).selectExpr(*[f"`{c}`" for c in df.columns], *out)


def _finite_text(c: str, name: str) -> str:
    """``finite`` as SQL text: NaN counts as greater than infinity in Spark."""
    x = f"CAST(`{c}` AS DOUBLE)"
    return f"CASE WHEN abs({x}) < double('infinity') THEN {x} END AS {name}"


def _rolling_z(
    work: DataFrame, columns: Sequence[str], window: int, min_periods: int, eps: float
) -> DataFrame:
    """Rolling scores of one chunk at a time, in Arrow batches.

    Spark has no incremental sliding frame: it would aggregate ``window`` rows
    anew for every row and column.  Spark cuts, shuffles and bounds the chunks;
    numpy slides over the rows of one chunk.
    """
    passed = [c for c in work.columns if c not in ("_series", "_chunk", "_row", "_own")]
    fields = [work.schema[c] for c in passed]
    fields += [T.StructField(f"z_{c}", T.DoubleType(), False) for c in columns]
    fields += [T.StructField(f"defaulted_{c}", T.BooleanType(), False) for c in columns]

    def score(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("_row", kind="stable")
        own = chunk["_own"].to_numpy()
        values = chunk[list(columns)].to_numpy("float64", na_value=np.nan)
        known, mean, std = previous_moments(values, window)
        with np.errstate(all="ignore"):
            z = (values - mean) / (std + eps)
        z = np.where((known >= min_periods) & np.isfinite(z), z, 0.0)
        out = chunk.loc[own, passed]
        scores = pd.DataFrame(z[own], index=out.index, columns=[f"z_{c}" for c in columns])
        short = pd.DataFrame(
            known[own] < min_periods, index=out.index, columns=[f"defaulted_{c}" for c in columns]
        )
        return pd.concat([out, scores, short], axis=1)

    return work.groupBy("_series", "_chunk").applyInPandas(score, T.StructType(fields))


def zscore_features(df: DataFrame, **options) -> DataFrame:
    """Keys, other passthrough columns, then one z column per numeric feature.

    The base features themselves are replaced by their scores.
    """
    columns = base_feature_columns(df)
    return score_table(causal_z(df, columns, **options), columns)


def score_table(scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The finished table of scores that ``causal_z`` added for ``columns``."""
    made = {f"{kind}_{c}" for c in columns for kind in ("z", "defaulted")}
    first = [c for c in ("symbol", "open_time") if c in scored.columns]
    rest = [c for c in scored.columns if c not in columns and c not in first and c not in made]
    return scored.select(*first, *rest, *[f"z_{c}" for c in columns])


def defaulted_rows(df: DataFrame, **options) -> DataFrame:
    """Per z column the number of rows that fell back to 0 for want of history."""
    columns = base_feature_columns(df)
    return count_defaulted(causal_z(df, columns, **options), columns)


def count_defaulted(scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same of scores that ``causal_z`` has already added."""
    counts = scored.agg(
        *[F.count_if(f"defaulted_{c}").alias(f"z_{c}") for c in columns]
    )
    return counts.unpivot([], [f"z_{c}" for c in columns], "z_column", "defaulted_rows")


def zscore_dataset(df: DataFrame, **options) -> DataFrame:
    """The modelling table: time, symbol, forward-looking targets and z columns only.

    Any numeric column but the time counts as a feature, also one named ``z_...``.
    """
    columns = [
        c
        for c in numeric_columns(df)
        if c != "open_time" and not c.startswith(TARGET_PREFIXES)
    ]
    scored = causal_z(df, columns, **options)
    keys = [c for c in ("open_time", "symbol") if c in df.columns]
    targets = [c for c in df.columns if c.startswith(TARGET_PREFIXES)]
    return scored.select(*keys, *targets, *[f"z_{c}" for c in columns])

