"""Decisions taken on column names and types; none of them reads data."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of forward-looking columns, which are never features.
TARGET_PREFIXES = ("y_", "dd_min_", "future_min_close_")
KEY_COLUMNS = ("symbol", "open_time")

# The features that do not depend on the price level.
SCALE_FREE_FEATURES = (
    "ret_1m",
    "rv_5m",
    "rv_30m",
    "rv_4h",
    "spread_proxy",
    "imbalance",
    "buyer_aggressor_ratio",
    "vol_z_30m",
    "drawdown_4h",
)
FEATURE_SETS = ("all", "scalefree")


def clean_name(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "")


def clean_name_text(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.strip().lower())


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} misses required columns: {missing}")


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers and booleans, in table order."""
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]


def base_feature_columns(df: DataFrame, keys: Sequence[str] = KEY_COLUMNS) -> list[str]:
    """Numeric columns that are neither keys nor forward-looking."""
    return [
        c
        for c in numeric_columns(df)
        if c not in keys and not c.startswith(TARGET_PREFIXES)
    ]


def training_columns(df: DataFrame, feature_set: str = "all", z_only: bool = False) -> list[str]:
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"feature_set must be one of {FEATURE_SETS}")
    if z_only:
        return [c for c in numeric_columns(df) if c.startswith("z_")]
    if feature_set == "scalefree":
        return [c for c in SCALE_FREE_FEATURES if c in df.columns]
    return base_feature_columns(df)


def drawdown_names(
    horizons: Sequence[int], thresholds: Sequence[float]
) -> dict[int, tuple[str, str, dict[str, float]]]:
    """Per horizon: minimum column, drawdown column, and label name to threshold."""
    names = {}
    for h in horizons:
        labels = {f"y_dd_{round(t * 100)}p_H{h}m": t for t in thresholds}
        if len(labels) < len(set(thresholds)):
            raise ValueError(f"thresholds {list(thresholds)} share a whole percentage")
        names[h] = (f"future_min_close_H{h}m", f"dd_min_H{h}m", labels)
    return names


def _values(given: str | Sequence) -> list:
    if isinstance(given, str):
        given = [part.strip() for part in given.split(",") if part.strip()]
    if not given:
        raise ValueError("the list must hold at least one value")
    return list(given)


def parse_grid(given: str | Sequence[float]) -> list[float]:
    return [float(v) for v in _values(given)]


def positive_ints(given: str | Sequence[int]) -> list[int]:
    values = [int(v) for v in _values(given)]
    if any(v <= 0 for v in values):
        raise ValueError("every value must be greater than 0")
    return values


def unit_floats(given: str | Sequence[float]) -> list[float]:
    values = parse_grid(given)
    if any(not 0.0 < v < 1.0 for v in values):
        raise ValueError("every value must lie strictly between 0 and 1")
    return values
