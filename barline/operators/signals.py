"""Class labels and linear rules to signals, and thresholds to positions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finite, require_columns
from .ordered import ROWS_PER_CHUNK, with_previous

# The three classes and the directions they stand for.
DIRECTIONS = {1: -1, 2: 0, 3: 1}
STD_FLOOR = 1e-8


@dataclass(frozen=True)
class RuleModel:
    """Selected features and their weights, in order of absolute weight."""

    features: tuple[str, ...]
    weights: tuple[float, ...]


def class_direction(label: str | Column) -> Column:
    """Direction of a class; any other value, NULL included, fails the query."""
    label = F.col(label) if isinstance(label, str) else label
    chain = F
    for value, direction in DIRECTIONS.items():
        chain = chain.when(label == value, direction)
    text = F.concat(F.lit("unexpected class "), F.coalesce(label.cast("string"), F.lit("NULL")))
    return chain.otherwise(F.raise_error(text).cast("int"))


def standardize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Each feature to mean 0 and population deviation 1, by the table's own statistics."""
    clean = {c: finite(F.col(c).cast("double")) for c in features}
    stats = df.select(*[v.alias(c) for c, v in clean.items()]).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in features],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in features],
    ).first()
    scaled = {}
    for c in features:
        mean, std = stats[f"mean_{c}"], stats[f"std_{c}"]
        scaled[c] = clean[c] if mean is None else (clean[c] - mean) / (std or STD_FLOOR)
    return df.withColumns(scaled)


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Average absolute mean and average population deviation over the features."""
    clean = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in features])
    stats = clean.agg(
        *[F.abs(F.avg(c)).alias(f"mean_{c}") for c in features],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in features],
    )

    def average(kind: str) -> Column:
        parts = [F.col(f"{kind}_{c}") for c in features]
        total = reduce(add, [F.coalesce(p, F.lit(0.0)) for p in parts])
        return F.try_divide(total, reduce(add, [p.isNotNull().cast("int") for p in parts]))

    return stats.select(
        average("mean").alias("mean_abs"), average("std").alias("std_avg")
    )


def feature_correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Correlation of every feature with ``target``, 0 where undefined: (feature, position, corr).

    One pass: all covariances are aggregates of the same scan.
    """
    clean = df.select(F.col(target).cast("double").alias("_target"), *[
        finite(F.col(c).cast("double")).alias(c) for c in features
    ])
    spread = F.col("_spread")
    moments = clean.agg(
        F.stddev_pop("_target").alias("_spread"),
        *[F.covar_pop(c, "_target").alias(f"cov_{c}") for c in features],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in features],
    )
    wide = moments.select(
        *[
            F.coalesce(F.try_divide(F.col(f"cov_{c}"), F.col(f"std_{c}") * spread), F.lit(0.0)).alias(c)
            for c in features
        ]
    )
    place = {c: k for k, c in enumerate(features)}
    long = wide.unpivot([], list(features), "feature", "corr")
    positions = F.create_map(*[F.lit(v) for pair in place.items() for v in pair])
    return long.withColumn("position", positions[F.col("feature")])


def top_features(correlations: DataFrame, top_k: int) -> DataFrame:
    """The ``top_k`` features by absolute correlation, earlier columns first on ties."""
    return correlations.orderBy(F.abs("corr").desc(), "position").limit(top_k)


def fit_rule(df: DataFrame, features: Sequence[str], label: str, top_k: int = 10) -> RuleModel:
    require_columns(df, [label, *features], "training table")
    target = df.withColumn("_direction", class_direction(label))
    best = top_features(feature_correlations(target, features, "_direction"), top_k)
    rows = best.collect()  # at most one row per feature column
    return RuleModel(tuple(r.feature for r in rows), tuple(r["corr"] for r in rows))


def rule_score(model: RuleModel) -> Column:
    """Weighted sum of the model's features; NULL if one of them is missing."""
    parts = [
        finite(F.col(c).cast("double")) * F.lit(w) for c, w in zip(model.features, model.weights)
    ]
    return reduce(add, parts, F.lit(0.0))


def threshold_signal(score: str | Column, threshold: float | Column) -> Column:
    """1 above the threshold, -1 below its negative, else 0; a missing score gives 0."""
    score = F.col(score) if isinstance(score, str) else score
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(score > threshold, 1).when(score < -threshold, -1).otherwise(0)


def positions(
    df: DataFrame,
    signal: str = "signal",
    series: Sequence[str] = (),
    order: Sequence[str] = ("row_id",),
    span: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Hold each signal one row later: ``position``, and the one before it."""
    lagged = with_previous(df, signal, ["_held", "_held_before"], series, order, span)
    return lagged.withColumns(
        {
            "position": F.coalesce("_held", F.lit(0)),
            "previous_position": F.coalesce("_held_before", F.lit(0)),
        }
    ).drop("_held", "_held_before")
