"""Logistic drawdown-risk model: cleaning, temporal split, fit, score, ranking."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import as_double, finite, open_time_ms
from ..session import written
from .ordered import ROWS_PER_CHUNK, with_sums_below

PREDICTION_SAMPLE_ROWS = 5_000


def labelled_rows(df: DataFrame, label: str) -> DataFrame:
    """Rows with a time and a label; adds ``y_true``."""
    return df.withColumns(
        {"open_time": open_time_ms(df), "y_true": finite(as_double(df, label)).cast("int")}
    ).na.drop(subset=["open_time", "y_true"])


def cleaning_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Cells that are infinite or missing before, between and after cleaning."""

    def cells(test):
        flags = [test(F.col(c).cast("double")) for c in features]
        return F.coalesce(F.sum(reduce(add, [F.coalesce(f.cast("int"), F.lit(0)) for f in flags])), F.lit(0))

    def missing(c):
        return c.isNull() | F.isnan(c)

    cleaned = df.agg(
        cells(lambda c: F.abs(c) == float("inf")).alias("inf_count_before"),
        cells(missing).alias("nan_count_before"),
        cells(lambda c: finite(c).isNull()).alias("nan_count_after_inf_replace"),
        cells(lambda c: F.coalesce(finite(c), F.lit(0.0)).isNull()).alias("nan_count_after_fill"),
    )
    return cleaned


def clean_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exactly ``features`` as finite doubles: gaps and absent columns become 0, booleans 0 and 1."""
    present = set(df.columns)
    columns = {
        c: F.coalesce(finite(as_double(df, c)), F.lit(0.0)) if c in present else F.lit(0.0)
        for c in features
    }
    return df.withColumns(columns)


def temporal_split(
    df: DataFrame,
    train_ratio: float,
    ties: Sequence[str] = ("symbol",),
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """The first ``int(n * ratio)`` rows by time, and the rest; both at least one row.

    Rows are counted per time; only the rows that share the time of the cut are
    ordered, by ``ties`` and then by a hash of all their values, again by counts.
    Equal rows are told apart by number alone.  Jobs run while the plan is built.
    """
    counts = df.groupBy("open_time").agg(F.count(F.lit(1)).alias("rows"))
    n = counts.agg(F.sum("rows")).first()[0] or 0
    if n < 2:
        raise ValueError("at least 2 labelled rows are needed for a split")
    cut = min(max(int(n * train_ratio), 1), n - 1)
    ranked = with_sums_below(counts, [], "open_time", ["rows"], rows_per_chunk)
    at = ranked.where(
        (F.col("rows_below") < cut) & (F.col("rows_below") + F.col("rows") >= cut)
    ).first()
    time, inside = F.lit(at.open_time), cut - at.rows_below
    before, after = df.where(F.col("open_time") < time), df.where(F.col("open_time") > time)
    shared = df.where(F.col("open_time") == time)
    if inside == at.rows:
        return before.unionByName(shared), after
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_key{k}") for k, c in enumerate(ties) if c in df.columns]
    shared = shared.select("*", *keys, F.xxhash64(*df.columns).alias("_same"))
    order = [c for c in shared.columns if c.startswith("_key")] + ["_same"]
    copies = shared.groupBy(*order).agg(F.count(F.lit(1)).alias("rows"))
    place = with_sums_below(copies, [], order, ["rows"], rows_per_chunk)
    at = place.where((F.col("rows_below") < inside) & (F.col("rows_below") + F.col("rows") >= inside)).first()
    here, last = F.struct(*order), F.struct(*[F.lit(at[c]).alias(c) for c in order])
    equal = shared.where(here == last)
    nth = F.row_number().over(Window.partitionBy(*order).orderBy("_same"))
    equal = equal.withColumn("_nth", nth)
    first = shared.where(here < last).unionByName(equal.where(F.col("_nth") <= inside - at.rows_below).drop("_nth"))
    rest = shared.where(here > last).unionByName(equal.where(F.col("_nth") > inside - at.rows_below).drop("_nth"))
    return before.unionByName(first.select(df.columns)), rest.select(df.columns).unionByName(after)


def fit_logistic(train: DataFrame, features: Sequence[str], max_iter: int = 100, tol: float = 1e-10) -> PipelineModel:
    """Scale by population statistics, then an L2 logistic regression with unit C.

    Newton steps on the sum of losses plus half the squared length of the weights, the constant left
    out.  Each step is one pass that sums gradient and Hessian, (features + 2)^2 numbers, over tasks.
    """
    clean = clean_features(train, features)
    stats = clean.agg(
        F.count_distinct("y_true").alias("classes"),
        *[F.avg(c).alias(f"mean_{c}") for c in features],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in features],
    ).first()
    if stats.classes < 2:
        raise ValueError("the training labels hold a single class")
    scaled = [f"_scaled_{k}" for k in range(len(features))]
    terms = ", ".join(
        f"(`{c}` - {stats[f'mean_{c}']!r}D) / {(stats[f'std_{c}'] or 1.0)!r}D AS {s}"
        for c, s in zip(features, scaled)
    )
    scaler = SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__")
    # every step passes over these rows again, and they survive lost executors
    rows = written(scaler.transform(clean).select(F.array(*scaled).alias("x"), F.col("y_true").cast("double").alias("y")), "train")
    weights = _newton(rows, len(features), max_iter, tol)
    logistic = _logistic_model(train.sparkSession, weights)
    return PipelineModel(stages=[scaler, VectorAssembler(inputCols=scaled, outputCol="_features"), logistic])


def _derivatives(rows: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of losses, gradient and Hessian over all rows; the constant comes first."""
    n = len(weights)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + n + n * n)
        for batch in batches:
            x, y = batch.column("x"), batch.column("y").to_numpy()
            x = np.column_stack([np.ones(len(y)), x.flatten().to_numpy().reshape(len(y), n - 1)])
            z = x @ weights
            p = 1 / (1 + np.exp(-z))
            total[0] += (np.logaddexp(0, z) - y * z).sum()
            total[1 : n + 1] += x.T @ (p - y)
            total[n + 1 :] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["place", "value"])

    found = rows.mapInArrow(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(1 + n + n * n)
    for r in found.collect():
        total[r.place] = r.value
    # the penalty, which leaves the constant alone
    own = np.append(0.0, weights[1:])
    return total[0] + own @ own / 2, total[1 : n + 1] + own, total[n + 1 :].reshape(n, n) + np.diag(np.append(0.0, np.ones(n - 1)))


def _newton(rows: DataFrame, features: int, max_iter: int, tol: float) -> np.ndarray:
    weights = np.zeros(features + 1)
    loss, gradient, hessian = _derivatives(rows, weights)
    for _ in range(max_iter):
        step = np.linalg.solve(hessian, gradient)
        if np.abs(step).max() < tol:
            break
        after = _derivatives(rows, weights - step)
        while after[0] > loss + tol * abs(loss) and np.abs(step).max() > tol:  # too far: half the way
            step = step / 2
            after = _derivatives(rows, weights - step)
        weights = weights - step
        loss, gradient, hessian = after
    return weights


def _logistic_model(spark: SparkSession, weights: np.ndarray) -> LogisticRegressionModel:
    """Spark's own model of the given weights, so that it scores, saves and loads like any other."""
    found = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"logistic_{uuid.uuid4().hex[:12]}", _py2java(spark.sparkContext, Vectors.dense(weights[1:])), float(weights[0])
    )
    model = LogisticRegressionModel(found)
    model._resetUid(found.uid())
    model.setFeaturesCol("_features").setPredictionCol("_prediction")
    return model.setRawPredictionCol("_raw").setProbabilityCol("_probability")


def predict(
    model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Probability of class 1 per row: keys, ``y_true`` where known, ``y_prob``."""
    clean = clean_features(df, features)
    kept = [c for c in (*keep, "open_time", "y_true") if c in df.columns]
    probability = vector_to_array("_probability")[1].alias("y_prob")
    return model.transform(clean).select(*kept, probability)


def coefficient_ranking(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Coefficients on the scaled axis, ranked by absolute value."""
    pairs = [(f, float(c)) for f, c in zip(features, model.stages[-1].coefficients)]
    pairs.sort(key=lambda p: -abs(p[1]))
    rows = [(f, c, abs(c), k) for k, (f, c) in enumerate(pairs, 1)]
    return spark.createDataFrame(rows, "feature string, coef double, abs_coef double, rank int")


def last_predictions(
    scored: DataFrame, threshold: float = 0.5, n: int = PREDICTION_SAMPLE_ROWS
) -> DataFrame:
    """The last ``n`` predictions in time order, with the class at the threshold."""
    keys = [c for c in ("open_time", "symbol") if c in scored.columns]
    tail = scored.orderBy(*[F.desc(c) for c in keys]).limit(n)
    return tail.withColumn("y_pred", (F.col("y_prob") >= threshold).cast("int")).orderBy(*keys)
