"""Column profiles of a wide table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import finite, numeric_columns
from ..session import written
from .ordered import ROWS_PER_CHUNK, quantiles, with_sums_below


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) pairs; NaN and infinities count as missing."""
    wide = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "value")


def describe(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exact: bool = True,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Per numeric column: count, missing, distinct, mean, std, min, quartiles, max.

    Exact quartiles come from cumulative counts of distinct values, so no task
    holds a whole column; ``exact=False`` uses sketches and a single aggregation.
    """
    columns = list(columns or numeric_columns(df))
    long = _long(df, columns)
    stats = [
        F.count("value").alias("count"),
        (F.count(F.lit(1)) - F.count("value")).alias("missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    if not exact:
        return long.groupBy("column").agg(
            *stats,
            F.approx_count_distinct("value").alias("distinct"),
            F.percentile_approx("value", [0.25, 0.5, 0.75], 10_000).alias("quartiles"),
        ).select(*_names())
    # every (column, value) is shuffled once; all that follows reads its written count
    counts = written(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows")), "counts")
    known = F.col("value").isNotNull()
    n, x = F.col("rows"), F.col("value")
    totals = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(known, n)), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("missing"),
        F.count("value").alias("distinct"),
        (F.sum(x * n) / F.sum(F.when(known, n))).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    totals = written(totals, "totals")  # one row per column of the table, so broadcasts are bounded by its width
    spread = (
        counts.where(known)
        .join(F.broadcast(totals.select("column", "mean", "count")), "column")
        .groupBy("column")
        .agg(F.try_divide(F.sum((x - F.col("mean")) ** 2 * n), F.first("count") - 1).alias("_var"))
    )
    ranked = with_sums_below(counts.where(known), ["column"], "value", ["rows"], rows_per_chunk)
    ranked = ranked.join(F.broadcast(totals.select("column", F.col("count").alias("_n"))), "column")
    quartiles = quantiles(ranked, ["column"], "value", "rows", [0.25, 0.5, 0.75])
    return (
        totals.join(F.broadcast(spread.select("column", F.sqrt("_var").alias("std"))), "column", "left")
        .join(F.broadcast(quartiles.withColumnRenamed("quantiles", "quartiles")), "column", "left")
        .select(*_names())
    )


def all_columns(df: DataFrame) -> DataFrame:
    """Every column, texts and times included: place, type, rows, missing and distinct values.

    NULL and, in numbers, NaN and infinities are missing.  Values are compared by their text.
    """
    
    def text(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        number = isinstance(field.dataType, (T.DoubleType, T.FloatType))
        return (finite(column) if number else column).cast("string").alias(field.name)

    wide = df.select(*[text(f) for f in df.schema])
    counts = wide.unpivot([], list(df.columns), "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    found = counts.groupBy("column").agg(
        F.sum("rows").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("rows"))), F.lit(0)).alias("missing"),
        F.count("value").alias("distinct"),
    )
    fields = [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema)]
    names = df.sparkSession.createDataFrame(fields, "position int, column string, type string")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "missing", "distinct")}
    return names.join(found, "column", "left").withColumns(zero).select("position", "column", "type", *zero)


def _names():
    q = F.col("quartiles")
    return [
        "column",
        "count",
        "missing",
        "distinct",
        "mean",
        "std",
        "min",
        q[0].alias("q25"),
        q[1].alias("q50"),
        q[2].alias("q75"),
        "max",
    ]


def table_shape(df: DataFrame) -> DataFrame:
    """Name, type and place of every column, with the number of rows of the table."""
    fields = [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema)]
    spark = df.sparkSession
    names = spark.createDataFrame(fields, "position int, column string, type string")
    return names.withColumn("n_rows", df.agg(F.count(F.lit(1)).alias("n")).scalar())


def most_missing(profile: DataFrame, n: int = 20) -> DataFrame:
    return profile.select("column", "missing").orderBy(F.desc("missing"), "column").limit(n)


def few_values(profile: DataFrame, at_most: int = 10, n: int = 30) -> DataFrame:
    """Columns with few distinct values, likely classes, fewest first."""
    low = profile.select("column", "distinct").where(F.col("distinct") <= at_most)
    return low.orderBy("distinct", "column").limit(n)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each label column, a missing value included."""
    return (
        _long(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    )
