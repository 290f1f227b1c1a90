"""Typed tables, sidecars and the coverage audit."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from datetime import datetime, timezone
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import date_text, require_columns
from ..operators.dedup import parts_of

# Layout of the wide labelled table.
WIDE_FEATURES = tuple(str(k) for k in range(144))
WIDE_LABELS = tuple(str(k) for k in range(144, 149))

TRADE_SCHEMA = T.StructType(
    [
        T.StructField("time", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("qty", T.DoubleType()),
        T.StructField("isBuyerMaker", T.BooleanType()),
        T.StructField("trade_id", T.LongType()),
    ]
)
PROBABILITY_SCHEMA = "open_time string, y_true string, y_prob string"


def read_wide_csv(
    spark: SparkSession, path: str, columns: Sequence[str] = WIDE_FEATURES + WIDE_LABELS
) -> DataFrame:
    """The wide CSV, whose unnamed first column becomes the order key ``row_id``.

    Columns are found by the names in the header, in any order; other columns are not read.
    A file without the unnamed first column, or without one of the names, is an error.
    All files of the path must share one header.
    """
    header = spark.read.csv(path, header=True, inferSchema=False)
    if not header.columns or not re.fullmatch(r"_c0|Unnamed: 0|index|", header.columns[0]):
        raise ValueError("the wide table has no unnamed first column to order its rows by")
    require_columns(header, columns, "wide table")
    # every column is named in file order, so no value can reach another name
    kinds = {c: T.DoubleType() for c in columns} | {header.columns[0]: T.LongType()}
    fields = [T.StructField(c, kinds.get(c, T.StringType())) for c in header.columns]
    rows = spark.read.csv(path, header=True, schema=T.StructType(fields), enforceSchema=True)
    return rows.select(F.col(f"`{header.columns[0]}`").alias("row_id"), *[F.col(f"`{c}`") for c in columns])


def split_features_labels(
    df: DataFrame,
    features: Sequence[str] = WIDE_FEATURES,
    labels: Sequence[str] = WIDE_LABELS,
) -> tuple[DataFrame, DataFrame]:
    require_columns(df, features, "wide table")
    require_columns(df, labels, "wide table")
    return df.select("row_id", *features), df.select("row_id", *labels)


def read_parquet_with_position(spark: SparkSession, *paths: str) -> DataFrame:
    """A parquet table whose ``position`` is the row's file and place in it."""
    return spark.read.parquet(*paths).select(
        "*", F.struct("_metadata.file_path", "_metadata.row_index").alias("position")
    )


def read_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """Scored probabilities, found by the names in their header; texts are left for the caller to parse.

    ``position`` tells later lines from earlier ones where a time repeats.
    """
    df = spark.read.csv(path, header=True)
    require_columns(df, ["open_time", "y_true", "y_prob"], "probability table")
    place = F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().alias("nth"),
    )
    return df.select("*", place.alias("position"))


def write_sorted(df: DataFrame, out: str, order: Sequence[str], columns: Sequence[str] | None = None) -> None:
    """One order over all files: each file holds a range of it, sorted, so readers skip by its bounds.

    The bounds of the ranges are sampled, so ``df`` is read twice and should be a written table.
    Beyond the session's number of partitions theirs follows that of the rows, so that no task sorts
    more of a larger table.
    """
    parts = parts_of(df.count())
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (df.repartitionByRange(parts, *order) if parts > usual else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    ordered.select(*(columns or df.columns)).write.mode("overwrite").parquet(out)


def file_bounds(spark: SparkSession, path: str, order: Sequence[str]) -> DataFrame:
    """Rows, first and last place in the order of each file of a table."""
    place = F.struct(*order)
    named = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"))
    return named.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.min("place").alias("first"), F.max("place").alias("last"))


def write_trades(trades: DataFrame, out: str) -> None:
    """Merged trades with the fixed schema, in order of symbol and time over all files."""
    columns = [F.col(f.name).cast(f.dataType) for f in TRADE_SCHEMA]
    extra = [c for c in ("symbol",) if c in trades.columns]
    # rows of one time keep the order of their files and lines, where those are known
    order = [*extra, "time", *[c for c in ("rank", "position") if c in trades.columns]]
    write_sorted(trades.withColumns({f.name: c for f, c in zip(TRADE_SCHEMA, columns)}), out, order, [*extra, *TRADE_SCHEMA.names])


def write_table(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").parquet(out)


def write_by_date(df: DataFrame, out: str) -> None:
    """Partitioned by symbol and UTC day; each day's rows meet in one task, one file per day.

    Days that ``df`` holds replace those of the table, its other days stay.
    """
    dated = df.withColumn("date", date_text("open_time").cast("date"))
    (
        dated.repartition("symbol", "date")
        .sortWithinPartitions("symbol", "date", "open_time")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("symbol", "date")
        .parquet(out)
    )


def read_by_date(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_by_date`` wrote, without the day; symbols that look like numbers stay texts."""
    fields = [f for f in spark.read.parquet(path).schema if f.name not in ("symbol", "date")]
    schema = T.StructType([*fields, T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())])
    return spark.read.schema(schema).parquet(path).select("symbol", *[f.name for f in fields])


def write_csv(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").csv(out, header=True)


def sidecar_path(out: str, replace: bool = True) -> str:
    """``x.parquet`` to ``x.meta.json``, or to ``x.parquet.meta.json`` when appending."""
    if not replace:
        return f"{out}.meta.json"
    head, _, name = out.rstrip("/").rpartition("/")
    stem = PurePosixPath(name).stem
    return f"{head}/{stem}.meta.json" if head else f"{stem}.meta.json"


def write_json(spark: SparkSession, path: str, payload: object) -> None:
    """A small JSON file, through Hadoop so that any file system works."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(json.dumps(payload, indent=2).encode("utf-8")))
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def feature_manifest(payload: object, path: str = "manifest") -> list[str]:
    if not isinstance(payload, list) or not all(isinstance(c, str) for c in payload):
        raise ValueError(f"{path} holds no list of names")
    if not payload:
        raise ValueError(f"{path} is empty")
    return payload


def now_utc() -> str:
    return datetime.now(timezone.utc).isoformat()


def run_dir(out: str, symbol: str, label: str, full_fit: bool = False) -> tuple[str, str]:
    """Folder of the label's model and folder of this run's results."""
    label_dir = f"{out.rstrip('/')}/{symbol}/{label}"
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    return label_dir, label_dir if full_fit else f"{label_dir}/run_{stamp}"


def artifact_names(feature_set: str) -> tuple[str, str]:
    suffix = "_scalefree" if feature_set == "scalefree" else ""
    return f"model_pipeline{suffix}", f"feature_columns{suffix}.json"


def month_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Months that meet the inclusive range, each clamped to it."""
    if start > end:
        raise ValueError(f"the range {start} to {end} is empty")
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("month")).select(
        F.date_format("month", "yyyy-MM").alias("month_key"),
        F.greatest("month", first).alias("window_start"),
        F.least(F.last_day("month"), last).alias("window_end"),
    )


def month_coverage(
    expected: DataFrame, symbols: DataFrame, present: DataFrame
) -> DataFrame:
    """Every symbol's expected months with ``status`` existing or missing.

    ``expected`` and ``symbols`` are short lists; ``present`` may name a month many times.
    """
    months = F.array_sort(F.collect_set("month_key"))  # at most one value per month of the range
    wanted = symbols.select("symbol").distinct().withColumn(
        "month_key", F.explode(expected.agg(months).scalar())
    )
    seen = present.select("symbol", "month_key").distinct().withColumn("_seen", F.lit(True))
    return wanted.join(seen, ["symbol", "month_key"], "left").select(
        "symbol",
        "month_key",
        F.when(F.col("_seen"), "existing").otherwise("missing").alias("status"),
    )


def trade_months_present(files: DataFrame) -> DataFrame:
    """Symbol and month of monthly trade files, CSV or ZIP, from a file listing."""
    pattern = r"^(.+)-trades-(\d{4}-\d{2})\.(csv|zip)$"
    named = files.where(F.col("file_name").rlike(pattern))
    return named.select(
        F.regexp_extract("file_name", pattern, 1).alias("symbol"),
        F.regexp_extract("file_name", pattern, 2).alias("month_key"),
    )
