"""The given tables in the shapes the operators expect."""

from __future__ import annotations

import shutil
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import MINUTE_MS, div, minute_floor, open_time_ms
from ..operators.dedup import parts_of
from ..operators.ordered import ROWS_PER_CHUNK
from ..sources.line_source import BLOCK_BYTES, file_system

HOUR_MS = 60 * MINUTE_MS
EMBEDDING_WIDTH = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trades(spark: SparkSession, folder: str) -> DataFrame:
    return as_trades(table(spark, folder, "events"))


def as_trades(events: DataFrame) -> DataFrame:
    """Every event as a trade of the symbol named by its type."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("trade_id"),
        open_time_ms(events, "ts").alias("time"),
        (F.col("value") + 1).alias("price"),
        (F.col("event_id") % 7 + 1).cast("double").alias("qty"),
        (F.col("event_id") % 2 == 1).alias("isBuyerMaker"),
    )


def candles(spark: SparkSession, folder: str, step_ms: int = MINUTE_MS) -> DataFrame:
    """Open, high, low, close and volume of every bar that has a trade."""
    place = F.struct("time", "trade_id")
    return (
        trades(spark, folder)
        .groupBy("symbol", minute_floor("time", step_ms).alias("open_time"))
        .agg(
            F.min_by("price", place).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", place).alias("close"),
            F.sum("qty").alias("volume"),
        )
    )


def grid(
    spark: SparkSession,
    folder: str,
    step_ms: int = MINUTE_MS,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """A strict grid: a bar without trades repeats the last close with volume 0.

    Every candle also writes the empty bars up to the next candle; where the next
    one lies in a later chunk, that chunk's first time is carried back to it.
    """
    span = rows_per_chunk * step_ms
    bars = candles(spark, folder, step_ms).withColumn("_chunk", div("open_time", span))
    following = Window.partitionBy("symbol").orderBy("_chunk")
    starts = (
        bars.groupBy("symbol", "_chunk")
        .agg(F.min("open_time").alias("_first"))
        .select("symbol", "_chunk", F.lead("_first").over(following).alias("_later"))
    )
    walk = Window.partitionBy("symbol", "_chunk").orderBy("open_time")
    until = F.coalesce(F.lead("open_time").over(walk), F.col("_later"))
    times = F.sequence(
        F.col("open_time"), F.coalesce(F.col("_until") - step_ms, F.col("open_time")), F.lit(step_ms)
    )
    filled = (
        bars.join(starts, ["symbol", "_chunk"])
        .withColumn("_until", until)
        .withColumn("_time", F.explode(times))
    )
    real = F.col("_time") == F.col("open_time")

    def price(c: str):
        return F.when(real, F.col(c)).otherwise(F.col("close")).alias(c)

    return filled.select(
        "symbol",
        F.col("_time").alias("open_time"),
        price("open"),
        price("high"),
        price("low"),
        "close",
        F.when(real, F.col("volume")).otherwise(0.0).alias("volume"),
    )


#: Days of the month that the files named daily begin with.
FILE_DAYS = (1, 11, 21)


def _trade_file_lines(trades_: DataFrame) -> DataFrame:
    """Lines of trade files of every symbol, each with a layout of its own; every tenth trade is there twice.

    ``view`` has daily files and a monthly one that they replace, ``click`` one monthly archive,
    ``purchase`` no ids, ``signup`` headers and an archive among its daily files, and the last daily
    file of ``error`` ends with a byte that is no text.
    """
    ms, price, qty, number = (F.col(c).cast("string") for c in ("time", "price", "qty", "trade_id"))
    flag = F.when(F.col("isBuyerMaker"), "True").otherwise("False")
    fields = {
        "view": [number, price, qty, F.lit("0"), ms, flag, F.lit("True")],
        "click": [number, price, qty, (F.col("time") * 1_000).cast("string"), flag, F.lit("True")],
        "error": [number, price, qty, ms, flag],
        "purchase": [price, qty, ms, flag],
        "signup": [ms, flag, F.concat(F.lit('"'), price, F.lit('"')), qty, number],
    }
    symbol, line = F.col("symbol"), F
    for name, own in fields.items():
        line = line.when(symbol == name, F.concat_ws(",", *own))
    day = F.dayofmonth(F.timestamp_millis("time"))
    first = F.when(day >= FILE_DAYS[2], "21").when(day >= FILE_DAYS[1], "11").otherwise("01")
    month = F.date_format(F.timestamp_millis("time"), "yyyy-MM")
    kind = F.when((symbol == "click") | (symbol == "signup") & (first == "11"), "zip").otherwise("csv")
    daily = F.format_string("daily/trades/%s/%s-trades-%s-%s.%s", symbol, symbol, month, first, kind)
    monthly = F.format_string("monthly/trades/%s/%s-trades-%s.%s", symbol, symbol, month, kind)
    path = F.when(symbol == "click", F.array(monthly)).when(symbol == "view", F.array(daily, monthly)).otherwise(F.array(daily))
    copies = F.when(F.col("trade_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    data = trades_.select(F.explode(path).alias("path"), line.alias("line"), "trade_id", copies.alias("copies"))
    data = data.select("path", "line", "trade_id", F.explode("copies").alias("copy"))
    lines = data.select("path", "line", (F.col("trade_id") * 2 + F.col("copy")).alias("nth"))
    header = lines.where(F.col("path").contains("/signup/")).select("path").distinct()
    return lines.unionByName(header.select("path", F.lit("Timestamp,is_buyer_maker,Price,Quantity,trade ID").alias("line"), F.lit(-1).cast("bigint").alias("nth")))


def _candle_file_lines(bars: DataFrame) -> DataFrame:
    """Hourly candles to the 20th in monthly files, those from the 15th on in daily files at prices raised by 1000."""
    day = F.dayofmonth(F.timestamp_millis("open_time"))
    date = F.date_format(F.timestamp_millis("open_time"), "yyyy-MM")
    files = F.array_compact(
        F.array(
            F.when(day <= 20, F.struct(F.format_string("monthly/klines/%s/1m/%s-1m-%s.csv", "symbol", "symbol", date).alias("path"), F.lit(0.0).alias("more"))),
            F.when(day >= 15, F.struct(F.format_string("daily/klines/%s/1m/%s-1m-%s-15.csv", "symbol", "symbol", date).alias("path"), F.lit(1000.0).alias("more"))),
        )
    )
    filed = bars.withColumn("file", F.explode(files)).select("*", "file.*")
    line = F.concat_ws(",", F.col("open_time"), *[F.col(c) + F.col("more") for c in ("open", "high", "low", "close")], "volume", F.col("open_time") + HOUR_MS - 1)
    return filed.select("path", line.alias("line"), (F.col("open_time") * 2).alias("nth"))


#: Tasks that put files together from their parts.
FILE_TASKS = 32


def write_raw_files(spark: SparkSession, folder: str, root: str) -> str:
    """Raw files of the given events below ``root``; a stand-in for an archive's layout.

    Lines are cut into ranges of their order, each written by one task, so that no task holds more of a
    file than its range; then one task for each file puts its parts together, a block at a time.
    """
    traded = trades(spark, folder)
    lines = _trade_file_lines(traded).unionByName(_candle_file_lines(candles(spark, folder, HOUR_MS)))
    lines = lines.where("line IS NOT NULL")  # an event without a type belongs to no file
    order = [F.col("path"), F.col("nth").asc_nulls_last(), F.col("line")]
    ranges = lines.repartitionByRange(parts_of(traded.count()), *order).sortWithinPartitions(*order).select("path", "line")
    held = f"{root}/parts-{uuid.uuid4().hex}"

    def write_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file for each path of a range; a repeated attempt writes files of its own."""
        task, made, path, out = TaskContext.get(), [], None, None
        system, target = file_system(held)
        system.create_dir(target, recursive=True)
        try:
            for batch in batches:
                for own in pc.unique(batch.column("path")).to_pylist():
                    if own != path:
                        if out is not None:
                            out.close()
                        path = own
                        name = f"{target}/{task.partitionId()}-{task.taskAttemptId()}-{len(made)}"
                        out = system.open_output_stream(name)
                        made.append((path, task.partitionId(), name))
                    texts = batch.column("line").filter(pc.equal(batch.column("path"), own)).to_pylist()
                    out.write("".join(f"{text}\n" for text in texts).encode())
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_pydict({"path": [m[0] for m in made], "part": [m[1] for m in made], "file": [m[2] for m in made]}, pa.schema([("path", pa.string()), ("part", pa.int32()), ("file", pa.string())]))

    def join_parts(parts: pd.DataFrame) -> pd.DataFrame:
        path = parts["path"].iloc[0]
        system, target = file_system(f"{root}/spot/{path}")
        system.create_dir(target.rpartition("/")[0], recursive=True)

        def copy(out) -> None:
            for name in parts.sort_values("part")["file"]:
                with system.open_input_stream(name) as part:
                    shutil.copyfileobj(part, out, BLOCK_BYTES)
            if "/error/" in path and path.endswith("-21.csv"):
                out.write(b"\xff\n")

        with system.open_output_stream(target) as out:
            if path.endswith(".zip"):
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, archive.open("trades.csv", "w", force_zip64=True) as member:
                    copy(member)
            else:
                copy(out)
        return pd.DataFrame({"path": [path]})

    parts = ranges.mapInArrow(write_parts, "path string, part int, file string")
    parts.repartition(FILE_TASKS, "path").groupBy("path").applyInPandas(join_parts, "path string").count()
    done = spark._jvm.org.apache.hadoop.fs.Path(held)
    done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return root
