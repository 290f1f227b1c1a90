"""Trade bars as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bars import bar_aggregates, side_columns, usable_trades


def read_trade_stream(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def streaming_trade_bars(
    trades: DataFrame, delay: str = "10 minutes", bar: str = "1 minute"
) -> DataFrame:
    """Bars of a stream of trades, each emitted once, when its window is final.

    A trade that arrives twice within ``delay`` counts once; one that arrives
    later than that is dropped, as the watermark says.  Trades without an id can't
    be told from their repeats and count each.
    """
    timed = usable_trades(trades).withColumn("ts", F.timestamp_millis("time")).withWatermark("ts", delay)
    # a trade without an id gets one of its own, so that it equals no other
    own = F.when(F.col("trade_id").isNull(), F.uuid())
    unique = timed.withColumn("_own", own).dropDuplicatesWithinWatermark(["symbol", "trade_id", "_own"])
    return (
        unique.withColumns(side_columns())
        .groupBy(F.window("ts", bar).alias("bar"), "symbol")
        .agg(*bar_aggregates())
        .select(
            "symbol",
            F.unix_millis("bar.start").alias("open_time"),
            "trade_vol",
            "trade_dollar_vol",
            "n_trades",
            "buy_vol",
            "sell_vol",
        )
    )


def write_bars(bars: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append finished bars to parquet; processes what is there, then stops."""
    return (
        bars.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
