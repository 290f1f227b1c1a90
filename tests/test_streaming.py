from __future__ import annotations

from conftest import BASE, MINUTE

from barline.operators.bars import trade_bars
from barline.streaming import read_trade_stream, streaming_trade_bars, write_bars

SCHEMA = "symbol string, trade_id bigint, time bigint, price double, qty double, isBuyerMaker boolean"


def test_stream_of_trades_equals_batch_bars(spark, tmp_path):
    """Three runs over growing input: repeats count once, late trades drop, bars come once."""
    first = [("a", i, BASE + i * 20_000, 10.0, 1.0, i % 2 == 0) for i in range(30)]
    second = first[-3:] + [("a", 100 + i, BASE + (10 + i) * MINUTE, 11.0, 2.0, True) for i in range(3)]
    late = [("a", 999, BASE, 1.0, 1.0, True), ("a", 200, BASE + 40 * MINUTE, 1.0, 1.0, True)]
    for rows in (first, second, late):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = read_trade_stream(spark, f"{tmp_path}/in", SCHEMA)
        bars = streaming_trade_bars(stream, delay="2 minutes")
        write_bars(bars, f"{tmp_path}/bars", f"{tmp_path}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/bars").orderBy("open_time").collect()
    unique = spark.createDataFrame(first + second[3:], SCHEMA)
    expected = trade_bars(unique).select(*got[0].__fields__).orderBy("open_time").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in expected]
