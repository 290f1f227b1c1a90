"""Raw files that can't be read, archives of any size, merge jobs and the tables they leave."""

from __future__ import annotations

import glob
import io
import os
import random
import tracemalloc
import zipfile

import pytest
from conftest import BASE, MINUTE
from pyspark.sql import functions as F
from test_raw_files import _write

from barline.operators import dedup
from barline.plans import inputs, jobs
from barline.session import owned_tables, shared_dir, written
from barline.sources import line_source, raw_files, tables


def test_parts_of_a_file_hold_every_line_once(monkeypatch):
    random_ = random.Random(4)
    for _ in range(500):
        data = b"".join(random_.choice([b"a", b"bb,c", b"", b"\xc3\xa9x"]) + random_.choice([b"\n", b"\r\n", b"\r"]) for _ in range(random_.randint(0, 30)))
        data += random_.choice([b"", b"end"])
        monkeypatch.setattr(line_source, "BLOCK_BYTES", random_.choice([1, 2, 3, 7, 100]))
        most, got = random_.randint(1, 20), []
        for start in range(0, len(data), most):
            file = io.BytesIO(data)
            first = file.seek(max(start - 1, 0))
            for block in line_source.owned_lines(file.read, first, start, start + most):
                got += [x for x in block.split(b"\n") if x]
        assert got == [x for x in data.replace(b"\r", b"\n").split(b"\n") if x]


def test_small_files_share_a_partition_and_large_ones_are_cut():
    sizes = [(f"{k}.csv", 10) for k in range(100)] + [("big.csv", 35 << 20), ("big.zip", 90 << 20)]
    parts = line_source.cut_pieces(sizes, 16 << 20, heads=False)
    assert len(parts) == 7 + 3 + 1
    pieces = [p for part in parts for p in part.pieces]
    assert [(p.start, p.end) for p in pieces if p.path == "big.csv"] == [(0, 16 << 20), (16 << 20, 32 << 20), (32 << 20, line_source._END)]
    assert len(line_source.cut_pieces(sizes, 16 << 20, heads=True)) == 7


def test_an_archive_of_any_size_is_read_in_blocks(tmp_path):
    """A member of 160 MB, of which never more than a few blocks are held."""
    line = b"1,10.5,2,21,1727740800000,True,True\n"
    with zipfile.ZipFile(f"{tmp_path}/big.zip", "w", zipfile.ZIP_DEFLATED) as archive, archive.open("a.csv", "w") as member:
        for _ in range(160):
            member.write(line * ((1 << 20) // len(line)))
    tracemalloc.start()
    rows = sum(b.num_rows for b in line_source.piece_rows(line_source.Piece(f"{tmp_path}/big.zip", 0, line_source._END)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 160 * ((1 << 20) // len(line)) and peak < 60 << 20


def test_files_that_cannot_be_read_are_rows_not_failures(spark, tmp_path):
    line = f"1,10,2,20,{BASE},True,True\n"
    _write(f"{tmp_path}/good.csv", line)
    _write(f"{tmp_path}/bom.csv", "﻿id,price,qty,time\n" + f"7,10,2,{BASE + 7}\n")
    with open(f"{tmp_path}/bytes.csv", "wb") as f:
        f.write(line.encode() * 10 + b"\xff\xfe\n")
    os.makedirs(f"{tmp_path}/folder.csv")
    with zipfile.ZipFile(f"{tmp_path}/cut.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "".join(f"{i},{random.random()},2,2,{BASE + i},True,True\n" for i in range(20_000)))
    body = bytearray(open(f"{tmp_path}/cut.zip", "rb").read())
    body[len(body) // 2 : len(body) // 2 + 50] = bytes(50)
    open(f"{tmp_path}/cut.zip", "wb").write(body)
    paths = [f"{tmp_path}/{n}" for n in ("good.csv", "bom.csv", "bytes.csv", "folder.csv", "cut.zip", "absent.csv")]
    trades, rejects = raw_files.merge_trades(spark, paths)
    assert sorted((r.time - BASE, r.trade_id) for r in trades.collect()) == [(0, 1), (7, 7)]
    errors = {r.source_file.rsplit("/", 1)[-1]: r.error for r in rejects.collect()}
    assert set(errors) == {"bytes.csv", "folder.csv", "cut.zip", "absent.csv"}
    assert "UnicodeDecodeError" in errors["bytes.csv"]


def _archive(root):
    """Two symbols: AB with daily and monthly trades and candles, CD with a broken and a good file."""
    line = "{i},{p},2,20,{t},True,True\n"
    days = {"2024-10-02": range(50, 0, -1), "2024-10-01": range(100, 50, -1)}
    for day, ids in days.items():
        rows = [line.format(i=i, p=i, t=BASE + i * 1000) for i in ids]
        _write(f"{root}/spot/daily/trades/AB/AB-trades-{day}.csv", "".join(rows + rows[:5]))
    _write(f"{root}/spot/monthly/trades/AB/AB-trades-2024-10.csv", line.format(i=1, p=9, t=BASE))
    _write(f"{root}/spot/monthly/trades/CD/CD-trades-2024-10.zip", {"a.csv": line.format(i=1, p=9, t=BASE)})
    with open(f"{root}/spot/monthly/trades/CD/CD-trades-2024-11.csv", "wb") as f:
        f.write(b"\xff\n")
    for grain, close, minutes in (("monthly", 1, range(5)), ("daily", 2, range(3, 9))):
        rows = [f"{BASE + m * MINUTE},1,2,0.5,{close},5,{BASE + m * MINUTE + 59_999}\n" for m in minutes]
        _write(f"{root}/spot/{grain}/klines/AB/1m/x.csv", "".join(rows))


def test_merge_job_writes_sorted_tables_counts_and_leaves_nothing(spark, tmp_path):
    _archive(str(tmp_path))
    before = set(glob.glob(f"{shared_dir(spark)}/*"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = jobs.merge_raw(spark, jobs.MergeConfig(str(tmp_path), f"{tmp_path}/out", ("AB", "CD", "EF")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert set(glob.glob(f"{shared_dir(spark)}/*")) == before
    counts = {(c["kind"], c["symbol"]): (c["daily_files"], c["monthly_files"], c["failed_files"], c["rows_read"], c["rows_kept"]) for c in done["counts"]}
    assert counts == {("klines", "AB"): (1, 1, 0, 11, 9), ("trades", "AB"): (2, 0, 0, 110, 100), ("trades", "CD"): (0, 2, 1, 1, 1)}
    assert done["symbols_without_files"] == ["EF"]
    files = spark.read.parquet(f"{tmp_path}/out/files.parquet").where("kind = 'trades' and symbol = 'AB'")
    assert [(r.rank, r.rows_read, r.rows_kept) for r in files.orderBy("rank").collect()] == [(1, 55, 50), (2, 55, 50)]
    assert tables.read_json(spark, f"{tmp_path}/out/merge.meta.json")["counts"] == done["counts"]

    order = ["symbol", "time"]
    bounds = sorted((tuple(r["first"]), tuple(r["last"])) for r in tables.file_bounds(spark, f"{tmp_path}/out/trades.parquet", order).collect())
    assert len(bounds) > 2 and all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))
    for path in glob.glob(f"{tmp_path}/out/trades.parquet/part-*"):
        rows = [(r.symbol, r.time) for r in spark.read.parquet(path).collect()]
        assert rows == sorted(rows)
    klines = spark.read.parquet(f"{tmp_path}/out/klines_1m.parquet").orderBy("open_time").collect()
    assert [r.close for r in klines] == [1.0] * 5 + [2.0] * 4 and klines[0].symbol == "AB"


def test_merge_job_checks_its_input(spark, tmp_path):
    with pytest.raises(ValueError, match="no raw files"):
        jobs.merge_raw(spark, jobs.MergeConfig(str(tmp_path), f"{tmp_path}/out", ("AB",)))
    with pytest.raises(ValueError, match="no symbols"):
        jobs.merge_raw(spark, jobs.MergeConfig(str(tmp_path), f"{tmp_path}/out", ()))


def test_owned_tables_go_on_success_and_on_failure(spark):
    before = set(glob.glob(f"{shared_dir(spark)}/*"))
    with owned_tables(spark):
        assert written(spark.range(3), "x").count() == 3
        assert set(glob.glob(f"{shared_dir(spark)}/*")) != before
        with owned_tables(spark):
            written(spark.range(3), "y")
    assert set(glob.glob(f"{shared_dir(spark)}/*")) == before
    with pytest.raises(RuntimeError), owned_tables(spark):
        written(spark.range(3), "x")
        raise RuntimeError
    assert set(glob.glob(f"{shared_dir(spark)}/*")) == before


def test_a_rerun_of_one_day_replaces_that_day_only(spark, tmp_path):
    day = 24 * 60 * MINUTE
    minutes = spark.range(0, 2 * 1440).select(F.lit("7").alias("symbol"), (F.lit(BASE) + F.col("id") * MINUTE).alias("open_time"))
    prices = {c: F.lit(10.0) for c in ("open", "high", "low", "close")} | {"volume": F.lit(1.0)}
    minutes.withColumns(prices).write.parquet(f"{tmp_path}/klines")
    trades = "symbol string, time long, price double, qty double, isBuyerMaker boolean, trade_id long"
    spark.createDataFrame([("7", BASE, 1.0, 1.0, True, 1), ("7", BASE + day, 1.0, 1.0, True, 2)], trades).write.parquet(f"{tmp_path}/trades")

    def build(first, last, name):
        config = jobs.FeatureConfig(f"{tmp_path}/{name}", f"{tmp_path}/trades", f"{tmp_path}/features", first, last, by_date=True)
        return jobs.build_features_1m(spark, config)

    whole = build("2024-10-01", "2024-10-02", "klines")
    assert whole.count() == 2 * 1440 and whole.schema["symbol"].dataType.simpleString() == "string"
    minutes.withColumns(prices | {"volume": F.lit(5.0)}).write.parquet(f"{tmp_path}/later")
    again = build("2024-10-02", "2024-10-02", "later")
    by_day = again.groupBy((F.col("open_time") >= BASE + day).alias("second")).agg(F.count("*"), F.max("volume")).collect()
    assert {tuple(r) for r in by_day} == {(False, 1440, 1.0), (True, 1440, 5.0)}


def _events(spark, folder, rows):
    """Events of one symbol on one day, and one without a type."""
    at = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("id") * 1000)
    kind = F.when(F.col("id") != 7, "purchase")
    events = spark.range(rows).select(F.col("id").alias("event_id"), at.alias("ts"), F.lit(1).alias("user_id"), kind.alias("event_type"), (F.col("id") % 13).cast("double").alias("value"))
    events.write.parquet(f"{folder}/events.parquet")


def test_raw_files_are_written_in_ranges_of_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "ROWS_PER_TASK", 50)
    _events(spark, tmp_path, 400)
    inputs.write_raw_files(spark, str(tmp_path), f"{tmp_path}/raw")
    path = tmp_path / "raw/spot/daily/trades/purchase/purchase-trades-2024-01-01.csv"
    wanted = [k for k in range(400) if k != 7 for _ in range(2 if k % 10 == 0 else 1)]
    assert [int(line.split(",")[2]) for line in path.read_text().splitlines()] == [1_704_067_200_000 + k * 1000 for k in wanted]
    assert {p.name for p in (tmp_path / "raw").iterdir()} == {"spot"}


def test_dealt_rows_keep_the_same_first_ones(spark, monkeypatch):
    monkeypatch.setattr(dedup, "ROWS_PER_TASK", 100)
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 40).alias("k"), F.struct("id").alias("position"), F.concat(F.lit("a"), F.col("id") % 2).alias("s"))
    keys = ["s", F.when(F.col("k") < 30, F.col("k"))]
    dealt = dedup.keep_first_dealt(rows, keys, ["position"], 2000)
    plain = dedup.keep_first(rows, keys, ["position"])
    assert dealt.columns == plain.columns
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    assert dealt.rdd.getNumPartitions() == 20  # one of about 100 rows for each task
