from __future__ import annotations

import os
import zipfile

import pytest

from barline.sources import raw_files, tables

T0 = 1_727_740_800_000


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if path.endswith(".zip"):
        with zipfile.ZipFile(path, "w") as z:
            for name, body in text.items():
                z.writestr(name, body)
    else:
        with open(path, "w") as f:
            f.write(text)


def _trades(spark, paths):
    trades, rejects = raw_files.merge_trades(spark, paths)
    rows = [tuple(r) for r in trades.select("time", "price", "qty", "isBuyerMaker", "trade_id").collect()]
    return rows, {r.source_file.rsplit("/", 1)[-1]: r.error for r in rejects.collect()}


def test_every_width_and_header(spark, tmp_path):
    bodies = {
        "a7.csv": f"1,10.5,2,21,{T0},True,True\n",
        "a6.csv": f"2,10.5,2,{T0 + 1}000,false,True\n",
        "a5.csv": f"3,10.5,2,{T0 // 1000 + 9},t\n",
        "a4.csv": f"10.5,4,{T0 + 3},0\n",
        "a3.csv": f"10.5,5,{T0 + 4}\n",
        "a8.csv": f"6,10.5,2,21,{T0 + 5},True,True,more\n",
        "a2.csv": "1,2\n",
        "head.csv": f'Trade ID,Quantity,"Price",Timestamp,m\n7,8,"9.5",{T0 + 6},yes\n',
        "one.csv": f"id,time,price,p,qty\n8,{T0 + 7},1.5,99,3\n",
    }
    for name, body in bodies.items():
        _write(f"{tmp_path}/{name}", body)
    rows, rejects = _trades(spark, [f"{tmp_path}/{n}" for n in bodies])
    assert rejects == {}
    assert sorted(rows) == sorted(
        [
            (T0, 10.5, 2.0, True, 1),
            (T0 + 1, 10.5, 2.0, False, 2),
            (T0 + 9000, 10.5, 2.0, True, 3),
            (T0 + 3, 10.5, 4.0, False, None),
            (T0 + 4, 10.5, 5.0, None, None),
            (T0 + 5, 10.5, 2.0, True, 6),
            (T0 + 6, 9.5, 8.0, True, 7),
            (T0 + 7, 1.5, 3.0, None, 8),
        ]
    )


def test_repeats_count_within_a_file_only(spark, tmp_path):
    line = f"1,10,2,20,{T0},True,True\n"
    no_id = f",10,2,20,{T0 + 5},True,True\n"
    _write(f"{tmp_path}/x.csv", line + f"1,11,2,20,{T0 + 1},True,True\n" + no_id + f",12,2,20,{T0 + 6},True,True\n")
    _write(f"{tmp_path}/y.csv", line)
    content = f"10,2,{T0},True\n10,2,{T0},True\n10,3,{T0},True\nbad,2,none,True\n"
    _write(f"{tmp_path}/z.csv", content)
    rows, _ = _trades(spark, [f"{tmp_path}/{n}.csv" for n in "xyz"])
    # x: the first row of id 1, and the first of the rows without an id
    assert sorted(rows, key=str) == sorted(
        [
            (T0, 10.0, 2.0, True, 1),
            (T0 + 5, 10.0, 2.0, True, None),
            (T0, 10.0, 2.0, True, 1),
            (T0, 10.0, 2.0, True, None),
            (T0, 10.0, 3.0, True, None),
        ],
        key=str,
    )


def test_archives(spark, tmp_path):
    body = "".join(f"{i},1,2,2,{T0 + i},True,True\n" for i in range(60_000))
    _write(f"{tmp_path}/good.zip", {"b.csv": "9,9,9,9,9,True,True\n", "a.csv": body, "0.txt": "no"})
    _write(f"{tmp_path}/none.zip", {"a.txt": "x"})
    with open(f"{tmp_path}/broken.zip", "wb") as f:
        f.write(b"not an archive")
    trades, rejects = raw_files.merge_trades(spark, [f"{tmp_path}/{n}.zip" for n in ("good", "none", "broken")])
    assert trades.count() == 60_000
    assert trades.selectExpr("max(time) - min(time)").first()[0] == 59_999
    errors = {r.source_file.rsplit("/", 1)[-1]: r.error for r in rejects.collect()}
    assert set(errors) == {"none.zip", "broken.zip"}
    assert "no CSV" in errors["none.zip"]
    with pytest.raises(ValueError, match="neither"):
        raw_files.read_lines(spark, ["x.txt"])


def test_lines_of_a_split_file_keep_their_order(spark, tmp_path):
    """The first of two rows with one id lies in another split than the second."""
    head = "id,price,qty,quoteQty,time,isBuyerMaker,best\n"
    body = "".join(f"{i % 20_000},{i},2,2,{T0 + i},True,True\n" for i in range(40_000))
    _write(f"{tmp_path}/big.csv", head + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = raw_files.read_lines(spark, [f"{tmp_path}/big.csv"])
        assert lines.select("split_start").distinct().count() > 5
        trades, _ = raw_files.merge_trades(spark, [f"{tmp_path}/big.csv"])
        assert trades.count() == 20_000
        assert trades.where("price <> trade_id").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_daily_files_replace_monthly_ones_and_sort_by_date(spark, tmp_path):
    root = str(tmp_path)
    line = f"1,10,2,20,{T0},True,True\n"
    for name in ("AB-trades-2024-10.csv", "AB-trades-2024-09.csv"):
        _write(f"{root}/spot/monthly/trades/AB/{name}", line)
    paths, grain = raw_files.trade_paths(spark, root, "AB")
    assert grain == "monthly" and [p[-11:-4] for p in paths] == ["2024-09", "2024-10"]
    for name in ("AB-trades-2024-10-02.csv", "zz.csv", "AB-trades-2024-10-01.zip"):
        body = {"a.csv": line} if name.endswith("zip") else line
        _write(f"{root}/spot/daily/trades/AB/{name}", body)
    paths, grain = raw_files.trade_paths(spark, root, "AB")
    assert grain == "daily"
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["AB-trades-2024-10-01.zip", "AB-trades-2024-10-02.csv", "zz.csv"]
    assert raw_files.trade_paths(spark, root, "NONE") == ([], "none")


def test_first_candle_wins_monthly_before_daily(spark, tmp_path):
    root = str(tmp_path)
    folder = "klines/AB/1m"
    head = "open_time,open,high,low,close,volume,close_time\n"

    def line(t, v):
        return f"{t},1,2,0.5,{v},5,{t + 59_999},9,3,1,1,0\n"

    _write(f"{root}/spot/daily/{folder}/AB-1m-2024-10-01.csv", line(T0, 7) + line(T0 + 60_000, 8))
    _write(f"{root}/spot/monthly/{folder}/AB-1m-2024-10.csv", head + line(T0 * 1000, 1).replace(f",{T0 * 1000 + 59_999},", f",{T0 + 59_999},"))
    paths = raw_files.kline_paths(spark, root, "AB")
    assert ["/monthly/" in p for p in paths] == [True, False]
    out = raw_files.merge_klines(spark, paths).orderBy("open_time").collect()
    assert out[0].asDict().keys() == dict.fromkeys(raw_files.KLINE_OUTPUT).keys()
    assert [(r.open_time, r.close, r.number_of_trades) for r in out] == [(T0, 1.0, 3), (T0 + 60_000, 8.0, 3)]
    assert out[0].open_time_raw == T0 * 1000
    assert out[0].open_time_utc.timestamp() * 1000 == T0


def test_coverage_of_monthly_files(spark, tmp_path):
    root = str(tmp_path)
    for name in ("AB-trades-2024-10.csv", "AB-trades-2024-12.zip", "AB-trades-2024-10-01.csv"):
        _write(f"{root}/m/{name}", {"a.csv": ""} if name.endswith("zip") else "")
    files = raw_files.find_files(spark, [f"{root}/m/*.csv", f"{root}/m/AB*", f"{root}/m/*.none"])
    assert files.count() == 3
    present = tables.trade_months_present(files)
    symbols = spark.createDataFrame([("AB",), ("CD",)], "symbol string")
    expected = tables.month_windows(spark, "2024-10-15", "2024-12-02")
    windows = [tuple(map(str, r)) for r in expected.orderBy("month_key").collect()]
    assert windows == [
        ("2024-10", "2024-10-15", "2024-10-31"),
        ("2024-11", "2024-11-01", "2024-11-30"),
        ("2024-12", "2024-12-01", "2024-12-02"),
    ]
    cover = tables.month_coverage(expected, symbols, present)
    missing = {(r.symbol, r.month_key) for r in cover.where("status = 'missing'").collect()}
    assert missing == {("AB", "2024-11"), ("CD", "2024-10"), ("CD", "2024-11"), ("CD", "2024-12")}
    with pytest.raises(ValueError):
        tables.month_windows(spark, "2024-02-01", "2024-01-01")
