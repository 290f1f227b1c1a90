"""Answers that must not depend on size, order or layout, and inputs that must not pass silently."""

from __future__ import annotations

import random

import pytest
from conftest import BASE, MINUTE
from pyspark.sql import functions as F

from barline.operators import backtest as bt
from barline.operators import evaluate, model, profile
from barline.operators.ordered import even_span
from barline.plans import jobs
from barline.sources import tables


@pytest.fixture(scope="module")
def gapped_scores(spark):
    draw = random.Random(1)
    rows = [(draw.randint(0, 1), round(draw.random(), 2)) for _ in range(200)]
    rows += [(1, None), (0, float("nan")), (None, 0.5), (1, float("inf"))]
    return spark.createDataFrame(rows, "y_true int, y_prob double")


def test_ranks_leave_missing_scores_out_at_any_chunk_size(gapped_scores):
    known = [(r.y_true, r.y_prob) for r in gapped_scores.limit(200).collect()]
    pos, neg = [s for y, s in known if y], [s for y, s in known if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    found = [evaluate.rank_metrics(gapped_scores, n).first() for n in (5, 20, 20_000)]
    assert all(abs(r.roc_auc - auc) < 1e-12 and abs(r.pr_auc - found[0].pr_auc) < 1e-12 for r in found)
    bins = [sorted(map(tuple, evaluate.calibration_bins(gapped_scores, rows_per_chunk=n).collect())) for n in (5, 20_000)]
    assert bins[0] == bins[1] and sum(b[1] for b in bins[0]) == 200
    assert evaluate.missing_scores(gapped_scores).first()[0] == 4


def test_sparse_ids_give_no_more_chunks_than_rows_fill(spark):
    draw = random.Random(2)
    rows = [(k, draw.choice([-1, 0, 1]), draw.choice([-1, 0, 1])) for k in range(1000)]
    dense = spark.createDataFrame(rows, "row_id long, signal int, realized_direction int")
    sparse = dense.withColumn("row_id", F.col("row_id") * 1_000_003)
    span = even_span(sparse, "row_id", 20)
    assert sparse.select(F.floor(F.col("row_id") / span)).distinct().count() <= 51
    a, b, c = (
        [[round(v, 9) + 0.0 for v in tuple(r)[1:]] for r in table.orderBy("row_id").collect()]
        for table in (bt.backtest(dense, span=20), bt.backtest(sparse, span=span), bt.backtest(sparse))
    )
    assert a == b == c


def test_booleans_are_features(spark):
    df = spark.createDataFrame([(True, "1.5", 2), (False, "x", None), (None, None, 3)], "a boolean, b string, c int")
    got = [tuple(r) for r in model.clean_features(df, ["a", "b", "c"]).collect()]
    assert got == [(1.0, 1.5, 2.0), (0.0, 0.0, 0.0), (0.0, 0.0, 3.0)]


def test_split_gives_every_row_to_one_side(spark):
    rows = [(BASE, "s", k % 4) for k in range(40)] + [(BASE + MINUTE, None, k) for k in range(3)]
    draw = random.Random(3)
    seen = set()
    for n in (3, 20_000):
        draw.shuffle(rows)
        df = spark.createDataFrame(rows, "open_time long, symbol string, x int").repartition(5)
        train, test = model.temporal_split(df, 0.5, rows_per_chunk=n)
        a, b = sorted(map(str, train.collect())), sorted(map(str, test.collect()))
        assert len(a) == 21 and sorted(a + b) == sorted(map(str, df.collect()))
        seen.add(str(a))
    assert len(seen) == 1


def test_wide_csv_binds_by_name(spark, tmp_path):
    names = ["0", "1", "2"]
    (tmp_path / "a.csv").write_text(",0,1,2\n7,1.5,2.5,3.5\n")
    (tmp_path / "b.csv").write_text(",2,extra,0,1\n7,3.5,t,1.5,2.5\n")
    (tmp_path / "c.csv").write_text("0,1,2\n1.5,2.5,3.5\n")
    for file in ("a", "b"):
        assert tables.read_wide_csv(spark, f"{tmp_path}/{file}.csv", names).collect() == [(7, 1.5, 2.5, 3.5)]
    with pytest.raises(ValueError, match="first column"):
        tables.read_wide_csv(spark, f"{tmp_path}/c.csv", names)
    with pytest.raises(ValueError):
        tables.read_wide_csv(spark, f"{tmp_path}/a.csv", [*names, "3"])


def test_diagnostics_keep_all_symbols(spark, tmp_path):
    times = [(s, BASE + k * MINUTE) for s in ("a", "b") for k in range(5)]
    spark.createDataFrame([(*t, 1.0) for t in times], "symbol string, open_time long, close double").write.parquet(f"{tmp_path}/f")
    scored = spark.createDataFrame([(*t, 0.5, 1) for t in times], "symbol string, open_time long, y_prob double, y_true int")
    scored.write.csv(f"{tmp_path}/p", header=True)
    assert jobs.hazard_diagnostics(spark, f"{tmp_path}/f", f"{tmp_path}/p", f"{tmp_path}/out").count() == 10
    scored.drop("symbol").write.csv(f"{tmp_path}/q", header=True)
    with pytest.raises(ValueError, match="symbol"):
        jobs.hazard_diagnostics(spark, f"{tmp_path}/f", f"{tmp_path}/q", f"{tmp_path}/out2")


def test_features_need_symbols_on_both_sides(spark, tmp_path):
    spark.createDataFrame([("a", BASE, 1.0, 1.0, 1.0, 1.0, 1.0)], "symbol string, open_time long, open double, high double, low double, close double, volume double").write.parquet(f"{tmp_path}/k")
    spark.createDataFrame([(BASE, 1.0, 1.0, True)], "time long, price double, qty double, isBuyerMaker boolean").write.parquet(f"{tmp_path}/t")
    config = jobs.FeatureConfig(f"{tmp_path}/k", f"{tmp_path}/t", f"{tmp_path}/out", "2024-10-01", "2024-10-01")
    with pytest.raises(ValueError, match="symbol"):
        jobs.build_features_1m(spark, config)


def test_zscores_of_an_open_range_in_one_series(spark, tmp_path):
    day = 1440 * MINUTE
    rows = [(s, BASE + d * day, float(d * 3 + k)) for d in range(6) for k, s in enumerate("abc")]
    spark.createDataFrame(rows, "symbol string, open_time long, x double").repartition(7).write.parquet(f"{tmp_path}/f")
    config = jobs.ZScoreConfig(f"{tmp_path}/f", f"{tmp_path}/z", min_periods=2, start_date="2024-10-03", by_symbol=False)
    got = jobs.build_features_zscore_1m(spark, config).orderBy("open_time", "symbol").collect()
    values, want = [r[2] for r in sorted(rows, key=lambda r: (r[1], r[0])) if r[1] >= BASE + 2 * day], []
    for k, x in enumerate(values):
        past = values[:k]
        mean = sum(past) / k if k else 0.0
        std = (sum((p - mean) ** 2 for p in past) / k) ** 0.5 if k else 0.0
        want.append((x - mean) / (std + 1e-12) if k >= 2 else 0.0)
    assert len(got) == 12 and all(abs(r.z_x - w) < 1e-9 for r, w in zip(got, want))
    assert tables.read_json(spark, tables.sidecar_path(f"{tmp_path}/z"))["defaulted_rows_per_z_feature"] == {"z_x": 2}


def test_profile_covers_every_column(spark):
    df = spark.createDataFrame([("a", 1.0, True), (None, float("nan"), True), ("b", 2.0, None)], "s string, x double, b boolean")
    got = {r["column"]: (r["position"], r["type"], r["n_rows"], r["missing"], r["distinct"]) for r in profile.all_columns(df).collect()}
    assert got == {"s": (0, "string", 3, 1, 2), "x": (1, "double", 3, 1, 2), "b": (2, "boolean", 3, 1, 1)}
    assert {tuple(r)[3:] for r in profile.all_columns(df.limit(0)).collect()} == {(0, 0, 0)}
