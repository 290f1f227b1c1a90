from __future__ import annotations

import json
import os

import numpy as np
import pytest
from conftest import BASE, MINUTE
from pyspark.sql import functions as F

from barline.operators import evaluate, model, profile
from barline.plans import jobs
from barline.sources import tables


def _scored(spark, pairs):
    return spark.createDataFrame(pairs, "y_true int, y_prob double").repartition(3)


def _auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def _average_precision(pairs):
    total, found, shown, out = sum(y for y, _ in pairs), 0, 0, 0.0
    for score in sorted({p for _, p in pairs}, reverse=True):
        here = [y for y, p in pairs if p == score]
        found, shown = found + sum(here), shown + len(here)
        out += sum(here) / total * found / shown
    return out


@pytest.mark.parametrize("rows_per_chunk", [2, 10_000])
def test_rank_metrics(spark, rows_per_chunk):
    rng = np.random.default_rng(2)
    pairs = [(int(y), float(p)) for y, p in zip(rng.integers(0, 2, 200), rng.random(200).round(2))]
    got = evaluate.rank_metrics(_scored(spark, pairs), rows_per_chunk).first()
    assert got.roc_auc == pytest.approx(_auc(pairs))
    assert got.pr_auc == pytest.approx(_average_precision(pairs))


def test_rank_metrics_of_one_class(spark):
    only = evaluate.rank_metrics(_scored(spark, [(1, 0.5), (1, 0.7)])).first()
    assert (only.roc_auc, only.pr_auc) == (None, 1.0)
    none = evaluate.rank_metrics(_scored(spark, [(0, 0.5)])).first()
    assert (none.roc_auc, none.pr_auc) == (None, 0.0)
    means = evaluate.mean_prob_by_class(_scored(spark, [(0, 0.5)])).first()
    assert tuple(means) == (0.5, None)


def test_threshold_metrics(spark):
    got = evaluate.threshold_metrics(_scored(spark, [(1, 0.5), (1, 0.4), (0, 0.9), (0, 0.1)]), 0.5).first()
    assert (got.tn, got.fp, got.fn, got.tp) == (1, 1, 1, 1)
    assert (got.precision, got.recall, got.f1, got.base_rate) == (0.5, 0.5, 0.5, 0.5)
    empty = evaluate.threshold_metrics(_scored(spark, [(0, 0.1)]), 0.5).first()
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("rows_per_chunk", [3, 10_000])
def test_calibration(spark, rows_per_chunk):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.random(90), np.full(40, 0.25)])
    y = (rng.random(130) < p).astype(int)
    got = evaluate.calibration_bins(_scored(spark, list(zip(y.tolist(), p.tolist()))), 10, rows_per_chunk)
    edges = np.percentile(p, np.linspace(0, 100, 11))
    place = np.searchsorted(edges[1:-1], p)
    for r in got.collect():
        inside = place == r.bin
        assert r.n_rows == inside.sum()
        assert r.mean_predicted == pytest.approx(p[inside].mean())
        assert r.observed_rate == pytest.approx(y[inside].mean())
    assert got.count() == len(set(place))


def _dataset(spark, path, n=400, seed=0, missing=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 50.0] + [0.0, 10.0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.02 * x[:, 1])))).astype(float)
    rows = [
        ("AB", BASE + i * MINUTE, float(a), float(b), float(c) if i % 50 else None, 1.0)
        for i, (a, b, c) in enumerate(zip(x[:, 0], x[:, 1], y))
    ]
    df = spark.createDataFrame(
        rows, "symbol string, open_time bigint, ret_1m double, rv_5m double, y_dd_30p_H3m double, flat double"
    )
    (df.drop("rv_5m") if missing else df).repartition(3).write.parquet(path)
    kept = np.arange(n) % 50 > 0
    return x[kept], y[kept]


def _newton(x, y):
    """Penalised logistic regression with unit C and a free intercept."""
    x = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))])
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
    return w


def test_train_and_infer(spark, tmp_path):
    x, y = _dataset(spark, f"{tmp_path}/data")
    config = jobs.TrainConfig(f"{tmp_path}/data", "y_dd_30p_H3m", f"{tmp_path}/out", "AB", 0.7)
    done = jobs.train_hazard_logistic(spark, config)
    cut = int(len(y) * 0.7)
    m = done["metrics"]
    assert (m["n_rows_total_labeled"], m["n_rows_train"], m["n_rows_test"]) == (392, cut, 392 - cut)
    w = _newton(np.column_stack([x[:cut], np.ones(cut)]), y[:cut])
    found = spark.read.csv(f"{done['run_dir']}/coefficients", header=True, inferSchema=True)
    by_name = {r.feature: r for r in found.collect()}
    assert by_name["ret_1m"].coef == pytest.approx(w[1], abs=1e-5)
    assert by_name["rv_5m"].coef == pytest.approx(w[2], abs=1e-5)
    assert by_name["flat"].coef == pytest.approx(0.0, abs=1e-9)
    assert by_name["ret_1m"]["rank"] == 1
    assert m["roc_auc"] > 0.7 and sum(map(sum, m["confusion_matrix_labels_0_1"])) == 392 - cut
    for name in ("metrics.json", "meta.json", "predictions_sample", "calibration", "prob_hist"):
        assert os.path.exists(f"{done['run_dir']}/{name}")
    sample = spark.read.csv(f"{done['run_dir']}/predictions_sample", header=True, inferSchema=True)
    assert sample.count() == 392 - cut and "y_pred" in sample.columns

    _dataset(spark, f"{tmp_path}/new", 100, seed=9, missing=True)
    scored = jobs.infer_hazard(
        spark, jobs.InferConfig(f"{tmp_path}/new", "y_dd_30p_H3m", done["label_dir"], f"{tmp_path}/oos")
    )
    assert scored["missing_columns"] == ["rv_5m"]
    assert set(scored["metrics"]) == {"base_rate", "roc_auc", "pr_auc", "mean_prob_when_y0", "mean_prob_when_y1"}
    assert json.load(open(f"{tmp_path}/oos/oos_metrics.json"))["roc_auc"] == scored["metrics"]["roc_auc"]
    with pytest.raises(ValueError, match="z_only"):
        jobs.infer_hazard(
            spark,
            jobs.InferConfig(f"{tmp_path}/new", "y_dd_30p_H3m", done["label_dir"], f"{tmp_path}/z", z_only=True),
        )

    klines = spark.read.parquet(f"{tmp_path}/new").withColumn("close", F.col("ret_1m") + 100)
    klines.drop("ret_1m").write.parquet(f"{tmp_path}/features")
    table = jobs.hazard_diagnostics(spark, f"{tmp_path}/features", f"{tmp_path}/oos/oos_probs", f"{tmp_path}/diag")
    rows = table.orderBy("open_time").collect()
    assert len(rows) == 98
    returns = [r.ret_1m for r in rows]
    assert rows[0].cumret_30m is None
    assert rows[60].cumret_30m == pytest.approx(sum(returns[31:61]))


def test_full_fit(spark, tmp_path):
    _dataset(spark, f"{tmp_path}/data", 120)
    config = jobs.TrainConfig(
        f"{tmp_path}/data", "y_dd_30p_H3m", f"{tmp_path}/out", "AB", 1.0, feature_set="scalefree"
    )
    done = jobs.train_hazard_logistic(spark, config)
    assert done["run_dir"] == done["label_dir"]
    assert done["metrics"]["full_fit"] and done["metrics"]["n_rows_test"] == 0
    assert spark.read.csv(f"{done['run_dir']}/full_fit_probs", header=True).count() == 117
    names = json.load(open(f"{done['label_dir']}/feature_columns_scalefree.json"))
    assert names == ["ret_1m", "rv_5m"]


def test_single_class_and_tiny_tables_fail(spark):
    df = spark.createDataFrame([("a", i, 1.0, 1) for i in range(5)], "symbol string, open_time bigint, x double, y_true int")
    with pytest.raises(ValueError, match="single class"):
        model.fit_logistic(df, ["x"])
    with pytest.raises(ValueError, match="at least 2"):
        model.temporal_split(df.limit(1), 0.5)


@pytest.mark.parametrize("ratio,expected", [(0.01, 1), (0.5, 15), (0.55, 16), (0.999, 29), (1.0, 29)])
@pytest.mark.parametrize("rows_per_chunk", [2, 10_000])
def test_temporal_split(spark, ratio, expected, rows_per_chunk):
    rows = [(s, t) for t in range(10) for s in "abc"]
    df = spark.createDataFrame(rows, "symbol string, open_time bigint").repartition(4)
    train, test = model.temporal_split(df, ratio, rows_per_chunk=rows_per_chunk)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    assert sorted(map(tuple, train.collect())) == sorted(ordered[:expected])
    assert sorted(map(tuple, test.collect())) == sorted(ordered[expected:])


def test_cleaning(spark):
    rows = [(1.0, float("inf")), (float("nan"), None), (None, float("-inf"))]
    df = spark.createDataFrame(rows, "a double, b double")
    assert tuple(model.cleaning_counts(df, ["a", "b"]).first()) == (2, 3, 5, 0)
    clean = model.clean_features(df, ["a", "b", "c"]).collect()
    assert [tuple(r) for r in clean] == [(1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_profile(spark):
    rows = [(float(i % 7), i, None if i % 2 else float("nan")) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b int, c double")
    by_name = {r["column"]: r for r in profile.describe(df, rows_per_chunk=4).collect()}
    a = np.array([r[0] for r in rows])
    row = by_name["a"]
    assert (row["count"], row.missing, row.distinct) == (50, 0, 7)
    assert (row.q25, row.q50, row.q75) == tuple(np.quantile(a, [0.25, 0.5, 0.75]))
    assert row["std"] == pytest.approx(a.std(ddof=1))
    assert (by_name["c"]["count"], by_name["c"].missing, by_name["c"].distinct) == (0, 50, 0)
    described = profile.describe(df)
    assert profile.most_missing(described, 1).first()["column"] == "c"
    assert [r["column"] for r in profile.few_values(described, 7).collect()] == ["c", "a"]
    assert profile.describe(df, exact=False).count() == 3
    shape = profile.table_shape(df).orderBy("position").collect()
    assert [(r["column"], r.type, r.n_rows) for r in shape] == [("a", "double", 50), ("b", "int", 50), ("c", "double", 50)]
    counts = {(r["column"], r.value): r.n_rows for r in profile.value_counts(df, ["c"]).collect()}
    assert counts == {("c", None): 50}


def test_sinks(spark, tmp_path):
    assert tables.sidecar_path("/a/b.parquet") == "/a/b.meta.json"
    assert tables.sidecar_path("/a/b.parquet", replace=False) == "/a/b.parquet.meta.json"
    df = spark.createDataFrame([("s", BASE, 1.0), ("s", BASE + 86_400_000, 2.0)], "symbol string, open_time bigint, x double")
    tables.write_by_date(df, f"{tmp_path}/dated")
    assert sorted(os.listdir(f"{tmp_path}/dated/symbol=s"))[:2] == ["date=2024-10-01", "date=2024-10-02"]
    trades = spark.createDataFrame([("5", 1.0, 1.0, True, 1)], "time string, price double, qty double, isBuyerMaker boolean, trade_id int")
    tables.write_trades(trades, f"{tmp_path}/trades")
    back = spark.read.parquet(f"{tmp_path}/trades")
    assert [f.dataType for f in back.schema] == [f.dataType for f in tables.TRADE_SCHEMA]
    tables.write_json(spark, f"{tmp_path}/x.json", ["a"])
    assert tables.feature_manifest(tables.read_json(spark, f"{tmp_path}/x.json")) == ["a"]
    for bad in ({}, [], [1]):
        with pytest.raises(ValueError):
            tables.feature_manifest(bad)
