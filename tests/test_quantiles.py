"""Exact quantiles by bins of the value, and the summaries and samples that read them."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import inference, ranks, resample, sensitivity


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(3)
    rows = [(k, None if v > 90 else float(v)) for k in ("a", "b", None) for v in np.concatenate([rng.normal(0, 50, 61), np.full(30, 7.25), [0.0, -0.5, 1e9]])] + [("c", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    levels = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p975": 0.975, "p100": 1.0}
    got = {r.k: [r[n] for n in levels] for r in ranks.quantiles(df, ["k"], "v", levels).collect()}
    want = {r.k: [r[n] for n in levels] for r in df.where("v IS NOT NULL").groupBy("k").agg(*[F.percentile("v", q).alias(n) for n, q in levels.items()]).collect()}
    assert got == want


def test_no_task_holds_all_values_of_a_feature(spark):
    df = spark.range(100).selectExpr("id % 7 AS c", "id * 1.0D AS f", "id")
    for out in (sensitivity.feature_summary(df, ["f"]), inference.describe_features(df, "c", ["f"])):
        assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_balanced_medians_of_many_samples(spark):
    n, times = 60, 53
    rows = [(k % 20, k, float(k * k % 37)) for k in range(n)]
    df = spark.createDataFrame(rows, "c int, id int, v double")
    key = lambda it, k: hashlib.md5(f"20260713|{it}|{k}".encode()).hexdigest()
    medians = [np.median([rows[min(range(c, n, 20), key=lambda k: key(it, k))][2] for c in range(20)]) for it in range(times)]
    out = resample.balanced_medians(df, "c", "id", "v", times)
    # Rows are not copied for each sample before they meet.
    assert "Generate explode(sequence" not in out._jdf.queryExecution().analyzed().toString()
    (row,) = out.collect()
    assert (row.iterations, row["median"]) == (times, np.median(medians))
    assert np.allclose([row.low, row.high], np.quantile(medians, [0.025, 0.975]))


def test_slopes_of_a_long_key_are_found_in_blocks():
    rng = np.random.default_rng(2)
    x, y = np.sort(rng.integers(0, 30, 80)).astype(float), rng.normal(0, 9, 80).round(1)
    places = [0, 400, 1500, 2900]
    assert ranks._kth_slopes(x, y, places, 100) == ranks._kth_slopes(x, y, places)


def test_theil_sen_forms_no_pairs_of_rows_in_a_join(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 3.0), ("a", 2.0, 4.0), ("a", None, 9.0), ("b", 1.0, 1.0)], "k string, x double, y double")
    out = ranks.theil_sen_interval(df, ["k"], "x", "y", 0.1)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.k, r.pairs, r.slope) for r in out.collect()] == [("a", 3, 2.0)]
