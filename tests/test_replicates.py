"""Bootstraps by groups of replicates: the same draws as by hash, ranks and medians against rows that are copied."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import replicates, resample, robust

N, TIMES = 31, 5


def copied(cluster, replicate):
    """Row numbers of a replicate, a row as often as its cluster is drawn."""
    w = np.bincount(replicates.drawn(resample.SEED, replicate, N), minlength=N)
    return np.repeat(np.arange(len(cluster)), w[cluster])


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    cluster = rng.permutation(np.repeat(np.arange(N), 40))
    # Ties that run over the ends of pieces, and one long tie.
    return cluster, np.where(rng.random(len(cluster)) < 0.4, 3.0, rng.integers(-4, 40, len(cluster))).astype(float), rng.integers(0, 6, len(cluster)).astype(float)


def ranks(v):
    order = np.argsort(v, kind="stable")
    _, inverse, counts = np.unique(v[order], return_inverse=True, return_counts=True)
    out = np.empty(len(v))
    out[order] = (np.cumsum(counts) - counts + (counts + 1) / 2)[inverse]
    return out


def spread(values):
    return [np.quantile(values, 0.025), np.quantile(values, 0.975)]


def test_draws_are_those_of_the_hash(spark):
    rows = spark.range(25).select(F.col("id"), resample.draw(F.lit(25), F.lit(7), F.col("id")).alias("x")).collect()
    assert replicates.drawn(resample.SEED, 7, 25).tolist() == [r.x for r in sorted(rows)]
    assert len(replicates.drawn(resample.SEED, 1, 100_001)) == 100_001


@pytest.mark.parametrize("statistic", ["spearman", "auc"])
def test_ranked_statistics_of_copied_rows(spark, sample, statistic):
    c, x, y = sample
    y = (y > 2).astype(float) if statistic == "auc" else y

    def value(at):
        a = ranks(x[at])
        if statistic == "spearman":
            return np.corrcoef(a, ranks(y[at]))[0, 1]
        pos = y[at].sum()
        return (a[y[at] == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(at) - pos))

    df = spark.createDataFrame([(f"p{k:02d}", float(a), float(b)) for k, a, b in zip(c, x, y, strict=True)], "c string, x double, y double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        (row,) = robust.bootstrap_statistic(df, "c", statistic, "x", "y", TIMES).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (row.clusters, row.replicates) == (N, TIMES)
    want = [value(np.arange(len(c))), *spread([value(copied(c, r)) for r in range(TIMES)])]
    assert np.allclose([row.estimate, row.ci_low, row.ci_high], want, rtol=0, atol=1e-12)


def test_median_of_copied_rows(spark, sample):
    c, x, _ = sample
    df = spark.createDataFrame([(int(k), float(a)) for k, a in zip(c, x, strict=True)], "c int, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        (row,) = resample.bootstrap_median(df, "c", "x", TIMES).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [row.estimate, row.ci_low, row.ci_high] == [np.median(x), *spread([np.median(x[copied(c, r)]) for r in range(TIMES)])]


def test_no_rows_are_one_row_without_figures(spark):
    (row,) = robust.bootstrap_statistic(spark.createDataFrame([], "c int, x double, y double"), "c", "icc", "x", "y", 3).collect()
    assert (row.estimate, row.ci_low, row.replicates, row.clusters) == (None, None, 0, 0)


@pytest.mark.parametrize("statistic", ["spearman", "icc"])
def test_no_row_meets_its_replicates(spark, statistic):
    """Replicates times clusters or rows are formed by no join, and no window takes all clusters."""
    df = spark.range(900).selectExpr("id % 300 AS c", "id * 1.0D AS x", "(id * 7) % 13 * 1.0D AS y")
    out = robust.bootstrap_statistic(df, "c", statistic, "x", "y", 200)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 199" not in plan and plan.count("MapInArrow") >= 2
    (row,) = out.collect()
    assert row.replicates == 200 and math.isfinite(row.estimate)
