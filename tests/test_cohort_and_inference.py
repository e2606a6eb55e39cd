"""Cohort rules that must fail, persistence against its closed form, reference and resampling details."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import cohort, inference, reference, resample


def test_reml_equals_the_balanced_closed_form():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((30, 1)) * 1.5 + rng.standard_normal((30, 4))
    within = ((x - x.mean(1, keepdims=True)) ** 2).sum()
    msb, msw = 4 * x.mean(1).var(ddof=1), within / (30 * 3)
    theta = inference.reml_ratio(np.full(30, 4.0), x.mean(1), within)
    assert abs(theta - (msb - msw) / (4 * msw)) < 1e-4
    flat = np.tile([-1.0, 1.0], (10, 1))
    assert inference.reml_ratio(np.full(10, 2.0), flat.mean(1), (flat**2).sum()) < 1e-3


def test_persistence_statuses(spark):
    rows = [(s, float(s + 0.1 * k), None if s else 1.0) for s in range(8) for k in range(3)]
    out = {r.feature: r for r in inference.persistence(spark.createDataFrame(rows, "subject int, f double, g double"), "subject", ["f", "g"]).collect()}
    assert out["f"].status == "ok" and out["f"].icc > 0.95
    assert out["g"].status == "insufficient_participants" and out["g"].icc is None


def test_manual_decisions_may_not_contradict(spark):
    df = spark.createDataFrame([(1, "ALS"), (2, None)], "subject int, diagnosis string")
    manual = lambda s, d: spark.createDataFrame([(s, d)], "subject int, diagnosis string")
    ok = cohort.resolve(df, manual(2, " als"), "subject", "diagnosis", ["ALS", "CONTROL"])
    assert sorted((r.subject, r.resolved, r.origin) for r in ok.collect()) == [(1, "ALS", "reported"), (2, "ALS", "manual")]
    for s, d, message in ((1, "CONTROL", "contradicts"), (2, "maybe", "not allowed")):
        with pytest.raises(Exception, match=message):
            cohort.resolve(df, manual(s, d), "subject", "diagnosis", ["ALS", "CONTROL"]).collect()


@pytest.mark.parametrize(("rows", "message"), [([("a", "KEEP")], "missing from the sheet"), ([("a", "KEEP"), ("b", "KEEP"), ("b", "KEEP")], "repeats"), ([("a", "KEEP"), ("b", "")], "open or unknown"), ([("a", "KEEP"), ("b", "KEEP"), ("c", "KEEP")], "summary has not")])
def test_adjudication_contract(spark, rows, message):
    summary = spark.createDataFrame([("a", 1), ("b", 2)], "rec string, n int")
    with pytest.raises(Exception, match=message):
        cohort.apply_adjudication(summary, spark.createDataFrame(rows, "rec string, decision string"), "rec").collect()


@pytest.mark.parametrize(("rows", "message"), [([(1, 0.0, 1.0)], "numbered"), ([(0, 0.0, 2.0), (1, 1.0, 3.0)], "overlap"), ([(0, 0.0, 11.0)], "outside")])
def test_manual_intervals_contract(spark, rows, message):
    df = spark.createDataFrame([("a", *r) for r in rows], "rec string, idx int, start double, end double")
    with pytest.raises(Exception, match=message):
        cohort.validated_overrides(df, spark.createDataFrame([("a", 10.0)], "rec string, duration double"), "rec").collect()


def test_reference_median_without_the_subject(spark):
    rng = np.random.default_rng(1)
    power = {s: float(v) for s, v in enumerate(rng.random(9).round(2))}
    rows = [(s, "t", s, 0, v) for s, v in power.items()]
    out = {r.excluded: r.reference for r in reference.loso_references(spark.createDataFrame(rows, "id int, task string, subject int, bin int, power double")).collect()}
    assert all(abs(out[s] - np.median([v for k, v in power.items() if k != s])) < 1e-12 for s in power)


def test_replicates_draw_as_many_as_there_are(spark):
    df = spark.createDataFrame([(i,) for i in range(25)], "c int")
    w = resample.replicate_weights(df, "c", 7).groupBy("replicate").agg(F.sum("weight").alias("n")).collect()
    assert len(w) == 7 and {r.n for r in w} == {25}
