"""Operators on small tables with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import quantiles, values
from cadenza.operators import agreement, audit, intervals, joins, measure, ranks, runs, sensitivity


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture()
def three(spark):
    return spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 3.0), ("a", 3.0, 4.0), ("a", 6.0, 7.0), ("a", 6.0, 6.0), (None, 1.0, 2.0)], "rec string, start double, end double")


def test_merged_touching_and_null_keys(three):
    assert sorted((r.rec or "", r.start, r.end, r.n) for r in intervals.merged(three, ["rec"]).collect()) == [("", 1.0, 2.0, 1), ("a", 0.0, 4.0, 3), ("a", 6.0, 7.0, 1)]


def test_gaps_and_complement(spark, three):
    a = three.where("rec = 'a'")
    assert rows(intervals.gaps(a, ["rec"]), "start", "end") == [(4.0, 6.0)]
    spans = spark.createDataFrame([("a", -1.0, 9.0), ("b", 0.0, 1.0)], "rec string, low double, high double")
    assert rows(intervals.complement(a, spans, ["rec"]), "rec", "start", "end") == [("a", -1.0, 0.0), ("a", 4.0, 6.0), ("a", 7.0, 9.0), ("b", 0.0, 1.0)]


def test_guard_order_matters(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.0, 4.0)], "rec int, start double, end double")
    assert rows(intervals.merged_then_guarded(df, ["rec"], 0.5), "start", "end") == [(0.5, 3.5)]
    assert rows(intervals.guarded_then_merged(df, ["rec"], 0.5), "start", "end") == [(0.5, 1.5), (2.5, 3.5)]


def test_erosion_bounds(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 5.0, 8.0)], "rec int, start double, end double")
    assert rows(intervals.eroded(df, 1.0), "start", "end") == [(6.0, 7.0)]
    assert rows(intervals.eroded(df, 1.0, 1.0), "start", "end") == [(6.0, 7.0)]


def test_long_intervals_meet_once(spark):
    a = spark.createDataFrame([(1, 0, 1000)], "rec int, start long, end long")
    b = spark.createDataFrame([(1, 10, 990), (1, 995, 2000)], "rec int, start long, end long")
    assert rows(intervals.intersected(a, b, ["rec"], 7), "start", "end") == [(10, 990), (995, 1000)]


def test_refractory_keeps_best_and_moves(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 3.0), (1, 2.0, 2.0), (1, 5.0, 1.0)], "rec int, t double, score double")
    assert rows(intervals.refractory_best(df, ["rec"], 1.5), "t", "score") == [(1.0, 3.0), (5.0, 1.0)]


def test_runs_and_sustained(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 1, 0, 1, 1, 1, None, 1])], "rec int, i int, v int")
    assert rows(runs.runs(df, ["rec"], ["i"], F.col("v") == 1, 2), "first", "last", "length") == [(0, 1, 2), (3, 5, 3)]
    assert rows(runs.first_sustained(df, ["rec"], ["i"], F.col("v") == 1, 3), "first_index") == [(3,)]


def test_auc_is_null_for_one_class(spark):
    df = spark.createDataFrame([("x", 1.0, 1), ("x", 2.0, 1), ("y", 1.0, 0), ("y", 1.0, 1)], "k string, s double, l int")
    assert rows(ranks.auc(df, ["k"], "s", "l").select("k", F.coalesce("auc", F.lit(-1.0)).alias("auc")), "k", "auc") == [("x", -1.0), ("y", 0.5)]


def test_false_discovery_monotone(spark):
    df = spark.createDataFrame([(1, 0.01), (1, 0.02), (1, 0.04), (1, None)], "k int, p double")
    got = sorted((r.p, round(r.q, 6)) for r in ranks.false_discovery(df, ["k"], "p").collect() if r.p is not None)
    assert got == [(0.01, 0.03), (0.02, 0.03), (0.04, 0.04)]


def test_checked_join_rejects_repeated_keys(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(1, "y"), (1, "z")], "k int, b string")
    assert joins.checked_join(a, b, ["k"], validate="one_to_many").count() == 2
    with pytest.raises(Exception, match="repeats a key"):
        joins.checked_join(a, b, ["k"]).collect()


def test_assignment_against_all_permutations():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m in ((3, 3), (2, 4), (4, 2), (5, 5)):
        cost = rng.random((n, m))
        small, large = min(n, m), max(n, m)
        best = min(sum((cost if n <= m else cost.T)[i, p[i]] for i in range(small)) for p in permutations(range(large), small))
        assert math.isclose(sum(cost[i, j] for i, j in joins.assign(cost)), best)


def test_match_events(spark):
    t = spark.createDataFrame([("r", 0.0, 1.0), ("r", 2.0, 3.0), ("s", 0.0, 1.0)], "rec string, start double, end double")
    f = spark.createDataFrame([("r", 0.1, 1.0), ("r", 5.0, 6.0)], "rec string, start double, end double")
    got = {r.rec: (r.matched, r.n_truth, r.n_found) for r in joins.match_events(t, f, "rec").collect()}
    assert got == {"r": (1, 2, 2), "s": (0, 1, 0)}


def test_quantile_functions():
    assert math.isclose(quantiles.normal_quantile(0.975), values.Z95, rel_tol=1e-9)
    low, high = quantiles.poisson_bounds(0)
    assert low == 0 and math.isclose(high, -math.log(0.025), rel_tol=1e-9)
    low, high = quantiles.binomial_bounds(0, 10)
    assert low == 0 and math.isclose(high, 1 - 0.025 ** (1 / 10), rel_tol=1e-9)


def test_quantile_columns(spark):
    df = spark.createDataFrame([(3.0, 60.0), (0.0, 0.0)], "k double, e double")
    got = df.select(quantiles.poisson_rate_interval("k", "e").alias("i")).select("i.*").collect()
    assert math.isclose(got[0].low, 0.618672, rel_tol=1e-5) and math.isclose(got[0].high, 8.767273, rel_tol=1e-5)


def test_rules_and_gates(spark):
    df = spark.createDataFrame([(1, "YES", 5.0), (2, " no ", 50.0), (3, "perhaps", None)], "id int, w string, x double")
    ledger = audit.issues(df, "id", [audit.one_of("w", ("YES", "NO")), audit.in_range("x", 0, 10), audit.required("x")])
    assert rows(ledger, "id", "rule") == [(2, "value_out_of_range"), (3, "required_value_missing"), (3, "value_not_allowed")]
    gated = audit.gates(df, "id", audit.dispositions(ledger, {"value_out_of_range": "flag"}))
    assert rows(gated, "id", "eligible") == [(1, True), (2, True), (3, False)]


def test_consensus_ties(spark):
    df = spark.createDataFrame([("a", "r1", 1), ("a", "r2", 1), ("b", "r1", 1), ("b", "r2", 0), ("c", "r1", 1)], "item string, rater string, rating int")
    assert rows(agreement.consensus(df, "item", "rating", 2).select("item", "status"), "item", "status") == [("a", "majority"), ("b", "tie"), ("c", "insufficient")]


def test_text_functions(spark):
    df = spark.createDataFrame([("S1_P_2_20240131_T3_rest task.WAV", " a \t b ", "Yes", "1e3", "x")], "n string, t string, b string, v string, w string")
    r = df.select(values.media_name_parts(F.col("n")).alias("m"), values.normal_text(F.col("t")).alias("t"), values.as_bool(F.col("b")).alias("b"), values.to_number(F.col("v")).alias("v"), values.to_number(F.col("w")).alias("w")).first()
    assert (r.m.subject, r.m.task, r.m.suffix, str(r.m.date), r.t, r.b, r.v, r.w) == ("S1", "rest task", "wav", "2024-01-31", "a b", True, 1000.0, None)


def test_hum_and_flatness():
    fs = 16000
    t = np.arange(fs // 2) / fs
    hum = sum(np.sin(2 * np.pi * 50 * k * t) for k in range(1, 5)) + 1e-3 * np.random.default_rng(0).standard_normal(len(t))
    f, p = measure.power_spectrum(hum, fs)
    assert measure.hum_score(f, p, 50.0)[0] > 30 and measure.hum_score(f, p, 60.0)[0] < 10
    noise = np.random.default_rng(1).standard_normal(len(t))
    assert measure.flatness(*measure.power_spectrum(noise, fs)) > 0.4 > measure.flatness(f, p)


def test_spectrum_descriptors_of_white_noise():
    f = np.linspace(0, 8000, 1025)
    rolloff, high, tilt = measure.describe_spectrum(f, np.ones_like(f))
    assert abs(rolloff - (100 + 0.95 * 7400)) < 10 and abs(high - 4500 / 7400) < 0.01 and abs(tilt) < 1e-9


def test_plateaus_and_dropouts(spark):
    x = [0.0, 0.5, 1.0, 1.0, 1.0, 0.2, -1.0, -1.0, -1.0, -1.0, 0.3]
    df = spark.createDataFrame([("r", 10.0, x)], "rec string, fs double, samples array<double>")
    assert rows(measure.plateaus(df), "first", "last", "length") == [(2, 4, 3), (6, 9, 4)]
    feature = measure.distortion_features(df, measure.plateaus(df), 5).first()
    assert (feature.events, round(feature.sample_fraction, 6), feature.frame_fraction) == (2, round(7 / 11, 6), 1.0)
    y = [0.5, -0.5] * 4 + [0.0] * 5 + [0.5, -0.5] * 4
    df = spark.createDataFrame([("r", 10.0, y)], "rec string, fs double, samples array<double>")
    assert rows(measure.dropouts(df, 4, 4, 0.3), "first", "length", "disposition") == [(8, 5, "accepted")]


def test_splice_is_found(spark):
    t = np.arange(512)
    x = np.sin(0.2 * t)
    x[256:] = np.sin(0.2 * t[256:] + 2.5)
    x += 1e-4 * np.random.default_rng(5).standard_normal(512)
    df = spark.createDataFrame([("r", 100.0, x.tolist())], "rec string, fs double, samples array<double>")
    found = {r.i for r in measure.continuity_scores(df, 512, 8, 8.0).collect()}
    assert found and all(abs(i - 256) <= 10 for i in found)


def test_frames_never_cross_intervals(spark):
    x = np.random.default_rng(2).standard_normal(400).tolist()
    rec = spark.createDataFrame([("r", 100.0, x)], "rec string, fs double, samples array<double>")
    spans = spark.createDataFrame([("r", 0, 0.0, 1.0), ("r", 1, 1.0, 1.05), ("r", 2, 2.0, 4.0)], "rec string, idx int, start double, end double")
    got = measure.frame_ledger(rec, spans, measure.Frames(100.0, 50.0)).collect()
    assert {r.idx for r in got} == {0, 2} and all(r.start + 0.1 <= (1.0 if r.idx == 0 else 4.0) + 1e-9 for r in got)


def test_tail_features(spark):
    rel = [k * 0.01 + 0.005 for k in range(110)]
    level = [-20 - 100 * t if t < 0.4 else -60.0 + (0.1 if k % 2 else 0.0) for k, t in enumerate(rel)]
    trace = spark.createDataFrame([("r", 0, t, lv, False) for t, lv in zip(rel, level, strict=True)], "rec string, boundary int, rel double, level double, at_floor boolean")
    bounds = spark.createDataFrame([("r", 0, 1.1), ("r", 1, 0.3)], "rec string, boundary int, pause double")
    out = {r.boundary: r for r in measure.boundary_features(trace, bounds).collect()}
    assert out[1].reason == "pause_shorter_than_floor_window" and out[1].tail_excess is None
    assert out[0].reason == "ok" and abs(out[0].decay_rate - 100) < 1e-6 and 0.35 < out[0].persistence < 0.4
    feature = measure.reverb_features(measure.boundary_features(trace, bounds)).first()
    assert feature.tail_excess is None and feature.tail_excess_status == "insufficient_boundaries" and feature.srmr_status == "dependency_unavailable"


def test_policies_keep_recordings_without_value(spark):
    df = spark.createDataFrame([(1, 2.0), (3, None), (5, 4.0)], "n int, v double")
    assert rows(sensitivity.policy_availability(df, "n", "v", [1, 4]), "minimum_count", "recordings", "available") == [(1, 3, 2), (4, 3, 1)]
