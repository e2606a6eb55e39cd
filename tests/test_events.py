"""Events at their edges: intervals without length, contrasts of just the limit, matches of long recordings."""

import numpy as np

from cadenza.operators import events, intervals, joins, summaries
from cadenza.plans import QUERIES

from .oracle import SF


def test_winner_without_length_rejects_what_holds_it(spark):
    rows = [("a", 1, "frozen", 0, 10, "accepted"), ("a", 2, "dropout", 4, 4, "accepted"), ("b", 3, "frozen", 4, 10, "accepted"), ("b", 4, "dropout", 4, 4, "accepted"), ("c", 5, "frozen", 7, 7, "indeterminate"), ("c", 6, "dropout", 0, 9, "accepted"), ("d", 7, "frozen", 0, 0, "accepted"), ("d", 8, "dropout", 0, 9, "accepted")]
    df = spark.createDataFrame(rows, "rec string, id int, kind string, start long, end long, disposition string")
    out = events.arbitrated(df, ["rec"], [("frozen", "dropout", 0)], 3)
    assert sorted(r.id for r in out.where("arbitrated").collect()) == [1, 5]


def test_contrast_of_just_the_limit_follows_falling_time(spark):
    before, behind = [85.77, 52.42, 41.86, 24.97], [71.86, 54.97, 82.42, 115.77]
    levels = [(1, t, v) for t, v in zip([-9, -8, -7, -6, 6, 7, 8, 9], before + behind, strict=True)]
    bounds = spark.createDataFrame([(1, 1, 0)], "rec int, id int, t long")
    for turned in (levels, levels[::-1]):
        frames = spark.createDataFrame(turned, "rec int, t long, level double").coalesce(1)
        (row,) = summaries.boundary_contrast(frames, bounds, ["rec"], 10, 2, 30.0).collect()
        assert row.contrast == 30.0 and not row.ambiguous


def test_matches_of_many_recordings_are_dealt_over_tasks(spark):
    spans = spark.range(40_000).selectExpr("id % 2000 AS rec", "(id DIV 2000) * 10.0D AS start", "(id DIV 2000) * 10.0D + 6 AS end")
    out = joins.match_events(spans, spans.selectExpr("rec", "start + 1 AS start", "end"), "rec", 0.5)
    assert out.rdd.getNumPartitions() >= 48
    assert {(r.matched, r.n_truth, r.n_found, round(r.median_iou, 9)) for r in out.collect()} == {(20, 20, 20, round(5 / 6, 9))}


def test_a_long_recording_is_matched_by_its_overlaps():
    """A matrix of 60,000 by 60,000 events takes 29 GB."""
    start = np.arange(60_000) * 10.0
    a, b = np.column_stack([start, start + 6]), np.column_stack([start + 4, start + 11])
    assert len(joins._best_scores(a, b, 0.15)) == 60_000


def test_sets_merged_in_several_ways_are_dealt_over_tasks(spark):
    for name in ("segmentation_views", "episode_gap_sensitivity"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert f", {intervals.TASKS}" in plan and "RepartitionByExpression" in plan
