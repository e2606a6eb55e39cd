"""Interval and run queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import joins, runs
from .base import FRAMES, INTERVALS, ISLANDS, SECOND, frames, intervals

REC = ["rec"]
HOUR = 3600 * SECOND
#: Width of the bins that interval joins are dealt over, microseconds.
BIN = 48 * HOUR
ISL0, ISL_BRIDGE = ISLANDS.format(gap=0), ISLANDS.format(gap=2 * HOUR)
SECS = lambda c: (F.col(c) / float(SECOND))


def interval_union(spark, sf):
    out = iv.union_length(intervals(spark, sf), REC)
    return out.select("rec", SECS("length").alias("union_sec"), "islands")


def interval_merged(spark, sf):
    return iv.merged(intervals(spark, sf), REC)


def interval_bridge(spark, sf):
    return iv.bridged(intervals(spark, sf), REC, 2 * HOUR, 24 * HOUR).drop("n")


def interval_erode(spark, sf):
    return iv.eroded(intervals(spark, sf), 3 * HOUR, HOUR).select("rec", "id", "start", "end")


def interval_merge_then_guard(spark, sf):
    return iv.merged_then_guarded(intervals(spark, sf), REC, 6 * HOUR).drop("n")


def interval_guard_then_merge(spark, sf):
    return iv.guarded_then_merged(intervals(spark, sf), REC, 6 * HOUR).drop("n")


def interval_gaps(spark, sf):
    return iv.gaps(intervals(spark, sf), REC)


def interval_complement(spark, sf):
    rows = intervals(spark, sf)
    spans = rows.groupBy("rec").agg((F.min("start") - HOUR).alias("low"), (F.max("start") + HOUR).alias("high"))
    return iv.complement(rows, spans, REC)


def interval_intersect(spark, sf):
    rows = intervals(spark, sf)
    return iv.intersected(rows.where("kind IN ('click', 'view')").select("rec", "start", "end"), rows.where("kind NOT IN ('click', 'view')").select("rec", "start", "end"), REC, BIN)


def point_in_interval(spark, sf):
    return iv.members(frames(spark, sf).select("rec", "id", "t"), intervals(spark, sf).select("rec", "start", "end"), REC, BIN)


def boundary_distance(spark, sf):
    odd = intervals(spark, sf).where("id % 2 = 1").select("rec", "start", "end")
    return iv.nearest_boundary(frames(spark, sf).where("id % 2 = 0").select("rec", "id", "t"), odd, REC)


def interval_iou_pairs(spark, sf):
    rows = intervals(spark, sf)
    pair = iv.overlaps(rows.where("id % 2 = 0").select("rec", "id", "start", "end"), rows.where("id % 2 = 1").select("rec", "id", "start", "end"), REC, BIN)
    return pair.select("rec", "id", "r_id", F.round(iv.iou(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")), 9).alias("iou"))


def pause_boundaries(spark, sf):
    return iv.pause_boundaries(intervals(spark, sf), REC)


def shifted_offsets(spark, sf):
    return iv.shifted_offsets(intervals(spark, sf), REC, 8 * HOUR, HOUR, HOUR // 2)


def segmentation_views(spark, sf):
    return iv.segmentation_views(intervals(spark, sf), REC, 2 * HOUR, 24 * HOUR, 3 * HOUR, 2 * HOUR)


def touched_frames(spark, sf):
    return iv.touched_frames(intervals(spark, sf).select("rec", "start", "end"), REC, 24 * HOUR).groupBy("rec").agg(F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"))


def episode_gap_sensitivity(spark, sf):
    rows, out = intervals(spark, sf).repartition(iv.TASKS, "rec"), None
    for hours in (0, 2, 12, 48):
        part = iv.merged(rows, REC, hours * HOUR).groupBy("rec").agg(F.count(F.lit(1)).alias("episodes"), F.max("n").alias("largest")).withColumn("gap_hours", F.lit(hours))
        out = part if out is None else out.unionByName(part)
    return out


def run_lengths(spark, sf):
    return runs.runs(frames(spark, sf), REC, ["t", "id"], F.col("level") > 100, 2)


def k_consecutive_first(spark, sf):
    return runs.first_sustained(frames(spark, sf), REC, ["t", "id"], F.col("level") > 150, 3)


def segment_step_rate(spark, sf):
    return runs.steps(frames(spark, sf), REC, "kind", ["t", "id"], "level", 120.0)


def rolling_sums(spark, sf):
    return runs.rolling(frames(spark, sf), REC, ["t", "id"], "level", 5).select("rec", "id", F.round("rolling_sum", 6).alias("rolling_sum"))


def context_windows(spark, sf):
    return runs.context_maxima(frames(spark, sf), REC, ["t", "id"], "level", 4).select("rec", "id", "before_max", "after_max")


def nonincreasing_thresholds(spark, sf):
    return runs.nonincreasing(frames(spark, sf).select("rec", "id", "level"), REC, "id", "level")


def level_clusters(spark, sf):
    return runs.level_clusters(frames(spark, sf).select("rec", "id", "level"), REC, "level", 5.0).groupBy("rec", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("low"), F.max("level").alias("high"))


def segment_roles(spark, sf):
    return runs.segment_roles(frames(spark, sf), REC, ["t", "id"], F.col("level") > 100).groupBy("rec", "role").agg(F.count(F.lit(1)).alias("n"))


def nearest_event(spark, sf):
    f = frames(spark, sf)
    return joins.nearest(f.where("kind = 'click'").select("rec", "id", "t"), f.where("kind = 'view'").select("rec", "t", F.col("id").alias("view_id")), REC, "t", "view_id", 72.0 * HOUR).select("rec", "id", "near_t")


def as_of_level(spark, sf):
    f = frames(spark, sf)
    return joins.as_of(f.where("kind = 'click'").select("rec", "id", "t"), f.where("kind <> 'click'").groupBy("rec", "t").agg(F.max("level").alias("level")), REC, "t", "level").select("rec", "id", "level")


def media_coverage(spark, sf):
    f = frames(spark, sf)
    return joins.coverage(f.where("level > 400").select("rec", "kind"), f.where("level < 90").select("rec", "kind"), ["rec", "kind"])


def matched_events(spark, sf):
    rows = intervals(spark, sf)
    return joins.match_events(iv.merged(rows.where("id % 2 = 0"), REC), iv.merged(rows.where("id % 2 = 1"), REC), "rec", 0.1)


def refractory_events(spark, sf):
    return iv.refractory_best(frames(spark, sf).select("rec", "t", F.col("level").alias("score")), REC, 24.0 * HOUR)


QUERIES = {f.__name__: f for f in (interval_union, interval_merged, interval_bridge, interval_erode, interval_merge_then_guard, interval_guard_then_merge, interval_gaps, interval_complement, interval_intersect, point_in_interval, boundary_distance, interval_iou_pairs, pause_boundaries, shifted_offsets, segmentation_views, touched_frames, episode_gap_sensitivity, run_lengths, k_consecutive_first, segment_step_rate, rolling_sums, context_windows, nonincreasing_thresholds, level_clusters, segment_roles, nearest_event, as_of_level, media_coverage, matched_events, refractory_events)}

_GAPS = "gp AS (SELECT rec, e AS s, lead(s) OVER (PARTITION BY rec ORDER BY s) AS e FROM isl)"


def _islands(source: str, name: str, gap: int = 0) -> str:
    return f"""{name}1 AS (SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {source} WHERE e > s),
{name}2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}1),
{name} AS (SELECT rec, min(s) AS s, max(e) AS e, count(*) AS n FROM {name}2 GROUP BY rec, g)"""


_FLAG_RUNS = f"""WITH {FRAMES}, a AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY t, id) - 1 AS i FROM fr)"""

ORACLES = {
    "interval_union": f"WITH {INTERVALS}, {ISL0} SELECT rec, sum(e - s) / 1e6 AS union_sec, count(*) AS islands FROM isl GROUP BY rec",
    "interval_merged": f'WITH {INTERVALS}, {ISL0} SELECT rec, s AS "start", e AS "end", n FROM isl',
    "interval_bridge": f'WITH {INTERVALS}, {ISL_BRIDGE} SELECT rec, s AS "start", e AS "end" FROM isl WHERE e - s >= {24 * HOUR}',
    "interval_erode": f'WITH {INTERVALS} SELECT rec, id, s + {3 * HOUR} AS "start", e - {3 * HOUR} AS "end" FROM iv WHERE e - s - {6 * HOUR} >= {HOUR}',
    "interval_merge_then_guard": f'WITH {INTERVALS}, {ISL0} SELECT rec, s + {6 * HOUR} AS "start", e - {6 * HOUR} AS "end" FROM isl WHERE e - s > {12 * HOUR}',
    "interval_guard_then_merge": f'WITH {INTERVALS}, gd AS (SELECT rec, s + {6 * HOUR} AS s, e - {6 * HOUR} AS e FROM iv), {_islands("gd", "q")} SELECT rec, s AS "start", e AS "end" FROM q',
    "interval_gaps": f'WITH {INTERVALS}, {ISL0}, {_GAPS} SELECT rec, s AS "start", e AS "end" FROM gp WHERE e > s',
    "interval_complement": f"""WITH {INTERVALS}, sp AS (SELECT rec, min(s) - {HOUR} AS lo, max(s) + {HOUR} AS hi FROM iv GROUP BY rec),
        ct AS (SELECT iv.rec, greatest(s, lo) AS s, least(e, hi) AS e FROM iv JOIN sp ON iv.rec = sp.rec), {_islands("ct", "q")},
        u AS (SELECT rec, s, e FROM q UNION ALL SELECT rec, lo, lo FROM sp UNION ALL SELECT rec, hi, hi FROM sp),
        p AS (SELECT rec, e AS s, lead(s) OVER (PARTITION BY rec ORDER BY s, e) AS e FROM u)
        SELECT rec, s AS "start", e AS "end" FROM p WHERE e > s""",
    "interval_intersect": f"""WITH {INTERVALS}, a0 AS (SELECT * FROM iv WHERE kind IN ('click', 'view')), b0 AS (SELECT * FROM iv WHERE kind NOT IN ('click', 'view')), {_islands("a0", "a")}, {_islands("b0", "b")}
        SELECT a.rec, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end" FROM a JOIN b ON a.rec = b.rec AND a.s < b.e AND b.s < a.e""",
    "point_in_interval": f"WITH {FRAMES}, {INTERVALS} SELECT fr.rec, fr.id, fr.t, count(iv.id) AS inside FROM fr LEFT JOIN iv ON fr.rec = iv.rec AND iv.s <= fr.t AND fr.t < iv.e GROUP BY 1, 2, 3",
    "boundary_distance": f"""WITH {FRAMES}, {INTERVALS}, b AS (SELECT rec, s AS x FROM iv WHERE id % 2 = 1 UNION SELECT rec, e FROM iv WHERE id % 2 = 1)
        SELECT fr.rec, fr.id, fr.t, min(abs(fr.t - b.x)) AS distance FROM fr LEFT JOIN b ON fr.rec = b.rec WHERE fr.id % 2 = 0 GROUP BY 1, 2, 3""",
    "interval_iou_pairs": f"""WITH {INTERVALS} SELECT a.rec, a.id, b.id AS r_id, round((least(a.e, b.e) - greatest(a.s, b.s)) / CAST((a.e - a.s) + (b.e - b.s) - (least(a.e, b.e) - greatest(a.s, b.s)) AS DOUBLE), 9) AS iou
        FROM iv a JOIN iv b ON a.rec = b.rec AND a.s < b.e AND b.s < a.e WHERE a.id % 2 = 0 AND b.id % 2 = 1""",
    "pause_boundaries": f"""WITH {INTERVALS}, {ISL0}, p AS (SELECT rec, row_number() OVER w - 1 AS left_index, e, lead(s) OVER w AS nx FROM isl WINDOW w AS (PARTITION BY rec ORDER BY s))
        SELECT rec, left_index, left_index + 1 AS right_index, e AS "offset", nx AS onset, nx - e AS pause FROM p WHERE nx IS NOT NULL""",
    "shifted_offsets": f"""WITH {INTERVALS}, {ISL0}, p AS (SELECT *, lead(s) OVER (PARTITION BY rec ORDER BY s) AS nx FROM isl)
        SELECT rec, s AS "start", CASE WHEN nx IS NULL THEN e ELSE greatest(least(e + {8 * HOUR}, nx - {HOUR // 2}), s + {HOUR}) END AS "end" FROM p""",
    "segmentation_views": f"""WITH {INTERVALS}, {_islands("iv", "r")}, {_islands("iv", "b", 2 * HOUR)}, pr AS (SELECT * FROM b WHERE e - s >= {24 * HOUR}),
        g AS (SELECT rec, e AS s, lead(s) OVER (PARTITION BY rec ORDER BY s) AS e FROM pr),
        v AS (SELECT rec, 'raw_speech' AS view, s, e FROM r UNION ALL SELECT rec, 'primary_speech', s, e FROM pr
              UNION ALL SELECT rec, 'strict_speech', s + {3 * HOUR}, e - {3 * HOUR} FROM pr WHERE e - s > {6 * HOUR}
              UNION ALL SELECT rec, 'strict_internal_nonspeech', s + {2 * HOUR}, e - {2 * HOUR} FROM g WHERE e - s > {4 * HOUR})
        SELECT rec, view, s AS "start", e AS "end", row_number() OVER (PARTITION BY rec, view ORDER BY s) - 1 AS interval_index FROM v""",
    "touched_frames": f"""WITH {INTERVALS}, f AS (SELECT DISTINCT rec, unnest(range(CAST(floor(s / {24 * HOUR}.0) AS BIGINT), CAST(floor((e - 1) / {24 * HOUR}.0) AS BIGINT) + 1)) AS frame FROM iv WHERE e > s)
        SELECT rec, count(*) AS frames, min(frame) AS first, max(frame) AS last FROM f GROUP BY rec""",
    "episode_gap_sensitivity": f"WITH {INTERVALS}, " + ", ".join(_islands("iv", f"g{h}_", h * HOUR) for h in (0, 2, 12, 48)) + " " + " UNION ALL ".join(f"SELECT rec, count(*) AS episodes, max(n) AS largest, {h} AS gap_hours FROM g{h}_ GROUP BY rec" for h in (0, 2, 12, 48)),
    "run_lengths": _FLAG_RUNS + """, b AS (SELECT *, i - row_number() OVER (PARTITION BY rec ORDER BY i) AS g FROM a WHERE level > 100)
        SELECT rec, min(i) AS first, max(i) AS last, count(*) AS length FROM b GROUP BY rec, g HAVING count(*) >= 2""",
    "k_consecutive_first": _FLAG_RUNS + """, b AS (SELECT *, count_if(level > 150) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS c FROM a)
        SELECT rec, min(i) FILTER (WHERE c = 3) AS first_index FROM b GROUP BY rec""",
    "segment_step_rate": f"""WITH {FRAMES}, d AS (SELECT rec, abs(level - lag(level) OVER (PARTITION BY rec, kind ORDER BY t, id)) AS d FROM fr)
        SELECT rec, count(d) AS pairs, count(*) FILTER (WHERE d >= 120) AS steps, CASE WHEN count(d) > 0 THEN count(*) FILTER (WHERE d >= 120) / count(d)::DOUBLE END AS rate FROM d GROUP BY rec""",
    "rolling_sums": f"""WITH {FRAMES} SELECT rec, id, round(CASE WHEN count(*) OVER w = 5 THEN sum(level) OVER w END, 6) AS rolling_sum FROM fr WINDOW w AS (PARTITION BY rec ORDER BY t, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "context_windows": f"""WITH {FRAMES} SELECT rec, id, max(level) OVER (PARTITION BY rec ORDER BY t, id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before_max, max(level) OVER (PARTITION BY rec ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS after_max FROM fr""",
    "nonincreasing_thresholds": f"WITH {FRAMES} SELECT rec, id, level, max(level) OVER (PARTITION BY rec ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS conservative FROM fr",
    "level_clusters": f"""WITH {FRAMES}, d AS (SELECT rec, level, CASE WHEN lag(level) OVER w IS NULL OR level - lag(level) OVER w > 5.0::DOUBLE THEN 1 ELSE 0 END AS nw FROM fr WINDOW w AS (PARTITION BY rec ORDER BY level)),
        c AS (SELECT rec, level, sum(nw) OVER (PARTITION BY rec ORDER BY level RANGE UNBOUNDED PRECEDING) AS cluster FROM d)
        SELECT rec, cluster, count(*) AS n, min(level) AS low, max(level) AS high FROM c GROUP BY 1, 2""",
    "segment_roles": _FLAG_RUNS + """, b AS (SELECT rec, CASE WHEN level > 100 THEN 'speech' WHEN i = 0 THEN 'leading' WHEN i = count(*) OVER (PARTITION BY rec) - 1 THEN 'trailing' ELSE 'internal' END AS role FROM a)
        SELECT rec, role, count(*) AS n FROM b GROUP BY 1, 2""",
    "refractory_events": f"""WITH RECURSIVE {FRAMES}, r AS (SELECT rec, t, level AS score, row_number() OVER (PARTITION BY rec ORDER BY t, level) AS k FROM fr),
        p AS (SELECT rec, k, t, score, CAST([] AS STRUCT(t BIGINT, score DOUBLE)[]) AS done FROM r WHERE k = 1
              UNION ALL SELECT p.rec, r.k, CASE WHEN r.t - p.t <= {24 * HOUR} AND r.score <= p.score THEN p.t ELSE r.t END, CASE WHEN r.t - p.t <= {24 * HOUR} AND r.score <= p.score THEN p.score ELSE r.score END, CASE WHEN r.t - p.t <= {24 * HOUR} THEN done ELSE list_append(done, struct_pack(t := p.t, score := p.score)) END FROM p JOIN r ON p.rec = r.rec AND r.k = p.k + 1),
        e AS (SELECT rec, arg_max(list_append(done, struct_pack(t := t, score := score)), k) AS l FROM p GROUP BY rec), u AS (SELECT rec, unnest(l) AS x FROM e) SELECT rec, x.t AS t, x.score AS score FROM u""",
    "nearest_event": f"""WITH {FRAMES}, p AS (SELECT a.rec, a.id, a.t, b.t AS bt, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.t - b.t), b.t) AS k FROM fr a JOIN fr b ON a.rec = b.rec AND b.kind = 'view' WHERE a.kind = 'click')
        SELECT a.rec, a.id, CASE WHEN abs(p.bt - a.t) <= {72 * HOUR} THEN p.bt END AS near_t FROM fr a LEFT JOIN p ON a.id = p.id AND p.k = 1 WHERE a.kind = 'click'""",
    "as_of_level": f"""WITH {FRAMES}, o AS (SELECT rec, t, max(level) AS level FROM fr WHERE kind <> 'click' GROUP BY 1, 2)
        SELECT a.rec, a.id, (SELECT arg_max(o.level, o.t) FROM o WHERE o.rec = a.rec AND o.t <= a.t) AS level FROM fr a WHERE kind = 'click'""",
    "media_coverage": f"""WITH {FRAMES}, a AS (SELECT DISTINCT rec, kind FROM fr WHERE level > 400), b AS (SELECT DISTINCT rec, kind FROM fr WHERE level < 90)
        SELECT coalesce(a.rec, b.rec) AS rec, coalesce(a.kind, b.kind) AS kind, CASE WHEN a.rec IS NULL THEN 'right_only' WHEN b.rec IS NULL THEN 'left_only' ELSE 'both' END AS coverage FROM a FULL JOIN b ON a.rec = b.rec AND a.kind = b.kind""",
}
