"""Segmentation and feature-table summaries, event arbitration and matching, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import events, ranks, summaries
from ..operators import intervals as iv
from .base import FRAMES, INTERVALS, ISLANDS, RATINGS, REPEATS, frames, intervals, ratings, repeats, table

HOUR = 3_600_000_000
BIN = 48 * HOUR
REC = ["rec"]


def frame_diagnostics(spark, sf):
    f = frames(spark, sf)
    views = intervals(spark, sf).select("rec", F.when(F.col("kind").isin("click", "view"), "raw_speech").otherwise("strict_speech").alias("view"), "start", "end")
    return summaries.frame_diagnostics(f.select("rec", "id", "t"), views, ["raw_speech", "strict_speech"], REC, BIN).select("id", "raw_speech", "strict_speech")


def _summary(spark, sf):
    speech = iv.bridged(intervals(spark, sf).where("kind = 'click'"), REC, 0, 2 * HOUR)
    spans = intervals(spark, sf).groupBy("rec").agg(((F.max("end") - F.min("start")) / 1e6).alias("duration"))
    seconds = speech.select("rec", (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"))
    return summaries.segmentation_summary(seconds, spans, frames(spark, sf).select("rec", (F.col("level") / 7 - 63).alias("level")), REC)


def segmentation_summary(spark, sf):
    return _summary(spark, sf).select("rec", "segments", "pauses", *[F.round(c, 4).alias(c) for c in ("duration", "speech", "longest_pause", "speech_fraction", "rms_median", "rms_std")])


def reading_triage(spark, sf):
    rows = _summary(spark, sf).withColumns({"longest_pause": F.col("longest_pause") / 400000, "segments": F.col("segments") + F.col("rec") % 20, "speech_fraction": F.col("speech_fraction") * 40})
    return summaries.reading_triage(rows).select("rec", "qc_flags", "qc_status")


def flag_counts(spark, sf):
    return summaries.flag_counts(reading_triage(spark, sf), "qc_flags")


def pending_reviews(spark, sf):
    i = F.col("id")
    word = lambda m, *w: F.element_at(F.array(*map(F.lit, w)), (F.floor(i / m) % len(w) + 1).cast("int"))
    sheet = repeats(spark, sf).select("id", word(1, "KEEP", " keep", "EXCLUDE", "").alias("decision"), word(4, "AUTO", "manual", "NONE").alias("boundary_source"), (i % 2 == 0).alias("review_required"), (i % 11 == 0).alias("automatic"), word(3, "ann", "").alias("reviewer"), word(5, "2020-01-01", "", " ").alias("review_date"), word(7, "", "n").alias("notes"))
    return summaries.pending_reviews(sheet).select("id")


def role_durations(spark, sf):
    rows = intervals(spark, sf).withColumnRenamed("kind", "role")
    return summaries.role_durations(rows, REC)


def majority_frames(spark, sf):
    rows = intervals(spark, sf)
    spans = rows.groupBy("rec").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    out = summaries.majority_frames(rows.where("kind = 'view'").select("rec", "start", "end"), spans, REC, 6 * HOUR)
    return out.groupBy("rec").agg(F.count(F.lit(1)).alias("frames"), F.count_if("speech").alias("speech_frames"), F.min(F.when(F.col("speech"), F.col("frame"))).alias("first_speech"))


def boundary_contrast(spark, sf):
    f = frames(spark, sf)
    out = summaries.boundary_contrast(f.where("kind <> 'click'"), f.where("kind = 'click'").select("rec", "id", "t"), REC, 96 * HOUR, 12 * HOUR, 30.0)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("before", "behind", "contrast")], "ambiguous")


def _features(spark, sf):
    r = repeats(spark, sf)
    second = F.when(F.col("status") == "F", F.col("balance")).when(F.col("status") == "O", 0.0)
    return r.select("id", "subject", "grp", "status", "priority", "feature", second.alias("second"), F.lit("ok_measured").alias("feature_status"), F.when(F.col("status") == "F", "ok_measured").when(F.col("status") == "O", "ok_zero").otherwise("insufficient_support").alias("second_status"))


def status_missingness(spark, sf):
    return summaries.status_missingness(_features(spark, sf), ["feature_status", "second_status"]).withColumn("fraction", F.round("fraction", 9))


def empirical_summary(spark, sf):
    out = summaries.empirical_summary(_features(spark, sf), {"feature": "feature_status", "second": "second_status"})
    return out.select("feature", "available", "status_counts", *[F.round(c, 6).alias(c) for c in ("least", "p01", "p05", "p10", "p25", "p50", "p75", "p90", "p95", "p99", "most")])


def grouped_availability(spark, sf):
    return summaries.grouped_availability(_features(spark, sf), "grp", ["feature", "second"]).withColumns({"fraction": F.round("fraction", 9), "median": F.round("median", 6)})


def challenge_audit(spark, sf):
    li = table(spark, sf, "lineitem")
    grid = li.select(F.col("l_returnflag").alias("geometry"), F.col("l_linenumber").cast("string").alias("dose"), (F.col("l_quantity") > 20).alias("detected"), F.col("l_quantity").cast("long").alias("tp"), (F.col("l_suppkey") % 5).alias("fp"), (F.col("l_partkey") % 7).alias("fn"))
    out = summaries.challenge_audit(grid, ["geometry", "dose"])
    return out.select("geometry", "dose", "rows", *[F.round(c, 9).alias(c) for c in ("sensitivity", "low", "high", "precision", "recall")])


def deletion_summary(spark, sf):
    rows = repeats(spark, sf).select("grp", F.when(F.col("status") != "P", F.col("feature") - F.col("balance")).alias("change"))
    return summaries.deletion_summary(rows, ["grp"], "change").select("grp", "deletions", *[F.round(c, 6).alias(c) for c in ("retained", "median", "p90", "most")])


def bounded_horizons(spark, sf):
    return summaries.within_horizons(frames(spark, sf), "rec", "level", [20.0, 60.0, 200.0], 60).withColumn("mean", F.round("mean", 6))


def level_histogram(spark, sf):
    return summaries.histogram(frames(spark, sf), "level", 100, 480.0)


def rank_quartiles(spark, sf):
    per = repeats(spark, sf).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return per.select("subject", summaries.rank_strata(per, "n", "subject", 4).alias("stratum"))


def group_shares(spark, sf):
    return summaries.shares(repeats(spark, sf), ["grp"], "status").withColumn("share", F.round("share", 9))


def extent_consensus(spark, sf):
    return summaries.extent_consensus(ratings(spark, sf).withColumn("twice", F.col("score") * 2), "item", ["score", "twice"], 5, 4).withColumns({"score": F.round("score", 6), "twice": F.round("twice", 6)})


def winner_counts(spark, sf):
    return summaries.winners(repeats(spark, sf), "grp", (F.col("status") == "F") & (F.col("feature") > 1000)).withColumn("share", F.round("share", 9))


def capped_ledger(spark, sf):
    return summaries.capped(frames(spark, sf), REC, "level", "id", 10).select("rec", "id", "true_count")


def disagreement_priority(spark, sf):
    rows = ratings(spark, sf).groupBy("item").agg(F.min("rating").alias("low"), F.max("rating").alias("high"), F.avg(F.col("rating").cast("double")).alias("agreement"), (F.avg(F.col("rating").cast("double")) / 2).alias("ac1"))
    return summaries.disagreement(rows).select("item", F.round("priority", 9).alias("priority"))


def occurrence_agreement(spark, sf):
    r = ratings(spark, sf)
    pair = r.where("rater = 'click'").select("item", (F.col("rating") == 1).alias("a")).join(r.where("rater = 'view'").select("item", (F.col("score") > 38).alias("b")), "item")
    out = summaries.occurrence_agreement(pair, "a", "b")
    return out.select("both", "first_only", "second_only", "neither", *[F.round(c, 9).alias(c) for c in ("positive_agreement", "negative_agreement", "kappa")])


def criterion_margins(spark, sf):
    out = summaries.margins(repeats(spark, sf), {"large": ("feature", 150000.0, True), "solvent": ("balance", 5000.0, False)}, "grp")
    return out.select("criterion", "grp", "rows", "passed", F.round("least", 6).alias("least"), F.round("median", 6).alias("median"))


def parameter_variants(spark, sf):
    return summaries.one_factor_variants(spark, {"limit": 100.0, "least": 2.0}, {"limit": [80.0, 120.0], "least": [1.0]})


def parameter_robustness(spark, sf):
    out = summaries.variant_robustness(frames(spark, sf), parameter_variants(spark, sf), "rec", F.col("level"), F.col("level") >= F.col("limit") * F.col("least"))
    return out.select("variant", "keys", "accepted", "positives", "changed")


def shifted_intervals(spark, sf):
    return events.shifted(intervals(spark, sf), HOUR).select("rec", "id", "start", "end")


def near_intervals(spark, sf):
    rows = intervals(spark, sf).where("kind = 'signup'")
    return events.near_any(frames(spark, sf).where("kind = 'click'").select("rec", "id", "t"), rows, REC, 12 * HOUR, BIN).select("id", "near")


def merged_of_a_kind(spark, sf):
    return events.merged_of_a_kind(intervals(spark, sf).select("rec", "kind", "start", "end"), REC, ["kind"], 24 * HOUR)


def suppressed_peaks(spark, sf):
    return events.suppressed(frames(spark, sf).select("rec", "id", "t", F.col("level").alias("score")), REC, 72.0 * HOUR, 8).select("id")


def _candidates(spark, sf):
    kind = F.when(F.col("kind") == "click", "dropout").when(F.col("kind") == "view", "frozen").otherwise("splice")
    said = F.when(F.col("id") % 5 == 0, "rejected").when(F.col("id") % 5 == 1, "indeterminate").otherwise("accepted")
    return intervals(spark, sf).select("rec", "id", kind.alias("kind"), "start", "end", said.alias("disposition"), (F.col("id") % 2).alias("channel"), (F.col("end") - F.col("start")).alias("score"))


def arbitrated_candidates(spark, sf):
    out = events.arbitrated(_candidates(spark, sf), REC, [("frozen", "dropout", 0)], BIN)
    return out.select("id", "kind", "disposition", "reason", "arbitrated")


def recording_events(spark, sf):
    rows = _candidates(spark, sf).where("disposition = 'accepted'")
    return events.recording_events(rows, REC, {"dropout": 6 * HOUR, "frozen": 12 * HOUR, "splice": 0}).select("rec", "kind", "start", "end", "support", "span", "candidates", "candidate_ids", "channels", "score", "parts")


def event_rates(spark, sf):
    rows = events.recording_events(_candidates(spark, sf).where("disposition = 'accepted'"), REC, {"dropout": 6 * HOUR, "frozen": 12 * HOUR, "splice": 0})
    exposure = intervals(spark, sf).groupBy("rec").agg(F.when(F.col("rec") % 10 > 0, F.max("end") - F.min("start")).otherwise(0).alias("eligible"))
    return events.event_rates(rows, exposure, REC, ["dropout", "frozen", "glitch"], float(HOUR)).select("rec", "kind", "events", F.round("rate", 9).alias("rate"), F.round("fraction", 9).alias("fraction"))


def local_transitions(spark, sf):
    out = events.local_transitions(frames(spark, sf), REC, ["t", "id"], 4, 60.0, 1.0)
    return out.select("id", *[F.round(c, 4).alias(c) for c in ("pre_level", "post_level", "step", "spread")])


def _annotations(spark, sf):
    rows = intervals(spark, sf).select("rec", "kind", "start", "end")
    return iv.merged(rows.where("kind = 'click'"), REC).select("rec", "start", "end"), iv.merged(rows.where("kind = 'view'"), REC).select("rec", "start", "end")


def one_to_one_matches(spark, sf):
    a, b = _annotations(spark, sf)
    return events.matched_one_to_one(a, b, "rec", "overlap", 0)


def match_summary(spark, sf):
    a, b = _annotations(spark, sf)
    out = events.match_summary(events.matched_one_to_one(a, b, "rec", "strict", 12.0 * HOUR), a, b, "rec")
    return out.select("matches", "a_events", "b_events", *[F.round(c, 9).alias(c) for c in ("f1", "median_onset", "median_offset", "median_iou", "dice")])


def interval_coverage(spark, sf):
    rows = intervals(spark, sf)
    return events.with_overlap(rows.where("kind = 'click'").select("rec", "id", "start", "end"), rows.where("kind = 'view'").select("rec", "start", "end"), REC, BIN).select("id", "covered")


def eligible_support(spark, sf):
    return events.eligible_support(intervals(spark, sf), REC, 10 * HOUR)


def redundancy(spark, sf):
    """Spearman of two features over all rows and over rows where both are positive, by group."""
    rows = _features(spark, sf)
    parts = [ranks.spearman(d, ["grp"], "feature", "second").select("grp", F.lit(n).alias("rows_used"), "n", F.round("rho", 9).alias("rho")) for n, d in (("all", rows), ("positive", rows.where("second > 0")))]
    return parts[0].unionByName(parts[1])


def widest_z(spark, sf):
    rows = repeats(spark, sf)
    z = ranks.robust_spread(rows, ["grp"], "feature").select("grp", F.col("median").alias("m1"), F.col("mad").alias("d1")).join(ranks.robust_spread(rows, ["grp"], "balance").select("grp", F.col("median").alias("m2"), F.col("mad").alias("d2")), "grp")
    rows = rows.join(F.broadcast(z), "grp")
    return rows.select("id", F.round(values.most_extreme([(F.col("feature") - F.col("m1")) / F.col("d1"), (F.col("balance") - F.col("m2")) / F.col("d2")]), 6).alias("widest"))


QUERIES = {f.__name__: f for f in (frame_diagnostics, segmentation_summary, reading_triage, flag_counts, pending_reviews, role_durations, majority_frames, boundary_contrast, status_missingness, empirical_summary, grouped_availability, challenge_audit, deletion_summary, bounded_horizons, level_histogram, rank_quartiles, group_shares, extent_consensus, winner_counts, capped_ledger, disagreement_priority, occurrence_agreement, criterion_margins, parameter_variants, parameter_robustness, shifted_intervals, near_intervals, merged_of_a_kind, suppressed_peaks, arbitrated_candidates, recording_events, event_rates, local_transitions, one_to_one_matches, match_summary, interval_coverage, eligible_support, redundancy, widest_z)}

ISL0 = ISLANDS.format(gap=0)


def _islands(source: str, name: str, keys: str = "rec", gap: str = "0") -> str:
    return f"""{name}1 AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {source} WHERE e > s),
{name}2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}1),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e, count(*) AS n FROM {name}2 GROUP BY {keys}, g)"""


_SUMMARY = f"""{INTERVALS}, ck AS (SELECT * FROM iv WHERE kind = 'click'), {_islands("ck", "k0")}, sp AS (SELECT rec, s / 1e6 AS s, e / 1e6 AS e FROM k0 WHERE e - s >= {2 * HOUR}), dr AS (SELECT rec, (max(e) - min(s)) / 1e6 AS duration FROM iv GROUP BY 1),
    gp AS (SELECT rec, lead(s) OVER (PARTITION BY rec ORDER BY s) - e AS g FROM sp), p1 AS (SELECT rec, sum(e - s) AS speech, count(*) AS segments FROM sp GROUP BY 1), p2 AS (SELECT rec, count(*) AS pauses, max(g) AS longest_pause FROM gp WHERE g > 0 GROUP BY 1),
    lv AS (SELECT user_id AS rec, quantile_cont(value / 7 - 63, 0.5) AS rms_median, stddev_pop(value / 7 - 63) AS rms_std FROM events GROUP BY 1),
    sm AS (SELECT dr.rec, duration, coalesce(speech, 0) AS speech, coalesce(segments, 0) AS segments, coalesce(pauses, 0) AS pauses, coalesce(longest_pause, 0) AS longest_pause, rms_median, rms_std, CASE WHEN duration > 0 THEN coalesce(speech, 0) / duration END AS speech_fraction
      FROM dr LEFT JOIN p1 ON dr.rec = p1.rec LEFT JOIN p2 ON dr.rec = p2.rec LEFT JOIN lv ON dr.rec = lv.rec)"""
_FLAGS = [("no_speech_detected", "sg = 0"), ("very_low_speech_fraction", "sf < 0.05"), ("very_short_file", "duration < 1"), ("near_silent_or_noise_only", "rms_median < -60 AND rms_std < 3"), ("extreme_fragmentation", "sg > 25"), ("extreme_internal_pause", "lp > 5")]
_TRIAGE = f"""{_SUMMARY}, tg AS (SELECT *, longest_pause / 400000 AS lp, segments + rec % 20 AS sg, speech_fraction * 40 AS sf FROM sm),
    tr AS (SELECT rec, concat_ws(';', {", ".join(f"CASE WHEN {w} THEN '{n}' END" for n, w in _FLAGS)}) AS qc_flags, CASE WHEN {" OR ".join(f"coalesce({w}, false)" for _, w in _FLAGS[:4])} THEN 'excluded' WHEN sg > 25 OR lp > 5 THEN 'flagged' ELSE 'accepted' END AS qc_status FROM tg)"""
_FEATURES = f"{REPEATS}, ft AS (SELECT *, CASE status WHEN 'F' THEN balance WHEN 'O' THEN 0.0 END AS second, CASE status WHEN 'F' THEN 'ok_measured' WHEN 'O' THEN 'ok_zero' ELSE 'insufficient_support' END AS second_status FROM rp)"
_LONG = _FEATURES + ", lg AS (SELECT grp, 'feature' AS feature, feature AS v, 'ok_measured' AS s FROM ft UNION ALL SELECT grp, 'second', second, second_status FROM ft)"
_CAND = f"""{INTERVALS}, cd AS (SELECT rec, id, CASE kind WHEN 'click' THEN 'dropout' WHEN 'view' THEN 'frozen' ELSE 'splice' END AS kind, s, e, CASE id % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'indeterminate' ELSE 'accepted' END AS disposition, id % 2 AS channel FROM iv)"""
_EVENTS = f"""{_CAND}, ac AS (SELECT * FROM cd WHERE disposition = 'accepted'), e1 AS (SELECT *, max(e) OVER (PARTITION BY rec, kind ORDER BY s, e, channel, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ac),
    e2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + CASE kind WHEN 'dropout' THEN {6 * HOUR} WHEN 'frozen' THEN {12 * HOUR} ELSE 0 END THEN 1 ELSE 0 END) OVER (PARTITION BY rec, kind ORDER BY s, e, channel, id ROWS UNBOUNDED PRECEDING) AS ev FROM e1),
    {_islands("e2b", "pt", "rec, kind, ev")}, su AS (SELECT rec, kind, ev, sum(e - s)::BIGINT AS support, CAST(to_json(list([s, e] ORDER BY s)) AS VARCHAR) AS parts FROM pt GROUP BY 1, 2, 3),
    re AS (SELECT e2.rec, e2.kind, e2.ev, min(s) AS st, max(e) AS en, max(e - s) AS score, count(*) AS candidates, string_agg(CAST(id AS VARCHAR), '|' ORDER BY s, e, channel, id) AS candidate_ids, string_agg(DISTINCT CAST(channel AS VARCHAR), '|' ORDER BY CAST(channel AS VARCHAR)) AS channels FROM e2 GROUP BY 1, 2, 3)""".replace("FROM e2b", "FROM (SELECT rec, kind, ev, s, e FROM e2)")
_RANK = "(rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0::DOUBLE)"
_RHO = lambda n, w: f"SELECT grp, '{n}' AS rows_used, count(*) AS n, round(CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END, 9) AS rho FROM (SELECT grp, {_RANK.format(k='grp', x='feature')} AS a, {_RANK.format(k='grp', x='second')} AS b FROM ft WHERE second IS NOT NULL AND {w}) GROUP BY grp"
_word = lambda m, *w: f"[{', '.join(repr(x) for x in w)}][CAST(id // {m} % {len(w)} AS INT) + 1]"
_Q = ((0.01, "p01"), (0.05, "p05"), (0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))

ORACLES = {
    "frame_diagnostics": f"""WITH {FRAMES}, {INTERVALS} SELECT fr.id, coalesce(bool_or(iv.kind IN ('click', 'view')), false) AS raw_speech, coalesce(bool_or(iv.kind NOT IN ('click', 'view')), false) AS strict_speech FROM fr LEFT JOIN iv ON fr.rec = iv.rec AND iv.s <= fr.t AND fr.t < iv.e GROUP BY 1""",
    "segmentation_summary": f"WITH {_SUMMARY} SELECT rec, segments, pauses, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("duration", "speech", "longest_pause", "speech_fraction", "rms_median", "rms_std")) + " FROM sm",
    "reading_triage": f"WITH {_TRIAGE} SELECT * FROM tr",
    "flag_counts": f"WITH {_TRIAGE}, x AS (SELECT unnest(string_split(qc_flags, ';')) AS flag FROM tr) SELECT flag, count(*) AS rows FROM x WHERE flag <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "pending_reviews": f"""WITH {REPEATS}, h AS (SELECT id, upper(trim({_word(1, "KEEP", " keep", "EXCLUDE", "")})) AS d, upper({_word(4, "AUTO", "manual", "NONE")}) AS b, id % 2 = 0 AS rr, id % 11 = 0 AS au, {_word(3, "ann", "")} = '' AS nr, trim({_word(5, "2020-01-01", "", " ")}) = '' AS nd, {_word(7, "", "n")} = '' AS nn FROM rp)
        SELECT id FROM h WHERE d NOT IN ('KEEP', 'EXCLUDE') OR (d = 'KEEP' AND b NOT IN ('AUTO', 'MANUAL')) OR (d = 'EXCLUDE' AND b <> 'NONE') OR (au AND NOT (d = 'EXCLUDE' AND b = 'NONE')) OR (NOT au AND (rr OR d = 'EXCLUDE' OR b = 'MANUAL') AND (nr OR nd)) OR ((au OR d = 'EXCLUDE' OR b = 'MANUAL') AND nn)""",
    "role_durations": f"WITH {INTERVALS} SELECT rec, kind AS role, count(*) AS segments, sum(e - s)::BIGINT AS total, max(e - s) AS longest FROM iv GROUP BY 1, 2",
    "majority_frames": f"""WITH {INTERVALS}, w AS (SELECT rec, min(s) AS lo, max(s) AS hi FROM iv GROUP BY 1), v AS (SELECT * FROM iv WHERE kind = 'view'), {_islands("v", "q")}, f AS (SELECT rec, lo, hi, unnest(range(CAST(floor((hi - lo - 1) / {6 * HOUR}.0) AS BIGINT) + 1)) AS frame FROM w),
        c AS (SELECT f.rec, f.frame, coalesce(sum(CASE WHEN q.s IS NOT NULL THEN greatest(0, least(q.e, f.hi, f.lo + (f.frame + 1) * {6 * HOUR}) - greatest(q.s, f.lo + f.frame * {6 * HOUR})) END), 0) AS c FROM f LEFT JOIN q ON f.rec = q.rec AND q.s < f.lo + (f.frame + 1) * {6 * HOUR} AND q.e > f.lo + f.frame * {6 * HOUR} GROUP BY 1, 2)
        SELECT rec, count(*) AS frames, count_if(c * 2 >= {6 * HOUR}) AS speech_frames, min(frame) FILTER (WHERE c * 2 >= {6 * HOUR}) AS first_speech FROM c GROUP BY 1""",
    "boundary_contrast": f"""WITH {FRAMES}, b AS (SELECT a.id, avg(f.level) FILTER (WHERE f.t >= a.t - {108 * HOUR} AND f.t < a.t - {12 * HOUR}) AS x, avg(f.level) FILTER (WHERE f.t >= a.t + {12 * HOUR} AND f.t < a.t + {108 * HOUR}) AS y FROM fr a LEFT JOIN fr f ON a.rec = f.rec AND f.kind <> 'click' WHERE a.kind = 'click' GROUP BY 1)
        SELECT id, round(x, 6) AS before, round(y, 6) AS behind, round(y - x, 6) AS contrast, y - x IS NULL OR abs(y - x) < 30 AS ambiguous FROM b""",
    "status_missingness": f"WITH {_LONG.replace('SELECT grp,', 'SELECT')}, c AS (SELECT feature || '_status' AS feature, s AS status, count(*) AS rows FROM lg GROUP BY 1, 2) SELECT feature, status, rows, round(rows / sum(rows) OVER (PARTITION BY feature), 9) AS fraction, starts_with(status, 'ok_') AS available FROM c",
    "empirical_summary": f"""WITH {_LONG}, c AS (SELECT feature, s, count(*) AS n FROM lg GROUP BY 1, 2), j AS (SELECT feature, '{{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}}' AS status_counts FROM c GROUP BY 1)
        SELECT lg.feature, count(v) AS available, any_value(status_counts) AS status_counts, round(min(v), 6) AS least, {", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for q, n in _Q)}, round(max(v), 6) AS most FROM lg JOIN j ON lg.feature = j.feature GROUP BY 1""",
    "grouped_availability": f"WITH {_LONG} SELECT grp, feature, count(*) AS rows, count(v) AS available, round(count(v) / count(*), 9) AS fraction, round(quantile_cont(v, 0.5), 6) AS median FROM lg GROUP BY 1, 2",
    "challenge_audit": """WITH g AS (SELECT l_returnflag AS geometry, CAST(l_linenumber AS VARCHAR) AS dose, l_quantity > 20 AS d, CAST(l_quantity AS BIGINT) AS tp, l_suppkey % 5 AS fp, l_partkey % 7 AS fn FROM lineitem),
        a AS (SELECT coalesce(geometry, 'ALL') AS geometry, coalesce(dose, 'ALL') AS dose, count(*)::DOUBLE AS n, count_if(d)::DOUBLE AS k, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn FROM g GROUP BY GROUPING SETS ((geometry, dose), ())), z AS (SELECT *, 1.959963984540054::DOUBLE AS z, k / n AS p FROM a)
        SELECT geometry, dose, CAST(n AS BIGINT) AS rows, round(p, 9) AS sensitivity, round(greatest(0, ((p + z*z/(2*n)) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) AS low, round(least(1, ((p + z*z/(2*n)) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) AS high,
        round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS recall FROM z""",
    "deletion_summary": f"WITH {REPEATS}, c AS (SELECT grp, CASE WHEN status <> 'P' THEN feature - balance END AS c FROM rp) SELECT grp, count(*) AS deletions, round(count(c) / count(*), 6) AS retained, round(quantile_cont(abs(c), 0.5), 6) AS median, round(quantile_cont(abs(c), 0.9), 6) AS p90, round(max(abs(c)), 6) AS most FROM c GROUP BY 1",
    "bounded_horizons": f"WITH {FRAMES}, h AS (SELECT unnest([20.0::DOUBLE, 60.0, 200.0]) AS horizon) SELECT rec, horizon, count(*) AS boundaries, round(CASE WHEN count(*) >= 60 THEN avg(least(level, horizon)) END, 6) AS mean FROM fr, h GROUP BY 1, 2",
    "level_histogram": f"WITH {FRAMES} SELECT CAST(least(floor(level / 480 * 100), 99) AS INT) AS bin, count(*) AS rows FROM fr WHERE level BETWEEN 0 AND 480 GROUP BY 1",
    "rank_quartiles": f"WITH {REPEATS}, p AS (SELECT subject, count(*) AS n FROM rp GROUP BY 1), r AS (SELECT subject, row_number() OVER (ORDER BY n, subject) AS k, count(*) OVER () AS m FROM p), b AS (SELECT quantile_cont(k, 0.25) AS a, quantile_cont(k, 0.5) AS b, quantile_cont(k, 0.75) AS c FROM r) SELECT subject, CASE WHEN k <= a THEN 0 WHEN k <= b THEN 1 WHEN k <= c THEN 2 ELSE 3 END AS stratum FROM r, b",
    "group_shares": f"WITH {REPEATS} SELECT grp, status, count(*) AS rows, round(count(*) / sum(count(*)) OVER (PARTITION BY grp), 9) AS share FROM rp GROUP BY 1, 2",
    "extent_consensus": f"WITH {RATINGS} SELECT item, count(DISTINCT rater) AS raters, count(DISTINCT rater) >= 5 AS complete, round(CASE WHEN count(score) >= 4 THEN quantile_cont(score, 0.5) END, 6) AS score, round(CASE WHEN count(score) >= 4 THEN quantile_cont(score * 2, 0.5) END, 6) AS twice FROM rt GROUP BY 1",
    "winner_counts": f"WITH {REPEATS}, w AS (SELECT grp, count(*) AS rows, count_if(status = 'F' AND feature > 1000) AS eligible FROM rp GROUP BY 1) SELECT grp, rows, eligible, round(eligible / sum(eligible) OVER (), 9) AS share FROM w",
    "capped_ledger": f"WITH {FRAMES} SELECT rec, id, true_count FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY level DESC, id) AS k, count(*) OVER (PARTITION BY rec) AS true_count FROM fr) WHERE k <= 10",
    "disagreement_priority": f"WITH {RATINGS} SELECT item, round(max(rating) - min(rating) + (1 - avg(rating)) + (1 - avg(rating) / 2) / 2, 9) AS priority FROM rt GROUP BY 1",
    "occurrence_agreement": f"""WITH {RATINGS}, p AS (SELECT x.rating = 1 AS a, y.score > 38 AS b FROM rt x JOIN rt y ON x.item = y.item AND x.rater = 'click' AND y.rater = 'view'), c AS (SELECT count_if(a AND b)::DOUBLE AS tt, count_if(a AND NOT b)::DOUBLE AS tf, count_if(NOT a AND b)::DOUBLE AS ft, count_if(NOT a AND NOT b)::DOUBLE AS ff FROM p),
        k AS (SELECT *, tt + tf + ft + ff AS n, (tt + tf) / (tt + tf + ft + ff) AS p1, (tt + ft) / (tt + tf + ft + ff) AS p2 FROM c), q AS (SELECT *, p1 * p2 + (1 - p1) * (1 - p2) AS ch FROM k)
        SELECT tt AS both, tf AS first_only, ft AS second_only, ff AS neither, round(CASE WHEN 2 * tt + tf + ft > 0 THEN 2 * tt / (2 * tt + tf + ft) END, 9) AS positive_agreement, round(CASE WHEN 2 * ff + tf + ft > 0 THEN 2 * ff / (2 * ff + tf + ft) END, 9) AS negative_agreement, round(CASE WHEN ch < 1 THEN ((tt + ff) / n - ch) / (1 - ch) END, 9) AS kappa FROM q""",
    "criterion_margins": f"""WITH {REPEATS}, m AS (SELECT 'large' AS criterion, grp, feature - 150000 AS m FROM rp UNION ALL SELECT 'solvent', grp, 5000 - balance FROM rp) SELECT criterion, grp, count(*) AS rows, count_if(m >= 0) AS passed, round(min(m), 6) AS least, round(quantile_cont(m, 0.5), 6) AS median FROM m GROUP BY 1, 2""",
    "parameter_variants": """SELECT * FROM (VALUES ('base', 'none', 100.0::DOUBLE, 2.0::DOUBLE), ('limit=80', 'limit', 80.0, 2.0), ('limit=120', 'limit', 120.0, 2.0), ('least=1', 'least', 100.0, 1.0)) AS t(variant, changed, "limit", "least")""",
    "parameter_robustness": f"""WITH {FRAMES}, v(variant, x) AS (VALUES ('base', 200), ('limit=80', 160), ('limit=120', 240), ('least=1', 100)), p AS (SELECT variant, rec, bool_or(level >= x) AS pos, count_if(level >= x) AS k FROM fr, v GROUP BY 1, 2)
        SELECT p.variant, count(*) AS keys, sum(p.k)::BIGINT AS accepted, count_if(p.pos) AS positives, count_if(p.pos <> b.pos) AS changed FROM p JOIN p b ON p.rec = b.rec AND b.variant = 'base' GROUP BY 1""",
    "shifted_intervals": f'WITH {INTERVALS} SELECT rec, id, s + {HOUR} AS "start", e + {HOUR} AS "end" FROM iv',
    "near_intervals": f"WITH {FRAMES}, {INTERVALS} SELECT fr.id, count(iv.id) > 0 AS near FROM fr LEFT JOIN iv ON fr.rec = iv.rec AND iv.kind = 'signup' AND fr.t BETWEEN iv.s - {12 * HOUR} AND iv.e + {12 * HOUR} WHERE fr.kind = 'click' GROUP BY 1",
    "merged_of_a_kind": f"""WITH {INTERVALS}, a AS (SELECT rec, kind, s, e, CASE WHEN kind = lag(kind) OVER (PARTITION BY rec ORDER BY s, e, kind) THEN 0 ELSE 1 END AS nw FROM iv), b AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY s, e, kind ROWS UNBOUNDED PRECEDING) AS st FROM a),
        c AS (SELECT *, max(e) OVER (PARTITION BY rec, st ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b), d AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > {24 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY rec, st ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM c)
        SELECT rec, kind, min(s) AS "start", max(e) AS "end", count(*) AS merged FROM d GROUP BY rec, kind, st, g""",
    "suppressed_peaks": f"""WITH RECURSIVE {FRAMES}, r AS (SELECT rec, id, t, row_number() OVER (PARTITION BY rec ORDER BY level DESC, id) AS k FROM fr),
        p AS (SELECT rec, 1 AS k, [t] AS kept, [id] AS ids FROM r WHERE k = 1
              UNION ALL SELECT p.rec, p.k + 1, CASE WHEN ok THEN list_append(kept, t) ELSE kept END, CASE WHEN ok THEN list_append(ids, id) ELSE ids END
              FROM (SELECT p.*, r.t, r.id, len(kept) < 8 AND len(list_filter(kept, lambda x: abs(x - r.t) < {72 * HOUR})) = 0 AS ok FROM p JOIN r ON p.rec = r.rec AND r.k = p.k + 1) AS p)
        SELECT unnest(arg_max(ids, k)) AS id FROM p GROUP BY rec""",
    "arbitrated_candidates": f"""WITH {_CAND}, h AS (SELECT DISTINCT f.id FROM cd f JOIN cd d ON f.rec = d.rec AND f.kind = 'frozen' AND d.kind = 'dropout' AND d.disposition = 'accepted' AND f.disposition <> 'rejected' AND f.s < d.e AND d.s < f.e)
        SELECT cd.id, kind, CASE WHEN h.id IS NULL THEN disposition ELSE 'rejected' END AS disposition, CASE WHEN h.id IS NULL THEN '' ELSE 'near_accepted_dropout' END AS reason, h.id IS NOT NULL AS arbitrated FROM cd LEFT JOIN h ON cd.id = h.id""",
    "recording_events": f"""WITH {_EVENTS} SELECT re.rec, re.kind, st AS "start", en AS "end", support, en - st AS span, candidates, candidate_ids, channels, score, parts FROM re JOIN su ON re.rec = su.rec AND re.kind = su.kind AND re.ev = su.ev""",
    "event_rates": f"""WITH {_EVENTS}, x AS (SELECT rec, CASE WHEN rec % 10 > 0 THEN max(e) - min(s) ELSE 0 END AS el FROM iv GROUP BY rec), k AS (SELECT unnest(['dropout', 'frozen', 'glitch']) AS kind), c AS (SELECT re.rec, re.kind, count(*) AS n, sum(support) AS su FROM re JOIN su ON re.rec = su.rec AND re.kind = su.kind AND re.ev = su.ev GROUP BY 1, 2)
        SELECT x.rec, k.kind, coalesce(n, 0) AS events, round(CASE WHEN el > 0 THEN coalesce(n, 0) * {HOUR}::DOUBLE / el END, 9) AS rate, round(CASE WHEN el > 0 THEN coalesce(su, 0)::DOUBLE / el END, 9) AS fraction FROM x CROSS JOIN k LEFT JOIN c ON x.rec = c.rec AND k.kind = c.kind""",
    "local_transitions": f"""WITH {FRAMES}, w AS (SELECT id, list(level) OVER (PARTITION BY rec ORDER BY t, id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a, list(level) OVER (PARTITION BY rec ORDER BY t, id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS b FROM fr), m AS (SELECT *, list_median(a) AS x, list_median(b) AS y FROM w WHERE len(a) = 4 AND len(b) = 4),
        d AS (SELECT *, greatest(0.25, 1.4826 * list_median(list_concat(list_transform(a, lambda v: abs(v - x)), list_transform(b, lambda v: abs(v - y))))) AS sp FROM m) SELECT id, round(x, 4) AS pre_level, round(y, 4) AS post_level, round(y - x, 4) AS step, round(sp, 4) AS spread FROM d WHERE abs(y - x) >= greatest(60, sp)""",
    "interval_coverage": f"""WITH {INTERVALS}, v AS (SELECT * FROM iv WHERE kind = 'view'), {_islands("v", "q")} SELECT iv.id, coalesce(sum(CASE WHEN q.s IS NOT NULL THEN least(iv.e, q.e) - greatest(iv.s, q.s) END), 0)::BIGINT AS covered FROM iv LEFT JOIN q ON iv.rec = q.rec AND q.s < iv.e AND iv.s < q.e WHERE kind = 'click' GROUP BY 1""",
    "eligible_support": f"WITH {INTERVALS} SELECT rec, count_if(e - s >= {10 * HOUR}) AS intervals, coalesce(sum(e - s) FILTER (WHERE e - s >= {10 * HOUR}), 0)::BIGINT AS exposure FROM iv GROUP BY 1",
    "redundancy": f"WITH {_FEATURES} " + _RHO("all", "true") + " UNION ALL " + _RHO("positive", "second > 0"),
    "widest_z": f"""WITH {REPEATS}, m AS (SELECT grp, quantile_cont(feature, 0.5) AS m1, quantile_cont(balance, 0.5) AS m2 FROM rp GROUP BY 1), d AS (SELECT rp.grp, any_value(m1) AS m1, any_value(m2) AS m2, 1.4826 * quantile_cont(abs(feature - m1), 0.5) AS d1, 1.4826 * quantile_cont(abs(balance - m2), 0.5) AS d2 FROM rp JOIN m ON rp.grp = m.grp GROUP BY 1)
        SELECT id, round(greatest(abs((feature - m1) / d1), abs((balance - m2) / d2)), 6) AS widest FROM rp JOIN d ON rp.grp = d.grp""",
}
