"""Measurement queries: waveforms are the embeddings, 64 samples at 64 Hz, cut in three intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measure as m
from .base import table

P = m.Frames(frame_ms=125.0, hop_ms=62.5)
SPANS = ((0, 0.0, 0.25), (1, 0.25, 0.75), (2, 0.75, 1.0))


def recordings(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("rec"), F.lit(64.0).alias("fs"), F.col("embedding").alias("samples"))


def spans(rows):
    return rows.select("rec", F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(a).alias("start"), F.lit(b).alias("end")) for i, a, b in SPANS])).alias("s")).select("rec", "s.*")


def _ledger(spark, sf):
    rows = recordings(spark, sf)
    return m.frame_ledger(rows, spans(rows), P)


def frame_levels(spark, sf):
    return _ledger(spark, sf).select("rec", "idx", "frame", "start", F.round("level", 6).alias("level"), "at_floor")


def segment_levels(spark, sf):
    return m.segment_ledger(_ledger(spark, sf), m.GainSupport(segment_frames=3)).select("rec", "idx", "frames", "valid", "usable", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"))


def gain_features(spark, sf):
    p = m.GainSupport(segment_frames=3, frames=10, drift_span_sec=0.5)
    out = m.gain_features(_ledger(spark, sf), p)
    return out.select("rec", "frames", "segments", *[F.round(c, 6).alias(c) for c in ("level", "within", "between", "drift")], "level_status", "between_status", "drift_status")


def spectral_windows(spark, sf):
    rows = recordings(spark, sf)
    return m.spectral_windows(rows, spans(rows), 250.0, 125.0, 4.0, 28.0).withColumn("flatness", F.round("flatness", 6))


def window_shapes(spark, sf):
    rows = recordings(spark, sf)
    out = m.window_shapes(rows, spans(rows), 500.0, 250.0, 125.0)
    return out.select("rec", "idx", "window", "start", *[F.round(c, 6).alias(c) for c in ("entropy", "similarity", "lag")])


def additive_features(spark, sf):
    rows = recordings(spark, sf)
    s = spans(rows)
    pauses, speech = s.where("idx = 1"), s.where("idx <> 1")
    out = m.additive_features(m.frame_ledger(rows, pauses, P), m.frame_ledger(rows, speech, P), m.spectral_windows(rows, pauses, 250.0, 125.0, 4.0, 28.0), least_frames=5, least_windows=2)
    return out.select("rec", "pause_frames", "speech_frames", "windows", *[F.round(c, 6).alias(c) for c in ("level", "iqr", "contrast", "flatness", "contrast_raw", "floor_fraction")], "level_status", "contrast_status", "flatness_status", "hum_status")


def channel_spectra(spark, sf):
    rows = recordings(spark, sf)
    out = m.channel_spectra(rows, spans(rows), P, m.Band(2.0, 30.0, 12.0, 28.0, 64))
    return out.select("rec", "frames", *[F.round(c, 6).alias(c) for c in ("rolloff", "highband", "tilt")])


def plateau_detector(spark, sf):
    return m.plateaus(recordings(spark, sf), tolerance=0.2, near=0.6, least=2)


def distortion_features(spark, sf):
    rows = recordings(spark, sf)
    return m.distortion_features(rows, m.plateaus(rows, tolerance=0.2, near=0.6, least=2), 8).select("rec", "events", "sample_fraction", "frame_fraction", "events_per_min")


def dropout_detector(spark, sf):
    return m.dropouts(recordings(spark, sf), 3, 4, 0.05, 0.02).select("rec", "first", "last", "length", F.round("before_rms", 6).alias("before_rms"), F.round("after_rms", 6).alias("after_rms"), "disposition")


def channel_tolerances(spark, sf):
    out = m.channel_tolerances(recordings(spark, sf), F.when(F.col("rec") % 2 == 0, 2.0 ** -7), 1e-6, 1e-2)
    return out.select("rec", *[F.round(c, 9).alias(c) for c in ("robust_peak", "flat_tolerance", "cluster_tolerance")])


def edge_evidence(spark, sf):
    rows = recordings(spark, sf)
    out = m.edge_evidence(rows, m.plateaus(rows, tolerance=0.2, near=0.6, least=2), 8, 4, 0.03)
    return out.select("rec", "sign", F.round("edge", 6).alias("edge"), "edge_samples", "interior_samples", "beyond_samples", F.round("ratio", 6).alias("ratio"), "excess", "allowed")


def square_like(spark, sf):
    rows = recordings(spark, sf).withColumn("samples", F.transform("samples", lambda x: F.when((F.col("rec") % 3 == 0) & (x > 0), 0.1).when(F.col("rec") % 3 == 0, -0.1).otherwise(x)))
    out = m.square_like(rows, m.edge_evidence(rows, m.plateaus(rows, tolerance=0.2, near=0.6, least=2), 8, 4, 0.03), 0.03, 0.9, 4)
    return out.select("rec", F.round("covered", 6).alias("covered"), "square_like")


def duplicate_windows(spark, sf):
    quantised = recordings(spark, sf).withColumn("samples", F.transform("samples", lambda x: F.signum(x).cast("int")))
    return m.repeated_windows(quantised, 6, 1)


def lpc_continuity(spark, sf):
    return m.continuity_scores(recordings(spark, sf), 64, 4, 3.0)


QUERIES = {f.__name__: f for f in (frame_levels, segment_levels, gain_features, spectral_windows, window_shapes, additive_features, channel_spectra, plateau_detector, distortion_features, dropout_detector, channel_tolerances, edge_evidence, square_like, duplicate_windows, lpc_continuity)}

_LEDGER = """sg(idx, lo, hi) AS (VALUES (0, 0, 16), (1, 16, 48), (2, 48, 64)),
    st AS (SELECT idx, unnest(range(lo, hi - 8 + 1, 4)) AS l, lo FROM sg),
    fs AS (SELECT vec_id AS rec, idx, (l - lo) // 4 AS frame, l / 64.0::DOUBLE AS start, list_transform(list_slice(embedding, l + 1, l + 8), lambda v: CAST(v AS DOUBLE)) AS w FROM embeddings, st),
    lr AS (SELECT rec, idx, frame, start, sqrt(list_avg(list_transform(w, lambda v: (v - list_avg(w)) * (v - list_avg(w))))) AS rms FROM fs),
    ld AS (SELECT rec, idx, frame, start, CASE WHEN rms <= 1e-6 THEN -120.0 ELSE 20 * log10(rms) END AS level, rms <= 1e-6 AS at_floor FROM lr)"""
_SEG = """sq AS (SELECT rec, idx, count(*) AS frames, count(*) FILTER (WHERE NOT at_floor) AS valid, avg(start) + 0.0625::DOUBLE AS mid, quantile_cont(CASE WHEN NOT at_floor THEN level END, 0.5) AS md, quantile_cont(CASE WHEN NOT at_floor THEN level END, 0.75) - quantile_cont(CASE WHEN NOT at_floor THEN level END, 0.25) AS iqr FROM ld GROUP BY 1, 2)"""
_SAMPLES = "sm AS (SELECT vec_id AS rec, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS i))"
_PLATEAU = _SAMPLES + """, pk AS (SELECT *, max(abs(x)) OVER (PARTITION BY rec) AS pk FROM sm), hg AS (SELECT *, abs(x) >= 0.6 * pk AND pk > 0 AS hi FROM pk),
    nw AS (SELECT *, CASE WHEN coalesce(hi AND lag(hi) OVER w AND abs(x - lag(x) OVER w) <= 0.2 * pk, false) THEN 0 ELSE 1 END AS nw FROM hg WINDOW w AS (PARTITION BY rec ORDER BY i)),
    rn AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM nw),
    pt AS (SELECT rec, min(i) AS first, max(i) AS last, count(*) AS length, quantile_cont(x, 0.5) AS level FROM rn WHERE hi GROUP BY rec, r HAVING count(*) >= 2)"""

_SPECTRUM = """sw(idx, lo, hi) AS (VALUES (0, 0, 16), (1, 16, 48), (2, 48, 64)), wn AS (SELECT idx, unnest(range(lo, hi - 16 + 1, 8)) AS l, lo FROM sw),
    xs AS (SELECT vec_id AS rec, idx, (l - lo) // 8 AS win, l / 64.0::DOUBLE AS start, j, CAST(embedding[l + j + 1] AS DOUBLE) AS x FROM embeddings, wn, (SELECT unnest(range(16)) AS j)),
    xc AS (SELECT *, (x - avg(x) OVER (PARTITION BY rec, idx, win)) * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS y FROM xs),
    dp AS (SELECT rec, idx, win, start, k, pow(sum(y * cos(2 * pi() * j * k / 16)), 2) + pow(sum(y * sin(2 * pi() * j * k / 16)), 2) AS p FROM xc, (SELECT unnest(range(1, 8)) AS k) GROUP BY 1, 2, 3, 4, 5),
    de AS (SELECT *, max(p) OVER (PARTITION BY rec, idx, win) * 1e-15 AS e FROM dp), fl AS (SELECT rec, idx, win, start, exp(avg(ln(p + e))) / avg(p + e) AS flatness FROM de GROUP BY 1, 2, 3, 4)"""
_EDGES = _PLATEAU + """, es AS (SELECT rec, CAST(sign(level) AS BIGINT) AS sg, first, last, length, level FROM pt), eg AS (SELECT *, CASE WHEN first - (lag(last) OVER w + 1) <= 4 THEN 0 ELSE 1 END AS nw FROM es WINDOW w AS (PARTITION BY rec, sg ORDER BY first)),
    eh AS (SELECT *, sum(nw) OVER (PARTITION BY rec, sg ORDER BY first ROWS UNBOUNDED PRECEDING) AS g FROM eg), ew AS (SELECT rec, sg, CASE WHEN count(*) = 1 THEN min(first) - 8 ELSE min(first) END AS lo, CASE WHEN count(*) = 1 THEN max(last) + 8 ELSE max(last) END AS hi FROM eh GROUP BY rec, sg, g),
    ed AS (SELECT rec, sg, sg * sum(level * length) / sum(length) AS edge FROM es GROUP BY 1, 2), ev AS (SELECT DISTINCT ew.rec, ew.sg, sm.i, ew.sg * sm.x AS v FROM ew JOIN sm ON ew.rec = sm.rec AND sm.i BETWEEN ew.lo AND ew.hi),
    ec AS (SELECT ev.rec, ev.sg AS sign, any_value(edge) AS edge, count_if(abs(v - edge) <= 0.03) AS a, count_if(v >= edge - 0.12::DOUBLE AND v < edge - 0.06::DOUBLE) AS b, count_if(v > edge + 0.03::DOUBLE) AS c, count(*) AS n FROM ev JOIN ed ON ev.rec = ed.rec AND ev.sg = ed.sg GROUP BY 1, 2)"""

ORACLES = {
    "spectral_windows": f"WITH {_SPECTRUM} SELECT rec, idx, win AS \"window\", start, round(flatness, 6) AS flatness, CAST(NULL AS DOUBLE) AS hum50, CAST(NULL AS DOUBLE) AS hum60, 0 AS supported50, 0 AS supported60 FROM fl",
    "window_shapes": """WITH w0 AS (SELECT vec_id AS rec, j, CAST(embedding[16 + j + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(32)) AS j)), c AS (SELECT rec, j, x - avg(x) OVER (PARTITION BY rec) AS x FROM w0),
        p AS (SELECT rec, k, pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 31)) * cos(2 * pi() * j * k / 32)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 31)) * sin(2 * pi() * j * k / 32)), 2) AS p FROM c, (SELECT unnest(range(17)) AS k) GROUP BY 1, 2), s AS (SELECT rec, p / sum(p) OVER (PARTITION BY rec) AS s FROM p), e AS (SELECT rec, -sum(s * ln(s + 1e-20)) / ln(17) AS entropy FROM s GROUP BY 1),
        l AS (SELECT a.rec, g, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS cs FROM c a JOIN (SELECT unnest(range(1, 9)) AS g) ON true JOIN c b ON a.rec = b.rec AND b.j = a.j + g GROUP BY 1, 2)
        SELECT e.rec, 1 AS idx, 0 AS "window", 0.25::DOUBLE AS start, round(any_value(entropy), 6) AS entropy, round(max(cs), 6) AS similarity, round(arg_max(g, cs) / 64.0::DOUBLE, 6) AS lag FROM e JOIN l ON e.rec = l.rec GROUP BY e.rec""",
    "additive_features": f"""WITH {_LEDGER}, {_SPECTRUM}, p AS (SELECT rec, count(*) FILTER (WHERE NOT at_floor) AS n, avg(at_floor::INT) AS ff, quantile_cont(level, 0.5) FILTER (WHERE NOT at_floor) AS md, quantile_cont(level, 0.75) FILTER (WHERE NOT at_floor) - quantile_cont(level, 0.25) FILTER (WHERE NOT at_floor) AS iq FROM ld WHERE idx = 1 GROUP BY 1),
        s AS (SELECT rec, count(*) FILTER (WHERE NOT at_floor) AS n, quantile_cont(level, 0.5) FILTER (WHERE NOT at_floor) AS md FROM ld WHERE idx <> 1 GROUP BY 1), w AS (SELECT rec, count(flatness) AS n, quantile_cont(flatness, 0.5) AS fm FROM fl WHERE idx = 1 GROUP BY 1),
        j AS (SELECT p.rec, p.n AS pn, s.n AS sn, w.n AS wn, p.md, p.iq, s.md - p.md AS ct, fm, ff, CASE WHEN p.n < 5 THEN 'insufficient_support' WHEN ff > 0.02 THEN 'floor_censored' ELSE 'ok' END AS st, CASE WHEN w.n < 2 THEN 'insufficient_windows' ELSE 'ok' END AS sw FROM p JOIN s ON p.rec = s.rec JOIN w ON p.rec = w.rec)
        SELECT rec, pn AS pause_frames, sn AS speech_frames, wn AS windows, round(CASE WHEN st = 'ok' THEN md END, 6) AS level, round(CASE WHEN st = 'ok' THEN iq END, 6) AS iqr, round(CASE WHEN st = 'ok' THEN ct END, 6) AS contrast, round(CASE WHEN sw = 'ok' THEN fm END, 6) AS flatness, round(ct, 6) AS contrast_raw, round(ff, 6) AS floor_fraction,
        st AS level_status, st AS contrast_status, sw AS flatness_status, sw AS hum_status FROM j""",
    "channel_spectra": f"""WITH {_LEDGER}, x AS (SELECT rec, idx, frame, j, w[j + 1] - list_avg(w) AS x FROM fs, (SELECT unnest(range(8)) AS j)), d AS (SELECT rec, idx, frame, k, pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 8)) * cos(2 * pi() * j * k / 64)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 8)) * sin(2 * pi() * j * k / 64)), 2) AS p FROM x, (SELECT unnest(range(2, 31)) AS k) GROUP BY 1, 2, 3, 4),
        t AS (SELECT rec, k, sum(p) AS p, count(*) AS n FROM d GROUP BY 1, 2), u AS (SELECT *, coalesce((p + lag(p) OVER (PARTITION BY rec ORDER BY k)) / 2, 0) AS a FROM t), c AS (SELECT *, sum(a) OVER (PARTITION BY rec ORDER BY k) AS c, sum(a) OVER (PARTITION BY rec) AS tot, max(p) OVER (PARTITION BY rec) AS mx FROM u),
        r AS (SELECT rec, min(k) - 1 + (0.95::DOUBLE * any_value(tot) - (min(c) - arg_min(a, k))) / arg_min(a, k) AS ro FROM c WHERE c >= 0.95::DOUBLE * tot GROUP BY rec), h AS (SELECT rec, any_value(n) AS n, sum(a) FILTER (WHERE k > 12) / any_value(tot) AS hb FROM c GROUP BY rec),
        o AS (SELECT i, 2 * pow(2, i / 3.0::DOUBLE) AS ce FROM (SELECT unnest(range(12)) AS i)), b AS (SELECT c.rec, i, ce, min(k) AS k0, max(k) AS k1, sum(p) AS sp, arg_min(p, k) AS p0, arg_max(p, k) AS p1, any_value(mx) AS mx FROM c JOIN o ON k >= greatest(2, ce * pow(2, -1 / 6.0::DOUBLE)) AND k <= least(30, ce * pow(2, 1 / 6.0::DOUBLE)) WHERE ce <= 28 GROUP BY 1, 2, 3 HAVING count(*) > 1),
        l AS (SELECT rec, log2(ce) AS x, 10 * log10(greatest((sp - (p0 + p1) / 2) / (k1 - k0), mx * 1e-8)) AS y FROM b), ti AS (SELECT g.rec, quantile_cont((g.y - f.y) / (g.x - f.x), 0.5) AS ti FROM l f JOIN l g ON f.rec = g.rec AND f.x < g.x GROUP BY 1 HAVING count(*) >= 15)
        SELECT h.rec, h.n AS frames, round(ro, 6) AS rolloff, round(hb, 6) AS highband, round(ti, 6) AS tilt FROM h JOIN r ON h.rec = r.rec LEFT JOIN ti ON h.rec = ti.rec""",
    "channel_tolerances": f"""WITH {_SAMPLES}, q AS (SELECT rec, quantile_cont(abs(x), 0.999) AS pk FROM sm GROUP BY 1), f AS (SELECT *, CASE WHEN rec % 2 = 0 THEN 0.00390625::DOUBLE ELSE greatest(1e-6, pk * 1e-2) END AS fl FROM q)
        SELECT rec, round(pk, 9) AS robust_peak, round(fl, 9) AS flat_tolerance, round(greatest(fl, CASE WHEN rec % 2 = 0 THEN 0.015625::DOUBLE ELSE pk * 2e-3 END), 9) AS cluster_tolerance FROM f""",
    "edge_evidence": f"WITH {_EDGES} SELECT rec, sign, round(sign * edge, 6) AS edge, a AS edge_samples, b AS interior_samples, c AS beyond_samples, round(a / greatest(1, b)::DOUBLE, 6) AS ratio, a - b AS excess, greatest(1, CAST(ceil(0.001 * n) AS BIGINT)) AS allowed FROM ec",
    "frame_levels": f"WITH {_LEDGER} SELECT rec, idx, frame, start, round(level, 6) AS level, at_floor FROM ld",
    "segment_levels": f"WITH {_LEDGER}, {_SEG} SELECT rec, idx, frames, valid, valid >= 3 AS usable, round(CASE WHEN valid >= 3 THEN md END, 6) AS median, round(CASE WHEN valid >= 3 THEN iqr END, 6) AS iqr FROM sq",
    "gain_features": f"""WITH {_LEDGER}, {_SEG}, gd AS (SELECT rec, idx, mid, md FROM sq WHERE valid >= 3), su AS (SELECT rec, count(*) AS frames, count(*) FILTER (WHERE NOT at_floor) AS valid, avg(at_floor::INT) AS ff FROM ld GROUP BY 1),
        ty AS (SELECT rec, count(*) AS segments, quantile_cont(md, 0.5) AS lv, max(mid) - min(mid) AS span FROM gd GROUP BY 1), ce AS (SELECT ld.rec, quantile_cont(level - md, 0.75) - quantile_cont(level - md, 0.25) AS wi FROM ld JOIN gd ON ld.rec = gd.rec AND ld.idx = gd.idx WHERE NOT at_floor GROUP BY 1),
        be AS (SELECT gd.rec, 1.482602218505602::DOUBLE * quantile_cont(abs(md - lv), 0.5) AS be FROM gd JOIN ty ON gd.rec = ty.rec GROUP BY 1), dr AS (SELECT a.rec, abs(quantile_cont((b.md - a.md) / ((b.mid - a.mid) / 60), 0.5)) AS dr FROM gd a JOIN gd b ON a.rec = b.rec AND a.mid < b.mid GROUP BY 1),
        al AS (SELECT su.*, segments, lv, span, wi, be, dr, CASE WHEN ff > 0.02 THEN 'floor_censored' WHEN valid < 10 THEN 'insufficient_frames' WHEN coalesce(segments, 0) < 1 THEN 'insufficient_segments' ELSE 'ok' END AS s0 FROM su LEFT JOIN ty USING (rec) LEFT JOIN ce USING (rec) LEFT JOIN be USING (rec) LEFT JOIN dr USING (rec)),
        sx AS (SELECT *, CASE WHEN s0 IN ('floor_censored', 'insufficient_frames') THEN s0 WHEN coalesce(segments, 0) < 3 THEN 'insufficient_segments' ELSE 'ok' END AS s1 FROM al)
        SELECT rec, frames, segments, round(CASE WHEN s0 = 'ok' THEN lv END, 6) AS level, round(CASE WHEN s0 = 'ok' THEN wi END, 6) AS within, round(CASE WHEN s1 = 'ok' THEN be END, 6) AS "between", round(CASE WHEN s1 = 'ok' AND span >= 0.5 THEN dr END, 6) AS drift,
        s0 AS level_status, s1 AS between_status, CASE WHEN s1 <> 'ok' THEN s1 WHEN span < 0.5 THEN 'insufficient_span' ELSE 'ok' END AS drift_status FROM sx""",
    "plateau_detector": f"WITH {_PLATEAU} SELECT * FROM pt",
    "distortion_features": f"""WITH {_PLATEAU}, tf AS (SELECT DISTINCT rec, unnest(range(first // 8, last // 8 + 1)) AS f FROM pt), tc AS (SELECT rec, count(*) AS t FROM tf WHERE f < 8 GROUP BY rec), ev AS (SELECT rec, count(*) AS events, sum(length) AS n FROM pt GROUP BY rec)
        SELECT e.vec_id AS rec, coalesce(events, 0) AS events, coalesce(n, 0) / 64.0::DOUBLE AS sample_fraction, coalesce(t, 0) / 8.0::DOUBLE AS frame_fraction, coalesce(events, 0) * 60.0::DOUBLE AS events_per_min FROM embeddings e LEFT JOIN ev ON e.vec_id = ev.rec LEFT JOIN tc ON e.vec_id = tc.rec""",
    "dropout_detector": f"""WITH {_SAMPLES}, st AS (SELECT *, CASE WHEN coalesce(abs(x - lag(x) OVER (PARTITION BY rec ORDER BY i)) <= 0.02, false) THEN 0 ELSE 1 END AS nw FROM sm), rn AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM st),
        fd AS (SELECT rec, min(i) AS first, max(i) AS last, count(*) AS length FROM rn GROUP BY rec, r HAVING count(*) >= 3),
        cx AS (SELECT fd.rec, fd.first, fd.last, fd.length, sqrt(avg(x * x) FILTER (WHERE sm.i BETWEEN first - 4 AND first - 1)) AS b, count(*) FILTER (WHERE sm.i BETWEEN first - 4 AND first - 1) AS nb, sqrt(avg(x * x) FILTER (WHERE sm.i BETWEEN last + 1 AND last + 4)) AS a, count(*) FILTER (WHERE sm.i BETWEEN last + 1 AND last + 4) AS na FROM fd JOIN sm ON fd.rec = sm.rec GROUP BY 1, 2, 3, 4)
        SELECT rec, first, last, length, round(b, 6) AS before_rms, round(a, 6) AS after_rms, CASE WHEN nb < 4 OR na < 4 THEN 'edge' WHEN b >= 0.05 AND a >= 0.05 THEN 'accepted' ELSE 'unbracketed' END AS disposition FROM cx""",
    "duplicate_windows": """WITH w AS (SELECT vec_id AS rec, s AS start, list_transform(list_slice(embedding, s + 1, s + 6), lambda v: CAST(sign(v) AS INT)) AS w FROM embeddings, (SELECT unnest(range(59)) AS s)),
        g AS (SELECT rec, start, lag(start) OVER (PARTITION BY rec, w ORDER BY start) AS earlier FROM w WHERE list_max(w) > list_min(w)) SELECT * FROM g WHERE earlier IS NOT NULL""",
}
