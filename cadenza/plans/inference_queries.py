"""Inference and cohort queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort, inference
from .base import FRAMES, INTERVALS, LABELLED, REPEATS, frames, intervals, labelled, repeats, table

DAY = 86_400_000_000
FEATURES = ["feature", "balance", "gap"]


def _wide(spark, sf):
    return repeats(spark, sf).withColumn("gap", F.when(F.col("status") != "P", F.col("feature") - 10 * F.col("balance")))


def describe_features(spark, sf):
    out = inference.describe_features(_wide(spark, sf), "subject", FEATURES)
    return out.select("feature", "recordings", "participants", "n", "missing", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "zero_fraction")])


def feature_pairs(spark, sf):
    return inference.feature_pairs(_wide(spark, sf), "id", FEATURES).select("feature_a", "feature_b", "n", F.round("rho", 6).alias("rho"))


def correlation_matrix(spark, sf):
    return inference.correlation_matrix(feature_pairs(spark, sf), FEATURES)


def perceptual_links(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"), F.octet_length("text").alias("octets"))
    lab = table(spark, sf, "labels")
    long = lab.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("category"), F.col("quality").alias("label")), F.struct(F.lit("toxic").alias("category"), F.col("toxic").alias("label")))).alias("x")).select("doc_id", "x.*")
    return inference.perceptual_links(d, long, "doc_id", ["chars", "octets"]).select("feature", "category", "n_pos", "n_neg", F.round("auc", 6).alias("auc"), "status")


def matched_specificity(spark, sf):
    f = frames(spark, sf).groupBy("kind", F.expr("CASE id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END").alias("other")).agg(F.avg("level").alias("effect"))
    return inference.matched_specificity(f, "kind", "other", "effect").select(*[F.round(c, 6).alias(c) for c in ("matched", "unmatched", "specificity")])


def extreme_recordings(spark, sf):
    return inference.extremes(_wide(spark, sf), "id", FEATURES, 3).select("feature", "id", "side", "place")


def blind_review(spark, sf):
    rows = labelled(spark, sf)
    a = rows.select("id", F.when(F.col("quality") == 1, "clean").when(F.col("toxic") == 1, "rude").otherwise("noise").alias("label"))
    b = rows.select("id", F.when(F.col("score") > 800, "clean").when(F.col("toxic") == 1, "rude").otherwise("noise").alias("label"))
    return inference.blind_review(a, b, "id", "label", ["noise", "rude"]).select("items", "to_adjudicate", *[F.round(c, 6).alias(c) for c in ("exact", "binary", "kappa")])


def detection_metrics(spark, sf):
    return labelled(spark, sf).groupBy("stratum").agg(*inference.truth_metrics(F.col("toxic") == 1, F.col("score") % 3 == 0)).select("stratum", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def persistence(spark, sf):
    return inference.persistence(_wide(spark, sf), "subject", FEATURES)


def gallery(spark, sf):
    return inference.gallery(_wide(spark, sf), "id", FEATURES, ["grp"], 40)


def detector_roles(spark, sf):
    m = labelled(spark, sf).groupBy("stratum").agg(*inference.truth_metrics(F.col("quality") == 0, F.col("score") % 2 == 0)).withColumn("occurrence_recall", F.lit(0.92))
    return inference.decide_role(m).select("stratum", "failed", "role")


def resolved_diagnoses(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.when(F.col("c_nationkey") % 3 == 0, "als ").when(F.col("c_nationkey") % 3 == 1, "Control").alias("diagnosis"), "c_acctbal")
    manual = c.where("diagnosis IS NULL AND subject % 2 = 0").select("subject", F.lit("als").alias("diagnosis"))
    return cohort.resolve(c, manual, "subject", "diagnosis", ["ALS", "CONTROL"], F.col("c_acctbal") > 5000).select("subject", "resolved", "origin")


def adjudicated_recordings(spark, sf):
    rows = frames(spark, sf).groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("top"))
    sheet = cohort.adjudication_sheet(rows, "rec", {"few_frames": F.col("n") < 60, "loud": F.col("top") > 250}).withColumn("decision", F.when(F.col("decision") == "", "exclude").otherwise(F.col("decision")))
    return cohort.apply_adjudication(rows, sheet, "rec").select("rec", "decision", "eligible")


def frozen_intervals(spark, sf):
    rows = intervals(spark, sf)
    decided = rows.select("rec").distinct().select("rec", F.when(F.col("rec") % 5 == 0, "EXCLUDE").when(F.col("rec") % 5 == 1, "MANUAL").otherwise("KEEP").alias("decision")).withColumn("eligible", F.col("decision") != "EXCLUDE")
    span = rows.groupBy("rec").agg(F.min("start").alias("s0"))
    manual = span.select("rec", F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), (F.col("s0") + i * 3 * DAY).alias("start"), (F.col("s0") + i * 3 * DAY + DAY).alias("end")) for i in range(3)])).alias("x")).select("rec", "x.*")
    manual = cohort.validated_overrides(manual, span.select("rec", (F.col("s0") + 30 * DAY).alias("duration")), "rec")
    views = rows.groupBy("rec").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("view", F.lit("primary_speech"))
    return cohort.frozen_intervals(views, decided, manual, "rec", DAY // 8, DAY // 4)


QUERIES = {f.__name__: f for f in (describe_features, feature_pairs, correlation_matrix, perceptual_links, matched_specificity, extreme_recordings, blind_review, detection_metrics, persistence, gallery, detector_roles, resolved_diagnoses, adjudicated_recordings, frozen_intervals)}

_LONG = f"WITH {REPEATS}, lg AS (SELECT id, subject, 'feature' AS f, feature AS v FROM rp UNION ALL SELECT id, subject, 'balance', balance FROM rp UNION ALL SELECT id, subject, 'gap', CASE WHEN status <> 'P' THEN feature - 10 * balance END FROM rp)"
_PAIRS = _LONG + """, pr AS (SELECT a.f AS feature_a, b.f AS feature_b, a.v AS x, b.v AS y FROM lg a JOIN lg b ON a.id = b.id AND a.f < b.f WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
    rk AS (SELECT feature_a, feature_b, rank() OVER (PARTITION BY feature_a, feature_b ORDER BY x) + (count(*) OVER (PARTITION BY feature_a, feature_b, x) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY feature_a, feature_b ORDER BY y) + (count(*) OVER (PARTITION BY feature_a, feature_b, y) - 1) / 2.0::DOUBLE AS y FROM pr),
    rh AS (SELECT feature_a, feature_b, count(*) AS n, round(corr(x, y), 6) AS rho FROM rk GROUP BY 1, 2)"""


def _metrics(truth: str, found: str) -> str:
    return f"count(*) FILTER (WHERE {truth} AND {found}) AS tp, count(*) FILTER (WHERE NOT {truth} AND {found}) AS fp, count(*) FILTER (WHERE {truth} AND NOT {found}) AS fn"


_PRF = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1"

ORACLES = {
    "describe_features": _LONG + " SELECT f AS feature, count(*) AS recordings, count(DISTINCT CASE WHEN v IS NOT NULL THEN subject END) AS participants, count(v) AS n, count(*) - count(v) AS missing, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(avg((v = 0)::INT), 6) AS zero_fraction FROM lg GROUP BY f",
    "feature_pairs": _PAIRS + " SELECT * FROM rh",
    "correlation_matrix": _PAIRS + ", b AS (SELECT feature_a AS a, feature_b AS b, rho FROM rh UNION ALL SELECT feature_b, feature_a, rho FROM rh UNION ALL SELECT DISTINCT f, f, 1.0 FROM lg) SELECT a AS row_feature, " + ", ".join(f"max(rho) FILTER (WHERE b = '{f}') AS {f}" for f in FEATURES) + " FROM b GROUP BY a",
    "perceptual_links": """WITH l AS (SELECT doc_id, 'quality' AS category, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels), f AS (SELECT doc_id, 'chars' AS feature, CAST(length(text) AS DOUBLE) AS v FROM documents UNION ALL SELECT doc_id, 'octets', CAST(strlen(text) AS DOUBLE) FROM documents),
        j AS (SELECT feature, category, label, rank() OVER (PARTITION BY feature, category ORDER BY v) + (count(*) OVER (PARTITION BY feature, category, v) - 1) / 2.0::DOUBLE AS r FROM f JOIN l ON f.doc_id = l.doc_id WHERE v IS NOT NULL AND label IN (0, 1)),
        c AS (SELECT feature, category, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg, sum(r) FILTER (WHERE label = 1) AS s FROM j GROUP BY 1, 2)
        SELECT feature, category, n_pos, n_neg, round(CASE WHEN n_pos >= 5 AND n_neg >= 5 THEN (s - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg) END, 6) AS auc, CASE WHEN n_pos >= 5 AND n_neg >= 5 THEN 'ok' ELSE 'insufficient_class_support' END AS status FROM c""",
    "matched_specificity": f"""WITH {FRAMES}, e AS (SELECT kind, CASE id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END AS other, avg(level) AS effect FROM fr GROUP BY 1, 2)
        SELECT round(avg(effect) FILTER (WHERE kind = other), 6) AS matched, round(avg(effect) FILTER (WHERE kind <> other), 6) AS unmatched, round(avg(effect) FILTER (WHERE kind = other) - avg(effect) FILTER (WHERE kind <> other), 6) AS specificity FROM e""",
    "extreme_recordings": _LONG + ", k AS (SELECT f AS feature, id, row_number() OVER (PARTITION BY f ORDER BY v, id) AS lo, row_number() OVER (PARTITION BY f ORDER BY v DESC, id) AS hi FROM lg WHERE v IS NOT NULL) SELECT feature, id, 'low' AS side, lo AS place FROM k WHERE lo <= 3 UNION ALL SELECT feature, id, 'high', hi FROM k WHERE hi <= 3",
    "gallery": f"""{_LONG}, k AS (SELECT f, id, row_number() OVER (PARTITION BY f ORDER BY v, id) AS lo, row_number() OVER (PARTITION BY f ORDER BY v DESC, id) AS hi FROM lg WHERE v IS NOT NULL), en AS (SELECT id, f || '_low' AS reason, lo AS turn FROM k WHERE lo <= 2 UNION ALL SELECT id, f || '_high', hi FROM k WHERE hi <= 2),
        al AS (SELECT id, 0 AS cl, turn, reason FROM en UNION ALL SELECT id, 1, row_number() OVER (PARTITION BY grp ORDER BY sha256('20260713|' || id), id), 'stratum_' || grp FROM rp), g AS (SELECT id, min(cl * 1000000000 + turn) AS o, string_agg(DISTINCT reason, '|' ORDER BY reason) FILTER (WHERE cl = 0) AS ends, min(reason) FILTER (WHERE cl = 1) AS st FROM al GROUP BY 1)
        SELECT id, CASE WHEN o < 1000000000 THEN ends ELSE st END AS reason FROM g ORDER BY o, sha256('20260713|' || id), id LIMIT 40""",
    "blind_review": f"""WITH {LABELLED}, r AS (SELECT CASE WHEN quality = 1 THEN 'clean' WHEN toxic = 1 THEN 'rude' ELSE 'noise' END AS a, CASE WHEN score > 800 THEN 'clean' WHEN toxic = 1 THEN 'rude' ELSE 'noise' END AS b FROM lb),
        s AS (SELECT count(*) AS items, count(*) FILTER (WHERE a <> b) AS to_adjudicate, avg((a = b)::INT) AS ex, avg(((a <> 'clean') = (b <> 'clean'))::INT) AS bi, avg((a <> 'clean')::INT) AS ma, avg((b <> 'clean')::INT) AS mb FROM r)
        SELECT items, to_adjudicate, round(ex, 6) AS exact, round(bi, 6) AS binary, round((bi - (ma * mb + (1 - ma) * (1 - mb))) / (1 - (ma * mb + (1 - ma) * (1 - mb))), 6) AS kappa FROM s""",
    "detection_metrics": f"WITH {LABELLED}, m AS (SELECT stratum, {_metrics('toxic = 1', 'score % 3 = 0')} FROM lb GROUP BY 1) SELECT stratum, tp, fp, fn, {_PRF} FROM m",
    "detector_roles": f"""WITH {LABELLED}, m AS (SELECT stratum, {_metrics('quality = 0', 'score % 2 = 0')} FROM lb GROUP BY 1), p AS (SELECT stratum, {_PRF} FROM m)
        SELECT stratum, concat_ws('|', CASE WHEN NOT coalesce(precision >= 0.95, false) THEN 'precision' END, CASE WHEN NOT coalesce(recall >= 0.85, false) THEN 'recall' END, CASE WHEN NOT coalesce(f1 >= 0.70, false) THEN 'f1' END) AS failed, CASE WHEN precision >= 0.95 AND recall >= 0.85 AND f1 >= 0.70 THEN 'full' ELSE 'occurrence_only' END AS role FROM p""",
    "resolved_diagnoses": """WITH c AS (SELECT c_custkey AS subject, CASE c_nationkey % 3 WHEN 0 THEN 'ALS' WHEN 1 THEN 'CONTROL' END AS d, c_acctbal AS b FROM customer)
        SELECT subject, coalesce(d, CASE WHEN subject % 2 = 0 THEN 'ALS' END, CASE WHEN b > 5000 THEN 'CONTROL' END) AS resolved, CASE WHEN d IS NOT NULL THEN 'reported' WHEN subject % 2 = 0 THEN 'manual' WHEN b > 5000 THEN 'rule' ELSE 'unresolved' END AS origin FROM c""",
    "adjudicated_recordings": f"WITH {FRAMES}, r AS (SELECT rec, count(*) < 60 OR max(level) > 250 AS bad FROM fr GROUP BY 1) SELECT rec, CASE WHEN bad THEN 'EXCLUDE' ELSE 'KEEP' END AS decision, NOT bad AS eligible FROM r",
    "frozen_intervals": f"""WITH {INTERVALS}, sp AS (SELECT rec, min(s) AS s0, max(e) AS e1 FROM iv GROUP BY 1), mn AS (SELECT rec, s0 + i * {3 * DAY} AS s, s0 + i * {3 * DAY} + {DAY} AS e FROM sp, (SELECT unnest(range(3)) AS i) WHERE rec % 5 = 1),
        gp AS (SELECT rec, e AS s, lead(s) OVER (PARTITION BY rec ORDER BY s) AS e FROM mn),
        v AS (SELECT rec, 'primary_speech' AS view, s0 AS s, e1 AS e, 'detected' AS source FROM sp WHERE rec % 5 NOT IN (0, 1) UNION ALL SELECT rec, 'primary_speech', s, e, 'manual' FROM mn
              UNION ALL SELECT rec, 'strict_speech', s + {DAY // 8}, e - {DAY // 8}, 'manual' FROM mn UNION ALL SELECT rec, 'strict_internal_nonspeech', s + {DAY // 4}, e - {DAY // 4}, 'manual' FROM gp WHERE e IS NOT NULL)
        SELECT rec, view, s AS "start", e AS "end", source, row_number() OVER (PARTITION BY rec, view ORDER BY s) - 1 AS interval_index FROM v""",
}
