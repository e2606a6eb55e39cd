"""Rank, agreement, resampling and inference queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import wilson
from ..operators import agreement, ranks, resample
from .base import FRAMES, LABELLED, RATINGS, REPEATS, frames, labelled, ratings, repeats

RATERS = 5


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def percent_scores(spark, sf):
    return ranks.percent_score(repeats(spark, sf).select("grp", "id", "feature"), ["grp"], "feature").select("grp", "id", *r6("score"))


def auc_by_stratum(spark, sf):
    return ranks.auc(labelled(spark, sf), ["stratum"], "score", "quality").select("stratum", "n_pos", "n_neg", *r6("auc"))


def average_precision(spark, sf):
    return ranks.average_precision(labelled(spark, sf), ["stratum"], "score", "toxic", "id").select("stratum", *r6("average_precision"))


def delta_auc(spark, sf):
    rows = labelled(spark, sf).where("quality IS NOT NULL AND toxic IS NOT NULL").withColumn("k", F.lit(1))
    a = ranks.auc(rows, ["k"], "score", "quality").select("k", F.col("auc").alias("auc_quality"))
    b = ranks.auc(rows, ["k"], "score", "toxic").select("k", F.col("auc").alias("auc_toxic"))
    return a.join(b, "k").withColumn("delta", F.col("auc_quality") - F.col("auc_toxic")).select(*r6("auc_quality", "auc_toxic", "delta"))


def spearman_by_group(spark, sf):
    return ranks.spearman(repeats(spark, sf), ["grp"], "feature", "balance").select("grp", "n", *r6("rho"))


def cliffs_delta(spark, sf):
    return ranks.cliffs_delta(repeats(spark, sf), ["priority"], "feature", "grp", "BUILDING", "MACHINERY").select("priority", "n_high", "n_low", *r6("delta"))


def group_contrast(spark, sf):
    per = repeats(spark, sf).groupBy("grp", "subject").agg(F.percentile("feature", 0.5).alias("m"))
    return per.groupBy("grp").agg(F.count(F.lit(1)).alias("subjects"), F.round(F.percentile("m", 0.5), 6).alias("median_of_medians"))


def stratified_effect(spark, sf):
    return ranks.rank_biserial_by_stratum(labelled(spark, sf).withColumn("all", F.lit("all")), ["all"], "stratum", "score", "quality").select("strata", "pairs", *r6("effect"))


def theil_sen_drift(spark, sf):
    f = frames(spark, sf).withColumn("hours", F.col("t") / 3.6e9)
    return ranks.theil_sen(f, ["rec"], "hours", "level").select("rec", "pairs", *r6("slope"))


def mad_iqr(spark, sf):
    return ranks.robust_spread(frames(spark, sf), ["rec"], "level").select("rec", "n", *r6("median", "iqr", "mad"))


def robust_outliers(spark, sf):
    return ranks.robust_outliers(frames(spark, sf).select("rec", "id", "level"), ["rec"], "level", 2.5).select("rec", "id", *r6("robust_z"))


def bh_fdr(spark, sf):
    rows = frames(spark, sf).select("kind", "id", (F.col("level") / 500).alias("p"))
    return ranks.false_discovery(rows, ["kind"], "p").select("kind", "id", *r6("q"))


def cohen_kappa_pairs(spark, sf):
    return agreement.pair_kappa(ratings(spark, sf), "item", "rater", "rating").select("rater_a", "rater_b", "n", *r6("observed", "kappa"))


def gwet_ac1(spark, sf):
    return agreement.gwet_ac1(ratings(spark, sf), "item", "rating").select("items", *r6("observed", "ac1"))


def fleiss_kappa(spark, sf):
    return agreement.fleiss_kappa(ratings(spark, sf), "item", "rating", RATERS).select("items", *r6("observed", "kappa"))


def icc2(spark, sf):
    return agreement.icc_two_way(ratings(spark, sf), "item", "rater", "score", RATERS).select("n", *r6("icc2_1", "icc2_k"))


def first_two_visits_icc1(spark, sf):
    return agreement.icc_one_way(repeats(spark, sf), "subject", ["visit", "id"], "feature").select("subjects", *r6("icc1", "pearson", "median_abs_difference"))


def two_visits_then_drop_icc1(spark, sf):
    rows = repeats(spark, sf).withColumn("feature", F.when(F.col("status") != "P", F.col("feature")))
    return agreement.icc_one_way(rows, "subject", ["visit", "id"], "feature", finite_first=False).select("subjects", *r6("icc1", "pearson", "median_abs_difference"))


def consensus(spark, sf):
    return agreement.consensus(ratings(spark, sf), "item", "rating", RATERS)


def rater_coverage(spark, sf):
    return agreement.coverage(ratings(spark, sf), "item", "rater", RATERS)


def rater_prevalence(spark, sf):
    return agreement.rater_prevalence(ratings(spark, sf), "rater", "rating").select("rater", "cells", "rated", "positive", *r6("prevalence"))


def binary_agreement(spark, sf):
    return agreement.binary_agreement(ratings(spark, sf), "item", "rating").select("items", *r6("prevalence", "positive_agreement", "negative_agreement", "unanimous"))


def wilson_prevalence(spark, sf):
    rows = repeats(spark, sf).groupBy("grp").agg(F.count_if(F.col("status") == "F").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return rows.withColumns({"low": lo, "high": hi}).select("grp", "k", "n", *r6("low", "high"))


def participant_weighting(spark, sf):
    per = repeats(spark, sf).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "F").alias("k"))
    return per.agg(F.count(F.lit(1)).alias("subjects"), F.sum("n").alias("recordings"), (F.sum("k") / F.sum("n")).alias("by_recording"), F.avg(F.col("k") / F.col("n")).alias("by_participant"), F.avg((F.col("k") > 0).cast("double")).alias("any_positive")).select("subjects", "recordings", *r6("by_recording", "by_participant", "any_positive"))


def bootstrap_mean_ci(spark, sf):
    return resample.bootstrap_mean(repeats(spark, sf), "subject", "feature", 40).select("clusters", "replicates", *r6("estimate", "ci_low", "ci_high"))


def bootstrap_median_ci(spark, sf):
    return resample.bootstrap_median(frames(spark, sf), "rec", "level", 40).select("clusters", "replicates", *r6("estimate", "ci_low", "ci_high"))


def balanced_resampling(spark, sf):
    return resample.balanced_medians(repeats(spark, sf), "subject", "id", "feature", 20).select("iterations", *r6("median", "low", "high"))


def one_per_participant(spark, sf):
    return resample.one_per_cluster(repeats(spark, sf).select("subject", "id", "feature"), "subject", "id")


def stratified_sample(spark, sf):
    return resample.stratified_sample(repeats(spark, sf).select("grp", "id"), ["grp"], "id", 60).select("grp", "id", "turn")


def visit_pairs(spark, sf):
    rows = repeats(spark, sf).selectExpr("subject", "id", "status = 'F' AS positive")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.subject") == F.col("b.subject")) & (F.col("a.id") < F.col("b.id")))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("a.positive") & F.col("b.positive")).alias("both"), F.count_if(F.col("a.positive") != F.col("b.positive")).alias("one"), F.count_if(~F.col("a.positive") & ~F.col("b.positive")).alias("neither"))


QUERIES = {f.__name__: f for f in (percent_scores, auc_by_stratum, average_precision, delta_auc, spearman_by_group, cliffs_delta, group_contrast, stratified_effect, theil_sen_drift, mad_iqr, robust_outliers, bh_fdr, cohen_kappa_pairs, gwet_ac1, fleiss_kappa, icc2, first_two_visits_icc1, two_visits_then_drop_icc1, consensus, rater_coverage, rater_prevalence, binary_agreement, wilson_prevalence, participant_weighting, bootstrap_mean_ci, bootstrap_median_ci, balanced_resampling, one_per_participant, stratified_sample, visit_pairs)}


def _auc(source: str, key: str, score: str, label: str) -> str:
    return f"""(SELECT {key}, count(*) FILTER (WHERE {label} = 1) AS n_pos, count(*) FILTER (WHERE {label} = 0) AS n_neg,
        (sum(r) FILTER (WHERE {label} = 1) - count(*) FILTER (WHERE {label} = 1) * (count(*) FILTER (WHERE {label} = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (WHERE {label} = 1) * count(*) FILTER (WHERE {label} = 0), 0)::DOUBLE AS auc
        FROM (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY {score}) + (count(*) OVER (PARTITION BY {key}, {score}) - 1) / 2.0::DOUBLE AS r FROM {source} WHERE {score} IS NOT NULL AND {label} IN (0, 1)) GROUP BY {key})"""


_ICC = """SELECT count(*) AS subjects, round((2 * var_samp((a + b) / 2) - avg((a - b) * (a - b)) / 2) / (2 * var_samp((a + b) / 2) + avg((a - b) * (a - b)) / 2), 6) AS icc1,
    round(corr(a, b), 6) AS pearson, round(quantile_cont(abs(a - b), 0.5), 6) AS median_abs_difference FROM p WHERE a IS NOT NULL AND b IS NOT NULL"""
_DRAW = "CAST(('0x' || substr(md5('20260713|' || rep || '|' || d), 1, 12)) AS BIGINT) % n"
_WEIGHTS = f"""c AS (SELECT cl, row_number() OVER (ORDER BY cl) - 1 AS i FROM (SELECT DISTINCT cl FROM src)), nn AS (SELECT count(*) AS n FROM c),
    dr AS (SELECT rep, {_DRAW} AS i FROM (SELECT n, unnest(range(n)) AS d FROM nn), (SELECT unnest(range(40)) AS rep)), w AS (SELECT rep, cl, count(*) AS wt FROM dr JOIN c ON dr.i = c.i GROUP BY 1, 2)"""
_CI = "round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, count(*) AS replicates"

ORACLES = {
    "percent_scores": f"""WITH {REPEATS} SELECT grp, id, round(CASE WHEN count(*) OVER (PARTITION BY grp) = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY grp ORDER BY feature) + (count(*) OVER (PARTITION BY grp, feature) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER (PARTITION BY grp) - 1) END, 6) AS score FROM rp""",
    "auc_by_stratum": f"WITH {LABELLED} SELECT stratum, n_pos, n_neg, round(auc, 6) AS auc FROM {_auc('lb', 'stratum', 'score', 'quality')}",
    "average_precision": f"""WITH {LABELLED}, p AS (SELECT stratum, toxic, sum(toxic) OVER w / (count(*) OVER w)::DOUBLE AS pr FROM lb WHERE toxic IS NOT NULL WINDOW w AS (PARTITION BY stratum ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))
        SELECT stratum, round(avg(pr) FILTER (WHERE toxic = 1), 6) AS average_precision FROM p GROUP BY stratum""",
    "delta_auc": f"""WITH {LABELLED}, k AS (SELECT *, 1 AS k FROM lb WHERE quality IS NOT NULL AND toxic IS NOT NULL), a AS {_auc('k', 'k', 'score', 'quality')}, b AS {_auc('k', 'k', 'score', 'toxic')}
        SELECT round(a.auc, 6) AS auc_quality, round(b.auc, 6) AS auc_toxic, round(a.auc - b.auc, 6) AS delta FROM a, b""",
    "spearman_by_group": f"""WITH {REPEATS}, r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY feature) + (count(*) OVER (PARTITION BY grp, feature) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY grp ORDER BY balance) + (count(*) OVER (PARTITION BY grp, balance) - 1) / 2.0::DOUBLE AS y FROM rp)
        SELECT grp, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY grp""",
    "cliffs_delta": f"""WITH {REPEATS}, h AS (SELECT priority, count(*) FILTER (WHERE grp = 'BUILDING') AS n_high, count(*) FILTER (WHERE grp = 'MACHINERY') AS n_low FROM rp GROUP BY 1),
        d AS (SELECT a.priority, sum(sign(a.feature - b.feature)) AS s FROM rp a JOIN rp b ON a.priority = b.priority AND a.grp = 'BUILDING' AND b.grp = 'MACHINERY' GROUP BY 1)
        SELECT h.priority, n_high, n_low, round(s / (n_high * n_low)::DOUBLE, 6) AS delta FROM h JOIN d ON h.priority = d.priority""",
    "group_contrast": f"WITH {REPEATS}, p AS (SELECT grp, subject, quantile_cont(feature, 0.5) AS m FROM rp GROUP BY 1, 2) SELECT grp, count(*) AS subjects, round(quantile_cont(m, 0.5), 6) AS median_of_medians FROM p GROUP BY grp",
    "stratified_effect": f"WITH {LABELLED}, a AS {_auc('lb', 'stratum', 'score', 'quality')} SELECT count(*) AS strata, sum(n_pos * n_neg)::BIGINT AS pairs, round(sum((2 * auc - 1) * n_pos * n_neg) / sum(n_pos * n_neg), 6) AS effect FROM a WHERE auc IS NOT NULL",
    "theil_sen_drift": f"""WITH {FRAMES}, h AS (SELECT rec, t / 3.6e9::DOUBLE AS x, level AS y FROM fr)
        SELECT a.rec, count(*) AS pairs, round(quantile_cont((b.y - a.y) / (b.x - a.x), 0.5), 6) AS slope FROM h a JOIN h b ON a.rec = b.rec AND a.x < b.x GROUP BY a.rec""",
    "mad_iqr": f"""WITH {FRAMES}, m AS (SELECT rec, quantile_cont(level, 0.5) AS md, quantile_cont(level, 0.75) - quantile_cont(level, 0.25) AS iqr FROM fr GROUP BY rec)
        SELECT fr.rec, count(level) AS n, round(max(md), 6) AS median, round(max(iqr), 6) AS iqr, round(1.4826::DOUBLE * quantile_cont(abs(level - md), 0.5), 6) AS mad FROM fr JOIN m ON fr.rec = m.rec GROUP BY fr.rec""",
    "robust_outliers": f"""WITH {FRAMES}, m AS (SELECT rec, quantile_cont(level, 0.5) AS md FROM fr GROUP BY rec), d AS (SELECT fr.rec, md, 1.4826::DOUBLE * quantile_cont(abs(level - md), 0.5) AS mad FROM fr JOIN m ON fr.rec = m.rec GROUP BY 1, 2)
        SELECT fr.rec, id, round((level - md) / mad, 6) AS robust_z FROM fr JOIN d ON fr.rec = d.rec WHERE mad > 0 AND abs((level - md) / mad) > 2.5""",
    "bh_fdr": f"""WITH {FRAMES}, p AS (SELECT kind, id, level / 500.0::DOUBLE AS p FROM fr), k AS (SELECT *, rank() OVER (PARTITION BY kind ORDER BY p) + count(*) OVER (PARTITION BY kind, p) - 1 AS k, count(*) OVER (PARTITION BY kind) AS n FROM p)
        SELECT kind, id, round(least(1.0::DOUBLE, min(p * n / k) OVER (PARTITION BY kind ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS q FROM k""",
    "cohen_kappa_pairs": f"""WITH {RATINGS}, b AS (SELECT a.rater AS rater_a, c.rater AS rater_b, count(*) AS n, avg((a.rating = c.rating)::INT) AS o, avg(a.rating) AS pa, avg(c.rating) AS pb FROM rt a JOIN rt c ON a.item = c.item AND a.rater < c.rater GROUP BY 1, 2)
        SELECT rater_a, rater_b, n, round(o, 6) AS observed, round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) < 1 - 1e-12 THEN (o - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END, 6) AS kappa FROM b""",
    "gwet_ac1": f"""WITH {RATINGS}, c AS (SELECT item, rating, count(*) AS k, sum(count(*)) OVER (PARTITION BY item) AS r FROM rt GROUP BY 1, 2), i AS (SELECT item, max(r) AS r, sum(k * (k - 1)) AS s FROM c GROUP BY 1),
        o AS (SELECT count(*) AS items, avg(s / (r * (r - 1))::DOUBLE) AS o FROM i WHERE r >= 2), p AS (SELECT rating, sum(k / r::DOUBLE) / (SELECT count(*) FROM i) AS p FROM c GROUP BY 1), e AS (SELECT CASE WHEN count(*) > 1 THEN sum(p * (1 - p)) / (count(*) - 1) ELSE 0 END AS e FROM p)
        SELECT items, round(o, 6) AS observed, round((o - e) / (1 - e), 6) AS ac1 FROM o, e""",
    "fleiss_kappa": f"""WITH {RATINGS}, c AS (SELECT item, rating, count(*) AS k, sum(count(*)) OVER (PARTITION BY item) AS r FROM rt GROUP BY 1, 2), f AS (SELECT * FROM c WHERE r = 5),
        a AS (SELECT count(*) AS items, avg(p) AS o FROM (SELECT item, sum(k * (k - 1)) / 20.0::DOUBLE AS p FROM f GROUP BY item)), e AS (SELECT sum(power(k / (items * 5)::DOUBLE, 2)) AS e FROM (SELECT rating, sum(k) AS k FROM f GROUP BY rating), a)
        SELECT items, round(o, 6) AS observed, round(CASE WHEN e < 1 - 1e-12 THEN (o - e) / (1 - e) END, 6) AS kappa FROM a, e""",
    "icc2": f"""WITH {RATINGS}, f AS (SELECT *, count(*) OVER (PARTITION BY item) AS r FROM rt), g AS (SELECT * FROM f WHERE r = 5), t AS (SELECT var_pop(score) AS v FROM g), rw AS (SELECT count(*) AS n, var_pop(a) AS vr FROM (SELECT item, avg(score) AS a FROM g GROUP BY item)), cl AS (SELECT var_pop(a) AS vc FROM (SELECT rater, avg(score) AS a FROM g GROUP BY rater)),
        ms AS (SELECT n, n * 5.0::DOUBLE * vr / (n - 1) AS msr, n * 5.0::DOUBLE * vc / 4 AS msc, n * 5.0::DOUBLE * (v - vr - vc) / ((n - 1) * 4) AS mse FROM t, rw, cl)
        SELECT n, round((msr - mse) / (msr + 4 * mse + 5 * (msc - mse) / n), 6) AS icc2_1, round((msr - mse) / (msr + (msc - mse) / n), 6) AS icc2_k FROM ms""",
    "first_two_visits_icc1": f"WITH {REPEATS}, k AS (SELECT subject, feature, row_number() OVER (PARTITION BY subject ORDER BY visit, id) AS k FROM rp), p AS (SELECT subject, max(feature) FILTER (WHERE k = 1) AS a, max(feature) FILTER (WHERE k = 2) AS b FROM k GROUP BY 1) {_ICC}",
    "two_visits_then_drop_icc1": f"WITH {REPEATS}, k AS (SELECT subject, CASE WHEN status <> 'P' THEN feature END AS feature, row_number() OVER (PARTITION BY subject ORDER BY visit, id) AS k FROM rp), p AS (SELECT subject, max(feature) FILTER (WHERE k = 1) AS a, max(feature) FILTER (WHERE k = 2) AS b FROM k GROUP BY 1) {_ICC}",
    "consensus": f"""WITH {RATINGS}, c AS (SELECT item, rating, count(*) AS k, sum(count(*)) OVER (PARTITION BY item) AS r FROM rt GROUP BY 1, 2), t AS (SELECT *, rank() OVER (PARTITION BY item ORDER BY k DESC) AS top FROM c),
        w AS (SELECT item, max(r)::BIGINT AS ratings, max(k) AS votes, count(*) AS ties, min(rating) AS v FROM t WHERE top = 1 GROUP BY item)
        SELECT item, ratings, votes, CASE WHEN ratings < 2 THEN 'insufficient' WHEN ties > 1 THEN 'tie' WHEN ratings < 5 THEN 'majority_incomplete' ELSE 'majority' END AS status, CASE WHEN ratings >= 2 AND ties = 1 THEN v END AS consensus FROM w""",
    "rater_coverage": f"WITH {RATINGS}, p AS (SELECT item, count(DISTINCT rater) AS raters FROM rt GROUP BY 1) SELECT raters, count(*) AS items, CASE WHEN raters >= 5 THEN 'complete' WHEN raters >= 2 THEN 'partial' ELSE 'blocked' END AS design FROM p GROUP BY raters",
    "rater_prevalence": f"WITH {RATINGS} SELECT rater, count(*) AS cells, count(rating) AS rated, sum(rating)::BIGINT AS positive, round(avg(rating), 6) AS prevalence FROM rt GROUP BY rater",
    "binary_agreement": f"""WITH {RATINGS}, p AS (SELECT item, count(*) AS r, sum(rating) AS k FROM rt GROUP BY 1 HAVING count(*) >= 2)
        SELECT count(*) AS items, round(sum(k) / sum(r)::DOUBLE, 6) AS prevalence, round(sum(k * (k - 1) / (r - 1)::DOUBLE) / nullif(sum(k), 0), 6) AS positive_agreement, round(sum((r - k) * (r - k - 1) / (r - 1)::DOUBLE) / nullif(sum(r - k), 0), 6) AS negative_agreement, round(avg((k = 0 OR k = r)::INT), 6) AS unanimous FROM p""",
    "wilson_prevalence": f"""WITH {REPEATS}, a AS (SELECT grp, count(*) FILTER (WHERE status = 'F') AS k, count(*) AS n FROM rp GROUP BY grp), z AS (SELECT *, k / n::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM a)
        SELECT grp, k, n, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high FROM z""",
    "participant_weighting": f"WITH {REPEATS}, p AS (SELECT subject, count(*) AS n, count(*) FILTER (WHERE status = 'F') AS k FROM rp GROUP BY 1) SELECT count(*) AS subjects, sum(n)::BIGINT AS recordings, round(sum(k) / sum(n)::DOUBLE, 6) AS by_recording, round(avg(k / n::DOUBLE), 6) AS by_participant, round(avg((k > 0)::INT), 6) AS any_positive FROM p",
    "bootstrap_mean_ci": f"""WITH {REPEATS}, src AS (SELECT subject AS cl, sum(feature) AS s, count(*) AS c FROM rp GROUP BY 1), {_WEIGHTS}, st AS (SELECT rep, sum(wt * s) / sum(wt * src.c) AS m FROM w JOIN src ON w.cl = src.cl GROUP BY rep)
        SELECT (SELECT count(*) FROM src) AS clusters, (SELECT round(sum(s) / sum(c), 6) FROM src) AS estimate, {_CI} FROM st""",
    "bootstrap_median_ci": f"""WITH src AS (SELECT user_id AS cl, value AS v FROM events), {_WEIGHTS}, st AS (SELECT rep, quantile_cont(v, 0.5) AS m FROM (SELECT rep, v, unnest(range(wt)) FROM w JOIN src ON w.cl = src.cl) GROUP BY rep)
        SELECT (SELECT count(DISTINCT cl) FROM src) AS clusters, (SELECT round(quantile_cont(v, 0.5), 6) FROM src) AS estimate, {_CI} FROM st""",
    "balanced_resampling": f"""WITH {REPEATS}, it AS (SELECT unnest(range(20)) AS it), pk AS (SELECT it, subject, arg_min(feature, md5('20260713|' || it || '|' || id)) AS v FROM rp, it GROUP BY 1, 2), m AS (SELECT it, quantile_cont(v, 0.5) AS m FROM pk GROUP BY 1)
        SELECT count(*) AS iterations, round(quantile_cont(m, 0.5), 6) AS median, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
    "one_per_participant": f"WITH {REPEATS}, k AS (SELECT subject, id, feature, row_number() OVER (PARTITION BY subject ORDER BY sha256('20260713|0|' || id), id) AS k FROM rp) SELECT subject, id, feature FROM k WHERE k = 1",
    "stratified_sample": f"WITH {REPEATS}, k AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY sha256('20260713|' || id), id) AS turn FROM rp) SELECT grp, id, turn FROM k ORDER BY turn, grp LIMIT 60",
    "visit_pairs": f"WITH {REPEATS} SELECT count(*) AS pairs, count(*) FILTER (WHERE a.status = 'F' AND b.status = 'F') AS both, count(*) FILTER (WHERE (a.status = 'F') <> (b.status = 'F')) AS one, count(*) FILTER (WHERE a.status <> 'F' AND b.status <> 'F') AS neither FROM rp a JOIN rp b ON a.subject = b.subject AND a.id < b.id",
}
