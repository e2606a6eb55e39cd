"""Bootstrap, deletion, reference and alignment queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quantiles import PPND16
from ..functions.values import Z95
from ..operators import inference, ranks, robust, sensitivity
from .base import FRAMES, RATINGS, REPEATS, frames, labelled, ratings, repeats, table

REPLICATES = 200


def _boot(df, cluster, statistic, x, y):
    out = robust.bootstrap_statistic(df, cluster, statistic, x, y, REPLICATES)
    return out.select("statistic", *[F.round(c, 6).alias(c) for c in ("estimate", "ci_low", "ci_high")], "replicates", "clusters")


def bootstrap_spearman(spark, sf):
    return _boot(repeats(spark, sf), "subject", "spearman", "feature", "balance")


def bootstrap_auc(spark, sf):
    return _boot(labelled(spark, sf).withColumn("cluster", F.col("id") % 60), "cluster", "auc", "score", "quality")


def bootstrap_icc(spark, sf):
    return _boot(robust.first_second(repeats(spark, sf), "subject", ["visit", "id"], "feature"), "subject", "icc", "first", "second")


def _pairs(spark, sf):
    f = frames(spark, sf).groupBy("rec", (F.col("id") % 7).alias("slot")).agg(F.max(F.when(F.col("kind") == "click", F.col("level"))).alias("a"), F.max(F.when(F.col("kind") == "view", F.col("level"))).alias("b"))
    return f.select("rec", (F.col("a") > 60).cast("int").alias("x"), (F.col("b") > 60).cast("int").alias("y"))


def bootstrap_kappa(spark, sf):
    return _boot(_pairs(spark, sf), "rec", "kappa", "x", "y")


def bootstrap_ac1(spark, sf):
    return _boot(_pairs(spark, sf), "rec", "ac1", "x", "y")


def first_second_pairs(spark, sf):
    return robust.first_second(repeats(spark, sf).where("status <> 'P'"), "subject", ["visit", "id"], "feature")


def cluster_deletion(spark, sf):
    out = robust.cluster_deletion(frames(spark, sf), "rec", "kind", "level")
    return out.select("rec", "omitted", *[F.round(c, 6).alias(c) for c in ("full", "deleted", "change")], "remaining")


def interval_ledger(spark, sf):
    rows = frames(spark, sf).select("rec", F.col("kind").alias("idx"), "level", (F.col("level") < 5).alias("at_floor"))
    windows = frames(spark, sf).where("kind <> 'error'").select("rec", F.col("kind").alias("idx"), F.when(F.col("id") % 3 > 0, F.col("level")).alias("flatness"))
    return robust.interval_ledger(rows, windows, "rec").select("rec", "idx", "frames", "valid", F.round("floor_fraction", 6).alias("floor_fraction"), F.round("level", 6).alias("level"), "windows")


def null_grid(spark, sf):
    pool = frames(spark, sf).select("id", "level", (F.lit(400) - F.col("level")).alias("other"))
    out = robust.null_grid(pool, "id", ["level", "other"], [1, 2, 5, 5, 9], 300)
    return out.select("windows", "iterations", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "p90", "p95", "p99")])


def _spectra(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("task"), (F.col("vec_id") % 11).alias("subject"), F.posexplode("embedding").alias("bin", "power")).withColumn("power", F.col("power").cast("double"))


def vintage_hashes(spark, sf):
    members = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("task"), (F.col("vec_id") % 11).alias("subject"), F.col("vec_id").alias("id"), F.col("label").alias("spectrum_hash"))
    return robust.vintage_hash(members, "v1")


def eligible_members(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("task"), (F.col("vec_id") % 11).alias("subject"), F.col("vec_id").alias("id"))
    return robust.eligible_members(rows, "3", F.col("subject") == 4, F.col("id") % 5 > 0)


def _grid(spark, sf):
    long = _spectra(spark, sf)
    return robust.reference_robustness(robust.reference_distances(long, robust.vintages(long, 3, 4)))


def reference_robustness(spark, sf):
    return _grid(spark, sf).select("comparison", "iteration", "id", *[F.round(c, 6).alias(c) for c in ("baseline", "variant", "delta")])


def reference_robustness_summary(spark, sf):
    return robust.robustness_summary(_grid(spark, sf)).select("comparison", "targets", "rows", "pairs", *[F.round(c, 6).alias(c) for c in ("rho", "median_delta", "p95_delta", "max_delta")])


def reference_rank_stability(spark, sf):
    return robust.rank_stability(_grid(spark, sf)).select("comparison", "iterations", *[F.round(c, 6).alias(c) for c in ("median_rho", "low_rho", "high_rho", "least_rho")])


def family_alignment(spark, sf):
    f = frames(spark, sf).withColumn("item", F.col("rec") * 10 + F.col("id") % 10)
    scores = f.where("kind IN ('click', 'view')").groupBy("item", F.col("kind").alias("objective")).agg(F.max("level").alias("score"), F.max("rec").alias("subject"))
    labels = f.where("kind IN ('error', 'signup', 'purchase')").groupBy("item", F.col("kind").alias("human")).agg((F.max("level") > F.when(F.col("kind") == "purchase", 400).otherwise(60)).cast("int").alias("label"))
    out = robust.family_alignment(scores, labels, "item", "subject")
    return out.select("human", "objective", "recordings", "participants", *[F.round(c, 6).alias(c) for c in ("prevalence", "auc", "effect")], "status")


def gain_tiers(spark, sf):
    per = frames(spark, sf).groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind").alias("k"), F.max("level").alias("top"))
    return per.select("rec", robust.level_tier(F.col("n") / 4.0, F.col("n") * 2, F.col("k")).alias("level_tier"), robust.drift_tier(F.col("k") + 1, F.col("top") / 10).alias("drift_tier"))


def recording_roles(spark, sf):
    rows = repeats(spark, sf).select("id", F.when(F.col("status") == "F", F.col("balance")).alias("rate"), (F.col("feature") / 1e6).alias("fraction"), F.when(F.col("status") == "O", "available_no_events").otherwise("available").alias("said"))
    out = robust.recording_table(rows, "rate", "fraction", "said")
    return out.select("id", "positive", "valid_zero", "occurrence", F.round("ms_per_min", 6).alias("ms_per_min"))


def role_features(spark, sf):
    return robust.by_role(repeats(spark, sf), "id", {"feature": "primary", "balance": "secondary", "subject": "conditional"})


def profile_sensitivity(spark, sf):
    """A feature under two profiles over all recordings of either: coverage, correlation and change."""
    a = repeats(spark, sf).where("id % 10 > 0").select("id", F.col("feature").alias("primary"))
    b = repeats(spark, sf).where("id % 7 > 0").select("id", (F.col("feature") + F.col("balance")).alias("variant"))
    rows = a.join(b, "id", "full_outer").withColumn("k", F.lit("all"))
    out = sensitivity.compare_variants(rows, ["k"], "primary", "variant")
    return out.select("rows", "pairs", *[F.round(c, 6).alias(c) for c in ("availability_agreement", "median_difference", "p95_abs_difference")])


def many_to_one(spark, sf):
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_custkey % 4 > 0"), table(spark, sf, "nation")
    media = c.join(F.broadcast(n.where("n_regionkey < 3")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")
    return o.join(media, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("n_name").alias("nation"), F.col("c_custkey").isNotNull().alias("matched"))


def theil_sen_interval(spark, sf):
    f = frames(spark, sf).withColumn("hours", F.floor(F.col("t") / 3.6e9).cast("double"))
    out = ranks.theil_sen_interval(f, ["rec"], "hours", "level", Z95)
    return out.select("rec", "pairs", *[F.round(c, 6).alias(c) for c in ("slope", "low", "high")])


def human_rank_scores(spark, sf):
    r = ratings(spark, sf)
    return inference.rank_normal(r, ["rater"], "score", "z").select("item", "rater", F.round("z", 6).alias("z"))


QUERIES = {f.__name__: f for f in (bootstrap_spearman, bootstrap_auc, bootstrap_icc, bootstrap_kappa, bootstrap_ac1, first_second_pairs, cluster_deletion, interval_ledger, null_grid, vintage_hashes, eligible_members, reference_robustness, reference_robustness_summary, reference_rank_stability, family_alignment, gain_tiers, recording_roles, role_features, profile_sensitivity, many_to_one, theil_sen_interval, human_rank_scores)}

SEED = "20260713"


def _draw(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5('{SEED}|' || " + " || '|' || ".join(parts) + "), 1, 12)) AS BIGINT)"


_WEIGHTS = f"""cl AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT c FROM b)), rp_ AS (SELECT unnest(range({REPLICATES})) AS r), dr AS (SELECT r, {_draw('r', 'i')} % n AS i FROM cl, rp_),
    wt AS (SELECT d.r, cl.c, count(*)::DOUBLE AS w FROM dr d JOIN cl ON d.i = cl.i GROUP BY 1, 2), s AS (SELECT r, w, x, y FROM b JOIN wt ON b.c = wt.c UNION ALL SELECT -1, 1.0, x, y FROM b)"""
_RANKED = """rk AS (SELECT r, w, x, y, sum(w) OVER (PARTITION BY r ORDER BY x RANGE UNBOUNDED PRECEDING) - sum(w) OVER (PARTITION BY r, x) + (sum(w) OVER (PARTITION BY r, x) + 1) / 2 AS a, sum(w) OVER (PARTITION BY r ORDER BY y RANGE UNBOUNDED PRECEDING) - sum(w) OVER (PARTITION BY r, y) + (sum(w) OVER (PARTITION BY r, y) + 1) / 2 AS b FROM s)"""
_STAT = {
    "spearman": _RANKED + ", m AS (SELECT r, sum(w) AS n, sum(w*a) AS sa, sum(w*b) AS sb, sum(w*a*b) AS ab, sum(w*a*a) AS aa, sum(w*b*b) AS bb FROM rk GROUP BY r), v AS (SELECT r, CASE WHEN aa - sa*sa/n > 1e-9 AND bb - sb*sb/n > 1e-9 THEN (ab - sa*sb/n) / sqrt((aa - sa*sa/n) * (bb - sb*sb/n)) END AS v FROM m)",
    "auc": _RANKED + ", m AS (SELECT r, sum(w) AS n, sum(w*y) AS p, sum(w*y*a) AS s FROM rk GROUP BY r), v AS (SELECT r, CASE WHEN p > 0 AND n > p THEN (s - p * (p + 1) / 2) / (p * (n - p)) END AS v FROM m)",
    "icc": "m AS (SELECT r, sum(w) AS n, sum(w*(x+y)/2) AS m1, sum(w*(x+y)*(x+y)/4) AS m2, sum(w*(x-y)*(x-y)) AS dd FROM s GROUP BY r), q AS (SELECT r, n, 2 * (m2 - m1*m1/n) / (n - 1) AS b, dd / n / 2 AS e FROM m), v AS (SELECT r, CASE WHEN n > 1 AND b + e > 0 THEN (b - e) / (b + e) END AS v FROM q)",
    "kappa": "m AS (SELECT r, sum(w * (x = y)::INT) / sum(w) AS o, sum(w*x) / sum(w) AS a, sum(w*y) / sum(w) AS b FROM s GROUP BY r), q AS (SELECT r, o, a * b + (1 - a) * (1 - b) AS e FROM m), v AS (SELECT r, CASE WHEN e < 1 - 1e-12 THEN (o - e) / (1 - e) END AS v FROM q)",
    "ac1": "m AS (SELECT r, sum(w * (x = y)::INT) / sum(w) AS o, (sum(w*x) + sum(w*y)) / sum(w) / 2 AS g FROM s GROUP BY r), q AS (SELECT r, o, 2 * g * (1 - g) AS e FROM m), v AS (SELECT r, CASE WHEN e < 1 - 1e-12 THEN (o - e) / (1 - e) END AS v FROM q)",
}


def _bootstrap(base: str, statistic: str) -> str:
    return f"""WITH {base}, {_WEIGHTS}, {_STAT[statistic]} SELECT '{statistic}' AS statistic, round(max(v) FILTER (WHERE r = -1), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (WHERE r >= 0), 6) AS ci_low, round(quantile_cont(v, 0.975) FILTER (WHERE r >= 0), 6) AS ci_high, count(v) FILTER (WHERE r >= 0) AS replicates, (SELECT count(*) FROM cl) AS clusters FROM v"""


_TWO = f"{REPEATS}, fs AS (SELECT subject, feature, row_number() OVER (PARTITION BY subject ORDER BY visit, id) AS k FROM rp), b AS (SELECT subject AS c, max(feature) FILTER (WHERE k = 1) AS x, max(feature) FILTER (WHERE k = 2) AS y FROM fs WHERE k <= 2 GROUP BY 1 HAVING count(*) = 2)"
_BOTH = "b0 AS (SELECT user_id AS c, event_id % 7 AS g, max(value) FILTER (WHERE event_type = 'click') > 60 AS x, max(value) FILTER (WHERE event_type = 'view') > 60 AS y FROM events GROUP BY 1, 2), b AS (SELECT c, x::INT AS x, y::INT AS y FROM b0 WHERE x IS NOT NULL AND y IS NOT NULL)"
_REF = f"""sp AS (SELECT vec_id AS id, label % 3 AS task, vec_id % 11 AS subject, i AS bin, CAST(embedding[i + 1] AS DOUBLE) AS power FROM embeddings, (SELECT unnest(range(64)) AS i)), sj AS (SELECT DISTINCT task, subject FROM sp), nb AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY subject) - 1 AS p FROM sj),
    vt AS (SELECT 'baseline' AS comparison, 0 AS iteration, task, subject FROM sj UNION ALL SELECT 'subset', i, task, subject FROM sj, (SELECT unnest(range(4)) AS i) WHERE {_draw('i', 'subject')} % 100 < 80 UNION ALL SELECT 'delete_one', i, task, subject FROM nb, (SELECT unnest(range(3)) AS i) WHERE p <> i),
    md AS (SELECT task, subject, bin, quantile_cont(power, 0.5) AS power FROM sp GROUP BY 1, 2, 3), sb AS (SELECT DISTINCT task, subject FROM sp),
    rf AS (SELECT vt.comparison, vt.iteration, t.task, t.subject, md.bin, CASE WHEN count(*) >= 3 THEN quantile_cont(md.power, 0.5) END AS reference FROM sb t JOIN vt ON vt.task = t.task AND vt.subject <> t.subject JOIN md ON md.task = vt.task AND md.subject = vt.subject GROUP BY 1, 2, 3, 4, 5),
    ds AS (SELECT comparison, iteration, id, sqrt(avg((power - reference) * (power - reference))) AS d FROM sp JOIN rf ON sp.task = rf.task AND sp.subject = rf.subject AND sp.bin = rf.bin GROUP BY 1, 2, 3),
    gd AS (SELECT a.comparison, a.iteration, a.id, b.d AS baseline, a.d AS variant, abs(a.d - b.d) AS delta FROM ds a JOIN ds b ON a.id = b.id AND b.comparison = 'baseline' WHERE a.comparison <> 'baseline')"""


def _rho(keys: str) -> str:
    r = lambda x: f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE)"
    return f"(SELECT {keys}, corr(a, b) AS rho FROM (SELECT {keys}, {r('baseline')} AS a, {r('variant')} AS b FROM gd WHERE baseline IS NOT NULL AND variant IS NOT NULL) GROUP BY {keys})"


def _quotient(x: str, pair) -> str:
    """SQL of a quotient of polynomials of x."""
    horner = lambda cs: "(" * (len(cs) - 1) + f"{cs[-1]!r}::DOUBLE" + "".join(f" * ({x}) + {c!r}::DOUBLE)" for c in reversed(cs[:-1]))
    return f"{horner(pair[0])} / {horner(pair[1])}"


ORACLES = {
    "human_rank_scores": f"""WITH {RATINGS}, p AS (SELECT item, rater, (rank() OVER (PARTITION BY rater ORDER BY score) + (count(*) OVER (PARTITION BY rater, score) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY rater) AS p FROM rt), q AS (SELECT *, p - 0.5 AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM p)
        SELECT item, rater, round(CASE WHEN abs(q) <= 0.425 THEN q * {_quotient('0.180625 - q * q', PPND16[0])} WHEN r <= 5 THEN sign(q) * {_quotient('r - 1.6', PPND16[1])} ELSE sign(q) * {_quotient('r - 5', PPND16[2])} END, 6) AS z FROM q""",
    "bootstrap_spearman": _bootstrap(f"{REPEATS}, b AS (SELECT subject AS c, feature AS x, balance AS y FROM rp)", "spearman"),
    "bootstrap_auc": _bootstrap("b AS (SELECT d.doc_id % 60 AS c, n_chars AS x, quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE n_chars IS NOT NULL AND quality IS NOT NULL)", "auc"),
    "bootstrap_icc": _bootstrap(_TWO, "icc"),
    "bootstrap_kappa": _bootstrap(_BOTH, "kappa"),
    "bootstrap_ac1": _bootstrap(_BOTH, "ac1"),
    "first_second_pairs": f"WITH {REPEATS}, f AS (SELECT subject, feature, row_number() OVER (PARTITION BY subject ORDER BY visit, id) AS k FROM rp WHERE status <> 'P') SELECT subject, max(feature) FILTER (WHERE k = 1) AS first, max(feature) FILTER (WHERE k = 2) AS second FROM f WHERE k <= 2 GROUP BY 1 HAVING count(*) = 2",
    "cluster_deletion": f"""WITH {FRAMES}, f AS (SELECT rec, quantile_cont(level, 0.5) AS m, count(DISTINCT kind) AS k FROM fr GROUP BY 1), c AS (SELECT DISTINCT rec, kind FROM fr)
        SELECT c.rec, c.kind AS omitted, round(any_value(m), 6) AS "full", round(quantile_cont(level, 0.5), 6) AS deleted, round(abs(quantile_cont(level, 0.5) - any_value(m)), 6) AS change, any_value(k) - 1 AS remaining FROM c JOIN fr ON c.rec = fr.rec AND c.kind <> fr.kind JOIN f ON c.rec = f.rec GROUP BY 1, 2""",
    "interval_ledger": f"""WITH {FRAMES} SELECT rec, kind AS idx, count(*) AS frames, count_if(level >= 5) AS valid, round(avg((level < 5)::INT), 6) AS floor_fraction, round(quantile_cont(level, 0.5) FILTER (WHERE level >= 5), 6) AS level, count_if(kind <> 'error' AND id % 3 > 0) AS windows FROM fr GROUP BY 1, 2""",
    "null_grid": f"""WITH {FRAMES}, p AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n, level AS a, 400 - level AS b FROM fr), c AS (SELECT unnest([2, 5, 9]) AS w), t AS (SELECT unnest(range(300)) AS it), d AS (SELECT unnest(range(9)) AS d), k AS (SELECT w, it, {_draw('w', 'it', 'd')} % (SELECT count(*) FROM fr) AS i FROM c, t, d WHERE d < w),
        m AS (SELECT w, it, greatest(quantile_cont(a, 0.5), quantile_cont(b, 0.5)) AS m FROM k JOIN p ON k.i = p.i GROUP BY 1, 2)
        SELECT w AS windows, count(*) AS iterations, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(quantile_cont(m, 0.9), 6) AS p90, round(quantile_cont(m, 0.95), 6) AS p95, round(quantile_cont(m, 0.99), 6) AS p99 FROM m GROUP BY 1""",
    "vintage_hashes": "WITH h AS (SELECT label % 3 AS task, sha256(concat_ws('|', label % 3, vec_id % 11, vec_id, label)) AS h FROM embeddings) SELECT task, count(*) AS members, sha256('v1' || string_agg(h, '' ORDER BY h)) AS vintage FROM h GROUP BY 1",
    "eligible_members": "SELECT CAST(label AS VARCHAR) AS task, vec_id % 11 AS subject, vec_id AS id FROM embeddings WHERE label = 3 AND vec_id % 11 <> 4 AND vec_id % 5 > 0",
    "reference_robustness": f"WITH {_REF} SELECT comparison, iteration, id, round(baseline, 6) AS baseline, round(variant, 6) AS variant, round(delta, 6) AS delta FROM gd",
    "reference_robustness_summary": f"""WITH {_REF}, f AS (SELECT comparison, count(DISTINCT id) AS targets, count(*) AS rows, count(delta) AS pairs, round(quantile_cont(delta, 0.5), 6) AS median_delta, round(quantile_cont(delta, 0.95), 6) AS p95_delta, round(max(delta), 6) AS max_delta FROM gd GROUP BY 1) SELECT f.*, round(rho, 6) AS rho FROM f JOIN {_rho('comparison')} r ON f.comparison = r.comparison""",
    "reference_rank_stability": f"WITH {_REF} SELECT comparison, count(rho) AS iterations, round(quantile_cont(rho, 0.5), 6) AS median_rho, round(quantile_cont(rho, 0.025), 6) AS low_rho, round(quantile_cont(rho, 0.975), 6) AS high_rho, round(min(rho), 6) AS least_rho FROM {_rho('comparison, iteration')} GROUP BY 1",
    "family_alignment": f"""WITH {FRAMES}, f AS (SELECT *, rec * 10 + id % 10 AS item FROM fr), sc AS (SELECT item, kind AS objective, max(level) AS score, max(rec) AS subject FROM f WHERE kind IN ('click', 'view') GROUP BY 1, 2), lb AS (SELECT item, kind AS human, (max(level) > CASE kind WHEN 'purchase' THEN 400 ELSE 60 END)::INT AS y FROM f WHERE kind IN ('error', 'signup', 'purchase') GROUP BY 1, 2),
        j AS (SELECT human, objective, subject, y, rank() OVER (PARTITION BY human, objective ORDER BY score) + (count(*) OVER (PARTITION BY human, objective, score) - 1) / 2.0::DOUBLE AS r FROM lb JOIN sc ON lb.item = sc.item), g AS (SELECT human, objective, count(*) AS n, count(DISTINCT subject) AS s, avg(y) AS p, sum(y) AS np, count(*) - sum(y) AS nn, sum(r) FILTER (WHERE y = 1) AS sr FROM j GROUP BY 1, 2),
        k AS (SELECT *, (sr - np * (np + 1) / 2.0::DOUBLE) / (np * nn) AS a, CASE WHEN least(np, nn) < 5 THEN 'insufficient_class_recordings' WHEN s < 5 THEN 'insufficient_participants' ELSE 'ok' END AS st FROM g)
        SELECT human, objective, n AS recordings, s AS participants, round(p, 6) AS prevalence, round(CASE WHEN st = 'ok' THEN a END, 6) AS auc, round(CASE WHEN st = 'ok' THEN 2 * a - 1 END, 6) AS effect, st AS status FROM k""",
    "gain_tiers": f"""WITH {FRAMES}, p AS (SELECT rec, count(*) AS n, count(DISTINCT kind) AS k, max(level) AS t FROM fr GROUP BY 1) SELECT rec, CASE WHEN n / 4.0 >= 20 AND n * 2 >= 200 AND k >= 3 THEN 'high' WHEN n / 4.0 >= 10 AND n * 2 >= 100 THEN 'moderate' WHEN n / 4.0 >= 3 AND n * 2 >= 25 THEN 'minimum' ELSE 'unavailable' END AS level_tier,
        CASE WHEN k + 1 >= 8 AND t >= 300 THEN 'high' WHEN k + 1 >= 5 AND t >= 200 THEN 'moderate' WHEN k + 1 >= 3 AND t >= 100 THEN 'minimum' ELSE 'unavailable' END AS drift_tier FROM p""",
    "recording_roles": f"WITH {REPEATS} SELECT id, status = 'F' AND balance > 0 AS positive, status = 'O' AS valid_zero, (status = 'F' AND balance > 0)::INT AS occurrence, round(feature / 1e6 * 60000, 6) AS ms_per_min FROM rp",
    "role_features": f"WITH {REPEATS} SELECT id, 'feature' AS feature, 'primary' AS role, feature AS value FROM rp UNION ALL SELECT id, 'balance', 'secondary', balance FROM rp",
    "profile_sensitivity": f"""WITH {REPEATS}, v AS (SELECT CASE WHEN id % 10 > 0 THEN feature END AS a, CASE WHEN id % 7 > 0 THEN feature + balance END AS b FROM rp WHERE id % 10 > 0 OR id % 7 > 0)
        SELECT count(*) AS rows, count(a + b) AS pairs, round(avg(((a IS NULL) = (b IS NULL))::INT), 6) AS availability_agreement, round(quantile_cont(b - a, 0.5), 6) AS median_difference, round(quantile_cont(abs(b - a), 0.95), 6) AS p95_abs_difference FROM v""",
    "theil_sen_interval": f"""WITH {FRAMES}, a AS (SELECT rec, floor(t / 3.6e9::DOUBLE) AS x, level AS y FROM fr), tx AS (SELECT rec, sum(k * (k - 1) * (2 * k + 5)) AS s FROM (SELECT rec, count(*) AS k FROM a GROUP BY rec, x HAVING count(*) > 1) GROUP BY 1), ty AS (SELECT rec, sum(k * (k - 1) * (2 * k + 5)) AS s FROM (SELECT rec, count(*) AS k FROM a GROUP BY rec, y HAVING count(*) > 1) GROUP BY 1),
        w AS (SELECT c.rec, {Z95}::DOUBLE * sqrt((n * (n - 1) * (2 * n + 5) - coalesce(tx.s, 0) - coalesce(ty.s, 0)) / 18.0::DOUBLE) AS w FROM (SELECT rec, count(*) AS n FROM a GROUP BY 1) c LEFT JOIN tx ON c.rec = tx.rec LEFT JOIN ty ON c.rec = ty.rec),
        s AS (SELECT p.rec, (q.y - p.y) / (q.x - p.x) AS sl FROM a p JOIN a q ON p.rec = q.rec AND p.x < q.x), k AS (SELECT rec, sl, row_number() OVER (PARTITION BY rec ORDER BY sl) - 1 AS k, count(*) OVER (PARTITION BY rec) AS m FROM s)
        SELECT k.rec, count(*) AS pairs, round(quantile_cont(sl, 0.5), 6) AS slope, round(max(sl) FILTER (WHERE k = greatest(round_even((m - w) / 2, 0) - 1, 0)), 6) AS low, round(max(sl) FILTER (WHERE k = least(round_even((m + w) / 2, 0), m - 1)), 6) AS high FROM k JOIN w ON k.rec = w.rec GROUP BY 1""",
    "many_to_one": """SELECT o_orderkey, n_name AS nation, c_custkey IS NOT NULL AS matched FROM orders LEFT JOIN (SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey WHERE c_custkey % 4 > 0) ON o_custkey = c_custkey""",
}
