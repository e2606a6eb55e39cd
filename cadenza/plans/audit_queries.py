"""Data-quality, cohort, sensitivity and reference queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import audit, joins, reference, sensitivity
from .base import FRAMES, RATINGS, REPEATS, frames, ratings, repeats, table


def _rules():
    return [
        audit.in_range("o_totalprice", 5000, 300000), audit.one_of("o_orderstatus", ("F", "O")),
        audit.matches("o_orderpriority", r"^[1-4]-", "priority_unparseable"), audit.required("o_orderpriority"),
    ]


def range_violation_issues(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", 0).cast("long").alias("o_totalprice"), "o_orderstatus", "o_orderpriority")
    return audit.issues(rows, "o_orderkey", _rules())


def eligibility(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", 0).cast("long").alias("o_totalprice"), "o_orderstatus", "o_orderpriority")
    ledger = audit.dispositions(audit.issues(rows, "o_orderkey", _rules()), {"value_out_of_range": "flag"})
    return audit.gates(rows.select("o_orderkey"), "o_orderkey", ledger)


def eligibility_flow(spark, sf):
    o = table(spark, sf, "orders")
    return audit.flow(o, {"all": F.lit(True), "finished": F.col("o_orderstatus") == "F", "in_range": F.col("o_totalprice").between(5000, 300000), "prioritised": F.col("o_orderpriority").rlike("^[1-4]-")})


def canonical_dedup(spark, sf):
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice")
    return audit.canonical(rows, ["l_orderkey", "l_linenumber"], [rank, F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")])


def duplicate_keys(spark, sf):
    return audit.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def static_conflict(spark, sf):
    return audit.static_conflicts(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


def duration_disagreement(spark, sf):
    return audit.spread_conflicts(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q")), ["l_orderkey", "l_linenumber"], "q", 20.0)


def column_profile(spark, sf):
    return audit.profile(table(spark, sf, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).select("column", "rows", "nulls", "distinct_values", "numeric_fraction", "smallest", "largest")


def totals_grouping_sets(spark, sf):
    return audit.totals(repeats(spark, sf), "grp", "status", [F.count(F.lit(1)).alias("recordings"), F.countDistinct("subject").alias("subjects")])


def adjudication_missing(spark, sf):
    need = table(spark, sf, "documents").select("doc_id").where("doc_id % 3 = 0")
    done = table(spark, sf, "labels").where("quality IS NOT NULL").select("doc_id")
    missing = need.join(done, "doc_id", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(done.join(need, "doc_id", "left_anti").withColumn("problem", F.lit("stale")))


def resolved_values(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = d.select("doc_id", "lang", "source").join(lab.select("doc_id", "quality"), "doc_id", "left")
    value, origin = audit.layered([("label", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")), ("rule", F.when(F.col("source") == "src0", "good"))])
    return rows.select("doc_id", value.alias("value"), origin.alias("origin"))


def acceptance_reasons(spark, sf):
    level, kind = F.col("level"), F.col("kind")
    return frames(spark, sf).select("id", audit.reason_list({"level_low": level >= 20, "level_high": level <= 90, "kind": kind != "error", "odd": F.col("id") % 2 == 1}).alias("reason"))


def paired_encodings(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("q"))
    a, b = rows.where("l_linestatus = 'O'").select("l_orderkey", F.col("q").alias("a")), rows.where("l_linestatus = 'F'").select("l_orderkey", F.col("q").alias("b"))
    return joins.checked_join(a, b, ["l_orderkey"], "inner", "one_to_one")


def text_normal_forms(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url")
    return rows.select("page_id", values.base_name(F.col("url")).alias("base"), values.snake(F.col("url")).alias("slug"), values.normal_text(F.concat(F.lit("  "), F.col("url"), F.lit("  x "))).alias("normal"), values.as_bool((F.col("page_id") % 2).cast("string")).alias("odd"))


def json_cells(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,double>").alias("m"))
    return rows.select("event_id", F.explode("m").alias("name", "number")).groupBy("name").agg(F.count(F.lit(1)).alias("cells"), F.sum("number").alias("total"), F.countDistinct("number").alias("distinct_values"))


def policy_availability(spark, sf):
    per = repeats(spark, sf).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.percentile("feature", 0.5).alias("m"))
    return sensitivity.policy_availability(per, "n", "m", [2, 5, 10, 15]).select("minimum_count", "recordings", "available", F.round("fraction", 6).alias("fraction"), F.round("median", 6).alias("median"))


def delete_one_influence(spark, sf):
    cents = F.round(F.col("level") * 100).cast("long")
    return sensitivity.delete_one(frames(spark, sf).select("rec", "id", cents.alias("level")), "rec", "id", "level")


def paired_robustness(spark, sf):
    rows = repeats(spark, sf).withColumn("variant", F.when(F.col("status") != "P", F.col("feature") + F.col("balance") / 10))
    out = sensitivity.compare_variants(rows, ["grp"], "feature", "variant")
    return out.select("grp", "rows", "pairs", *[F.round(c, 6).alias(c) for c in ("availability_agreement", "median_difference", "p95_abs_difference", "max_abs_difference")])


def legacy_transitions(spark, sf):
    rows = repeats(spark, sf).select(F.when(F.col("status") == "F", 0.0).otherwise(F.col("feature")).alias("old"), F.when(F.col("priority").startswith("1"), 0.0).when(F.col("priority").startswith("2"), None).otherwise(F.col("feature")).alias("new"))
    return rows.groupBy(sensitivity.transitions(rows, "old", "new").alias("transition")).agg(F.count(F.lit(1)).alias("recordings"))


def reconstruction_audit(spark, sf):
    stored = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("double").alias("q"), F.count(F.lit(1)).cast("double").alias("n"))
    rebuilt = table(spark, sf, "lineitem").where("l_linenumber <= 3").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("double").alias("q"), F.count(F.lit(1)).cast("double").alias("n"))
    return sensitivity.reconstruction(stored, rebuilt, "l_orderkey", ["q", "n"], 1e-9)


def measurement_long(spark, sf):
    rows = repeats(spark, sf).select("id", "feature", F.when(F.col("status") == "F", F.lit(0.0)).when(F.col("status") == "O", F.col("balance")).alias("second"))
    return sensitivity.measurement_long(rows, "id", ["feature", "second"])


def model_interface(spark, sf):
    rows = repeats(spark, sf).select("id", "feature", F.when(F.col("status") == "O", F.col("balance")).alias("second"))
    return sensitivity.model_interface(rows, "id", ["feature", "second"])


def feature_summary(spark, sf):
    rows = repeats(spark, sf).select("feature", F.when(F.col("status") == "O", F.greatest(F.col("balance"), F.lit(0.0))).alias("second"))
    out = sensitivity.feature_summary(rows, ["feature", "second"])
    return out.select("feature", "rows", "available", "zeros", "positives", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "positive_median", "least", "most")])


def family_index(spark, sf):
    wide = ratings(spark, sf).groupBy("item").pivot("rater", ["click", "view", "error"]).agg(F.first("score"))
    return sensitivity.family_index(wide, "item", {"click": 1, "view": -1, "error": 1}).select("item", "available", F.round("family_index", 6).alias("family_index"))


def rating_matrix(spark, sf):
    return ratings(spark, sf).groupBy("item").pivot("rater", ["click", "error", "purchase", "signup", "view"]).agg(F.max("rating"))


def support_tiers(spark, sf):
    per = frames(spark, sf).groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
    return per.select("rec", "n", values.tier(F.col("n"), 50, 60, 75).alias("tier"))


def _spectra(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("task"), (F.col("vec_id") % 25).alias("subject"), F.posexplode("embedding").alias("bin", "power")).withColumn("power", F.col("power").cast("double")).where("bin < 16")


def loso_references(spark, sf):
    return reference.loso_references(_spectra(spark, sf)).select("task", "excluded", "bin", F.round("reference", 6).alias("reference"), "subjects")


def relative_features(spark, sf):
    long = _spectra(spark, sf)
    return reference.relative_features(long, reference.loso_references(long)).select("id", "bins", *[F.round(c, 6).alias(c) for c in ("rms_distance", "excess", "deficit")])


def reference_inventory(spark, sf):
    return reference.reference_inventory(_spectra(spark, sf))


QUERIES = {f.__name__: f for f in (range_violation_issues, eligibility, eligibility_flow, canonical_dedup, duplicate_keys, static_conflict, duration_disagreement, column_profile, totals_grouping_sets, adjudication_missing, resolved_values, acceptance_reasons, paired_encodings, text_normal_forms, json_cells, policy_availability, delete_one_influence, paired_robustness, legacy_transitions, reconstruction_audit, measurement_long, model_interface, feature_summary, family_index, rating_matrix, support_tiers, loso_references, relative_features, reference_inventory)}

_ISSUES = """os AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS price, o_orderstatus, o_orderpriority FROM orders),
    iss AS (SELECT o_orderkey, 'value_out_of_range' AS rule, 'warning' AS severity, 'o_totalprice' AS "column", CAST(price AS VARCHAR) AS value FROM os WHERE price NOT BETWEEN 5000 AND 300000
    UNION ALL SELECT o_orderkey, 'value_not_allowed', 'error', 'o_orderstatus', o_orderstatus FROM os WHERE upper(trim(o_orderstatus)) NOT IN ('F', 'O')
    UNION ALL SELECT o_orderkey, 'priority_unparseable', 'error', 'o_orderpriority', o_orderpriority FROM os WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
    UNION ALL SELECT o_orderkey, 'required_value_missing', 'error', 'o_orderpriority', o_orderpriority FROM os WHERE o_orderpriority IS NULL OR trim(o_orderpriority) = '')"""
_SPECTRA = "sp AS (SELECT vec_id AS id, label AS task, vec_id % 25 AS subject, b AS bin, CAST(embedding[b + 1] AS DOUBLE) AS power FROM embeddings, (SELECT unnest(range(16)) AS b))"
_LOSO = """md AS (SELECT task, subject, bin, quantile_cont(power, 0.5) AS power FROM sp GROUP BY 1, 2, 3),
    ls AS (SELECT a.task, a.subject AS excluded, a.bin, CASE WHEN count(b.power) >= 5 THEN quantile_cont(b.power, 0.5) END AS reference, count(b.power) AS subjects FROM md a LEFT JOIN md b ON a.task = b.task AND a.bin = b.bin AND a.subject <> b.subject GROUP BY 1, 2, 3)"""

ORACLES = {
    "range_violation_issues": f'WITH {_ISSUES} SELECT * FROM iss',
    "eligibility": f"""WITH {_ISSUES}, a AS (SELECT o_orderkey, string_agg(DISTINCT rule, '|' ORDER BY rule) AS reasons FROM iss WHERE rule <> 'value_out_of_range' GROUP BY 1)
        SELECT os.o_orderkey, a.reasons IS NULL AS eligible, coalesce(a.reasons, 'eligible') AS reasons FROM os LEFT JOIN a ON os.o_orderkey = a.o_orderkey""",
    "eligibility_flow": """SELECT 0 AS position, 'all' AS stage, count(*) AS remaining FROM orders UNION ALL SELECT 1, 'finished', count(*) FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 2, 'in_range', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 5000 AND 300000
        UNION ALL SELECT 3, 'prioritised', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 5000 AND 300000 AND regexp_matches(o_orderpriority, '^[1-4]-')""",
    "canonical_dedup": """SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "static_conflict": """WITH c AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS f, count(DISTINCT l_linestatus) AS s FROM lineitem GROUP BY 1)
        SELECT l_orderkey, 'l_returnflag' AS "column", f AS distinct_values FROM c WHERE f > 1 UNION ALL SELECT l_orderkey, 'l_linestatus', s FROM c WHERE s > 1""",
    "duration_disagreement": "SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) - min(l_quantity) AS DOUBLE) AS spread FROM lineitem GROUP BY 1, 2 HAVING max(l_quantity) - min(l_quantity) > 20",
    "column_profile": " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, avg((TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NOT NULL)::INT) FILTER (WHERE {c} IS NOT NULL) AS numeric_fraction, CAST(min({c}) AS VARCHAR) AS smallest, CAST(max({c}) AS VARCHAR) AS largest FROM customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")),
    "totals_grouping_sets": f"WITH {REPEATS} SELECT CASE WHEN grouping(grp) = 1 THEN 'ALL' ELSE grp END AS grp, CASE WHEN grouping(status) = 1 THEN 'ALL' ELSE status END AS status, count(*) AS recordings, count(DISTINCT subject) AS subjects FROM rp GROUP BY ROLLUP (grp, status)",
    "adjudication_missing": """SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)
        UNION ALL SELECT doc_id, 'stale' FROM labels WHERE quality IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)""",
    "resolved_values": """SELECT d.doc_id, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, CASE WHEN source = 'src0' THEN 'good' END) AS value,
        CASE WHEN quality IN (0, 1) THEN 'label' WHEN source = 'src0' THEN 'rule' ELSE 'unresolved' END AS origin FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "acceptance_reasons": f"""WITH {FRAMES} SELECT id, CASE WHEN level >= 20 AND level <= 90 AND kind <> 'error' AND id % 2 = 1 THEN 'accepted' ELSE concat_ws('|', CASE WHEN level < 20 THEN 'level_low' END, CASE WHEN level > 90 THEN 'level_high' END, CASE WHEN kind = 'error' THEN 'kind' END, CASE WHEN id % 2 <> 1 THEN 'odd' END) END AS reason FROM fr""",
    "paired_encodings": """WITH r AS (SELECT l_orderkey, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1, 2) SELECT x.l_orderkey, x.q AS a, y.q AS b FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.l_linestatus = 'O' AND y.l_linestatus = 'F'""",
    "text_normal_forms": r"""SELECT page_id, list_last(string_split_regex(url, '[\\/]')) AS base, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, regexp_replace(trim(url || '  x'), '\s+', ' ', 'g') AS normal, page_id % 2 = 1 AS odd FROM pages""",
    "json_cells": """WITH k AS (SELECT unnest(map_entries(CAST(CAST(props AS JSON) AS MAP(VARCHAR, DOUBLE)))) AS e FROM events) SELECT e.key AS name, count(*) AS cells, sum(e.value) AS total, count(DISTINCT e.value) AS distinct_values FROM k GROUP BY 1""",
    "policy_availability": f"""WITH {REPEATS}, p AS (SELECT subject, count(*) AS n, quantile_cont(feature, 0.5) AS m FROM rp GROUP BY 1), k AS (SELECT unnest([2, 5, 10, 15]) AS minimum_count)
        SELECT minimum_count, count(*) AS recordings, count(*) FILTER (WHERE n >= minimum_count) AS available, round(avg((n >= minimum_count)::INT), 6) AS fraction, round(quantile_cont(CASE WHEN n >= minimum_count THEN m END, 0.5), 6) AS median FROM p, k GROUP BY 1""",
    "delete_one_influence": f"""WITH {FRAMES}, c AS (SELECT rec, id, CAST(round(level * 100) AS BIGINT) AS v FROM fr), s AS (SELECT rec, id, v, sum(v) OVER (PARTITION BY rec)::BIGINT AS s, count(*) OVER (PARTITION BY rec) AS n FROM c)
        SELECT rec, id, CASE WHEN n > 1 THEN (s - v) / (n - 1)::DOUBLE END AS "without", CASE WHEN n > 1 THEN (s - v) / (n - 1)::DOUBLE - s / n::DOUBLE END AS change FROM s""",
    "paired_robustness": f"""WITH {REPEATS}, v AS (SELECT grp, feature AS b, CASE WHEN status <> 'P' THEN feature + balance / 10 END AS v FROM rp)
        SELECT grp, count(*) AS rows, count(v) AS pairs, round(avg((v IS NOT NULL)::INT), 6) AS availability_agreement, round(quantile_cont(v - b, 0.5), 6) AS median_difference, round(quantile_cont(abs(v - b), 0.95), 6) AS p95_abs_difference, round(max(abs(v - b)), 6) AS max_abs_difference FROM v GROUP BY grp""",
    "legacy_transitions": f"""WITH {REPEATS}, v AS (SELECT CASE WHEN status = 'F' THEN 0.0 ELSE feature END AS o, CASE WHEN starts_with(priority, '1') THEN 0.0 WHEN starts_with(priority, '2') THEN NULL ELSE feature END AS n FROM rp)
        SELECT CASE WHEN o IS NULL OR n IS NULL THEN 'unavailable' WHEN o = 0 AND n = 0 THEN 'zero_to_zero' WHEN o = 0 THEN 'new_positive' WHEN n = 0 THEN 'lost_positive' ELSE 'positive_to_positive' END AS transition, count(*) AS recordings FROM v GROUP BY 1""",
    "reconstruction_audit": """WITH s AS (SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS q, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS q, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
        b AS (SELECT s.q AS qa, r.q AS qb, s.n AS na, r.n AS nb FROM s FULL JOIN r ON s.l_orderkey = r.l_orderkey), l AS (SELECT 'q' AS "column", qa AS a, qb AS b FROM b UNION ALL SELECT 'n', na, nb FROM b)
        SELECT "column", count(*) AS cells, count(*) FILTER (WHERE (a IS NULL AND b IS NULL) OR abs(a - b) <= 1e-9) AS matching, max(abs(a - b)) AS max_abs_difference FROM l GROUP BY 1""",
    "measurement_long": f"""WITH {REPEATS}, l AS (SELECT id, 'feature' AS feature, feature AS value FROM rp UNION ALL SELECT id, 'second', CASE status WHEN 'F' THEN 0.0 WHEN 'O' THEN balance END FROM rp)
        SELECT id, feature, value, CASE WHEN value IS NULL THEN 'unavailable' WHEN value = 0 THEN 'ok_zero' ELSE 'ok_positive' END AS status FROM l""",
    "model_interface": f"WITH {REPEATS} SELECT id, feature, feature IS NOT NULL AS feature__available, CASE WHEN status = 'O' THEN balance END AS second, status = 'O' AND balance IS NOT NULL AS second__available FROM rp",
    "feature_summary": f"""WITH {REPEATS}, l AS (SELECT 'feature' AS feature, feature AS v FROM rp UNION ALL SELECT 'second', CASE WHEN status = 'O' THEN greatest(balance, 0.0::DOUBLE) END FROM rp)
        SELECT feature, count(*) AS rows, count(v) AS available, count(*) FILTER (WHERE v = 0) AS zeros, count(*) FILTER (WHERE v > 0) AS positives, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3,
        round(quantile_cont(CASE WHEN v > 0 THEN v END, 0.5), 6) AS positive_median, round(min(v), 6) AS least, round(max(v), 6) AS most FROM l GROUP BY feature""",
    "family_index": f"""WITH {RATINGS}, s AS (SELECT item, CASE WHEN rater = 'view' THEN 1 - s ELSE s END AS s FROM (SELECT item, rater, (rank() OVER (PARTITION BY rater ORDER BY score) + (count(*) OVER (PARTITION BY rater, score) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER (PARTITION BY rater) - 1) AS s FROM rt WHERE rater IN ('click', 'view', 'error')))
        SELECT i.item, count(s) AS available, round(CASE WHEN count(s) >= 2 THEN quantile_cont(s, 0.5) END, 6) AS family_index FROM (SELECT DISTINCT item FROM rt) i LEFT JOIN s ON i.item = s.item GROUP BY i.item""",
    "rating_matrix": f"WITH {RATINGS} SELECT item, " + ", ".join(f"max(rating) FILTER (WHERE rater = '{r}') AS {r}" for r in ("click", "error", "purchase", "signup", "view")) + " FROM rt GROUP BY item",
    "support_tiers": f"WITH {FRAMES} SELECT rec, count(*) AS n, CASE WHEN count(*) >= 75 THEN 'high' WHEN count(*) >= 60 THEN 'moderate' WHEN count(*) >= 50 THEN 'low' ELSE 'insufficient' END AS tier FROM fr GROUP BY rec",
    "loso_references": f"WITH {_SPECTRA}, {_LOSO} SELECT task, excluded, bin, round(reference, 6) AS reference, subjects FROM ls",
    "relative_features": f"""WITH {_SPECTRA}, {_LOSO}, d AS (SELECT id, power - reference AS d FROM sp JOIN ls ON sp.task = ls.task AND sp.subject = ls.excluded AND sp.bin = ls.bin)
        SELECT id, count(d) AS bins, round(sqrt(avg(d * d)), 6) AS rms_distance, round(avg(greatest(d, 0)), 6) AS excess, round(avg(greatest(-d, 0)), 6) AS deficit FROM d GROUP BY id""",
    "reference_inventory": f"""WITH {_SPECTRA}, m AS (SELECT DISTINCT task, subject, id FROM sp), p AS (SELECT task, count(DISTINCT subject) AS s, count(*) AS r FROM m GROUP BY 1), o AS (SELECT task, subject, count(*) AS own FROM m GROUP BY 1, 2)
        SELECT o.task, o.subject AS excluded, s - 1 AS subjects, r - own AS recordings FROM o JOIN p ON o.task = p.task""",
}
