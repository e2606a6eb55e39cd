"""Metadata rules, interval contracts, file gates and named checks with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import audit, contracts
from .base import INTERVALS, REPEATS, intervals, ratings, repeats, table

HOUR = 3_600_000_000
#: Recording metadata over orders: a file name with its parts, and columns that now and then contradict it.
_MD = """SELECT o_orderkey AS id, 'S' || o_custkey AS subject, 'P' || (o_orderkey % 4) AS protocol, CAST(o_orderkey % 3 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS STRING) AS iteration,
    CASE WHEN o_orderkey % 5 = 0 THEN 'REST' WHEN o_orderkey % 2 = 0 THEN 'Bamboo passage' ELSE 'REST' END AS task, CASE WHEN o_orderkey % 23 = 0 THEN 'mp4' ELSE 'wav' END AS suffix,
    CASE WHEN o_orderkey % 17 = 0 THEN 'unknown' ELSE '1960-02-01' END AS birth, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS diagnosis, {day} AS recorded,
    'S' || (o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) || '_P' || (o_orderkey % 4) || '_0' || (o_orderkey % 3) || '_' || {stamp} || '_' || o_orderstatus || '_' || CASE WHEN o_orderkey % 2 = 0 THEN 'BAMBOO' ELSE 'REST' END || CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE '.WAV' END AS name FROM orders"""
_SHIFTED = "o_orderdate + INTERVAL 24 HOUR * (CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END)"
_CONTROL = ["S1", "S2"]


def _metadata(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("__orders_md")
    return spark.sql(_MD.format(day="to_date(o_orderdate)", stamp=f"date_format({_SHIFTED}, 'yyyyMMdd')").replace("FROM orders", "FROM __orders_md"))


def metadata_rule_pack(spark, sf):
    p = values.media_name_parts(F.col("name"))
    rows = _metadata(spark, sf).withColumn("p", p).withColumn("birth_date", F.try_to_date("birth", "yyyy-MM-dd"))
    rules = [
        audit.Rule("filename_unparseable", "error", "name", F.col("p.subject").isNull(), F.col("name")), audit.unparseable_date("birth"),
        *audit.diagnosis_rules("diagnosis", "subject", _CONTROL), audit.differs("subject", F.col("p.subject"), "filename_subject_mismatch"),
        audit.differs("recorded", F.col("p.date"), "filename_recording_date_mismatch"), audit.differs("suffix", F.col("p.suffix"), "filename_extension_mismatch"),
        audit.differs_as_number("iteration", F.col("p.iteration"), "filename_protocol_iteration_mismatch"), audit.differs_as_number("protocol", F.col("p.protocol"), "filename_protocol_iteration_mismatch"),
        audit.task_mismatch("task", F.col("p.task"), {"BAMBOO": True, "REST": False}), audit.ordered("birth_date", "recorded"), audit.within_days("recorded", "birth_date", 13000),
    ]
    return audit.issues(rows, "id", rules).select("id", "rule", "severity", "column")


def audit_rule_summary(spark, sf):
    return audit.audit_summary(metadata_rule_pack(spark, sf), "id")


def diagnosis_template(spark, sf):
    return audit.adjudication_template(_metadata(spark, sf).where("id % 9 = 0 OR id % 4 = 0"), "subject", "diagnosis", [r"S1\d"], r"S\d+0")


def confirmed_controls(spark, sf):
    return _metadata(spark, sf).select("id", audit.fullmatch_any(F.col("subject"), [r"s\d{2}", "S1.*5"]).alias("confirmed"))


def workbook_reconciliation(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return audit.reconciled(o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), li.select(F.col("l_suppkey").cast("long").alias("id")), "id")


def session_pairs(spark, sf):
    rows = repeats(spark, sf).withColumn("day", F.to_date("visit"))
    a, b = (rows.where(F.col("status") == s).select("subject", "day", F.col("id").alias(n)) for s, n in (("F", "first_id"), ("O", "second_id")))
    return a.join(b, ["subject", "day"]).select("subject", "first_id", "second_id")


def native_metadata(spark, sf):
    o = table(spark, sf, "orders")
    files = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 10 != 0).alias("probe_ok"), (F.col("o_orderkey") % 7 != 0).alias("decode_ok"), (F.col("o_custkey") % 5 * 1000 + 8000).alias("rate"), (F.col("o_totalprice") / 1000).alias("duration"))
    stated = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.lit(9000).alias("stated_rate"), (F.col("o_totalprice") / 1000 + F.when(F.col("o_orderkey") % 3 == 0, 0.5).otherwise(0.01)).alias("stated_duration"))
    return audit.native_consistency(files, stated, "id", 0.1).select("id", "rule", "severity", "column")


def _files(spark, sf):
    li = table(spark, sf, "lineitem")
    name = F.concat(F.lit("f"), F.col("l_orderkey"), F.when(F.col("l_linenumber") % 2 == 0, ".wav").otherwise(".webm"))
    return li.select(F.col("l_orderkey").alias("id"), name.alias("name"), F.when(F.col("l_linenumber") % 2 == 0, ".wav").otherwise(".webm").alias("kind"), F.col("l_linenumber").alias("path"), (F.col("l_quantity") > 5).alias("probe_ok"), (F.col("l_quantity") > 10).alias("decode_ok"))


def media_gate(spark, sf):
    files = _files(spark, sf)
    rows = files.select("id", "name", "kind").union(table(spark, sf, "orders").where("o_orderkey % 50 = 0").select("o_orderkey", F.concat(F.lit("g"), F.col("o_orderkey"), F.lit(".mp4")), F.lit(".mp4")))
    return audit.media_gate(rows, files.where("path < 3"), "id", "name", "kind", (".wav", ".webm", ".mp4"))


def one_rater_design(spark, sf):
    return audit.one_rater_each(ratings(spark, sf).where("item % 5 = rating OR rater = 'click'"), "item", "rater", ["click", "view", "error"])


def broad_metadata_labels(spark, sf):
    rows = repeats(spark, sf).select("id", F.when(F.col("status") == "F", "Yes").when(F.col("status") == "O", " no ").alias("noise"), F.when(F.col("priority").startswith("1"), "N").when(F.col("priority").startswith("2"), "y").alias("without_echo"))
    return audit.broad_labels(rows, "id", {"noise": False, "without_echo": True})


def _views(spark, sf):
    return intervals(spark, sf).select("rec", F.col("kind").alias("view"), F.when(F.col("id") % 10 == 0, "other").otherwise("primary").alias("profile"), F.col("id").alias("interval_index"), "start", "end", F.when(F.col("id") % 3 == 0, "yes").otherwise("True").alias("eligible"), F.when(F.col("id") % 7 == 0, "drop").otherwise(" keep").alias("decision"))


def one_view_intervals(spark, sf):
    return contracts.one_view(_views(spark, sf), "click", "primary", "rec", "eligible", "decision").select("rec", "interval_index", "start", "end")


def interval_faults(spark, sf):
    rows = _views(spark, sf).withColumn("interval_index", F.floor(F.col("interval_index") / 2)).withColumn("end", F.when(F.col("start") % 5 == 0, F.col("start")).otherwise(F.col("end")))
    return contracts.interval_faults(rows.where("view IN ('click', 'view')"))


def view_contract(spark, sf):
    decided = intervals(spark, sf).groupBy("rec").agg(F.count(F.lit(1)).alias("n")).select("rec", (F.col("n") > 50).alias("eligible"))
    rows = _views(spark, sf).where("rec % 9 <> 0 OR view <> 'signup'")
    return contracts.view_contract(decided, rows, "primary", {"click": True, "signup": False, "view": True, "none": False})


def frozen_identity(spark, sf):
    frozen = contracts.one_view(_views(spark, sf), "click", "primary")
    ledger = frozen.groupBy("rec").agg(F.count(F.lit(1)).alias("n")).select("rec", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("interval_index"))
    return contracts.with_frozen_identity(ledger, frozen.withColumn("interval_index", F.col("interval_index").cast("long")), "click", "primary")


def set_equality(spark, sf):
    return contracts.set_difference(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k")), ["k"])


def named_checks(spark, sf):
    o = table(spark, sf, "orders")
    price = F.col("o_totalprice")
    return contracts.checks(o, {"has_rows": (F.count(F.lit(1)) > 0, True), "keys_unique": (F.countDistinct("o_orderkey") == F.count(F.lit(1)), True), "no_null_price": (F.count_if(price.isNull()) == 0, True), "price_bounded": (F.max(price) < 1000, False)})


def gate_decision(spark, sf):
    return contracts.gate_passed(named_checks(spark, sf))


def union_of_frames(spark, sf):
    o = repeats(spark, sf)
    return contracts.union_all([o.where("status = 'F'").select("id", "feature"), o.where("status = 'X'").select("id"), o.where("status = 'O'").select("id", "grp")])


def decided_pairs_union(spark, sf):
    """Distinct union and intersection of two id lists: id, in_both."""
    o = repeats(spark, sf)
    a, b = o.where("status = 'F'").select("subject"), o.where("status = 'O'").select("subject")
    both = a.intersect(b).withColumn("in_both", F.lit(True))
    return a.union(b).distinct().join(both, "subject", "left").fillna(False, ["in_both"])


def any_all_first(spark, sf):
    rows = repeats(spark, sf)
    return rows.groupBy("subject").agg(F.bool_or(F.col("status") == "F").alias("any_final"), F.bool_and(F.col("feature") > 1000).alias("all_large"), F.min_by(F.when(F.col("status") == "O", F.col("priority")), F.when(F.col("status") == "O", F.col("id"))).alias("first_open"))


def id_forms(spark, sf):
    rows = _metadata(spark, sf)
    base = F.regexp_replace(F.regexp_replace("name", r"\.WAV$", ""), "^[^_]+_", "")
    rec = F.concat(F.col("subject"), F.lit("_X_"), base, F.lit("_z"))
    path = F.concat(F.lit("a\\b c\\"), F.col("name"))
    return rows.select("id", values.participant_of(rec).alias("participant"), values.acquisition_date(rec).cast("string").alias("day"), values.safe_id(path).alias("safe"), values.portable_path(path).alias("portable"), values.stable_hash(F.col("subject"), F.col("id")).alias("digest"), values.media_name_parts(F.col("name"))["task"].alias("task"))


def tolerant_scalars(spark, sf):
    rows = repeats(spark, sf)
    word = F.element_at(F.array(*map(F.lit, ["yes", " No", "PASS", "0", "maybe", "failed"])), (F.col("id") % 6 + 1).cast("int"))
    status = F.concat(F.when(F.col("id") % 2 == 0, "ok_").otherwise("unavailable_"), F.lower("status"))
    text = F.concat(F.lit("1.5, 2.5\n\n"), F.col("id") % 7, F.lit(",3\n"), F.when(F.col("id") % 2 == 0, "x,1").otherwise("4,5"))
    items = F.concat(F.lit("[['a', "), (F.col("id") % 3).cast("string"), F.lit("]]"))
    read = values.manual_intervals(text)
    return rows.select("id", values.scalar_bool(word).alias("yes"), values.status_available(status).alias("available"), F.size(read).alias("lines"), F.size(F.filter(read, lambda x: x["start"].isNotNull())).alias("valid"), values.tolerant_list(items, "array<array<string>>")[0][1].alias("item"), values.most_extreme([F.col("feature"), F.col("balance") * 50]).alias("extreme"))


def sample_forms(spark, sf):
    rows = repeats(spark, sf)
    codec = F.element_at(F.array(*map(F.lit, ["pcm_s16le", "opus", "flac", "pcm_f32le"])), (F.col("id") % 4 + 1).cast("int"))
    fmt = F.when(F.col("id") % 4 == 2, "s32").otherwise("fltp")
    bits = values.integer_bits(codec, fmt, F.when(F.col("id") % 8 == 2, "24"))
    lo, hi = values.aligned_samples(F.col("feature") / 1000, F.col("feature") / 900, F.lit(100))
    level, floor = values.alternating_levels(F.pow(F.col("feature") / 1e6, F.lit(2)) + F.when(F.col("id") % 3 == 0, 0.0).otherwise(0.01), F.col("feature") / 1e6)
    return rows.select("id", bits.alias("bits"), values.quantization_step(bits).alias("step"), lo.alias("first_sample"), hi.alias("end_sample"), F.round(values.working_set_mb(F.col("id") * 160), 6).alias("megabytes"), F.round(level, 4).alias("level"), floor.alias("at_floor"))


QUERIES = {f.__name__: f for f in (metadata_rule_pack, audit_rule_summary, diagnosis_template, confirmed_controls, workbook_reconciliation, session_pairs, native_metadata, media_gate, one_rater_design, broad_metadata_labels, one_view_intervals, interval_faults, view_contract, frozen_identity, set_equality, named_checks, gate_decision, union_of_frames, decided_pairs_union, any_all_first, id_forms, tolerant_scalars, sample_forms)}

_MDQ = "md AS (" + _MD.format(day="CAST(o_orderdate AS DATE)", stamp=f"strftime({_SHIFTED}, '%Y%m%d')").replace("AS STRING", "AS VARCHAR") + ")"
_PARTS = r"^([^_]+)_([^_]+)_([^_]+)_(\d{8})_([^_]+)_(.+)\.([A-Za-z0-9]+)$"
_PARSED = _MDQ + ", pr AS (SELECT *, " + ", ".join(f"nullif(regexp_extract(name, '{_PARTS}', {i}), '') AS p{i}" for i in (1, 2, 3, 4, 6, 7)) + " FROM md)"
_num = lambda c: f"coalesce(CAST(TRY_CAST({c} AS DOUBLE) AS VARCHAR), {c})"
_RULES = [
    ("filename_unparseable", "error", "name", "p1 IS NULL"), ("date_unparseable", "error", "birth", "birth = 'unknown'"), ("diagnosis_control_id_candidate", "review", "diagnosis", "diagnosis IS NULL AND regexp_matches(subject, '^(S1|S2)')"),
    ("diagnosis_missing_unresolved", "error", "diagnosis", "diagnosis IS NULL AND NOT regexp_matches(subject, '^(S1|S2)')"), ("filename_subject_mismatch", "error", "subject", "p1 <> subject"),
    ("filename_recording_date_mismatch", "error", "recorded", "CAST(strptime(p4, '%Y%m%d') AS DATE) <> recorded"), ("filename_extension_mismatch", "error", "suffix", "upper(p7) <> upper(suffix)"),
    ("filename_protocol_iteration_mismatch", "error", "iteration", f"{_num('p3')} <> {_num('iteration')}"), ("filename_protocol_iteration_mismatch", "error", "protocol", f"{_num('p2')} <> {_num('protocol')}"),
    ("filename_task_mismatch", "error", "task", "p6 IS NOT NULL AND NOT ((p6 LIKE '%BAMBOO%' AND upper(task) LIKE '%BAMBOO%') OR (p6 LIKE '%REST%' AND upper(task) = 'REST'))"),
    ("chronology_failure", "error", "birth_date", "TRY_CAST(birth AS DATE) > recorded"), ("outside_window", "warning", "recorded", "abs(date_diff('day', recorded, TRY_CAST(birth AS DATE))) > 13000"),
]
_PACK = _PARSED + ", pack AS (" + " UNION ALL ".join(f"""SELECT id, '{r}' AS rule, '{s}' AS severity, '{c}' AS "column" FROM pr WHERE {w}""" for r, s, c, w in _RULES) + ")"
_FILES = "fl AS (SELECT l_orderkey AS id, 'f' || l_orderkey || CASE WHEN l_linenumber % 2 = 0 THEN '.wav' ELSE '.webm' END AS name, CASE WHEN l_linenumber % 2 = 0 THEN '.wav' ELSE '.webm' END AS kind, l_linenumber AS path, l_quantity > 5 AS probe_ok, l_quantity > 10 AS decode_ok FROM lineitem)"
_VIEWS = f"""{INTERVALS}, vw AS (SELECT rec, kind AS view, CASE WHEN id % 10 = 0 THEN 'other' ELSE 'primary' END AS profile, id AS interval_index, s AS "start", e AS "end", id % 7 = 0 AS dropped FROM iv)"""
_CHECKS = """ck AS (SELECT 'has_rows' AS "check", true AS blocking, count(*) > 0 AS passed FROM orders UNION ALL SELECT 'keys_unique', true, count(DISTINCT o_orderkey) = count(*) FROM orders
    UNION ALL SELECT 'no_null_price', true, count(*) = count(o_totalprice) FROM orders UNION ALL SELECT 'price_bounded', false, max(o_totalprice) < 1000 FROM orders)"""

ORACLES = {
    "metadata_rule_pack": f"WITH {_PACK} SELECT * FROM pack",
    "audit_rule_summary": f"WITH {_PACK} SELECT rule, severity, count(*) AS issues, count(DISTINCT id) AS rows FROM pack GROUP BY 1, 2",
    "diagnosis_template": rf"""WITH {_MDQ}, f AS (SELECT subject, max(diagnosis) AS d FROM md WHERE id % 9 = 0 OR id % 4 = 0 GROUP BY 1)
        SELECT subject, '' AS decision, '' AS evidence, CASE WHEN regexp_full_match(subject, 'S\d+0') THEN 'verify_suffix' ELSE 'verify_or_exclude' END AS recommended_review FROM f WHERE d IS NULL AND NOT regexp_full_match(subject, 'S1\d')""",
    "confirmed_controls": rf"WITH {_MDQ} SELECT id, regexp_full_match(subject, 'S\d{{2}}') OR regexp_full_match(subject, 'S1.*5') AS confirmed FROM md",
    "workbook_reconciliation": """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT DISTINCT l_suppkey AS id FROM lineitem), k AS (SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM c),
        f AS (SELECT k.id IN (SELECT id FROM a) AS x, k.id IN (SELECT id FROM b) AS y, k.id IN (SELECT id FROM c) AS z FROM k)
        SELECT count_if(x AND y) AS shared, count_if(x AND NOT y) AS left_only, count_if(y AND NOT x) AS right_only, count_if((x OR y) AND NOT z) AS not_combined, count_if(z AND NOT x AND NOT y) AS combined_only FROM f""",
    "session_pairs": f"WITH {REPEATS} SELECT a.subject, a.id AS first_id, b.id AS second_id FROM rp a JOIN rp b ON a.subject = b.subject AND CAST(a.visit AS DATE) = CAST(b.visit AS DATE) AND a.status = 'F' AND b.status = 'O'",
    "native_metadata": """WITH f AS (SELECT o_orderkey AS id, o_orderkey % 10 <> 0 AS p, o_orderkey % 7 <> 0 AS d, o_custkey % 5 * 1000 + 8000 AS rate, CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0.01 END END AS off FROM orders)
        SELECT id, 'probe_failed' AS rule, 'error' AS severity, 'probe_ok' AS "column" FROM f WHERE NOT p UNION ALL SELECT id, 'decode_failed', 'error', 'decode_ok' FROM f WHERE p AND NOT d
        UNION ALL SELECT id, 'native_rate_mismatch', 'error', 'rate' FROM f WHERE off IS NOT NULL AND rate <> 9000 UNION ALL SELECT id, 'native_duration_mismatch', 'error', 'duration' FROM f WHERE off > 0.1""",
    "media_gate": f"""WITH {_FILES}, g AS (SELECT name, count(*) AS paths, bool_and(probe_ok) AS p, bool_and(decode_ok) AS d FROM fl WHERE path < 3 GROUP BY 1), r AS (SELECT id, name, kind FROM fl UNION SELECT o_orderkey, 'g' || o_orderkey || '.mp4', '.mp4' FROM orders WHERE o_orderkey % 50 = 0),
        j AS (SELECT r.id, r.name, kind, coalesce(paths, 0) AS paths, coalesce(p, false) AS p, coalesce(d, false) AS d FROM r LEFT JOIN g ON r.name = g.name), e AS (SELECT *, paths = 1 AND p AND d AS eligible, CASE WHEN paths = 0 THEN 'missing' WHEN paths > 1 THEN 'several_paths' WHEN NOT p THEN 'probe_failed' WHEN NOT d THEN 'decode_failed' ELSE 'included' END AS reason FROM j)
        SELECT id, name, kind, paths, eligible, reason FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY eligible DESC, CASE kind WHEN '.wav' THEN 0 WHEN '.webm' THEN 1 ELSE 2 END, name) AS k FROM e) WHERE k = 1""",
    "one_rater_design": """WITH rt AS (SELECT user_id AS item, event_type AS rater, CAST(quantile_cont(value, 0.5) > 35 AS INT) AS rating FROM events GROUP BY 1, 2), r AS (SELECT * FROM rt WHERE item % 5 = rating OR rater = 'click'), p AS (SELECT item, count(DISTINCT rater) AS n FROM r GROUP BY 1), a AS (SELECT count(*) AS items, count_if(n > 1) AS several FROM p),
        b AS (SELECT count(DISTINCT rater) AS raters, count(DISTINCT rater) FILTER (WHERE rater NOT IN ('click', 'view', 'error')) AS u FROM r) SELECT items, several AS items_with_several, raters, u AS unexpected_raters, several = 0 AND u = 0 AS valid FROM a, b""",
    "broad_metadata_labels": f"""WITH {REPEATS} SELECT id, 'noise' AS label, CASE status WHEN 'F' THEN true WHEN 'O' THEN false END AS present, 'as_said' AS direction FROM rp
        UNION ALL SELECT id, 'without_echo', CASE WHEN starts_with(priority, '1') THEN true WHEN starts_with(priority, '2') THEN false END, 'turned' FROM rp""",
    "one_view_intervals": f"""WITH {_VIEWS} SELECT rec, interval_index, "start", "end" FROM vw WHERE view = 'click' AND profile = 'primary' AND NOT dropped""",
    "interval_faults": f"""WITH {_VIEWS}, x AS (SELECT rec, interval_index // 2 AS interval_index, "start" AS s, CASE WHEN "start" % 5 = 0 THEN "start" ELSE "end" END AS e FROM vw WHERE view IN ('click', 'view')),
        w AS (SELECT *, count(*) OVER (PARTITION BY rec, interval_index) AS n, max(e) OVER (PARTITION BY rec ORDER BY s, e, interval_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x)
        SELECT rec, interval_index, 'identity_repeated' AS fault FROM w WHERE n > 1 UNION ALL SELECT rec, interval_index, 'not_positive' FROM w WHERE e <= s UNION ALL SELECT rec, interval_index, 'overlaps' FROM w WHERE s < b""",
    "view_contract": f"""WITH {_VIEWS}, d AS (SELECT rec FROM iv GROUP BY rec HAVING count(*) > 50), v(view, every_recording) AS (VALUES ('click', true), ('signup', false), ('view', true), ('none', false)),
        h AS (SELECT view, rec, count(*) AS n FROM vw WHERE profile = 'primary' AND (rec % 9 <> 0 OR view <> 'signup') GROUP BY 1, 2), b AS (SELECT view, count(*) AS recordings, sum(n)::BIGINT AS intervals, count(d.rec) AS hit FROM h LEFT JOIN d ON h.rec = d.rec GROUP BY 1), t AS (SELECT count(*) AS eligible_recordings FROM d)
        SELECT v.view, every_recording, coalesce(recordings, 0) AS recordings, coalesce(intervals, 0) AS intervals, eligible_recordings, eligible_recordings - coalesce(hit, 0) AS missing, coalesce(recordings - hit, 0) AS extra, coalesce(recordings - hit, 0) = 0 AND (NOT every_recording OR eligible_recordings = coalesce(hit, 0)) AS contract_pass FROM v LEFT JOIN b ON v.view = b.view, t""",
    "frozen_identity": f"""WITH {_VIEWS} SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY "start", "end", interval_index) - 1 AS interval_index, interval_index AS frozen_index, "start" AS frozen_start, "end" AS frozen_end, 'click' AS frozen_view, 'primary' AS frozen_profile FROM vw WHERE view = 'click' AND profile = 'primary'""",
    "set_equality": """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 > 0), f AS (SELECT a.k AS l, b.k AS r FROM a FULL JOIN b ON a.k = b.k)
        SELECT count_if(l IS NOT NULL AND r IS NOT NULL) AS shared, count_if(r IS NULL) AS left_only, count_if(l IS NULL) AS right_only, count_if(l IS NULL OR r IS NULL) = 0 AS equal FROM f""",
    "named_checks": f'WITH {_CHECKS} SELECT "check", blocking, passed FROM ck',
    "gate_decision": f"WITH {_CHECKS} SELECT bool_and(NOT blocking OR passed) AS gate_passed, count(*) AS checks, count_if(NOT passed) AS failed FROM ck",
    "union_of_frames": f"WITH {REPEATS} SELECT id, feature, NULL AS grp FROM rp WHERE status = 'F' UNION ALL SELECT id, NULL, grp FROM rp WHERE status = 'O'",
    "decided_pairs_union": f"WITH {REPEATS} SELECT subject, bool_or(status = 'F') AND bool_or(status = 'O') AS in_both FROM rp WHERE status IN ('F', 'O') GROUP BY 1",
    "any_all_first": f"WITH {REPEATS} SELECT subject, bool_or(status = 'F') AS any_final, bool_and(feature > 1000) AS all_large, arg_min(priority, id) FILTER (WHERE status = 'O') AS first_open FROM rp GROUP BY 1",
    "id_forms": rf"""WITH {_PARSED}, r AS (SELECT *, subject || '_X_' || regexp_replace(regexp_replace(name, '\.WAV$', ''), '^[^_]+_', '') || '_z' AS rec, 'a\b c\' || name AS path FROM pr)
        SELECT id, subject || '_X' AS participant, CAST(CAST(strptime(string_split(rec, '_')[5], '%Y%m%d') AS DATE) AS VARCHAR) AS day, regexp_replace(path, '[^A-Za-z0-9_.\-]+', '_', 'g') AS safe, replace(path, '\', '/') AS portable, sha256('["' || subject || '","' || id || '"]') AS digest, p6 AS task FROM r""",
    "tolerant_scalars": f"""WITH {REPEATS} SELECT id, id % 6 IN (0, 2) AS yes, id % 2 = 0 AS available, 3 AS lines, 1 + CAST(id % 7 < 3 AS INT) + CAST(id % 2 <> 0 AS INT) AS valid, CAST(id % 3 AS VARCHAR) AS item, greatest(abs(feature), abs(balance * 50)) AS extreme FROM rp""",
    "sample_forms": f"""WITH {REPEATS}, b AS (SELECT *, CASE id % 4 WHEN 0 THEN 16 WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN id % 8 = 2 THEN 24 END ELSE 32 END AS bits, ceil(id * 160 / 40.0) AS st FROM rp), c AS (SELECT *, greatest(1, ceil((st - 103) / 26.0) + 1) AS fr FROM b)
        SELECT id, bits, 2.0 ** (1 - bits) AS step, CAST(ceil(feature / 1000 * 100 - 1e-9::DOUBLE) AS BIGINT) AS first_sample, CAST(floor(feature / 900 * 100 + 1e-9::DOUBLE) AS BIGINT) AS end_sample, round((id * 160 + 31 * st + 184 * fr) * 20.0::DOUBLE / 1048576.0::DOUBLE, 6) AS megabytes,
        CASE WHEN id % 3 = 0 THEN -120.0::DOUBLE ELSE -20.0::DOUBLE END AS level, id % 3 = 0 AS at_floor FROM c""",
}
