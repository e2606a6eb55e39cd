"""Data-quality rules as named predicates, the issue ledger they fill, its dispositions and the gates they decide."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where `broken` is true; `value` is what the ledger shows of it."""

    name: str
    severity: str
    column: str
    broken: Column
    value: Column


def required(column: str, severity: str = "error") -> Rule:
    c = F.col(column)
    return Rule("required_value_missing", severity, column, c.isNull() | (F.trim(c.cast("string")) == ""), c)


def in_range(column: str, low: float, high: float, severity: str = "warning") -> Rule:
    c = F.col(column)
    return Rule("value_out_of_range", severity, column, ~c.between(low, high), c)


def sentinel(column: str, values: tuple = (999, 9999, -999)) -> Rule:
    return Rule("sentinel_value", "warning", column, F.col(column).isin(*values), F.col(column))


def one_of(column: str, words: tuple[str, ...]) -> Rule:
    c = F.col(column)
    return Rule("value_not_allowed", "error", column, c.isNotNull() & ~F.upper(F.trim(c)).isin(*words), c)


def matches(column: str, pattern: str, name: str = "unparseable") -> Rule:
    c = F.col(column)
    return Rule(name, "error", column, c.isNotNull() & ~c.rlike(pattern), c)


def ordered(first: str, then: str) -> Rule:
    return Rule("chronology_failure", "error", first, F.col(first) > F.col(then), F.col(first))


def within_days(first: str, then: str, days: int) -> Rule:
    return Rule("outside_window", "warning", first, F.abs(F.datediff(then, first)) > days, F.col(first))


def issues(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """key, rule, severity, column, value: a row for each broken rule, from one scan that tests all rules."""
    found = F.array(*[F.when(r.broken, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.column).alias("column"), r.value.cast("string").alias("value"))) for r in rules])
    return df.select(key, F.explode(F.array_compact(found)).alias("i")).select(key, "i.rule", "i.severity", "i.column", "i.value")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def static_conflicts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """key, column, distinct non-null values, where a column that should be constant within the key is not. Cells are
    unpivoted once and each distinct value is one row before it is counted."""
    cells = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(keys, columns, "column", "value")
    distinct = cells.where("value IS NOT NULL").groupBy(*keys, "column", "value").agg(F.lit(1).alias("one"))
    return distinct.groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("distinct_values")).where("distinct_values > 1")


def spread_conflicts(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    out = df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("spread"))
    return out.where(F.col("spread") > tolerance)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, nulls, distinct values, share that is numeric, smallest and largest as text. Plain figures come
    from one scan; values are unpivoted and counted once for the distinct ones."""
    parts = []
    for c in columns:
        x = F.col(c)
        parts.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(x.isNull()).alias("nulls"), F.avg(F.when(x.isNotNull(), x.cast("string").try_cast("double").isNotNull().cast("double"))).alias("numeric_fraction"), F.min(x).cast("string").alias("smallest"), F.max(x).cast("string").alias("largest")))
    plain = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("x")).select("x.*")
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value IS NOT NULL")
    distinct = cells.groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    out = plain.join(distinct, "column", "left").fillna(0, ["distinct_values"])
    return out.select("column", "rows", "nulls", "distinct_values", "numeric_fraction", "smallest", "largest")


def canonical(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must end in a unique column."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def dispositions(ledger: DataFrame, table: dict[str, str], default: str = "exclude") -> DataFrame:
    """The ledger with what its rules mean for analysis; rules without an entry exclude."""
    chosen = reduce(lambda acc, kv: F.when(F.col("rule") == kv[0], kv[1]).otherwise(acc), table.items(), F.lit(default))
    return ledger.withColumn("disposition", chosen)


def gates(df: DataFrame, key: str, ledger: DataFrame) -> DataFrame:
    """df with eligible and the reasons against, sorted, from a ledger with dispositions."""
    against = ledger.where("disposition = 'exclude'").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("rule")), "|").alias("reasons"))
    return df.join(against, key, "left").withColumn("eligible", F.col("reasons").isNull()).withColumn("reasons", F.coalesce("reasons", F.lit("eligible")))


def reason_list(predicates: dict[str, Column], accepted: str = "accepted") -> Column:
    """Names of the failed predicates in their order, joined by |; NULL counts as failed."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in predicates.items()]))
    return F.when(F.size(names) == 0, F.lit(accepted)).otherwise(F.array_join(names, "|"))


def layered(sources: list[tuple[str, Column]], missing: str = "unresolved") -> tuple[Column, Column]:
    """The first non-null of several sources and the name of the one it came from."""
    value = F.coalesce(*[c for _, c in sources])
    origin = reduce(lambda acc, s: F.when(s[1].isNotNull(), s[0]).otherwise(acc), reversed(sources), F.lit(missing))
    return value, origin


def totals(df: DataFrame, role: str, group: str, measures: list[Column]) -> DataFrame:
    """Measures per role and group with a row ALL for each role and for everything."""
    out = df.rollup(role, group).agg(F.grouping_id().alias("__g"), *measures)
    return out.withColumns({role: F.when(F.col("__g") == 3, "ALL").otherwise(F.col(role).cast("string")), group: F.when(F.col("__g") >= 1, "ALL").otherwise(F.col(group).cast("string"))}).drop("__g")


def flow(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows left after each stage of conditions applied in order."""
    held, parts = F.lit(True), []
    for name, condition in stages.items():
        held = held & F.coalesce(condition, F.lit(False))
        parts.append(F.struct(F.lit(name).alias("stage"), F.count_if(held).alias("remaining")))
    return df.agg(F.array(*parts).alias("p")).select(F.posexplode("p").alias("position", "x")).select("position", "x.*")


def unparseable_date(column: str, formats: tuple[str, ...] = ("yyyy-MM-dd",)) -> Rule:
    """Text is there, but no format reads it as a date."""
    c = F.col(column).cast("string")
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
    return Rule("date_unparseable", "error", column, (F.trim(c) != "") & parsed.isNull(), c)


def differs(column: str, other: Column, name: str) -> Rule:
    """Both are there and differ as upper-case text."""
    text = lambda c: F.nullif(F.upper(F.trim(c.cast("string"))), F.lit(""))
    return Rule(name, "error", column, text(F.col(column)) != text(other), F.col(column))


def differs_as_number(column: str, other: Column, name: str) -> Rule:
    """Both are there and differ as numbers where they are numbers, else as text."""
    text = lambda c: F.coalesce(c.cast("string").try_cast("double").cast("string"), F.nullif(F.trim(c.cast("string")), F.lit("")))
    return Rule(name, "error", column, text(F.col(column)) != text(other), F.col(column))


def task_mismatch(column: str, parsed: Column, labels: dict[str, bool]) -> Rule:
    """The parsed task names none of the labels that the column names; labels: whether the column need only contain it."""
    said, own = F.upper(F.col(column).cast("string")), F.upper(parsed.cast("string"))
    agree = reduce(lambda a, b: a | b, [own.contains(n) & (said.contains(n) if part else said == n) for n, part in labels.items()])
    return Rule("filename_task_mismatch", "error", column, parsed.isNotNull() & ~F.coalesce(agree, F.lit(False)), F.col(column))


def fullmatch_any(x: Column, patterns: list[str]) -> Column:
    """Whether the whole text matches one of the patterns, in any case; NULL does not."""
    return F.coalesce(x.rlike("(?i)^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"), F.lit(False)) if patterns else F.lit(False)


def diagnosis_rules(column: str, subject: str, patterns: list[str]) -> list[Rule]:
    """A missing diagnosis is a candidate for control where the id begins like a control's, else unresolved."""
    begins = F.coalesce(F.col(subject).rlike("(?i)^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"), F.lit(False))
    missing, shown = F.nullif(F.trim(F.col(column)), F.lit("")).isNull(), F.col(subject)
    return [Rule("diagnosis_control_id_candidate", "review", column, missing & begins, shown), Rule("diagnosis_missing_unresolved", "error", column, missing & ~begins, shown)]


def adjudication_template(df: DataFrame, subject: str, reported: str, confirmed: list[str], suffix: str) -> DataFrame:
    """One row for each subject without a reported value that no confirmed pattern covers, with what to do about it."""
    first = df.groupBy(subject).agg(F.max(F.nullif(F.trim(reported), F.lit(""))).alias("__r"))
    left = first.where(F.col("__r").isNull() & ~fullmatch_any(F.col(subject), confirmed)).select(subject)
    advice = F.when(fullmatch_any(F.col(subject), [suffix]), "verify_suffix").otherwise("verify_or_exclude")
    return left.withColumns({"decision": F.lit(""), "evidence": F.lit(""), "recommended_review": advice})


def reconciled(left: DataFrame, right: DataFrame, combined: DataFrame, key: str) -> DataFrame:
    """One row: ids of two tables shared and alone, and how many of them the combined table lacks or has beyond them."""
    a, b, c = (d.select(key).distinct().withColumn(n, F.lit(True)) for d, n in ((left, "a"), (right, "b"), (combined, "c")))
    x, y, z = (F.coalesce(F.col(n), F.lit(False)) for n in "abc")
    counts = {"shared": x & y, "left_only": x & ~y, "right_only": y & ~x, "not_combined": (x | y) & ~z, "combined_only": z & ~x & ~y}
    return a.join(b, key, "full_outer").join(c, key, "full_outer").agg(*[F.count_if(v).alias(n) for n, v in counts.items()])


def native_consistency(files: DataFrame, metadata: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key, rule: what a probed file says against its metadata: probe and decode failures, sample rate, duration."""
    rows = files.join(metadata, key, "left")
    rules = [
        Rule("probe_failed", "error", "probe_ok", ~F.coalesce("probe_ok", F.lit(False)), F.col("probe_ok")),
        Rule("decode_failed", "error", "decode_ok", F.coalesce("probe_ok", F.lit(False)) & ~F.coalesce("decode_ok", F.lit(False)), F.col("decode_ok")),
        Rule("native_rate_mismatch", "error", "rate", F.col("rate") != F.col("stated_rate"), F.col("rate")),
        Rule("native_duration_mismatch", "error", "duration", F.abs(F.col("duration") - F.col("stated_duration")) > tolerance, F.col("duration")),
    ]
    return issues(rows, key, rules)


def media_gate(rows: DataFrame, files: DataFrame, key: str, name: str, kind: str, preference: tuple[str, ...]) -> DataFrame:
    """For each key the file that is there once, probes and decodes, the preferred kind first: name, kind, paths,
    eligible, reason. rows: key, name, kind; files: name, path, probe_ok, decode_ok."""
    ok = lambda c: F.bool_and(F.coalesce(F.col(c), F.lit(False)))
    found = files.groupBy(name).agg(F.count(F.lit(1)).alias("paths"), ok("probe_ok").alias("probe_ok"), ok("decode_ok").alias("decode_ok"))
    joined = rows.select(key, name, kind).distinct().join(found, name, "left").fillna({"paths": 0, "probe_ok": False, "decode_ok": False})
    eligible = (F.col("paths") == 1) & F.col("probe_ok") & F.col("decode_ok")
    rank = reduce(lambda acc, p: F.when(F.lower(kind) == p[1], p[0]).otherwise(acc), enumerate(preference), F.lit(len(preference) + 1))
    reason = F.when(F.col("paths") == 0, "missing").when(F.col("paths") > 1, "several_paths").when(~F.col("probe_ok"), "probe_failed").when(~F.col("decode_ok"), "decode_failed").otherwise("included")
    best = canonical(joined.withColumns({"eligible": eligible, "reason": reason}), [key], [F.col("eligible").desc(), rank, F.col(name)])
    return best.select(key, name, kind, "paths", "eligible", "reason")


def one_rater_each(ratings: DataFrame, item: str, rater: str, expected: list[str]) -> DataFrame:
    """One row on a design in which each item has one rater: items, raters, items with several, raters not expected."""
    per = ratings.groupBy(item).agg(F.countDistinct(rater).alias("__n"))
    shape = per.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("__n") > 1).alias("items_with_several"))
    names = ratings.agg(F.countDistinct(rater).alias("raters"), F.countDistinct(F.when(~F.col(rater).isin(*expected), F.col(rater))).alias("unexpected_raters"))
    return shape.join(F.broadcast(names)).withColumn("valid", (F.col("items_with_several") == 0) & (F.col("unexpected_raters") == 0))


def broad_labels(df: DataFrame, key: str, columns: dict[str, bool]) -> DataFrame:
    """key, label, present, direction: yes/no columns in long form; columns that say "without" are turned round."""
    long = df.select(key, *[F.lower(F.trim(c)).alias(c) for c in columns]).unpivot(key, list(columns), "label", "answer")
    turned = reduce(lambda acc, kv: F.when(F.col("label") == kv[0], F.lit(kv[1])).otherwise(acc), columns.items(), F.lit(False))
    said = F.when(F.col("answer").isin("yes", "y", "true", "1"), True).when(F.col("answer").isin("no", "n", "false", "0"), False)
    return long.select(key, "label", F.when(turned, ~said).otherwise(said).alias("present"), F.when(turned, "turned").otherwise("as_said").alias("direction"))


def audit_summary(ledger: DataFrame, key: str) -> DataFrame:
    """rule, severity, issues and the rows they touch, the most frequent first where it is shown."""
    return ledger.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct(key).alias("rows"))
