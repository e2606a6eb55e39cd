"""Cohort governance: adjudication of segmentation, frozen intervals with manual overrides, resolved diagnoses, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals


def fail_when(df: DataFrame, broken: Column, message: str) -> DataFrame:
    """df, whose plan fails at the first row where broken holds."""
    return df.where(F.when(F.coalesce(broken, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def resolve(df: DataFrame, manual: DataFrame, key: str, reported: str, allowed: list[str], control: Column | None = None) -> DataFrame:
    """df with resolved and origin: what was reported, else the manual decision, else the control rule. A manual decision
    may not contradict a reported value nor name one outside `allowed`."""
    m = manual.select(F.col(key), F.upper(F.trim(F.col(reported))).alias("__manual"))
    rows = df.join(m, key, "left").withColumn("__given", F.upper(F.trim(F.col(reported))))
    rows = fail_when(rows, F.col("__manual").isNotNull() & ~F.col("__manual").isin(*allowed), "a manual decision names a value that is not allowed")
    rows = fail_when(rows, F.col("__manual").isNotNull() & F.col("__given").isin(*allowed) & (F.col("__manual") != F.col("__given")), "a manual decision contradicts a reported value")
    known = F.when(F.col("__given").isin(*allowed), F.col("__given"))
    rule = F.when(control, "CONTROL") if control is not None else F.lit(None).cast("string")
    origin = F.when(known.isNotNull(), "reported").when(F.col("__manual").isNotNull(), "manual").when(rule.isNotNull(), "rule").otherwise("unresolved")
    return rows.withColumns({"resolved": F.coalesce(known, F.col("__manual"), rule), "origin": origin}).drop("__manual", "__given")


def adjudication_sheet(summary: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """The review sheet: what each recording was flagged for, a decision prefilled only where nothing was."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]))
    return summary.select(key, F.array_join(reasons, "|").alias("review_reasons"), (F.size(reasons) > 0).alias("review_required"), F.when(F.size(reasons) == 0, "KEEP").otherwise("").alias("decision"))


def apply_adjudication(summary: DataFrame, sheet: DataFrame, key: str, decisions: tuple[str, ...] = ("KEEP", "EXCLUDE", "MANUAL")) -> DataFrame:
    """summary with decision and eligible. Fails on rows for unknown or missing recordings, repeated rows and decisions
    that are open or unknown."""
    s = sheet.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.upper(F.trim(F.first("decision"))).alias("decision"))
    both = summary.withColumn("__l", F.lit(True)).join(s, key, "full_outer")
    both = fail_when(both, F.col("__l").isNull(), "the sheet has a recording that the summary has not")
    both = fail_when(both, F.col("__n").isNull(), "a recording is missing from the sheet")
    both = fail_when(both, F.col("__n") > 1, "the sheet repeats a recording")
    both = fail_when(both, ~F.col("decision").isin(*decisions), "a decision is open or unknown")
    return both.withColumn("eligible", F.col("decision") != "EXCLUDE").drop("__l", "__n")


def validated_overrides(overrides: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """Manual intervals (key, idx, start, end); fails unless numbered from 0 in order, apart and within the duration."""
    w = Window.partitionBy(key).orderBy("idx")
    rows = overrides.join(durations.select(key, "duration"), key, "left").withColumns({"__i": F.row_number().over(w) - 1, "__prev": F.lag("end").over(w)})
    rows = fail_when(rows, F.col("idx") != F.col("__i"), "manual intervals are not numbered in order")
    rows = fail_when(rows, (F.col("end") <= F.col("start")) | (F.col("start") < F.col("__prev")), "manual intervals are empty or overlap")
    rows = fail_when(rows, F.col("duration").isNull() | (F.col("start") < 0) | (F.col("end") > F.col("duration")), "a manual interval lies outside its recording")
    return rows.drop("__i", "__prev", "duration")


def frozen_intervals(views: DataFrame, decided: DataFrame, overrides: DataFrame, key: str, speech_edge: float, pause_edge: float) -> DataFrame:
    """Views of eligible recordings; where the decision is MANUAL they are built anew from the manual intervals."""
    manual = decided.where("decision = 'MANUAL'").select(key)
    speech = overrides.join(manual, key, "left_semi").select(key, "start", "end")
    rebuilt = {"primary_speech": speech, "strict_speech": intervals.eroded(speech, speech_edge), "strict_internal_nonspeech": intervals.eroded(intervals.gaps(speech, [key]), pause_edge)}
    out = views.join(manual, key, "left_anti").select(key, "view", "start", "end").withColumn("source", F.lit("detected"))
    for view, rows in rebuilt.items():
        out = out.unionByName(rows.select(key, F.lit(view).alias("view"), "start", "end").withColumn("source", F.lit("manual")))
    out = out.join(decided.where("eligible").select(key), key, "left_semi")
    return out.withColumn("interval_index", F.row_number().over(Window.partitionBy(key, "view").orderBy("start")) - 1)


def assembled(metadata: DataFrame, segmentation: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """One row a metadata recording with its segmentation and features, flags of what is there, and analysis_eligible."""
    s = segmentation.withColumn("has_segmentation", F.lit(True))
    f = features.withColumn("has_features", F.lit(True))
    out = metadata.join(s, key, "left").join(f, key, "left").fillna(False, ["has_segmentation", "has_features"])
    return out.withColumn("analysis_eligible", F.coalesce(F.col("eligible"), F.lit(False)) & F.col("has_segmentation") & F.col("has_features"))
