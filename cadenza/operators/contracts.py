"""Contracts on interval tables and tables of ids: one view and profile, identities, sets that must agree, named checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import as_bool
from .cohort import fail_when


def one_view(intervals: DataFrame, view: str, profile: str, key: str = "rec", eligible: str | None = None, decision: str | None = None) -> DataFrame:
    """Intervals of one view and profile, of eligible rows decided KEEP only; views are never pooled."""
    out = intervals.where((F.col("view") == view) & (F.col("profile") == profile))
    if eligible:
        out = out.where(as_bool(F.col(eligible)))
    if decision:
        out = out.where(F.upper(F.trim(F.col(decision))) == "KEEP")
    return out


def interval_faults(intervals: DataFrame, key: str = "rec", index: str = "interval_index", slack: float = 1e-9) -> DataFrame:
    """key, index, fault: repeated identities, lengths that are not positive, overlap with an interval before."""
    ordered = Window.partitionBy(key).orderBy("start", "end", index)
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    seen = F.count(F.lit(1)).over(Window.partitionBy(key, index))
    rows = intervals.withColumns({"__seen": seen, "__before": before})
    faults = F.array(F.when(F.col("__seen") > 1, "identity_repeated"), F.when(F.col("end") <= F.col("start"), "not_positive"), F.when(F.col("start") < F.col("__before") - slack, "overlaps"))
    return rows.select(key, index, F.explode(F.array_compact(faults)).alias("fault"))


def faultless(intervals: DataFrame, key: str = "rec", index: str = "interval_index") -> DataFrame:
    """intervals; its plan fails at the first row that interval_faults would name."""
    ordered = Window.partitionBy(key).orderBy("start", "end", index)
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumns({"__n": F.count(F.lit(1)).over(Window.partitionBy(key, index)), "__before": before})
    rows = fail_when(rows, F.col("__n") > 1, "an interval's identity is repeated")
    rows = fail_when(rows, F.col("end") <= F.col("start"), "an interval's length is not positive")
    return fail_when(rows, F.col("start") < F.col("__before") - 1e-9, "intervals overlap").drop("__n", "__before")


def view_contract(decided: DataFrame, intervals: DataFrame, profile: str, views: dict[str, bool], key: str = "rec") -> DataFrame:
    """A row for each view: recordings and intervals it has, eligible recordings, those missing and those too many, and
    whether the ids are the eligible ones (views that need every recording) or among them."""
    wanted = decided.where("eligible").select(key).distinct().withColumn("__wanted", F.lit(1))
    rows = intervals.where((F.col("profile") == profile) & F.col("view").isin(*views))
    held = rows.groupBy("view", key).agg(F.count(F.lit(1)).alias("__n"))
    both = held.join(wanted, key, "left").groupBy("view").agg(F.count(F.lit(1)).alias("recordings"), F.sum("__n").alias("intervals"), F.count("__wanted").alias("__hit"))
    total = wanted.agg(F.count(F.lit(1)).alias("eligible_recordings"))
    spark = decided.sparkSession
    every = spark.createDataFrame(list(views.items()), "view string, every_recording boolean")
    out = every.join(both, "view", "left").join(F.broadcast(total)).fillna(0, ["recordings", "intervals", "__hit"])
    missing, extra = F.col("eligible_recordings") - F.col("__hit"), F.col("recordings") - F.col("__hit")
    passed = (extra == 0) & (~F.col("every_recording") | (missing == 0))
    return out.select("view", "every_recording", "recordings", "intervals", "eligible_recordings", missing.alias("missing"), extra.alias("extra"), passed.alias("contract_pass"))


def with_frozen_identity(ledger: DataFrame, frozen: DataFrame, view: str, profile: str, key: str = "rec", index: str = "interval_index") -> DataFrame:
    """ledger, whose index counts the intervals of a recording in order of time, with the frozen identity and bounds of
    each. Fails at rows without one."""
    local = F.row_number().over(Window.partitionBy(key).orderBy("start", "end", index)) - 1
    named = frozen.select(key, local.alias("__i"), F.col(index).alias("frozen_index"), F.col("start").alias("frozen_start"), F.col("end").alias("frozen_end"))
    out = ledger.join(named.withColumnRenamed(key, "__key"), (F.col(key) == F.col("__key")) & (F.col(index) == F.col("__i")), "left").drop("__key", "__i")
    out = fail_when(out, F.col("frozen_index").isNull(), "a ledger row has no frozen interval")
    return out.withColumns({"frozen_view": F.lit(view), "frozen_profile": F.lit(profile)})


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: ids in both tables, only left, only right, and whether the sets are equal."""
    a, b = left.select(*keys).distinct().withColumn("__l", F.lit(1)), right.select(*keys).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, keys, "full_outer")
    counts = both.agg(F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("shared"), F.count_if(F.col("__r").isNull()).alias("left_only"), F.count_if(F.col("__l").isNull()).alias("right_only"))
    return counts.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def checks(df: DataFrame, named: dict[str, tuple[Column, bool]]) -> DataFrame:
    """check, blocking, passed: named conditions over aggregates of df, in one pass; NULL does not pass."""
    parts = [F.struct(F.lit(n).alias("check"), F.lit(b).alias("blocking"), F.coalesce(c, F.lit(False)).alias("passed")) for n, (c, b) in named.items()]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("x")).select("x.*")


def gate_passed(table: DataFrame) -> DataFrame:
    """One row: whether all blocking checks pass, how many checks there are and how many fail."""
    return table.agg(F.coalesce(F.bool_and(~F.col("blocking") | F.col("passed")), F.lit(True)).alias("gate_passed"), F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Frames one below another by column name; columns that one lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
