"""Leave-one-subject-out references of spectra and features relative to them, over long rows (id, task, subject, bin, power)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def subject_medians(long: DataFrame) -> DataFrame:
    """task, subject, bin, power: each subject counts once, whatever its recordings."""
    return long.groupBy("task", "subject", "bin").agg(F.percentile("power", 0.5).alias("power"))


def loso_references(long: DataFrame, least_subjects: int = 5) -> DataFrame:
    """task, excluded, bin, reference, subjects: median over the other subjects of their medians.

    The values of a (task, bin) are numbered once in order; the median without one of them is read off the ranks, so no
    subject meets another and the plan grows with subjects, not with their square."""
    med = subject_medians(long)
    w = Window.partitionBy("task", "bin").orderBy("power", "subject")
    ranked = med.withColumns({"__r": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy("task", "bin"))})
    # Of the n - 1 left in order, the middle ones have these ranks among all, moved up by one at or past the excluded.
    left = F.col("__n") - 1
    lo, hi = F.floor((left + 1) / 2).cast("int"), F.floor((left + 2) / 2).cast("int")
    ranked = ranked.withColumns({"__lo": lo, "__hi": hi})
    middle = [F.max(F.when(F.col("__r") == F.col(k) + d, F.col("power"))).alias(f"{k}{d}") for k in ("__lo", "__hi") for d in (0, 1)]
    rows = ranked.join(ranked.groupBy("task", "bin").agg(*middle), ["task", "bin"])
    at = lambda k: F.when(F.col(k) >= F.col("__r"), F.col(f"{k}1")).otherwise(F.col(f"{k}0"))
    rows = rows.withColumns({"__a": at("__lo"), "__b": at("__hi")})
    return rows.select("task", F.col("subject").alias("excluded"), "bin", F.when(left >= least_subjects, (F.col("__a") + F.col("__b")) / 2).alias("reference"), left.alias("subjects"))


def relative_features(long: DataFrame, references: DataFrame) -> DataFrame:
    """Per recording: RMS difference to its subject's reference over bins, and its positive and negative parts."""
    rows = long.join(references.withColumnRenamed("excluded", "subject"), ["task", "subject", "bin"])
    d = F.col("power") - F.col("reference")
    return rows.groupBy("id").agg(F.count(d).alias("bins"), F.sqrt(F.avg(d * d)).alias("rms_distance"), F.avg(F.greatest(d, F.lit(0.0))).alias("excess"), F.avg(F.greatest(-d, F.lit(0.0))).alias("deficit"))


def reference_inventory(long: DataFrame) -> DataFrame:
    """Members of each reference: subjects and recordings left, and a hash of who they are."""
    members = long.select("task", "subject", "id").distinct()
    per = members.groupBy("task").agg(F.countDistinct("subject").alias("__s"), F.count(F.lit(1)).alias("__r"))
    own = members.groupBy("task", "subject").agg(F.count(F.lit(1)).alias("__own"))
    return own.join(F.broadcast(per), "task").select("task", F.col("subject").alias("excluded"), (F.col("__s") - 1).alias("subjects"), (F.col("__r") - F.col("__own")).alias("recordings"))
