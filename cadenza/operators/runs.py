"""Runs, rolling frames and thresholds along an ordered series of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: list[str], flag: Column, least: int = 1) -> DataFrame:
    """Maximal runs of rows where flag holds: first and last row number from 0, their length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, *order, F.coalesce(flag, F.lit(False)).alias("__f")).withColumn("__i", F.row_number().over(w) - 1)
    rows = rows.withColumn("__run", F.sum(F.when(F.col("__f") & ~F.coalesce(F.lag("__f").over(w), F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.where("__f").groupBy(*keys, "__run").agg(F.min("__i").alias("first"), F.max("__i").alias("last"), F.count(F.lit(1)).alias("length"))
    return out.where(F.col("length") >= least).drop("__run")


def first_sustained(df: DataFrame, keys: list[str], order: list[str], flag: Column, k: int = 3) -> DataFrame:
    """The number of the first row from which flag holds k times in a row; NULL where it never does."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, *order, F.coalesce(flag, F.lit(False)).cast("int").alias("__f")).withColumn("__i", F.row_number().over(w) - 1)
    ahead = w.rowsBetween(0, k - 1)
    hit = (F.min("__f").over(ahead) == 1) & (F.count(F.lit(1)).over(ahead) == k)
    return rows.withColumn("__hit", hit).groupBy(*keys).agg(F.min(F.when(F.col("__hit"), F.col("__i"))).alias("first_index"))


def steps(df: DataFrame, keys: list[str], segment: str, order: list[str], value: str, threshold: float) -> DataFrame:
    """Changes of at least threshold between neighbours of one segment: pairs compared, steps, their rate."""
    w = Window.partitionBy(*keys, segment).orderBy(*order)
    diff = F.abs(F.col(value) - F.lag(value).over(w))
    rows = df.withColumn("__d", diff)
    return rows.groupBy(*keys).agg(F.count("__d").alias("pairs"), F.count_if(F.col("__d") >= threshold).alias("steps")).withColumn("rate", F.when(F.col("pairs") > 0, F.col("steps") / F.col("pairs")))


def rolling(df: DataFrame, keys: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """Sum of the last k rows, NULL until there are k."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - k, 0)
    return df.withColumn("rolling_sum", F.when(F.count(F.lit(1)).over(w) == k, F.sum(value).over(w)))


def context_maxima(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """The largest value among the n rows before and the n after."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"before_max": F.max(value).over(w.rowsBetween(-n, -1)), "after_max": F.max(value).over(w.rowsBetween(1, n))})


def nonincreasing(df: DataFrame, keys: list[str], k: str, value: str) -> DataFrame:
    """The least non-increasing curve over k that is nowhere below value."""
    w = Window.partitionBy(*keys).orderBy(F.desc(k)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("conservative", F.max(value).over(w))


def rolloff(df: DataFrame, keys: list[str], axis: str, power: str, share: float = 0.95) -> DataFrame:
    """Where the running sum of power along axis reaches share of its total, linear between neighbours."""
    w = Window.partitionBy(*keys).orderBy(axis)
    rows = df.withColumn("__c", F.sum(power).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__t", F.sum(power).over(Window.partitionBy(*keys)))
    rows = rows.withColumns({"__pc": F.lag("__c").over(w), "__pa": F.lag(axis).over(w)}).where(F.col("__c") >= share * F.col("__t"))
    at = F.when(F.col("__pc").isNull() | (F.col("__c") == F.col("__pc")), F.col(axis).cast("double")).otherwise(F.col("__pa") + (F.col(axis) - F.col("__pa")) * (share * F.col("__t") - F.col("__pc")) / (F.col("__c") - F.col("__pc")))
    return rows.withColumn("__at", at).groupBy(*keys).agg(F.min_by("__at", axis).alias("rolloff"))


def level_clusters(df: DataFrame, keys: list[str], level: str, tolerance: Column | float) -> DataFrame:
    """Cluster number of sorted levels: a new one where a level lies more than the larger of both tolerances above the last."""
    w = Window.partitionBy(*keys).orderBy(level)
    tol = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    rows = df.withColumn("__tol", tol)
    far = F.col(level) - F.lag(level).over(w) > F.greatest(F.col("__tol"), F.lag("__tol").over(w))
    rows = rows.withColumn("__new", F.when(far | F.lag(level).over(w).isNull(), 1).otherwise(0))
    return rows.withColumn("cluster", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("__new", "__tol")


def segment_roles(df: DataFrame, keys: list[str], order: list[str], speech: Column) -> DataFrame:
    """speech, or leading, trailing or internal for what is not."""
    w = Window.partitionBy(*keys)
    n = F.row_number().over(w.orderBy(*order))
    rows = df.withColumns({"__n": n, "__all": F.count(F.lit(1)).over(w)})
    return rows.withColumn("role", F.when(speech, "speech").when(F.col("__n") == 1, "leading").when(F.col("__n") == F.col("__all"), "trailing").otherwise("internal")).drop("__n", "__all")
