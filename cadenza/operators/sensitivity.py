"""Policy grids, leave-one-out influence, variant comparison and reconstruction checks over measured features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles


def policy_availability(df: DataFrame, count: str, value: str, policies: list[int]) -> DataFrame:
    """For each minimum count: recordings, those whose value stays available, share, median of what stays."""
    parts = F.array(*[F.struct(F.lit(k).alias("minimum_count"), ((F.col(count) >= k) & F.col(value).isNotNull()).alias("ok")) for k in policies])
    rows = df.select(value, F.explode(parts).alias("p")).select(value, "p.*")
    return rows.groupBy("minimum_count").agg(F.count(F.lit(1)).alias("recordings"), F.count_if("ok").alias("available"), F.avg(F.col("ok").cast("double")).alias("fraction"), F.percentile(F.when(F.col("ok"), F.col(value)), 0.5).alias("median"))


def delete_one(df: DataFrame, key: str, unit: str, value: str) -> DataFrame:
    """For each unit of a key: the key's mean without it and the change, by subtraction rather than by pairs of units."""
    w = Window.partitionBy(key)
    rows = df.where(F.col(value).isNotNull()).withColumns({"__s": F.sum(value).over(w), "__n": F.count(F.lit(1)).over(w)})
    rest = F.when(F.col("__n") > 1, (F.col("__s") - F.col(value)) / (F.col("__n") - 1))
    return rows.select(key, unit, rest.alias("without"), (rest - F.col("__s") / F.col("__n")).alias("change"))


def compare_variants(df: DataFrame, keys: list[str], base: str, variant: str, least: int = 10) -> DataFrame:
    """Agreement of two versions of a value: availability agreement, pairs, signed and absolute differences."""
    b, v = F.col(base), F.col(variant)
    both = b.isNotNull() & v.isNotNull()
    d = F.when(both, v - b)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg((b.isNotNull() == v.isNotNull()).cast("double")).alias("availability_agreement"), F.count_if(both).alias("pairs"),
        F.when(F.count_if(both) >= least, F.percentile(d, 0.5)).alias("median_difference"), F.when(F.count_if(both) >= least, F.percentile(F.abs(d), 0.95)).alias("p95_abs_difference"), F.max(F.abs(d)).alias("max_abs_difference"),
    )


def transitions(df: DataFrame, old: str, new: str) -> Column:
    """Label of a change between two versions of a non-negative feature."""
    o, n = F.col(old), F.col(new)
    return F.when(o.isNull() | n.isNull(), "unavailable").when((o == 0) & (n == 0), "zero_to_zero").when((o == 0) & (n > 0), "new_positive").when((o > 0) & (n == 0), "lost_positive").otherwise("positive_to_positive")


def reconstruction(stored: DataFrame, rebuilt: DataFrame, key: str, columns: list[str], tolerance: float) -> DataFrame:
    """Per column: keys on either side, cells that agree within tolerance (NULL agrees with NULL), largest difference."""
    s, r = stored.alias("s"), rebuilt.alias("r")
    both = s.join(r, F.col(f"s.{key}").eqNullSafe(F.col(f"r.{key}")), "full_outer")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s.{c}").cast("double").alias("a"), F.col(f"r.{c}").cast("double").alias("b")) for c in columns])
    rows = both.select(F.explode(cells).alias("x")).select("x.*")
    same = (F.col("a").isNull() & F.col("b").isNull()) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False))
    return rows.groupBy("column").agg(F.count(F.lit(1)).alias("cells"), F.count_if(same).alias("matching"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_difference"))


def measurement_long(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """recording, feature, value, status: NULL values stay rows."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    rows = df.select(key, F.explode(cells).alias("x")).select(key, "x.*")
    return rows.withColumn("status", F.when(F.col("value").isNull(), "unavailable").when(F.col("value") == 0, "ok_zero").otherwise("ok_positive"))


def model_interface(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Each feature with its availability mask, never imputed."""
    return df.select(key, *[c for f in features for c in (F.col(f), F.col(f).isNotNull().alias(f"{f}__available"))])


def feature_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: available, zeros, positives, quartiles, median of positive values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select("x.*")
    v = F.col("value")
    counted = long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("available"), F.count_if(v == 0).alias("zeros"), F.count_if(v > 0).alias("positives"), F.min("value").alias("least"), F.max("value").alias("most"))
    placed = quantiles(long, ["feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    positive = quantiles(long.where(v > 0), ["feature"], "value", {"positive_median": 0.5})
    out = counted.join(placed, "feature", "left").join(positive, "feature", "left")
    return out.select("feature", "rows", "available", "zeros", "positives", "q1", "median", "q3", "positive_median", "least", "most")


def densified(df: DataFrame, key: str, values: list[str], measures: list[Column], zero: list[str]) -> DataFrame:
    """Aggregates for each of a fixed list of key values, zero where the table has none."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(v,) for v in values], f"{key} string")
    out = F.broadcast(grid).join(df.groupBy(key).agg(*measures), key, "left")
    return out.fillna(0, zero)


def family_index(df: DataFrame, key: str, features: dict[str, int], least_share: float = 0.5) -> DataFrame:
    """Row median of percentile scores, each turned so that higher is worse (direction -1 flips); NULL unless at least
    the share of features, rounded up, is there."""
    from .ranks import percent_score

    parts = []
    for name, direction in features.items():
        scored = percent_score(df.select(key, F.col(name).cast("double").alias("__v"), F.lit(name).alias("feature")), ["feature"], "__v")
        parts.append(scored.select(key, "feature", (F.col("score") if direction > 0 else 1 - F.col("score")).alias("score")))
    need = -(-len(features) * least_share // 1)
    out = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.count("score").alias("available"), F.percentile("score", 0.5).alias("__m"))
    return out.select(key, "available", F.when(F.col("available") >= need, F.col("__m")).alias("family_index"))
