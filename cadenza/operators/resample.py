"""Resampling with hash draws: any engine that has MD5 draws the same samples, at any partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import replicates as weighting
from .ranks import quantiles

SEED = 20260713
#: Tasks that clusters are dealt over where each has much to do, and samples whose picks are made in one pass over rows.
TASKS, PICKS = 96, 25


def draw(modulus: Column, *parts: Column) -> Column:
    """A number in [0, modulus) from the MD5 of the parts joined by |."""
    digest = F.md5(F.concat_ws("|", F.lit(str(SEED)), *[p.cast("string") for p in parts]))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), modulus)


def stable_order(value: Column, seed: str = str(SEED)) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), value.cast("string")), 256)


def replicate_weights(clusters: DataFrame, cluster: str, replicates: int) -> DataFrame:
    """replicate, cluster, weight: how often a bootstrap replicate draws the cluster. As many draws as clusters each;
    clusters are participants, so the table is replicates times participants."""
    numbered = weighting.numbered(clusters.select(cluster).distinct(), cluster)
    draws = numbered.select("__n", F.col("__i").alias("__d"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = draws.select("replicate", draw(F.col("__n"), F.col("replicate"), F.col("__d")).alias("__i")).groupBy("replicate", "__i").agg(F.count(F.lit(1)).alias("weight"))
    return drawn.join(numbered, "__i").select("replicate", cluster, "weight")


def bootstrap_mean(df: DataFrame, cluster: str, value: str, replicates: int) -> DataFrame:
    """One row: the mean over rows, its percentile interval over cluster bootstrap replicates, their number."""
    per = df.where(F.col(cluster).isNotNull() & F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__c"))
    return weighting.interval(weighting.weighted_sums(per, cluster, ["__s", "__c"], replicates, SEED), F.col("s0") / F.col("s1"))


def bootstrap_median(df: DataFrame, cluster: str, value: str, replicates: int) -> DataFrame:
    """As bootstrap_mean, for the median over rows; a replicate weighs a cluster's rows by how often it drew it."""
    rows = df.where(F.col(cluster).isNotNull() & F.col(value).isNotNull()).select(cluster, value)
    return weighting.interval(weighting.medians(rows, cluster, value, replicates, SEED), F.col("s0"))


def one_per_cluster(df: DataFrame, cluster: str, row: str, salt: str = "0") -> DataFrame:
    """One row of each cluster, picked by hash."""
    w = Window.partitionBy(cluster).orderBy(stable_order(F.concat_ws("|", F.lit(salt), F.col(row).cast("string"))), row)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def balanced_medians(df: DataFrame, cluster: str, row: str, value: str, iterations: int) -> DataFrame:
    """One row: median and 2.5/97.5 percentiles of the medians of `iterations` samples of one row per cluster."""
    rows = df.where(F.col(cluster).isNotNull() & F.col(value).isNotNull()).select(cluster, F.col(row).cast("string").alias("__r"), F.col(value).cast("double").alias("__v")).repartition(TASKS, cluster)
    pick = lambda i: F.min_by("__v", F.md5(F.concat_ws("|", F.lit(str(SEED)), F.lit(str(i)), "__r")))
    # Rows of a cluster meet once for all samples; the quantiles read the picks twice, which costs less than to move them.
    parts = [rows.groupBy(cluster).agg(F.array(*map(pick, range(low, min(low + PICKS, iterations)))).alias("__l")).select(F.posexplode("__l").alias("__it", "__v")).withColumn("__it", F.col("__it") + low) for low in range(0, iterations, PICKS)]
    picked = reduce(DataFrame.unionAll, parts)
    medians = quantiles(picked, ["__it"], "__v", {"__m": 0.5})
    return medians.agg(F.percentile("__m", 0.5).alias("median"), F.percentile("__m", 0.025).alias("low"), F.percentile("__m", 0.975).alias("high"), F.count(F.lit(1)).alias("iterations"))


def stratified_sample(df: DataFrame, strata: list[str], row: str, most: int) -> DataFrame:
    """`most` rows dealt round by round over the strata, hash order within each."""
    w = Window.partitionBy(*strata).orderBy(stable_order(F.col(row)), row)
    return df.withColumn("turn", F.row_number().over(w)).orderBy("turn", *strata).limit(most)


def evenly_spaced(df: DataFrame, order: list[str], count: int) -> DataFrame:
    """Rows at evenly spaced places of the whole order, ends included, duplicates once."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    rows = df.withColumn("place", F.row_number().over(w) - 1)
    places = df.agg(F.count(F.lit(1)).alias("__n")).select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("__i"), "__n").select(F.bround(F.col("__i") * (F.col("__n") - 1) / F.lit(max(1, count - 1))).cast("int").alias("place")).distinct()
    return rows.join(F.broadcast(places), "place", "left_semi")
