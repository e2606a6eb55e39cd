"""Agreement of raters over long ratings (item, rater, rating): kappa, AC1, ICC, consensus, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_kappa(df: DataFrame, item: str, rater: str, rating: str) -> DataFrame:
    """Cohen's kappa of each pair of raters on binary ratings of shared items; NULL where chance agreement is 1."""
    a = df.where(F.col(rating).isNotNull()).select(F.col(item).alias("__i"), F.col(rater).alias("rater_a"), F.col(rating).cast("double").alias("__a"))
    b = df.where(F.col(rating).isNotNull()).select(F.col(item).alias("__i"), F.col(rater).alias("rater_b"), F.col(rating).cast("double").alias("__b"))
    both = a.join(b, "__i").where("rater_a < rater_b").groupBy("rater_a", "rater_b").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("__a") == F.col("__b")).cast("double")).alias("observed"), F.avg("__a").alias("__pa"), F.avg("__b").alias("__pb"))
    chance = F.col("__pa") * F.col("__pb") + (1 - F.col("__pa")) * (1 - F.col("__pb"))
    return both.withColumn("kappa", F.when(chance < 1 - 1e-12, (F.col("observed") - chance) / (1 - chance))).drop("__pa", "__pb")


def category_counts(df: DataFrame, item: str, rating: str) -> DataFrame:
    """Per item and rating: raters who gave it, raters of the item, raters the fullest item has."""
    counts = df.where(F.col(rating).isNotNull()).groupBy(item, rating).agg(F.count(F.lit(1)).alias("k"))
    return counts.withColumn("r", F.sum("k").over(Window.partitionBy(item)))


def gwet_ac1(df: DataFrame, item: str, rating: str) -> DataFrame:
    """One row: items rated twice or more, observed pair agreement, AC1 of any number of raters, gaps allowed."""
    counts = category_counts(df, item, rating)
    per_item = counts.groupBy(item).agg(F.first("r").alias("r"), F.sum(F.col("k") * (F.col("k") - 1)).alias("__same"))
    observed = per_item.where("r >= 2").agg(F.count(F.lit(1)).alias("items"), F.avg(F.col("__same") / (F.col("r") * (F.col("r") - 1))).alias("observed"))
    items = per_item.agg(F.count(F.lit(1)).alias("__n"))
    share = counts.groupBy(rating).agg(F.sum(F.col("k") / F.col("r")).alias("__s")).crossJoin(F.broadcast(items)).withColumn("__p", F.col("__s") / F.col("__n"))
    chance = share.agg(F.count(F.lit(1)).alias("__q"), F.sum(F.col("__p") * (1 - F.col("__p"))).alias("__pp"))
    out = observed.crossJoin(F.broadcast(chance)).withColumn("__e", F.when(F.col("__q") > 1, F.col("__pp") / (F.col("__q") - 1)).otherwise(0.0))
    return out.select("items", "observed", F.try_divide(F.col("observed") - F.col("__e"), 1 - F.col("__e")).alias("ac1"))


def fleiss_kappa(df: DataFrame, item: str, rating: str, raters: int) -> DataFrame:
    """One row: Fleiss' kappa over items that all raters rated."""
    counts = category_counts(df, item, rating).where(F.col("r") == raters)
    agree = counts.groupBy(item).agg((F.sum(F.col("k") * (F.col("k") - 1)) / (raters * (raters - 1))).alias("__p")).agg(F.count(F.lit(1)).alias("items"), F.avg("__p").alias("observed"))
    share = counts.groupBy(rating).agg(F.sum("k").alias("__k")).crossJoin(F.broadcast(agree)).agg(F.first("items").alias("items"), F.first("observed").alias("observed"), F.sum(F.pow(F.col("__k") / (F.col("items") * raters), F.lit(2))).alias("__e"))
    return share.select("items", "observed", F.when(F.col("__e") < 1 - 1e-12, (F.col("observed") - F.col("__e")) / (1 - F.col("__e"))).alias("kappa"))


def icc_two_way(df: DataFrame, item: str, rater: str, value: str, raters: int) -> DataFrame:
    """One row: ICC(2,1) and ICC(2,k), two-way random, absolute agreement, over items that all raters rated."""
    full = df.where(F.col(value).isNotNull()).withColumn("__r", F.count(F.lit(1)).over(Window.partitionBy(item))).where(F.col("__r") == raters)
    x = F.col(value).cast("double")
    total = full.agg(F.count(F.lit(1)).alias("__m"), F.avg(x).alias("__g"), F.var_pop(x).alias("__v"))
    rows = full.groupBy(item).agg(F.avg(x).alias("__a")).agg(F.count(F.lit(1)).alias("n"), F.var_pop("__a").alias("__vr"))
    cols = full.groupBy(rater).agg(F.avg(x).alias("__a")).agg(F.var_pop("__a").alias("__vc"))
    t = total.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))
    k, n = F.lit(float(raters)), F.col("n")
    t = t.withColumns({"__msr": n * k * F.col("__vr") / (n - 1) / 1.0, "__msc": n * k * F.col("__vc") / (k - 1)})
    t = t.withColumn("__mse", (n * k * (F.col("__v") - F.col("__vr") - F.col("__vc"))) / ((n - 1) * (k - 1)))
    one = F.try_divide(F.col("__msr") - F.col("__mse"), (F.col("__msr") + (k - 1) * F.col("__mse") + k * (F.col("__msc") - F.col("__mse")) / n))
    many = F.try_divide(F.col("__msr") - F.col("__mse"), (F.col("__msr") + (F.col("__msc") - F.col("__mse")) / n))
    return t.select("n", one.alias("icc2_1"), many.alias("icc2_k"))


def icc_one_way(df: DataFrame, subject: str, order: list[str], value: str, finite_first: bool = True, least: int = 2, need_order: bool = False) -> DataFrame:
    """One row: ICC(1,1) on the first two repeats of each subject.

    finite_first: NULL values go before the first two are picked; otherwise the first two visits are picked and subjects
    with a NULL among them go. need_order: rows with a NULL in `order` go first as well. NULL below `least` subjects."""
    rows = df.where(F.col(subject).isNotNull())
    if finite_first:
        rows = rows.where(F.col(value).isNotNull())
    if need_order:
        rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in order))
    w = Window.partitionBy(subject).orderBy(*[F.asc_nulls_last(c) for c in order])
    two = rows.withColumn("__k", F.row_number().over(w)).where("__k <= 2").groupBy(subject).agg(F.count(value).alias("__n"), F.max(F.when(F.col("__k") == 1, F.col(value))).alias("__a"), F.max(F.when(F.col("__k") == 2, F.col(value))).alias("__b"))
    two = two.where("__n = 2").withColumns({"__m": (F.col("__a") + F.col("__b")) / 2, "__d": F.col("__a") - F.col("__b")})
    out = two.agg(F.count(F.lit(1)).alias("subjects"), F.var_samp("__m").alias("__vm"), F.avg(F.col("__d") * F.col("__d")).alias("__dd"), F.corr("__a", "__b").alias("pearson"), F.percentile(F.abs("__d"), 0.5).alias("median_abs_difference"))
    between, within = 2 * F.col("__vm"), F.col("__dd") / 2
    return out.select("subjects", F.when((F.col("subjects") >= least) & (between + within > 0), (between - within) / (between + within)).alias("icc1"), "pearson", "median_abs_difference")


def consensus(df: DataFrame, item: str, rating: str, raters: int, least: int = 2) -> DataFrame:
    """Majority rating of each item; NULL on ties or below `least` ratings, with the status that says so."""
    votes = category_counts(df, item, rating).withColumn("__top", F.rank().over(Window.partitionBy(item).orderBy(F.desc("k"))))
    won = votes.where("__top = 1").groupBy(item).agg(F.first("r").alias("ratings"), F.count(F.lit(1)).alias("__ties"), F.min(rating).alias("__v"), F.max("k").alias("votes"))
    status = F.when(F.col("ratings") < least, "insufficient").when(F.col("__ties") > 1, "tie").when(F.col("ratings") < raters, "majority_incomplete").otherwise("majority")
    return won.select(item, "ratings", "votes", status.alias("status"), F.when((F.col("ratings") >= least) & (F.col("__ties") == 1), F.col("__v")).alias("consensus"))


def coverage(df: DataFrame, item: str, rater: str, raters: int) -> DataFrame:
    """Items by number of distinct raters, and whether agreement can be estimated on them."""
    per = df.groupBy(item).agg(F.countDistinct(rater).alias("raters"))
    return per.groupBy("raters").agg(F.count(F.lit(1)).alias("items")).withColumn("design", F.when(F.col("raters") >= raters, "complete").when(F.col("raters") >= 2, "partial").otherwise("blocked"))


def rater_prevalence(df: DataFrame, rater: str, rating: str) -> DataFrame:
    return df.groupBy(rater).agg(F.count(F.lit(1)).alias("cells"), F.count(rating).alias("rated"), F.sum(F.col(rating).cast("long")).alias("positive"), F.avg(F.col(rating).cast("double")).alias("prevalence"))


def binary_agreement(df: DataFrame, item: str, rating: str) -> DataFrame:
    """One row over items rated twice or more: prevalence, positive and negative agreement, unanimous share."""
    per = df.where(F.col(rating).isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("r"), F.sum(F.col(rating).cast("long")).alias("k")).where("r >= 2")
    pp = F.col("k") * (F.col("k") - 1) / (F.col("r") - 1)
    nn = (F.col("r") - F.col("k")) * (F.col("r") - F.col("k") - 1) / (F.col("r") - 1)
    return per.agg(
        F.count(F.lit(1)).alias("items"), F.try_divide(F.sum("k"), F.sum("r")).alias("prevalence"), F.try_divide(F.sum(pp), F.sum("k")).alias("positive_agreement"),
        F.try_divide(F.sum(nn), F.sum(F.col("r") - F.col("k"))).alias("negative_agreement"), F.avg(((F.col("k") == 0) | (F.col("k") == F.col("r"))).cast("double")).alias("unanimous"),
    )
