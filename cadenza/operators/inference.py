"""Inference at participant grain: descriptions, feature pairs, links to human ratings, persistence, roles, galleries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import norm_ppf
from . import ranks, resample


def long_features(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, value, one row for each cell; NaN as NULL."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias("value")) for f in features])
    return df.select(*keys, F.explode(cells).alias("__x")).select(*keys, "__x.*")


def describe_features(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """Per feature: recordings, participants and recordings with a value, missing, quartiles, share of zeros."""
    v = F.col("value")
    long = long_features(df, [cluster], features)
    counted = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("recordings"), F.countDistinct(F.when(v.isNotNull(), F.col(cluster))).alias("participants"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"),
        F.avg((v == 0).cast("double")).alias("zero_fraction"),
    )
    placed = ranks.quantiles(long, ["feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return counted.join(placed, "feature", "left").select("feature", "recordings", "participants", "n", "missing", "q1", "median", "q3", "zero_fraction")


def feature_pairs(df: DataFrame, key: str, features: list[str], least: int = 10) -> DataFrame:
    """feature_a, feature_b, n, rho for each pair of features over recordings that have both. Cells of one recording meet
    by its key, so the work is recordings times pairs of features."""
    cells = long_features(df, [key], features).where("value IS NOT NULL")
    a = cells.select(key, F.col("feature").alias("feature_a"), F.col("value").alias("__va"))
    b = cells.select(key, F.col("feature").alias("feature_b"), F.col("value").alias("__vb"))
    return ranks.spearman(a.join(b, key).where("feature_a < feature_b"), ["feature_a", "feature_b"], "__va", "__vb", least)


def correlation_matrix(pairs: DataFrame, features: list[str]) -> DataFrame:
    """Both triangles and the diagonal of pair rows: row_feature and a column for each feature."""
    if "row_feature" in features:
        raise ValueError("a feature is called row_feature")
    spark = pairs.sparkSession
    both = pairs.select("feature_a", "feature_b", "rho").union(pairs.select("feature_b", "feature_a", "rho"))
    eye = spark.createDataFrame([(f, f, 1.0) for f in features], "feature_a string, feature_b string, rho double")
    return both.union(eye).groupBy(F.col("feature_a").alias("row_feature")).pivot("feature_b", features).agg(F.first("rho"))


def perceptual_links(df: DataFrame, labels: DataFrame, key: str, features: list[str], least: int = 5) -> DataFrame:
    """feature, category, n_pos, n_neg, auc of labels(key, category, label 0/1) by feature; NULL with a reason where a
    class has fewer than `least`. Links without support stay rows."""
    rows = long_features(df, [key], features).join(labels, key)
    out = ranks.auc(rows.withColumn("value", F.col("value")), ["feature", "category"], "value", "label")
    few = (F.col("n_pos") < least) | (F.col("n_neg") < least)
    return out.select("feature", "category", "n_pos", "n_neg", F.when(~few, F.col("auc")).alias("auc"), F.when(few, "insufficient_class_support").otherwise("ok").alias("status"))


def matched_specificity(effects: DataFrame, human: str, objective: str, effect: str) -> DataFrame:
    """One row: mean effect of matched families, of the others, and their difference."""
    same = F.col(human) == F.col(objective)
    out = effects.where(F.col(effect).isNotNull()).agg(F.avg(F.when(same, F.col(effect))).alias("matched"), F.avg(F.when(~same, F.col(effect))).alias("unmatched"))
    return out.withColumn("specificity", F.col("matched") - F.col("unmatched"))


def rank_normal(df: DataFrame, keys: list[str], value: str, name: str = "score") -> DataFrame:
    """Normal quantile of (average rank - 1/2) / n within keys; NULL values are left out."""
    rows = ranks.with_rank(df, keys, value, "__r", "__n")
    return rows.withColumn(name, norm_ppf((F.col("__r") - 0.5) / F.col("__n"))).drop("__r", "__n")


def reml_ratio(n: np.ndarray, mean: np.ndarray, within: float) -> float:
    """Between over residual variance that maximises the restricted likelihood of a random-intercept model, from group
    sizes, group means and the pooled within-group sum of squares."""
    total = n.sum()

    def loss(theta: float) -> float:
        w = n / (1 + n * theta)
        mu = (w * mean).sum() / w.sum()
        q = within + (w * (mean - mu) ** 2).sum()
        return (total - 1) * np.log(max(q, 1e-300)) + np.log1p(n * theta).sum() + np.log(w.sum())

    grid = np.concatenate(([0.0], np.exp(np.linspace(-9, 9, 181))))
    at = int(np.argmin([loss(t) for t in grid]))
    lo, hi = grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)]
    g = (np.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float((lo + hi) / 2)


def persistence(df: DataFrame, cluster: str, features: list[str], least_clusters: int = 5, least_repeats: int = 3) -> DataFrame:
    """Per feature: REML intraclass correlation of rank-normal scores within participants, with its status.

    Rows are reduced to size, mean and squares of each participant before a feature's participants meet in one task."""
    scores = rank_normal(long_features(df.where(F.col(cluster).isNotNull()), [cluster], features), ["feature"], "value")
    per = scores.groupBy("feature", cluster).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), (F.var_pop("score") * F.count(F.lit(1))).alias("within"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        groups, repeated = len(pdf), int((pdf["n"] > 1).sum())
        status = "insufficient_participants" if groups < least_clusters else "insufficient_repeats" if repeated < least_repeats else "ok"
        theta = reml_ratio(pdf["n"].to_numpy(float), pdf["mean"].to_numpy(), float(pdf["within"].sum())) if status == "ok" else np.nan
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "participants": [groups], "repeated": [repeated], "recordings": [int(pdf["n"].sum())], "icc": [theta / (1 + theta) if status == "ok" else None], "status": [status]})

    return per.groupBy("feature").applyInPandas(one, "feature string, participants long, repeated long, recordings long, icc double, status string")


def extremes(df: DataFrame, key: str, features: list[str], k: int) -> DataFrame:
    """The k lowest and highest recordings of each feature, ties by key."""
    cells = long_features(df, [key], features).where("value IS NOT NULL")

    def first(side: str, *order: Column | str) -> DataFrame:
        # One window alone lets each task keep its k best before the shuffle.
        placed = cells.withColumn("place", F.row_number().over(Window.partitionBy("feature").orderBy(*order))).where(F.col("place") <= k)
        return placed.select("feature", key, "value", F.lit(side).alias("side"), "place")

    return first("low", "value", key).unionByName(first("high", F.desc("value"), key))


def gallery(df: DataFrame, key: str, features: list[str], strata: list[str], most: int, k: int = 2) -> DataFrame:
    """At most `most` recordings: extremes first, then rounds over the strata in hash order; each once, with its reasons."""
    ends = extremes(df, key, features, k).select(key, F.concat_ws("_", "feature", "side").alias("reason"), F.lit(0).alias("__class"), F.col("place").alias("__turn"))
    w = Window.partitionBy(*strata).orderBy(resample.stable_order(F.col(key)), key)
    rest = df.select(key, F.concat_ws("_", F.lit("stratum"), *strata).alias("reason"), F.lit(1).alias("__class"), F.row_number().over(w).alias("__turn"))
    first = ends.unionByName(rest).groupBy(key).agg(F.min(F.struct("__class", "__turn")).alias("__o"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("__class") == 0, F.col("reason")))), "|").alias("__ends"), F.min(F.when(F.col("__class") == 1, F.col("reason"))).alias("__stratum"))
    picked = first.orderBy("__o", resample.stable_order(F.col(key)), key).limit(most)
    return picked.select(key, F.when(F.col("__o.__class") == 0, F.col("__ends")).otherwise(F.col("__stratum")).alias("reason"))


def blind_review(first: DataFrame, second: DataFrame, item: str, label: str, positive: list[str]) -> DataFrame:
    """One row: items both reviewed, exact and binary agreement, binary kappa, items to adjudicate."""
    both = first.select(item, F.col(label).alias("__a")).join(second.select(item, F.col(label).alias("__b")), item)
    rows = both.withColumns({"__pa": F.col("__a").isin(*positive).cast("double"), "__pb": F.col("__b").isin(*positive).cast("double")})
    out = rows.agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("__a") == F.col("__b")).cast("double")).alias("exact"), F.avg((F.col("__pa") == F.col("__pb")).cast("double")).alias("binary"), F.avg("__pa").alias("__ma"), F.avg("__pb").alias("__mb"), F.count_if(F.col("__a") != F.col("__b")).alias("to_adjudicate"))
    chance = F.col("__ma") * F.col("__mb") + (1 - F.col("__ma")) * (1 - F.col("__mb"))
    return out.withColumn("kappa", F.when(chance < 1 - 1e-12, (F.col("binary") - chance) / (1 - chance))).drop("__ma", "__mb")


def truth_metrics(truth: Column, found: Column) -> list[Column]:
    """Aggregates of two boolean columns: tp, fp, fn, precision, recall, f1; NULL where undefined."""
    tp, fp, fn = F.count_if(truth & found), F.count_if(~truth & found), F.count_if(truth & ~found)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1")]


#: Least values a detector needs for the full role. Fixed values.
GATES = {"precision": 0.95, "recall": 0.85, "occurrence_recall": 0.90, "event_precision": 0.80, "event_recall": 0.80, "median_iou": 0.50, "spearman": 0.80, "f1": 0.70}


def decide_role(df: DataFrame, gates: dict[str, float] = GATES) -> DataFrame:
    """df with failed (gates not met, in order; NULL fails) and role: full, occurrence_only or exploratory."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(g) >= v, F.lit(False)), F.lit(g)) for g, v in gates.items() if g in df.columns]))
    out = df.withColumn("__f", failed)
    occurrence = F.coalesce(F.col("occurrence_recall") >= gates["occurrence_recall"], F.lit(False)) if "occurrence_recall" in df.columns else F.lit(False)
    return out.withColumns({"failed": F.array_join("__f", "|"), "role": F.when(F.size("__f") == 0, "full").when(occurrence, "occurrence_only").otherwise("exploratory")}).drop("__f")
