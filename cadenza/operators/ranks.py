"""Rank statistics: average ranks, percentiles, AUC, average precision, Spearman, Cliff's delta, Theil-Sen, robust spread.

A rank is not taken from one window over all rows of a key: values are counted first, each count falls in a bin of its
value, and a rank is what the bins below hold, what the bin holds below, and half of the ties. So a feature of any number
of rows is ranked by as many tasks as there are, and a value that many rows share is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of each octave of values.
PARTS = 4096
#: Tasks that keys are dealt over where pairs of their rows meet.
TASKS = 96
#: Slopes of one key that are sorted at once.
PAIRS = 1 << 22


def value_bin(x: Column) -> Column:
    """A number that never falls as x rises: PARTS bins for each doubling, negative below zero; NaN is above all."""
    size = F.abs(x)
    octave = F.floor(F.log2(size))
    place = (octave + 1100) * PARTS + F.floor((size / F.pow(F.lit(2.0), octave) - 1) * PARTS)
    return F.when(F.isnan(x), 1 << 40).when(x == 0, 0).when(size == float("inf"), F.signum(x).cast("long") * (1 << 39)).otherwise(F.signum(x).cast("long") * place.cast("long"))


def same_keys(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def with_rank(df: DataFrame, keys: list[str], value: str, name: str, total: str | None = None, kind: str = "average") -> DataFrame:
    """Rows with a value, its rank from 1 on within the keys, and, if asked, the rows of the key. Ties share the average of
    their places, or with kind "last" the last of them."""
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c")).withColumn("__b", value_bin(F.col(value).cast("double")))
    inside = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__in", F.coalesce(F.sum("__c").over(inside), F.lit(0)))
    bins = counts.groupBy(*keys, "__b").agg(F.sum("__c").alias("__s"))
    w = Window.partitionBy(*keys)
    bins = bins.withColumns({"__below": F.coalesce(F.sum("__s").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__n": F.sum("__s").over(w)})
    before = F.col("__in") + F.col("__below")
    rank = before + (F.col("__c") + 1) / F.lit(2.0) if kind == "average" else before + F.col("__c")
    placed = counts.alias("c").join(bins.alias("b"), same_keys("c", "b", [*keys, "__b"])).select(*[F.col(f"c.{k}") for k in keys], F.col(f"c.{value}"), rank.alias(name), *([F.col("__n").alias(total)] if total else []))
    both = rows.alias("r").join(placed.alias("p"), same_keys("r", "p", [*keys, value]))
    return both.select("r.*", f"p.{name}", *([f"p.{total}"] if total else []))


def quantiles(df: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """keys and the exact quantiles of a value, interpolated as percentile does. Rows are counted by bins of the value; only
    those in a bin that a quantile falls in, two for each level at most, are looked at again, so no task holds a key's values."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v")).withColumn("__b", value_bin(F.col("__v")))
    w = Window.partitionBy(*keys)
    bins = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__s"))
    bins = bins.withColumns({"__below": F.coalesce(F.sum("__s").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__n": F.sum("__s").over(w)})
    at = {name: (F.col("__n") - 1) * F.lit(float(q)) for name, q in levels.items()}
    inside = lambda p, low, size: (p >= F.col(low)) & (p < F.col(low) + F.col(size))
    held = reduce(lambda a, b: a | b, [inside(f(p), "__below", "__s") for p in at.values() for f in (F.floor, F.ceil)])
    counts = rows.alias("r").join(F.broadcast(bins.where(held).alias("b")), same_keys("r", "b", [*keys, "__b"])).select("r.*", "b.__below", "b.__n")
    counts = counts.groupBy(*keys, "__b", "__v", "__below", "__n").agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__k", F.col("__below") + F.coalesce(before, F.lit(0)))
    pick = lambda p: F.max(F.when(inside(p, "__k", "__c"), F.col("__v")))
    found = counts.groupBy(*keys).agg(F.max("__n").alias("__n"), *[pick(f(p)).alias(f"__{e}{k}") for k, p in enumerate(at.values()) for e, f in (("l", F.floor), ("h", F.ceil))])
    between = lambda k, p: F.when(F.floor(p) == F.ceil(p), F.col(f"__l{k}")).otherwise((F.ceil(p) - p) * F.col(f"__l{k}") + (p - F.floor(p)) * F.col(f"__h{k}"))
    return found.select(*keys, *[between(k, p).alias(name) for k, (name, p) in enumerate(at.items())])


def percent_score(df: DataFrame, keys: list[str], value: str, name: str = "score") -> DataFrame:
    """(rank - 1) / (n - 1), 0.5 for a single value, NULL for NULL."""
    ranked = with_rank(df, keys, value, "__r", "__n")
    ranked = ranked.withColumn(name, F.when(F.col("__n") == 1, 0.5).otherwise((F.col("__r") - 1) / (F.col("__n") - 1))).drop("__r", "__n")
    return ranked.unionByName(df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double")))


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC of label 1 over label 0 for each key, ties half; NULL unless both labels occur."""
    rows = with_rank(df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)), keys, score, "__r")
    out = rows.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"), F.sum(F.when(F.col(label) == 1, F.col("__r"))).alias("__s"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.withColumn("auc", F.when(ok, (F.col("__s") - F.col("n_pos") * (F.col("n_pos") + 1) / F.lit(2.0)) / (F.col("n_pos") * F.col("n_neg")))).drop("__s")


def average_precision(df: DataFrame, keys: list[str], score: str, label: str, tie: str) -> DataFrame:
    """Mean precision at each positive by falling score, ties in order of `tie`; NULL without positives. Rows of one bin of
    scores are put in order together, bins are added up."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumns({"__b": value_bin(F.col(score).cast("double")), "__y": F.col(label).cast("double")})
    inside = Window.partitionBy(*keys, "__b").orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__k": F.count(F.lit(1)).over(inside), "__p": F.sum("__y").over(inside)})
    bins = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__bn"), F.sum("__y").alias("__bp"))
    above = Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns({"__an": F.coalesce(F.sum("__bn").over(above), F.lit(0)), "__ap": F.coalesce(F.sum("__bp").over(above), F.lit(0.0))})
    both = rows.alias("r").join(bins.alias("b"), same_keys("r", "b", [*keys, "__b"])).select("r.*", "b.__an", "b.__ap")
    return both.groupBy(*keys).agg(F.avg(F.when(F.col(label) == 1, (F.col("__p") + F.col("__ap")) / (F.col("__k") + F.col("__an")))).alias("average_precision"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Correlation of average ranks over complete pairs; NULL below `least` pairs or where a side is constant."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    rows = with_rank(with_rank(rows, keys, x, "__x"), keys, y, "__y")
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("__x", "__y").alias("__rho"), F.min("__x").alias("__x0"), F.max("__x").alias("__x1"), F.min("__y").alias("__y0"), F.max("__y").alias("__y1"))
    ok = (F.col("n") >= least) & (F.col("__x0") < F.col("__x1")) & (F.col("__y0") < F.col("__y1"))
    return out.select(*keys, "n", F.when(ok, F.col("__rho")).alias("rho"))


def cliffs_delta(df: DataFrame, keys: list[str], value: str, group: str, high: str, low: str) -> DataFrame:
    """P(high > low) - P(high < low), from ranks rather than from pairs of rows."""
    rows = df.where(F.col(group).isin(high, low) & F.col(value).isNotNull()).withColumn("__l", (F.col(group) == high).cast("int"))
    return auc(rows, keys, value, "__l").select(*keys, F.col("n_pos").alias("n_high"), F.col("n_neg").alias("n_low"), (2 * F.col("auc") - 1).alias("delta"))


def rank_biserial_by_stratum(df: DataFrame, keys: list[str], stratum: str, score: str, label: str) -> DataFrame:
    """Within-stratum rank-biserial effects averaged with the number of pairs as weight."""
    parts = auc(df, [*keys, stratum], score, label).where("auc IS NOT NULL").withColumn("__w", F.col("n_pos") * F.col("n_neg"))
    return parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("strata"), F.sum("__w").alias("pairs"), (F.sum((2 * F.col("auc") - 1) * F.col("__w")) / F.sum("__w")).alias("effect"))


def theil_sen(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Median of the slopes of all pairs of a key with different x, and their number. Pairs meet by an equi-join on the
    key, which must be a recording or participant: the work is the square of its rows, never of the table's."""
    a = df.select(*keys, F.col(x).alias("__x1"), F.col(y).alias("__y1"))
    b = df.select(*keys, F.col(x).alias("__x2"), F.col(y).alias("__y2"))
    pairs = a.join(b, keys).where("__x1 < __x2").withColumn("__slope", (F.col("__y2") - F.col("__y1")) / (F.col("__x2") - F.col("__x1")))
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.percentile("__slope", 0.5).alias("slope"))


def _slopes(x: np.ndarray, y: np.ndarray, low: int, high: int) -> np.ndarray:
    """Slopes of the pairs x[i] < x[j] with i in [low, high); x rises."""
    first = np.searchsorted(x, x[low:high], "right")
    many = len(x) - first
    i = np.repeat(np.arange(low, high), many)
    j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return (y[j] - y[i]) / (x[j] - x[i])


def _kth_slopes(x: np.ndarray, y: np.ndarray, places: list[int], held: int = PAIRS) -> list[float]:
    """The slopes at places of their order. Up to `held` of them are sorted, beyond that a place is found by halving the range
    of doubles and counting slopes in blocks, so what is held at once is bounded."""
    pairs = int((len(x) - np.searchsorted(x, x, "right")).sum())
    if pairs <= held:
        slopes = np.sort(_slopes(x, y, 0, len(x)))
        return [float(slopes[p]) for p in places]
    step = max(1, held // len(x))
    # Doubles in order as integers.
    double = lambda k: np.array(k if k >= 0 else k ^ 0x7FFFFFFFFFFFFFFF, np.int64).view(np.float64)[()]
    out = []
    for p in places:
        low, high = -(0x7FF << 52) - 1, 0x7FF << 52
        while low < high:
            mid = (low + high) // 2
            if sum(int((_slopes(x, y, at, min(len(x), at + step)) <= double(mid)).sum()) for at in range(0, len(x), step)) > p:
                high = mid
            else:
                low = mid + 1
        out.append(float(double(low)))
    return out


def theil_sen_interval(df: DataFrame, keys: list[str], x: str, y: str, z: float) -> DataFrame:
    """keys, pairs, slope, low, high: the median of all slopes of a key and the slopes whose ranks lie z standard deviations
    of Kendall's statistic, ties allowed for, on both sides. A key must be a recording or participant: its rows are held
    together, never its pairs beyond PAIRS. Keys are dealt over TASKS tasks whatever their size in bytes."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("__r"))
    held = rows.repartition(TASKS, *keys).groupBy(*keys).agg(F.collect_list("__r").alias("__l"))
    term = lambda n: n * (n - 1) * (2 * n + 5)

    def one(x: np.ndarray, y: np.ndarray) -> tuple | None:
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        m = int((len(x) - np.searchsorted(x, x, "right")).sum())
        if not m:
            return None
        tied = [int(term(np.unique(c, return_counts=True)[1].astype(object)).sum()) for c in (x, y)]
        w = z * ((term(len(x)) - sum(tied)) / 18.0) ** 0.5
        low, high = max(round((m - w) / 2) - 1, 0), min(round((m + w) / 2), m - 1)
        a, b, c, d = _kth_slopes(x, y, [(m - 1) // 2, m // 2, low, high])
        return m, (a + b) / 2, c, d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            ends = lists.offsets.to_numpy()
            xs, ys = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in range(2))
            ends = ends - ends[0]
            found = [one(xs[i:j], ys[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            some = batch.filter(pa.array([f is not None for f in found], pa.bool_()))
            figures = list(zip(*[f for f in found if f is not None], strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*some.columns[: len(keys)], *[pa.array(c, pa.float64() if k else pa.int64()) for k, c in enumerate(figures)]], [*keys, "pairs", "slope", "low", "high"])

    types = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return held.mapInArrow(run, types + "pairs long, slope double, low double, high double")


def robust_spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, median, IQR and scaled median absolute deviation."""
    mid = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("__mid"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("__iqr"))
    dev = df.join(mid, keys).withColumn("__d", F.abs(F.col(value) - F.col("__mid")))
    return dev.groupBy(*keys).agg(F.count(value).alias("n"), F.first("__mid").alias("median"), F.first("__iqr").alias("iqr"), (1.4826 * F.percentile("__d", 0.5)).alias("mad"))


def robust_outliers(df: DataFrame, keys: list[str], value: str, limit: float) -> DataFrame:
    """Rows whose distance from their key's median exceeds limit scaled deviations, with that robust z."""
    spread = robust_spread(df, keys, value).select(*keys, F.col("median").alias("__mid"), F.col("mad").alias("__mad"))
    z = F.when(F.col("__mad") > 0, (F.col(value) - F.col("__mid")) / F.col("__mad"))
    return df.join(spread, keys).withColumn("robust_z", z).where(F.abs("robust_z") > limit).drop("__mid", "__mad")


def false_discovery(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Benjamini-Hochberg q values within each key; NULL p stays NULL and does not count. The least ratio at or above a
    value is taken bin by bin."""
    rows = with_rank(df, keys, p, "__k", "__n", "last").withColumns({"__q": F.col(p) * F.col("__n") / F.col("__k"), "__b": value_bin(F.col(p).cast("double"))})
    inside = Window.partitionBy(*keys, "__b").orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__here", F.min("__q").over(inside))
    bins = rows.groupBy(*keys, "__b").agg(F.min("__q").alias("__m"))
    bins = bins.withColumn("__above", F.min("__m").over(Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)))
    both = rows.alias("r").join(bins.alias("b"), same_keys("r", "b", [*keys, "__b"])).select("r.*", "b.__above")
    both = both.withColumn("q", F.least(F.lit(1.0), "__here", "__above")).drop("__k", "__n", "__q", "__b", "__here", "__above")
    return both.unionByName(df.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))
