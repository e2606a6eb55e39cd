"""Robustness: cluster bootstraps of named statistics, deletions, alternative references, calibrated nulls, alignment of
human and measured families. Samples are drawn by hash, so any engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks, resample
from . import replicates as weighting
from .measure import gated


#: Sums over rows that a statistic of x and y is made of.
_SUMS = {
    "icc": lambda x, y: [F.lit(1.0), (x + y) / 2, (x + y) / 2 * ((x + y) / 2), (x - y) * (x - y)],
    "kappa": lambda x, y: [F.lit(1.0), (x == y).cast("double"), x, y],
    "ac1": lambda x, y: [F.lit(1.0), (x == y).cast("double"), x, y],
}


def _value(statistic: str) -> Column:
    """A statistic from its weighted sums s0, s1 ...; NULL where it has none."""
    n, *s = (F.col(f"s{k}") for k in range(6))
    if statistic == "spearman":
        a, b, ab, aa, bb = s
        va, vb = aa - a * a / n, bb - b * b / n
        return F.when((va > 1e-9) & (vb > 1e-9), (ab - a * b / n) / F.sqrt(va * vb))
    if statistic == "auc":
        _, pos, ab, *_ = s
        return F.when((pos > 0) & (n > pos), (ab - pos * (pos + 1) / 2) / (pos * (n - pos)))
    if statistic == "icc":
        mid, square, off, *_ = s
        between, within = 2 * (square - mid * mid / n) / (n - 1), off / n / 2
        return F.when((n > 1) & (between + within > 0), (between - within) / (between + within))
    agree, a, b = (c / n for c in s[:3])
    mean = (a + b) / 2
    chance = a * b + (1 - a) * (1 - b) if statistic == "kappa" else 2 * mean * (1 - mean)
    return F.when(chance < 1 - 1e-12, (agree - chance) / (1 - chance))


def bootstrap_statistic(df: DataFrame, cluster: str, statistic: str, x: str, y: str, replicates: int) -> DataFrame:
    """One row: statistic, estimate over all rows, 2.5 and 97.5 percentiles over cluster bootstrap replicates that have a
    value, their number, clusters. spearman of x and y; auc of score x for label y (0/1); icc of first x and second y,
    one-way; kappa and ac1 of two binary ratings x and y. A replicate weighs a cluster's rows by how often it drew it; no
    row is copied."""
    rows = df.where(F.col(cluster).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select(cluster, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    if statistic in ("spearman", "auc"):
        sums = weighting.rank_sums(rows, cluster, "__x", "__y", statistic == "spearman", replicates, resample.SEED)
    elif statistic in _SUMS:
        terms = _SUMS[statistic](F.col("__x"), F.col("__y"))
        per = rows.groupBy(cluster).agg(*[F.sum(c).alias(f"__{k}") for k, c in enumerate(terms)])
        sums = weighting.weighted_sums(per, cluster, [f"__{k}" for k in range(len(terms))], replicates, resample.SEED)
    else:
        raise ValueError(f"no statistic {statistic}")
    return weighting.interval(sums, _value(statistic)).select(F.lit(statistic).alias("statistic"), "estimate", "ci_low", "ci_high", "replicates", "clusters")


def first_second(df: DataFrame, subject: str, order: list[str], value: str) -> DataFrame:
    """subject, first, second: values of the first two repeats that have one."""
    w = Window.partitionBy(subject).orderBy(*order)
    two = df.where(F.col(subject).isNotNull() & F.col(value).isNotNull()).withColumn("__k", F.row_number().over(w)).where("__k <= 2")
    pair = two.groupBy(subject).agg(F.max(F.when(F.col("__k") == 1, F.col(value))).alias("first"), F.max(F.when(F.col("__k") == 2, F.col(value))).alias("second"))
    return pair.where("second IS NOT NULL")


def cluster_deletion(ledger: DataFrame, key: str, cluster: str, value: str) -> DataFrame:
    """key, omitted cluster, median of all its rows, without that cluster, the absolute change, clusters left. Rows of one
    recording meet its few clusters by its key."""
    rows = ledger.where(F.col(value).isNotNull())
    names = rows.select(key, F.col(cluster).alias("omitted")).distinct().withColumn("remaining", F.count(F.lit(1)).over(Window.partitionBy(key)) - 1).where("remaining > 0")
    full = rows.groupBy(key).agg(F.percentile(value, 0.5).alias("full"))
    left = rows.join(names, key).where(F.col(cluster) != F.col("omitted")).groupBy(key, "omitted", "remaining").agg(F.percentile(value, 0.5).alias("deleted"))
    return left.join(full, key).select(key, "omitted", "full", "deleted", F.abs(F.col("deleted") - F.col("full")).alias("change"), "remaining")


def interval_ledger(frames: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Per interval of a frame ledger (key, idx, level, at_floor) and a spectral ledger (key, idx, flatness): frames, those
    above the floor, share at the floor, median level, windows with a flatness; intervals without windows stay."""
    level = F.when(~F.col("at_floor"), F.col("level"))
    out = frames.groupBy(key, "idx").agg(F.count(F.lit(1)).alias("frames"), F.count(level).alias("valid"), F.avg(F.col("at_floor").cast("double")).alias("floor_fraction"), F.percentile(level, 0.5).alias("level"))
    per = windows.groupBy(key, "idx").agg(F.count("flatness").alias("windows"))
    return out.join(per, [key, "idx"], "left").fillna(0, ["windows"])


def null_grid(pool: DataFrame, row: str, scores: list[str], counts: list[int], iterations: int) -> DataFrame:
    """windows, iterations, mean, sd, p90, p95, p99 of the largest of the scores' medians over `windows` rows drawn from
    pool, for each of a few counts. The pool is numbered once; draws are hashes, counts times iterations of them."""
    numbered = pool.select(row, *scores).withColumn("__i", F.row_number().over(Window.orderBy(row)) - 1)
    size = numbered.agg(F.count(F.lit(1)).alias("__n"))
    spark = pool.sparkSession
    wanted = spark.createDataFrame([(c,) for c in sorted({c for c in counts if c >= 2})], "windows int")
    draws = wanted.join(F.broadcast(size)).select("windows", "__n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("__it")).select("*", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("__d"))
    picked = draws.withColumn("__i", resample.draw(F.col("__n"), F.col("windows"), F.col("__it"), F.col("__d"))).join(numbered, "__i")
    medians = picked.groupBy("windows", "__it").agg(F.greatest(*[F.percentile(s, 0.5) for s in scores]).alias("__m") if len(scores) > 1 else F.percentile(scores[0], 0.5).alias("__m"))
    return medians.groupBy("windows").agg(F.count(F.lit(1)).alias("iterations"), F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("sd"), *[F.percentile("__m", q).alias(n) for n, q in (("p90", 0.9), ("p95", 0.95), ("p99", 0.99))])


def eligible_members(members: DataFrame, task: str, excluded: Column, eligible: Column) -> DataFrame:
    """Members of one task's reference without those of the excluded subject and those not eligible."""
    return members.where((F.col("task") == task) & ~excluded & F.coalesce(eligible, F.lit(False)))


def vintage_hash(members: DataFrame, parameters: str) -> DataFrame:
    """task, members, vintage: SHA-256 of who is in a task's reference, their spectra's hashes and the parameters. Members
    are (task, subject, id, spectrum_hash); their own hashes are sorted, so order does not matter."""
    row = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("task", "subject", "id", "spectrum_hash")]), 256)
    out = members.select("task", row.alias("h")).groupBy("task").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_list("h")), "").alias("all"))
    return out.select("task", "members", F.sha2(F.concat(F.lit(parameters), F.col("all")), 256).alias("vintage"))


def vintages(subjects: DataFrame, delete: int, samples: int, keep_percent: int = 80) -> DataFrame:
    """comparison, iteration, task, subject: which subjects alternative references hold. baseline has all; of subset each
    subject is in with keep_percent by hash; delete_one leaves the first `delete` subjects of a task out in turn."""
    base = subjects.select("task", "subject").distinct()
    every = base.select(F.lit("baseline").alias("comparison"), F.lit(0).alias("iteration"), "task", "subject")
    rolls = base.select(F.lit("subset").alias("comparison"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("iteration"), "task", "subject")
    rolls = rolls.where(resample.draw(F.lit(100), F.col("iteration"), F.col("subject")) < keep_percent)
    place = F.row_number().over(Window.partitionBy("task").orderBy("subject")) - 1
    numbered = base.withColumn("__p", place)
    out = numbered.where(F.col("__p") < delete).select("task", F.col("__p").alias("iteration"))
    gone = numbered.join(out, "task").where(F.col("__p") != F.col("iteration")).select(F.lit("delete_one").alias("comparison"), "iteration", "task", "subject")
    return every.union(rolls).union(gone)


def reference_distances(long: DataFrame, members: DataFrame, least_subjects: int = 3) -> DataFrame:
    """comparison, iteration, id, distance: root mean square distance of a recording (id, task, subject, bin, power) from the
    median over subjects of the reference members' medians, its own subject left out. NULL below least_subjects."""
    per = long.groupBy("task", "subject", "bin").agg(F.percentile("power", 0.5).alias("power")).join(members, ["task", "subject"])
    keys = ["comparison", "iteration", "task", "bin"]
    # The median without one value lies among three of the middle: they are kept, and nothing is joined pair by pair.
    w = Window.partitionBy(*keys)
    ranked = per.withColumns({"__k": F.row_number().over(w.orderBy("power", "subject")).cast("long"), "__n": F.count(F.lit(1)).over(w)})
    half = F.floor(F.col("__n") / 2)
    middle = ranked.where(F.col("__k").between(half, half + 2)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__k", "power"))).alias("__l"), F.max("__n").alias("__n"))
    own = ranked.select(*keys, "subject", "__k")
    rows = long.select("id", "task", "subject", "bin", "power").join(middle, ["task", "bin"]).join(own, [*keys, "subject"], "left")
    n = F.col("__n") - F.col("__k").isNotNull().cast("long")
    # Places of the middle among the others, moved by one behind the recording's own subject.
    lo, hi = F.floor((n + 1) / 2), F.ceil((n + 1) / 2)
    at = lambda p: F.try_element_at("__l", p + F.coalesce((F.col("__k") <= p).cast("long"), F.lit(0)))
    reference = F.when(n >= least_subjects, (at(lo) + at(hi)) / 2)
    off = F.col("power") - reference
    return rows.groupBy("comparison", "iteration", "id").agg(F.sqrt(F.avg(off * off)).alias("distance"))


def reference_robustness(distances: DataFrame) -> DataFrame:
    """comparison, iteration, id, baseline, variant, delta of every alternative against the baseline."""
    base = distances.where("comparison = 'baseline'").select("id", F.col("distance").alias("baseline"))
    out = distances.where("comparison <> 'baseline'").join(base, "id")
    return out.select("comparison", "iteration", "id", "baseline", F.col("distance").alias("variant"), F.abs(F.col("distance") - F.col("baseline")).alias("delta"))


def robustness_summary(grid: DataFrame) -> DataFrame:
    """comparison, targets, rows, pairs, rho, median, 95th percentile and largest delta."""
    figures = grid.groupBy("comparison").agg(F.countDistinct("id").alias("targets"), F.count(F.lit(1)).alias("rows"), F.count("delta").alias("pairs"), F.percentile("delta", 0.5).alias("median_delta"), F.percentile("delta", 0.95).alias("p95_delta"), F.max("delta").alias("max_delta"))
    return figures.join(ranks.spearman(grid, ["comparison"], "baseline", "variant").select("comparison", "rho"), "comparison")


def rank_stability(grid: DataFrame) -> DataFrame:
    """comparison, iterations, median, 2.5 and 97.5 percentiles and least of each iteration's Spearman correlation."""
    per = ranks.spearman(grid, ["comparison", "iteration"], "baseline", "variant")
    return per.groupBy("comparison").agg(F.count("rho").alias("iterations"), F.percentile("rho", 0.5).alias("median_rho"), F.percentile("rho", 0.025).alias("low_rho"), F.percentile("rho", 0.975).alias("high_rho"), F.min("rho").alias("least_rho"))


def family_alignment(scores: DataFrame, labels: DataFrame, key: str, subject: str, least_class: int = 5, least_subjects: int = 5) -> DataFrame:
    """human, objective, recordings, participants, prevalence, auc, effect (2 auc - 1), status: each human family's binary
    labels(key, human, label) against each objective family's scores(key, subject, objective, score). Pairs without
    support stay rows, with the reason."""
    rows = labels.join(scores, key).where(F.col("label").isNotNull() & F.col("score").isNotNull())
    keys = ["human", "objective"]
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("recordings"), F.countDistinct(subject).alias("participants"), F.avg(F.col("label").cast("double")).alias("prevalence"))
    out = size.join(ranks.auc(rows, keys, "score", "label"), keys)
    _, status = gated(F.lit(1), {"insufficient_class_recordings": F.least("n_pos", "n_neg") < least_class, "insufficient_participants": F.col("participants") < least_subjects})
    ok = status == "ok"
    return out.select(*keys, "recordings", "participants", "prevalence", F.when(ok, F.col("auc")).alias("auc"), F.when(ok, 2 * F.col("auc") - 1).alias("effect"), status.alias("status"))


#: Support tiers of the gain features: (seconds of speech, frames, segments) and (segments, span). Fixed values.
LEVEL_TIERS = (("high", 20.0, 200, 3), ("moderate", 10.0, 100, 1), ("minimum", 3.0, 25, 1))
DRIFT_TIERS = (("high", 8, 30.0), ("moderate", 5, 20.0), ("minimum", 3, 10.0))


def level_tier(seconds: Column, frames: Column, segments: Column, tiers: tuple = LEVEL_TIERS) -> Column:
    out = F.lit("unavailable")
    for name, s, f, g in reversed(tiers):
        out = F.when((seconds >= s) & (frames >= f) & (segments >= g), name).otherwise(out)
    return out


def drift_tier(segments: Column, span: Column, tiers: tuple = DRIFT_TIERS) -> Column:
    out = F.lit("unavailable")
    for name, g, s in reversed(tiers):
        out = F.when((segments >= g) & (span >= s), name).otherwise(out)
    return out


def recording_table(df: DataFrame, rate: str, fraction: str, status: str) -> DataFrame:
    """df with what follows from an event family's features: positive, valid_zero, occurrence, milliseconds a minute."""
    positive = F.coalesce(F.col(rate) > 0, F.lit(False))
    return df.withColumns({"positive": positive, "valid_zero": F.coalesce(F.col(status) == "available_no_events", F.lit(False)), "occurrence": positive.cast("int"), "ms_per_min": F.col(fraction) * 60_000.0})


def by_role(df: DataFrame, key: str, roles: dict[str, str], keep: tuple[str, ...] = ("primary", "secondary")) -> DataFrame:
    """key, feature, role, value: the features of an analysis table whose role is kept, in long form."""
    use = [f for f, r in roles.items() if r in keep]
    named = F.create_map(*[x for f in use for x in (F.lit(f), F.lit(roles[f]))])
    return df.select(key, *[F.col(f).cast("double").alias(f) for f in use]).unpivot(key, use, "feature", "value").select(key, "feature", named[F.col("feature")].alias("role"), "value")
