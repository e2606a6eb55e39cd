"""Summaries of segmentations, ledgers and feature tables: per recording, per stratum, per feature."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import wilson
from . import intervals as iv

#: Limits of the reading triage. Fixed values.
TRIAGE = {"speech_fraction": 0.05, "duration": 1.0, "rms_median": -60.0, "rms_std": 3.0, "segments": 25, "longest_pause": 5.0}
HARD_FLAGS = ("no_speech_detected", "very_low_speech_fraction", "very_short_file", "near_silent_or_noise_only")


def frame_diagnostics(frames: DataFrame, views: DataFrame, names: list[str], keys: list[str], width: int) -> DataFrame:
    """frames (keys, id, t) with a boolean for each view: whether t lies in one of its intervals."""
    out = frames
    for name in names:
        inside = iv.members(frames.select(*keys, "id", "t"), views.where(F.col("view") == name).select(*keys, "start", "end"), keys, width)
        out = out.join(inside.where("inside > 0").select("id", F.lit(True).alias(name)), "id", "left").fillna(False, [name])
    return out


def segmentation_summary(speech: DataFrame, durations: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Per recording of durations(keys, duration): speech length and share, segments, pauses between them, the longest,
    median and spread of frame levels(keys, level). Recordings without speech have zeros."""
    per = speech.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("speech"), F.count(F.lit(1)).alias("segments"))
    pauses = iv.gaps(speech, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("pauses"), F.max(F.col("end") - F.col("start")).alias("longest_pause"))
    level = frames.groupBy(*keys).agg(F.percentile("level", 0.5).alias("rms_median"), F.stddev_pop("level").alias("rms_std"))
    out = durations.join(per, keys, "left").join(pauses, keys, "left").join(level, keys, "left").fillna(0, ["speech", "segments", "pauses", "longest_pause"])
    return out.withColumn("speech_fraction", F.when(F.col("duration") > 0, F.col("speech") / F.col("duration")))


def reading_triage(summary: DataFrame) -> DataFrame:
    """summary with qc_flags, in fixed order joined by ;, and qc_status: excluded by a hard flag, else flagged by a soft one."""
    t = TRIAGE
    flags = {
        "no_speech_detected": F.col("segments") == 0, "very_low_speech_fraction": F.col("speech_fraction") < t["speech_fraction"], "very_short_file": F.col("duration") < t["duration"],
        "near_silent_or_noise_only": (F.col("rms_median") < t["rms_median"]) & (F.col("rms_std") < t["rms_std"]), "extreme_fragmentation": F.col("segments") > t["segments"], "extreme_internal_pause": F.col("longest_pause") > t["longest_pause"],
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in flags.items()]))
    hard = F.size(F.array_intersect(found, F.array(*map(F.lit, HARD_FLAGS)))) > 0
    return summary.withColumns({"qc_flags": F.array_join(found, ";"), "qc_status": F.when(hard, "excluded").when(F.size(found) > 0, "flagged").otherwise("accepted")})


def flag_counts(df: DataFrame, column: str, mark: str = ";", most: int = 20) -> DataFrame:
    """flag, rows: the `most` most frequent parts of a joined column, ties by name."""
    parts = df.select(F.explode(F.split(column, mark)).alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count(F.lit(1)).alias("rows"))
    return parts.orderBy(F.desc("rows"), "flag").limit(most)


def pending_reviews(sheet: DataFrame) -> DataFrame:
    """Rows of a segmentation sheet that are not complete: decision, boundary_source, review_required, automatic,
    reviewer, review_date, notes. Automatic exclusions need notes only, by hand each decision needs its reviewer."""
    decision, source = F.upper(F.trim("decision")), F.upper(F.trim("boundary_source"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    auto, excluded, manual = F.col("automatic"), decision == "EXCLUDE", source == "MANUAL"
    by_hand = ~auto & (F.col("review_required") | excluded | manual)
    open_ = reduce(lambda a, b: a | F.coalesce(b, F.lit(True)), [
        ~decision.isin("KEEP", "EXCLUDE"), ((decision == "KEEP") & ~source.isin("AUTO", "MANUAL")) | (excluded & (source != "NONE")), auto & ~(excluded & (source == "NONE")),
        by_hand & (blank("reviewer") | blank("review_date")), ((~auto & (excluded | manual)) | auto) & blank("notes"),
    ], F.lit(False))
    return sheet.where(open_)


def role_durations(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, role of a run-length segment: count, total and longest."""
    length = F.col("end") - F.col("start")
    return segments.groupBy(*keys, "role").agg(F.count(F.lit(1)).alias("segments"), F.sum(length).alias("total"), F.max(length).alias("longest"))


def majority_frames(intervals: DataFrame, spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, frame, speech: frames of `width` from each span's low on; speech where intervals cover half of it or more.
    Only frames that an interval touches are made before the count; the others follow from the span."""
    merged = iv.merged(intervals, keys)
    cut = merged.join(spans, keys).where((F.col("start") < F.col("high")) & (F.col("end") > F.col("low")))
    lo, hi = F.greatest("start", "low") - F.col("low"), F.least("end", "high") - F.col("low")
    cut = cut.select(*keys, lo.alias("a"), hi.alias("b")).withColumn("frame", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))))
    inside = F.least(F.col("b"), (F.col("frame") + 1) * width) - F.greatest(F.col("a"), F.col("frame") * width)
    covered = cut.groupBy(*keys, "frame").agg(F.sum(inside).alias("covered"))
    every = spans.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low") - 1) / width))).alias("frame"))
    return every.join(covered, [*keys, "frame"], "left").select(*keys, "frame", (F.coalesce("covered", F.lit(0)) * 2 >= width).alias("speech"))


def boundary_contrast(frames: DataFrame, bounds: DataFrame, keys: list[str], width: int, guard: int, least: float) -> DataFrame:
    """For each bound (keys, id, t): mean level of the frames within `width` before and behind it, `guard` left free, the
    contrast, and ambiguous where a side has no frame or the contrast is below `least`. Levels of a side are added up in
    falling order of time, so a contrast of just `least` falls on the same side in every run."""
    around = bounds.select(*keys, "id", "t", (F.col("t") - guard - width).alias("start"), (F.col("t") + guard + width).alias("end"))
    near = iv.overlaps(around, frames.select(*keys, F.col("t").alias("start"), (F.col("t") + 1).alias("end"), F.col("t").alias("ft"), "level"), keys, 4 * (guard + width))
    before, behind = F.col("r_ft") < F.col("t") - guard, F.col("r_ft") >= F.col("t") + guard
    side = lambda held: F.sort_array(F.collect_list(F.when(held & F.col("r_level").isNotNull(), F.struct("r_ft", F.col("r_level").cast("double").alias("v")))), False)
    mean = lambda c: F.try_divide(F.aggregate(c, F.lit(0.0), lambda s, x: s + x["v"]), F.size(c))
    out = near.groupBy(*keys, "id").agg(side(before).alias("__b"), side(behind).alias("__a")).select(*keys, "id", mean(F.col("__b")).alias("before"), mean(F.col("__a")).alias("behind"))
    out = bounds.select(*keys, "id").join(out, [*keys, "id"], "left").withColumn("contrast", F.col("behind") - F.col("before"))
    return out.withColumn("ambiguous", F.col("contrast").isNull() | (F.abs("contrast") < least))


def status_missingness(df: DataFrame, statuses: list[str]) -> DataFrame:
    """feature, status, rows, fraction of each status column's values; statuses that begin with ok_ are available."""
    long = df.select(*statuses).unpivot([], statuses, "feature", "status").where("status IS NOT NULL")
    out = long.groupBy("feature", "status").agg(F.count(F.lit(1)).alias("rows"))
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy("feature"))
    return out.select("feature", "status", "rows", share.alias("fraction"), F.col("status").startswith("ok_").alias("available"))


def empirical_summary(df: DataFrame, features: dict[str, str]) -> DataFrame:
    """Per feature: count, extremes, quantiles of available values, and a JSON object of its status counts."""
    long = reduce(lambda a, b: a.unionAll(b), [df.select(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"), F.col(s).alias("s")) for f, s in features.items()])
    levels = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    figures = long.groupBy("feature").agg(F.count("v").alias("available"), F.min("v").alias("least"), F.percentile("v", F.array(*map(F.lit, levels))).alias("q"), F.max("v").alias("most"))
    statuses = long.groupBy("feature", "s").agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n"))))).alias("status_counts"))
    return figures.join(statuses, "feature").select("feature", "available", "least", *[F.col("q")[i].alias(f"p{round(100 * q):02d}") for i, q in enumerate(levels)], "most", "status_counts")


def grouped_availability(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """group, feature, rows, available, fraction, median."""
    long = df.unpivot(group, features, "feature", "value")
    return long.groupBy(group, "feature").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("available"), (F.count("value") / F.count(F.lit(1))).alias("fraction"), F.percentile("value", 0.5).alias("median"))


def challenge_audit(grid: DataFrame, cells: list[str]) -> DataFrame:
    """Per cell of known-truth rows (detected, tp, fp, fn): rows, sensitivity with Wilson bounds, micro precision and
    recall; a row ALL for everything."""
    named = [F.col(c).cast("string").alias(c) for c in cells]
    out = grid.select(*named, "detected", "tp", "fp", "fn").groupingSets([tuple(cells), ()], *cells).agg(F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("rows"), F.count_if("detected").alias("hits"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    low, high = wilson(F.col("hits").cast("double"), F.col("rows").cast("double"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    names = [F.when(F.col("__g") > 0, "ALL").otherwise(F.col(c)).alias(c) for c in cells]
    return out.select(*names, "rows", (F.col("hits") / F.col("rows")).alias("sensitivity"), low.alias("low"), high.alias("high"), share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def deletion_summary(changes: DataFrame, keys: list[str], change: str) -> DataFrame:
    """Per key: deletions, how many left a value, median, 90th percentile and largest absolute change."""
    x = F.abs(F.col(change))
    return changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("deletions"), (F.count(change) / F.count(F.lit(1))).alias("retained"), F.percentile(x, 0.5).alias("median"), F.percentile(x, 0.9).alias("p90"), F.max(x).alias("most"))


def within_horizons(boundaries: DataFrame, key: str, value: str, horizons: list[float], least: int) -> DataFrame:
    """key, horizon, boundaries, mean of the values cut at each horizon; NULL below `least` boundaries."""
    long = boundaries.where(F.col(value).isNotNull()).select(key, value, F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    out = long.groupBy(key, "horizon").agg(F.count(F.lit(1)).alias("boundaries"), F.avg(F.least(value, "horizon")).alias("__m"))
    return out.select(key, "horizon", "boundaries", F.when(F.col("boundaries") >= least, F.col("__m")).alias("mean"))


def histogram(df: DataFrame, value: str, bins: int, high: float) -> DataFrame:
    """bin, rows over `bins` equal bins of [0, high]; high itself falls in the last, values outside in none."""
    x = F.col(value)
    place = F.least(F.floor(x / high * bins), F.lit(bins - 1)).cast("int")
    return df.where(x.between(0, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def rank_strata(df: DataFrame, value: str, tie: str, q: int) -> Column:
    """Stratum 0 to q - 1 of each row by its rank, ties by `tie`, cut at quantiles of the ranks."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.orderBy(value, tie))
    return F.greatest(F.ceil((rank - 1) * q / (n - 1)) - 1, F.lit(0)).cast("int")


def shares(df: DataFrame, group: list[str], part: str) -> DataFrame:
    """group, part, rows, share of the group's rows."""
    out = df.groupBy(*group, part).agg(F.count(F.lit(1)).alias("rows"))
    return out.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(*group)))


def extent_consensus(ratings: DataFrame, item: str, values: list[str], expected: int, least: int) -> DataFrame:
    """item, raters, complete, and the median of each value where at least `least` raters gave one."""
    columns = [F.when(F.count(v) >= least, F.percentile(v, 0.5)).alias(v) for v in values]
    return ratings.groupBy(item).agg(F.countDistinct("rater").alias("raters"), (F.countDistinct("rater") >= expected).alias("complete"), *columns)


def winners(df: DataFrame, winner: str, eligible: Column) -> DataFrame:
    """winner, rows, eligible rows and their share of all eligible ones."""
    out = df.groupBy(winner).agg(F.count(F.lit(1)).alias("rows"), F.count_if(eligible).alias("eligible"))
    total = df.agg(F.count_if(eligible).alias("__n"))
    return out.join(F.broadcast(total)).withColumn("share", F.when(F.col("__n") > 0, F.col("eligible") / F.col("__n"))).drop("__n")


def capped(df: DataFrame, keys: list[str], score: str, tie: str, most: int) -> DataFrame:
    """The `most` best rows of each key with the true count of all of them beside."""
    w = Window.partitionBy(*keys)
    out = df.withColumns({"__k": F.row_number().over(w.orderBy(F.desc(score), tie)), "true_count": F.count(F.lit(1)).over(w)})
    return out.where(F.col("__k") <= most).drop("__k")


def disagreement(df: DataFrame) -> DataFrame:
    """df(low, high, agreement, ac1) with priority: range, lack of agreement, half the lack of chance-corrected agreement."""
    return df.withColumn("priority", (F.col("high") - F.col("low")) + (1 - F.col("agreement")) + (1 - F.col("ac1")) / 2)


def occurrence_agreement(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """One row on pairs of booleans: the four cells, positive and negative agreement, kappa."""
    a, b = F.col(first), F.col(second)
    t = pairs.agg(*[F.count_if(c).cast("double").alias(n) for n, c in (("both", a & b), ("first_only", a & ~b), ("second_only", ~a & b), ("neither", ~a & ~b))])
    n = F.col("both") + F.col("first_only") + F.col("second_only") + F.col("neither")
    off = F.col("first_only") + F.col("second_only")
    ratio = lambda x, y: F.when(y > 0, x / y)
    p1, p2 = (F.col("both") + F.col("first_only")) / n, (F.col("both") + F.col("second_only")) / n
    chance = p1 * p2 + (1 - p1) * (1 - p2)
    kappa = F.when((n > 0) & (chance < 1), ((F.col("both") + F.col("neither")) / n - chance) / (1 - chance))
    return t.withColumns({"positive_agreement": ratio(2 * F.col("both"), 2 * F.col("both") + off), "negative_agreement": ratio(2 * F.col("neither"), 2 * F.col("neither") + off), "kappa": kappa})


def margins(df: DataFrame, criteria: dict[str, tuple[str, float, bool]], stratum: str) -> DataFrame:
    """criterion, stratum, rows, passed, least and median margin; criteria: name to (column, limit, at least)."""
    parts = [F.struct(F.lit(n).alias("criterion"), ((F.col(c) - limit) if above else (limit - F.col(c))).cast("double").alias("margin")) for n, (c, limit, above) in criteria.items()]
    long = df.select(stratum, F.explode(F.array(*parts)).alias("x")).select(stratum, "x.*").where("margin IS NOT NULL")
    return long.groupBy("criterion", stratum).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("margin") >= 0).alias("passed"), F.min("margin").alias("least"), F.percentile("margin", 0.5).alias("median"))


def one_factor_variants(spark, base: dict[str, float], factors: dict[str, list[float]]) -> DataFrame:
    """variant, changed, and a column for each parameter: the base and each setting with one of them changed."""
    rows = [("base", "none", *base.values())]
    rows += [(f"{k}={v:g}", k, *({**base, k: v}).values()) for k, vs in factors.items() for v in vs]
    return spark.createDataFrame([tuple(float(x) if i > 1 else x for i, x in enumerate(r)) for r in rows], "variant string, changed string, " + ", ".join(f"{k} double" for k in base))


def variant_robustness(df: DataFrame, variants: DataFrame, key: str, statistic: Column, accepted: Column) -> DataFrame:
    """variant, rows, accepted, positives, and how many keys change against the base. df meets each of the few settings
    once: statistic and accepted read df's columns and the setting's."""
    # A stated grid of settings against all rows, not pairs of rows.
    rows = df.join(F.broadcast(variants)).select("variant", key, F.coalesce(accepted, F.lit(False)).alias("ok"), statistic.alias("x"))
    per = rows.groupBy("variant", key).agg(F.bool_or("ok").alias("positive"), F.count_if("ok").alias("accepted"), F.sum(F.when(F.col("ok"), F.col("x"))).alias("total"))
    base = per.where("variant = 'base'").select(key, F.col("positive").alias("was"))
    return per.join(base, key).groupBy("variant").agg(F.count(F.lit(1)).alias("keys"), F.sum("accepted").alias("accepted"), F.count_if("positive").alias("positives"), F.count_if(F.col("positive") != F.col("was")).alias("changed"))
