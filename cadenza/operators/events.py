"""Events: shifting, merging, precedence, non-maximum suppression, recording-level unions, one-to-one matches, rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv
from .joins import assign


def shifted(df: DataFrame, by: float) -> DataFrame:
    """Intervals moved by a constant."""
    return df.withColumns({"start": F.col("start") + by, "end": F.col("end") + by})


def near_any(points: DataFrame, df: DataFrame, keys: list[str], guard: float, width: float) -> DataFrame:
    """Points (keys, id, t) with near: whether an interval, widened by guard on both sides and closed, holds t."""
    wide = df.select(*keys, (F.col("start") - guard).alias("start"), (F.col("end") + guard + 1).alias("end"))
    return iv.members(points, wide, keys, width).withColumn("near", F.col("inside") > 0).drop("inside")


def merged_of_a_kind(df: DataFrame, keys: list[str], kinds: list[str], gap: float) -> DataFrame:
    """Runs of events that follow one another in time, agree in `kinds` and lie `gap` apart at most: start, end, merged."""
    w = Window.partitionBy(*keys).orderBy("start", "end", *kinds)
    same = F.lit(True)
    for k in kinds:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    rows = df.withColumn("__new", F.when(same, 0).otherwise(1))
    rows = rows.withColumn("__stretch", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy(*keys, "__stretch").orderBy("start", "end")
    before = F.max("end").over(v.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__cut", F.when(before.isNull() | (F.col("start") - before > gap), 1).otherwise(0))
    rows = rows.withColumn("__group", F.sum("__cut").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, *kinds, "__stretch", "__group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("merged")).drop("__stretch", "__group")


def suppressed(df: DataFrame, keys: list[str], distance: float, most: int, at: str = "t", score: str = "score", tie: str = "id") -> DataFrame:
    """Non-maximum suppression: by falling score, ties by `tie`, an event stays if it lies `distance` or more from all that
    stay, `most` at the most for each key. Keys are sorted into order by Spark; a task holds only those kept of one key."""
    columns = [*keys, tie, at, score]
    rows = df.select(*columns).where(f"{at} IS NOT NULL AND {score} IS NOT NULL")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc(score), tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, np.zeros(0)
        for batch in batches:
            mask = np.zeros(batch.num_rows, dtype=bool)
            names = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))], strict=True))
            for i, (k, t) in enumerate(zip(names, batch.column(len(keys) + 1).to_pylist(), strict=True)):
                if k != key:
                    key, kept = k, np.zeros(0)
                # kept is sorted, so only its two neighbours matter.
                p = int(np.searchsorted(kept, t))
                if len(kept) < most and (p == 0 or t - kept[p - 1] >= distance) and (p == len(kept) or kept[p] - t >= distance):
                    kept, mask[i] = np.insert(kept, p, t), True
            yield batch.filter(pa.array(mask))

    return rows.mapInArrow(run, rows.schema)


def arbitrated(candidates: DataFrame, keys: list[str], precedence: list[tuple[str, str, float]], width: float) -> DataFrame:
    """Candidates (keys, id, kind, start, end, disposition) with disposition, reason and arbitrated after precedence rules in
    order: (loser, winner, guard) rejects a loser that lies within guard of an accepted winner of its keys. A guard of 0
    asks for an overlap, which one without length has where it lies strictly inside the other. Rules read dispositions as
    they were when the rule before had been applied."""
    out = candidates.withColumns({"reason": F.lit(""), "arbitrated": F.lit(False)})
    for loser, winner, guard in precedence:
        strong = out.where((F.col("kind") == winner) & (F.col("disposition") == "accepted")).select(*keys, (F.col("start") - guard).alias("start"), (F.col("end") + guard).alias("end"))
        weak = out.where((F.col("kind") == loser) & F.col("disposition").isin("accepted", "indeterminate")).select(*keys, "id", "start", F.greatest(F.col("end"), F.col("start") + 1).alias("end") if guard else "end")
        hit = iv.overlaps(weak, strong, keys, width, points=not guard).select("id").distinct().withColumn("__hit", F.lit(True))
        out = out.join(hit, "id", "left")
        said = F.coalesce("__hit", F.lit(False))
        out = out.withColumns({"disposition": F.when(said, "rejected").otherwise(F.col("disposition")), "reason": F.when(said, F.concat(F.lit("near_accepted_"), F.lit(winner))).otherwise(F.col("reason")), "arbitrated": F.col("arbitrated") | said}).drop("__hit")
    return out


def recording_events(accepted: DataFrame, keys: list[str], tolerance: dict[str, float]) -> DataFrame:
    """Accepted candidates of channels (keys, id, kind, channel, start, end, score) as events of the recording: candidates
    of one kind that lie within its tolerance make one event. span is its whole extent, support the union of its parts;
    ids and channels are joined by |, the parts a JSON list."""
    gap = F.create_map(*[x for k, v in tolerance.items() for x in (F.lit(k), F.lit(v))])
    w = Window.partitionBy(*keys, "kind").orderBy("start", "end", "channel", "id")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = accepted.withColumn("__cut", F.when(before.isNull() | (F.col("start") > before + F.coalesce(gap[F.col("kind")], F.lit(0))), 1).otherwise(0))
    rows = rows.withColumn("event", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__cut")
    group = [*keys, "kind", "event"]
    parts = iv.merged(rows.select(*group, "start", "end"), group)
    support = parts.groupBy(*group).agg(F.sum(F.col("end") - F.col("start")).alias("support"), F.to_json(F.array_sort(F.collect_list(F.array("start", "end")))).alias("parts"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "channel", "id"))), lambda x: x["id"].cast("string")), "|")
    out = rows.groupBy(*group).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.count(F.lit(1)).alias("candidates"), ids.alias("candidate_ids"), F.array_join(F.array_sort(F.collect_set(F.col("channel").cast("string"))), "|").alias("channels"))
    return out.join(support, group).withColumn("span", F.col("end") - F.col("start"))


def event_rates(events: DataFrame, exposure: DataFrame, keys: list[str], kinds: list[str], unit: float) -> DataFrame:
    """Per recording of exposure(keys, eligible) and kind: events, rate per `unit` of eligible time and share of it that
    events cover; zeros where there is none, NULL without eligible time."""
    counted = events.where(F.col("kind").isin(*kinds)).groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("events"), F.sum("support").alias("__s"))
    every = exposure.select(*keys, "eligible", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    out = every.join(counted, [*keys, "kind"], "left").fillna(0, ["events", "__s"])
    some = F.col("eligible") > 0
    return out.select(*keys, "kind", "events", F.when(some, F.col("events") * unit / F.col("eligible")).alias("rate"), F.when(some, F.col("__s") / F.col("eligible")).alias("fraction"))


def local_transitions(frames: DataFrame, keys: list[str], order: list[str], context: int, least: float, effect: float) -> DataFrame:
    """Frames at which the median level of the `context` frames from it on differs from that of the frames before by more
    than `least` and than `effect` robust spreads of both around their medians. For audit only."""
    w = Window.partitionBy(*keys).orderBy(*order)
    mid = lambda c: (F.get(F.array_sort(c), F.lit((context - 1) // 2)) + F.get(F.array_sort(c), F.lit(context // 2))) / 2
    rows = frames.withColumns({"__pre": F.collect_list("level").over(w.rowsBetween(-context, -1)), "__post": F.collect_list("level").over(w.rowsBetween(0, context - 1))})
    rows = rows.where((F.size("__pre") == context) & (F.size("__post") == context)).withColumns({"pre_level": mid(F.col("__pre")), "post_level": mid(F.col("__post"))})
    off = F.array_sort(F.concat(F.transform("__pre", lambda x: F.abs(x - F.col("pre_level"))), F.transform("__post", lambda x: F.abs(x - F.col("post_level")))))
    rows = rows.withColumn("__off", off)
    spread = F.greatest(F.lit(0.25), 1.4826 * (F.get("__off", F.lit(context - 1)) + F.get("__off", F.lit(context))) / 2)
    rows = rows.withColumns({"step": F.col("post_level") - F.col("pre_level"), "spread": spread})
    return rows.where(F.abs("step") >= F.greatest(F.lit(least), effect * F.col("spread"))).select(*keys, *order, "pre_level", "post_level", "step", "spread")


def matched_one_to_one(a: DataFrame, b: DataFrame, key: str, mode: str, tolerance: float) -> DataFrame:
    """key, a_start, a_end, b_start, b_end: the assignment of events of one key with the most pairs and, of those, the
    least sum of onset and offset differences. mode "strict" asks that both differ by `tolerance` at most, "overlap" that
    the events overlap. Events of one key are one recording's annotations by one rater."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, left, right in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x = np.array(sorted((e["start"], e["end"]) for e in left), dtype=float).reshape(-1, 2)
                y = np.array(sorted((e["start"], e["end"]) for e in right), dtype=float).reshape(-1, 2)
                if not len(x) or not len(y):
                    continue
                off = np.abs(x[:, None, :] - y[None, :, :])
                if mode == "strict":
                    ok = (off <= tolerance).all(2)
                else:
                    ok = np.minimum(x[:, None, 1], y[None, :, 1]) > np.maximum(x[:, None, 0], y[None, :, 0])
                cost = np.where(ok, off.sum(2), 1e15)
                out += [(k, *x[i].tolist(), *y[j].tolist()) for i, j in assign(cost) if ok[i, j]]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), *[pa.array(c, pa.float64()) for c in cols[1:]]], [key, "a_start", "a_end", "b_start", "b_end"])

    pack = lambda d, n: d.groupBy(key).agg(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))).alias(n))
    both = pack(a, "x").join(pack(b, "y"), key)
    return both.mapInArrow(kernel, f"{key} {a.schema[key].dataType.simpleString()}, a_start double, a_end double, b_start double, b_end double")


def match_summary(matches: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: matches, events of both sides, F1, median absolute onset and offset difference and overlap over union of
    the matches, Dice of covered time."""
    overlap = F.greatest(F.least("a_end", "b_end") - F.greatest("a_start", "b_start"), F.lit(0.0))
    union = F.greatest("a_end", "b_end") - F.least("a_start", "b_start")
    m = matches.agg(F.count(F.lit(1)).alias("matches"), F.percentile(F.abs(F.col("a_start") - F.col("b_start")), 0.5).alias("median_onset"), F.percentile(F.abs(F.col("a_end") - F.col("b_end")), 0.5).alias("median_offset"), F.percentile(overlap / union, 0.5).alias("median_iou"))
    x, y = iv.merged(a, [key]), iv.merged(b, [key])
    length = lambda d, n: d.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias(n))
    sizes = a.agg(F.count(F.lit(1)).alias("a_events")).join(F.broadcast(b.agg(F.count(F.lit(1)).alias("b_events"))))
    both = iv.overlaps(x.drop("n"), y.drop("n"), [key], 3.6e9 * 48)
    covered = both.agg(F.coalesce(F.sum(F.col("both_end") - F.col("both_start")), F.lit(0)).alias("__both"))
    out = m.join(F.broadcast(sizes)).join(F.broadcast(covered)).join(F.broadcast(length(x, "__x"))).join(F.broadcast(length(y, "__y")))
    return out.select("matches", "a_events", "b_events", F.try_divide(2.0 * F.col("matches"), F.col("a_events") + F.col("b_events")).alias("f1"), "median_onset", "median_offset", "median_iou", F.try_divide(2.0 * F.col("__both"), F.col("__x") + F.col("__y")).alias("dice"))


def with_overlap(df: DataFrame, others: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Intervals (keys, id, start, end) with the length that others' union covers of each."""
    pair = iv.overlaps(df, iv.merged(others, keys).drop("n"), keys, width)
    covered = pair.groupBy("id").agg(F.sum(F.col("both_end") - F.col("both_start")).alias("covered"))
    return df.join(covered, "id", "left").fillna(0, ["covered"])


def eligible_support(df: DataFrame, keys: list[str], least: Column | float) -> DataFrame:
    """Per key: intervals of `least` length or more, and their total length."""
    long = F.col("end") - F.col("start") >= least
    return df.groupBy(*keys).agg(F.count_if(long).alias("intervals"), F.coalesce(F.sum(F.when(long, F.col("end") - F.col("start"))), F.lit(0)).alias("exposure"))
