"""Interval algebra over rows (key..., start, end), half-open, one set of intervals for each key.

All operators are windows or equi-joins on the key; no interval set is gathered into one value. Bounds may be integers
(samples, microseconds) or doubles (seconds). Empty or NULL intervals are dropped, NULL keys form a key of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tasks that keys are dealt over where one set of intervals is merged in several ways.
TASKS = 96


def _order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("start", "end")


def clipped(df: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Intervals cut to [low, high), without those that end up empty."""
    start = F.col("start") if low is None else F.greatest("start", low)
    end = F.col("end") if high is None else F.least("end", high)
    return df.withColumns({"start": start, "end": end}).where("end > start")


def merged(df: DataFrame, keys: list[str], gap: float | Column = 0) -> DataFrame:
    """Islands: intervals that overlap, touch or lie at most `gap` apart become one; n counts their parts."""
    w = _order(keys)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    marked = df.where("end > start").withColumn("__new", F.when(reach.isNull() | (F.col("start") - reach > gap), 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("__island")


def union_length(df: DataFrame, keys: list[str]) -> DataFrame:
    """key, length of the union, islands."""
    return merged(df, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("length"), F.count(F.lit(1)).alias("islands"))


def bridged(df: DataFrame, keys: list[str], gap: float, least: float) -> DataFrame:
    """Gaps up to `gap` closed, then islands of at least `least` kept."""
    return merged(df, keys, gap).where(F.col("end") - F.col("start") >= least)


def eroded(df: DataFrame, edge: float, least: float | None = None) -> DataFrame:
    """Both edges cut by `edge`. Without `least` what has no length left goes; with it, what is shorter goes."""
    out = df.withColumns({"start": F.col("start") + edge, "end": F.col("end") - edge})
    return out.where("end > start") if least is None else out.where((F.col("end") - F.col("start") >= least) & (F.col("end") > F.col("start")))


def merged_then_guarded(df: DataFrame, keys: list[str], guard: float) -> DataFrame:
    return eroded(merged(df, keys), guard)


def guarded_then_merged(df: DataFrame, keys: list[str], guard: float) -> DataFrame:
    return merged(eroded(df, guard), keys)


def gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between consecutive islands."""
    w = _order(keys)
    out = merged(df, keys).select(*keys, F.col("end").alias("__s"), F.lead("start").over(w).alias("__e"))
    return out.where("__e > __s").select(*keys, F.col("__s").alias("start"), F.col("__e").alias("end"))


def complement(df: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """What spans(key, low, high), one row a key, leave free, edges included; all of a span without intervals."""
    inside = df.join(spans, keys).withColumns({"start": F.greatest("start", "low"), "end": F.least("end", "high")}).where("end > start").select(*keys, "start", "end")
    edges = spans.select(*keys, F.explode(F.array(F.struct(F.col("low").alias("start"), F.col("low").alias("end")), F.struct(F.col("high").alias("start"), F.col("high").alias("end")))).alias("x")).select(*keys, "x.start", "x.end")
    both = merged(inside, keys).select(*keys, "start", "end").union(edges)
    w = _order(keys)
    out = both.select(*keys, F.max("end").over(w).alias("__s"), F.lead("start").over(w).alias("__e"))
    return out.where("__e > __s").select(*keys, F.col("__s").alias("start"), F.col("__e").alias("end"))


def _binned(df: DataFrame, width: float) -> DataFrame:
    lo, hi = F.floor(F.col("start") / width), F.ceil(F.col("end") / width) - 1
    return df.withColumn("__bin", F.explode(F.sequence(lo.cast("long"), F.greatest(lo, hi).cast("long"))))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: float, points: bool = False) -> DataFrame:
    """Pairs of overlapping intervals of one key: columns of left, those of right prefixed r_, common start and end as
    both_start, both_end. Intervals are dealt over bins of `width`, so a long recording does not meet itself in one
    place; a pair is reported in the bin where its overlap begins. With `points` an interval without length counts where
    it lies strictly inside the other."""
    a = _binned(left, width)
    b = _binned(right, width).select(*keys, "__bin", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    both = a.join(b, [*keys, "__bin"]).withColumns({"both_start": F.greatest("start", "r_start"), "both_end": F.least("end", "r_end")})
    held = "start < r_end AND r_start < end" if points else "both_end > both_start"
    return both.where(held).where(F.floor(F.col("both_start") / width) == F.col("__bin")).drop("__bin")


def intersected(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """The intersection of two sets, both merged first."""
    pair = overlaps(merged(left, keys).drop("n"), merged(right, keys).drop("n"), keys, width)
    return pair.select(*keys, F.col("both_start").alias("start"), F.col("both_end").alias("end"))


def members(points: DataFrame, df: DataFrame, keys: list[str], width: float, at: str = "t") -> DataFrame:
    """points with the number of intervals that hold them, [start, end)."""
    bins = _binned(df.where("end > start").select(*keys, "start", "end"), width)
    held = points.withColumn("__bin", F.floor(F.col(at) / width).cast("long"))
    both = held.join(bins.alias("i"), [*keys, "__bin"], "left").withColumn("__in", F.coalesce((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end")), F.lit(False)))
    return both.groupBy(*points.columns).agg(F.sum(F.col("__in").cast("long")).alias("inside"))


def nearest_boundary(points: DataFrame, df: DataFrame, keys: list[str], at: str = "t") -> DataFrame:
    """points with the distance to the nearest interval edge of their key, found from the last edge before and the first
    after in one window; NULL where the key has none."""
    edges = df.select(*keys, F.explode(F.array("start", "end")).alias(at)).distinct().select(*keys, at, F.col(at).alias("__edge"))
    both = points.withColumn("__edge", F.lit(None).cast(edges.schema["__edge"].dataType)).withColumn("__point", F.lit(True)).unionByName(edges, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at)
    # Ranges, not rows: an edge at the very place of a point counts from both sides.
    before = F.last("__edge", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("__edge", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return both.withColumn("distance", F.least(F.col(at) - before, after - F.col(at))).where("__point").drop("__edge", "__point")


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    both = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    return F.when(both > 0, both / ((e1 - s1) + (e2 - s2) - both)).otherwise(F.lit(0.0))


def pause_boundaries(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each pause: end of the island before, start of the one after, their numbers from 0."""
    w = _order(keys)
    rows = merged(df, keys).withColumn("left_index", F.row_number().over(w) - 1).withColumn("next_start", F.lead("start").over(w))
    return rows.where("next_start IS NOT NULL").select(*keys, "left_index", (F.col("left_index") + 1).alias("right_index"), F.col("end").alias("offset"), F.col("next_start").alias("onset"), (F.col("next_start") - F.col("end")).alias("pause"))


def shifted_offsets(df: DataFrame, keys: list[str], shift: float, least: float, apart: float) -> DataFrame:
    """Ends of islands moved by `shift`, kept `least` after their start and `apart` before the next; the last stays."""
    w = _order(keys)
    rows = merged(df, keys).withColumn("__next", F.lead("start").over(w))
    moved = F.greatest(F.least(F.col("end") + shift, F.col("__next") - apart), F.col("start") + least)
    return rows.withColumn("end", F.when(F.col("__next").isNull(), F.col("end")).otherwise(moved)).drop("__next", "n")


def segmentation_views(df: DataFrame, keys: list[str], bridge: float, least: float, speech_edge: float, pause_edge: float) -> DataFrame:
    """Four views of detected speech in one table, never pooled: raw, primary (bridged), strict (eroded primary) and
    strict pauses (eroded gaps of primary). Keys are dealt over TASKS tasks once, for all views."""
    df = df.repartition(TASKS, *keys)
    primary = bridged(df, keys, bridge, least).select(*keys, "start", "end")
    parts = {
        "raw_speech": merged(df, keys).select(*keys, "start", "end"),
        "primary_speech": primary,
        "strict_speech": eroded(primary, speech_edge),
        "strict_internal_nonspeech": eroded(gaps(primary, keys), pause_edge),
    }
    out = None
    for view, rows in parts.items():
        rows = rows.select(*keys, F.lit(view).alias("view"), "start", "end")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("interval_index", F.row_number().over(Window.partitionBy(*keys, "view").orderBy("start")) - 1)


def touched_frames(df: DataFrame, keys: list[str], length: int, frames: Column | None = None) -> DataFrame:
    """Distinct numbers of the frames of `length` that intervals touch; of complete frames only if their count is given."""
    lo, hi = F.floor(F.col("start") / length), F.floor((F.col("end") - 1) / length)
    rows = df.where("end > start").select(*keys, F.explode(F.sequence(lo.cast("long"), hi.cast("long"))).alias("frame"), *([frames.alias("__n")] if frames is not None else []))
    return (rows.where("frame < __n").drop("__n") if frames is not None else rows).distinct()


def refractory_best(df: DataFrame, keys: list[str], distance: float, at: str = "t", score: str = "score") -> DataFrame:
    """Points merged in time order: one within `distance` of the last kept competes with it and the better score stays,
    which moves the place that the next is measured from. One pass over each key's points as Spark sorts them; a task
    holds one point."""
    rows = df.select(*keys, at, score).repartition(*keys).sortWithinPartitions(*keys, at, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None
        for batch in batches:
            out, schema = [], batch.schema
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held is not None and held[:-2] == row[:-2] and row[-2] - held[-2] <= distance:
                    if row[-1] > held[-1]:
                        held = row
                    continue
                if held is not None:
                    out.append(held)
                held = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema.names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(held, schema, strict=True)], schema.names)

    return rows.mapInArrow(run, rows.schema)
