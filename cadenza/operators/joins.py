"""Joins with contracts: cardinality guards, coverage, nearest and as-of matches, optimal one-to-one matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tasks that the matching of recordings is dealt over.
TASKS = 96


def _unique(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    rows = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    fine = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{side} side of the join repeats a key")).cast("boolean"))
    return rows.where(fine).drop("__n")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join that fails when a side that must be unique repeats a key. The check shares the join's partitioning."""
    if validate in ("one_to_one", "one_to_many"):
        left = _unique(left, keys, "left")
    if validate in ("one_to_one", "many_to_one"):
        right = _unique(right, keys, "right")
    return left.join(right, keys, how)


def coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of either side with left_only, right_only or both."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(True))
    status = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return a.join(b, keys, "full_outer").withColumn("coverage", status).drop("__l", "__r")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with right's value at the last place not after its own, through one window over both sides."""
    a = left.withColumns({"__side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*keys, at, value).withColumn("__side", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last(value, True).over(w)).where("__side = 1").drop("__side")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tolerance: float) -> DataFrame:
    """left with right's value nearest to its place within tolerance, the earlier of equals; columns near_<at>, <value>.

    Last before and first after come from one window, so no pair of rows is formed."""
    carry = F.struct(F.col(at).alias("at"), F.col(value).alias("v"))
    a = left.withColumns({"__side": F.lit(1), "__c": F.lit(None).cast(right.select(carry.alias("c")).schema["c"].dataType)})
    b = right.select(*keys, at, carry.alias("__c")).withColumn("__side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at)
    # Ranges: rows at the same place are seen from both sides.
    before = F.last("__c", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("__c", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    rows = both.withColumns({"__b": before, "__a": after}).where("__side = 1")
    db, da = F.col(at) - F.col("__b.at"), F.col("__a.at") - F.col(at)
    pick = F.when(F.col("__b").isNull() | (da < db), F.col("__a")).otherwise(F.col("__b"))
    rows = rows.withColumn("__p", pick)
    near = F.abs(F.col(at) - F.col("__p.at")) <= tolerance
    return rows.select(*left.columns, F.when(near, F.col("__p.at")).alias(f"near_{at}"), F.when(near, F.col("__p.v")).alias(value))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of an assignment of least total cost between rows and columns, all of the smaller side used."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            used[j0] = True
            reduced = c[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            open_ = np.where(used[1:], np.inf, least[1:])
            j1 = int(open_.argmin()) + 1
            delta = open_[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][~used[1:]] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


def _overlap_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, rows of b and IoU of the pairs of two sorted sets of intervals that overlap."""
    low, high = np.searchsorted(np.maximum.accumulate(b[:, 1]), a[:, 0], "right"), np.searchsorted(b[:, 0], a[:, 1], "left")
    many = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(a)), many)
    j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + low[i]
    overlap = np.maximum(np.minimum(a[i, 1], b[j, 1]) - np.maximum(a[i, 0], b[j, 0]), 0)
    total = (a[i, 1] - a[i, 0]) + (b[j, 1] - b[j, 0]) - overlap
    keep = overlap > 0
    return i[keep], j[keep], (overlap / np.where(total > 0, total, 1))[keep]


def _best_scores(a: np.ndarray, b: np.ndarray, least: float) -> list[float]:
    """Scores of the assignment with the largest sum of scores of `least` or more. Sets of intervals that no
    such pair links are solved apart, so the work follows the overlaps and not the square of a recording."""
    i, j, score = _overlap_pairs(a, b)
    if least <= 0:
        table = np.zeros((len(a), len(b)))
        table[i, j] = score
        return [float(table[p, q]) for p, q in assign(-table)]
    keep = score >= least
    i, j, score = i[keep], j[keep], score[keep]
    alone = (np.bincount(i, minlength=len(a))[i] == 1) & (np.bincount(j, minlength=len(b))[j] == 1)
    hits = score[alone].tolist()
    linked: dict[tuple[int, int], list[int]] = {}
    for k in np.flatnonzero(~alone).tolist():
        linked.setdefault((0, int(i[k])), []).append(k)
        linked.setdefault((1, int(j[k])), []).append(k)
    while linked:
        open_, own = [next(iter(linked))], set()
        while open_:
            for k in linked.pop(open_.pop(), ()):
                own.add(k)
                open_ += [(0, int(i[k])), (1, int(j[k]))]
        own = np.array(sorted(own))
        rows, x = np.unique(i[own], return_inverse=True)
        columns, y = np.unique(j[own], return_inverse=True)
        table = np.zeros((len(rows), len(columns)))
        table[x, y] = score[own]
        hits += [float(table[p, q]) for p, q in assign(-table) if table[p, q] >= least]
    return hits


def match_events(truth: DataFrame, found: DataFrame, key: str, least_iou: float = 0.5) -> DataFrame:
    """Per key: optimal one-to-one matching of events (start, end) on IoU, counting matches of least_iou or more:
    matched, n_truth, n_found, precision, recall, f1, median_iou. A key's events are those of one recording; keys are
    dealt over TASKS tasks whatever their size in bytes, since the work is in the matching."""
    event = F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("side"))
    rows = truth.select(key, "start", "end", F.lit(0).alias("side")).unionByName(found.select(key, "start", "end", F.lit(1).alias("side")))
    both = rows.repartition(TASKS, key).groupBy(key).agg(F.collect_list(event).alias("l"))
    names = ["matched", "n_truth", "n_found", "precision", "recall", "f1", "median_iou"]
    kind = truth.schema[key].dataType.simpleString()

    def one(events: np.ndarray) -> tuple:
        events = events[np.lexsort((events[:, 1], events[:, 0]))]
        a, b = events[events[:, 2] == 0, :2], events[events[:, 2] == 1, :2]
        hits = _best_scores(a, b, least_iou) if len(a) and len(b) else []
        k = len(hits)
        return k, len(a), len(b), k / len(b) if len(b) else None, k / len(a) if len(a) else None, 2 * k / (len(a) + len(b)), float(np.median(hits)) if hits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            events = lists.flatten()
            table = np.column_stack([events.field(c).to_numpy(zero_copy_only=False).astype(float) for c in range(3)])
            ends = ends - ends[0]
            found = list(zip(*[one(table[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)], strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64() if n < 3 else pa.float64()) for n, c in enumerate(found)]], [key, *names])

    return both.mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} {'long' if n < 3 else 'double'}" for n, c in enumerate(names)))
