"""Cluster bootstraps in tasks of a few replicates each: a task draws its own replicates whole, holds a weight of a byte for
each cluster of each, and reads all rows once, in pieces. No table of replicates times clusters or rows is formed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .ranks import value_bin

#: Tasks that the replicates are dealt over.
GROUPS = 24
#: Draws hashed at once.
BLOCK = 16_384

_SHIFT = ([7, 12, 17, 22] * 4, [5, 9, 14, 20] * 4, [4, 11, 16, 23] * 4, [6, 10, 15, 21] * 4)
_SINE = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_PIECE = "phase int, at double, seq long, n long, i binary, fresh binary, v binary, x binary"


def _md5_head(words: list) -> np.ndarray:
    """The first six bytes, as a number, of the MD5 of messages of one block: its sixteen words, each an array or, where all
    messages agree, a number."""
    size = next(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(size, x, np.uint32) for x in _START)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(64):
        turn, j = divmod(i, 16)
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words[(j, 5 * j + 1, 3 * j + 5, 7 * j)[turn] % 16]
        f += a
        if isinstance(word, np.ndarray):
            f += word
            word = 0
        f += np.uint32((_SINE[i] + word) % 2**32)
        by = _SHIFT[turn][j]
        np.right_shift(f, np.uint32(32 - by), out=t), np.left_shift(f, np.uint32(by), out=f), np.bitwise_or(f, t, out=f)
        # The old a holds the next b.
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    a, b = (a + np.uint32(_START[0])).byteswap().astype(np.int64), (b + np.uint32(_START[1])).byteswap()
    return (a << 16) | (b >> np.uint32(16))


def drawn(seed: int, replicate: int, n: int) -> np.ndarray:
    """The clusters, numbers below n, that the n draws of a replicate pick: resample.draw(n, replicate, place)."""
    out = np.empty(n, np.int64)
    prefix = np.frombuffer(f"{seed}|{replicate}|".encode(), np.uint8)
    low = 0
    while low < n:
        digits = len(str(low))
        high = min(n, low + BLOCK, 10**digits)
        message = np.zeros((high - low, 64), np.uint8)
        end = len(prefix) + digits
        message[:, : len(prefix)] = prefix
        place = np.arange(low, high)
        for k in range(digits):
            message[:, end - 1 - k] = place // 10**k % 10 + 48
        message[:, end] = 0x80
        message[:, 56:58] = np.frombuffer((8 * end).to_bytes(2, "little"), np.uint8)
        words = message.view("<u4").T
        varied = range(len(prefix) // 4, (end - 1) // 4 + 1)
        out[low:high] = _md5_head([np.ascontiguousarray(words[j]) if j in varied else int(words[j][0]) for j in range(16)]) % n
        low = high
    return out


def weights(seed: int, replicate: int, n: int) -> np.ndarray:
    """How often a replicate draws each of n clusters; replicate -1 is the sample itself."""
    if replicate < 0:
        return np.ones(n, np.uint8)
    counts = np.bincount(drawn(seed, replicate, n), minlength=n)
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


class Sums:
    """Weighted sums of columns, in any order of rows."""

    def __init__(self, w: np.ndarray, width: int):
        self.w, self.total = w, np.zeros(width)

    def feed(self, phase: int, i: np.ndarray, fresh: np.ndarray, v: np.ndarray, x: np.ndarray) -> None:
        self.total += x.reshape(-1, len(i)) @ self.w[i].astype(float)

    def result(self) -> list:
        return self.total.tolist()


class Ranked:
    """Sums n, a, b, ab, aa, bb of weighted average ranks a of a value and of b: phase 0 brings the rows that b ranks, in
    order, with counts, phase 1 all rows in order of a. Without a phase 0 b is the other value itself."""

    def __init__(self, w: np.ndarray, ranked: bool):
        self.w, self.ranked, self.ties, self.rank = w, ranked, [], None
        self.below, self.open, self.total = 0.0, np.zeros(2), np.zeros(6)

    def feed(self, phase: int, i: np.ndarray, fresh: np.ndarray, v: np.ndarray, x: np.ndarray) -> None:
        w = self.w[i].astype(float)
        starts = np.flatnonzero(fresh)
        if not fresh[0]:
            starts = np.concatenate(([0], starts))
        if phase == 0:
            ties = np.add.reduceat(w * x, starts)
            if not fresh[0]:
                self.ties[-1][-1] += ties[0]
                ties = ties[1:]
            if len(ties):
                self.ties.append(ties)
            return
        if self.ranked and self.rank is None:
            ties = np.concatenate(self.ties)
            twice = 2 * np.cumsum(ties) - ties + 1
            self.rank, self.ties = twice.astype(np.min_scalar_type(int(twice[-1]))), []
        b = self.rank[x] / 2 if self.ranked else x
        wb = w * b
        self.total[[0, 2, 5]] += w.sum(), wb.sum(), wb @ b
        parts = np.stack([np.add.reduceat(w, starts), np.add.reduceat(wb, starts)])
        if not fresh[0]:
            parts[:, 0] += self.open
        else:
            self.close(self.open[:, None])
        self.close(parts[:, :-1])
        self.open = parts[:, -1].copy()

    def close(self, parts: np.ndarray) -> None:
        """Ranks of whole ties: their weights and sums of w * b."""
        ties, wb = parts
        if not len(ties):
            return
        through = self.below + np.cumsum(ties)
        a = through - ties + (ties + 1) / 2
        wa = ties * a
        self.total[[1, 3, 4]] += wa.sum(), wb @ a, wa @ a
        self.below = float(through[-1])

    def result(self) -> list:
        self.close(self.open[:, None])
        return self.total.tolist()


class Median:
    """The weighted median: phase 0 brings the number of rows of each cluster, phase 1 all rows in order of the value."""

    def __init__(self, w: np.ndarray):
        self.w, self.rows, self.seen, self.last, self.found = w, 0.0, 0.0, None, []

    def feed(self, phase: int, i: np.ndarray, fresh: np.ndarray, v: np.ndarray, x: np.ndarray) -> None:
        w = self.w[i].astype(float)
        if phase == 0:
            self.rows += float(w @ x)
            return
        at = (self.rows - 1) / 2
        through = self.seen + np.cumsum(w)
        place = np.cumsum(fresh) - 1
        for p in (np.floor(at), np.ceil(at))[len(self.found) :]:
            k = int(np.searchsorted(through, p, "right"))
            if k == len(w):
                break
            self.found.append(float(v[place[k]] if place[k] >= 0 else self.last))
        self.seen, self.last = float(through[-1]), v[-1] if len(v) else self.last

    def result(self) -> list:
        return [sum(self.found) / 2 if len(self.found) == 2 else None]


def pieces(rows: DataFrame, phase: int, order: str | None, columns: list[str], keep: bool = False) -> DataFrame:
    """Rows (__n clusters, __i cluster, columns) as rows of bytes, one for each Arrow batch, in order of a column if one is
    named: `at` its first value, `fresh` a bit where a row has another value than the one before, with keep those values."""
    value = F.lit(0.0) if order is None else F.col(order).cast("double") + 0.0
    data = rows.select("__n", F.col("__i").cast("int"), value.alias("__v"), *[F.col(c).cast("double") for c in columns])
    if order is not None:
        data = data.repartitionByRange("__v").sortWithinPartitions("__v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for seq, batch in enumerate(b for b in batches if b.num_rows):
            n, i, v, *x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            fresh = np.ones(len(v), bool)
            fresh[1:] = ~((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
            fresh[0] = before is None or not (v[0] == before or (np.isnan(v[0]) and np.isnan(before)))
            before = v[-1]
            cells = [phase, float(v[0]), seq, int(n[0]), i.astype(np.int32).tobytes(), np.packbits(fresh).tobytes(), v[fresh].tobytes() if keep else b"", b"".join(c.astype(float).tobytes() for c in x)]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, [pa.int32(), pa.float64(), pa.int64(), pa.int64(), *[pa.binary()] * 4], strict=True)], [c.split()[0] for c in _PIECE.split(", ")])

    return data.mapInArrow(pack, _PIECE)


def replicated(parts: list[DataFrame], replicates: int, seed: int, made: Callable, width: int, looked_up: bool = False) -> DataFrame:
    """replicate (-1: the sample itself), clusters, s0, s1 ...: what made(weights) has gathered after all pieces. With
    looked_up the values of phase 0 number those of phase 1."""
    groups = min(GROUPS, replicates + 1)
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    dealt = every.withColumn("__g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartitionById(groups, F.col("__g")).sortWithinPartitions("phase", "at", "seq")
    names = [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, n, known, values = {}, 0, [], None
        for batch in batches:
            for phase, n, i, fresh, v, x, group in zip(*[batch.column(c) for c in ("phase", "n", "i", "fresh", "v", "x", "__g")], strict=True):
                phase, n = phase.as_py(), n.as_py()
                if not states:
                    states = {r: made(weights(seed, r, n)) for r in range(group.as_py() - 1, replicates, groups)}
                i, v, x = (np.frombuffer(c.as_buffer(), t) for c, t in ((i, np.int32), (v, float), (x, float)))
                fresh = np.unpackbits(np.frombuffer(fresh.as_buffer(), np.uint8), count=len(i)).astype(bool)
                if looked_up and phase == 0:
                    known.append(v)
                elif looked_up:
                    values = np.concatenate(known) if values is None else values
                    x = np.searchsorted(values, x)
                for s in states.values():
                    s.feed(phase, i, fresh, v, x)
        if states:
            found = list(zip(*[s.result() for s in states.values()], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(states), pa.int32()), pa.array([n] * len(states), pa.int64()), *[pa.array(c, pa.float64()) for c in found]], ["replicate", "clusters", *names])

    return dealt.mapInArrow(run, "replicate int, clusters long, " + ", ".join(f"{c} double" for c in names))


def numbered(clusters: DataFrame, cluster: str) -> DataFrame:
    """Rows of one cluster each with __i, the cluster's place in order from 0, and __n, their number. Numbers are placed in
    bins of their value and counts of bins added up; names of other types are put in order by one task."""
    numeric = isinstance(clusters.schema[cluster].dataType, NumericType)
    rows = clusters.withColumn("__b", value_bin(F.col(cluster).cast("double")) if numeric else F.lit(0).cast("long"))
    every = Window.partitionBy(F.lit(0))
    bins = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    bins = bins.select("__b", (F.sum("__c").over(every.orderBy("__b")) - F.col("__c")).alias("__below"), F.sum("__c").over(every).alias("__n"))
    placed = rows.withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy(cluster)) - 1)
    return placed.join(bins, "__b").withColumn("__i", F.col("__k") + F.col("__below")).drop("__b", "__k", "__below")


def weighted_sums(per: DataFrame, cluster: str, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """Sums of columns of rows of one cluster each."""
    width = len(columns)
    return replicated([pieces(numbered(per, cluster), 0, None, columns)], replicates, seed, lambda w: Sums(w, width), width)


def rank_sums(rows: DataFrame, cluster: str, x: str, y: str, ranked: bool, replicates: int, seed: int) -> DataFrame:
    """Sums n, a, b, ab, aa, bb of the average ranks a of x and b of y, or b = y where it is not ranked."""
    at = rows.join(numbered(rows.select(cluster).distinct(), cluster), cluster).select("__n", "__i", F.col(x).alias("__x"), F.col(y).alias("__y"))
    parts = [pieces(at, 1, "__x", ["__y"])]
    if ranked:
        counted = at.withColumn("__y", F.col("__y").cast("double")).groupBy("__n", "__i", "__y").agg(F.count(F.lit(1)).alias("__c"))
        parts.insert(0, pieces(counted, 0, "__y", ["__c"], True))
    return replicated(parts, replicates, seed, lambda w: Ranked(w, ranked), 6, ranked)


def medians(rows: DataFrame, cluster: str, value: str, replicates: int, seed: int) -> DataFrame:
    """The median of value over rows."""
    per = numbered(rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("__c")), cluster)
    at = rows.join(per, cluster)
    return replicated([pieces(per, 0, None, ["__c"]), pieces(at, 1, value, [], True)], replicates, seed, Median, 1)


def interval(values: DataFrame, value: Column) -> DataFrame:
    """One row: estimate of the sample, percentiles of the replicates' values, how many have one, clusters."""
    v, again = F.col("__v"), F.col("replicate") >= 0
    rows = values.withColumn("__v", value)
    return rows.agg(F.max(F.when(~again, v)).alias("estimate"), F.percentile(F.when(again, v), 0.025).alias("ci_low"), F.percentile(F.when(again, v), 0.975).alias("ci_high"), F.count(F.when(again, v)).alias("replicates"), F.coalesce(F.max("clusters"), F.lit(0).cast("long")).alias("clusters"))
