"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, temporary


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes with edges(u, v), u <> v, of any orderable type.

    Every step keeps at most as many edges as there are; minima combine before the shuffle and adaptive execution
    splits the joins of nodes with many neighbours. Each round is written to the shared folder, so lineage stays short.
    Stops when a round changes nothing, after a number of rounds that grows with the logarithm of the longest path.
    """
    now, before = edges.where("u <> v").select("u", "v").distinct(), None
    with temporary(edges.sparkSession):
        while True:
            now = materialize(now, "edges")
            state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1))).first()
            if state == before or state[0] == 0:
                break
            before, now = state, _small(_large(now))
        now = materialize(now, "components", outlive=True)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
