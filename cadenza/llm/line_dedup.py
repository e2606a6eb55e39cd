"""Line deduplication by repeated windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def covered_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3) -> DataFrame:
    """Per document with anything to remove: doc_id, runs array<struct<first, last>> of covered line numbers (from 0).

    Every window of `width` consecutive lines is hashed to 128 bits. The first occurrence of a window, by doc_id and
    position, stays; all later ones cover their lines, and covered lines that overlap or touch merge into runs. Window
    counts combine before the shuffle, and the join back to a very frequent window is one that adaptive execution splits.
    """
    lines = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("__lines"))
    lines = lines.where(F.size("__lines") >= width)
    hashes = F.transform(
        F.sequence(F.lit(1), F.size("__lines") - (width - 1)),
        lambda i: F.unhex(F.md5(F.array_join(F.slice("__lines", i, F.lit(width)), "\n"))),
    )
    windows = lines.select("doc_id", F.posexplode(hashes).alias("__pos", "__hash"))
    repeated = windows.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("doc_id", "__pos")).alias("__first")).where("__n > 1").select("__hash", "__first")
    later = windows.join(repeated, "__hash").where(F.struct("doc_id", "__pos") != F.col("__first")).select("doc_id", "__pos").distinct()
    order = Window.partitionBy("doc_id").orderBy("__pos")
    gap = F.col("__pos") - F.lag("__pos").over(order)
    marked = later.withColumn("__new", F.when(gap <= width, 0).otherwise(1))
    runs = marked.withColumn("__run", F.sum("__new").over(order)).groupBy("doc_id", "__run").agg(F.min("__pos").alias("first"), (F.max("__pos") + (width - 1)).alias("last"))
    return runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3) -> DataFrame:
    """One row per input row: doc_id, kept_text, n_lines, n_removed, n_runs.

    Lines end at a line feed; a null text counts as empty, which is one empty line. Texts of fewer than `width` lines
    are never changed. Rows that share an id are read as copies of one document: their windows count as repeated, the
    first position of the id stays in each copy. Rows with a null id are returned unchanged and take no part. An
    empty table gives an empty result. Other columns are not read.
    """
    runs = covered_runs(docs, text, doc_id, width)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("__lines"))
    joined = rows.join(runs.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left")
    n = F.size("__lines")
    # The lines that stay are those between runs: from after one run to before the next.
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["last"] + 1))
    ends = F.concat(F.transform("runs", lambda r: r["first"]), F.array(n))
    pieces = F.zip_with(starts, ends, lambda s, e: F.slice("__lines", s + 1, F.greatest(e - s, F.lit(0))))
    kept = F.when(F.col("runs").isNull(), F.col("__lines")).otherwise(F.flatten(pieces))
    out = joined.select("doc_id", n.alias("n_lines"), kept.alias("__kept"), F.coalesce(F.size("runs"), F.lit(0)).alias("__runs"))
    return out.select(
        "doc_id", F.array_join("__kept", "\n").alias("kept_text"), F.col("n_lines").cast("long"),
        (F.col("n_lines") - F.size("__kept")).cast("long").alias("n_removed"), F.greatest(F.col("__runs"), F.lit(0)).cast("long").alias("n_runs"),
    )


ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     w AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM l WHERE len(ls) >= 3),
     h AS (SELECT doc_id, p, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] AS win FROM w),
     r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM h),
     c AS (SELECT DISTINCT doc_id, p + o AS q FROM r, (VALUES (0), (1), (2)) t(o) WHERE k > 1),
     e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS q FROM l),
     m AS (SELECT e.doc_id, e.q, e.line, c.q IS NOT NULL AS gone,
                  c.q IS NOT NULL AND lag(c.q) OVER (PARTITION BY e.doc_id ORDER BY e.q) IS NULL AS run_start
           FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.q = c.q)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE run_start) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY q) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
