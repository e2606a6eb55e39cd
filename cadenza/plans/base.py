"""Role tables that the queries read: interval and frame ledgers, repeats, raters, labels and spectra over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import epoch_us

SECOND = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame ledger: rec, id, t (microseconds), level, kind."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), F.col("event_id").alias("id"), epoch_us("ts").alias("t"), F.col("value").alias("level"), F.col("event_type").alias("kind"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval ledger: rec, id, kind, start, end in microseconds, value * 400 seconds long."""
    f = frames(spark, sf_dir)
    return f.select("rec", "id", "kind", F.col("t").alias("start"), (F.col("t") + F.round(F.col("level") * 4e8).cast("long")).alias("end"))


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated recordings of participants: subject, visit, id, feature, status, grp."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.select(F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("visit"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("feature"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return rows.join(c.select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("grp"), F.col("c_acctbal").alias("balance")), "subject")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ratings: item, rater, score, rating (score above 35)."""
    f = frames(spark, sf_dir)
    cell = f.groupBy(F.col("rec").alias("item"), F.col("kind").alias("rater")).agg(F.percentile("level", 0.5).alias("score"))
    return cell.withColumn("rating", (F.col("score") > 35).cast("int"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary labels with a score: id, score, quality, toxic, stratum."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.select("doc_id", F.col("n_chars").alias("score"), F.col("lang").alias("stratum")).join(lab, "doc_id").withColumnRenamed("doc_id", "id")


FRAMES = "fr AS (SELECT user_id AS rec, event_id AS id, epoch_us(ts) AS t, value AS level, event_type AS kind FROM events)"
INTERVALS = 'iv AS (SELECT user_id AS rec, event_id AS id, event_type AS kind, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 4e8) AS BIGINT) AS e FROM events)'
ISLANDS = """m1 AS (SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv WHERE e > s),
m2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m1),
isl AS (SELECT rec, min(s) AS s, max(e) AS e, count(*) AS n FROM m2 GROUP BY rec, g)"""
REPEATS = "rp AS (SELECT o_custkey AS subject, o_orderdate AS visit, o_orderkey AS id, o_totalprice AS feature, o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS grp, c_acctbal AS balance FROM orders JOIN customer ON o_custkey = c_custkey)"
RATINGS = "rt AS (SELECT user_id AS item, event_type AS rater, quantile_cont(value, 0.5) AS score, CAST(quantile_cont(value, 0.5) > 35 AS INT) AS rating FROM events GROUP BY 1, 2)"
LABELLED = "lb AS (SELECT d.doc_id AS id, n_chars AS score, lang AS stratum, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
