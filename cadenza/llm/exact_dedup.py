"""Exact duplicates: 128-bit content hash groups, bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "min") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Documents are grouped by the 128-bit MD5 of their text. Within a group texts are compared as bytes: the text
    itself is a grouping key of the first aggregation, which combines copies before the shuffle, so a hash collision
    never merges two texts; members find their text's subgroup again by its SHA-256. Should two different texts share
    both digests, the plan raises instead of answering.

    keep: "min" or "max", the id of a group that stays. Null texts count as empty. Null ids are never preferred to
    others; a group of null ids has a null keep_id and keeps all its rows. Rows that repeat an id and a text are one
    document: they count in group_size and share its kept flag. An empty table gives an empty result. Other columns
    are not read.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("__body"))
    keyed = rows.select("doc_id", "__body", F.unhex(F.md5("__body")).alias("__md5"), F.sha2("__body", 256).alias("text_sha256"))
    texts = keyed.groupBy("__md5", "text_sha256", "__body").agg(F.count(F.lit(1)).alias("__n"), pick("doc_id").alias("__keep"))
    groups = texts.groupBy("__md5", "text_sha256").agg(F.sum("__n").alias("group_size"), pick("__keep").alias("keep_id"), F.count(F.lit(1)).alias("__texts"))
    groups = groups.select(
        "__md5", "text_sha256", "keep_id",
        F.when(F.col("__texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share an MD5 and a SHA-256"))).alias("group_size"),
    )
    members = keyed.select("doc_id", "__md5", "text_sha256")
    return members.join(groups, ["__md5", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "min") -> DataFrame:
    """docs without the rows that exact_groups does not keep, columns unchanged."""
    kept = exact_groups(docs, text, doc_id, keep).where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha")).distinct()
    own = F.sha2(F.coalesce(docs[text], F.lit("")), 256)
    return docs.join(kept, docs[doc_id].eqNullSafe(kept["__kept_id"]) & (own == kept["__kept_sha"]), "left_semi")


def one_of_each_text(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "min") -> DataFrame:
    """docs with exactly one row of each text, columns unchanged: one of those that drop_exact_duplicates keeps, which
    are several where rows repeat or all ids of a text are null."""
    kept = drop_exact_duplicates(docs, text, doc_id, keep).withColumn("__sha", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return kept.dropDuplicates(["__sha"]).drop("__sha")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
