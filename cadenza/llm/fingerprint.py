"""Merkle fingerprints of documents: leaves within paragraphs, paragraphs within sections, one root."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: A leaf: at most 80 code points of one paragraph, ending early after sentence marks. Leaves partition the paragraph.
LEAF = r"[^.!?]{1,80}[.!?]*|[.!?]+"


def leaf_hashes(text: Column) -> Column:
    """array<array<string>>: per paragraph (lines of the text) the MD5 of each leaf."""
    return F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.md5(x)))


def section_hashes(leaves: Column) -> Column:
    """array<string>: SHA-256 of each section. Sections end after paragraphs whose own hash says so (one in four) or
    that are blank, so that an insertion moves no border but its own."""
    paragraphs = F.transform(leaves, lambda a: F.when(F.size(a) == 0, F.lit("0" * 32)).otherwise(F.md5(F.array_join(a, ""))))
    marked = F.transform(paragraphs, lambda h: F.concat(h, F.when(F.substring(h, 1, 1) < "4", F.lit("|")).otherwise(F.lit(""))))
    return F.transform(F.split(F.array_join(marked, ""), r"\|"), lambda s: F.sha2(s, 256))


def root_hash(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ""), 256)


def likeness(a: Column, b: Column, root_a: Column, root_b: Column) -> Column:
    """1 for equal roots; else the larger share of leaves that agree, in place or anywhere (Dice over distinct leaves)."""
    fa, fb = F.flatten(a), F.flatten(b)
    place = F.aggregate(F.zip_with(fa, fb, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) / F.greatest(F.size(fa), F.size(fb), F.lit(1))
    both = F.size(F.array_intersect(fa, fb)) * 2.0 / F.greatest(F.size(F.array_distinct(fa)) + F.size(F.array_distinct(fb)), F.lit(1))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(F.least(F.greatest(place, both), F.lit(0.9999)))


def merkle_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, fingerprint (root), sections, leaves. Null texts count as empty."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), leaf_hashes(F.coalesce(F.col(text), F.lit(""))).alias("leaves"))
    rows = rows.withColumn("sections", section_hashes(F.col("leaves")))
    return rows.select("doc_id", root_hash(F.col("sections")).alias("fingerprint"), "sections", "leaves")


def differing_paragraphs(a: DataFrame, b: DataFrame) -> DataFrame:
    """For two merkle_fingerprints tables: doc_id, paragraph numbers (from 0) at which their trees differ; equal roots
    are never opened."""
    x, y = a.alias("x"), b.alias("y")
    pair = x.join(y, "doc_id").where("x.fingerprint <> y.fingerprint")
    spots = F.filter(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("x.leaves"), F.size("y.leaves")) - 1), lambda i: F.when(F.get("x.leaves", i).eqNullSafe(F.get("y.leaves", i)), None).otherwise(i)),
        lambda i: i.isNotNull(),
    )
    return pair.select("doc_id", spots.alias("paragraphs"))


def with_next_text(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, body, next_body: the text of the next document by descending id, the first one's after the last.

    Ids are dealt into ranges at bounds that are themselves ids, so each range's first document is known beforehand
    and is copied to the range before it. One shuffle moves the texts, no range depends on another. Rows that share an
    id follow each other by descending text; null ids come last. A single row is its own successor.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    n = 4 * partitions(docs.sparkSession)
    cuts = [float(i) / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("doc_id", cuts, 10 * n).alias("cuts"), F.max("doc_id").alias("top")).first()
    bounds = sorted({*(found["cuts"] or []), *([] if found["top"] is None else [found["top"]])})
    if not bounds:
        order = Window.partitionBy("doc_id").orderBy(F.desc("body"))
        return rows.select("doc_id", "body", F.coalesce(F.lead("body").over(order), F.first("body").over(order)).alias("next_body"))
    # Two short scans find a range: the block of bounds, then the place in it.
    step = math.isqrt(len(bounds)) + 1
    blocks = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    lasts = F.array(*[F.lit(bounds[min(i + step, len(bounds)) - 1]) for i in range(0, len(bounds), step)])
    block = F.size(F.filter(lasts, lambda b: b < F.col("doc_id")))
    inner = F.size(F.filter(F.get(blocks, F.col("__block")), lambda b: b < F.col("doc_id")))
    ranged = rows.withColumn("__block", F.when(F.col("doc_id").isNull(), 0).otherwise(block))
    ranged = ranged.withColumn("__range", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("__block") * step + inner))
    first = F.coalesce(F.get(F.get(blocks, F.col("__block")), F.col("__range") % step) == F.col("doc_id"), F.lit(False))
    copies = F.when(first, F.array(F.struct(F.col("__range").alias("at"), F.lit(0).alias("ghost")), F.struct(((F.col("__range") + 1) % len(bounds)).alias("at"), F.lit(1).alias("ghost"))))
    copies = copies.otherwise(F.array(F.struct(F.col("__range").alias("at"), F.lit(0).alias("ghost"))))
    dealt = ranged.select("doc_id", "body", F.explode(copies).alias("__c")).select("doc_id", "body", "__c.at", "__c.ghost")
    order = Window.partitionBy("at").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("body"))
    return dealt.withColumn("next_body", F.lead("body").over(order)).where("ghost = 0").select("doc_id", "body", "next_body")


def edited_likeness(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's fingerprint against an edited text (its last third replaced by the start of the next document)
    and against the next document. Nulls, ties and single rows as in with_next_text; an empty table gives none."""
    rows = with_next_text(docs, text, doc_id)
    n, third = F.length("body"), F.floor(F.length("body") / 3).cast("int")
    rows = rows.select("doc_id", "body", "next_body", n.cast("long").alias("n_chars"), F.concat(F.expr("left(body, length(body) - int(floor(length(body) / 3)))"), F.expr("left(next_body, int(floor(length(body) / 3)))")).alias("__edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), *[leaf_hashes(F.col(c)).alias(k) for c, k in (("body", "__a"), ("__edited", "__e"), ("next_body", "__n"))])
    rows = rows.select("*", *[root_hash(section_hashes(F.col(k))).alias(f"{k}r") for k in ("__a", "__e", "__n")])
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.col("__ar").alias("fingerprint"), F.col("__er").alias("edited_fingerprint"),
        F.round(likeness(F.col("__a"), F.col("__e"), F.col("__ar"), F.col("__er")), 6).alias("near_edited"),
        F.round(likeness(F.col("__a"), F.col("__n"), F.col("__ar"), F.col("__nr")), 6).alias("near_next"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
     n AS (SELECT doc_id, body, coalesce(lead(body) OVER w, first_value(body) OVER w) AS nxt FROM d WINDOW w AS (ORDER BY doc_id DESC)),
     e AS (SELECT *, left(body, length(body) - length(body) // 3) || left(nxt, length(body) // 3) AS edited FROM n),
     t AS (SELECT doc_id, 'a' AS k, body AS x FROM e UNION ALL SELECT doc_id, 'e', edited FROM e UNION ALL SELECT doc_id, 'n', nxt FROM e),
     l AS (SELECT doc_id, k, list_transform(string_split(x, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^.!?]{1,80}[.!?]*|[.!?]+'), lambda y: md5(y))) AS lv FROM t),
     p AS (SELECT *, list_transform(lv, lambda a: CASE WHEN len(a) = 0 THEN repeat('0', 32) ELSE md5(array_to_string(a, '')) END) AS ph FROM l),
     s AS (SELECT *, list_transform(string_split(array_to_string(list_transform(ph, lambda h: h || CASE WHEN left(h, 1) < '4' THEN '|' ELSE '' END), ''), '|'), lambda z: sha256(z)) AS sec FROM p),
     r AS (SELECT doc_id, k, flatten(lv) AS f, sha256(array_to_string(sec, '')) AS root FROM s),
     j AS (SELECT e.doc_id, length(e.body) AS n_chars, sha256(e.edited) AS edited_sha256, a.root AS ra, b.root AS rb, c.root AS rc, a.f AS fa, b.f AS fb, c.f AS fc
           FROM e JOIN r a ON a.doc_id = e.doc_id AND a.k = 'a' JOIN r b ON b.doc_id = e.doc_id AND b.k = 'e' JOIN r c ON c.doc_id = e.doc_id AND c.k = 'n')
SELECT doc_id, n_chars, edited_sha256, ra AS fingerprint, rb AS edited_fingerprint,
       round(CASE WHEN ra = rb THEN 1.0 ELSE least(0.9999, greatest(
           len(list_filter(list_zip(fa, fb), lambda z: z[1] = z[2])) / greatest(len(fa), len(fb), 1)::DOUBLE,
           len(list_intersect(fa, fb)) * 2.0::DOUBLE / greatest(len(list_distinct(fa)) + len(list_distinct(fb)), 1))) END::DOUBLE, 6) AS near_edited,
       round(CASE WHEN ra = rc THEN 1.0 ELSE least(0.9999, greatest(
           len(list_filter(list_zip(fa, fc), lambda z: z[1] = z[2])) / greatest(len(fa), len(fc), 1)::DOUBLE,
           len(list_intersect(fa, fc)) * 2.0::DOUBLE / greatest(len(list_distinct(fa)) + len(list_distinct(fc)), 1))) END::DOUBLE, 6) AS near_next
FROM j
"""
