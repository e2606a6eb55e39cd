"""Sinks: write-once versions, checked bundles, manifests of content hashes, feature releases and their registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_version(df: DataFrame, root: str, stem: str, version: str) -> str:
    """df under root/stem/version=...; an existing version is never overwritten."""
    path = f"{root.rstrip('/')}/{stem}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, stem: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{stem}/version={version}")


def save_bundle(df: DataFrame, folder: str, stem: str) -> DataFrame:
    """Parquet and CSV of one table, read back and compared with what was written: schema, rows and content hash."""
    base = f"{folder.rstrip('/')}/{stem}"
    df.write.mode("errorifexists").parquet(f"{base}.parquet")
    back = df.sparkSession.read.parquet(f"{base}.parquet")
    flat = back.select(*[F.col(f.name) if f.dataType.typeName() not in ("array", "map", "struct", "binary") else F.to_json(F.struct(f.name)).alias(f.name) for f in back.schema.fields])
    flat.write.mode("errorifexists").option("header", True).csv(f"{base}.csv")
    if [f.dataType for f in back.schema.fields] != [f.dataType for f in df.schema.fields] or content_hash(back) != content_hash(df):
        raise ValueError(f"{stem}: what was read back differs from what was written")
    return back


def content_hash(df: DataFrame) -> tuple[int, int]:
    """Rows and the sum of row hashes, whatever the order; columns by name."""
    row = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(df.columns)])
    found = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)"))).first()
    return found[0], int(found[1] or 0)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path below root, bytes, sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    tail = F.regexp_replace("path", "^.*?" + _quoted(root) + "/", "")
    return files.select(tail.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _quoted(path: str) -> str:
    import re

    return re.escape(path.split("://")[-1].rstrip("/"))


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """file, status: missing, unexpected or changed; no rows when all is as expected."""
    e, f = expected.alias("e"), found.alias("f")
    both = e.join(f, F.col("e.file") == F.col("f.file"), "full_outer")
    status = F.when(F.col("f.file").isNull(), "missing").when(F.col("e.file").isNull(), "unexpected").when(F.col("e.sha256") != F.col("f.sha256"), "changed")
    return both.select(F.coalesce("e.file", "f.file").alias("file"), status.alias("status")).where("status IS NOT NULL")


def registry(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The feature registry, one row a feature; names must be unique."""
    names = [r["feature"] for r in rows]
    if len(set(names)) != len(names):
        raise ValueError("the registry repeats a feature")
    columns = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))


def build_release(families: dict[str, DataFrame], key: str, features: dict[str, list[str]]) -> DataFrame:
    """One row a recording with every family's features and statuses. All families must hold the same recordings, once
    each; otherwise the plan fails where the first difference is met."""
    parts = []
    for name, df in families.items():
        n = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for f in features[name] for c in (f, f"{f}_status") if c in df.columns])
        once = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{name} repeats a recording")).cast("boolean"))
        parts.append(n.where(once).drop("__n").withColumn(f"__in_{name}", F.lit(True)))
    out = reduce(lambda a, b: a.join(b, key, "full_outer"), parts)
    missing = F.concat_ws(", ", *[F.when(F.col(f"__in_{n}").isNull(), F.lit(n)) for n in families])
    whole = F.when(missing == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("recording missing in: "), missing)).cast("boolean"))
    return out.where(whole).drop(*[f"__in_{n}" for n in families])
