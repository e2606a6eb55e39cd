"""Readers: tables by suffix, adjudication sheets as text, media inventories, WAV decoding, nested annotation exports."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEDIA_SUFFIXES = ("wav", "webm", "mp4", "mp3", "ogg", "m4a", "flac")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, JSON lines or Parquet, by suffix; Parquet without one."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if low.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return spark.read.parquet(path)


def read_sheet(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV whose cells stay text as written, "NA" and empty included; fails when a required column is missing."""
    df = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\0").option("emptyValue", "").csv(path)
    require(df, required)
    return df.fillna("")


def require(df: DataFrame, columns: list[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def find_column(df: DataFrame, aliases: list[str]) -> str:
    """The first column whose snake-cased name is one of the aliases, in their order."""
    import re

    names = {re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_"): c for c in reversed(df.columns)}
    for a in aliases:
        if a in names:
            return names[a]
    raise ValueError(f"no column for any of: {', '.join(aliases)}")


def media_inventory(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = MEDIA_SUFFIXES) -> DataFrame:
    """path, name, suffix, bytes, sha256 of the media files below folder. Files are read where their hash is formed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    return files.select("path", name.alias("name"), suffix.alias("suffix"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where(F.col("suffix").isin(*suffixes))


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples x channels, -1 to 1, of integer PCM."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()
        rate = w.getframerate()
    if width == 3:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8
    else:
        x = np.frombuffer(raw, dtype={1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.int64) - (128 if width == 1 else 0)
    return rate, (x / float(1 << (8 * width - 1))).reshape(-1, channels)


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """rec (file name without suffix), channel, fs, samples array<float>, status: one row for each channel of each WAV
    file; a file that cannot be decoded is a row with its status and no samples."""

    def run(batches):
        for batch in batches:
            out = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rec = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    fs, x = decode_wav(data)
                    out += [(rec, k, float(fs), x[:, k].astype(np.float32), "ok") for k in range(x.shape[1])]
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    out.append((rec, 0, None, None, f"decode_failed: {type(e).__name__}"))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(pa.float32())), pa.array(cols[4], pa.string())], ["rec", "channel", "fs", "samples", "status"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInArrow(run, "rec string, channel int, fs double, samples array<float>, status string")


def mono(df: DataFrame) -> DataFrame:
    """One row a recording: the mean over channels, its own mean removed. A task holds one recording's channels."""

    def one(pdf):
        x = np.mean([np.asarray(v, dtype=np.float64) for v in pdf["samples"]], axis=0)
        return pdf.iloc[:1][["rec", "fs"]].assign(samples=[(x - x.mean()) if len(x) else x])

    return df.where("status = 'ok'").groupBy("rec").applyInPandas(one, "rec string, fs double, samples array<double>")


ANNOTATION = T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.DoubleType())))


def annotation_intervals(df: DataFrame, item: str, rater: str, categories: list[str], duration: str) -> tuple[DataFrame, DataFrame]:
    """Intervals and issues from cells of JSON maps {subcategory: [[start, end], ...]}, one column a category.

    Intervals: item, rater, category, subcategory, start, end, clipped to the duration. Issues: the cells and pairs left
    out and why: malformed_json, not_a_pair, not_finite, reversed_or_empty, outside_duration."""
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("cell")) for c in categories])
    long = df.select(item, rater, F.col(duration).alias("__d"), F.explode(cells).alias("x")).select(item, rater, "__d", "x.*").where(F.trim(F.coalesce("cell", F.lit(""))) != "")
    parsed = long.withColumn("m", F.from_json("cell", ANNOTATION, {"mode": "PERMISSIVE"}))
    bad = parsed.where("m IS NULL").select(item, rater, "category", F.lit(None).cast("string").alias("subcategory"), F.lit("malformed_json").alias("issue"), F.col("cell").alias("value"))
    pairs = parsed.where("m IS NOT NULL").select(item, rater, "__d", "category", F.explode("m").alias("subcategory", "list")).select(item, rater, "__d", "category", "subcategory", F.explode("list").alias("p"))
    s, e = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    why = F.when(F.col("p").isNull() | (F.size("p") != 2), "not_a_pair").when(s.isNull() | e.isNull() | F.isnan(s) | F.isnan(e), "not_finite").when(e <= s, "reversed_or_empty").when((s >= F.col("__d")) | (e <= 0), "outside_duration")
    judged = pairs.withColumn("issue", why)
    good = judged.where("issue IS NULL").select(item, rater, "category", "subcategory", F.greatest(s, F.lit(0.0)).alias("start"), F.least(e, F.col("__d")).alias("end"))
    return good, bad.unionByName(judged.where("issue IS NOT NULL").select(item, rater, "category", "subcategory", "issue", F.to_json("p").alias("value")))


def annotation_ratings(df: DataFrame, good: DataFrame, item: str, rater: str, categories: list[str], duration: str) -> DataFrame:
    """item, rater, category, rating (0/1), annotated_sec (union of its intervals), annotated_fraction, events: every cell
    of the grid is a row, zero where nothing was annotated."""
    from ..operators.intervals import merged

    grid = df.select(item, rater, F.col(duration).alias("__d"), F.explode(F.array(*map(F.lit, categories))).alias("category"))
    keys = [item, rater, "category"]
    found = merged(good, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("annotated_sec"), F.count(F.lit(1)).alias("events"))
    out = grid.join(found, keys, "left").fillna(0, ["annotated_sec", "events"])
    return out.select(*keys, (F.col("events") > 0).cast("int").alias("rating"), "annotated_sec", F.when(F.col("__d") > 0, F.col("annotated_sec") / F.col("__d")).alias("annotated_fraction"), "events")


def long_ratings(df: DataFrame, item: str, rater: str, categories: list[str]) -> DataFrame:
    """Wide rating columns as rows item, rater, category, rating; what is not a number is NULL."""
    from ..functions.values import to_number

    return df.select(item, rater, *[to_number(F.col(c)).alias(c) for c in categories]).unpivot([item, rater], categories, "category", "rating")
