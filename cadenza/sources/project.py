"""Projects: configuration, workbooks, rater manifests, media paths, checkpoints, stored spectra, run manifests."""

from __future__ import annotations

import datetime
import hashlib
import io
import json
import math
import os
import platform
import re
import sys
import tomllib
import wave
import zipfile
from importlib import metadata
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_table, require


def load_config(path: str) -> dict:
    """A project's settings from TOML or JSON; relative paths below "paths" are taken from the file's folder."""
    with open(path, "rb") as f:
        raw = f.read()
    config = json.loads(raw) if path.endswith(".json") else tomllib.loads(raw.decode())
    if not isinstance(config, dict):
        raise ValueError(f"{path} is not a mapping")
    home = os.path.dirname(os.path.abspath(path))
    config["paths"] = {k: v if os.path.isabs(v) or "://" in v else os.path.join(home, v) for k, v in config.get("paths", {}).items()}
    config["config_path"], config["config_sha256"] = os.path.abspath(path), hashlib.sha256(raw).hexdigest()
    return config


def json_safe(value):
    """value with what JSON has no form for replaced: NaN and infinities by None, dates and others by text, tuples and sets
    by lists (sets in order)."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return [json_safe(v) for v in sorted(value, key=str)]
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if hasattr(value, "tolist"):
        return json_safe(value.tolist())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (str, int, bool)) else value.isoformat() if hasattr(value, "isoformat") else str(value)


def run_manifest(path: str, command: list[str], config: dict, inputs: list[str], extra: dict | None = None) -> dict:
    """What a run was: command, versions, hashes of configuration and input files; written as JSON, never over another."""

    def described(p: str) -> dict:
        known = os.path.isfile(p)
        digest = hashlib.sha256()
        if known:
            with open(p, "rb") as f:
                while block := f.read(1 << 20):
                    digest.update(block)
        return {"path": p, "exists": os.path.exists(p), "bytes": os.path.getsize(p) if known else None, "sha256": digest.hexdigest() if known else None}

    out = json_safe({
        "created_utc": datetime.datetime.now(datetime.UTC), "command": command, "python": sys.version, "platform": platform.platform(), "config_path": config.get("config_path"),
        "config_sha256": config.get("config_sha256"), "inputs": [described(p) for p in inputs], "packages": sorted(f"{d.metadata['Name']}=={d.version}" for d in metadata.distributions()), "extra": extra or {},
    })
    with open(path, "x", encoding="utf-8") as f:
        json.dump(out, f, indent=1)
    return out


_CELL = re.compile(r"([A-Z]+)\d+")
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def workbook_rows(data: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Cells of one sheet, the first unless it is named, as text; numbers as written, booleans as true and false."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = {s.get("name"): s.get(_REL) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet}; there are {', '.join(sheets)}")
        target = targets[sheets[sheet] if sheet is not None else next(iter(sheets.values()))]
        rows = []
        for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_NS}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{_NS}c"):
                v, kind = c.find(f"{_NS}v"), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if kind == "inlineStr" else v.text if v is not None else None
                if text is not None and kind == "s":
                    text = strings[int(text)]
                elif text is not None and kind == "b":
                    text = "true" if text == "1" else "false"
                place = _CELL.match(c.get("r") or "")
                cells[_column(place[1]) if place else len(cells)] = text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet of a workbook as a table of text columns named by its first row. A sheet has 1,048,576 rows at the most by
    its format; blank rows are left out, columns without a name too."""
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    head, *rows = workbook_rows(data, sheet) or [[]]
    use = [(i, str(h).strip()) for i, h in enumerate(head) if h is not None and str(h).strip()]
    names = [h for _, h in use]
    if len(set(names)) != len(names):
        raise ValueError("the sheet repeats a column name")
    values = [[r[i] if i < len(r) else None for r in rows if any(v is not None for v in r)] for i, _ in use]
    return spark.createDataFrame(pa.table([pa.array(v, pa.string()) for v in values], names=names))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A workbook, or what read_table reads."""
    return read_workbook(spark, path) if path.lower().endswith(".xlsx") else read_table(spark, path)


def table_file(folder: str, stem: str, suffixes: tuple[str, ...] = (".parquet", ".csv", ".json")) -> str:
    """The path of folder/stem with the first suffix that is there."""
    for s in suffixes:
        if os.path.exists(path := os.path.join(folder, stem + s)):
            return path
    raise FileNotFoundError(f"no table {stem} in {folder}")


def discover_table(spark: SparkSession, folder: str, required: list[str]) -> tuple[str, DataFrame]:
    """The table of a folder that has all required columns; of several the one with the fewest others, then by name."""
    found = []
    for name in sorted(os.listdir(folder)):
        if name.lower().endswith((".parquet", ".csv", ".json", ".jsonl")):
            df = read_table(spark, os.path.join(folder, name))
            if set(required) <= set(df.columns):
                found.append((len(df.columns), name, df))
    if not found:
        raise FileNotFoundError(f"no table in {folder} has {', '.join(required)}")
    _, name, df = min(found, key=lambda x: x[:2])
    return name, df


def rater_manifest(spark: SparkSession, path: str) -> DataFrame:
    """relative_path, rater_id of a manifest of rating files; fails on blank raters and repeated paths."""
    df = read_any(spark, path)
    require(df, ["relative_path", "rater_id"])
    rows = df.select(F.trim("relative_path").alias("relative_path"), F.trim(F.col("rater_id").cast("string")).alias("rater_id"))
    bad = rows.where("coalesce(rater_id, '') = '' OR coalesce(relative_path, '') = ''").count() or rows.groupBy("relative_path").count().where("count > 1").count()
    if bad:
        raise ValueError("the manifest has blank entries or repeats a path")
    return rows


def rating_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Rows of all CSV rating files of a folder with the rater that the manifest names; fails for files it does not name."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + re.escape(folder.split("://")[-1].rstrip("/")) + "/", "")
    out = rows.select("*", path.alias("relative_path")).join(F.broadcast(manifest), "relative_path", "left")
    return out.where(F.when(F.col("rater_id").isNull(), F.raise_error(F.concat(F.lit("the manifest lacks "), "relative_path")).cast("boolean")).otherwise(True))


def normal_ratings(df: DataFrame, item: str, rater: str, categories: list[str]) -> DataFrame:
    """item, rater, category, rating from a wide table with a column for each category, or a long one with columns category
    and rating; what is not a number is NULL."""
    from ..functions.values import to_number

    if {"category", "rating"} <= set(df.columns):
        return df.where(F.col("category").isin(*categories)).select(item, rater, "category", to_number(F.col("rating")).alias("rating"))
    return df.select(item, rater, *[to_number(F.col(c)).alias(c) for c in categories]).unpivot([item, rater], categories, "category", "rating")


def media_paths(names: DataFrame, inventory: DataFrame, name: str = "name") -> DataFrame:
    """names with path and path_status: found, missing, or ambiguous where several files have the name."""
    per = inventory.groupBy(name).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("__n"))
    out = names.join(per, name, "left")
    status = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous").otherwise("found")
    return out.select(*names.columns, F.when(F.col("__n") == 1, F.col("path")).alias("path"), status.alias("path_status"))


def probe_wav(spark: SparkSession, folder: str) -> DataFrame:
    """path, rate, channels, bits, frames, duration, status of each WAV file, from its header and length."""

    def run(batches):
        for batch in batches:
            out = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with wave.open(io.BytesIO(data)) as w:
                        n, rate = w.getnframes(), w.getframerate()
                        whole = len(w.readframes(n)) == n * w.getsampwidth() * w.getnchannels()
                        out.append((path, rate, w.getnchannels(), 8 * w.getsampwidth(), n, n / rate if rate else None, "ok" if whole and n else "truncated" if n else "empty"))
                except (wave.Error, EOFError) as e:
                    out.append((path, None, None, None, None, None, f"probe_failed: {type(e).__name__}"))
            if out:
                types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["path", "rate", "channels", "bits", "frames", "duration", "status"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, rate int, channels int, bits int, frames long, duration double, status string")


def waveform_hash(samples: Column) -> Column:
    """SHA-256 of an array's length and values, whatever their type."""
    return F.sha2(F.concat_ws(",", F.size(samples).cast("string"), F.array_join(F.transform(samples, lambda x: F.coalesce(x.cast("double").cast("string"), F.lit("null"))), ",")), 256)


def write_checkpoint(df: DataFrame, root: str, part: str, signature: str) -> str:
    """df as one part of a resumable run; parts of other signatures are other parts."""
    path = f"{root.rstrip('/')}/signature={signature}/part={part}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_checkpoints(spark: SparkSession, root: str, signature: str) -> DataFrame:
    """All parts written under the signature, with their name in column part."""
    return spark.read.option("basePath", f"{root.rstrip('/')}/signature={signature}").parquet(f"{root.rstrip('/')}/signature={signature}")


def open_work(ids: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    """Ids that not every part of the checkpoints has."""
    for p in (done := [x.select(key).distinct() for x in parts])[:1]:
        whole = p
        for other in done[1:]:
            whole = whole.join(other, key, "left_semi")
        return ids.join(whole, key, "left_anti")
    return ids


def save_spectra(df: DataFrame, path: str) -> None:
    """Spectra rows (rec, freq, psd, ...) with a hash of their values beside them; never over others."""
    df.withColumn("spectrum_hash", F.sha2(F.to_json(F.struct("freq", "psd")), 256)).write.mode("errorifexists").parquet(path)


def load_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Spectra as saved; the plan fails at a row whose values are not those of its hash."""
    df = spark.read.parquet(path)
    same = F.sha2(F.to_json(F.struct("freq", "psd")), 256) == F.col("spectrum_hash")
    return df.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("a spectrum differs from its hash: "), F.col("rec").cast("string"))).cast("boolean")))
