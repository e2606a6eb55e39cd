"""Command line: python -m cadenza.cli COMMAND ...; every command reads tables or folders and writes new tables."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import agreement, audit, cohort, contracts, inference, intervals, joins, measure, ranks, robust, sensitivity, summaries
from .plans import QUERIES
from .session import build_session
from .sources import project, readers, release


def _rules(spec: list[dict]) -> list[audit.Rule]:
    """Rules from JSON objects such as {"rule": "in_range", "column": "age", "low": 18, "high": 120}."""
    kinds = {"required": audit.required, "in_range": audit.in_range, "sentinel": audit.sentinel, "one_of": audit.one_of, "matches": audit.matches, "ordered": audit.ordered, "within_days": audit.within_days}
    return [kinds[r["rule"]](**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items() if k != "rule"}) for r in spec]


def run_audit(spark: SparkSession, a) -> dict[str, DataFrame]:
    df = readers.read_table(spark, a.table)
    with open(a.rules) as f:
        rules = _rules(json.load(f))
    ledger = audit.issues(df, a.key, rules)
    return {"issues": ledger, "profile": audit.profile(df, df.columns), "duplicates": audit.duplicate_keys(df, [a.key]), "summary": ledger.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("rows"))}


def run_inventory(spark: SparkSession, a) -> dict[str, DataFrame]:
    found = readers.media_inventory(spark, a.folder)
    out = {"inventory": found}
    if a.metadata:
        out["coverage"] = joins.coverage(found.select("name"), readers.read_table(spark, a.metadata).select(F.col(a.column).alias("name")), ["name"])
    return out


def run_freeze(spark: SparkSession, a) -> dict[str, DataFrame]:
    df = audit.canonical(readers.read_table(spark, a.table), [a.key], [F.col(c) for c in a.order])
    with open(a.rules) as f:
        ledger = audit.dispositions(audit.issues(df, a.key, _rules(json.load(f))), json.loads(a.dispositions))
    return {"cohort": audit.gates(df, a.key, ledger), "issues": ledger}


def run_freeze_template(spark: SparkSession, a) -> dict[str, DataFrame]:
    """The sheet of subjects whose group a person has to decide."""
    df = project.read_any(spark, a.table)
    return {"adjudication": audit.adjudication_template(df, a.subject, a.reported, a.confirmed, a.suffix)}


def run_segment(spark: SparkSession, a) -> dict[str, DataFrame]:
    rows = readers.read_table(spark, a.intervals)
    views = intervals.segmentation_views(rows.select("rec", "start", "end"), ["rec"], a.bridge, a.least, a.speech_edge, a.pause_edge)
    return {"intervals": views, "pauses": intervals.pause_boundaries(views.where("view = 'primary_speech'"), ["rec"])}


def run_segment_template(spark: SparkSession, a) -> dict[str, DataFrame]:
    """Summaries of a segmentation, their triage, and the review sheet with decisions open where something was flagged."""
    views, durations, frames = (readers.read_table(spark, t) for t in (a.intervals, a.durations, a.frames))
    primary = views.where("view = 'primary_speech'").select("rec", "start", "end")
    judged = summaries.reading_triage(summaries.segmentation_summary(primary, durations, frames, ["rec"]))
    sheet = cohort.adjudication_sheet(judged, "rec", {"excluded": F.col("qc_status") == "excluded", "flagged": F.col("qc_status") == "flagged"})
    return {"summary": judged, "flags": summaries.flag_counts(judged, "qc_flags"), "sheet": sheet}


def run_reviewed_release(spark: SparkSession, a) -> dict[str, DataFrame]:
    """One table of all families' features from FAMILY=TABLE arguments; features are columns with a status beside them."""
    families = {name: readers.read_table(spark, path) for name, path in (f.split("=", 1) for f in a.families)}
    features = {n: [c for c in df.columns if f"{c}_status" in df.columns] for n, df in families.items()}
    rows = [{"feature": f, "family": n} for n, fs in features.items() for f in fs]
    return {"release": release.build_release(families, a.key, features), "registry": release.registry(spark, rows)}


def run_assemble(spark: SparkSession, a) -> dict[str, DataFrame]:
    """Metadata, segmentation and released features in one row a recording, with the sets they agree on."""
    meta, seg, features = (readers.read_table(spark, t) for t in (a.metadata, a.segmentation, a.features))
    return {"dataset": cohort.assembled(meta, seg, features, a.key), "coverage": contracts.set_difference(meta, features, [a.key])}


def run_sensitivity(spark: SparkSession, a) -> dict[str, DataFrame]:
    """Features of a primary table and of a variant over the recordings of either, feature by feature."""
    long = lambda t, n: inference.long_features(readers.read_table(spark, t), [a.key], a.features).withColumnRenamed("value", n)
    both = long(a.primary, "primary").join(long(a.variant, "variant"), [a.key, "feature"], "full_outer")
    return {"sensitivity": sensitivity.compare_variants(both, ["feature"], "primary", "variant"), "correlation": ranks.spearman(both, ["feature"], "primary", "variant", 10)}


def run_encoding_sensitivity(spark: SparkSession, a) -> dict[str, DataFrame]:
    """The same features of two encodings of a recording, which never count as two recordings."""
    df = readers.read_table(spark, a.table)
    pick = lambda e, n: inference.long_features(df.where(F.col(a.encoding) == e), [a.key], a.features).withColumnRenamed("value", n)
    both = joins.checked_join(pick(a.first, "first"), pick(a.second, "second"), [a.key, "feature"], "inner", "one_to_one")
    return {"pairs": both, "sensitivity": sensitivity.compare_variants(both, ["feature"], "first", "second")}


def run_rest_reference(spark: SparkSession, a) -> dict[str, DataFrame]:
    """Level, spread, transients and spectrum of recordings at rest, half a second at both ends left out where there is room."""
    rec = readers.mono(readers.recordings(spark, a.folder))
    whole = rec.select("rec", F.lit(0).alias("idx"), (F.size("samples") / F.col("fs")).alias("__d"))
    spans = whole.select("rec", "idx", F.when(F.col("__d") >= 2, 0.5).otherwise(0.0).alias("start"), F.when(F.col("__d") >= 2, F.col("__d") - 0.5).otherwise(F.col("__d")).alias("end"))
    return {"rest": measure.rest_reference(measure.frame_ledger(rec, spans), measure.spectral_windows(rec, spans, 250.0, 125.0, 20.0, 1000.0), spans)}


def run_broad(spark: SparkSession, a) -> dict[str, DataFrame]:
    """Yes/no metadata columns as labels against family scores, and the raters' design."""
    df, scores = project.read_any(spark, a.table), readers.read_table(spark, a.scores)
    labels = audit.broad_labels(df, a.key, {c: c.startswith("without_") for c in a.columns})
    long = labels.where("present IS NOT NULL").select(a.key, F.col("label").alias("human"), F.col("present").cast("int").alias("label"))
    out = {"labels": labels, "alignment": robust.family_alignment(scores, long, a.key, a.subject)}
    if a.rater:
        out["design"] = audit.one_rater_each(df, a.key, a.rater, a.expected)
    return out


def run_adjudicate(spark: SparkSession, a) -> dict[str, DataFrame]:
    return {"decided": cohort.apply_adjudication(readers.read_table(spark, a.summary), readers.read_sheet(spark, a.sheet, [a.key, "decision"]), a.key)}


def run_extract(spark: SparkSession, a) -> dict[str, DataFrame]:
    rec = readers.mono(readers.recordings(spark, a.folder))
    views = readers.read_table(spark, a.intervals)
    pick = lambda v: views.where(F.col("view") == v).select("rec", F.col("interval_index").alias("idx"), "start", "end")
    speech, pauses = pick("strict_speech"), pick("strict_internal_nonspeech")
    frames = measure.frame_ledger(rec, intervals.eroded(speech, 0.2))
    quiet = measure.frame_ledger(rec, pauses, measure.Frames(30.0, 10.0))
    loud = measure.frame_ledger(rec, speech, measure.Frames(30.0, 10.0))
    found = measure.plateaus(rec)
    return {
        "frames": frames, "segments": measure.segment_ledger(frames), "gain": measure.gain_features(frames), "additive": measure.additive_features(quiet, loud, measure.spectral_windows(rec, pauses, 250.0, 125.0)),
        "channel": measure.channel_spectra(rec, speech), "plateaus": found, "distortion": measure.distortion_features(rec, found, 480), "dropouts": measure.dropouts(rec, 80, 320, 1e-3),
    }


def run_describe(spark: SparkSession, a) -> dict[str, DataFrame]:
    df = readers.read_table(spark, a.table)
    pairs = inference.feature_pairs(df, a.key, a.features)
    return {"describe": inference.describe_features(df, a.cluster, a.features), "pairs": pairs, "matrix": inference.correlation_matrix(pairs, a.features), "persistence": inference.persistence(df, a.cluster, a.features), "long": sensitivity.measurement_long(df, a.key, a.features), "interface": sensitivity.model_interface(df, a.key, a.features)}


def run_human(spark: SparkSession, a) -> dict[str, DataFrame]:
    df = readers.read_table(spark, a.table)
    good, bad = readers.annotation_intervals(df, a.item, a.rater, a.categories, a.duration)
    rows = readers.annotation_ratings(df, good, a.item, a.rater, a.categories, a.duration)
    n = df.select(F.countDistinct(a.rater)).first()[0]
    parts = [(c, rows.where(F.col("category") == c)) for c in a.categories]
    total = None
    for c, part in parts:
        row = agreement.gwet_ac1(part, a.item, "rating").crossJoin(agreement.binary_agreement(part, a.item, "rating").drop("items")).withColumn("category", F.lit(c))
        total = row if total is None else total.unionByName(row)
    return {"intervals": good, "issues": bad, "ratings": rows, "agreement": total, "coverage": agreement.coverage(df, a.item, a.rater, n)}


def run_manifest(spark: SparkSession, a) -> dict[str, DataFrame]:
    found = release.manifest(spark, a.folder)
    return {"differences": release.verify(readers.read_table(spark, a.expected), found)} if a.expected else {"manifest": found}


def run_query(spark: SparkSession, a) -> dict[str, DataFrame]:
    return {a.name: QUERIES[a.name](spark, a.sf)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cadenza", description=__doc__)
    p.add_argument("--out", required=True, help="folder for the new tables; existing ones are never overwritten")
    p.add_argument("--cores", default="*")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *arguments: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        for flag, more in arguments:
            c.add_argument(flag, **more)
        c.set_defaults(run=run)

    need, many = {"required": True}, {"required": True, "nargs": "+"}
    command("audit", run_audit, ("--table", need), ("--key", need), ("--rules", need))
    command("inventory", run_inventory, ("--folder", need), ("--metadata", {}), ("--column", {"default": "file_name"}))
    command("freeze", run_freeze, ("--table", need), ("--key", need), ("--order", many), ("--rules", need), ("--dispositions", {"default": "{}"}))
    command("freeze-template", run_freeze_template, ("--table", need), ("--subject", need), ("--reported", need), ("--confirmed", {"nargs": "*", "default": []}), ("--suffix", {"default": r".*-\d+"}))
    command("segment-template", run_segment_template, ("--intervals", need), ("--durations", need), ("--frames", need))
    command("reviewed-release", run_reviewed_release, ("--families", many), ("--key", {"default": "rec"}))
    command("assemble", run_assemble, ("--metadata", need), ("--segmentation", need), ("--features", need), ("--key", {"default": "rec"}))
    command("sensitivity", run_sensitivity, ("--primary", need), ("--variant", need), ("--key", {"default": "rec"}), ("--features", many))
    command("encoding-sensitivity", run_encoding_sensitivity, ("--table", need), ("--key", {"default": "rec"}), ("--encoding", {"default": "suffix"}), ("--first", {"default": "wav"}), ("--second", {"default": "webm"}), ("--features", many))
    command("rest-reference", run_rest_reference, ("--folder", need))
    command("broad-qc", run_broad, ("--table", need), ("--scores", need), ("--key", need), ("--subject", need), ("--columns", many), ("--rater", {}), ("--expected", {"nargs": "*", "default": []}))
    command("segment", run_segment, ("--intervals", need), *((f"--{n}", {"type": float, "default": d}) for n, d in (("bridge", 0.2), ("least", 0.1), ("speech_edge", 0.05), ("pause_edge", 0.1))))
    command("adjudicate", run_adjudicate, ("--summary", need), ("--sheet", need), ("--key", {"default": "rec"}))
    command("extract", run_extract, ("--folder", need), ("--intervals", need))
    command("describe", run_describe, ("--table", need), ("--key", need), ("--cluster", need), ("--features", many))
    command("human-qc", run_human, ("--table", need), ("--item", need), ("--rater", need), ("--duration", need), ("--categories", many))
    command("manifest", run_manifest, ("--folder", need), ("--expected", {}))
    command("query", run_query, ("name", {"choices": sorted(QUERIES)}), ("--sf", need))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    a = parser().parse_args(argv)
    spark = spark or build_session(a.cores)
    paths = []
    for name, df in a.run(spark, a).items():
        paths.append(f"{a.out.rstrip('/')}/{name}.parquet")
        df.write.mode("errorifexists").parquet(paths[-1])
    return paths


if __name__ == "__main__":
    print(*main(), sep="\n")
