"""Projects: configuration, workbooks, manifests, checkpoints, spectra, probes, and the commands that use them."""

import json
import math
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import cli
from cadenza.operators import contracts, events, measure, robust, summaries
from cadenza.sources import project


def workbook(path, rows):
    """A minimal workbook with one sheet of shared and inline strings, numbers and booleans."""
    cells, strings = [], []
    for r, row in enumerate(rows, 1):
        out = []
        for c, v in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            if v is None:
                continue
            if isinstance(v, bool):
                out.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, str) and c % 2:
                out.append(f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif isinstance(v, str):
                strings.append(v)
                out.append(f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>')
            else:
                out.append(f'<c r="{at}"><v>{v}</v></c>')
        cells.append(f'<row r="{r}">{"".join(out)}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{s}</t></si>' for s in strings)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(cells)}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "m.xlsx", [["rec", "name", "age", "ok"], ["a", "Ann", 20, True], [None, None, None, None], ["b", None, 3.5, False]])
    got = project.read_any(spark, str(tmp_path / "m.xlsx"))
    assert [tuple(r) for r in got.orderBy("rec").collect()] == [("a", "Ann", "20", "true"), ("b", None, "3.5", "false")]
    with pytest.raises(ValueError, match="no sheet"):
        project.workbook_rows((tmp_path / "m.xlsx").read_bytes(), "other")


def test_config_and_run_manifest(tmp_path):
    (tmp_path / "p.toml").write_text('name = "x"\n[paths]\ndata = "d"\nfar = "s3://b/c"\n')
    config = project.load_config(str(tmp_path / "p.toml"))
    assert config["paths"] == {"data": str(tmp_path / "d"), "far": "s3://b/c"} and len(config["config_sha256"]) == 64
    assert project.json_safe({"a": float("nan"), "b": {3, 1}, "c": np.arange(2), 4: (None, True)}) == {"a": None, "b": [1, 3], "c": [0, 1], "4": [None, True]}
    out = project.run_manifest(str(tmp_path / "run.json"), ["x"], config, [str(tmp_path / "p.toml"), str(tmp_path / "none")], {"v": math.inf})
    assert json.loads((tmp_path / "run.json").read_text()) == out and [i["exists"] for i in out["inputs"]] == [True, False] and out["extra"] == {"v": None}
    with pytest.raises(FileExistsError):
        project.run_manifest(str(tmp_path / "run.json"), [], config, [])


def test_tables_raters_and_paths(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "t/b.csv").write_text("x,y,z\n1,2,3\n")
    assert project.discover_table(spark, str(tmp_path / "t"), ["x"])[0] == "a.csv" and project.discover_table(spark, str(tmp_path / "t"), ["z"])[0] == "b.csv"
    assert project.table_file(str(tmp_path / "t"), "a").endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        project.discover_table(spark, str(tmp_path / "t"), ["w"])
    (tmp_path / "m.csv").write_text("relative_path,rater_id\na.csv, ann\nb.csv,bob\n")
    raters = project.rater_manifest(spark, str(tmp_path / "m.csv"))
    assert {(r.x, r.rater_id) for r in project.rating_files(spark, str(tmp_path / "t"), raters).collect()} == {("1", "ann"), ("1", "bob")}
    with pytest.raises(Exception, match="lacks"):
        project.rating_files(spark, str(tmp_path / "t"), raters.where("rater_id = 'bob'")).collect()
    (tmp_path / "bad.csv").write_text("relative_path,rater_id\na.csv,ann\na.csv,bob\n")
    with pytest.raises(ValueError, match="repeats"):
        project.rater_manifest(spark, str(tmp_path / "bad.csv"))
    wide = spark.createDataFrame([("i", "r", "1", "no")], "item string, rater string, a string, b string")
    long = spark.createDataFrame([("i", "r", "a", "1"), ("i", "r", "c", "1")], "item string, rater string, category string, rating string")
    assert sorted((r.category, r.rating) for r in project.normal_ratings(wide, "item", "rater", ["a", "b"]).collect()) == [("a", 1.0), ("b", None)]
    assert [(r.category, r.rating) for r in project.normal_ratings(long, "item", "rater", ["a", "b"]).collect()] == [("a", 1.0)]
    inventory = spark.createDataFrame([("p1", "a"), ("p2", "b"), ("p3", "b")], "path string, name string")
    got = project.media_paths(spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), inventory)
    assert {r.name: (r.path, r.path_status) for r in got.collect()} == {"a": ("p1", "found"), "b": (None, "ambiguous"), "c": (None, "missing")}


def tone(path, fs, x):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(fs)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())


def test_probe_and_rest_reference(spark, tmp_path):
    fs, rng = 8000, np.random.default_rng(1)
    (tmp_path / "w").mkdir()
    x = 0.01 * rng.standard_normal(4 * fs)
    x[2 * fs : 2 * fs + 400] += 0.5 * rng.standard_normal(400)
    tone(tmp_path / "w/a.wav", fs, x)
    (tmp_path / "w/b.wav").write_bytes(b"no sound")
    (tmp_path / "w/c.wav").write_bytes((tmp_path / "w/a.wav").read_bytes()[:-1000])
    got = {r.path.rsplit("/", 1)[-1]: (r.rate, r.bits, r.frames, r.status) for r in project.probe_wav(spark, str(tmp_path / "w")).collect()}
    assert got["a.wav"] == (fs, 16, 4 * fs, "ok") and got["b.wav"][3].startswith("probe_failed") and got["c.wav"][3] == "truncated"
    (tmp_path / "w/b.wav").unlink()
    (tmp_path / "w/c.wav").unlink()
    cli.main(["--out", str(tmp_path / "o"), "rest-reference", "--folder", str(tmp_path / "w")], spark)
    rest = spark.read.parquet(str(tmp_path / "o/rest.parquet")).first()
    assert rest.status == "ok" and abs(rest.level + 40) < 1 and abs(rest.seconds - 3) < 0.01 and abs(rest.transients_per_min - 20) < 1e-6 and rest.flatness > 0.4


def test_checkpoints_and_spectra(spark, tmp_path):
    ids = spark.createDataFrame([(i,) for i in range(4)], "rec int")
    for part, upto in (("a", 3), ("b", 2)):
        project.write_checkpoint(ids.where(f"rec < {upto}"), str(tmp_path), part, "s1")
    parts = project.read_checkpoints(spark, str(tmp_path), "s1")
    assert sorted(r.rec for r in project.open_work(ids, "rec", [parts.where("part = 'a'"), parts.where("part = 'b'")]).collect()) == [2, 3]
    assert project.open_work(ids, "rec", []).count() == 4
    rows = spark.createDataFrame([("r", [1.0, 2.0], [0.5, 0.25])], "rec string, freq array<double>, psd array<double>")
    project.save_spectra(rows, str(tmp_path / "sp"))
    assert project.load_spectra(spark, str(tmp_path / "sp")).count() == 1
    spark.read.parquet(str(tmp_path / "sp")).withColumn("psd", F.array(F.lit(1.0))).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="differs from its hash"):
        project.load_spectra(spark, str(tmp_path / "bad")).collect()
    a, b = (spark.createDataFrame([(v,)], "x array<double>").select(project.waveform_hash(F.col("x"))).first()[0] for v in ([1.0, None], [1.0, 2.0]))
    assert a != b and len(a) == 64


def test_template_commands(spark, tmp_path):
    (tmp_path / "m.csv").write_text("SubjectID,Diagnosis\nC1-2,\nS3,\nS4,als\nX9,\n")
    cli.main(["--out", str(tmp_path / "t"), "freeze-template", "--table", str(tmp_path / "m.csv"), "--subject", "SubjectID", "--reported", "Diagnosis", "--confirmed", r"X\d"], spark)
    assert {r.SubjectID: r.recommended_review for r in spark.read.parquet(str(tmp_path / "t/adjudication.parquet")).collect()} == {"C1-2": "verify_suffix", "S3": "verify_or_exclude"}
    spark.createDataFrame([("a", "primary_speech", 0.0, 4.0), ("a", "primary_speech", 12.0, 14.0)], "rec string, view string, start double, end double").write.parquet(str(tmp_path / "iv"))
    spark.createDataFrame([("a", 15.0), ("b", 9.0)], "rec string, duration double").write.parquet(str(tmp_path / "du"))
    spark.createDataFrame([("a", -20.0), ("a", -30.0), ("b", -70.0), ("b", -71.0)], "rec string, level double").write.parquet(str(tmp_path / "fr"))
    cli.main(["--out", str(tmp_path / "s"), "segment-template", "--intervals", str(tmp_path / "iv"), "--durations", str(tmp_path / "du"), "--frames", str(tmp_path / "fr")], spark)
    judged = {r.rec: (r.qc_status, r.qc_flags) for r in spark.read.parquet(str(tmp_path / "s/summary.parquet")).collect()}
    assert judged == {"a": ("flagged", "extreme_internal_pause"), "b": ("excluded", "no_speech_detected;very_low_speech_fraction;near_silent_or_noise_only")}
    assert spark.read.parquet(str(tmp_path / "s/sheet.parquet")).where("decision <> ''").count() == 0


def test_release_assemble_and_sensitivity_commands(spark, tmp_path):
    for name, shift in (("g", 0.0), ("h", 1.0)):
        spark.createDataFrame([(f"r{i}", float(i * i) + shift, "ok") for i in range(12)], f"rec string, {name}1 double, {name}1_status string").write.parquet(str(tmp_path / name))
    cli.main(["--out", str(tmp_path / "o"), "reviewed-release", "--families", f"gain={tmp_path / 'g'}", f"hum={tmp_path / 'h'}"], spark)
    rel = spark.read.parquet(str(tmp_path / "o/release.parquet"))
    assert rel.count() == 12 and {"g1", "g1_status", "h1", "h1_status"} <= set(rel.columns)
    spark.createDataFrame([(f"r{i}", f"s{i % 3}") for i in range(13)], "rec string, subject string").write.parquet(str(tmp_path / "m"))
    spark.createDataFrame([(f"r{i}", i % 4 > 0) for i in range(13)], "rec string, eligible boolean").write.parquet(str(tmp_path / "s"))
    cli.main(["--out", str(tmp_path / "a"), "assemble", "--metadata", str(tmp_path / "m"), "--segmentation", str(tmp_path / "s"), "--features", str(tmp_path / "o/release.parquet")], spark)
    data = spark.read.parquet(str(tmp_path / "a/dataset.parquet"))
    assert data.count() == 13 and data.where("analysis_eligible").count() == 9
    spark.createDataFrame([(f"r{i}", float(i * i) + (i == 5)) for i in range(1, 12)], "rec string, g1 double").write.parquet(str(tmp_path / "v"))
    cli.main(["--out", str(tmp_path / "c"), "sensitivity", "--primary", str(tmp_path / "g"), "--variant", str(tmp_path / "v"), "--features", "g1"], spark)
    assert spark.read.parquet(str(tmp_path / "c/correlation.parquet")).first().rho == 1.0
    both = [(f"r{i}", e, float(i) + (e == "webm")) for i in range(5) for e in ("wav", "webm")]
    spark.createDataFrame(both, "rec string, suffix string, g1 double").write.parquet(str(tmp_path / "e"))
    cli.main(["--out", str(tmp_path / "p"), "encoding-sensitivity", "--table", str(tmp_path / "e"), "--features", "g1"], spark)
    assert {r.second - r.first for r in spark.read.parquet(str(tmp_path / "p/pairs.parquet")).collect()} == {1.0}
    spark.createDataFrame([(f"r{i}", f"s{i}", "Yes" if i < 7 else "No", "ann") for i in range(14)], "rec string, subject string, noise string, rater string").write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([(f"r{i}", f"s{i}", "additive", float(-i)) for i in range(14)], "rec string, subject string, objective string, score double").write.parquet(str(tmp_path / "bs"))
    cli.main(["--out", str(tmp_path / "q"), "broad-qc", "--table", str(tmp_path / "b"), "--scores", str(tmp_path / "bs"), "--key", "rec", "--subject", "subject", "--columns", "noise", "--rater", "rater", "--expected", "ann"], spark)
    assert spark.read.parquet(str(tmp_path / "q/alignment.parquet")).drop("subject").first().auc == 1.0 and spark.read.parquet(str(tmp_path / "q/design.parquet")).first().valid


def test_faults_stop_the_plan(spark):
    rows = spark.createDataFrame([("a", 0, 0.0, 2.0), ("a", 1, 1.0, 3.0)], "rec string, interval_index int, start double, end double")
    assert [r.fault for r in contracts.interval_faults(rows).collect()] == ["overlaps"]
    with pytest.raises(Exception, match="overlap"):
        contracts.faultless(rows).collect()
    assert contracts.faultless(rows.where("interval_index = 0")).count() == 1
    with pytest.raises(Exception, match="no frozen interval"):
        contracts.with_frozen_identity(spark.createDataFrame([("a", 2)], "rec string, interval_index int"), rows, "v", "p").collect()


def test_one_to_one_matching_is_optimal(spark):
    """Against all permutations on small random sets: most pairs first, then the least cost."""
    from itertools import permutations

    rng = np.random.default_rng(5)
    rows, want = ([], []), {}
    for k in range(12):
        a, b = (np.sort(rng.integers(0, 30, (rng.integers(1, 5), 2)), axis=1) + [0, 1] for _ in range(2))
        for side, x in zip(rows, (a, b), strict=True):
            side.extend((k, float(s), float(e)) for s, e in x)
        best = (0, 0.0)
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        for order in permutations(range(len(large)), len(small)):
            ok = [(x, large[j]) for x, j in zip(small, order, strict=True) if abs(x[0] - large[j][0]) <= 4 and abs(x[1] - large[j][1]) <= 4]
            cost = sum(abs(x[0] - y[0]) + abs(x[1] - y[1]) for x, y in ok)
            best = max(best, (len(ok), -float(cost)))
        want[k] = best
    a, b = (spark.createDataFrame(r, "rec long, start double, end double") for r in rows)
    got = {k: (0, 0.0) for k in want}
    for r in events.matched_one_to_one(a, b, "rec", "strict", 4.0).collect():
        n, c = got[r.rec]
        got[r.rec] = (n + 1, c - abs(r.a_start - r.b_start) - abs(r.a_end - r.b_end))
    assert got == want


def test_linear_prediction(spark):
    t = np.arange(400)
    x = np.sin(0.3 * t) + 0.001 * np.random.default_rng(0).standard_normal(400)
    guess, scale = measure.predicted_next(x[:-1], 4)
    assert abs(guess - x[-1]) < 0.1 and 0 < scale < 0.1
    assert measure.lpc(np.zeros(100), 4) is None and measure.lpc(x[:20], 4) is None and math.isnan(measure.predicted_next(np.zeros(100), 4)[0])


def test_square_waves_are_told_from_clipping(spark):
    t = np.arange(2000)
    rows = [("square", 1.0, np.sign(np.sin(0.2 * t) + 1e-9).tolist()), ("clipped", 1.0, np.clip(np.sin(0.05 * t), -0.8, 0.8).tolist()), ("sine", 1.0, np.sin(0.05 * t).tolist())]
    df = spark.createDataFrame(rows, "rec string, fs double, samples array<double>")
    found = measure.plateaus(df, 1e-6, 0.98, 3)
    edges = measure.edge_evidence(df, found, 50, 100, 0.01)
    got = {r.rec: r.square_like for r in measure.square_like(df, edges, 0.01, 0.9, 8).collect()}
    assert got == {"square": True, "clipped": False, "sine": False}
    beyond = {r.rec: r.beyond_samples for r in edges.collect() if r.sign == 1}
    assert beyond["clipped"] == 0


def test_streaming_refractory(spark, tmp_path):
    from cadenza.streaming import frames

    rows = [("a", 0, 1.0), ("a", 1, 5.0), ("a", 2, 3.0), ("a", 60, 2.0), ("b", 5, 1.0), ("z", 4000, 0.0)]
    df = spark.createDataFrame(rows, "k string, s long, v double").select("k", F.timestamp_seconds("s").alias("ts"), "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = frames.refractory(stream, "k", "ts", "v", 10.0, "1 seconds").writeStream.format("memory").queryName("refr").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.k, r.v) for r in spark.table("refr").collect())
    assert ("a", 5.0) in got and set(got) <= {("a", 5.0), ("a", 2.0), ("b", 1.0)} and len(set(got)) == len(got)


def test_tiers_and_empty_tables(spark):
    rows = spark.createDataFrame([(21.0, 300, 3), (21.0, 150, 2), (4.0, 30, 1), (1.0, 5, 0)], "s double, f int, g int")
    assert [r[0] for r in rows.select(robust.level_tier(F.col("s"), F.col("f"), F.col("g"))).collect()] == ["high", "moderate", "minimum", "unavailable"]
    none = spark.createDataFrame([], "rec string, start double, end double, kind string, level double, id long, t double, score double")
    assert events.merged_of_a_kind(none, ["rec"], ["kind"], 1).count() == 0 and events.suppressed(none, ["rec"], 1.0, 3).count() == 0
    assert summaries.histogram(none, "level", 4, 1.0).count() == 0 and robust.cluster_deletion(none, "rec", "kind", "level").count() == 0
