"""Commands end to end on small inputs."""

import json
import wave

import numpy as np
import pytest

from cadenza import cli


def test_audit_and_freeze(spark, tmp_path):
    (tmp_path / "m.csv").write_text("rec,age,sex\na,20,F\nb,200,M\nb,30,M\nc,,X\n")
    (tmp_path / "rules.json").write_text(json.dumps([{"rule": "in_range", "column": "age", "low": 18, "high": 120}, {"rule": "required", "column": "age"}, {"rule": "one_of", "column": "sex", "words": ["F", "M"]}]))
    common = ["--table", str(tmp_path / "m.csv"), "--key", "rec", "--rules", str(tmp_path / "rules.json")]
    cli.main(["--out", str(tmp_path / "o"), "audit", *common], spark)
    got = spark.read.parquet(str(tmp_path / "o/issues.parquet"))
    assert sorted((r.rec, r.rule) for r in got.collect()) == [("b", "value_out_of_range"), ("c", "required_value_missing"), ("c", "value_not_allowed")]
    cli.main(["--out", str(tmp_path / "f"), "freeze", *common, "--order", "age"], spark)
    assert sorted((r.rec, r.eligible) for r in spark.read.parquet(str(tmp_path / "f/cohort.parquet")).collect()) == [("a", True), ("b", True), ("c", False)]
    with pytest.raises(Exception, match="(?i)already.exists"):
        cli.main(["--out", str(tmp_path / "o"), "audit", *common], spark)


def test_segment_and_extract(spark, tmp_path):
    fs, rng = 8000, np.random.default_rng(0)
    x = rng.standard_normal(fs * 12) * 0.001
    speech = [(1.0, 3.0), (4.0, 6.0), (7.0, 9.0), (10.0, 11.5)]
    for a, b in speech:
        x[int(a * fs) : int(b * fs)] += 0.2 * rng.standard_normal(int((b - a) * fs))
    (tmp_path / "w").mkdir()
    with wave.open(str(tmp_path / "w/r1.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(fs)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    spark.createDataFrame([("r1", a, b) for a, b in speech], "rec string, start double, end double").write.parquet(str(tmp_path / "iv.parquet"))
    cli.main(["--out", str(tmp_path / "s"), "segment", "--intervals", str(tmp_path / "iv.parquet")], spark)
    cli.main(["--out", str(tmp_path / "e"), "extract", "--folder", str(tmp_path / "w"), "--intervals", str(tmp_path / "s/intervals.parquet")], spark)
    gain = spark.read.parquet(str(tmp_path / "e/gain.parquet")).first()
    assert gain.level_status == "ok" and abs(gain.level - 20 * np.log10(0.2)) < 1.0
    extra = spark.read.parquet(str(tmp_path / "e/additive.parquet")).first()
    assert abs(extra.level - 20 * np.log10(0.001)) < 1.5 and 40 < extra.contrast < 50


def test_human_qc(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 5.0, '{"h": [[0, 1]]}'), ("a", "y", 5.0, '{"h": [[0, 2]]}'), ("b", "x", 5.0, None), ("b", "y", 5.0, '{"h": [[1, 2]]}')], "item string, rater string, d double, noise string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    cli.main(["--out", str(tmp_path / "o"), "human-qc", "--table", str(tmp_path / "t.parquet"), "--item", "item", "--rater", "rater", "--duration", "d", "--categories", "noise"], spark)
    assert spark.read.parquet(str(tmp_path / "o/agreement.parquet")).first().observed == 0.5


def test_human_qc_counts_all_raters(spark, tmp_path):
    """An item that 1000 of 1001 raters saw is not complete."""
    rows = [(i, f"r{k}", 5.0, None) for i, n in (("a", 1001), ("b", 1000)) for k in range(n)]
    spark.createDataFrame(rows, "item string, rater string, d double, noise string").write.parquet(str(tmp_path / "t.parquet"))
    cli.main(["--out", str(tmp_path / "o"), "human-qc", "--table", str(tmp_path / "t.parquet"), "--item", "item", "--rater", "rater", "--duration", "d", "--categories", "noise"], spark)
    got = {r.raters: r.design for r in spark.read.parquet(str(tmp_path / "o/coverage.parquet")).collect()}
    assert got == {1001: "complete", 1000: "partial"}
