"""Readers, releases and streams on files made in the test."""

import datetime
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.sources import readers, release
from cadenza.streaming import frames


@pytest.fixture()
def wavs(tmp_path):
    x = (np.array([[0, 100], [1000, -100], [-2000, 50], [32767, 0]])).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(x.tobytes())
    (tmp_path / "b.wav").write_bytes(b"not audio")
    (tmp_path / "c.txt").write_text("no media")
    return tmp_path


def test_recordings_and_inventory(spark, wavs):
    rows = {(r.rec, r.channel): r for r in readers.recordings(spark, str(wavs)).collect()}
    assert rows["a", 0].fs == 8000 and np.allclose(rows["a", 0].samples, [0, 1000 / 32768, -2000 / 32768, 32767 / 32768])
    assert rows["b", 0].samples is None and rows["b", 0].status.startswith("decode_failed")
    m = readers.mono(readers.recordings(spark, str(wavs))).first()
    want = np.array([50, 450, -975, 16383.5]) / 32768
    assert np.allclose(m.samples, want - want.mean(), atol=1e-6)
    assert sorted(r.name for r in readers.media_inventory(spark, str(wavs)).collect()) == ["a.wav", "b.wav"]


def test_annotations_route_bad_cells(spark):
    df = spark.createDataFrame([("r", "x", 10.0, '{"hum": [[1, 3], [2, 4]], "hiss": [[5, 5]]}', "not json"), ("r", "y", 10.0, '{"hum": [[1], [11, 12], [-1, 2]]}', None)], "item string, rater string, d double, noise string, echo string")
    good, bad = readers.annotation_intervals(df, "item", "rater", ["noise", "echo"], "d")
    assert sorted((r.rater, r.start, r.end) for r in good.collect()) == [("x", 1.0, 3.0), ("x", 2.0, 4.0), ("y", 0.0, 2.0)]
    assert sorted((r.rater, r.issue) for r in bad.collect()) == [("x", "malformed_json"), ("x", "reversed_or_empty"), ("y", "not_a_pair"), ("y", "outside_duration")]
    ratings = {(r.rater, r.category): (r.rating, r.annotated_sec) for r in readers.annotation_ratings(df, good, "item", "rater", ["noise", "echo"], "d").collect()}
    assert ratings == {("x", "noise"): (1, 3.0), ("x", "echo"): (0, 0.0), ("y", "noise"): (1, 2.0), ("y", "echo"): (0, 0.0)}


def test_sheets_stay_text(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,decision\n1,NA\n2,\n")
    got = readers.read_sheet(spark, str(tmp_path / "s.csv"), ["id", "decision"])
    assert sorted((r.id, r.decision) for r in got.collect()) == [("1", "NA"), ("2", "")]
    with pytest.raises(ValueError, match="missing columns: x"):
        readers.read_sheet(spark, str(tmp_path / "s.csv"), ["x"])
    assert readers.find_column(got, ["verdict", "decision"]) == "decision"


def test_versions_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    root = str(tmp_path / "store")
    release.save_version(df, root, "t", "1")
    assert release.content_hash(release.read_version(spark, root, "t", "1")) == release.content_hash(df)
    with pytest.raises(Exception, match="(?i)already.exists"):
        release.save_version(df, root, "t", "1")
    release.save_bundle(df, root, "bundle")
    rows = release.manifest(spark, root).collect()
    before, n = spark.createDataFrame(rows), len(rows)
    assert release.verify(before, release.manifest(spark, root)).count() == 0
    (tmp_path / "store" / "new.bin").write_bytes(b"1")
    assert [(r.file, r.status) for r in release.verify(before, release.manifest(spark, root)).collect()] == [("new.bin", "unexpected")] and n > 0


def test_release_needs_equal_cohorts(spark):
    a = spark.createDataFrame([(1, 0.5, "ok"), (2, None, "insufficient")], "rec int, f double, f_status string")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "rec int, g double")
    out = release.build_release({"a": a, "b": b}, "rec", {"a": ["f"], "b": ["g"]})
    assert sorted(out.columns) == ["f", "f_status", "g", "rec"] and out.count() == 2
    with pytest.raises(Exception, match="recording missing in: b"):
        release.build_release({"a": a, "b": b.limit(1)}, "rec", {"a": ["f"], "b": ["g"]}).collect()
    with pytest.raises(ValueError, match="repeats"):
        release.registry(spark, [{"feature": "f"}, {"feature": "f"}])


def test_streams(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [("r", start + datetime.timedelta(seconds=s), float(s)) for s in (0, 1, 2, 10, 11, 100)]
    spark.createDataFrame(rows, "rec string, ts timestamp, level double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rec string, ts timestamp, level double").parquet(str(tmp_path / "in"))
    out = frames.episodes(stream, "rec", "ts", "5 seconds", "0 seconds").writeStream.format("memory").queryName("episodes").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted((r.n for r in spark.table("episodes").collect()))[:2] == [2, 3]
    seen = []
    frames.into_versions(stream, lambda batch, _: seen.append(batch.agg(F.count(F.lit(1))).first()[0]), str(tmp_path / "ck")).awaitTermination()
    assert sum(seen) == 6
    windows = frames.sliding_levels(spark.read.parquet(str(tmp_path / "in")), "rec", "ts", "level", "4 seconds", "2 seconds", "0 seconds")
    assert {(r.n, r.level) for r in windows.collect()} >= {(3, 1.0), (2, 10.5)}
