"""Signal measurement: frame and spectral ledgers from waveforms, and recording features rebuilt from them.

Recordings are rows (rec, fs, samples array<float>), one for each channel; intervals are rows (rec, idx, start, end) in
seconds. Kernels that need the samples of a frame run batch-wise over Arrow, one recording at a time; everything after
the ledgers is SQL, so a feature can be rebuilt from its stored ledger. Values without enough support are NULL with a
status that says why, and their raw estimates stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks, runs


@dataclass(frozen=True)
class Frames:
    frame_ms: float = 40.0
    hop_ms: float = 10.0
    floor_db: float = -120.0


@dataclass(frozen=True)
class GainSupport:
    """Least and higher support of the gain features. Fixed values."""

    guard_sec: float = 0.2
    floor_fraction: float = 0.02
    segment_frames: int = 5
    frames: int = 25
    between_segments: int = 3
    drift_segments: int = 3
    drift_span_sec: float = 10.0
    mad_factor: float = 1.482602218505602


def with_intervals(recordings: DataFrame, intervals: DataFrame) -> DataFrame:
    """recordings with their intervals as one sorted array; recordings without any are dropped."""
    per = intervals.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("idx", "start", "end"))).alias("spans"))
    return recordings.join(per, "rec")


#: Rows that a kernel's output gathers before it goes on.
GATHERED = 50_000


def _rows_of(kernel, names: list[str], types: list[pa.DataType]):
    """A mapInArrow function that calls kernel(fs, samples, spans) for each row (rec, fs, samples, spans). A kernel gives
    one array for each name, all of one length, or None; NaN and infinities become NULL."""

    def packed(batch, held):
        recs = batch.column(0).take(pa.array(np.repeat([i for i, _ in held], [len(c[0]) for _, c in held])))
        out = []
        for k, t in enumerate(types):
            if pa.types.is_list(t):
                out.append(pa.array([v for _, c in held for v in c[k]], t))
            else:
                v = np.concatenate([np.asarray(c[k]) for _, c in held])
                out.append(pa.array(v, t, mask=~np.isfinite(v)) if pa.types.is_floating(t) else pa.array(v, t))
        return pa.RecordBatch.from_arrays([recs, *out], ["rec", *names])

    def run(batches):
        for batch in batches:
            samples = batch.column(2)
            flat, cut = samples.values.to_numpy(zero_copy_only=False), samples.offsets.to_numpy()
            held, n = [], 0
            for i, (fs, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x = flat[cut[i] : cut[i + 1]].astype(np.float64)
                found = kernel(float(fs), x, spans or ())
                if found is None or not len(found[0]):
                    continue
                held.append((i, found))
                n += len(found[0])
                if n > GATHERED:
                    yield packed(batch, held)
                    held, n = [], 0
            if held:
                yield packed(batch, held)

    return run


def frames_within(fs: float, x: np.ndarray, spans, frame_ms: float, hop_ms: float):
    """For each span that holds a whole frame: its idx, the first sample of each of its frames, the frames as rows.
    Sample bounds round half to even."""
    size, hop = round(frame_ms * fs / 1000), max(1, round(hop_ms * fs / 1000))
    for s in spans:
        lo, hi = max(0, round(s["start"] * fs)), min(len(x), round(s["end"] * fs))
        if size >= 1 and hi - lo >= size:
            yield s["idx"], np.arange(lo, hi - size + 1, hop), np.lib.stride_tricks.sliding_window_view(x[lo:hi], size)[::hop]


def joined(parts: list[tuple]) -> tuple | None:
    """Columns of several parts one below another."""
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else None


def frame_ledger(recordings: DataFrame, intervals: DataFrame, p: Frames = Frames()) -> DataFrame:
    """rec, idx, frame, start, mid, rms, level, at_floor: frames that lie wholly within one interval, their mean
    removed; frames of no more than the floor's amplitude are at the floor."""

    def kernel(fs, x, spans):
        floor, parts = 10 ** (p.floor_db / 20), []
        for idx, left, cut in frames_within(fs, x, spans, p.frame_ms, p.hop_ms):
            rms = np.sqrt(((cut - cut.mean(1, keepdims=True)) ** 2).mean(1))
            low = rms <= floor
            level = np.where(low, p.floor_db, 20 * np.log10(np.where(low, 1.0, rms)))
            parts.append((np.full(len(left), idx), np.arange(len(left)), left / fs, (2 * left + cut.shape[1]) / (2 * fs), rms, level, low))
        return joined(parts)

    kind = recordings.schema["rec"].dataType.simpleString()
    rows = with_intervals(recordings, intervals).select("rec", "fs", "samples", "spans")
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
    return rows.mapInArrow(_rows_of(kernel, ["idx", "frame", "start", "mid", "rms", "level", "at_floor"], types), f"rec {kind}, idx long, frame long, start double, mid double, rms double, level double, at_floor boolean")


def segment_ledger(frames: DataFrame, p: GainSupport = GainSupport()) -> DataFrame:
    """Per interval: frames, those above the floor, their median and IQR where there are enough, its middle."""
    level = F.when(~F.col("at_floor"), F.col("level"))
    out = frames.groupBy("rec", "idx").agg(F.count(F.lit(1)).alias("frames"), F.count(level).alias("valid"), F.avg("mid").alias("mid"), F.percentile(level, 0.5).alias("median"), (F.percentile(level, 0.75) - F.percentile(level, 0.25)).alias("iqr"))
    usable = F.col("valid") >= p.segment_frames
    return out.withColumns({"usable": usable, "median": F.when(usable, F.col("median")), "iqr": F.when(usable, F.col("iqr"))})


def gated(raw: Column, problems: dict[str, Column]) -> tuple[Column, Column]:
    """The published value, NULL at the first problem, and its status: that problem's name or ok."""
    status = F.lit("ok")
    for name, broken in reversed(problems.items()):
        status = F.when(F.coalesce(broken, F.lit(True)), name).otherwise(status)
    return F.when(status == "ok", raw), status


def gain_features(frames: DataFrame, p: GainSupport = GainSupport()) -> DataFrame:
    """Per recording: typical level (median of segment medians), within-segment IQR of levels centred on their segment,
    between-segment spread, absolute drift a minute (Theil-Sen over segments); raw, published and status of each."""
    seg = segment_ledger(frames, p)
    good = seg.where("usable")
    level = F.when(~F.col("at_floor"), F.col("level"))
    support = frames.groupBy("rec").agg(F.count(F.lit(1)).alias("frames"), F.count(level).alias("valid"), F.avg(F.col("at_floor").cast("double")).alias("floor_fraction"))
    centred = frames.where("NOT at_floor").join(good.select("rec", "idx", F.col("median").alias("__m")), ["rec", "idx"]).withColumn("__c", F.col("level") - F.col("__m"))
    within = centred.groupBy("rec").agg((F.percentile("__c", 0.75) - F.percentile("__c", 0.25)).alias("within_raw"))
    typical = good.groupBy("rec").agg(F.count(F.lit(1)).alias("segments"), F.percentile("median", 0.5).alias("level_raw"), (F.max("mid") - F.min("mid")).alias("span"))
    spread = ranks.robust_spread(good, ["rec"], "median").select("rec", (F.col("mad") / 1.4826 * p.mad_factor).alias("between_raw"))
    drift = ranks.theil_sen(good.withColumn("minutes", F.col("mid") / 60), ["rec"], "minutes", "median").select("rec", F.abs("slope").alias("drift_raw"))
    rows = support
    for part in (typical, within, spread, drift):
        rows = rows.join(part, "rec", "left")
    base = {"floor_censored": F.col("floor_fraction") > p.floor_fraction, "insufficient_frames": F.col("valid") < p.frames, "insufficient_segments": F.coalesce("segments", F.lit(0)) < 1}
    more = {"between": {"insufficient_segments": F.coalesce("segments", F.lit(0)) < p.between_segments}, "drift": {"insufficient_segments": F.coalesce("segments", F.lit(0)) < p.drift_segments, "insufficient_span": F.col("span") < p.drift_span_sec}}
    for name in ("level", "within", "between", "drift"):
        value, status = gated(F.col(f"{name}_raw"), {**base, **more.get(name, {})})
        rows = rows.withColumns({name: value, f"{name}_status": status})
    return rows


def drift_permutation(segments: DataFrame, iterations: int) -> DataFrame:
    """rec, p: share of time orders, drawn by hash, whose drift is at least the observed, the observed one counted in.

    Each replicate deals the segments' times anew; pairs are those of one recording's segments."""
    good = segments.where("usable").select("rec", "idx", "mid", "median")
    w = Window.partitionBy("rec").orderBy("idx")
    numbered = good.withColumn("__k", F.row_number().over(w))
    many = numbered.select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("replicate"))
    dealt = many.withColumn("__j", F.row_number().over(Window.partitionBy("rec", "replicate").orderBy(F.md5(F.concat_ws("|", "replicate", "rec", "idx")))))
    times = numbered.select("rec", F.col("__k").alias("__j"), F.col("mid").alias("__t"))
    shuffled = dealt.join(times, ["rec", "__j"])
    null = ranks.theil_sen(shuffled, ["rec", "replicate"], "__t", "median").select("rec", F.abs("slope").alias("__s"))
    real = ranks.theil_sen(good, ["rec"], "mid", "median").select("rec", F.abs("slope").alias("__o"))
    return null.join(real, "rec").groupBy("rec").agg(((F.count_if(F.col("__s") >= F.col("__o") - 1e-12) + 1) / F.lit(iterations + 1.0)).alias("p"))


# Spectra


def power_spectrum(x: np.ndarray, fs: float, n_fft: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density of mean-removed, Hann-windowed samples; rows of samples give rows of powers."""
    size = x.shape[-1]
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    n = n_fft or size
    power = np.abs(np.fft.rfft((x - x.mean(-1, keepdims=True)) * w, n)) ** 2 / (fs * (w**2).sum())
    power[..., 1 : power.shape[-1] - (1 if n % 2 == 0 else 0)] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power


def flatness(freq: np.ndarray, power: np.ndarray, low: float = 80.0, high: float = 7000.0) -> np.ndarray:
    """Geometric over arithmetic mean of the band, of each row; NaN below three bins or without power."""
    band = power[..., (freq >= low) & (freq <= high)]
    if band.shape[-1] < 3:
        return np.full(power.shape[:-1], np.nan)
    most = band.max(-1, keepdims=True)
    band = band + np.maximum(most * 1e-15, np.finfo(float).tiny)
    return np.where(most[..., 0] > 0, np.exp(np.log(band).mean(-1)) / band.mean(-1), np.nan)


def hum_score(freq: np.ndarray, power: np.ndarray, fundamental: float, harmonics: int = 4, tone: float = 2.0, inner: float = 6.0, outer: float = 14.0, top: float = 1000.0) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the median over harmonics of their level above the median of the band beside them, in dB, and how many
    harmonics rise 6 dB above it. Harmonics beyond `top`, or that no bin is near to, do not count."""
    places = fundamental * np.arange(1, harmonics + 1)
    distance = np.abs(freq[None, :] - places[places <= top][:, None])
    near, beside = distance <= tone, (distance >= inner) & (distance <= outer)
    usable = np.flatnonzero(near.any(1) & beside.any(1))
    if not len(usable):
        return np.full(power.shape[:-1], np.nan), np.zeros(power.shape[:-1], dtype=int)
    ground = np.stack([np.median(power[..., beside[h]], axis=-1) for h in usable], axis=-1)
    level = np.stack([power[..., near[h]].mean(-1) for h in usable], axis=-1)
    eps = np.maximum(ground * 1e-12, np.finfo(float).tiny)
    rise = 10 * (np.log10(level + eps) - np.log10(ground + eps))
    return np.median(rise, axis=-1), (rise >= 6.0).sum(-1)


def spectral_windows(recordings: DataFrame, intervals: DataFrame, window_ms: float, hop_ms: float, low: float = 80.0, high: float = 7000.0) -> DataFrame:
    """rec, idx, window, start, flatness, hum50, hum60, supported50, supported60 of windows within intervals; windows with
    a sample that is no number are left out."""

    def kernel(fs, x, spans):
        parts = []
        for idx, left, cut in frames_within(fs, x, spans, window_ms, hop_ms):
            whole = np.flatnonzero(np.isfinite(cut).all(1))
            f, power = power_spectrum(cut[whole], fs)
            (a, na), (b, nb) = hum_score(f, power, 50.0), hum_score(f, power, 60.0)
            parts.append((np.full(len(whole), idx), whole, left[whole] / fs, flatness(f, power, low, high), a, b, na, nb))
        return joined(parts)

    kind = recordings.schema["rec"].dataType.simpleString()
    types = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.int64()]
    names = ["idx", "window", "start", "flatness", "hum50", "hum60", "supported50", "supported60"]
    return with_intervals(recordings, intervals).select("rec", "fs", "samples", "spans").mapInArrow(_rows_of(kernel, names, types), f"rec {kind}, idx long, window long, start double, flatness double, hum50 double, hum60 double, supported50 long, supported60 long")


def window_shapes(recordings: DataFrame, intervals: DataFrame, window_ms: float, hop_ms: float, most_lag_ms: float, shortest: float = 500.0) -> DataFrame:
    """rec, idx, window, start, entropy, similarity, lag of windows within intervals: entropy of the spectrum's shares over
    its largest possible value; the largest cosine of the window and itself moved by up to most_lag_ms, and that lag in
    seconds. Lags begin at one period of `shortest` hertz; NULL below 16 samples or without spread."""

    def kernel(fs, x, spans):
        parts = []
        for idx, left, cut in frames_within(fs, x, spans, window_ms, hop_ms):
            whole = np.flatnonzero(np.isfinite(cut).all(1))
            c = cut[whole] - cut[whole].mean(1, keepdims=True)
            n = c.shape[1]
            power = np.abs(np.fft.rfft(c * np.hanning(n))) ** 2
            total = power.sum(1, keepdims=True)
            share = np.divide(power, total, out=np.zeros_like(power), where=total > 0)
            entropy = -(share * np.log(share + 1e-20)).sum(1) / np.log(power.shape[1])
            lags = np.arange(max(1, round(fs / shortest)), min(n // 2, round(most_lag_ms * fs / 1000)) + 1)
            best, at = np.full(len(c), np.nan), np.full(len(c), np.nan)
            if n >= 16 and len(lags):
                cosines = np.stack([_cosines(c[:, k:], c[:, :-k]) for k in lags], axis=1)
                some = np.flatnonzero(np.isfinite(cosines).any(1) & (c != 0).any(1))
                first = np.nanargmax(cosines[some], axis=1)
                best[some], at[some] = cosines[some, first], lags[first] / fs
            parts.append((np.full(len(whole), idx), whole, left[whole] / fs, entropy if n >= 8 else np.full(len(c), np.nan), best, at))
        return joined(parts)

    kind = recordings.schema["rec"].dataType.simpleString()
    names = ["idx", "window", "start", "entropy", "similarity", "lag"]
    return with_intervals(recordings, intervals).select("rec", "fs", "samples", "spans").mapInArrow(_rows_of(kernel, names, [pa.int64(), pa.int64(), *[pa.float64()] * 4]), f"rec {kind}, idx long, window long, start double, entropy double, similarity double, lag double")


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, NaN where one has no length."""
    size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return np.divide((a * b).sum(1), size, out=np.full(len(a), np.nan), where=size > 0)


def additive_features(pauses: DataFrame, speech: DataFrame, spectral: DataFrame, least_frames: int = 20, least_windows: int = 3, floor_fraction: float = 0.02) -> DataFrame:
    """Per recording from frame ledgers of pauses and speech and a spectral ledger of pauses: pause level and IQR,
    speech-to-pause contrast, flatness, the stronger hum; each with its status."""
    level = F.when(~F.col("at_floor"), F.col("level"))
    p = pauses.groupBy("rec").agg(F.count(level).alias("pause_frames"), F.avg(F.col("at_floor").cast("double")).alias("floor_fraction"), F.percentile(level, 0.5).alias("level_raw"), (F.percentile(level, 0.75) - F.percentile(level, 0.25)).alias("iqr_raw"))
    s = speech.groupBy("rec").agg(F.count(level).alias("speech_frames"), F.percentile(level, 0.5).alias("__speech"))
    w = spectral.groupBy("rec").agg(F.count("flatness").alias("windows"), F.percentile("flatness", 0.5).alias("flatness_raw"), F.percentile("hum50", 0.5).alias("__h50"), F.percentile("hum60", 0.5).alias("__h60"))
    rows = s.join(p, "rec", "full_outer").join(w, "rec", "full_outer").withColumns({"contrast_raw": F.col("__speech") - F.col("level_raw"), "hum_raw": F.greatest("__h50", "__h60"), "hum_hz": F.when(F.col("__h60") > F.col("__h50"), 60).when(F.col("__h50").isNotNull(), 50)})
    few, censored, none = F.coalesce("pause_frames", F.lit(0)) < least_frames, F.col("floor_fraction") > floor_fraction, F.col("pause_frames").isNull()
    windows = {"no_strict_pause": none, "insufficient_windows": F.coalesce("windows", F.lit(0)) < least_windows}
    levels = {"no_strict_pause": none, "insufficient_support": few, "floor_censored": censored}
    for name, why in {"level": levels, "iqr": levels, "contrast": {**levels, "no_speech": F.col("__speech").isNull()}, "flatness": windows, "hum": windows}.items():
        value, status = gated(F.col(f"{name}_raw"), why)
        rows = rows.withColumns({name: value, f"{name}_status": status})
    return rows.drop("__speech", "__h50", "__h60")


def rest_reference(frames: DataFrame, windows: DataFrame, spans: DataFrame, least_sec: float = 1.0, least_frames: int = 20) -> DataFrame:
    """Per recording at rest, from its frame and spectral ledgers over spans(rec, start, end): seconds, level, IQR,
    transients a minute (runs of frames 12 dB or six scaled deviations above the median), flatness, the stronger hum and
    status. Context of a session, not a calibrated floor."""
    support = spans.groupBy("rec").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))
    spread = ranks.robust_spread(frames, ["rec"], "level").select("rec", F.col("n").alias("frames"), F.col("median").alias("level_raw"), F.col("iqr").alias("iqr_raw"), "mad")
    loud = frames.join(spread.select("rec", (F.col("level_raw") + F.greatest(F.lit(12.0), 6 * F.col("mad"))).alias("__limit")), "rec")
    found = runs.runs(loud, ["rec"], ["idx", "frame"], F.col("level") >= F.col("__limit")).groupBy("rec").agg(F.count(F.lit(1)).alias("__t"))
    seen = windows.groupBy("rec").agg(F.percentile("flatness", 0.5).alias("__f"), F.percentile("hum50", 0.5).alias("__h50"), F.percentile("hum60", 0.5).alias("__h60"))
    rows = support.join(spread, "rec", "left").join(found, "rec", "left").join(seen, "rec", "left").fillna(0, ["__t"])
    raw = {"level": F.col("level_raw"), "iqr": F.col("iqr_raw"), "transients_per_min": F.col("__t") / F.col("seconds") * 60, "flatness": F.col("__f"), "hum": F.greatest("__h50", "__h60")}
    why = {"insufficient_support": (F.col("seconds") < least_sec) | (F.coalesce("frames", F.lit(0)) < least_frames)}
    _, status = gated(F.lit(1), why)
    return rows.select("rec", "seconds", *[gated(v, why)[0].alias(n) for n, v in raw.items()], status.alias("status"))


def hum_excess(recordings: DataFrame, calibration: DataFrame) -> DataFrame:
    """recordings(rec, hum, windows) with the null threshold of the largest calibrated window count not above their own
    (the smallest if none is) and the excess over it; calibration(windows, p95) is a table of a few counts."""
    grid = calibration.groupBy().agg(F.array_sort(F.collect_list(F.struct("windows", "p95"))).alias("__g"))
    rows = recordings.crossJoin(F.broadcast(grid))
    fit = F.filter("__g", lambda g: g["windows"] <= F.col("windows"))
    pick = F.when(F.size(fit) > 0, F.element_at(fit, -1)).otherwise(F.element_at("__g", 1))
    return rows.withColumn("__p", pick).withColumn("null_p95", F.col("__p.p95")).withColumn("excess", F.col("hum") - F.col("null_p95")).drop("__g", "__p")


# Tails after speech


def boundary_features(trace: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Per boundary (rec, boundary, pause): reason for exclusion, floor, tail excess, persistence, decay.

    trace(rec, boundary, rel, level, at_floor) holds frames by seconds after the end of speech. Windows: early 0-0.1 s,
    floor 0.7-1 s, decay 0-0.3 s; a tail ends at the first three frames in a row within 3 dB of the floor, or is
    censored at 0.6 s. Fixed values."""
    key = ["rec", "boundary"]
    level = F.when(~F.col("at_floor"), F.col("level"))
    early, late, decay = F.col("rel").between(0, 0.1), F.col("rel").between(0.7, 1.0), F.col("rel").between(0, 0.3)
    stats = trace.groupBy(*key).agg(
        F.count(F.when(early, level)).alias("early_frames"), F.percentile(F.when(early, level), 0.5).alias("early_level"), F.count(F.when(late, level)).alias("floor_frames"),
        F.percentile(F.when(late, level), 0.5).alias("floor_level"), (F.percentile(F.when(late, level), 0.75) - F.percentile(F.when(late, level), 0.25)).alias("floor_iqr"), F.avg(F.when(late, F.col("at_floor").cast("double"))).alias("floor_fraction"),
        F.count(F.when(decay, level)).alias("decay_frames"), (F.percentile(F.when(decay, level), 0.9) - F.percentile(F.when(decay, level), 0.1)).alias("decay_range"),
    )
    slope = ranks.theil_sen(trace.where(decay & ~F.col("at_floor")), key, "rel", "level").select(*key, "slope")
    near = trace.where(F.col("rel").between(0, 0.6)).join(stats.select(*key, "floor_level"), key)
    hit = runs.first_sustained(near, key, ["rel"], F.col("level") <= F.col("floor_level") + 3.0, 3)
    w = Window.partitionBy(*key).orderBy("rel")
    at = near.withColumn("first_index", F.row_number().over(w) - 1).join(hit, [*key, "first_index"]).select(*key, F.col("rel").alias("__hit"))
    counts = near.groupBy(*key).agg(F.count(F.lit(1)).alias("persistence_frames"))
    rows = boundaries
    for part in (stats, slope, at, counts):
        rows = rows.join(part, key, "left")
    _, reason = gated(F.lit(1), {"pause_shorter_than_floor_window": F.col("pause") < 1.0, "insufficient_early_frames": F.coalesce("early_frames", F.lit(0)) < 5, "insufficient_nonfloor_floor_frames": F.coalesce("floor_frames", F.lit(0)) < 20, "digital_floor_censored": F.col("floor_fraction") > 0.1, "unstable_late_pause_floor": F.col("floor_iqr") > 12.0})
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason") == "ok"
    persistent = ok & (F.coalesce("persistence_frames", F.lit(0)) >= 50)
    falling = ok & (F.coalesce("decay_frames", F.lit(0)) >= 20) & (F.col("slope") < 0) & (F.col("decay_range") >= 3.0)
    return rows.withColumns({
        "tail_excess": F.when(ok, F.col("early_level") - F.col("floor_level")), "persistence": F.when(persistent, F.coalesce("__hit", F.lit(0.6))),
        "persistence_censored": F.when(persistent, F.col("__hit").isNull()), "decay_rate": F.when(falling, -F.col("slope")),
    }).drop("__hit")


def reverb_features(boundaries: DataFrame, least: int = 2) -> DataFrame:
    """Medians over a recording's eligible boundaries where there are `least`, raw medians and counts always."""
    names = ["tail_excess", "persistence", "decay_rate"]
    out = boundaries.groupBy("rec").agg(F.count(F.lit(1)).alias("boundaries"), *[x for n in names for x in (F.count(n).alias(f"{n}_count"), F.percentile(n, 0.5).alias(f"{n}_raw"))])
    for n in names:
        value, status = gated(F.col(f"{n}_raw"), {"no_eligible_boundary": F.col(f"{n}_count") == 0, "insufficient_boundaries": F.col(f"{n}_count") < least})
        out = out.withColumns({n: value, f"{n}_status": status})
    return out.withColumns({"srmr": F.lit(None).cast("double"), "srmr_status": F.lit("dependency_unavailable")})


# Channel


@dataclass(frozen=True)
class Band:
    low: float = 100.0
    high: float = 7500.0
    high_from: float = 3000.0
    tilt_to: float = 4000.0
    n_fft: int = 2048
    floor_db: float = -80.0


def trapezoid_weights(freq: np.ndarray, low: float, high: float) -> np.ndarray:
    """Weights whose product with a density on freq is its integral over the bins of [low, high]; NaN below two bins."""
    m = np.flatnonzero((freq >= low) & (freq <= high))
    w = np.zeros(len(freq))
    if len(m) < 2:
        return np.full(len(freq), np.nan)
    half = np.diff(freq[m]) / 2
    w[m[:-1]] += half
    w[m[1:]] += half
    return w


def third_octaves(freq: np.ndarray, power: np.ndarray, b: Band = Band()) -> tuple[np.ndarray, np.ndarray]:
    """Centres and mean density in dB of third-octave bands, no lower than the floor below the band's peak."""
    count = int(np.floor(3 * np.log2(b.high / b.low) + 1e-9)) + 1
    centres = b.low * np.exp2(np.arange(count) / 3)
    bands = np.stack([trapezoid_weights(freq, max(b.low, c * 2 ** (-1 / 6)), min(b.high, c * 2 ** (1 / 6))) for c in centres])
    density = (bands @ power) / bands.sum(1)
    floor = power[(freq >= b.low) & (freq <= b.high)].max() * 10 ** (b.floor_db / 10)
    return centres, 10 * np.log10(np.where(np.isnan(density), np.nan, np.maximum(density, floor)))


def describe_spectrum(freq: np.ndarray, power: np.ndarray, b: Band = Band()) -> tuple[float, float, float]:
    """95 % roll-off in Hz, share of the high band, tilt in dB an octave (median of pairwise slopes of six bands or more)."""
    none = (float("nan"),) * 3
    whole, upper = trapezoid_weights(freq, b.low, b.high) @ power, trapezoid_weights(freq, b.high_from, b.high) @ power
    if not whole > np.finfo(float).tiny:
        return none
    f = freq[(freq >= b.low) & (freq <= b.high)]
    reached = np.array([trapezoid_weights(freq, b.low, x) @ power if k else 0.0 for k, x in enumerate(f)])
    k = int(np.searchsorted(reached, 0.95 * whole))
    rolloff = f[k - 1] + (f[k] - f[k - 1]) * (0.95 * whole - reached[k - 1]) / (reached[k] - reached[k - 1])
    centres, levels = third_octaves(freq, power, b)
    use = (centres <= b.tilt_to) & np.isfinite(levels)
    rise, run = np.subtract.outer(levels[use], levels[use]), np.subtract.outer(np.log2(centres[use]), np.log2(centres[use]))
    tilt = float(np.median(rise[run > 0] / run[run > 0])) if use.sum() >= 6 else float("nan")
    return float(rolloff), float(upper / whole), tilt


def channel_spectra(recordings: DataFrame, intervals: DataFrame, p: Frames = Frames(), b: Band = Band()) -> DataFrame:
    """rec, frames, freq, psd (unit area in the band), rolloff, highband, tilt over all frames within intervals; those with a
    sample that is no number are left out. Without power psd and what follows from it are NULL."""

    def kernel(fs, x, spans):
        total, n, freq = 0.0, 0, None
        for _, _, cut in frames_within(fs, x, spans, p.frame_ms, p.hop_ms):
            cut = cut[np.isfinite(cut).all(1)]
            for lo in range(0, len(cut), 2000):
                freq, power = power_spectrum(cut[lo : lo + 2000], fs, max(b.n_fft, cut.shape[1]))
                total, n = total + power.sum(0), n + len(power)
        if not n:
            return None
        area = trapezoid_weights(freq, b.low, b.high) @ total
        psd = total / area if area > 0 else None
        described = describe_spectrum(freq, psd, b) if psd is not None else (float("nan"),) * 3
        return [n], [freq.tolist()], [None if psd is None else psd.tolist()], *([v] for v in described)

    kind = recordings.schema["rec"].dataType.simpleString()
    types = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64()]
    return with_intervals(recordings, intervals).select("rec", "fs", "samples", "spans").mapInArrow(_rows_of(kernel, ["frames", "freq", "psd", "rolloff", "highband", "tilt"], types), f"rec {kind}, frames long, freq array<double>, psd array<double>, rolloff double, highband double, tilt double")


# Distortion and discontinuities


def sample_runs(joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run; joins tells of each place whether it belongs to the run of the one before."""
    first = np.flatnonzero(~joins)
    return first, np.append(first[1:], len(joins)) - 1


def without_intervals(recordings: DataFrame) -> DataFrame:
    return recordings.select("rec", "fs", "samples", F.expr("CAST(NULL AS array<struct<idx: int, start: double, end: double>>)").alias("spans"))


def plateaus(recordings: DataFrame, tolerance: float = 1e-4, near: float = 0.98, least: int = 3) -> DataFrame:
    """Candidate clipping: runs of at least `least` samples of one sign, each within tolerance of the one before and at
    least `near` of the recording's peak: rec, first, last, length, level (the median)."""

    def kernel(fs, x, spans):
        peak = np.nanmax(np.abs(x), initial=0.0) if len(x) else 0.0
        if not peak > 0:
            return None
        high = np.abs(x) >= near * peak
        joins = np.zeros(len(x), dtype=bool)
        joins[1:] = high[1:] & high[:-1] & (np.abs(np.diff(x)) <= tolerance * peak)
        first, last = sample_runs(joins)
        use = high[first] & (last - first + 1 >= least)
        first, last = first[use], last[use]
        return first, last, last - first + 1, np.array([np.median(x[a : b + 1]) for a, b in zip(first, last, strict=True)])

    kind = recordings.schema["rec"].dataType.simpleString()
    rows = without_intervals(recordings).mapInArrow(_rows_of(kernel, ["first", "last", "length", "level"], [pa.int64(), pa.int64(), pa.int64(), pa.float64()]), f"rec {kind}, first long, last long, length long, level double")
    return rows.select("rec", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), "length", "level")


def channel_tolerances(recordings: DataFrame, step: Column, flat: float = 1e-6, relative: float = 1e-5, flat_steps: float = 0.5, cluster_steps: float = 2.0, cluster_share: float = 2e-3) -> DataFrame:
    """rec, robust_peak (99.9 % quantile of absolute samples), flat_tolerance, cluster_tolerance. step: width of an integer
    code, NULL where samples are floating; then tolerances follow the peak."""

    def kernel(fs, x, spans):
        x = np.abs(x[np.isfinite(x)])
        return ([float(np.quantile(x, 0.999)) if len(x) else np.nan],)

    kind = recordings.schema["rec"].dataType.simpleString()
    peaks = without_intervals(recordings).mapInArrow(_rows_of(kernel, ["robust_peak"], [pa.float64()]), f"rec {kind}, robust_peak double")
    out = recordings.select("rec", step.cast("double").alias("__step")).join(peaks, "rec")
    known = F.col("__step") > 0
    flat_tolerance = F.when(known, F.greatest(F.lit(flat), F.col("__step") * flat_steps)).otherwise(F.greatest(F.lit(flat), F.col("robust_peak") * relative))
    out = out.withColumn("flat_tolerance", flat_tolerance)
    cluster = F.greatest("flat_tolerance", F.when(known, F.col("__step") * cluster_steps).otherwise(F.col("robust_peak") * cluster_share))
    return out.withColumn("cluster_tolerance", cluster).drop("__step")


def edge_evidence(recordings: DataFrame, found: DataFrame, context: int, gap: int, zone: float, beyond_share: float = 0.001) -> DataFrame:
    """Per recording and sign of its plateaus (rec, first, last, length, level): what lies around their common level, in
    windows around them. Plateaus `gap` samples apart or less make one window from the first to the last of them, others
    one of `context` samples on both sides. rec, sign, edge (mean level, weighted by length), edge_samples within `zone`
    of it, interior_samples in the shell from two to four zones below, beyond_samples above it, ratio, excess, allowed."""
    spans = F.array_sort(F.collect_list(F.struct(F.col("first").cast("long").alias("idx"), F.col("last").cast("double").alias("start"), F.col("level").alias("end"))))
    signed = found.withColumn("sign", F.signum("level").cast("int"))
    rows = recordings.join(signed.groupBy("rec", "sign").agg(spans.alias("spans")), "rec").select("rec", F.col("sign").cast("double").alias("fs"), "samples", "spans")

    def kernel(sign, x, spans):
        first, last, level = (np.array([s[k] for s in spans]) for k in ("idx", "start", "end"))
        last = last.astype(np.int64)
        apart = np.concatenate(([True], first[1:] - (last[:-1] + 1) > gap))
        group = np.cumsum(apart) - 1
        single = np.bincount(group)[group] == 1
        inside = np.zeros(len(x) + 1, dtype=np.int64)
        for g in range(group[-1] + 1):
            on = np.flatnonzero(group == g)
            pad = context if single[on[0]] else 0
            inside[max(0, first[on[0]] - pad)] += 1
            inside[min(len(x), last[on].max() + 1 + pad)] -= 1
        v = sign * x[np.cumsum(inside[:-1]) > 0]
        v = v[np.isfinite(v)]
        edge = sign * float(np.average(level, weights=last - first + 1))
        at, below, above = (np.abs(v - edge) <= zone).sum(), ((v >= edge - 4 * zone) & (v < edge - 2 * zone)).sum(), (v > edge + zone).sum()
        allowed = max(1, int(np.ceil(beyond_share * len(v))))
        return [int(sign)], [sign * edge], [at], [below], [above], [at / max(1, below)], [at - below], [allowed]

    kind = recordings.schema["rec"].dataType.simpleString()
    names = ["sign", "edge", "edge_samples", "interior_samples", "beyond_samples", "ratio", "excess", "allowed"]
    types = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    return rows.mapInArrow(_rows_of(kernel, names, types), f"rec {kind}, sign long, edge double, edge_samples long, interior_samples long, beyond_samples long, ratio double, excess long, allowed long")


def square_like(recordings: DataFrame, edges: DataFrame, zone: float, share: float, most_levels: int) -> DataFrame:
    """rec, covered (share of samples within `zone` of an edge), levels (distinct ones, in steps of 1e-5 of the robust
    peak), square_like: streams that sit on few levels by nature, whose plateaus prove nothing. No edges: not so."""
    spans = F.array_sort(F.collect_list(F.struct(F.col("sign").cast("long").alias("idx"), F.col("edge").alias("start"), F.col("edge").alias("end"))))
    rows = recordings.join(edges.groupBy("rec").agg(spans.alias("spans")), "rec", "left").select("rec", "fs", "samples", "spans")

    def kernel(fs, x, spans):
        x = x[np.isfinite(x)]
        if not len(x) or not spans:
            return [0.0], [0]
        covered = np.any([np.abs(x - s["start"]) <= zone for s in spans], axis=0).mean()
        step = max(float(np.quantile(np.abs(x), 0.999)), 1e-12) * 1e-5
        return [covered], [len(np.unique(np.rint(x / max(step, 1e-12)).astype(np.int64)))]

    kind = recordings.schema["rec"].dataType.simpleString()
    out = rows.mapInArrow(_rows_of(kernel, ["covered", "levels"], [pa.float64(), pa.int64()]), f"rec {kind}, covered double, levels long")
    return out.withColumn("square_like", (F.col("covered") >= share) & (F.col("levels") <= most_levels))


def distortion_features(recordings: DataFrame, found: DataFrame, frame: int) -> DataFrame:
    """Per recording: clipped sample fraction, fraction of complete frames touched, events a minute; zero where none."""
    size = recordings.select("rec", F.size("samples").alias("n"), "fs")
    touched = found.select("rec", F.explode(F.sequence(F.floor(F.col("first") / frame), F.floor(F.col("last") / frame))).alias("f")).distinct()
    touched = touched.join(size.select("rec", F.floor(F.col("n") / frame).alias("__c")), "rec").where("f < __c").groupBy("rec").agg(F.count(F.lit(1)).alias("__t"))
    events = found.groupBy("rec").agg(F.count(F.lit(1)).alias("events"), F.sum("length").alias("__len"))
    rows = size.join(events, "rec", "left").join(touched, "rec", "left").fillna(0, ["events", "__len", "__t"])
    complete = F.floor(F.col("n") / frame)
    return rows.select("rec", "events", F.when(F.col("n") > 0, F.col("__len") / F.col("n")).alias("sample_fraction"), F.when(complete > 0, F.col("__t") / complete).alias("frame_fraction"), F.when(F.col("n") > 0, F.col("events") * 60.0 * F.col("fs") / F.col("n")).alias("events_per_min"))


def dropouts(recordings: DataFrame, least: int, context: int, active: float, same: float = 0.0) -> DataFrame:
    """Runs of at least `least` samples that do not change (by more than `same`) between contexts that are active: rec,
    first, last, length, before_rms, after_rms, disposition accepted, unbracketed or edge."""

    def kernel(fs, x, spans):
        if not len(x):
            return None
        joins = np.zeros(len(x), dtype=bool)
        joins[1:] = np.abs(np.diff(x)) <= same
        first, last = sample_runs(joins)
        use = last - first + 1 >= least
        first, last = first[use], last[use]
        squares = np.concatenate(([0.0], np.cumsum(x * x)))
        lo, hi = np.maximum(first - context, 0), np.minimum(last + 1 + context, len(x))

        def rms(a, b):
            return np.sqrt(np.divide(np.maximum(squares[b] - squares[a], 0), b - a, out=np.full(len(a), np.nan), where=b > a))

        return first, last, last - first + 1, rms(lo, first), rms(last + 1, hi), (first - lo < context) | (hi - last - 1 < context)

    kind = recordings.schema["rec"].dataType.simpleString()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
    rows = without_intervals(recordings).mapInArrow(_rows_of(kernel, ["first", "last", "length", "before_rms", "after_rms", "edge"], types), f"rec {kind}, first long, last long, length long, before_rms double, after_rms double, edge boolean")
    status = F.when(F.col("edge"), "edge").when((F.col("before_rms") >= active) & (F.col("after_rms") >= active), "accepted").otherwise("unbracketed")
    return rows.select("rec", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), "length", "before_rms", "after_rms", status.alias("disposition"))


def repeated_windows(recordings: DataFrame, size: int, hop: int, least_spread: float = 1e-6) -> DataFrame:
    """Windows whose samples also fill an earlier window of the recording: rec, start, earlier; constant ones do not count.

    Windows meet by a hash of their samples, so no pair of different windows is formed."""
    starts = F.sequence(F.lit(1), F.size("samples") - size + 1, F.lit(hop))
    rows = recordings.where(F.size("samples") >= size).select("rec", F.explode(F.transform(starts, lambda i: F.struct((i - 1).alias("start"), F.slice("samples", i, size).alias("w")))).alias("c")).select("rec", "c.start", "c.w")
    rows = rows.where(F.array_max("w") - F.array_min("w") > least_spread).select("rec", "start", F.md5(F.to_json("w")).alias("h"))
    w = Window.partitionBy("rec", "h").orderBy("start")
    return rows.withColumn("earlier", F.lag("start").over(w)).where("earlier IS NOT NULL").select("rec", "start", "earlier")


def lpc(x: np.ndarray, order: int = 8, damp: float = 1e-6) -> np.ndarray | None:
    """Coefficients a of x[t] ~ sum a[k] x[t - 1 - k] by the Yule-Walker equations, slightly damped; None where a fit means
    little: few samples, no energy, or coefficients whose absolute sum exceeds 8."""
    c = x - x.mean()
    if len(c) < max(8 * order, order + 32) or c @ c <= 1e-20:
        return None
    r = np.array([c[: len(c) - k] @ c[k:] for k in range(order + 1)]) / len(c)
    toeplitz = r[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))]
    a = np.linalg.solve(toeplitz + max(1e-12, damp * r[0]) * np.eye(order), r[1:])
    return a if np.isfinite(a).all() and np.abs(a).sum() <= 8.0 else None


def prediction_errors(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Errors of the prediction from the samples before, mean removed; NaN where there are too few before."""
    c, n = x - x.mean(), len(a)
    out = np.full(len(c), np.nan)
    out[n:] = c[n:] - np.lib.stride_tricks.sliding_window_view(c, n)[:-1, ::-1] @ a
    return out


def robust_z(e: np.ndarray) -> np.ndarray:
    """Absolute values less their median, in units of their scaled median absolute deviation."""
    x = np.abs(e)
    m = np.nanmedian(x)
    return (x - m) / max(1.4826 * np.nanmedian(np.abs(x - m)), 1e-15)


def predicted_next(x: np.ndarray, order: int = 8) -> tuple[float, float]:
    """The sample that linear prediction expects after x, and the robust scale of its errors in x; NaN without a fit."""
    a = lpc(x, order) if np.isfinite(x).all() else None
    if a is None:
        return float("nan"), float("nan")
    e = prediction_errors(x, a)[order:]
    return float((x - x.mean())[: -order - 1 : -1] @ a + x.mean()), float(1.4826 * np.median(np.abs(e - np.median(e))))


def continuity_scores(recordings: DataFrame, block: int = 256, order: int = 8, limit: float = 8.0, overlap: float = 0.0) -> DataFrame:
    """Samples whose error under linear prediction, robustly scaled over the block, exceeds limit both for the series and
    for its reverse: rec, i, z, where blocks overlap the most of their scores. Splices show as such; a tone's onset does
    not."""

    def kernel(fs, x, spans):
        z = np.full(len(x), -np.inf)
        hop = max(1, round(block * (1 - overlap)))
        for lo in range(0, max(1, len(x) - block + hop), hop):
            cut = x[lo : lo + block]
            if not len(cut) or not np.isfinite(cut).all():
                continue
            ahead, back = lpc(cut, order), lpc(cut[::-1], order)
            if ahead is None or back is None:
                continue
            f, b = robust_z(prediction_errors(cut, ahead)), robust_z(prediction_errors(cut[::-1], back))[::-1]
            score = np.fmin(f[1:], b[:-1])  # a break lies before a sample and after the last
            z[lo + 1 : lo + len(cut)] = np.fmax(z[lo + 1 : lo + len(cut)], np.where(np.isnan(f[1:] + b[:-1]), -np.inf, score))
        at = np.flatnonzero(z > limit)
        return at, z[at]

    kind = recordings.schema["rec"].dataType.simpleString()
    return without_intervals(recordings).mapInArrow(_rows_of(kernel, ["i", "z"], [pa.int64(), pa.float64()]), f"rec {kind}, i long, z double")
