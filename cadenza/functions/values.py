"""Scalar expressions: text normal forms, tolerant casts, tiers, decibels, closed-form intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that read as true, in tables and in detector exports. Fixed values.
TRUE_WORDS = ("true", "1", "yes", "y")
DETECTOR_TRUE_WORDS = ("true", "1", "yes", "y", "pass", "passed")
#: Two-sided 95 % quantile of the normal distribution. Fixed value.
Z95 = 1.959963984540054


def epoch_us(name: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"(unix_date(to_date({name})) * 86400L + hour({name}) * 3600L + minute({name}) * 60L) * 1000000L + cast(extract(second FROM {name}) * 1000000 AS bigint)")


def finite(x: Column) -> Column:
    """x without NaN and infinities, which become NULL."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def to_number(x: Column) -> Column:
    """A number where the text is one, else NULL, never an error."""
    return finite(x.try_cast("double"))


def normal_text(x: Column) -> Column:
    """Trimmed, white space collapsed, empty as NULL."""
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def as_bool(x: Column, words: tuple[str, ...] = TRUE_WORDS) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin(*words), F.lit(False))


def snake(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def base_name(x: Column) -> Column:
    return F.element_at(F.split(x, r"[\\/]"), -1)


def media_name_parts(x: Column) -> Column:
    """struct of subject, protocol, iteration, date, task_code, task, suffix of
    subject_protocol_iteration_YYYYMMDD_taskcode_task.ext; NULL fields where the name does not parse."""
    pattern = r"^([^_]+)_([^_]+)_([^_]+)_(\d{8})_([^_]+)_(.+)\.([A-Za-z0-9]+)$"
    part = lambda i: F.nullif(F.regexp_extract(base_name(x), pattern, i), F.lit(""))
    return F.struct(
        part(1).alias("subject"), part(2).alias("protocol"), part(3).alias("iteration"), F.try_to_date(part(4), "yyyyMMdd").alias("date"),
        part(5).alias("task_code"), part(6).alias("task"), F.lower(part(7)).alias("suffix"),
    )


def salted_order(x: Column, salt: str) -> Column:
    """The key by which deterministic samples are ordered."""
    return F.sha2(F.concat_ws("|", F.lit(salt), x.cast("string")), 256)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def decibels(rms: Column, floor: float = 1e-12) -> Column:
    return 20 * F.log10(F.greatest(rms, F.lit(floor)))


def power_ratio_db(num: Column, den: Column, tiny: float = 1e-20) -> Column:
    return F.when(den > tiny, 10 * F.log10(F.greatest(num, F.lit(tiny)) / den))


def tier(x: Column, low: float, moderate: float, high: float) -> Column:
    """insufficient, low, moderate or high by rising thresholds."""
    return F.when(x >= high, "high").when(x >= moderate, "moderate").when(x >= low, "low").otherwise("insufficient")


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson bounds of k of n; NULL where n is 0."""
    p, z2 = k / n, Z95 * Z95
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), mid - half)), F.when(ok, F.least(F.lit(1.0), mid + half))


def scalar_bool(x: Column, default: bool = False) -> Column:
    """A boolean from text or number; `default` where it says neither yes nor no."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin(*DETECTOR_TRUE_WORDS), True).when(t.isin("false", "0", "no", "n", "fail", "failed"), False).otherwise(default)


def status_available(x: Column) -> Column:
    return F.coalesce(x.startswith("ok_"), F.lit(False))


def safe_id(x: Column) -> Column:
    """The text with anything but letters, digits, dot, dash and underscore as one underscore."""
    return F.regexp_replace(x.cast("string"), r"[^A-Za-z0-9_.\-]+", "_")


def portable_path(x: Column) -> Column:
    return F.replace(x, F.lit("\\"), F.lit("/"))


def participant_of(x: Column) -> Column:
    """What comes before the last six of the parts that underscores make; the whole id where there are fewer."""
    parts = F.split(x, "_")
    return F.when(F.size(parts) >= 7, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 6, F.lit(1))), "_")).otherwise(x)


def acquisition_date(x: Column) -> Column:
    """The date in the third of an id's last six parts, if it is eight digits and a date."""
    parts = F.split(x, "_")
    token = F.when(F.size(parts) >= 7, F.element_at(parts, F.greatest(F.size(parts) - 3, F.lit(1))))
    return F.when(token.rlike(r"^\d{8}$"), F.try_to_date(token, "yyyyMMdd"))


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of the parts as one JSON array of texts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def integer_bits(codec: Column, fmt: Column, raw_bits: Column, lossy: tuple[str, ...] = ("aac", "opus", "mp3", "vorbis")) -> Column:
    """Bit depth of integer PCM where the source states it, NULL for lossy codecs and unknown forms."""
    text = F.lower(F.concat_ws(" ", F.coalesce(codec, F.lit("")), F.coalesce(fmt, F.lit(""))))
    stated = raw_bits.cast("string").try_cast("int")
    form = text.contains("pcm") | F.trim(text).rlike("^[su]")
    named = F.coalesce(*[F.when(text.contains(str(b)) & form, b) for b in (64, 32, 24, 16, 8)])
    return F.when(~F.lower(F.coalesce(codec, F.lit(""))).isin(*lossy), F.coalesce(F.when(stated.between(2, 64), stated), named))


def quantization_step(bits: Column) -> Column:
    """Step of signed PCM in [-1, 1)."""
    return F.pow(F.lit(2.0), 1 - bits)


def aligned_samples(start: Column, end: Column, rate: Column, slack: float = 1e-9) -> tuple[Column, Column]:
    """First sample at or behind the start and the sample behind the last one before the end, `slack` samples allowed."""
    return F.ceil(start * rate - slack), F.floor(end * rate + slack)


def working_set_mb(samples: Column, filters: int = 23) -> Column:
    """Megabytes that a modulation-energy model of `filters` bands needs. Rates and frames are fixed values."""
    n = F.greatest(samples, F.lit(0))
    steps = F.ceil(n / 40.0)
    frames = F.greatest(F.lit(1), F.ceil((steps - 103) / 26.0) + 1)
    return (n + filters * steps + 8 * steps + filters * 8 * frames) * 8.0 * 2.5 / (1024.0**2)


def manual_intervals(x: Column) -> Column:
    """array<struct<start, end>> of lines `start,end`; blank lines are skipped, lines that are not two numbers in order
    have NULL fields."""
    lines = F.filter(F.transform(F.split(x, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")

    def one(s):
        p = F.split(s, ",")
        a, b = F.trim(F.try_element_at(p, F.lit(1))).try_cast("double"), F.trim(F.try_element_at(p, F.lit(2))).try_cast("double")
        ok = (F.size(p) == 2) & (a < b) & (a >= 0)
        return F.struct(F.when(ok, a).alias("start"), F.when(ok, b).alias("end"))

    return F.transform(lines, one)


def tolerant_list(x: Column, schema: str) -> Column:
    """A JSON value, or one written with single quotes; NULL where neither reads."""
    return F.from_json(x, schema, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})


def alternating_levels(power_mean: Column, mean: Column, floor_db: float = -120.0) -> tuple[Column, Column]:
    """Level of a frame without its mean, in decibels with a floor, and whether it lies at the floor."""
    rms = F.sqrt(F.greatest(power_mean - mean * mean, F.lit(0.0)))
    level = F.greatest(20 * F.log10(F.greatest(rms, F.lit(1e-300))), F.lit(floor_db))
    return level, level <= floor_db


def most_extreme(columns: list[Column]) -> Column:
    """Largest absolute value of several, NULLs aside."""
    return F.greatest(*[F.abs(c) for c in columns]) if len(columns) > 1 else F.abs(columns[0])
