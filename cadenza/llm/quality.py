"""Document quality by a regularised quadratic discriminant over transformed text statistics."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, materialize, tidy

#: Statistics of one text, in the order of the feature vector.
FEATURES = (
    "log_bytes", "log_word_length", "word_length_spread", "upper_share", "digit_share", "mark_share", "odd_mark_share", "mark_runs",
    "distinct_words", "top_word", "repeated_neighbours", "distinct_pairs", "log_compression", "line_repeats", "sentence_words", "late_news",
)
ORDINARY_MARKS = np.zeros(256, dtype=bool)
ORDINARY_MARKS[[ord(c) for c in ".,;:?'\"-()"]] = True
KIND = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 digit, 3 white space, 4 mark; 0 other letters and UTF-8 parts
KIND[65:91], KIND[48:58] = 1, 2
KIND[[9, 10, 11, 12, 13, 32]] = 3
KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4


def logit(part: float, whole: float) -> float:
    """Log odds of a share with half a count on either side."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str) -> list[float]:
    raw = text.encode()
    n = len(raw)
    codes = np.frombuffer(raw, dtype=np.uint8)
    kinds = KIND[codes]
    per_kind = np.bincount(kinds, minlength=5)
    marks = codes[kinds == 4]
    odd = int(np.count_nonzero(~ORDINARY_MARKS[marks]))
    runs = int(np.count_nonzero((kinds[1:] == 4) & (kinds[:-1] == 4)))
    words = raw.lower().split()
    w = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=w) if w else np.zeros(1, dtype=np.int64)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    neighbours = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = raw.split(b"\n")
    # Words of the second half that the first half does not have: repetition at any distance lowers it.
    half = set(words[: w // 2])
    news = sum(1 for x in words[w // 2 :] if x not in half)
    packed = len(zlib.compress(raw, 1)) if n else 1
    ends = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    return [
        float(np.log1p(n)), float(np.log(lengths.mean() + 1)), float(np.log(lengths.std() + 1)), logit(per_kind[1], n), logit(per_kind[2], n), logit(per_kind[4], n), logit(odd, n), logit(runs, n),
        logit(len(counts), w) - 0.0, logit(max(counts.values(), default=0), w), logit(neighbours, w), logit(pairs, max(w, pairs)), float(np.log((n + 20) / (packed + 8))),
        logit(len(lines) - len(set(lines)), len(lines)), float(np.log((w + 1) / (ends + 1))), logit(news, w),
    ]


#: Bytes at which texts change length band; each band has its own discriminant, as statistics of short texts scatter more.
BANDS = (150, 600)
#: Rows up to which a class, or a band, borrows what it lacks from all bands: scale, mean and covariance.
LEAST_ROWS = 30
#: Weight of the shrinkage target, and the pooled covariance's part of that target (the rest is a scaled identity).
SHRINK, POOLED = 0.1, 0.5
CLIP = 6.0


@dataclass(frozen=True)
class Discriminant:
    """Parameters of one length band. `inverse` and `log_det` are cached from each class's Cholesky factor."""

    mean: np.ndarray
    spread: np.ndarray
    centre: tuple[np.ndarray, ...] | None
    inverse: tuple[np.ndarray, ...] | None
    log_det: tuple[float, ...] | None
    log_prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """log p(label 1 | x) - log p(label 0 | x)."""
        if self.centre is None:
            return np.full(len(x), self.log_prior)
        z = np.clip((x - self.mean) / self.spread, -CLIP, CLIP)
        density = [-0.5 * (((z - m) @ inv.T) ** 2).sum(1) - ld for m, inv, ld in zip(self.centre, self.inverse, self.log_det, strict=True)]
        return density[1] - density[0] + self.log_prior


def band_of(x: np.ndarray) -> np.ndarray:
    return np.digitize(x[:, 0], np.log1p(BANDS))


def text_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, features array<double>, band int; null texts count as empty."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([statistics(t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(band_of(x), pa.int32())], ["doc_id", "features", "band"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, features array<double>, band int")


def topped(own: np.ndarray, rows: int, common: np.ndarray) -> np.ndarray:
    """An average over `rows` rows, with as many rows of `common` as it lacks of LEAST_ROWS."""
    lack = max(0, LEAST_ROWS - rows)
    return (rows * own + lack * common) / (rows + lack)


def fit(examples: DataFrame) -> list[Discriminant]:
    """One discriminant for each band from examples(features, band, label 0/1), all of them: class sums and cross
    products are combined by Spark, a fixed number of figures comes to the driver. Where a band has few rows of a class,
    scale, class mean (from the band's mean and the usual difference of the classes) and covariance come from all bands
    in part, so each band tells classes apart at any size."""
    d = len(FEATURES)
    x = [F.col("features")[i] for i in range(d)]
    first = examples.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).collect()
    scale = {r["band"]: (np.array([r[f"m{i}"] for i in range(d)]), np.array([r[f"s{i}"] for i in range(d)]) + 1e-9) for r in first}
    if not scale:
        return [Discriminant(np.zeros(d), np.ones(d), None, None, None, 0.0)] * (len(BANDS) + 1)
    rows = {r["band"]: r["n"] for r in first}
    within = sum(rows[b] * s[1] ** 2 for b, s in scale.items()) / sum(rows.values())
    middle = sum(rows[b] * s[0] for b, s in scale.items()) / sum(rows.values())
    scale = {b: (s[0], np.sqrt(topped(s[1] ** 2, rows[b], within))) for b, s in scale.items()}
    pick = lambda k: F.element_at(F.create_map(*[v for b, s in scale.items() for v in (F.lit(b), F.array(*map(F.lit, s[k].tolist())))]), F.col("band"))
    z = examples.select("band", "label", F.zip_with(F.zip_with("features", pick(0), lambda a, m: a - m), pick(1), lambda a, s: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), a / s))).alias("z"))
    z = z.select("band", "label", *[F.col("z")[i].alias(f"z{i}") for i in range(d)])
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = z.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"z{i}").alias(f"t{i}") for i in range(d)], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"c{i}_{j}") for i, j in upper]).collect()
    classes: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]] = {}
    for r in sums:
        c = np.zeros((d, d))
        for i, j in upper:
            c[i, j] = c[j, i] = r[f"c{i}_{j}"]
        classes[r["band"], r["label"]] = (r["n"], np.array([r[f"t{i}"] for i in range(d)]), c)
    none = (0, np.zeros(d), np.zeros((d, d)))
    n = {(b, k): classes.get((b, k), none)[0] for b in range(len(BANDS) + 1) for k in (0, 1)}
    everywhere = [sum(n[b, k] for b in range(len(BANDS) + 1)) for k in (0, 1)]
    if not min(everywhere):  # one class only: nothing to tell apart
        return [Discriminant(np.zeros(d), np.ones(d), None, None, None, float(np.log((everywhere[1] + 1) / (everywhere[0] + 1))))] * (len(BANDS) + 1)
    mean_of = lambda p: p[1] / max(1, p[0])
    cov = lambda p: p[2] / max(1, p[0]) - np.outer(mean_of(p), mean_of(p))
    totals = [tuple(classes.get((b, 0), none)[k] + classes.get((b, 1), none)[k] for k in range(3)) for b in range(len(BANDS) + 1)]
    # Of all bands: scatter of each class and of both within bands, difference of the classes within bands.
    inside = [sum(n[b, k] * cov(classes[b, k]) for b in range(len(BANDS) + 1) if n[b, k]) / everywhere[k] for k in (0, 1)]
    both = (everywhere[0] * inside[0] + everywhere[1] * inside[1]) / sum(everywhere)
    inside = [topped(s, everywhere[k], both) for k, s in enumerate(inside)]
    overall = sum(t[0] * cov(t) for t in totals) / sum(everywhere)
    weight = {b: n[b, 0] * n[b, 1] / totals[b][0] for b in range(len(BANDS) + 1) if n[b, 0] and n[b, 1]}
    if weight:
        apart = sum(w * (mean_of(classes[b, 1]) - mean_of(classes[b, 0])) for b, w in weight.items()) / sum(weight.values())
    else:
        apart = np.zeros(d)  # the classes share no band
    out = []
    for band in range(len(BANDS) + 1):
        mean, spread = scale.get(band, (middle, np.sqrt(within)))
        parts, total = [classes.get((band, k), none) for k in (0, 1)], totals[band]
        pooled = topped(cov(total), total[0], overall)
        share = n[band, 1] / total[0] if total[0] else everywhere[1] / sum(everywhere)
        centres, factors = [], []
        for k, p in enumerate(parts):
            centres.append(topped(mean_of(p), p[0], mean_of(total) + (k - share) * apart))
            s = topped(cov(p), p[0], inside[k])
            target = POOLED * pooled + (1 - POOLED) * np.trace(s) / d * np.eye(d)
            factors.append(np.linalg.cholesky((1 - SHRINK) * s + SHRINK * target + 1e-6 * np.eye(d)))
        # Up to one row of class frequencies of all bands is added where a class is thin.
        thin = max(0.0, 1 - min(n[band, 0], n[band, 1]) / LEAST_ROWS)
        m0, m1 = (n[band, k] + thin * everywhere[k] / sum(everywhere) for k in (0, 1))
        out.append(Discriminant(mean, spread, tuple(centres), tuple(np.linalg.inv(f) for f in factors), tuple(float(np.log(np.diag(f)).sum()) for f in factors), float(np.log(m1 / m0))))
    return out


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", modulus: int = 3, held: int = 1) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5).

    Learns from labels (doc_id, `label` 0/1) of documents whose crc32 of the id modulo `modulus` is not `held`. Labels
    of other values or null, and of ids without a document, are not read; an id labelled several times counts as often.
    Null texts count as empty; empty and short texts get their band's answer. What a band lacks of a class comes from
    all bands; with labels of one class only the class frequencies decide, and without any each score is 0.5. Rows with
    a null id are scored but never learned from. Rows may repeat; an empty table gives an empty result; other columns are not read.
    """
    stats = materialize(text_statistics(docs, text, doc_id), "statistics")
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label"))
    train = stats.where(bucket_of("doc_id", modulus) != held)
    model = fit(train.join(known, train["doc_id"] == known["__id"]).select("features", "band", "label"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, band = np.array(batch.column(1).to_pylist()), batch.column(2).to_numpy()
            odds = np.zeros(len(x))
            for b in np.unique(band):
                odds[band == b] = model[b].log_odds(x[band == b])
            score = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = stats.mapInArrow(tidy(run), f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return scored.select("doc_id", (bucket_of("doc_id", modulus) == held).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is predicted 0, columns unchanged; rows with a null id stay."""
    bad = score_quality(docs, labels, text, doc_id).where("predicted = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__bad_id"))
    return docs.join(bad, docs[doc_id] == bad["__bad_id"], "left_anti")
