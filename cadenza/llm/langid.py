"""Language identification by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of

#: Slots of the hashed n-gram table, n-gram sizes in bytes, labelled documents of each language that fitting takes at most (in expectation).
SLOTS, SIZES, PER_LANGUAGE = 1 << 15, (1, 2, 3, 4), 2000
#: Losses of the best two codewords closer than this: ambiguous.
CLOSE = 0.15

#: Bytes that belong to words: ASCII letters and all parts of other characters. The rest becomes a space.
WORDY = np.full(256, 32, dtype=np.uint8)
WORDY[97:123] = np.arange(97, 123)
WORDY[128:] = np.arange(128, 256)


def codewords(k: int, seed: int = 20260713) -> np.ndarray:
    """k rows of +1/-1, one column for each binary problem: the exhaustive code up to seven classes, else the random
    dense code of ten columns per bit whose rows lie furthest apart among 100 draws."""
    if k < 2:
        return np.zeros((k, 0))
    if k <= 7:
        rest = [c for c in itertools.product((1, -1), repeat=k - 1) if -1 in c]
        return np.array([(1, *c) for c in rest], dtype=float).T
    rng, width = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(k)))
    best, apart = None, -1
    for _ in range(100):
        m = rng.choice((-1.0, 1.0), (k, width))
        near = (m @ m.T - 2 * width * np.eye(k)).max()
        if width - near > apart:
            best, apart = m, width - near
    return best


def slots_of(joined: np.ndarray) -> list[np.ndarray]:
    """For each n-gram size the table slots of the n-grams that begin at each byte."""
    wide = joined.astype(np.uint64)
    out, key = [], np.zeros(len(wide), dtype=np.uint64)
    for n in range(1, max(SIZES) + 1):
        if n > len(wide):
            break
        key = key[: len(wide) - n + 1] << np.uint64(8) | wide[n - 1 :]
        if n in SIZES:
            out.append(((key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int32))
    return out


def prepared(text: str) -> bytes:
    return b" " + text.lower().encode() + b" "


def pieces(texts: list[str], most: int = 1_000_000):
    """Runs of whole texts, of `most` bytes or one text: (first index, joined bytes, starts)."""
    lo, size, parts = 0, 0, []
    for i, t in enumerate(texts):
        raw = prepared(t)
        if size and size + len(raw) > most:
            yield lo, parts
            lo, size, parts = i, 0, []
        parts.append(raw)
        size += len(raw)
    if parts:
        yield lo, parts


@dataclass(frozen=True)
class Codes:
    languages: list[str]
    words: np.ndarray  # language x bit
    table: np.ndarray  # slot x bit, log odds
    scale: np.ndarray  # bit
    trust: np.ndarray  # language x bit, rows sum to 1

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log odds of each bit over a text's n-grams, over the bit's scale."""
        out = np.zeros((len(texts), self.table.shape[1]))
        for lo, parts in pieces(texts):
            joined = WORDY[np.frombuffer(b"".join(parts), dtype=np.uint8)]
            starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
            total = np.zeros((len(joined), self.table.shape[1]), dtype=np.float32)
            for s in slots_of(joined):
                total[: len(s)] += self.table[s]
            sums = np.add.reduceat(total, starts, axis=0)
            out[lo : lo + len(parts)] = sums / np.array([len(p) for p in parts])[:, None]
        return out / self.scale

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss-weighted decoding: index of the nearest codeword, score, ambiguity."""
        k = len(self.languages)
        if k == 1:
            return np.zeros(len(margins), dtype=int), np.ones(len(margins)), np.zeros(len(margins), dtype=bool)
        loss = np.logaddexp(0, -2 * self.words[None] * np.clip(margins, -3, 3)[:, None]) * self.trust[None]
        loss = loss.sum(2)
        first = loss.argmin(1)
        two = np.sort(loss, axis=1)[:, :2]
        chance = np.exp(-4 * (loss - two[:, :1]))
        return first, 1 / chance.sum(1), two[:, 1] - two[:, 0] < CLOSE


def count_slots(texts: list[str]) -> np.ndarray:
    total = np.zeros(SLOTS, dtype=np.int64)
    for _, parts in pieces(texts):
        for s in slots_of(WORDY[np.frombuffer(b"".join(parts), dtype=np.uint8)]):
            total += np.bincount(s, minlength=SLOTS)
    return total


def fit(train: DataFrame, per_language: int = PER_LANGUAGE) -> Codes:
    """Codes from train(doc_id, text, lang), all rows labelled. Of each language about per_language documents, chosen
    by a hash of the id, are read whole; the table and the driver's share do not grow with the input."""
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1.0, per_language / sizes[lang])).otherwise(share)
    drawn = train.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text").repartition(8)

    def counts(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + count_slots([t for t, x in zip(texts, langs, strict=True) if x == lang])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], ["lang", "counts"])

    freq = np.full((len(languages), SLOTS), 0.5)
    for r in drawn.mapInArrow(counts, "lang string, counts binary").collect():
        freq[languages.index(r["lang"])] += np.frombuffer(r["counts"], dtype="<i8")
    freq /= freq.sum(1, keepdims=True)
    words = codewords(len(languages))
    table = np.zeros((SLOTS, words.shape[1]), dtype=np.float32)
    for b in range(words.shape[1]):
        plus, minus = freq[words[:, b] > 0].mean(0), freq[words[:, b] < 0].mean(0)
        table[:, b] = np.log(plus) - np.log(minus)
    draft = Codes(languages, words, table, np.ones(words.shape[1]), np.ones_like(words) / max(1, words.shape[1]))
    if words.shape[1] == 0:
        return draft

    def measure(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, m = np.array(batch.column(0).to_pylist()), draft.margins(batch.column(1).to_pylist())
            for lang in set(langs.tolist()):
                rows = m[langs == lang]
                sums = np.stack([np.full(m.shape[1], len(rows)), np.abs(rows).sum(0), (rows * words[languages.index(lang)] > 0).sum(0)])
                total[lang] = total.get(lang, 0) + sums
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype("<f8").tobytes() for v in total.values()], pa.binary())], ["lang", "sums"])

    sums = np.zeros((len(languages), 3, words.shape[1]))
    for r in drawn.mapInArrow(measure, "lang string, sums binary").collect():
        sums[languages.index(r["lang"])] += np.frombuffer(r["sums"], dtype="<f8").reshape(3, -1)
    scale = sums[:, 1].sum(0) / np.maximum(sums[:, 0].sum(0), 1)
    trust = (sums[:, 2] + 1) / (sums[:, 0] + 2)  # how often the bit is right for documents of the language
    return Codes(languages, words, table, np.maximum(scale, 1e-9), trust / trust.sum(1, keepdims=True))


def identify_languages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", modulus: int = 3, held: int = 1, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1), ambiguous.

    Learns from rows with text and a `lang` whose crc32 of the id modulo `modulus` is not `held`, about per_language
    documents of each language. Whole texts are read. A null text or one without a letter is `und` with score 0; so is
    every text where there is nothing to learn from. With one language its answer is certain. Rows may repeat and ids
    may be null (never held out); an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    model = fit(rows.where((bucket_of("doc_id", modulus) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()), per_language)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            known = [bool(model.languages) and any(map(str.isalpha, t)) for t in texts]
            best, score, close = model.decode(model.margins([t for t, k in zip(texts, known, strict=True) if k])) if any(known) else (np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
            at = np.cumsum(known) - 1
            pred = [model.languages[best[i]] if k else "und" for i, k in zip(at, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array([float(score[i]) if k else 0.0 for i, k in zip(at, known, strict=True)], pa.float64()), pa.array([bool(close[i]) if k else True for i, k in zip(at, known, strict=True)], pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    out = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", (bucket_of("doc_id", modulus) == held).alias("held_out"), "lang_pred", "score", "ambiguous")
