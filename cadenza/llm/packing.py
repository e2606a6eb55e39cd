"""Packing documents into training sequences along a Hilbert curve of their hashed content vectors."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkIds, forget, loaded, slices
from .common import batches_of, materialize, tidy

#: Buckets of the hashed document vector, dimensions it is projected to, bits of the curve in each dimension.
BUCKETS, DIMS, BITS = 256, 4, 12
#: Tokens of one range of the curve, which one task packs; the most ranges; tokens that weigh as one when ranges are cut.
RANGE_TOKENS, MOST_RANGES, WEIGHED = 4_000_000, 20_000, 512
#: Bytes of text that a worker tokenises at a time, one document at least.
BATCH_BYTES = 2_000_000
#: Characters whose new words a worker looks up together, the texts of one batch at least.
LEARNED = 8_000_000
#: Bits that part documents of one curve position.
TIE_BITS = 63 - DIMS * BITS


def projection(seed: int = 20260713) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of each row of integer coordinates in [0, 2**bits)."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level
        low = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | ((x[i] >> b) & 1)
    return key


def curve_position(counts: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Hilbert key of rows of bucket counts: square roots, unit length, projection, squashing to cells."""
    v = np.sqrt(counts, dtype=np.float32)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    cells = (0.5 + 0.5 * np.tanh(v @ into)) * (1 << BITS)
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64))


def tokenized(docs: DataFrame, path: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, curve long, tokens long, wide, ids binary (little-endian; 32-bit if wide, else 16-bit), one row per row."""

    def run(batches):
        cache = loaded(path, "ids", ChunkIds)
        n = len(cache.bpe.token)
        wide = n > 1 << 16
        kind = "<u4" if wide else "<u2"
        bucket = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64)
        into = projection()
        waiting, cuts, held = [], [], 0

        def numbered():
            nonlocal waiting, held
            names, waiting, held = waiting, [], 0
            for doc, (ids, offsets) in zip(names, cache.encode_all(cuts) if names else [], strict=True):
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                size = np.diff(offsets)
                counts = np.bincount(np.repeat(np.arange(len(size)) * BUCKETS, size) + bucket[ids], minlength=len(size) * BUCKETS).reshape(-1, BUCKETS)
                raw = pa.py_buffer(ids.astype(kind).tobytes())
                at = pa.py_buffer((offsets * (4 if wide else 2)).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(curve_position(counts, into), pa.int64()), pa.array(size, pa.int64()), pa.array([wide] * len(size)), pa.Array.from_buffers(pa.binary(), len(size), [None, at, raw])],
                    ["doc_id", "curve", "tokens", "wide", "ids"],
                )

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts):
                waiting.append(batch.column(0).slice(lo, hi - lo))
                cuts.append(cache.cut(texts[lo:hi]))
                held += sum(map(len, texts[lo:hi]))
                if held >= LEARNED:
                    yield from numbered()
        yield from numbered()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, forget), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, curve long, tokens long, wide boolean, ids binary")


def along_the_curve(done: DataFrame) -> DataFrame:
    """Rows of `tokenized` dealt to ranges of the curve that hold about as many tokens each, sorted along it.

    Bounds are weighted quantiles of (curve, hash of the id), so long documents and thousands of copies at one position
    do not swell a range. The quantile summary has a bounded size, and so have the bounds, MOST_RANGES at the most.
    """
    tie = F.pmod(F.xxhash64("doc_id"), F.lit(1 << TIE_BITS))
    placed = done.withColumn("place", F.shiftleft("curve", TIE_BITS) + tie)
    total = done.agg(F.sum("tokens")).first()[0] or 0
    n = min(MOST_RANGES, -(-total // RANGE_TOKENS))
    if n > 1:
        weighed = placed.select("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens").cast("long"), F.lit(WEIGHED).cast("long"))))
        cuts = weighed.agg(F.percentile_approx("place", [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0]
        # Bounds at or below a place, by a binary search over them and as many past the end as make it a power of two.
        steps = n.bit_length()
        bounds = F.lit(np.array(cuts + [(1 << 63) - 1] * ((1 << steps) - len(cuts)), dtype=np.int64))
        step = lambda at, size: F.when(F.element_at(bounds, at + size) <= F.col("place"), at + size).otherwise(at)
        part = F.aggregate(F.lit(np.array([1 << k for k in range(steps - 1, -1, -1)], dtype=np.int32)), F.lit(0), step)
        placed = placed.withColumn("part", part).repartitionById(n, F.col("part"))
    else:
        placed = placed.repartition(1)
    return placed.sortWithinPartitions("curve", "doc_id", "ids").select("doc_id", "wide", "ids")


def pack_documents(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2, text: str = "text", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless with_ids is
    False, ids array<int>.

    Documents are tokenised, ended by end_id, sorted by ranges along the curve and laid end to end in each range; each
    sequence takes `length` ids and a document goes on in the next one. What a range leaves over fills sequences whose
    lengths are falling powers of two, so nothing is padded. Ranges hold about RANGE_TOKENS tokens each; documents of one
    curve position are dealt by a hash of the id, so copies of one document spread over ranges. The tokens are written to the shared folder once: range bounds and
    retries read them from there.

    Null and empty texts are one id, the end. Rows may repeat and ids may be null: each row is packed on its own. An
    empty table gives an empty result. Other columns are not read.
    """
    with batches_of(docs.sparkSession, BATCH_BYTES):
        done = materialize(tokenized(docs, path, end_id, text, doc_id), "tokens")
    ranged = along_the_curve(done)

    def run(batches):
        base, number = TaskContext.get().partitionId() << 40, 0
        waiting: list[tuple[object, int, np.ndarray, int]] = []  # pieces of the open sequence: id, start, ids, document's ids
        held = 0

        def close(pieces, size):
            nonlocal number
            at = 0
            for doc, start, ids, total in pieces:
                yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + number, at, ids
                at += len(ids)
            assert at == size
            number += 1

        def tail():
            nonlocal waiting, held
            while held:
                size, part, taken = 1 << (held.bit_length() - 1), [], 0
                while taken < size:
                    doc, start, ids, total = waiting.pop(0)
                    use = min(len(ids), size - taken)
                    part.append((doc, start, ids[:use], total))
                    if use < len(ids):
                        waiting.insert(0, (doc, start + use, ids[use:], total))
                    taken += use
                held -= size
                yield from close(part, size)

        def batch_of(rows):
            cols = list(zip(*rows, strict=True))
            plain = [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:7]]]
            if not with_ids:
                return pa.RecordBatch.from_arrays(plain, names[:7])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in cols[7]])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(cols[7]).astype(np.int32), pa.int32()))
            return pa.RecordBatch.from_arrays([*plain, lists], names)

        out, id_type, names = [], None, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            id_type = batch.column(0).type
            for doc, wide, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = np.frombuffer(raw, dtype="<u4" if wide else "<u2")
                start = 0
                while start < len(ids):
                    use = min(len(ids) - start, length - held)
                    waiting.append((doc, start, ids[start : start + use], len(ids)))
                    start, held = start + use, held + use
                    if held == length:
                        out += close(waiting, length)
                        waiting, held = [], 0
                if len(out) >= 4000:
                    yield batch_of(out)
                    out = []
        out += tail()
        if out:
            yield batch_of(out)

    kind = done.schema["doc_id"].dataType.simpleString()
    return ranged.mapInArrow(tidy(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
