"""Repeated byte strings across a corpus by prefix-free parsing: triggers, dictionary, parse, corpus order.

Parse. A rolling hash of eight bytes marks about one position in PERIOD as a trigger. The trigger of a start s is the
first one in [s, s + window); where there is none it is the position of the smallest hash there, so no phrase is longer
than the window. A phrase runs from behind one trigger up to and with the next and holds none inside: no phrase end is
the beginning of another one. Equal strings have their triggers at equal places.

Dictionary and parse. Each phrase goes on with the parse behind it, as far as any of its strings of the asked length
may reach. Phrases that agree as far as that, by the 128-bit hash of these bytes, are one entry; entries that come up
twice are repeated at all their starts. Only the others, next to one copy of each entry whose parse begins alike, go on.

Corpus order. In each such group the suffix array of the dictionary's phrases is built by prefix doubling, and the
parses behind them are sorted. A suffix of the corpus is a suffix of a phrase and the parse behind it, so the pair of
both ranks puts all starts of the group in corpus order; two neighbours share as many bytes as their phrase suffix has
and their parses share, the least of the sorted parses' common prefixes between them.

Groups of more than TILE entries are parted by more bytes on both sides of the trigger: a phrase is cut into shorter
runs of starts, which agree on more bytes, until each group is small. Rows follow entries, never starts or pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, temporary, tidy

#: The most starts of a phrase, bytes of the rolling hash, mean distance of triggers.
WINDOW, GRAM, PERIOD = 256, 8, 160
#: Entries that a task puts in order together; larger groups are parted by more bytes.
TILE = 512
#: Bytes of entries put in order at a time.
RANKED = 2_000_000
#: Bits of the filters that spare rows without a match the shuffle: fixed, whatever the input.
FILTER_BITS = 1 << 26


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(codes: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, the first byte highest; zeros past the end."""
    x = np.concatenate((codes, np.zeros(GRAM, dtype=np.uint8))).astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] << np.uint64(8 * step) | x[step:]
    return x[: len(codes)]


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x over [i, i + width) for each i that has all of them."""
    n = len(x)
    pad = -n % width
    blocks = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def window_of(length: int) -> int:
    """The most starts of a phrase: three quarters of the length at most, so that the parse behind a trigger stays long
    enough to tell phrases apart."""
    return min(WINDOW, max(1, (length - GRAM) * 3 // 4))


def parse(raws: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Phrases of the documents: doc (index), first (byte), n (starts), lead (bytes from first to the trigger), key1,
    key2 (128-bit hash of the phrase, its trigger's place and the parse behind it), context (hash of that parse as far
    as all its starts reach)."""
    window = window_of(length)
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    none = {k: np.zeros(0, dtype=np.int64) for k in ("doc", "first", "n", "lead", "key1", "key2", "context")}
    joined = b"".join(raws)
    codes = np.frombuffer(joined, dtype=np.uint8)
    counts = np.maximum(sizes - length + 1, 0)
    if not counts.sum():
        return none
    begin = np.cumsum(sizes) - sizes
    hashed = mixed(grams(codes))
    at = np.arange(len(codes), dtype=np.uint64)
    # Triggers come before all others, by place; the others follow by hash.
    place = np.where(hashed >> np.uint64(40) < np.uint64((1 << 24) // PERIOD), at, (hashed | np.uint64(1 << 63)) & np.uint64(0xFFFFFFFF00000000) | at)
    trigger = (window_minimum(place, window) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    del hashed, at, place
    doc = np.repeat(np.arange(len(raws)), counts)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[doc]
    at = trigger[start]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
    n = np.diff(np.append(new, len(start)))
    first, at, doc = start[new], at[new], doc[new]
    lead, hash128, hash64 = at - first, xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
    # The trigger's place is the seed of the key.
    keys = np.frombuffer(b"".join([hash128(joined[a:b], s) for a, b, s in zip(first.tolist(), (first + n + length - 1).tolist(), lead.tolist(), strict=True)]), dtype="<i8").reshape(-1, 2)
    context = np.array([hash64(joined[a:b]) for a, b in zip(at.tolist(), (at + length - window + 1).tolist(), strict=True)], dtype=np.uint64).view(np.int64)
    return {"doc": doc, "first": first - begin[doc], "n": n, "lead": lead, "key1": keys[:, 0], "key2": keys[:, 1], "context": context}


def runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Sorted distinct numbers as half-open runs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.concatenate((cut, [len(starts) - 1]))] + 1).tolist(), strict=True))


def dense_ranks(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 on of rows of keys, the first key foremost; equal rows share one."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        found = k[order]
        new[1:] |= found[1:] != found[:-1]
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.cumsum(new) + 1
    return ranks


def phrase_suffix_ranks(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a dictionary: the rank of each suffix of each phrase, the empty one included, in byte order, as
    one array, and the place at which each phrase begins in it. Equal suffixes share a rank, by prefix doubling."""
    sizes = np.array([len(p) + 1 for p in phrases], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    codes = np.frombuffer(b"".join(p + b"\0" for p in phrases), dtype=np.uint8)
    left = np.repeat(begin + sizes - 1, sizes) - np.arange(len(codes))  # bytes up to the phrase's end
    # Eight bytes at first; those past the end of a phrase count as zero, and as less than a zero byte by `left`.
    short = np.minimum(left, GRAM)
    mask = ~np.uint64(0) << (np.uint64(8) * (GRAM - np.maximum(short, 1)).astype(np.uint64))
    ranks = dense_ranks(np.where(short > 0, grams(codes) & mask, np.uint64(0)), short)
    depth, most = GRAM, int(sizes.max(initial=1)) - 1
    while depth < most:
        ahead = np.zeros(len(ranks), dtype=np.int64)
        some = np.flatnonzero(left > depth)
        ahead[some] = ranks[some + depth]
        ranks = dense_ranks(ranks * (len(ranks) + 1) + ahead)
        depth *= 2
    return ranks, begin


def parse_order(parses: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of byte strings in their order, and the bytes that each place shares with the one before (first: 0)."""
    order = sorted(range(len(parses)), key=parses.__getitem__)
    rank = np.empty(len(parses), dtype=np.int64)
    rank[order] = np.arange(len(parses))
    width = max(map(len, parses), default=0)
    table = np.frombuffer(b"".join(parses[i].ljust(width, b"\0") for i in order), dtype=np.uint8).reshape(len(parses), width)
    sizes = np.array([len(parses[i]) for i in order])
    shared = np.zeros(len(parses), dtype=np.int64)
    if len(parses) > 1 and width:
        for lo in range(0, len(parses) - 1, 4096):
            off = table[lo + 1 : lo + 4097] != table[lo : min(lo + 4096, len(parses) - 1)]
            shared[lo + 1 : lo + 1 + len(off)] = np.where(off.any(1), off.argmax(1), width)
        shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    return rank, shared


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values over (lo, hi], lo < hi, from a table of minima of power-of-two stretches."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half, last = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(last[:-half], last[half:]))
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), dtype=np.int64)
    for k in np.unique(level).tolist():
        on = np.flatnonzero(level == k)
        out[on] = np.minimum(table[k][lo[on] + 1], table[k][hi[on] - (1 << k) + 1])
    return out


def corpus_order(entries: list[bytes], lead: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of entries (a phrase, whose trigger begins after `lead` bytes, and the parse from that trigger on) in
    corpus order by the ranks of phrase suffix and parse: entry, offset, the bytes each shares with the one before (-1
    where their phrase suffixes differ, so that they share no whole one), and its number in order of entries."""
    heads = [e[: a + GRAM] for e, a in zip(entries, lead.tolist(), strict=True)]
    dictionary = {h: i for i, h in enumerate(dict.fromkeys(heads))}
    suffix, begin = phrase_suffix_ranks(list(dictionary))
    parsed, shared = parse_order([e[a:] for e, a in zip(entries, lead.tolist(), strict=True)])
    owner = np.repeat(np.arange(len(entries)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    head = suffix[begin[np.array([dictionary[h] for h in heads])][owner] + offset]
    order = np.argsort(head * len(entries) + parsed[owner], kind="stable")
    owner, offset, head = owner[order], offset[order], head[order]
    place = parsed[owner]
    common = np.full(len(order), -1, dtype=np.int64)
    same = np.flatnonzero(head[1:] == head[:-1]) + 1
    if len(same):
        common[same] = lead[owner[same]] - offset[same] + least_between(shared, place[same - 1], place[same])
    return owner, offset, common, order


def repeated_in(entries: list[bytes], lead: np.ndarray, n: np.ndarray, length: int) -> list[np.ndarray]:
    """For each entry the offsets of its starts whose `length` bytes another start has too."""
    owner, offset, common, _ = corpus_order(entries, lead, n)
    twice = common >= length
    twice[:-1] |= twice[1:]
    at = np.flatnonzero(twice)
    owner, offset = owner[at], offset[at]
    by = np.lexsort((offset, owner))
    return np.split(offset[by], np.searchsorted(owner[by], np.arange(1, len(entries))))


def _parsed(docs: DataFrame, length: int) -> DataFrame:
    """Phrases of docs(doc_id, th, text): doc_id, th, first, n, lead, key1, key2, context; many tells that the phrase comes
    several times in its document, whose rows for it are one. Rows without a key are runs of starts that their own
    document repeats."""

    def run(batches):
        for batch in batches:
            ids, hashes, raws = batch.column(0), batch.column(1), [(t or "").encode() for t in batch.column(2).to_pylist()]
            for lo, hi in _portions(raws):
                p = parse(raws[lo:hi], length)
                if not len(p["doc"]):
                    continue
                _, index, back, count = np.unique(p["key1"].view(np.uint64) ^ mixed(p["doc"].astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
                many = count > 1
                own = np.flatnonzero(many[back])  # phrases that repeat within their document, in order
                local = []
                if len(own):
                    d, a, b = p["doc"][own], p["first"][own], p["first"][own] + p["n"][own]
                    new = np.concatenate(([True], (d[1:] != d[:-1]) | (a[1:] != b[:-1])))
                    at = np.flatnonzero(new)
                    local = [d[at], a[at], b[np.append(at[1:], len(d)) - 1] - a[at]]
                doc = np.concatenate((p["doc"][index], local[0])) if local else p["doc"][index]
                first = np.concatenate((p["first"][index], local[1])) if local else p["first"][index]
                n = np.concatenate((p["n"][index], local[2])) if local else p["n"][index]
                more = len(doc) - len(index)
                none = np.arange(len(doc)) >= len(index)
                key = lambda k: pa.array(np.concatenate((p[k][index], np.zeros(more, dtype=np.int64))), mask=none)  # noqa: B023, E731
                lead = pa.array(np.concatenate((p["lead"][index], np.zeros(more, dtype=np.int64))).astype(np.int32))
                pick = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pick), hashes.take(pick), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), lead, key("key1"), key("key2"), key("context"), pa.array(np.concatenate((many, np.ones(more, dtype=bool))))],
                    ["doc_id", "th", "first", "n", "lead", "key1", "key2", "context", "many"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"doc_id {kind}, th long, first int, n int, lead int, key1 long, key2 long, context long, many boolean")


def _portions(raws: list[bytes], most: int = 500_000):
    lo, size = 0, 0
    for i, r in enumerate(raws):
        if size and size + len(r) > most:
            yield lo, i
            lo, size = i, 0
        size += len(r)
    if lo < len(raws):
        yield lo, len(raws)


def _cut(length: int):
    """Rows (doc_id, th, text, wanted array<struct<context, k, first, n, lead, full>>) to one row per entry with its bytes."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                rows = [(d, h, w["context"], w["k"], w["first"], w["n"], w["lead"], w["full"], t[w["first"] : w["first"] + w["n"] + length - 1]) for d, h, t, ws in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), [(t or "").encode() for t in part.column(2).to_pylist()], part.column(3).to_pylist(), strict=True) for w in ws]
                if rows:
                    yield _entry_batch(rows, part.schema.field(0).type)

    return run


ENTRY = ("doc_id", "th", "context", "k", "first", "n", "lead", "full", "entry")


def _entry_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(ENTRY))


def _parted(length: int, width: int):
    """Rows of ENTRY to rows of shorter runs of starts: those whose distance to the trigger lies in [a, a + width), for
    all multiples a of width. All strings of a run hold the a bytes before the trigger and the length - a - width + 1
    from it on, whose hash is its context; k is not known yet and zero."""

    def run(batches):
        hash64 = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows: list[tuple] = []
            for d, h, _, _, first, n, lead, full, entry in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for a in range((lead - n + 1) // width * width, lead + 1, width):
                    far, near = min(lead, a + width - 1), max(lead - n + 1, a)
                    skip = lead - far
                    part = entry[skip : lead - near + length]
                    core = hash64(entry[lead - a : lead + length - a - width + 1], a)
                    rows.append((d, h, core - (1 << 64) if core >> 63 else core, 0, first + skip, far - near + 1, far, full, part))
                if len(rows) >= 2000:
                    yield _entry_batch(rows, batch.schema.field(0).type)
                    rows = []
            if rows:
                yield _entry_batch(rows, batch.schema.field(0).type)

    return run


def _ordered(length: int):
    """Groups of sorted rows of ENTRY: runs of starts that repeat."""

    def run(batches):
        held: list[tuple] = []
        size, id_type = 0, None

        def settle(rows):
            hits = repeated_in([r[8] for r in rows], np.array([r[6] for r in rows]), np.array([r[5] for r in rows]), length)
            return [(r[0], r[1], r[4] + a, r[4] + b) for r, hit in zip(rows, hits, strict=True) if not r[7] for a, b in runs_of(hit)]

        def batch_of(out):
            types = [id_type, pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "th", "lo", "hi"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 1000):
                for row in zip(*[c.to_pylist() for c in batch.slice(i, 1000).columns], strict=True):
                    if held and size > RANKED and held[-1][2] != row[2]:
                        out, held, size = settle(held), [], 0
                        if out:
                            yield batch_of(out)
                    held.append(row)
                    size += len(row[8])
        if held and (out := settle(held)):
            yield batch_of(out)

    return run


def _split_by_filter(rows: DataFrame, marked: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """rows whose columns may be in marked, and the rest. The filter is a bitmap of FILTER_BITS bits, 8 MB at the most
    whatever the input, and is broadcast; where it fills up, more rows take the join, results stay the same."""
    place = lambda: F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    bits = marked.select(place().alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    bits = materialize(bits, "filter")
    placed = rows.withColumn("__p", place()).withColumn("__bucket", F.bitmap_bucket_number("__p")).join(F.broadcast(bits), F.col("__bucket") == F.col("bucket"), "left")
    byte = "cast(conv(hex(substring(bitmap, cast(bitmap_bit_position(__p) div 8 as int) + 1, 1)), 16, 10) as int)"
    may = F.coalesce(F.expr(f"shiftright({byte}, cast(bitmap_bit_position(__p) % 8 as int)) & 1") == 1, F.lit(False))
    split = placed.withColumn("__may", may).select(*rows.columns, "__may")
    return split.where("__may").drop("__may"), split.where("NOT __may").drop("__may")


def _small_groups(entries: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """Entries in groups of TILE at most, and runs of starts found to repeat on the way. Larger groups are parted by
    ever shorter runs of starts; runs of one start and equal bytes are one entry, so the last round leaves none."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields)
    small, found = entries.where(F.col("k") <= TILE), []
    wide, width = entries.where(F.col("k") > TILE), window_of(length)
    while width > 1 and not wide.isEmpty():
        width = max(1, width // 4)
        parts = wide.mapInArrow(tidy(_parted(length, width)), schema).withColumn("key", F.unhex(F.md5("entry")))
        parts = materialize(parts, "parts")
        distinct = parts.groupBy("context", "key", "lead").agg(((F.count(F.lit(1)) > 1) | F.max("full")).alias("full"), F.min(F.struct("doc_id", "th", "first", "n", "entry")).alias("rep"))
        distinct = materialize(distinct, "distinct")
        twice = distinct.where("full").select("key", "lead").distinct()
        found.append(parts.where("NOT full").join(twice, ["key", "lead"]).select("doc_id", "th", F.col("first").alias("lo"), (F.col("first") + F.col("n")).alias("hi")))
        groups = distinct.groupBy("context").agg(F.count(F.lit(1)).alias("k"), F.max(~F.col("full")).alias("some_open")).where("k > 1 AND some_open").select("context", "k")
        entries = materialize(distinct.join(groups, "context").select("rep.doc_id", "rep.th", "context", "k", "rep.first", "rep.n", "lead", "full", "rep.entry"), "entries")
        small, wide = small.union(entries.where(F.col("k") <= TILE)), entries.where(F.col("k") > TILE)
    return small, found


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, th, lo, hi: runs of starts [lo, hi) whose `length` bytes also start elsewhere, of docs(doc_id, th, text)."""
    phrases = materialize(_parsed(docs, length), "phrases")
    keyed = phrases.where("key1 IS NOT NULL")
    # A parse beginning that comes up once has nothing to repeat: only the others are shuffled with their keys.
    seen = materialize(keyed.groupBy("context").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("context"), "seen")
    keyed, _ = _split_by_filter(keyed, seen, "context")
    dictionary = keyed.groupBy("context", "key1", "key2").agg(((F.count(F.lit(1)) > 1) | F.max("many")).alias("full"), F.min(F.struct("doc_id", "th", "first", "n", "lead")).alias("rep"))
    dictionary = materialize(dictionary, "dictionary")
    contexts = dictionary.groupBy("context").agg(F.count(F.lit(1)).alias("k"), F.max(~F.col("full")).alias("some_open")).where("k > 1 AND some_open").select("context", "k")
    wanted = dictionary.join(contexts, "context").select("context", "k", "rep.*", "full")
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("context", "k", "first", "n", "lead", "full")).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    text, _ = _split_by_filter(docs, wanted, "doc_id", "th")
    asked = text.alias("t").join(wanted.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.th") == F.col("w.th"))).select("t.doc_id", "t.th", "t.text", "w.wanted")
    kind = docs.schema["doc_id"].dataType.simpleString()
    entries = materialize(asked.mapInArrow(tidy(_cut(length)), f"doc_id {kind}, th long, context long, k long, first int, n int, lead int, full boolean, entry binary"), "entries")
    small, found = _small_groups(entries, length)
    small = small.repartition("context").sortWithinPartitions("context")
    ordered = small.mapInArrow(tidy(_ordered(length)), f"doc_id {kind}, th long, lo int, hi int")
    twice = materialize(dictionary.where("full").select("key1", "key2").distinct(), "twice")
    members, _ = _split_by_filter(keyed.where("NOT many").select("doc_id", "th", "first", "n", "key1", "key2"), twice, "key1", "key2")
    full = members.join(twice, ["key1", "key2"]).select("doc_id", "th", F.col("first").alias("lo"), (F.col("first") + F.col("n")).alias("hi"))
    local = phrases.where("key1 IS NULL").select("doc_id", "th", F.col("first").alias("lo"), (F.col("first") + F.col("n")).alias("hi"))
    for more in (local, ordered, *found):
        full = full.union(more)
    return full


def whole_characters(raw: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Spans shrunk so that they neither begin nor end within a UTF-8 character."""
    out = []
    for lo, hi in spans:
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append([lo, hi])
    return out


def _remover(length: int, whole: bool):
    """Rows (doc_id, text, runs of starts, carried columns) to doc_id, n_bytes, n_removed, spans, kept, carried columns."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for t, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = t.encode()
                spans: list[list[int]] = []
                for lo, hi in sorted((r["lo"], r["hi"]) for r in runs or ()):
                    end = hi - 1 + length
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([lo, end])
                if whole:
                    spans = whole_characters(raw, spans)
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), [{"lo": a, "hi": b} for a, b in spans], kept))
            if out:
                types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], batch.column(3)], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "carried"])

    return run


def _removed(docs: DataFrame, length: int, text: str, doc_id: str, carried: list[str], whole: bool) -> DataFrame:
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keep = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)], F.lit(0).alias("none"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"), keep.alias("carried"))
    with temporary(docs.sparkSession):
        marks = repeated_starts(rows.select("doc_id", "th", "text"), length).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
        marks = materialize(marks, "marks", outlive=True)
    some, none = _split_by_filter(rows, marks, "doc_id", "th")
    joined = some.alias("t").join(marks.alias("m"), F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("t.th") == F.col("m.th")), "left").select("t.doc_id", "t.text", "m.runs", "t.carried")
    kinds = rows.schema["doc_id"].dataType.simpleString(), rows.schema["carried"].dataType.simpleString()
    changed = joined.mapInArrow(tidy(_remover(length, whole)), f"doc_id {kinds[0]}, n_bytes long, n_removed long, spans array<struct<lo: long, hi: long>>, kept binary, carried {kinds[1]}")
    same = none.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.expr("CAST(array() AS array<struct<lo: bigint, hi: bigint>>)").alias("spans"), F.col("text").cast("binary").alias("kept"), "carried")
    return changed.union(same)


def remove_repeated_strings(docs: DataFrame, length: int = 400, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans array<struct<lo, hi>>, kept binary.

    Texts are UTF-8 bytes. Each byte covered by a string of `length` bytes that also starts anywhere else, in the same
    document or another, is removed; overlaps count, matches never cross documents and are judged on the input. spans
    are the maximal removed runs, kept the remaining bytes joined.

    Null and short texts lose nothing. Rows that repeat an id and a text are two documents with one text: each lies in
    the other. Rows that share only an id are told apart by a hash of the text. Null ids are ids like others. An empty
    table gives an empty result; other columns are not read.
    """
    return _removed(docs, length, text, doc_id, [], False).drop("carried")


def without_repeated_passages(docs: DataFrame, length: int, text: str = "text", doc_id: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """docs with texts as remove_repeated_strings leaves them, cut at whole characters, and n_chars counted anew; all
    rows and other columns stay, null texts become empty. Nulls, repeats and empty tables as there."""
    others = [c for c in docs.columns if c not in (text, n_chars)]
    out = _removed(docs, length, text, doc_id, others, True)
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("kept").cast("string").alias(c))
        elif c == n_chars:
            columns.append(F.length(F.col("kept").cast("string")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"carried.c{others.index(c)}").alias(c))
    return out.select(*columns)


def brute_force(texts: dict, length: int) -> dict:
    """What remove_repeated_strings must answer, by a dictionary of all strings: id -> (bytes, removed, spans, sha256)."""
    raws = {k: (t or "").encode() for k, t in texts.items()}
    seen: dict[bytes, int] = {}
    for r in raws.values():
        for i in range(len(r) - length + 1):
            w = r[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = {}
    for k, r in raws.items():
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[k] = (len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
