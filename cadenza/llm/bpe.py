"""Byte-pair encoding and decoding by a pair occurrence index.

All distinct words of a batch lie in one symbol array. The index maps the rank of each mergeable pair to all positions
where it occurs; active ranks are applied in ascending order, and each merge enters the pairs it creates into the lists
of their ranks. A merge's product is made by that merge alone, so pairs that hold it rank later and one ascending sweep
is exact.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Distinct chunks a task keeps between batches; beyond it the cache is emptied, results stay the same.
CACHE = 400_000
#: Separators that str.split drops although the tokenizer keeps them as text.
KEPT = "\x1c\x1d\x1e\x1f"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class WordBPE:
    """Encoder for word-level BPE files with an end-of-word suffix, lower-cased and NFC-normalised."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.token = [""] * (max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1)
        for t, i in vocab.items():
            self.token[i] = t
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.token[i] = t
        self.special_re = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.word_re = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in chars], dtype=np.int32)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], dtype=np.int64)
        self.left, self.right, self.made = (pairs[:, k].astype(np.int32) for k in range(3))
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        if len(set(self.made.tolist())) != len(self.made):
            raise ValueError("two merges make the same token; one ascending sweep would not be exact")
        # Ranks of the first pairs, by the byte and the one behind it (256 more at the end of its word).
        self.symbol = np.concatenate((self.inner, self.last))
        self.first = self.rank(np.repeat(self.inner, 512), np.tile(self.symbol, 256)).reshape(256, 512)
        self.rank_kind = np.uint16 if len(pairs) <= 1 << 16 else np.int32  # 16 bits are sorted by radix

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, -1 where there is none."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, which must not be empty, and the offset at which each word's ids begin, with the end.
        All words are merged together through the pair occurrence index."""
        return self.merged(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum([len(w) for w in words], dtype=np.int64))

    def merged(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode_words of the words whose bytes lie end to end in flat; ends: where each ends."""
        if not len(ends):
            return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        code = flat.astype(np.int32)
        code[ends - 1] += 256
        sym = self.symbol[code]
        n = len(sym)
        # One slot past the end stands for "no neighbour"; its symbol never matches.
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[ends - 1] = n
        starts = np.concatenate(([0], ends[:-1]))
        prv[starts] = n
        sym = np.append(sym, -1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
            live = ranks >= 0
            positions, ranks = positions[live], ranks[live]
            if not len(positions):
                return
            if len(positions) > 1:
                by = np.argsort(ranks.astype(self.rank_kind), kind="stable")
                positions, ranks = positions[by], ranks[by]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            lo = 0
            for hi in [*cuts.tolist(), len(ranks)]:
                r = int(ranks[lo])
                if r in index:
                    index[r].append(positions[lo:hi])
                else:
                    index[r] = [positions[lo:hi]]
                    heapq.heappush(active, r)
                lo = hi

        ranks = self.first[flat[:-1], code[1:]]
        ranks[ends[:-1] - 1] = -1
        enter(np.arange(n - 1), ranks)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b, made = self.left[r], self.right[r], self.made[r]
            then = nxt[at]
            ok = (sym[at] == a) & (sym[then] == b)
            if not ok.all():
                at, then = at[ok], then[ok]
                if not len(at):
                    continue
            if a == b and len(at) > 1:  # of overlapping occurrences every other one merges, from the left
                joined = np.concatenate(([False], then[:-1] == at[1:]))
                place = np.arange(len(at))
                first = np.maximum.accumulate(np.where(joined, 0, place))
                even = (place - first) % 2 == 0
                at, then = at[even], then[even]
            after = nxt[then]
            sym[at], sym[then] = made, -1
            nxt[at] = after
            prv[after] = at
            prv[n] = n
            before = prv[at]
            changed = np.concatenate((at[after < n], before[before < n]))
            if len(changed):
                enter(changed, self.rank(sym[changed], sym[nxt[changed]]))
        keep = sym[:n] >= 0
        return sym[:n][keep], np.concatenate(([0], np.cumsum(np.add.reduceat(keep, starts))))

    def normal(self, text: str) -> str:
        """Text as it is before words are cut, if it holds no special token."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def words(self, chunk: str) -> list[str]:
        """The words of normal text without white space."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.word_re.findall(chunk)

    def pieces(self, chunk: str) -> list[str]:
        """The words and special tokens of one of `chunks`."""
        if "<|" in chunk and chunk[0] != " " and self.special_re.search(chunk):
            return [w for s in self.special_re.split(chunk) for w in ([s] if s in self.special else self.words(self.normal(s)))]
        return self.words(chunk)

    def holds_special(self, text: str) -> bool:
        """Whether text holds a special token, as it is or, like <|ENDOFTEXT|>, what looks like one in normal form."""
        return "<|" in text and bool(self.special_re.search(text) or self.special_re.search(self.normal(text)))

    def chunks(self, text: str) -> list[str]:
        """text cut at white space, in normal form but for chunks with special tokens. A space leads those that only look
        in normal form as if they had one: only what the text itself holds is a special token."""
        if not self.holds_special(text):
            return split_chunks(self.normal(text))
        out = []
        for c in split_chunks(text):
            if not self.special_re.search(c):
                c = self.normal(c)
                if self.special_re.search(c):
                    c = " " + c
            out.append(c)
        return out


def split_chunks(text: str) -> list[str]:
    if any(c in text for c in KEPT):
        return text.split(" ")
    return text.split()


class Spaced:
    """The form of ids as strings with one space between."""

    def __init__(self, strings: list[str]):
        self.strings, self.join = strings, " ".join

    def one(self, token: int) -> str:
        return self.strings[token]

    def words(self, ids: np.ndarray, ends: list[int]) -> list[str]:
        every = [self.strings[i] for i in ids.tolist()]
        return [" ".join(every[a:b]) for a, b in zip(ends, ends[1:])]


class ChunkCache:
    """Forms of each chunk's ids, kept between batches. Beyond CACHE chunks only those that had come up before stay."""

    def __init__(self, bpe: WordBPE, forms: list):
        self.bpe, self.forms = bpe, forms
        self.kept: list[dict[str, object]] = [{} for _ in forms]

    def forget(self) -> None:
        self.kept = [{} for _ in self.forms]

    def learn(self, texts: list[str]) -> None:
        """After it `kept` holds the forms of all chunks of the texts. Their chunks are cut again when they are used:
        millions of small strings at a time would take more memory than the texts."""
        gc.disable()  # what is made here has no cycles; traversing millions of strings would cost a third of the time
        try:
            self._learn(texts)
        finally:
            gc.enable()

    def _learn(self, texts: list[str]) -> None:
        fresh: set[str] = set()
        for t in texts:
            fresh.update(self.bpe.chunks(t))
        if len(self.kept[0]) > CACHE:
            again = fresh & self.kept[0].keys()
            self.kept = [{c: d[c] for c in again} for d in self.kept]
        new = list(fresh - self.kept[0].keys())
        del fresh
        for lo in range(0, len(new), 150_000):
            alone: list[str] = []  # chunks that are one word
            mixed: list[tuple[str, list[str]]] = []
            for c in new[lo : lo + 150_000]:
                if c.isalpha():
                    alone.append(c)
                else:
                    mixed.append((c, self.bpe.pieces(c)))
            distinct = list({*alone, *(w for _, p in mixed for w in p)} - self.bpe.special.keys())
            ids, offsets = self.bpe.encode_words([w.encode() for w in distinct])
            ends = offsets.tolist()
            for d, form in zip(self.kept, self.forms, strict=True):
                word = dict(zip(distinct, form.words(ids, ends), strict=True))
                word.update((t, form.one(i)) for t, i in self.bpe.special.items())
                d.update(zip(alone, map(word.__getitem__, alone)))
                join = form.join
                d.update((c, join([word[w] for w in p])) for c, p in mixed)


class Cut(NamedTuple):
    """Texts cut at white space: the chunks of all, and the offset at which each text's begin, with the end. Texts with
    special tokens, or what looks like one, have none there; odd has theirs by position."""

    chunks: pa.Array
    offsets: np.ndarray
    odd: dict[int, list[str]]


class ChunkIds:
    """Ids of texts by the distinct chunks between their white space. Chunks seen before keep their ids, in one array;
    beyond CACHE of them the array begins anew. Texts are cut and numbered outside Python, chunk by chunk only where a
    chunk is new."""

    def __init__(self, bpe: WordBPE):
        self.bpe = bpe
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def rows(self, chunks: list[str]) -> np.ndarray:
        """The row of each distinct chunk; new ones are encoded together."""
        if len(self.row) > CACHE:
            self.forget()
        new = [c for c in chunks if c not in self.row]
        if new:
            gc.disable()  # what is made here has no cycles
            try:
                self._learn(new)
            finally:
                gc.enable()
        return np.fromiter(map(self.row.__getitem__, chunks), dtype=np.int64, count=len(chunks))

    def _learn(self, new: list[str]) -> None:
        alone, mixed = [], []  # chunks that are one word, and others
        for c in new:
            (alone if c.isalpha() else mixed).append(c)
        pieces = [self.bpe.pieces(c) for c in mixed]
        number = pa.array(chain(alone, chain.from_iterable(pieces)), pa.large_string()).dictionary_encode()
        words = number.dictionary
        _, cut, flat = words.buffers()
        ends = np.frombuffer(cut, dtype=np.int64)[1 : len(words) + 1] if len(words) else np.zeros(0, dtype=np.int64)
        ids, cut = self.bpe.merged(np.frombuffer(flat, dtype=np.uint8)[: ends[-1]] if len(words) else ends.astype(np.uint8), ends)
        begin, size = cut[:-1].copy(), np.diff(cut)
        # Words that are special tokens have one id, behind the others.
        for t, at in zip(self.bpe.special, pc.index_in(pa.array(self.bpe.special, words.type), value_set=words).to_pylist()):
            if at is not None:
                begin[at], size[at] = len(ids), 1
                ids = np.append(ids, np.int32(self.bpe.special[t]))
        word = number.indices.to_numpy()
        count = np.concatenate((np.ones(len(alone), dtype=np.int64), np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))))
        gathered = ids[spread(begin[word], size[word])]
        ends = np.concatenate(([0], np.cumsum(size[word])))[np.concatenate(([0], np.cumsum(count)))]
        self.row.update(zip(chain(alone, mixed), range(len(self.begin), len(self.begin) + len(new)), strict=True))
        self.begin = np.concatenate((self.begin, len(self.ids) + ends[:-1]))
        self.size = np.concatenate((self.size, np.diff(ends)))
        self.ids = np.concatenate((self.ids, gathered))

    def cut(self, texts: list[str]) -> Cut:
        """Chunks of the texts, for encode_all."""
        # Chunks with special tokens keep their case and are few, so Python cuts their texts, and those that look alike.
        odd = {i: self.bpe.chunks(t) for i, t in enumerate(texts) if self.bpe.holds_special(t)}
        cut = pc.ascii_split_whitespace(pa.array(["" if i in odd else self.bpe.normal(t) for i, t in enumerate(texts)], pa.large_string()))
        return Cut(cut.values, cut.offsets.to_numpy(), odd)

    def encode_all(self, cuts: list[Cut]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`encode` of the texts of each cut. What is new in any of them is encoded together: the pair occurrence index
        takes a few steps for each merge that occurs, however many places it has. cuts is emptied."""
        number = pa.chunked_array([c.chunks for c in cuts], pa.large_string()).dictionary_encode().unify_dictionaries()
        rest = [(c.offsets, c.odd) for c in cuts]
        cuts.clear()
        chunks = number.chunk(0).dictionary.to_pylist()
        if oddly := {c for _, odd in rest for own in odd.values() for c in own}:
            chunks += oddly.difference(chunks)
        row = self.rows(chunks)
        place = dict(zip(chunks, row.tolist(), strict=True)) if oddly else {}
        del chunks, oddly
        begin, size, ids = self.begin, self.size, self.ids
        for part, (offsets, odd) in zip(number.chunks, rest, strict=True):
            at = row[part.indices.to_numpy()]
            ends = np.concatenate(([0], np.cumsum(size[at])))[offsets]
            found = ids[spread(begin[at], size[at])]
            if odd:
                parts = np.split(found, ends[1:-1])
                for i, own in odd.items():
                    at = np.array([place[c] for c in own], dtype=np.int64)
                    parts[i] = ids[spread(begin[at], size[at])]
                found, ends = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            yield found, ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and the offset at which each text's begin, with the end."""
        return next(self.encode_all([self.cut(texts)]))


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] places, then begin[1], ... and so on."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(int(size.sum()))


_LOADED: dict = {}


def loaded(path: str, kind: str, make) -> object:
    """One encoder and cache for each worker process, path and use."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = make(WordBPE(path))
    return _LOADED[path, kind]


def forget() -> None:
    """Empty the caches of this process; encoders stay."""
    for cache in _LOADED.values():
        cache.forget()


def slices(texts: list[str], most: int = 4_000_000):
    """Runs of texts of at most `most` characters in all, one text at least."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def spaced_numbers(bpe: WordBPE) -> Spaced:
    return Spaced([str(i) for i in range(len(bpe.token))])


def spaced_tokens(bpe: WordBPE) -> Spaced:
    return Spaced(bpe.token)


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, ids array<int>, decoded string (tokens joined by one space, special ones kept).

    Null and empty texts, and texts of white space only, have no ids and decode to "". Rows may repeat; row order and
    other columns do not matter. An empty table gives an empty result. Texts are encoded whole; memory follows the
    batch and the cache, not the partition.
    """

    def run(batches):
        cache = loaded(path, "ids", ChunkIds)
        token = cache.bpe.token
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts):
                ids, offsets = cache.encode(texts[lo:hi])
                decoded = [" ".join([token[i] for i in part]) for part in map(np.ndarray.tolist, np.split(ids, offsets[1:-1]))]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, forget), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents' ids and decoded text, formed in the workers
    so that no token list leaves them. Null and empty texts as there."""

    def run(batches):
        cache = loaded(path, "text", lambda b: ChunkCache(b, [spaced_numbers(b), spaced_tokens(b)]))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[tuple[int, str, str]] = []
            for lo, hi in slices(texts):
                cache.learn(texts[lo:hi])
                number, shown = cache.kept
                for t in texts[lo:hi]:
                    c = cache.bpe.chunks(t)
                    ids = " ".join(filter(None, map(number.__getitem__, c)))
                    out.append((ids.count(" ") + 1 if ids else 0, sha(ids), sha(" ".join(filter(None, map(shown.__getitem__, c))))))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, forget), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
