"""Scores of texts under an online logistic context-mixing model learned from the corpus.

A text is a sequence of lower-cased words and one end. Each token is coded by binary decisions. Each is predicted by several
hashed contexts, whose stretched probabilities are mixed with weights that a gate selects, and refined by an adaptive map.

1. Is it the token that followed the last place of the same two tokens in this text? The same for one token. Contexts: the
   run of right guesses, the place in the text, the token before.
2. Is it in the common vocabulary? If so, bits of its code follow. The code halves the sorted words by their counts, again
   and again, so words that begin alike share nodes. Contexts of a bit: its node alone, with the last very common word, with
   the word before, with the two words before, all counted over the corpus. After MIXED bits the word costs its share of
   what they have left.
3. A word outside the common vocabulary costs what a mixture of its share of the rarer training words and of its spelling
   gives it. Spelling is eight bits a byte; contexts are the last one to five bytes.

Learning is online: a task codes its training texts one portion after another with what it has counted so far, moves the
weights along the error of each block, then counts the portion. Counts of all tasks are added up and weights averaged, so
all training texts take part and no weight was learned from a text that its own tables had seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import spread
from .common import bucket_of, materialize, tidy

#: The end of a text among tokens, which are never empty nor hold a line feed.
END = b"\n"
#: The most words of the common vocabulary, which every worker holds; rarer words get their counts and costs by joins.
COMMON = 300_000
#: Slots of the tables of the last one, two, three, four and five bytes (powers of two), slots of a decision table.
ORDER_SLOTS = (1 << 16, 1 << 18, 1 << 20, 1 << 20, 1 << 20)
DECISION_SLOTS = 1 << 12
#: Slots of a table of code contexts: four for each training token, between these bounds. What a worker holds stays bounded.
CODE_SLOTS = (1 << 14, 1 << 20)
#: The most bits of a word's code that contexts predict; training tokens that one task learns from.
MIXED, TASK_TOKENS = 10, 4_000_000
#: Distinct words that one task counts the spelling of; the most frequent words that tell what a text is about to be like.
SPELLED, ANCHORS = 500_000, 64
#: Slots of one block in which tables are added up.
BLOCK = 1 << 16
#: Learning rate, bits after which weights are updated.
RATE, STEP = 0.02, 1 << 15
#: Bits that a task tallies before it adds them to its counts; bytes of texts coded at a time; tokens whose bits are made at
#: a time to learn and to score, few enough for a processor's cache.
HELD, PORTION, CODED, PRICED = 1 << 22, 250_000, 20_000, 6700
#: Bytes of texts whose words are looked up, and of words that are spelled, at a time: what comes again costs once.
NUMBERED, SPELLED_BYTES = 8_000_000, 1 << 18
LIMIT, BIAS = 12.0, 0.3

MIX = np.uint64(0x9E3779B97F4A7C15)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -LIMIT, LIMIT)))


def stretch_counts(ones: np.ndarray, zeros: np.ndarray, prior: float = 0.4) -> np.ndarray:
    return np.clip(np.log((ones + prior) / (zeros + prior)), -LIMIT, LIMIT).astype(np.float32)


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, A to Z lower-cased; the number of each word of all texts among them; words of each text."""
    # Taken as a copy: lower-casing a slice that has been cast reads past its offset.
    whole = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    flat = lists.values
    some = pc.binary_length(flat).to_numpy() > 0
    before = np.concatenate(([0], np.cumsum(some)))
    words = flat.filter(pa.array(some)).dictionary_encode()
    return words.dictionary.cast(pa.large_binary()), words.indices.to_numpy().astype(np.int64), np.diff(before[lists.offsets.to_numpy()])


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """distinct_words, the words as a list."""
    words, index, counts = distinct_words(texts)
    return words.to_pylist(), index, counts


# Mixing


#: Steps of a stretched probability in the tables, buckets of the mixed one, points of the adaptive map.
FINE, BUCKETS, POINTS = 64, 4096, 33


def pack_tables(counts: list[np.ndarray]) -> list[np.ndarray]:
    """Tables of a Mixer from counts (2 x slots) of zeros and ones. The fuller a table, the more of a slot comes from
    other contexts that share it: its average is taken for doubt, in the prior and in what counts as seen."""
    out = []
    for t in counts:
        seen = t.sum(0)
        doubt = float(seen.mean())
        often = sum((seen > step).astype(np.int16) for step in np.array([0.5, 3, 12]) + doubt)
        out.append((np.rint(stretch_counts(t[1], t[0], 0.4 + doubt / 2) * FINE).astype(np.int16) << 2) | often)
    return out


@dataclass
class Mixer:
    """Tables of predictors (stretched probability in steps of 1/FINE, times four, plus 0 to 3 for how often the slot was
    seen), mixing weights by gate, refinement by bucket of the mixed probability."""

    tables: list[np.ndarray]
    weights: np.ndarray  # gate x (fixed inputs + tables + bias)
    refined: np.ndarray | None = None  # probability of a one at each of POINTS points

    def mixed(self, slots, weights: np.ndarray | None = None, fixed: tuple = (), gate: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Mixed stretched probability, the inputs, the gate: how often the last three tables' slots were seen, unless
        it is given."""
        packed = [t.take(s, mode="clip") for t, s in zip(self.tables, slots, strict=True)]
        if gate is None:
            gate = ((packed[-3] & 3) << 4 | (packed[-2] & 3) << 2 | packed[-1] & 3).astype(np.intp)
        x = [*fixed, *[(v >> 2) * np.float32(1 / FINE) for v in packed]]
        w = (self.weights if weights is None else weights).astype(np.float32).T.copy()
        z = w[-1].take(gate, mode="clip") * np.float32(BIAS)
        for v, wj in zip(x, w, strict=False):
            z += v * wj.take(gate, mode="clip")
        return z, x, gate

    def curve(self) -> np.ndarray:
        """Probability of a one by bucket of the mixed stretched probability: the average of the mixed one and of the
        adaptive map's, interpolated."""
        z = (np.arange(BUCKETS) + 0.5) / BUCKETS * 2 * LIMIT - LIMIT
        p = squash(z)
        if self.refined is not None:
            p = 0.5 * p + 0.5 * np.interp((z + LIMIT) / (2 * LIMIT) * (len(self.refined) - 1), np.arange(len(self.refined)), self.refined)
        return np.clip(p, 1e-9, 1 - 1e-9)

    def bucket(self, z: np.ndarray) -> np.ndarray:
        return np.clip((z + np.float32(LIMIT)) * np.float32(BUCKETS / (2 * LIMIT)), 0, BUCKETS - 1).astype(np.int32)

    def logs(self) -> np.ndarray:
        """log10 probability of a zero by bucket, then of a one."""
        p = self.curve()
        return np.log10(np.concatenate((1 - p, p)))

    def price(self, logs: np.ndarray, slots, bit: np.ndarray, fixed: tuple = (), gate: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each bit."""
        out = np.empty(len(bit))
        for lo in range(0, len(bit), STEP):
            on = slice(lo, lo + STEP)
            z = self.mixed([s[on] for s in slots], None, tuple(f[on] for f in fixed), None if gate is None else gate[on])[0]
            out[on] = logs[self.bucket(z) + BUCKETS * bit[on].astype(np.int32)]
        return out

    def cost(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of the spelling of each word, its closing space included."""
        out, logs = np.zeros(len(words)), self.logs()
        for lo, hi in runs(np.cumsum([len(w) + 1 for w in words]), SPELLED_BYTES):
            owner, key = spelled_bytes(words[lo:hi])
            # A byte after the same five costs the same, so each such run is priced once.
            found, back = np.unique(key, return_inverse=True)
            price = np.empty(len(found))
            for at in range(0, len(found), STEP // 8):
                price[at : at + STEP // 8] = self.price(logs, *byte_bits(found[at : at + STEP // 8])).reshape(-1, 8).sum(1)
            out[lo:hi] = np.bincount(owner, weights=price[back], minlength=hi - lo)
        return out


Speller = Mixer


class Learner:
    """What one task learns for one mixer: counts of its contexts, weights, and the sums behind the adaptive map."""

    def __init__(self, sizes: tuple[int, ...], start: np.ndarray):
        self.counts = [np.zeros((2, n), dtype=np.float32) for n in sizes]
        self.mixer = Mixer(pack_tables(self.counts), start.astype(np.float64))
        self.bits, self.map = 0, np.zeros((2, POINTS))  # ones and zeros at each point
        self.path, self.length = np.zeros(start.shape), 0.0
        self.tally: list[np.ndarray] = []  # what is not yet in counts, zeros before ones
        self.waiting = 0

    def learn(self, slots, bit: np.ndarray, weight: np.ndarray | None = None, fixed: tuple = (), gate: np.ndarray | None = None) -> None:
        """Predict the bits with what is known, move the weights block by block, then tally the bits."""
        w, bit = self.mixer.weights, bit.astype(np.intp)
        for lo in range(0, len(bit), STEP):
            on = slice(lo, lo + STEP)
            z, x, g = self.mixer.mixed([s[on] for s in slots], None, tuple(f[on] for f in fixed), None if gate is None else gate[on])
            err = bit[on] - squash(z)
            rate = RATE / np.sqrt(np.maximum(np.bincount(g, minlength=len(w)), 1))
            for j, v in enumerate(x):
                w[:, j] += rate * np.bincount(g, weights=err * v, minlength=len(w))
            w[:, -1] += rate * BIAS * np.bincount(g, weights=err, minlength=len(w))
            at = np.rint((np.clip(z, -LIMIT, LIMIT) + LIMIT) * ((POINTS - 1) / (2 * LIMIT))).astype(np.intp)
            self.map += np.bincount(at + POINTS * (1 - bit[on]), minlength=2 * POINTS).reshape(2, -1)
            # Weights wander with each block; their average is kept, in which later blocks, which knew more, weigh more.
            self.bits += len(g)
            self.path += w * (len(g) * self.bits)
            self.length += len(g) * self.bits
        # Tallies stay far below 2^24, so ones add up exactly in single precision; weights take double.
        kind = np.float32 if weight is None else np.float64
        if not self.tally:
            self.tally = [np.zeros(t.size, dtype=kind) for t in self.counts]
        ones = {n: bit * n for n in {t.shape[1] for t in self.counts}}
        for t, s in zip(self.tally, slots, strict=True):
            np.add.at(t, s + ones[len(t) // 2], kind(1) if weight is None else weight)
        self.waiting += len(bit)
        if self.waiting > HELD:
            self.count()

    def count(self) -> None:
        if self.waiting:
            for t, more in zip(self.counts, self.tally, strict=True):
                t += more.reshape(2, -1)
                more[:] = 0
        self.waiting = 0

    def refresh(self) -> None:
        self.count()
        self.mixer.tables = pack_tables(self.counts)

    def rows(self, name: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(part, v, b, sums) rows that add up over tasks: blocks of tables, weights times bits, map sums."""
        self.count()
        for k, t in enumerate(self.counts):
            for v in (0, 1):
                for b in range(0, t.shape[1], BLOCK):
                    yield name + k, v, b, t[v, b : b + BLOCK].tobytes()
        mean = self.path / self.length if self.length else self.mixer.weights
        more = np.concatenate(([self.bits], (mean * self.bits).ravel(), self.map.ravel()))
        yield name + 99, 0, 0, more.astype(np.float32).tobytes()


ADDED = "part int, v int, b int, sums binary"


def sum_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "v", "b", "sums"])


def mixers_of(rows: DataFrame, made: dict[int, Learner]) -> dict[int, Mixer]:
    """Mixers by name from the rows of all tasks, added up in blocks; what the driver gets has one size for any input."""

    def add(batches):
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for k, v, b, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                total[k, v, b] = total.get((k, v, b), 0) + np.frombuffer(raw, dtype=np.float32)
        for key, t in total.items():
            yield sum_batch([(*key, t.astype(np.float32).tobytes())])

    for r in rows.repartition("part", "v", "b").mapInArrow(tidy(add), ADDED).toLocalIterator():
        name = r["part"] // 100 * 100
        learner, sums = made[name], np.frombuffer(r["sums"], dtype=np.float32)
        if r["part"] == name + 99:
            n = learner.mixer.weights.size
            learner.bits = float(sums[0])
            if learner.bits:
                learner.mixer.weights = (sums[1 : n + 1] / sums[0]).reshape(learner.mixer.weights.shape)
                ones, zeros = sums[n + 1 :].reshape(2, -1)
                grid = squash(np.linspace(-LIMIT, LIMIT, POINTS))
                learner.mixer.refined = np.clip((ones + 20 * grid) / (ones + zeros + 20), 1e-6, 1 - 1e-6)
        else:
            learner.counts[r["part"] - name][r["v"], r["b"] : r["b"] + BLOCK] = sums
    for learner in made.values():
        learner.refresh()
        learner.mixer.weights = learner.mixer.weights.astype(np.float32)
    return {name: learner.mixer for name, learner in made.items()}


# Spelling


def spelled_bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the words and their closing space: word number; the five bytes before, the nearest highest, and it."""
    joined = np.frombuffer(b" " * 5 + b"".join(w + b"     " for w in words), dtype=np.uint8)
    sizes = np.array([len(w) + 1 for w in words])
    starts = 5 + np.cumsum(sizes + 4) - (sizes + 4)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]
    key = np.zeros(len(at), dtype=np.uint64)
    for back in (1, 2, 3, 4, 5, 0):
        key = key << np.uint64(8) | joined[at - back]
    return owner, key


def byte_bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table slots (order x bit) and outcome of the eight bits of each byte of spelled_bytes."""
    byte = (key & np.uint64(255)).astype(np.uint32)
    shift = np.arange(7, -1, -1, dtype=np.uint32)
    bit = ((byte[:, None] >> shift) & np.uint32(1)).astype(np.uint8)
    node = (np.uint32(1) << (np.uint32(7) - shift)) | (byte[:, None] >> (shift + np.uint32(1)))
    spread_ = node * np.uint32(0x9E3779B1)
    slots = np.empty((len(ORDER_SLOTS), len(key), 8), dtype=np.intp)
    for k, size in enumerate(ORDER_SLOTS):
        context = key >> np.uint64(8 * (len(ORDER_SLOTS) - k))
        mark = ((context + np.uint64(k)) * MIX >> np.uint64(32)).astype(np.uint32)
        slots[k] = (mark[:, None] ^ spread_) >> np.uint32(33 - int(size).bit_length())
    return slots.reshape(len(ORDER_SLOTS), -1), bit.ravel()


def spelled_bits(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bit of the words and their closing space: word number, table slots (order x bit), outcome."""
    owner, key = spelled_bytes(words)
    return np.repeat(owner, 8), *byte_bits(key)


def spelling_learner() -> Learner:
    return Learner(ORDER_SLOTS, np.tile(np.array([0.1, 0.2, 0.3, 0.3, 0.3, 0.0]), (64, 1)))


def spelling_rows(counts: DataFrame, distinct: int) -> DataFrame:
    """What tasks learn from the words of counts(token, c), all of them once, each weighing 1 + log2 c in the tables. Words
    come in the order of a hash, so lost tasks learn the same again."""
    words = counts.where(F.col("token") != F.lit(END)).select("token", (1 + F.log2("c")).alias("weight"))
    words = words.repartition(max(1, -(-distinct // SPELLED)), "token").sortWithinPartitions(F.xxhash64("token"), "token")

    def run(batches):
        learner, since, most = spelling_learner(), 0, 2000
        for batch in batches:
            tokens, weight = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for lo in range(0, len(tokens), 2000):
                owner, slots, bit = spelled_bits(tokens[lo : lo + 2000])
                learner.learn(slots, bit, weight[lo : lo + 2000][owner])
                since += 2000
                if since >= most:
                    learner.refresh()
                    since, most = 0, min(2 * most, 100_000)
        for row in learner.rows(0):
            yield sum_batch([row])

    return words.mapInArrow(tidy(run), ADDED)


# Words


@dataclass
class Vocabulary:
    """Common words, most frequent first, and their codes."""

    number: pa.Array  # the words; the place of each is its number
    count: np.ndarray
    sums: tuple[int, int]  # training tokens, distinct training tokens
    tail: tuple[int, float]  # tokens of rarer words; share of words seen in training expected among words outside the vocabulary
    begin: np.ndarray  # place at which each word's code begins in node and bit, and the end
    node: np.ndarray
    bit: np.ndarray
    stretched: np.ndarray  # of each node: stretched share of its ones
    rest: np.ndarray  # log10 of each word's share of the words that agree with it in all bits of the code


def balanced_code(words: list[bytes], count: np.ndarray, most: int = MIXED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """begin, node, bit, stretched, rest of a Vocabulary: sorted words are cut where the counts on both sides are most
    alike, and so are the parts, `most` times at the most. Shares of nodes and rest make up each word's share exactly."""
    v = len(words)
    order = np.array(sorted(range(v), key=words.__getitem__), dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(count[order]))).astype(np.float64)
    lo, hi, depth = np.zeros(v, dtype=np.int64), np.full(v, v, dtype=np.int64), np.zeros(v, dtype=np.int64)
    stretched, steps, on = np.zeros(max(0, v - 1), dtype=np.float32), [], np.arange(v)
    for _ in range(most):
        on = on[hi[on] - lo[on] > 1]
        if not len(on):
            break
        a, b = lo[on], hi[on]
        middle = (total[a] + total[b]) / 2
        cut = np.searchsorted(total, middle)
        cut -= (middle - total[cut - 1] < total[np.minimum(cut, v)] - middle) & (cut > 0)
        cut = np.clip(cut, a + 1, b - 1)
        one = on >= cut
        stretched[cut - 1] = np.log((total[b] - total[cut]) / (total[cut] - total[a]))
        steps.append((on, cut - 1, one))
        lo[on], hi[on] = np.where(one, cut, a), np.where(one, b, cut)
        depth[on] += 1
    begin, rest = np.zeros(v + 1, dtype=np.int64), np.zeros(v)
    sizes = np.zeros(v, dtype=np.int64)
    sizes[order] = depth
    np.cumsum(sizes, out=begin[1:])
    rest[order] = np.log10(np.diff(total) / (total[hi] - total[lo]))
    node, bit = np.zeros(begin[-1], dtype=np.int32), np.zeros(begin[-1], dtype=np.uint8)
    for k, (places, n, one) in enumerate(steps):
        at = begin[order[places]] + k
        node[at], bit[at] = n, one
    return begin, node, bit, stretched, rest


def last_followers(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the one that followed the last earlier place of the same two, and one, preceding tokens of its
    text; -1 where there is none. ids: numbers of tokens, texts one after another."""
    n = len(ids)
    begin = np.concatenate(([True], doc[1:] != doc[:-1])) if n else np.zeros(0, dtype=bool)
    one = np.concatenate(([-1], ids[:-1]))
    one[begin] = -2
    two = np.concatenate(([-1], one[:-1]))
    two[begin] = -3
    out, width, place = [], max(1, n.bit_length()), np.arange(n, dtype=np.uint64)
    for key in ((one.astype(np.uint64) * MIX) ^ two.astype(np.uint64) << np.uint64(1), one.astype(np.uint64)):
        key = (key ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * MIX
        # The place fills the low bits, so a plain sort of the numbers keeps equal keys in text order.
        low = np.uint64((1 << width) - 1)
        found = np.sort((key & ~low) | place)
        order = (found & low).astype(np.int64)
        same = np.concatenate(([False], (found[1:] ^ found[:-1]) <= low)) if n else np.zeros(0, dtype=bool)
        guess = np.full(n, -1, dtype=np.int64)
        guess[order[1:]] = np.where(same[1:], ids[order[:-1]], -1)
        guess[one == -2] = -1
        out.append(guess)
    return out[0], out[1]


@dataclass
class Portion:
    """Texts with numbered tokens. Words outside the vocabulary have numbers past it, their places in a list of rare words."""

    ids: np.ndarray
    doc: np.ndarray
    sizes: np.ndarray
    common: np.ndarray
    begin: np.ndarray  # place at which the token's text begins


def runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole things that end at `ends`, of `most` in all or one thing."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def numbered(texts: pa.Array, vocabulary: Vocabulary, most: int = PORTION) -> Iterator[tuple[pa.Array, list[tuple[int, int, Portion]]]]:
    """Runs of whole texts, of `most` bytes or one text: where each begins and ends, and its tokens. Several come together,
    with their rare words, as words are looked up for NUMBERED bytes at a time."""
    v = len(vocabulary.number)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    parts = list(runs(ends, most))
    for a, b in runs(np.array([ends[hi - 1] for _, hi in parts]), NUMBERED):
        first = parts[a][0]
        words, index, counts = distinct_words(texts.slice(first, parts[b - 1][1] - first))
        words = pa.concat_arrays([words, pa.array([END], pa.large_binary())])
        number = pc.fill_null(pc.index_in(words, value_set=vocabulary.number), -1).to_numpy().astype(np.int64)
        new = number < 0
        number[new] = v + np.arange(np.count_nonzero(new))
        ids, sizes = np.insert(number[index], np.cumsum(counts), number[-1]), counts + 1
        before = np.concatenate(([0], np.cumsum(sizes)))
        out = []
        for lo, hi in parts[a:b]:
            on, size = ids[before[lo - first] : before[hi - first]], sizes[lo - first : hi - first]
            out.append((lo, hi, Portion(on, np.repeat(np.arange(hi - lo), size), size, on < v, np.repeat(np.cumsum(size) - size, size))))
        yield words.filter(pa.array(new)).cast(pa.binary()), out


def decisions(p: Portion, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decisions of kinds 0 to 2: owner (token), outcome, slots (3 x decision), gate; last, the tokens that no guess has
    given. v: words of the vocabulary."""
    ids, n, at = p.ids, len(p.ids), np.arange(len(p.ids))
    two, one = last_followers(ids, p.doc)
    hit2, hit1 = two == ids, one == ids
    first = at == p.begin

    def run_before(hit):
        """Length of the run of right guesses before each token, up to 15, within its text."""
        last = np.maximum.accumulate(np.where(hit & ~first, 0, at)) if n else at
        before = np.concatenate(([0], (at - last)[:-1])) if n else at
        return np.where(first, 0, np.minimum(before, 15))

    r2, r1 = run_before(hit2), run_before(hit1)
    place = np.minimum(np.frexp((at - p.begin + 1).astype(np.float64))[1] - 1, 15)
    prior = np.concatenate(([v], np.minimum(ids[:-1], v))) if n else ids
    prior = np.where(first, v, prior) & 1023
    sums = np.concatenate(([0], np.cumsum(~p.common)))
    lo = np.maximum(p.begin, at - 64)
    rate = np.minimum((sums[at] - sums[lo]) * 16 // np.maximum(at - lo, 1), 15)  # sixteenths of rare words just before
    ask2 = np.flatnonzero(two >= 0)
    ask1 = np.flatnonzero((one >= 0) & (one != two) & ~hit2)
    open_ = np.flatnonzero(~hit2 & ~((one >= 0) & hit1))
    rows = [
        (ask2, hit2, (r2, (two == one) * 16 + place, prior), r2), (ask1, hit1, (r1, place * 2 + (two >= 0), prior), r1), (open_, p.common, (rate, place, prior), rate),
    ]
    owner = np.concatenate([r[0] for r in rows])
    bit = np.concatenate([r[1][r[0]] for r in rows]).astype(np.int64)
    slots = [np.concatenate([(r[2][j][r[0]] * 9 + kind * 3 + j) % DECISION_SLOTS for kind, r in enumerate(rows)]) for j in range(3)]
    gate = np.concatenate([kind * 16 + r[3][r[0]] for kind, r in enumerate(rows)])
    return owner, bit, slots, gate, open_


def code_contexts(p: Portion, v: int) -> list[np.ndarray]:
    """Hashes of each token's contexts: the last very common word, the word before, the two words before it."""
    at, ids = np.arange(len(p.ids)), np.minimum(p.ids, v).astype(np.uint64)
    pad = np.array([v + 1], dtype=np.uint64)
    one = np.where(at > p.begin, np.concatenate((pad, ids[:-1])), pad)
    two = np.where(at > p.begin + 1, np.concatenate((pad, pad, ids[:-2]))[: len(ids)], pad)
    last = np.maximum.accumulate(np.where(p.ids < ANCHORS, at, -1)) if len(at) else at
    last = np.concatenate(([-1], last[:-1])) if len(at) else at
    anchor = np.where(last >= p.begin, ids[np.maximum(last, 0)], pad)
    k = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    return [((c + np.uint64(1)) * m >> np.uint64(32)).astype(np.uint32) for c, m in ((anchor, k[0]), (one, k[1]), ((one * k[2]) ^ two, k[1]))]


def code_bits(p: Portion, which: np.ndarray, vocabulary: Vocabulary, slots: int, most: int = CODED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Bits of the codes of the tokens `which`, all common, `most` tokens at a time: these tokens, how many bits each has,
    outcome, slots (3 x bit), stretched share of the node."""
    begin, contexts = vocabulary.begin, code_contexts(p, len(vocabulary.number))
    shift = np.uint32(33 - slots.bit_length())
    for lo in range(0, len(which), most):
        some = which[lo : lo + most]
        size = begin[p.ids[some] + 1] - begin[p.ids[some]]
        at = spread(begin[p.ids[some]], size)
        node = vocabulary.node.take(at)
        mark = node.view(np.uint32) * np.uint32(0x9E3779B1)
        out = [(((np.repeat(c[some], size) ^ mark) * np.uint32(0x85EBCA6B)) >> shift).astype(np.intp) for c in contexts]
        yield some, size, vocabulary.bit.take(at), out, vocabulary.stretched.take(node)


def decision_learner() -> Learner:
    return Learner((DECISION_SLOTS,) * 3, np.tile(np.array([0.4, 0.4, 0.4, 0.0]), (48, 1)))


def code_learner(slots: int) -> Learner:
    return Learner((slots,) * 3, np.tile(np.array([0.8, 0.2, 0.1, 0.1, 0.0]), (64, 1)))


def code_slots(tokens: int) -> int:
    """Slots of a code table for so many training tokens."""
    return min(CODE_SLOTS[1], max(CODE_SLOTS[0], 1 << (4 * tokens).bit_length()))


def word_rows(train: DataFrame, vocabulary, slots: int, tokens: int) -> DataFrame:
    """What tasks learn from train(text), all of it, for decisions (100) and codes (200)."""

    def run(batches):
        decided, coded, since, most = decision_learner(), code_learner(slots), 0, 10_000
        v = vocabulary.value
        for batch in batches:
            # Tables are of use early: what a task sees first comes in small portions.
            for _, parts in numbered(batch.column(0), v, min(PORTION, int(6 * most))):
                for _, _, p in parts:
                    _, bit, at, gate, open_ = decisions(p, len(v.number))
                    decided.learn(at, bit, gate=gate)
                    for _, _, bit, at, st in code_bits(p, open_[p.common[open_]], v, slots):
                        coded.learn(at, bit, fixed=(st,))
                    since += len(p.ids)
                    if since >= most:
                        decided.refresh()
                        coded.refresh()
                        since, most = 0, min(2 * most, 500_000)
        for name, learner in ((100, decided), (200, coded)):
            for row in learner.rows(name):
                yield sum_batch([row])

    return train.coalesce(max(1, -(-tokens // TASK_TOKENS))).mapInArrow(tidy(run), ADDED)


# Corpus


def token_counts(train: DataFrame) -> DataFrame:
    """token binary, c long over train(text); each batch combines its own before the shuffle."""

    def run(batches):
        for batch in batches:
            words, index, counts = distinct_words(batch.column(0))
            found = np.bincount(index, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.cast(pa.binary()), pa.array([END], pa.binary())]), pa.array(np.append(found, len(counts)), pa.int64())], ["token", "c"])

    return train.mapInArrow(tidy(run), "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def common_words(counts: DataFrame, most: int = COMMON) -> Vocabulary:
    """The words at least as frequent as the smallest power of two that leaves no more than `most`."""
    rows = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s")).collect()
    sizes = {r["b"]: (r["n"], r["s"]) for r in rows}
    low, total = max(sizes, default=0) + 1, 0
    while low > 0 and total + sizes.get(low - 1, (0, 0))[0] <= most:
        low -= 1
        total += sizes.get(low, (0, 0))[0]
    words = counts.where(F.col("c") >= (1 << low)).orderBy(F.desc("c"), "token").collect() if total else []
    c = np.array([r["c"] for r in words], dtype=np.int64)
    # After Good and Turing a text's next word has count k with chance (k + 1) n[k + 1] / N: unseen ones weigh n[1], tail
    # words the tokens of counts from 2 to the least common one.
    least = int(c.min()) if len(c) else 1 << 62
    once, rare, upto = counts.select(F.sum(F.when(F.col("c") == 1, 1)), F.sum(F.when(F.col("c") < least, F.col("c"))), F.sum(F.when(F.col("c") <= least, F.col("c")))).first()
    seen = ((upto or 0) - (once or 0) + 0.5) / ((upto or 0) + 1.0) if rare else 0.0
    return Vocabulary(pa.array([bytes(r["token"]) for r in words], pa.large_binary()), c, (sum(s for _, s in sizes.values()), sum(n for n, _ in sizes.values())), (rare or 0, seen), *balanced_code([bytes(r["token"]) for r in words], c))


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", modulus: int = 7, held: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from rows whose crc32 of the id modulo `modulus` is not `held`. Null and empty texts are one token, the end.
    base_score is the add-one unigram score over training tokens; score the model's log10 probability. Common words are
    looked up in each worker; counts of the others come by a join on the word itself, for both scores, so any vocabulary
    works. Rows may repeat, each is scored on its own; rows with a null id are scored and learned from; with nothing to
    learn from, base_score is 0 a token (one token type, unseen) and score is that of the untrained model. An empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    train = rows.where(bucket_of("doc_id", modulus) != held).select("text")
    counts = materialize(token_counts(train), "counts")
    words = common_words(counts)
    total, distinct = words.sums
    slots = code_slots(total)
    speller = mixers_of(spelling_rows(counts, distinct), {0: spelling_learner()})[0]
    vocabulary = spark.sparkContext.broadcast(words)
    made = mixers_of(word_rows(train, vocabulary, slots, total), {100: decision_learner(), 200: code_learner(slots)})
    model = spark.sparkContext.broadcast((speller, made[100], made[200]))

    def run(batches):
        speller, decider, coder = model.value
        v = vocabulary.value
        n = len(v.number)
        decider_logs, coder_logs = decider.logs(), coder.logs()
        share = np.append(np.log10(v.count + 1.0), 0.0)  # zero past the vocabulary
        for batch in batches:
            for words, parts in numbered(batch.column(1), v):
                # Spelled as words that training has not seen; the join adds what a rarer training word's count gives.
                price = speller.cost(words.to_pylist()) + np.log10(1 - v.tail[1])
                for lo, hi, p in parts:
                    m = hi - lo
                    owner, bit, at, gate, open_ = decisions(p, n)
                    cost = np.bincount(p.doc[owner], weights=decider.price(decider_logs, at, bit, gate=gate), minlength=m)
                    coded = open_[p.common[open_]]
                    for some, size, bit, at, st in code_bits(p, coded, v, slots, PRICED):
                        cost += np.bincount(np.repeat(p.doc[some], size), weights=coder.price(coder_logs, at, bit, (st,)), minlength=m)
                    unknown = open_[~p.common[open_]]  # rare words that no guess has given
                    more, begin = np.zeros(len(p.ids)), np.cumsum(p.sizes) - p.sizes
                    more[coded], more[unknown] = v.rest[p.ids[coded]], price[p.ids[unknown] - n]
                    cost += np.add.reduceat(more, begin)
                    base = np.add.reduceat(share.take(p.ids, mode="clip"), begin)
                    known = np.add.reduceat(p.common, begin, dtype=np.int64)
                    rare = np.flatnonzero(~p.common)
                    n_bytes = np.maximum(1, pc.fill_null(pc.binary_length(batch.column(1).slice(lo, m)), 0).to_numpy(zero_copy_only=False))
                    free = np.ones(len(p.ids), dtype=bool)
                    free[unknown] = False
                    cuts = pa.array(np.concatenate(([0], np.cumsum(p.sizes - known))).astype(np.int32))
                    tail = pa.ListArray.from_arrays(cuts, words.take(pa.array(p.ids[rare] - n)))
                    spelled = pa.ListArray.from_arrays(cuts, pa.array(price[p.ids[rare] - n], mask=free[rare]))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, m), pa.array(p.sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(cost), pa.array(n_bytes, pa.int64()), tail, spelled],
                        ["doc_id", "n_tokens", "common", "base", "score", "n_bytes", "tail", "spelled"],
                    )

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = materialize(rows.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, common long, base double, score double, n_bytes long, tail array<binary>, spelled array<double>").withColumn("row", F.monotonically_increasing_id()), "scored")
    low = counts.where(F.col("c") < (int(words.count.min()) if len(words.count) else 1 << 62))
    tokens, seen = words.tail
    # log10 of (unseen + seen) / unseen, the shares of the mixture; spelled is null where a guess has given the word.
    more = F.log10(F.lit(max(seen, 1e-300) / max(1, tokens)) * F.col("c")) - F.col("spelled")
    gain = F.greatest(more, F.lit(0.0)) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(more)))
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "spelled")).alias("t")).select("row", F.col("t.tail").alias("token"), F.col("t.spelled").alias("spelled"))
    tail = tail.join(low, "token").groupBy("row").agg(F.count(F.lit(1)).alias("found"), F.sum(F.log10(F.col("c") + 1)).alias("logs"), F.sum(gain).alias("gain"))
    out = scored.drop("tail", "spelled").join(tail, "row", "left").withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0)))
    return out.select(
        "doc_id", (bucket_of("doc_id", modulus) == held).alias("held_out"), "n_tokens", (F.col("common") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), "score", (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
