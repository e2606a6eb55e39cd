"""Near-duplicate documents by b-bit MinHash, links confirmed on full shingle sets, components of links."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, temporary, tidy
from .components import connected_components

#: Minima per document, low bits of each kept in the signature, chance that a pair at the threshold shares no band.
MINIMA, KEPT_BITS, MISS = 120, 4, 1e-6
#: Standard deviations below the threshold at which an estimate still leads to a confirmation.
SLACK = 6.0
#: Rows of a bucket that one tile compares with one another or with another tile's.
TILE = 512
#: Members of one hub that a task confirms.
SALT = 2000
PLANES = [f"p{k}_{w}" for k in range(KEPT_BITS) for w in range(2)]


@dataclass(frozen=True)
class Plan:
    """Shingle width, threshold num/den, rows of a band; derived values for all stages."""

    width: int
    num: int
    den: int

    @property
    def rows(self) -> int:
        """The most rows a band may have so that a pair at the threshold is missed with chance MISS at most."""
        j = self.num / self.den
        fit = [r for r in range(1, MINIMA + 1) if MINIMA % r == 0 and (1 - j**r) ** (MINIMA // r) <= MISS]
        return max(fit, default=1)

    @property
    def least_estimate(self) -> float:
        """SLACK deviations of the estimate at the threshold, seen through KEPT_BITS bits, below it."""
        j, chance = self.num / self.den, 2.0**-KEPT_BITS
        c = j + (1 - j) * chance
        return j - SLACK * float(np.sqrt(c * (1 - c) / MINIMA)) / (1 - chance)

    @property
    def most_mismatches(self) -> int:
        chance = 2.0**-KEPT_BITS
        return int(np.floor(MINIMA * (1 - (self.least_estimate * (1 - chance) + chance))))


class WordHashes(dict):
    """64-bit hash of each word, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def forget() -> None:
    """Empty this process's hashes."""
    HASHES.clear()


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence where words are fewer than width."""
    words = text.encode().lower().split()
    h = np.fromiter(map(HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    width = min(width, len(h))
    s = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        s = (s ^ h[i : i + len(s)]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(31)
    return np.unique(s)


def set_key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return d >> 64, d & ((1 << 64) - 1)


def seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20260713)
    return rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64), rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(s: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(s), 8192):
        out = np.minimum(out, ((s[None, lo : lo + 8192] ^ xor[:, None]) * mul[:, None]).min(1))
    return out


def packed(mins: np.ndarray) -> np.ndarray:
    """Bit planes of the low bits of each row of minima: KEPT_BITS * 2 words."""
    out = np.zeros((len(mins), KEPT_BITS * 2), dtype=np.uint64)
    for k in range(KEPT_BITS):
        bits = (mins >> np.uint64(k)) & np.uint64(1)
        for w in range(2):
            part = bits[:, w * 64 : (w + 1) * 64]
            out[:, k * 2 + w] = (part << np.arange(part.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (key of the shingle set), bands array<long>, bit planes; one row per row."""
    rows, bands = plan.rows, MINIMA // plan.rows

    def run(batches):
        xor, mul = seeds()
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [shingles(t or "", plan.width) for t in batch.column(1).to_pylist()]
            mins = np.stack([minima(s, xor, mul) for s in sets])
            keys = np.zeros((len(sets), bands), dtype=np.uint64)
            for b in range(bands):
                k = np.full(len(sets), b + 1, dtype=np.uint64)
                for r in range(rows):
                    k = (k ^ mins[:, b * rows + r]) * np.uint64(0xD6E8FEB86659FD93)
                    k ^= k >> np.uint64(32)
                keys[:, b] = k
            ids = np.array([set_key(s) for s in sets], dtype=np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            planes = packed(mins).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), lists, *[pa.array(np.ascontiguousarray(planes[:, i])) for i in range(planes.shape[1])]],
                ["doc_id", "n_shingles", "k1", "k2", "bands", *PLANES],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run, forget), f"doc_id {kind}, n_shingles long, k1 long, k2 long, bands array<long>, " + ", ".join(f"{p} long" for p in PLANES))


def linked(a: np.ndarray, b: np.ndarray, plan: Plan) -> bool:
    if min(len(a), len(b)) * plan.den < plan.num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * plan.den >= plan.num * (len(a) + len(b) - both)


def _confirm_stars(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """u, v of pairs(hub, node) whose sets pass the threshold. A hub's members are dealt over salts, its own row goes to each."""
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    salts = F.ceil(F.col("n") / SALT).cast("int")
    members = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("node").alias("doc_id"))
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("role"), F.col("hub").alias("doc_id"))
    rows = members.union(hubs).join(texts.select("doc_id", "text"), "doc_id").select("hub", "salt", "role", "doc_id", "text")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "doc_id")

    def run(batches):
        hub, centre = None, None
        for batch in batches:
            found: list[tuple[object, object]] = []
            for h, salt, role, doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if role == 0:
                    hub, centre = (h, salt), shingles(text, plan.width)
                elif hub == (h, salt) and linked(centre, shingles(text, plan.width), plan):
                    found.append((h, doc))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], batch.schema.field(0).type) for k in (0, 1)], ["u", "v"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run, forget), f"u {kind}, v {kind}")


def _confirm_rest(open_rows: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """u, v: links between different components within open_rows(key, band, doc_id, component, n).

    Buckets are cut into tiles of about TILE rows; each pair of tiles meets in one task that gets no more than the two.
    A pair is looked at in the first band its members share only, and only if sizes, components and signatures allow a
    link; components that a task has joined are not compared again.
    """
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rows = open_rows.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    spread = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("a"), F.greatest(o, F.col("own")).alias("b")))
    rows = rows.select("key", "band", "doc_id", "component", "own", F.explode(spread).alias("t")).select("key", "band", "t.a", "t.b", "own", "doc_id", "component")
    rows = rows.join(texts.select("doc_id", "text", "bands", *PLANES), "doc_id").select("key", "a", "b", "own", "band", "doc_id", "component", "text", "bands", *PLANES)
    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "own", "doc_id")

    def compare(group: list[tuple]) -> list[tuple[object, object]]:
        _, a, b, _, band = group[0][:5]
        docs, comps, own = [g[5] for g in group], [g[6] for g in group], np.array([g[3] for g in group])
        codes = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        comp = np.array([codes[c] for c in comps])
        if len(codes) < 2:
            return []
        bands = np.array([g[8] for g in group], dtype=np.int64)
        planes = np.array([g[9:] for g in group], dtype=np.int64).view(np.uint64)
        root, sets, found = list(range(len(codes))), {}, []

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for i in range(len(group)):
            later = slice(i + 1, None)
            ok = comp[later] != comp[i]
            if a != b:
                ok &= own[later] != own[i]
            if not ok.any():
                continue
            off = sum(np.bitwise_count(np.bitwise_or.reduce([planes[later, k * 2 + w] ^ planes[i, k * 2 + w] for k in range(KEPT_BITS)])) for w in range(2))
            ok &= off <= plan.most_mismatches
            if band:  # seen already in an earlier band
                ok &= ~(bands[later, :band] == bands[i, :band]).any(1)
            for j in (np.flatnonzero(ok) + i + 1).tolist():
                x, y = top(comp[i]), top(comp[j])
                if x == y:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = shingles(group[k][7], plan.width)
                if linked(sets[i], sets[j], plan):
                    root[max(x, y)] = min(x, y)
                    found.append((docs[i], docs[j]))
        return found

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            found: list[tuple[object, object]] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and group[0][:3] != row[:3]:
                    found += compare(group)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], batch.schema.field(5).type) for k in (0, 1)], ["u", "v"])
        if group:
            found = compare(group)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], id_type) for k in (0, 1)], ["u", "v"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    return rows.mapInArrow(tidy(run, forget), f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of non-space ASCII-lower-cased bytes; a document's set holds its distinct `width`-word shingles, the
    whole sequence where words are fewer. Documents whose sets satisfy den * |A and B| >= num * |A or B| are linked;
    component_id is the smallest id reachable, kept marks it.

    1. Rows of one shingle set (128-bit key) form a class; only its smallest id goes on.
    2. Bands of full minima give buckets; in each bucket the smallest id is the hub. Hub and member are confirmed on
       full sets where size and collision-corrected b-bit estimate allow a link.
    3. A bucket whose rows lie in one component is done, whatever other links it has. In the others, rows of different
       components are compared tile by tile until none is left, so no link between components is lost.

    Texts without words have an empty set: linked with nothing. Null texts count as empty. Rows with a null id are
    linked with nothing and have a null component_id. Rows that share an id count as one document; should their texts
    differ, each is linked to what either is linked to. An empty table gives an empty result; other columns are not read.
    """
    plan = Plan(width, num, den)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = materialize(signatures(rows, plan), "signatures")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = signed.alias("s").join(classes.alias("c"), (F.col("s.k1") == F.col("c.k1")) & (F.col("s.k2") == F.col("c.k2")) & (F.col("s.doc_id") == F.col("c.rep"))).select("s.*").dropDuplicates(["doc_id"])
    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = materialize(banded.join(shared, "key").select("key", "band", "doc_id", "hub", "n"), "buckets")
    part = buckets.select("doc_id").distinct()
    texts = materialize(reps.join(part, "doc_id", "left_semi").join(rows.where("doc_id IS NOT NULL"), "doc_id").select("doc_id", "text", "n_shingles", "bands", *PLANES).dropDuplicates(["doc_id"]), "texts")

    pairs = buckets.where("doc_id <> hub").select("hub", F.col("doc_id").alias("node")).distinct()
    slim = texts.select("doc_id", "n_shingles", *PLANES)
    a, b = slim.alias("a"), slim.alias("b")
    off = sum(F.bit_count(_any([F.col(f"a.p{k}_{w}").bitwiseXOR(F.col(f"b.p{k}_{w}")) for k in range(KEPT_BITS)])) for w in range(2))
    sized = F.least("a.n_shingles", "b.n_shingles") * den >= F.greatest("a.n_shingles", "b.n_shingles") * num
    likely = pairs.join(a, F.col("hub") == F.col("a.doc_id")).join(b, F.col("node") == F.col("b.doc_id")).where(sized & (off <= plan.most_mismatches)).select("hub", "node")
    stars = materialize(_confirm_stars(materialize(likely, "pairs"), texts, plan), "stars")

    first = connected_components(stars)
    placed = buckets.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = materialize(placed.select("key", "band", "doc_id", "component", "n"), "placed")
    undone = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rest = materialize(_confirm_rest(placed.join(undone, "key"), texts, plan), "rest")

    final = connected_components(stars.union(rest))
    named = classes.join(final, classes["rep"] == final["node"], "left").select("k1", "k2", F.coalesce("component", "rep").alias("root"))
    joined = signed.alias("s").join(named.alias("n"), (F.col("s.k1") == F.col("n.k1")) & (F.col("s.k2") == F.col("n.k2")) & F.col("s.doc_id").isNotNull(), "left")
    out = joined.select("s.doc_id", "s.n_shingles", F.coalesce("n.root", "s.doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _any(columns: list):
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseOR(c)
    return out


def drop_near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document of each component, columns unchanged; rows with a null id stay."""
    gone = near_duplicates(docs, width, num, den, text, doc_id).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")
