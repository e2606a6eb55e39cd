"""Text operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables,
clashing column names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cadenza.llm import bpe, components, exact_dedup, fingerprint, langid, line_dedup, lm_score, near_dedup, packing, quality, substring_dedup
from cadenza.llm.queries import ORACLES, QUERIES, vocabulary

from ..oracle import SF, assert_same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, h int, runs string, component_id long, score double"
WORDS = [f"w{i}" for i in range(400)]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus() -> list[tuple[int, str | None]]:
    """Nulls, empties, copies, near copies, shared passages, a very long text, characters of several bytes."""
    rng = random.Random(7)
    base = [words(rng, rng.randint(30, 200)) for _ in range(30)]
    passage = words(rng, 120)
    texts: list[str | None] = [None, "", "", " ", "x", "ÄÖ ü\n", *base, base[0], base[0], base[3]]
    for k in range(8):
        t = base[5].split()
        t[k * 3] = f"edit{k}"
        texts.append(" ".join(t))
    texts += [f"{words(rng, 20)}é {passage} ü{words(rng, 20)}" for _ in range(5)] + ["é" * 3000, "ab" * 2000, "\n".join(["one line", "two line", "three line", "four"] * 4), "one line\ntwo line\nthree line", words(rng, 20000)]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "keep", 1, "runs", 5, 0.5) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3).cache()


def by_id(df):
    out = {r.doc_id: r for r in df.collect()}
    return out


def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name])


# Exact duplicates


@pytest.mark.parametrize(("keep", "pick"), [("min", min), ("max", max)])
def test_exact_groups(docs, keep, pick):
    groups = defaultdict(list)
    for i, t in corpus():
        groups[t or ""].append(i)
    got = by_id(exact_dedup.exact_groups(docs, keep=keep))
    for i, t in corpus():
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (pick(g), len(g), pick(g) == i, hashlib.sha256((t or "").encode()).hexdigest())
    assert exact_dedup.exact_groups(empty(docs)).count() == 0


def test_exact_groups_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b"), (2, "b"), (None, "b")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert got == [("1", "1", 4, True), ("1", "1", 4, True), ("2", "1", 4, False), ("None", "1", 4, False), ("None", "None", 2, True), ("None", "None", 2, True)]
    assert exact_dedup.drop_exact_duplicates(df).count() == 4


def test_repeated_rows_leave_the_pipeline_once(spark):
    """Equal rows and copies without ids keep one row with its whole text, from the exact stage through to packing."""
    import corpus_pipeline

    rng = random.Random(5)
    twice, nameless, once, named = (words(rng, 120) for _ in range(4))
    docs = frame(spark, [(1, twice), (1, twice), (None, nameless), (None, nameless), (2, once), (None, named), (3, named), (4, None), (4, None), (5, "")])
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SF).cache()
        got = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
        assert got == sorted([("1", twice), ("None", nameless), ("2", once), ("3", named), ("4", "")]), name
    assert exact_dedup.one_of_each_text(empty(docs)).count() == 0
    packed = corpus_pipeline.packed(spark, docs, SF).collect()
    assert {1, 2, 3} <= {r.doc_id for r in packed}


# Fingerprints


def test_next_text_at_any_number_of_ranges(spark):
    rng = random.Random(3)
    rows = [(i * i, words(rng, 5)) for i in range(300)] + [(None, "null id"), (900, "twin")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1]), reverse=True) + [(None, "null id")]
    want = {(a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {(r.doc_id, r.body, r.next_body) for r in fingerprint.with_next_text(df).collect()} == want
    one = spark.createDataFrame([(4, "alone")], "doc_id long, text string")
    assert fingerprint.with_next_text(one).first().next_body == "alone"
    assert fingerprint.edited_likeness(one.limit(0)).count() == 0


def test_fingerprint_equality_and_edits(spark):
    a = spark.createDataFrame([(1, "One. Two.\n\nThree."), (2, None), (3, "x" * 50000)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "One. Two.\n\nThree!"), (2, ""), (3, "x" * 50000)], "doc_id long, text string")
    fa, fb = by_id(fingerprint.merkle_fingerprints(a)), by_id(fingerprint.merkle_fingerprints(b))
    assert fa[1].fingerprint != fb[1].fingerprint and fa[2].fingerprint == fb[2].fingerprint and fa[3].fingerprint == fb[3].fingerprint
    spots = fingerprint.differing_paragraphs(fingerprint.merkle_fingerprints(a), fingerprint.merkle_fingerprints(b)).collect()
    assert [(r.doc_id, r.paragraphs) for r in spots] == [(1, [2])]


# Lines


def brute_lines(rows, width=3):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - width + 1):
            w = tuple(lines[p : p + width])
            if w in seen:
                gone.update(range(p, p + width))
            seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_windows(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))) for i in range(80)] + [(90, None), (91, "\n".join("pqrs" * 300))]
    got = by_id(line_dedup.dedup_lines(frame(spark, rows)))
    want = brute_lines(rows)
    assert {i: r.kept_text for i, r in got.items()} == want
    assert all(r.n_lines - r.n_removed == len(want[i].split("\n")) or not want[i] for i, r in got.items())
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


# Language


def test_codewords_differ_in_many_bits():
    for k in (2, 3, 4, 7, 12):
        m = langid.codewords(k)
        d = [(m[i] != m[j]).sum() for i in range(k) for j in range(i)]
        assert min(d) >= (2 ** (k - 2) if k <= 7 else 8)


def test_languages(spark):
    rng = random.Random(2)
    sets = {"aa": "the and of with from this".split(), "bb": "der und mit nicht eine ist".split(), "cc": "les dans pour une avec est".split()}
    rows = [(i, " ".join(rng.choice(sets[lang]) for _ in range(30)), lang if i % 5 else None) for i in range(300) for lang in [rng.choice(list(sets))]]
    truth = {i: next(k for k, v in sets.items() if t.split()[0] in v) for i, t, _ in rows}
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (1003, "der " * 40000, None)]
    got = by_id(langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i].lang_pred == k for i, k in truth.items())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    nothing = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify_languages(nothing).collect()] == ["und"]
    assert langid.identify_languages(nothing.limit(0)).count() == 0


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in QUERIES["op1_language_id"](spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


# Quality


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op4_quality"](spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = by_id(quality.score_quality(docs, none))
    assert len(got) == docs.count() and {r.score for r in got.values()} == {0.5}
    assert quality.score_quality(empty(docs), none).count() == 0
    assert quality.keep_good(docs, none).columns == docs.columns


@pytest.mark.parametrize("few", [0, 1, 5, 29])
@pytest.mark.parametrize("thin", [0, 1])
def test_thin_bands_tell_classes_apart(spark, few, thin):
    """A band with few or no rows of a class, whichever it is, borrows from the others."""
    rng = np.random.default_rng(4)
    d = len(quality.FEATURES)
    draw = lambda label, band, n: rng.standard_normal((n, d)) + label * 1.5 + band * 3
    sizes = {(1, 0): 200, (1, 1): 300, (0, thin): few, (0, 1 - thin): 120}
    rows = [(v.tolist(), b, k) for (b, k), n in sizes.items() for v in draw(k, b, n)]
    model = quality.fit(spark.createDataFrame(rows, "features array<double>, band int, label int"))
    for band in (0, 1) if few else (1,):
        for label in (0, 1):
            right = (model[band].log_odds(draw(label, band, 300)) > 0) == bool(label)
            assert right.mean() > 0.9, (band, label, right.mean())
    assert all(len(set(np.round(m.log_odds(draw(1, 0, 9)), 9))) == 9 for m in model)


def test_discriminant_is_the_gaussian_one(spark):
    rng = np.random.default_rng(1)
    d = len(quality.FEATURES)
    x = np.vstack([rng.standard_normal((400, d)), rng.standard_normal((300, d)) * 1.5 + 0.7])
    y = np.repeat([0, 1], [400, 300])
    rows = spark.createDataFrame([(v.tolist(), 0, int(k)) for v, k in zip(x, y, strict=True)], "features array<double>, band int, label int")
    model = quality.fit(rows)[0]
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -quality.CLIP, quality.CLIP)
    pooled, want = np.cov(z.T, bias=True), []
    for k in (0, 1):
        a = z[y == k]
        s = np.cov(a.T, bias=True)
        c = (1 - quality.SHRINK) * s + quality.SHRINK * (quality.POOLED * pooled + (1 - quality.POOLED) * np.trace(s) / d * np.eye(d)) + 1e-6 * np.eye(d)
        u = z - a.mean(0)
        want.append(-0.5 * np.einsum("ij,jk,ik->i", u, np.linalg.inv(c), u) - 0.5 * np.linalg.slogdet(c)[1] + math.log(len(a)))
    assert np.allclose(model.log_odds(x), want[1] - want[0])


# Repeated strings


@pytest.mark.parametrize("length", [20, 60, 400])
@pytest.mark.parametrize("tile", [1024, 2])
def test_repeated_strings(docs, monkeypatch, length, tile):
    monkeypatch.setattr(substring_dedup, "TILE", tile)
    want = substring_dedup.brute_force(dict(corpus()), length)
    got = by_id(substring_dedup.remove_repeated_strings(docs, length))
    assert {i: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for i, r in got.items()} == want


def test_repeated_strings_edges(spark, docs):
    assert substring_dedup.remove_repeated_strings(empty(docs), 400).count() == 0
    t = "".join(random.Random(1).choice("abcdefgh ") for _ in range(900))
    df = spark.createDataFrame([(1, t), (1, t), (2, "short"), (2, t[:300] + "!" + t[300:]), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in substring_dedup.remove_repeated_strings(df, 400).collect())
    assert got == [("1", 900, 900), ("1", 900, 900), ("2", 5, 0), ("2", 901, 600), ("None", 0, 0)]
    out = substring_dedup.without_repeated_passages(docs, 60)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_corpus_order_is_the_order_of_the_strings():
    """Ranks of phrase suffixes and of parses, combined, sort all starts of several texts as their bytes do."""
    rng, length = random.Random(4), 400
    passage = "".join(rng.choice("abc ") for _ in range(700))
    raws = [("".join(rng.choice("abc ") for _ in range(rng.randint(300, 900))) + (passage if i % 2 else "") + "z" * i).encode() for i in range(8)]
    p = substring_dedup.parse(raws, length)
    entries = [raws[d][a : a + n + length - 1] for d, a, n in zip(p["doc"], p["first"], p["n"], strict=True)]
    assert p["n"].sum() == sum(max(0, len(r) - length + 1) for r in raws) and p["lead"].max() < substring_dedup.window_of(length)
    owner, offset, common, _ = substring_dedup.corpus_order(entries, p["lead"], p["n"])
    # Where no hash trigger is near, a phrase ends at the smallest hash and order is by phrases only.
    marked = [(substring_dedup.mixed(substring_dedup.grams(np.frombuffer(e[a : a + 8], dtype=np.uint8)))[0] >> np.uint64(40)) < (1 << 24) // substring_dedup.PERIOD for e, a in zip(entries, p["lead"], strict=True)]
    strings = [entries[e][o : o + length] for e, o in zip(owner, offset, strict=True) if marked[e]]
    assert 0 < len(strings) and strings == sorted(strings)
    for k in range(1, len(owner)):
        if common[k] >= 0:
            a, b = entries[owner[k - 1]][offset[k - 1] :], entries[owner[k]][offset[k] :]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_phrase_suffix_ranks():
    rng = random.Random(6)
    phrases = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [b"", b"a" * 100]
    ranks, begin = substring_dedup.phrase_suffix_ranks(phrases)
    suffixes = [(p[i:], ranks[b + i]) for p, b in zip(phrases, begin.tolist(), strict=True) for i in range(len(p) + 1)]
    order = {x: k for k, x in enumerate(sorted({x for x, _ in suffixes}))}
    assert [r for _, r in suffixes] == [order[x] + 1 for x, _ in suffixes]


def test_wide_groups_of_near_copies(spark, monkeypatch):
    """Many copies with one edit each: rows that part wide groups follow copies, results stay whole."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(i, base[: (p := rng.randrange(900))] + "#%d#" % i + base[p:]) for i in range(60)]
    monkeypatch.setattr(substring_dedup, "TILE", 4)
    want = substring_dedup.brute_force(dict(rows), 400)
    got = by_id(substring_dedup.remove_repeated_strings(frame(spark, rows), 400))
    assert {i: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for i, r in got.items()} == want


# BPE


TRICKY = ["", " ", "a", "aaaaaaaaaaa", "It's we'LL they're N'T", "<|endoftext|>x<|startoftext|><|ENDOFTEXT|>", "é é Σίσυφος ΑΣ İ ß", "a\x1cb\x1fc\x85d\xa0e　f​g", "12345 ²½ Ⅷ", "中文字 한국어 कि", "😀👩‍👩‍👧", "x" * 3000, "aba" * 500, "\n\t\r\x0b\x0c mixed", "\0\x7f"]


def test_bpe_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    rng = random.Random(4)
    pieces = [p for t in TRICKY for p in (t[:6], t[-4:]) if p]
    texts = [*TRICKY, None, *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    full, digest = by_id(bpe.encode_documents(docs, vocabulary())), by_id(bpe.encoding_digests(docs, vocabulary()))
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        shown = lib.decode(ids, skip_special_tokens=False)
        assert full[i].ids == ids and full[i].decoded == shown, repr(t)
        assert (digest[i].n_tokens, digest[i].ids_sha256, digest[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
    assert bpe.encode_documents(docs.limit(0), vocabulary()).count() == 0


def test_only_what_the_text_holds_is_a_special_token(spark):
    """Upper-case look-alikes are words, also beside real special tokens."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|>, b <|endoftext|> c", "x<|StartOfText|><|endoftext|><|ENDOFTEXT|>", "<|endoftext|>\u0338 <|ENDOFTEXT|>\u0338", "a\x1c<|EndOfText|>\n<|endoftext|>", "< |endoftext|> <|", "<|EndOfText|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    full, digest = by_id(bpe.encode_documents(docs, vocabulary())), by_id(bpe.encoding_digests(docs, vocabulary()))
    tokens = by_id(packing.tokenized(docs, vocabulary(), 2))
    for i, t in enumerate(texts):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert full[i].ids == ids == np.frombuffer(tokens[i].ids, dtype="<u2")[:-1].tolist(), repr(t)
        assert digest[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_new_words_of_several_cuts_are_encoded_together(monkeypatch):
    """One sweep of the pair index serves all cuts, also where the cache begins anew; ids are the library's, text by text."""
    from tokenizers import Tokenizer

    lib, real, sweeps = Tokenizer.from_file(vocabulary()), bpe.WordBPE.merged, []
    monkeypatch.setattr(bpe.WordBPE, "merged", lambda self, flat, ends: sweeps.append(len(ends)) or real(self, flat, ends))
    monkeypatch.setattr(bpe, "CACHE", 3)
    cache = bpe.ChunkIds(bpe.WordBPE(vocabulary()))
    for k in range(3):
        runs = [TRICKY[k::4], ["", " "], [f"anew{c} again{k}, <|endoftext|>{c}" for c in "xyz"], TRICKY[k + 1 :: 4], TRICKY[k + 1 :: 4]]
        cuts = [cache.cut(r) for r in runs]
        got = list(cache.encode_all(cuts))
        assert len(sweeps) == k + 1 and not cuts and len(got) == len(runs)
        for texts, (ids, offsets) in zip(runs, got, strict=True):
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


# Packing


def test_packing_partitions_every_document(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for i, t in corpus()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs, vocabulary(), length=256).collect():
        want = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == want and r.ids_crc32 == zlib.crc32(np.array(want, dtype="<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for parts, total in [*((p, len(ids[i])) for i, p in pieces.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == total if total is not None else at <= 256 and at & (at - 1) == 0
    assert packing.pack_documents(empty(docs), vocabulary()).count() == 0


def test_ranges_hold_as_many_tokens_each(spark, monkeypatch):
    """Copies at one place of the curve, long and short documents: no range is far over its share, none loses rows."""
    monkeypatch.setattr(packing, "RANGE_TOKENS", 2000)
    monkeypatch.setattr(packing, "WEIGHED", 4)
    rng = random.Random(2)
    rows = [(i, 77, 50, False, b"") for i in range(500)] + [(1000 + i, rng.randrange(1 << 48), rng.choice([1, 300]), False, b"") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, curve long, tokens long, wide boolean, ids binary")
    tokens = {r[0]: r[2] for r in rows}
    parts = packing.along_the_curve(df).rdd.mapPartitions(lambda it: [[r.doc_id for r in it]]).collect()
    assert sorted(i for p in parts for i in p) == sorted(tokens)
    assert max(sum(tokens[i] for i in p) for p in parts) < 2 * 2000
    curve = {r[0]: r[1] for r in rows}
    flat = [curve[i] for p in parts for i in p]
    assert flat == sorted(flat)


def test_texts_come_to_the_tokenizer_in_small_batches(spark, monkeypatch):
    """A worker's memory follows BATCH_BYTES, not 10,000 rows of any length; all rows come, the setting goes back."""
    import pyarrow as pa

    key, before, real, seen = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), packing.materialize, []
    df = spark.createDataFrame([(i, "ab cd " * 700) for i in range(3000)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    def probe(done, tag):
        if tag == "tokens":
            seen.extend(df.mapInArrow(sizes, "n long, size long").collect())
        return real(done, tag)

    monkeypatch.setattr(packing, "materialize", probe)
    pieces = packing.pack_documents(df, vocabulary(), with_ids=False)
    total = {r.doc_id: (r.n, r.t) for r in pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "n", "t").collect()}
    assert len(total) == 3000 and all(n == t for n, t in total.values())
    assert sum(r.n for r in seen) == 3000 and max(r.size for r in seen) < packing.BATCH_BYTES + 10_000
    assert spark.conf.get(key) == before


def test_batches_whose_words_are_looked_up_together(spark, docs, monkeypatch):
    """Rows keep their ids, curve and token count however many batches wait for their words."""
    rows = docs.repartition(1)
    keyed = lambda: sorted((r.doc_id, r.curve, r.tokens, bytes(r.ids)) for r in packing.tokenized(rows, vocabulary(), 2).collect())
    want = keyed()
    assert len(want) == docs.count()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for most in (1, 500, 8_000_000):
            monkeypatch.setattr(packing, "LEARNED", most)
            assert keyed() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hilbert_curve_is_a_path():
    side = np.arange(8)
    cells = np.stack([g.ravel() for g in np.meshgrid(side, side, side, indexing="ij")], axis=1)
    order = cells[np.argsort(packing.hilbert_keys(cells, 3))]
    assert len(set(packing.hilbert_keys(cells, 3).tolist())) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# Near duplicates


def brute_components(rows, width, num, den):
    sets, first = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()
        first[i] = i

    def top(x):
        while first[x] != x:
            x = first[x]
        return x

    ids = list(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                first[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


@pytest.mark.parametrize(("width", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, width, num):
    got = by_id(near_dedup.near_duplicates(docs, width, num, 100))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == brute_components(corpus(), width, num, 100)


def test_near_duplicate_chains_and_tiles(spark, monkeypatch):
    """A chain whose ends are unlike, in buckets larger than a tile."""
    monkeypatch.setattr(near_dedup, "TILE", 3)
    monkeypatch.setattr(near_dedup, "SALT", 2)
    rng = random.Random(9)
    rows, t = [], [rng.choice(WORDS) for _ in range(150)]
    for i in range(40):
        rows.append((100 - i, " ".join(t)))
        t[rng.randrange(150)] = f"n{i}"
        if i % 7 == 0:
            t[rng.randrange(150)] = f"m{i}"
    got = by_id(near_dedup.near_duplicates(frame(spark, rows), 3, 85, 100))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == brute_components(rows, 3, 85, 100)


def test_near_duplicates_edges(spark, docs):
    assert near_dedup.near_duplicates(empty(docs)).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (7, None), (8, "A  B\tc d")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_duplicates(df, 3, 85, 100).collect())
    assert got == [("3", "3", True), ("3", "3", True), ("7", "7", True), ("8", "3", False), ("None", "None", True)]


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(0)
    xor, mul = near_dedup.seeds()
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    p = near_dedup.packed(np.stack([near_dedup.minima(s, xor, mul) for s in (a, b)]))
    off = sum(int(np.bitwise_count(np.bitwise_or.reduce([p[0, k * 2 + w] ^ p[1, k * 2 + w] for k in range(4)]))) for w in range(2))
    match = 1 - off / near_dedup.MINIMA
    assert abs((match - 1 / 16) / (15 / 16) - 1 / 3) < 0.2


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    edges = [(a, b) for a, b in edges if a != b]
    first = {n: n for e in edges for n in e}

    def top(x):
        while first[x] != x:
            x = first[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        first[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == {n: top(n) for n in first}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# Language model


def test_lm_counts_and_base_score(spark, docs):
    rows = corpus()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = by_id(lm_score.score_texts(docs))
    for i, t in rows:
        ts, r = tokens(t), got[i]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ts), sum(counts[x] > 0 for x in ts), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    assert lm_score.score_texts(empty(docs)).count() == 0


def test_lm_tail_counts_come_by_join(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "COMMON", 3)
    monkeypatch.setattr(lm_score.common_words, "__defaults__", (3,))
    rows = [(i, "a a a b b c " + f"r{i % 4} s{i}") for i in range(40)]
    counts = Counter(x for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for x in [*t.encode().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    for r in lm_score.score_texts(frame(spark, rows)).collect():
        ts = [*rows[r.doc_id][1].encode().split(), b"\n"]
        assert r.n_known == sum(counts[x] > 0 for x in ts)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts), rel_tol=1e-9)


def test_lm_rare_training_words_have_their_own_cost(spark, monkeypatch):
    """Past the common vocabulary costs follow counts: a word seen a hundred times as often costs about a hundredth, however long the
    words are to spell."""
    monkeypatch.setattr(lm_score.common_words, "__defaults__", (3,))
    rng = random.Random(3)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    others = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200)) for _ in range(100)]
    rows = [(i, "a a b b " + ("qzxwvk" if i % 2 else others[i // 2 % 100] if i else "u" * 3000)) for i in range(400) if i not in held]
    seen = Counter(t.split()[-1] for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)
    twice = min(w for w, c in seen.items() if c == 2)
    got = by_id(lm_score.score_texts(frame(spark, [*rows, (held[0], "a b qzxwvk"), (held[1], f"a b {twice}")])))
    assert (got[held[0]].n_known, got[held[1]].n_known) == (4, 4) and all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    gap = got[held[0]].score - got[held[1]].score
    assert abs(gap - math.log10(seen["qzxwvk"] / 2)) < 0.5, gap
    for i in held:
        assert math.isclose(got[i].bits_per_byte, -got[i].score / math.log10(2) / (10 if i == held[0] else 204), rel_tol=1e-9)


def test_lm_tail_words_share_what_spelling_leaves(spark):
    counts = spark.createDataFrame([(b"a", 9), (b"b", 8), (b"c", 3), (b"d", 2), (b"e", 1), (b"f", 1)], "token binary, c long")
    v = lm_score.common_words(counts, 2)
    assert len(v.number) == 2 and v.tail == (7, (15 - 2 + 0.5) / 16)
    assert lm_score.common_words(counts).tail == (0, 0.0) and lm_score.common_words(counts.limit(0)).tail == (0, 0.0)


def test_spelling_is_a_distribution():
    """All bytes after any prefix have probabilities that add up to one before rounding."""
    start = np.tile(np.array([0.25, 0.3, 0.3, 0.3, 0.0]), (64, 1))
    rng = np.random.default_rng(2)
    speller = lm_score.Speller(lm_score.pack_tables([rng.random((2, n)) * 9 for n in lm_score.ORDER_SLOTS]), start, np.linspace(0.01, 0.99, 33))
    curve, total = speller.curve(), 0.0
    for b in range(256):
        owner, slots, bit = lm_score.spelled_bits([b"th" + bytes([b])])
        p = curve[speller.bucket(speller.mixed(slots)[0])][16:24]
        total += float(np.prod(np.where(bit[16:24] == 1, p, 1 - p)))
    assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_spelling_has_an_order_of_one_byte():
    """The shortest context is the byte before alone, the longest the last five."""
    _, slots, _ = lm_score.spelled_bits([b"xabcde", b"yzbcde"])
    slots = slots.reshape(len(slots), -1, 8)
    assert len(slots) == 5 and (slots[0, 3] == slots[0, 10]).all() and (slots[1, 2] != slots[1, 9]).any()
    assert [(slots[k, 5] == slots[k, 12]).all() for k in range(5)] == [True, True, True, False, False]


def test_last_followers():
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 9, 1])
    doc = np.array([0, 0, 0, 0, 0, 0, 0, 0, 1, 1])
    two, one = lm_score.last_followers(ids, doc)
    assert one.tolist() == [-1, -1, -1, -1, 2, 3, -1, 2, -1, -1]
    assert two.tolist() == [-1, -1, -1, -1, -1, 3, -1, -1, -1, -1]


# Pipeline


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "suffix_array_dedup", "packing"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = source, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == source.columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    good, exact, near, cut = seen
    bad = {r.doc_id for r in quality.score_quality(source, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0").collect()}
    texts = {r.doc_id: r.text for r in source.collect()}
    assert set(good) == set(texts) - bad
    first = {}
    for i in sorted(good):
        first.setdefault(good[i], i)
    assert set(exact) == set(first.values())
    assert set(near) == {i for i, c in brute_components(list(exact.items()), 5, 80, 100).items() if c[2]}
    want = substring_dedup.brute_force(near, corpus_pipeline.PASSAGE_BYTES)
    assert set(cut) == set(near) and all(len(cut[i].encode()) - (want[i][0] - want[i][1]) in range(0, 7 * max(1, want[i][2])) for i in cut)
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == set(cut)


# Model of whole words and shared tables


def test_words_agree_with_bytes_split():
    """Arrow's words are those of bytes, also of slices of a longer column."""
    import pyarrow as pa

    rng = random.Random(9)
    texts = [None, "", " a\tB\x0bC\x0c\r\n", "É É x \x1c y"] + ["".join(rng.choice("abC é\t\n ") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    column = pa.array(["front"] * 7 + texts + ["back"] * 3).slice(7, len(texts))
    words, index, counts = lm_score.split_words(column)
    at = np.concatenate(([0], np.cumsum(counts)))
    got = [[words[k] for k in index[a:b]] for a, b in zip(at, at[1:])]
    assert got == [(t or "").encode().lower().split() for t in texts]


def test_balanced_code_makes_up_the_share():
    """Shares of the nodes on a word's way and what they leave multiply to its share, whatever the number of bits."""
    rng = random.Random(4)
    words = sorted({words_of(rng, 2).encode() for _ in range(300)}, key=lambda w: hashlib.md5(w).digest())
    count = np.array([rng.randint(1, 1000) for _ in words])
    for most in (0, 3, 8, 40):
        begin, node, bit, stretched, rest = lm_score.balanced_code(words, count, most)
        total = rest.copy()
        for w in range(len(words)):
            p = 1 / (1 + np.exp(-stretched[node[begin[w] : begin[w + 1]]].astype(float)))
            total[w] += np.log10(np.where(bit[begin[w] : begin[w + 1]] == 1, p, 1 - p)).sum()
        assert np.allclose(total, np.log10(count / count.sum()), atol=1e-5) and np.diff(begin).max(initial=0) <= most
    assert len(lm_score.balanced_code([], np.zeros(0, dtype=int))[0]) == 1 and lm_score.balanced_code([b"a"], np.array([3]))[4].tolist() == [0.0]


def words_of(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_lm_knows_what_it_has_learned(spark):
    """A held-out copy of a training text scores above a held-out text of the same words in other order, and whole held-out
    documents of the test tables above the unigram score where most words are known."""
    rng = random.Random(12)
    vocabulary = [words_of(rng, 1) for _ in range(200)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(120))
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, text()) for i in range(500) if i not in held]
    copy, mixed = rows[0][1], rows[0][1].split()
    rng.shuffle(mixed)
    got = by_id(lm_score.score_texts(frame(spark, [*rows, (held[0], copy), (held[1], " ".join(mixed))])))
    assert got[held[0]].score > got[held[1]].score + 5, (got[held[0]].score, got[held[1]].score)


def test_lm_spelling_is_priced_once():
    """Words cost what their bits cost one by one, though a byte after the same five bytes is priced only once."""
    rng = np.random.default_rng(5)
    speller = lm_score.Speller(lm_score.pack_tables([rng.random((2, n)) * 9 for n in lm_score.ORDER_SLOTS]), rng.random((64, 6)), np.linspace(0.01, 0.99, 33))
    words = [f"{a}common{b:02d}".encode() for a in "abcd" for b in range(50)] + [b"", b"x" * 9000, "\u00e4\u4e2d".encode()]
    priced, price = [], speller.price
    speller.price = lambda logs, slots, bit: priced.append(len(bit)) or price(logs, slots, bit)
    got = speller.cost(words)
    owner, slots, bit = lm_score.spelled_bits(words)
    assert np.allclose(got, np.bincount(owner, weights=price(speller.logs(), slots, bit)), rtol=1e-12)
    assert sum(priced) < len(bit) / 8 and len(speller.cost([])) == 0


def test_lm_numbers_do_not_depend_on_lookups(monkeypatch):
    """Portions of texts have the same words and ends, however many are looked up at a time."""
    import pyarrow as pa

    rng = random.Random(6)
    texts = [None, "", *[words(rng, rng.randint(0, 60)) for _ in range(40)], "w1 " * 300]
    column = pa.array(["front", *texts]).slice(1)
    for known in ([b"w1", b"\n", b"w2"], [b"w7"], []):
        v = lm_score.Vocabulary(pa.array(known, pa.large_binary()), *[None] * 8)
        runs = []
        for most in (1, 1000, 10**6):
            monkeypatch.setattr(lm_score, "NUMBERED", most)
            got, cut = [], []
            for rare, parts in lm_score.numbered(column, v, 400):
                names = [*known, *rare.to_pylist()]
                for lo, hi, p in parts:
                    cut.append((lo, hi))
                    assert (p.common == (p.ids < len(known))).all() and (p.begin == (np.cumsum(p.sizes) - p.sizes)[p.doc]).all()
                    got += [[names[i] for i in p.ids[p.doc == k]] for k in range(hi - lo)]
            assert got == [[*(t or "").encode().split(), b"\n"] for t in texts]
            runs.append(cut)
        assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 10
    assert list(lm_score.numbered(column.slice(0, 0), v)) == []


@pytest.mark.parametrize("weighted", [False, True])
def test_lm_learner_counts_every_bit(monkeypatch, weighted):
    """Counts are those of all bits, with nothing of a block kept but its tally."""
    monkeypatch.setattr(lm_score, "HELD", 500)
    rng = np.random.default_rng(8)
    learner = lm_score.Learner((16, 32, 16), np.tile(np.array([0.3, 0.3, 0.3, 0.0]), (64, 1)))
    want = [np.zeros((2, 16)), np.zeros((2, 32)), np.zeros((2, 16))]
    for n in (0, 1, 400, 700, 33_000):
        slots, bit, weight = [rng.integers(0, t.shape[1], n) for t in want], rng.integers(0, 2, n).astype(np.uint8), rng.random(n) if weighted else None
        learner.learn(slots, bit, weight)
        for t, s in zip(want, slots):
            np.add.at(t, (bit.astype(int), s), 1 if weight is None else weight)
    held = sum(t.nbytes for t in learner.tally)
    learner.refresh()
    assert held <= 8 * 2 * (16 + 32 + 16) and all(np.allclose(a, b, rtol=1e-6) for a, b in zip(learner.counts, want))
    assert weighted or all((a == b).all() for a, b in zip(learner.counts, want))


def test_temporary_tables_are_deleted(spark):
    import os

    from cadenza.llm import common

    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with common.temporary(spark):
        common.materialize(spark.range(3), "gone")
        kept = common.materialize(spark.range(5), "kept", outlive=True)
    assert kept.count() == 5 and {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"kept"}
    with common.temporary(spark), common.temporary(spark):
        common.materialize(spark.range(2), "kept2", outlive=True)
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"kept"}


def test_shared_folder_must_be_named_on_several_machines(spark, monkeypatch):
    from types import SimpleNamespace

    from cadenza.llm import common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


def test_workers_keep_nothing_between_tasks():
    """A task's caches are empty and its memory given back when it ends, also when it fails."""
    from cadenza.llm.common import tidy

    kept = {"a": 1}

    def run(batches):
        yield from batches
        raise KeyError("task fails")

    with pytest.raises(KeyError):
        list(tidy(run, kept.clear)([1, 2]))
    assert not kept
    near_dedup.shingles("some words here", 2)
    assert near_dedup.HASHES
    near_dedup.forget()
    assert not near_dedup.HASHES
