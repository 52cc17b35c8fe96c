"""Suffix dedup, chunk fingerprints, SimHash, packing, quality: brute force and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorespark.llm import chunk_fingerprint as cf
from lorespark.llm import components as cc
from lorespark.llm import kernels, packing, quality, simhash
from lorespark.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string"
CLASH = "doc_id long, text string, span string, fp string, _tag string, _rest string, n_chars long, source string, lang string, score double, mix_slot int"


def words_doc(rnd, n, vocabulary=400):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) if vocabulary is None else f"w{rnd.randint(0, vocabulary)}" for _ in range(n))


def brute_suffix(docs, length=50):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < d:
                    gone[i : i + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_is_brute_force(spark, seed):
    rnd = random.Random(seed)
    letters = "abcdé"
    passages = ["".join(rnd.choice(letters) for _ in range(rnd.choice([40, 50, 51, 90, 300]))) for _ in range(10)]
    docs = [(None, passages[0] * 3), (5, None), (6, ""), (7, "a" * 400), (8, "a" * 300)]
    for i in range(110):
        t = ""
        for _ in range(rnd.randint(0, 5)):
            p, cut = rnd.choice(passages), rnd.randint(0, 60)
            t += rnd.choice([p, p[cut:], p[:cut], "".join(rnd.choice(letters) for _ in range(cut))])
        docs.append((rnd.choice([i, i, i, 3]) - 20, t))  # some ids repeat, some are negative
    docs.append(docs[-1])
    got = sd.dedup_digests(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    same(got, brute_suffix(docs))


def test_suffix_dedup_hot_passage(spark):
    rnd = random.Random(3)
    shared = words_doc(rnd, 40)
    docs = [(i, (shared if i % 3 == 0 else "") + words_doc(rnd, 15, None)) for i in range(300)]
    same(sd.dedup_digests(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect(), brute_suffix(docs))


def test_suffix_dedup_real_rows(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(sd.op1_suffix_dedup(spark, sf).select(*[x.split(" ")[0] for x in sd.OUT.split(", ")]).collect(), brute_suffix(docs))


def test_dedup_texts_keeps_columns(spark):
    a = "é" * 60 + "tail one"
    rows = [(1, a, "s", "f", "t", "r", len(a), "src", "en", 0.5, 3), (2, "x" + a, "s", "f", "t", "r", 0, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    out = sd.dedup_texts(spark.createDataFrame(rows, CLASH))
    assert out.columns == [c.split(" ")[0] for c in CLASH.split(", ")]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == a and got[1].span == "s" and got[2].text == "x" and got[2].n_chars == 1 and got[None].text is None
    assert sd.dedup_texts(spark.createDataFrame([], CLASH)).count() == 0


def test_suffix_dedup_with_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 20)
    for seed in (1, 5):
        test_suffix_dedup_is_brute_force(spark, seed)
    test_suffix_dedup_hot_passage(spark)
    # one gram in many documents, in surroundings of their own and shared ones
    rnd = random.Random(6)
    letters = "abcdefghijklmnop"
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    gram, sides = "THE-COMMON-GRAM-OF-ALL", [word(40) for _ in range(9)]
    docs = [(i, rnd.choice([word(40), rnd.choice(sides)]) + gram + rnd.choice([word(40), rnd.choice(sides)])) for i in range(200)]
    same(sd.dedup_digests(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect(), brute_suffix(docs))


def test_suffix_dedup_of_patterns(spark):
    rnd = random.Random(8)
    docs = [(k, "".join(rnd.choice(["a" * rnd.randint(1, 300), "ab" * rnd.randint(1, 90), "abcdefg" * rnd.randint(1, 40), "x" * 31 + "y", "z"]) for _ in range(6))) for k in range(60)]
    same(sd.dedup_digests(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect(), brute_suffix(docs))


def test_long_runs_are_few_records():
    text = np.frombuffer(b"a" * (3 << 20), np.uint8)
    h, owner, pos, run = sd.anchors(text, np.array([0]), np.array([len(text)]))
    assert len(h) < 100 and int(sd._times(run).sum()) == len(text) - 19
    got = [p for _, p in sd._positions(np.array([5, 100, -7, 4, 200]), np.zeros(5, np.int64), 3)]
    assert np.concatenate(got).tolist() == [5, 100, 107, 114, 121, 200]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_longest_previous_factors(seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 25))) for _ in range(12)]
    suffixes = sorted((t[i:], d) for d, t in enumerate(texts) for i in range(len(t)))
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    common = np.array([0] + [shared(a, b) for (a, _), (b, _) in zip(suffixes, suffixes[1:])])
    rank = np.array([d for _, d in suffixes])
    want = [max((shared(s, t) for t, e in suffixes if e < d), default=0) for s, d in suffixes]
    assert sd.longest_previous_factors(rank, common).tolist() == want
    some = sd.longest_previous_factors(rank, common, 4)
    assert ((some >= 4) == (np.array(want) >= 4)).all() and (some[some >= 4] == np.array(want)[some >= 4]).all()
    near, share = sd.nearest_smaller(rank, common)
    for i, (n, c) in enumerate(zip(near, share)):
        before = [j for j in range(i) if rank[j] < rank[i]]
        assert n == (before[-1] if before else -1) and c == (shared(suffixes[n][0], suffixes[i][0]) if before else 0)


def test_packed_columns():
    cols = [np.array([0, 1, 2**40]), np.array([-3, 5, 2**62])]
    data = sd.squeeze(sd.pack_columns(cols[0], sd.delta(cols[1])) + b"tail")
    (a, b), used = sd.unpack_columns(sd.expand(data), 2)
    assert a.tolist() == cols[0].tolist() and sd.undelta(b).tolist() == cols[1].tolist() and sd.expand(data)[used:] == b"tail"


# -- SimHash --------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    low = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(ids, prints):
    f = np.array(prints, np.uint64)
    link = np.bitwise_count(f[:, None] ^ f[None]) <= 2
    comp = np.array(ids)
    while True:
        new = np.where(link, comp[None], 1 << 60).min(1)
        if (new == comp).all():
            return link.sum(1) - 1, comp
        comp = new


def test_simhash_is_brute_force(spark):
    rnd = random.Random(4)
    docs, base = [], [words_doc(rnd, 300) for _ in range(6)]
    for i in range(120):
        w = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            w[rnd.randrange(len(w))] = "Changed"
        docs.append((i, "  \t".join(w)))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "One two"), (205, "x" * 5000 + " y z " + "q" * 70)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    prints = [brute_fingerprint(t) for _, t in docs]
    near, comp = brute_groups([d for d, _ in docs], prints)
    for (d, _), p, n, c in zip(docs, prints, near, comp):
        assert got[d][1:] == (f"{p:016x}", n, c), d


def test_simhash_edges(spark):
    empty = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "other words here now")], SCHEMA)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_near, r.component_id) for r in got) == [(-1, 0, None), (1, 1, 1), (1, 1, 1), (2, 0, 2)]
    kept = simhash.keep_one(spark.createDataFrame([(1, "a b c", "p"), (2, "a b c", "q"), (1, "a b c", "p"), (None, "a b c", "r")], SCHEMA + ", _drop string"))
    assert sorted((r.doc_id or 0, r["_drop"]) for r in kept.collect()) == [(0, "r"), (1, "p")]


def test_keep_one_goes_by_row(spark):
    rnd = random.Random(11)
    a, b, c = (words_doc(rnd, 200, None) for _ in range(3))
    rows = [(3, a), (7, a), (7, b), (5, b), (9, c), (9, ""), (9, "lone words of another kind here"), (None, a)]
    rows += [(20, t) for t in (words_doc(rnd, 60, None) for _ in range(30))] + [(21, "Case  folds"), (21, "case folds")]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = [r for r in rows if r not in [(7, a), (7, b), (21, "case folds")]]
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((d or 0, t) for d, t in want)


def test_gray_index_and_split_groups(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([centres[rng.integers(0, 40, 3000)] ^ sum((np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) * rng.integers(0, 2, 3000).astype(np.uint64) for _ in range(3))]))
    group = np.zeros(len(fp), np.int64)
    got = {tuple(sorted(p)) for a, b in simhash.near_pairs(fp, group, chunk=500) for p in zip(a.tolist(), b.tolist())}
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 2, 1))
    assert got == set(zip(i.tolist(), j.tolist()))
    df = spark.createDataFrame([(int(f), 1 + k % 3, k) for k, f in enumerate(fp.view(np.int64))], "fp long, n long, rep long")
    near, comp = {}, {}
    for hot in (1 << 17, 8):  # with and without splitting
        linked, parts = simhash.link_fingerprints(df, hot)
        near[hot] = {r.fp: r.linked for r in linked.collect()}
        comp[hot] = {r.node: r.component for r in parts.collect()}
    count = np.array([1 + k % 3 for k in range(len(fp))])
    link = np.bitwise_count(fp[:, None] ^ fp[None]) <= 2
    want = (link * count[None]).sum(1) - count
    assert near[8] == near[1 << 17] == {int(f): int(n) for f, n in zip(fp.view(np.int64), want) if n}
    _, groups = brute_groups(list(range(len(fp))), fp)
    assert comp[8] == comp[1 << 17] == {k: int(c) for k, c in enumerate(groups) if c != k}


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long").repartition(8)
    assert {r.node: r.component for r in cc.components(edges).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_xxh64_and_words():
    rng = np.random.default_rng(6)
    buf = rng.integers(0, 256, 3000).astype(np.uint8)
    s, n = rng.integers(0, 2500, 500), rng.integers(0, 200, 500)
    assert kernels.xxh64_slices(buf, s, n).tolist() == [xxhash.xxh64_intdigest(bytes(buf[a : a + k]), 42) for a, k in zip(s, n)]


# -- chunk fingerprints ---------------------------------------------------------------------------------------------


def by_definition(docs):
    order = sorted(docs, key=lambda r: (r[0], r[1]), reverse=True)
    return {(d, t): order[(i + 1) % len(order)][1] for i, (d, t) in enumerate(order)}


def test_chunk_fingerprints_of_one_repeated_chunk(spark):
    text = "a" * 200_000
    rows = cf.in_order(spark.createDataFrame([(1, text), (2, text)], SCHEMA)).mapInArrow(cf.compare, cf.OUT).collect()
    assert [(r.near_next, r.near_edited) for r in rows] == [(1.0, 1.0)] * 2
    assert cf.likeness(rows[0].fingerprint, rows[1].fingerprint) == 1.0


@pytest.mark.parametrize("rows_per_range", [3, 4096])
def test_chunk_fingerprints(spark, rows_per_range):
    rnd = random.Random(7)
    docs = [(i, words_doc(rnd, rnd.choice([0, 1, 5, 200, 900]))) for i in range(40)] + [(7, "repeated id é"), (900, "z" * 3000)]
    got = cf.in_order(spark.createDataFrame(docs, SCHEMA), rows_per_range).mapInArrow(cf.compare, cf.OUT).collect()
    assert len(got) == len(docs)
    following = by_definition(docs)
    edited = {(d, len(t), hashlib.sha256(cf.edit(t, following[d, t]).encode()).hexdigest()) for d, t in docs}
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == edited
    for r in got:
        assert abs(cf.likeness(r.fingerprint, r.edited_fingerprint) - r.near_edited) < 1e-9
    long_ = [r for r in got if r.n_chars > 800 and r.doc_id != 900]
    assert min(r.near_edited for r in long_) > 0.5 and max(r.near_next for r in long_) < 0.4


def test_chunk_long_repetitive_texts_and_ranges(spark):
    lines = "one line of thirty-one bytes...\n" * 6000
    rows = cf.in_order(spark.createDataFrame([(1, lines), (2, lines), (None, lines), (None, "b")], SCHEMA)).mapInArrow(cf.compare, cf.OUT).collect()
    assert {(r.doc_id, r.near_next) for r in rows if r.fingerprint == rows[0].fingerprint} >= {(1, 1.0), (2, 1.0)}
    assert sorted(r.doc_id or 0 for r in rows) == [0, 0, 1, 2]
    base = spark.range(5000).select((F.col("id") % 977).alias("doc_id"))
    a, b = (sorted(map(tuple, cf._tag_ranges(base, list(range(3, 900, 7)), inline).collect())) for inline in (1000, 0))
    assert a == b  # both ways of tagging


def test_chunk_edges(spark):
    q = lambda rows: {r.doc_id: r for r in cf.in_order(spark.createDataFrame(rows, SCHEMA)).mapInArrow(cf.compare, cf.OUT).collect()}
    assert q([]) == {}
    one = q([(4, "abcdef")])[4]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    two = q([(1, None), (2, "")])
    assert two[1].near_next == 1.0 and two[1].fingerprint == two[2].fingerprint
    shifted = words_doc(random.Random(8), 800)
    pair = q([(2, shifted), (1, "an insertion " + shifted)])
    assert pair[2].near_next > 0.9


# -- packing --------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(9)
    docs = [(i, words_doc(rnd, rnd.choice([0, 3, 60, 400, 1500, 3000]))) for i in range(60)] + [(3, "again"), (None, None), (70, "a" * 50000)]
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA).coalesce(2)).collect()
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted((d if d is not None else -1, zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for d, x in docs if len(x or "") < 3000)
    whole = sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32) for r in rows if r.length == r.doc_tokens)
    assert set(whole) <= set(want) | {w for w in whole if w[0] == 70}
    total = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in docs)
    assert sum(r.length for r in rows) == total
    per = {}
    for r in rows:
        per.setdefault(r.sequence_id, []).append(r)
    for pieces in per.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(sum(r.length for r in p) < 2048 for p in per.values()) <= 2
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    encode, t = packing.load_tokenizer(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    rnd = random.Random(12)
    texts = ["x <|endoftext|> y", "<|endoftext|>" * 3, "<|endoftext", "a" * 5000, " " * 5000, "é\u2028\u00a0 it's 12345\t\n\n x"]
    texts += ["".join(chr(rnd.choice([32, 10, 39, 65, 97, 0x3B1, 0x4E2D, 0x1F600, rnd.randint(33, 0x2FFF)])) for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    for x in texts:
        assert encode(x) == t.encode(x, add_special_tokens=False).ids, x


def test_packing_pieces_join_up():
    rng = np.random.default_rng(10)
    packer, out, sizes = packing.SumOfSquares(64), [], rng.integers(1, 65, 700)
    for k, s in enumerate(sizes):
        done = packer.place(k, 0, int(s))
        assert packer.count.sum() == sum(map(len, packer.open)) and packer.count.min() >= 0
        if done:
            out.append(done)
    out += list(packer.close())
    got = {}
    for w in out:
        assert sum(n for *_, n in w) <= 64
        for k, a, n in w:
            got.setdefault(k, []).append((a, n))
    for k, s in enumerate(sizes):
        at = 0
        for a, n in sorted(got[k]):
            assert a == at
            at += n
        assert at == s
    assert sum(sum(n for *_, n in w) < 64 for w in out) <= 1


def test_packing_takes_the_least_sum_of_squares():
    rng = np.random.default_rng(11)
    packer = packing.SumOfSquares(32)
    for k, s in enumerate(rng.integers(1, 32, 400).tolist()):
        before = packer.count.copy()
        options = []
        for h in range(0, 33 - s):
            if h == 0 or before[h]:
                n = before.copy()
                n[h] -= h > 0
                if h + s < 32:
                    n[h + s] += 1
                options.append(int((n[1:32] ** 2).sum()))
        packer.place(k, 0, s)
        assert int((packer.count[1:32] ** 2).sum()) == min(options)


# -- quality --------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op8_quality(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    test = [(got[r.doc_id].predicted, r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels)
    assert sum(a == b for a, b in test) / len(test) > 0.95
    good = [p for p, q in test if q]
    assert sum(good) / len(good) > 0.98


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 8.0), (3, "fine words", None), (3, "fine words", None)], "doc_id long, text string, quality_score double")
    none = quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.quality_score for r in quality.score_quality(docs, none).collect()] == [0.5] * 4
    labels = spark.createDataFrame([(2, 0), (3, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    a = {r.doc_id: r.quality_score for r in quality.score_quality(docs, model).collect()}
    assert a[1] == a[2] and all(0 <= x <= 1 for x in a.values())
    assert quality.score_quality(docs.limit(0), model).count() == 0


M64 = (1 << 64) - 1


def mixed(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def token_hash(b):
    return mixed(sum((x + 1) * pow(kernels._BASE, i, 1 << 64) for i, x in enumerate(b)) & M64)


def by_hand(text, bits):
    """The classifier's features of one text, token by token: bucket to value."""
    tokens = [token_hash(m[0]) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", (text or "").encode())]
    count = {}
    for t in tokens:
        b = mixed(t + 1 & M64) >> 64 - bits
        count[b] = count.get(b, 0) + 1
    t = [1 if i and x == tokens[i - 1] else x for i, x in enumerate(tokens)]
    for a, b in zip(t, t[1:]):
        h = ((1 if b == 1 else a) * 0xD6E8FEB86659FD93 + b) & M64
        k = mixed(h + 2 & M64) >> 64 - bits
        count[k] = count.get(k, 0) + 1
    size = sum(n * n for n in count.values()) ** 0.5
    return {b: n / size for b, n in count.items()}


def test_quality_is_the_sparse_dot_product(spark):
    rnd = random.Random(13)
    texts = ["", None, "a", "a a a b", "Ünï code, signs!! 12", "x" * 300] + [" ".join(rnd.choice(["good", "bad", "ok", "ok", "!!", "ö"]) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    model = quality.fit_quality(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality"))
    assert np.abs(model.weights).sum() > 0
    for r in quality.score_quality(docs.repartition(3), model).collect():
        raw = model.bias + sum(float(model.weights[b]) * v for b, v in by_hand(r.text, model.bits).items())
        assert abs(r.quality_score - 1 / (1 + np.exp(-raw))) < 1e-9, r.text


def test_score_is_of_the_text_alone(spark):
    model = quality.fit_quality(spark.createDataFrame([(2, "a b c d"), (3, "a a b b")], SCHEMA), spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, quality int"))
    one = quality.score_quality(spark.createDataFrame([(1, "a b c d")], SCHEMA), model).first().quality_score
    for before in ("z a", "a", "a a", "", None):
        pair = spark.createDataFrame([(0, before), (1, "a b c d")], SCHEMA).coalesce(1)
        assert [r.quality_score for r in quality.score_quality(pair, model).collect() if r.doc_id == 1] == [one]
    odd = spark.createDataFrame([(None, "a")], SCHEMA)
    assert quality.score_quality(odd, model).select(quality.held_out().alias("h")).first().h is False


def test_training_is_bounded_and_skips_held_out(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("good w"), F.col("id") % 7).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.fit_quality(docs, labels, max_rows=10).bias > 0
    only = docs.where(quality.held_out())
    assert quality.fit_quality(docs, only.select("doc_id", F.lit(1).alias("quality"))).bias == 0.0
