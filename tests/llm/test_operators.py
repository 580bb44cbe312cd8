"""Each operator against a brute-force version on small tables with the awkward cases in them."""

import collections
import hashlib
import os
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import fingerprint, langid, mixing, packing, pagetext, pii, simhash, tokencount, topk, toxicity
from quarry.llm.common import hash_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def words(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def edit(text, seed, share=0.02):
    r, w = np.random.default_rng(seed), text.split()
    return " ".join(r.choice(WORDS) if r.random() < share else x for x in w)


@pytest.fixture(scope="module")
def docs(spark):
    base = words(0, 300)
    rows = [(i, edit(base, i, 0.01), "en", "a", 1) for i in range(6)] + [(10 + i, words(50 + i, 20 + 7 * i), "fr", ["a", "b", None][i % 3], 1) for i in range(20)]
    rows += [(40, None, None, None, None), (41, "", "en", "c", 0), (42, " \t\n", "en", "c", 3), (43, "One", "en", "b", 3), (44, "one", "en", "b", 3), (45, words(99, 9000), "de", "b", 9), (46, "a b", "en", "b", 3), (46, "a b", "en", "b", 3), (None, "no id here", "en", "a", 10)]
    return spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", label string").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ------------------------------------------------------------------------------------------------------


def fp_brute(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components_brute(fps, radius=3):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    fps = {r.doc_id: fp_brute(r.text) for r in docs.collect() if r.doc_id is not None}
    assert len(got) == docs.count()
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got if r.doc_id is not None} == fps
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == components_brute(fps)


def clusters(seed, centres, each):
    r = np.random.default_rng(seed)
    out = set()
    for c in r.integers(0, 2**63, centres).tolist():
        for _ in range(each):
            out.add(c ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False)))
    return sorted(out)


@pytest.mark.parametrize(("centres", "each", "block_rows"), [(40, 12, 16_384), (1, 400, 64), (2, 300, 37), (30, 4, 5)])
def test_simhash_index(spark, centres, each, block_rows):
    """Dense and sparse clusters in few and many blocks: the same components."""
    fps = dict(enumerate(clusters(centres, centres, each)))
    nodes = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in fps.items()], "node long, fp long")
    labels = {r.node: r.label for r in simhash.components(simhash.links(nodes, 3, block_rows)).collect()}
    assert {i: labels.get(i, i) for i in fps} == components_brute(fps)


def in_gray_order(fps):
    fp = np.array(fps, dtype=np.uint64)
    return fp[np.argsort(simhash.gray_rank(fp))]


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_index_finds_all_pairs(radius):
    """Both turns together: exactly the pairs within the radius."""
    fps = clusters(5, 30, 40)
    got = set()
    for turned in (fps, [(f << 32 | f >> 32) & (2**64 - 1) for f in fps]):
        fp = in_gray_order(turned)
        index = simhash.levels(fp, fp)
        for i, j in simhash.descend(index, index, radius, same=True):
            near = np.bitwise_count(fp[i] ^ fp[j])
            assert (near <= radius).all()
            back = (lambda f: f) if turned is fps else (lambda f: (f << 32 | f >> 32) & (2**64 - 1))
            got |= {frozenset((back(int(fp[x])), back(int(fp[y])))) for x, y in zip(i.tolist(), j.tolist(), strict=True) if x != y}
    assert got == {frozenset((a, b)) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= radius}


def test_index_prunes_groups():
    """Far fewer nodes are visited than there are pairs."""
    fp = in_gray_order(np.random.default_rng(1).integers(0, 2**63, 20_000).tolist())
    index = simhash.levels(fp, fp)
    met = []
    bitwise_count = np.bitwise_count
    simhash.np.bitwise_count = lambda x: met.append(len(x)) or bitwise_count(x)
    try:
        assert all((i == j).all() for i, j in simhash.descend(index, index, 3, same=True))
    finally:
        simhash.np.bitwise_count = bitwise_count
    assert sum(met) / 2 < 0.05 * 20_000**2 / 2


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.label for r in simhash.components(edges).collect()} == {0}


def test_keep_one(docs):
    got = sorted((r.doc_id, r.text or "") for r in simhash.keep_one(docs).collect() if r.doc_id is not None)
    shingles = {}
    for r in docs.filter("doc_id is not null").collect():
        w = (r.text or "").lower().split()
        shingles[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(shingles)
    up = {i: i for i in ids}
    for a in ids:
        for b in ids:
            s, t = shingles[a], shingles[b]
            if a < b and (s == t or len(s & t) >= 0.8 * len(s | t)):
                up[b] = min(up[b], up[a])
    assert [i for i, _ in got] == [i for i in ids if up[i] == i]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1


def test_keep_one_shared_passage(spark):
    """Near copies are found though earlier texts, which are not their near copies, share most buckets with them."""
    passage = words(7, 200)
    own = lambda k, n: " ".join(f"u{k}x{i}" for i in range(n))
    rows = [(i, f"{passage} {own(i, 90)}") for i in range(100)] + [(100 + i, f"{passage} {own(100 + i, 18)}") for i in range(50)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(101))


def test_keep_one_repeated_line(spark):
    """A line repeated inside texts decides all bits of their fingerprints, and none of the texts is a near copy."""
    line, own = words(3, 11), lambda k: " ".join(f"u{k}x{i}" for i in range(100))
    rows = [(i, " ".join([line] * 200 + [own(i)])) for i in range(30)] + [(30, " ".join([line] * 190 + [own(29)]))]
    assert len({simhash.fingerprint(t, 5) for _, t in rows}) == 1
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))


def test_matches_in_blocks(spark):
    rows = [(i, f"{words(7, 60)} u{i} v{i % 3} " + " ".join(f"w{i // 4}x{k}" for k in range(30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members = df.select(F.lit(1).cast("long").alias("key"), F.col("doc_id").alias("node"), F.col("doc_id").alias("label"))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {r.node: r.label for r in simhash.components(spark.createDataFrame(near, "a long, b long")).collect()}
    own = df.select(F.col("doc_id").alias("node"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"))
    sets_of = simhash.shingle_sets(df, own, 5).cache()
    sizes = sets_of.select("node", F.size("hashes").alias("size"))
    for rows_each in (1024, 6):
        got = simhash.matches(members, simhash.unlike_buckets(members, sizes, rows_each), sets_of, 0.8)
        assert {(r.a, r.b) for r in got.collect()} <= set(near)
        assert {r.node: r.label for r in simhash.components(got).collect()} == want
    stars = spark.createDataFrame([(a, b) for a in (0, 9) for b in range(40) if a != b], "a long, b long")
    for rows_each in (1024, 3):
        got = simhash.components(simhash.star_matches(stars, sets_of, sizes, 0.8, piece_rows=rows_each)).collect()
        linked = spark.createDataFrame([(a, b) for a, b in near if a in (0, 9) or b in (0, 9)], "a long, b long")
        assert {r.node: r.label for r in got} == {r.node: r.label for r in simhash.components(linked).collect()}


def test_keep_one_equal_ids(spark):
    """Different texts of one id stay; rows equal in id and text are one; further columns of any name come back."""
    one, other, near = words(1, 60), words(2, 60), edit(words(1, 60), 5, 0.01)
    rows = [(1, one, "p", 1), (1, other, "q", 2), (1, one, "p", 1), (1, one, "r", 0), (2, near, "s", 3), (None, one, "t", 4), (None, words(3, 40), "u", 5), (None, words(4, 40), "v", 6), (None, words(4, 40), "v", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, label int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == sorted([(1, one), (1, other), (0, words(3, 40)), (0, words(4, 40))])
    assert sorted(map(str, kept.collect())) == sorted(map(str, simhash.keep_one(df.repartition(3)).collect()))


def test_simhash_empty_and_long(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    long = " ".join(f"x{i}" for i in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long + " y"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3]


# --- 2 ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("scale", "group"), [(1.0, 64), (1e7, 1000), (0.0, 50)])
def test_topk(spark, scale, group):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=20) * scale]) for i in range(300)] + [(400, None), (401, [float("nan")] * 20), (402, [None] + [1.0] * 19), (5, [1.0] * 20), (None, [1.0] * 20)]
    df = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, df.filter("vec_id % 100 = 0"), 10, group, 2).collect())
    v = [(i, [int(np.floor(1024 * x)) for x in e]) for i, e in rows if e and i is not None and i not in (401, 402)]
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = [(i, n + 1, j, -s) for i, a in v if i % 100 == 0 for n, (s, j) in enumerate(sorted((-clamp(sum(x * y for x, y in zip(a, b, strict=True))), j) for j, b in v if j != i)[:10])]
    assert got == sorted(want)


def test_topk_few(spark):
    df = topk.integer_vectors(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"))
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 1024 * 2048)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


# --- 3 ------------------------------------------------------------------------------------------------------


def ids_of(text):
    from quarry.llm.wordtokens import tokens

    return tokens().whole(text or "") + packing.END


def check_packing(docs, got, capacity=4096):
    want = sorted((r.doc_id if r.doc_id is not None else -1, ids_of(r.text)) for r in docs.collect())
    assert sum(r.length for r in got) == sum(len(x) // 4 for _, x in want)
    texts = {}
    for i, x in want:
        texts.setdefault(i, []).append(x)
    for r in got:
        options = texts[r.doc_id if r.doc_id is not None else -1]
        assert any(zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and len(x) == 4 * r.doc_tokens for x in options)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    waste = 0
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        waste += 0 if at & (at - 1) == 0 else capacity - at
    return waste


def test_packing(docs, empty):
    got = packing.pack(docs).collect()
    assert check_packing(docs, got) <= 0.02 * sum(r.length for r in got) + 64
    assert packing.pack(empty).count() == 0


def test_packing_plan():
    r = np.random.default_rng(1)
    sizes = np.minimum(512, np.maximum(1, r.lognormal(3.5, 1, 20000).astype(int)))
    hist = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    plan = packing.plan(hist, 512)
    used = {}
    for pattern, times, _ in plan:
        assert sum(b * a for b, a in pattern.items()) <= 512
        for b, a in pattern.items():
            used[b] = used.get(b, 0) + a * times
    assert used == hist
    assert sum(t for _, t, dissolve in plan if not dissolve) <= 1.003 * sizes.sum() / 512 + 1
    began = time.perf_counter()
    huge = packing.plan({b: 10**8 + b for b in range(1, 513)}, 512)
    assert time.perf_counter() - began < 15
    held = collections.Counter()
    for pattern, times, _ in huge:
        assert sum(b * a for b, a in pattern.items()) <= 512
        held.update({b: a * times for b, a in pattern.items()})
    assert held == {b: 10**8 + b for b in range(1, 513)}
    assert packing.plan({}, 512) == [] and packing.binary_cuts(1000) == [512, 256, 128, 64, 32, 8]


# --- 4 ------------------------------------------------------------------------------------------------------


def test_fingerprint(docs, empty, spark):
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    order = sorted(text, reverse=True)
    for per_range in (1000, 4, 1):
        got = {r.doc_id: r for r in fingerprint.edited(rows, per_range).collect()}
        assert set(got) == set(text)
        for i, d in enumerate(order):
            t, n = text[d], text[order[(i + 1) % len(order)]]
            half = len(t) // 2
            changed = t[: len(t) - half] + n[:half]
            assert got[d].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert got[d].n_chars == len(t) and got[d].near_edited == float(fingerprint.canonical(t) == fingerprint.canonical(changed))
        assert got[43].fingerprint == got[44].fingerprint and got[43].near_next == 0.0 and got[44].near_next == 1.0
    assert fingerprint.edited(docs, 5).count() == docs.count()
    assert fingerprint.edited(empty).count() == 0
    lone = fingerprint.edited(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).first()
    assert lone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and lone.near_next == 1.0


def test_exact_classes(spark):
    df = spark.createDataFrame([(1, "Ａb  c"), (2, "ab c "), (3, "x"), (4, None), (5, " ")], "doc_id long, text string")
    assert sorted((r.class_id, r.copies) for r in fingerprint.exact_classes(df).collect()) == [(1, 2), (3, 1), (4, 2)]


@pytest.mark.parametrize("weak", [False, True])
def test_classified(docs, empty, monkeypatch, weak):
    """Classes are those of equal canonical bytes, also where digests clash."""
    if weak:
        monkeypatch.setattr(fingerprint, "digest", lambda data: f"{len(data) % 3:032x}")
    text = [(r.doc_id, fingerprint.canonical(r.text or "")) for r in docs.collect()]
    got = fingerprint.classified(docs).collect()
    want = sorted((-1 if i is None else i, min(j for j, u in text if u == t and j is not None) if any(u == t and j is not None for j, u in text) else None, sum(u == t for _, u in text)) for i, t in text)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.copies) for r in got) == want
    assert all((r.near_next == 1.0) <= (r.copies > 1) for r in got)
    spread = fingerprint._joined(rows := fingerprint.edited(docs), fingerprint.shared_classes(docs, rows), most=0)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.copies) for r in spread.collect()) == want
    assert fingerprint.classified(empty).count() == 0


# --- 5 ------------------------------------------------------------------------------------------------------


def targets_brute(size):
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    w = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(size.values())), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 3 * size[s]]
        for s in over or list(open_):
            out[s] = 3.0 * size[s] if over else left * w[s] / total
            open_.discard(s)
        left -= sum(out[s] for s in over)
    return out


def test_mixing(docs, empty, spark):
    got = mixing.mix(docs).collect()
    assert mixing.mix(empty).count() == 0
    rows = docs.collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert sorted(r["size"] for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    for s, t in targets_brute(size).items():
        mine = [r for r in got if abs(r.target - t) < 1e-6 and r.source_size == size[s]]
        assert mine and abs(sum(r.taken for r in mine) - t) <= 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_resample(docs):
    out = mixing.resample(docs)
    assert out.columns == docs.columns
    assert out.filter("text is null or trim(text) = ''").count() == 0


# --- 6 ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "whole"), [(1 << 20, 1 << 28), (64, 1 << 28), (7, 100)])
def test_token_counts(spark, docs, empty, tmp_path, block, whole):
    """Files written, read back in blocks or by byte ranges, and counted: what the encoder gives, in the files' order."""
    encode = tokencount.encoder().encode_ordinary
    want = sorted((r.doc_id if r.doc_id is not None else -1, len(encode(r.text or ""))) for r in docs.collect())
    names = tokencount.write_token_files(docs, str(tmp_path / "files"))
    got = tokencount.token_counts(tokencount.read_token_files(spark, str(tmp_path / "files"), block=block, whole=whole))
    by = {}
    for r in got.collect():
        assert r.closed
        by.setdefault(int(r.file.split("part-")[1].split("-")[0]), []).append((r.ordinal, r.start, r.n_tokens))
    for rows in by.values():
        at = 0
        for k, (ordinal, start, n) in enumerate(sorted(rows)):
            assert (ordinal, start) == (k, at)
            at += n + 1
    ids = {(r.file, r.ordinal): r.doc_id for r in names.collect()}
    assert sorted((ids[f, o] if ids[f, o] is not None else -1, n) for f, rows in by.items() for o, _, n in rows) == want
    total = sum((tmp_path / "files" / f).stat().st_size for f in os.listdir(tmp_path / "files") if f.startswith("part-"))
    assert total == sum(2 * (n + 1) for _, n in want)  # nothing but ids in the files


def test_count_documents(docs, empty):
    encode = tokencount.encoder().encode_ordinary
    key = lambda r: (r[0] if r[0] is not None else -1, r[1])
    assert sorted(key((r.doc_id, r.n_tokens)) for r in tokencount.count_documents(docs).collect()) == sorted(key((r.doc_id, len(encode(r.text or "")))) for r in docs.collect())
    assert tokencount.count_documents(empty).count() == 0


def test_token_files(spark, tmp_path):
    np.array([1, 2, 9, 9, 3, 4, 5], dtype="<u4").tofile(tmp_path / "a.bin")
    for whole in (1000, 8):
        blocks = tokencount.read_token_files(spark, str(tmp_path), "<u4", 2, whole)
        got = tokencount.token_counts(blocks, 9, "<u4").orderBy("ordinal").collect()
        assert [(r.start, r.n_tokens, r.closed) for r in got] == [(0, 2, True), (3, 0, True), (4, 3, False)]


# --- 7 ------------------------------------------------------------------------------------------------------


def test_toxicity(spark, empty):
    r = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [f"{r.choice(['fine', 'house', 'river', 'garden', 'letter', 'window'])}" for _ in range(40)]
        if bad:
            w[5], w[20] = "nasty", "vileword"
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    rows += [(1000, "house v1l3w0rd river n a s t y"), (1001, "house river garden"), (1002, None), (1003, "nnnaasty viiileeword house"), (1004, "x" * 9000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(400))
    assert got[1000] >= 0.5 and got[1003] >= 0.5 and got[1001] < 0.5 and got[1002] < 0.5 and got[1004] < 0.5
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(empty, toxicity.train(docs, labels)).count() == 0


def test_toxicity_learns_every_labelled_document(spark):
    """Terms, trigrams and the logistic model come from all labelled rows: 3,200 toxic ones, where rare words stand in twelve each."""
    rare = [f"zaq{a}{b}ump" for a in "abcdef" for b in "ghijk"]
    known = [i for i in range(12_000) if zlib.crc32(str(i).encode()) % 5]
    toxic = known[1::3]
    put = {i: rare[k // 12] for k, i in enumerate(toxic[7 :: len(toxic) // 360][:360])}
    rows = [(i, f"house river {'garden' if i % 2 else 'window'} {put.get(i, 'letter')} {'nasty' if i in put or i % 7 == 0 else 'fine'}") for i in range(12_000)]
    bad = set(toxic)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i in bad)) for i in range(12_000)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    seen = {}
    for i in known:
        for t in {t for w in rows[i][1].split() for t in toxicity.terms(w)}:
            seen.setdefault(t, [0, 0])[i in bad] += 1
    n = [len(known) - len(bad), len(bad)]
    low = {t: np.log((b + 0.5) / (n[1] + 1)) - np.log((g + 0.5) / (n[0] + 1)) - 1.64 * np.sqrt(1 / (b + 0.5) + 1 / (g + 0.5)) for t, (g, b) in seen.items() if g + b >= 4}
    assert model.weights == pytest.approx({t: v for t, v in low.items() if v > 1}) and set(rare) <= set(model.weights)
    assert model.chars.table == toxicity.CharModel({t: sum(seen[t]) for t in low if not t.endswith("*")}).table
    x, y = np.array([model.features(rows[i][1]) for i in known]), np.array([i in bad for i in known], dtype=float)
    gradient = x.T @ (1 / (1 + np.exp(-x @ np.array(model.w))) - y) + np.array(model.w)
    assert np.abs(gradient).max() < 1e-3


def test_restore():
    chars = toxicity.CharModel({"idiot": 50, "stupid": 50, "house": 80, "scum": 30, "letter": 40})
    for token, word in [("1d10t", "idiot"), ("$tup1d", "stupid"), ("s.c.u.m", "scum"), ("iiidiot", "idiot"), ("s t u p i d", "stupid"), ("house", "house")]:
        assert chars.restore(token) == word


def restore_brute(chars, token):
    """The best score over all readings of a token, spelled out one by one."""
    best = []

    def read(i, state, score):
        if i == len(token):
            best.append(score + chars.step(state, "$"))
            return
        options, skip = chars.letters(token, i)
        for x, cost in options:
            read(i + 1, state[1] + x, score + chars.step(state, x) - cost)
        if skip is not None:
            read(i + 1, state, score - skip)
        if token[i] == " " and state != "^^":
            read(i + 1, "^^", score + chars.step(state, "$") - toxicity.COST["break"])

    read(0, "^^", 0.0)
    return max(best)


def test_restore_is_the_best_of_all_readings():
    chars = toxicity.CharModel({"idiot": 50, "stupid": 50, "house": 80, "scum": 30, "letter": 40, "a": 60, "you": 60})
    r = np.random.default_rng(3)
    for token in ["s***d", "*****", "6|8!1", "a s c u m", "1!1!1!", "((**))", *("".join(r.choice(list("ab1!6*. s8|"), 7)) for _ in range(60))]:
        assert chars.best(token)[0] == pytest.approx(restore_brute(chars, token), abs=1e-9)
    for run, words_in in [("a s t u p i d", "a stupid"), ("y o u s c u m", "you scum"), ("s c u m", "scum")]:
        assert chars.restore(run) == words_in
    assert chars.restore("stupid" * 3000).count("stupid") == 3000


def test_hash_sample(spark):
    """Within the bound for strata of few and many rows, and where all rows are one."""
    rows = [("a", i) for i in range(9000)] + [("b", i) for i in range(7)] + [("c", 1)] * 5000 + [(None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, doc_id long")
    for bits in (12, 4):
        got = hash_sample(df, "s", 100, ["doc_id"], bits=bits).groupBy("s").count().collect()
        n = {r.s: r["count"] for r in got}
        assert 50 <= n["a"] <= 100 and n["b"] == 7 and n["c"] == 100 and 50 <= n[None] <= 100


# --- 8 ------------------------------------------------------------------------------------------------------


def test_forward_is_the_sum_of_segmentations():
    pieces = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba", "▁", "▁a"])}
    r = np.random.default_rng(0)
    p = np.concatenate([r.random((7, 2)), np.zeros((1, 2)), np.full((1, 2), 1e-9)])

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(word) + 1):
            if word[:k] in pieces:
                out += p[pieces[word[:k]]] * total(word[k:])
            elif k == 1:
                out += 1e-9 * total(word[1:])
        return out

    forms = ["▁abab", "▁aba", "ba", "▁azb"]
    assert np.allclose(np.exp(langid.Lattice(forms, pieces).forward(p)), [total(w) for w in forms])
    used = langid.Lattice(["▁abab"], pieces).expected(p, np.ones((1, 2)))
    letters = sum(used[i] * len(x) for x, i in pieces.items())
    assert np.allclose(letters, 5)


def test_forward_has_whole_words_and_all_pieces():
    """Long pieces count, words of any length are one lattice, and their sums don't run out of range."""
    pieces = {"▁": 0, "a": 1, "aaaaaaaaaaaaaaa": 2, "▁aa": 3}
    p = np.array([[0.1, 0.2], [1e-8, 1e-7], [0.3, 0.1], [0.2, 0.1], [0, 0], [1e-9, 1e-9]])

    def log_total(word):
        a = [np.zeros(2)]
        for j in range(1, len(word) + 1):
            arcs = [a[i] + np.log(p[pieces[word[i:j]]]) for i in range(j) if word[i:j] in pieces]
            arcs += [a[j - 1] + np.log(1e-9)] if word[j - 1] not in pieces else []
            a.append(np.logaddexp.reduce(arcs))
        return a[-1]

    forms = ["▁" + "a" * n for n in (1, 15, 16, 40, 400)] + ["▁" + "a" * 20 + "z" * 60, "b"]
    lattice = langid.Lattice(forms, pieces)
    assert np.allclose(lattice.forward(p), [log_total(w) for w in forms])
    used = lattice.expected(p, np.ones((len(forms), 2)))
    assert np.allclose(sum(used[i] * len(x) for x, i in pieces.items()) + used[5], sum(map(len, forms)))
    assert langid.stretches("x" * 60 + "1ab") == ["▁" + "x" * 60, "▁ab"]
    assert max(map(len, langid.vocabulary())) == 16


def test_langid(spark, docs, empty):
    en, de = "the house is over there and that is what they said with this", "das haus ist da und das ist nicht was sie mit dem gesagt haben"
    rows = [(i, " ".join(np.random.default_rng(i).permutation((en if i % 2 else de).split())), "en" if i % 2 else "de") for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !", "en"), (902, "das ist das haus", None)], "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(200))
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "de")
    assert all(0 <= r.score <= 1 for r in got.values())
    model.cache_words = 40
    assert {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()} == {i: r.lang_pred for i, r in got.items()}
    assert {r.lang_pred for r in langid.predict(df, langid.train(df.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
    assert sorted(r.doc_id for r in langid.keep_known(df).collect()) == [*range(200), 902]


# --- 9 ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body><nav>m</nav><article><h1>T &amp; x</h1><p>a <b>b</b>\n c<br>d<p>e</article><footer>f</footer>", "T & x\na b c d\ne"),
        ('<main><p>a</p><aside>s</aside><div class="ad">x</div><form>q</form><script>var a="</p>";</script><section id="comments"><article>no</article></section><p>b</p></main>', "a\nb"),
        ('<article class="comment">no</article><div role="main"><header>h</header>x<!-- c --></div>', "h\nx"),
        ("<head><title>t</title><body><article>only &lt;this&gt; &#228;</article>", "only <this> ä"),
        ("", ""),
        (None, ""),
        ("<nav>x</nav>", ""),
        ('<body><form action="/"><div>menu</div><article><p>a<p>b</article></form>', "a\nb"),
        ('<body class="has-sidebar"><div class="no-sidebar"><article>a</article></div><div class="sidebar">s</div>', "a"),
        ('<div id="related-topics"><main><p>a</p></main></div>', "a"),
        ('<div class="wrapper sidebar"><article>teaser</article></div><article>a</article>', "a"),
        ('<main><p>long text of the article</p><div class="related"><article>teaser</article></div></main>', "long text of the article"),
        ("<form><p>the whole page is a form</p><fieldset>login</fieldset></form>", "the whole page is a form\nlogin"),
        ('<article><h1>T</h1><div class="post share-enabled"><p>all of the text is in here</p></div></article>', "T\nall of the text is in here"),
        ('<article><p>text with <span class="ad">buy</span> an advert</p></article>', "text with an advert"),
        ('<article><p>one <a class="share">x</p><p>two</p></article>', "one\ntwo"),
        ('<article><h1>T</h1><p>one line</p><div class="related">' + "<p><a>teaser of another page</a></p>" * 12 + "</div></article>", "T\none line"),
        ('<article><p>one line</p><div class="newsletter"><p>' + "sign up now " * 40 + "</p></div></article>", "one line"),
        ('<article><header><h1>T</h1><p>by A</p></header><div class="social-body"><p>text</p><div class="related"><p>x</p></div></div><div class="promo"><p>y</p></div></article>', "T\nby A\ntext"),
        ('<article><div class="widget"><h1>T</h1><p>text</p></div><p>more</p></article>', "T\ntext\nmore"),
        ("<article><p>x <script>1</script>y <svg><path/></svg>z<iframe></iframe>, <select><option>o</select>a <button>b</button>c <video>v</video>d</p></article>", "x y z, a c d"),
        ("<article>" + "<p>x y</p>" * 20_000 + "</article>", "\n".join(["x y"] * 20_000)),
    ],
)
def test_pagetext(spark, html, text):
    pages = spark.createDataFrame([(1, "https://h.x/", html, 5)], "page_id long, url string, html string, text int")
    assert [(r.page_id, r.text) for r in pagetext.extract(pages).collect()] == [(1, text)]


def test_unmarked_pages(spark):
    """Without an article mark, what the host repeats goes and the rest stays; another host's repetition doesn't count."""
    menu = "<div>Home News Sport</div><div>All about us and our many friends here</div>"
    foot = "<div>Copyright by the people of this good site forever</div>"
    rows = [(i, f"https://h.x/{i}", f"<body>{menu}<p>Story number {i} has words {words(i, 12)}</p>{foot}") for i in range(4)] + [(9, "https://other.x/", f"<body>{menu}<p>Text</p>{foot}")]
    got = {r.page_id: r.text for r in pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == f"Story number 2 has words {words(2, 12)}"
    assert got[9].startswith("Home News Sport\n") and got[9].endswith("forever")


def test_unmarked_pages_lose_only_what_repeats(spark):
    """A common opening or a passage inside blocks goes, the rest of the block stays; copies of one page are one page."""
    opening, inside = "According to a report published today by the office", "this sentence stands on many pages inside of their blocks"
    rows = [(i, f"https://h.x/{i}", f"<p>{opening} {words(i, 20)}</p><p>{words(20 + i, 9)} {inside} {words(40 + i, 9)}</p>") for i in range(4)]
    rows += [(10 + i, f"https://copy.x/{i}", f"<p>{words(90, 30)}</p>") for i in range(3)]
    got = {r.page_id: r.text for r in pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{words(i, 20)}\n{words(20 + i, 9)} {words(40 + i, 9)}" for i in range(4)} | {10 + i: words(90, 30) for i in range(3)}


def repeats_brute(pages, run, least):
    """Of each page's tokens, those in a stretch of `run` tokens or more that stands on `least` distinct pages of the host."""
    out = {}
    for url, tokens in pages:
        held = {tuple(u) for v, u in pages if pagetext.host_of(v) == pagetext.host_of(url)}
        gone = [False] * len(tokens)
        for a in range(len(tokens) - run + 1):
            part = tuple(tokens[a : a + run])
            if sum(any(u[k : k + run] == part for k in range(len(u) - run + 1)) for u in held) >= least:
                gone[a : a + run] = [True] * run
        out[url] = [t for t, g in zip(tokens, gone, strict=True) if not g]
    return out


def test_unmarked_pages_brute(spark):
    """All repeated stretches of random pages of two hosts, repeated rows among them."""
    r = np.random.default_rng(8)
    shared = [[f"s{k}x{i}" for i in range(int(r.integers(8, 30)))] for k in range(6)]
    pages = []
    for i in range(24):
        tokens = []
        for _ in range(5):
            tokens += [f"p{i}w{int(x)}" for x in r.integers(0, 50, int(r.integers(9, 25)))] + (shared[int(r.integers(6))] if r.random() < 0.6 else [])
        pages.append((f"https://h{i % 2}.x/{i}", tokens + [f"end{i}x{k}" for k in range(9)]))
    pages += [(u + "?again", t) for u, t in pages[:3] for _ in range(1)]
    rows = [(i, u, f"<p>{' '.join(t)}</p>") for i, (u, t) in enumerate(pages)]
    got = {x.url: x.text.split() for x in pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = repeats_brute(pages, pagetext.RUN, 3)
    assert got == want and sum(map(len, want.values())) < sum(len(t) for _, t in pages)


def test_marked_pages_meet_the_suffix_array(spark):
    """In an article, a box that the host repeats gives way to one that it does not; with no other it stays, as articles do."""
    notice = '<div class="notice"><p>please read the terms of this good site before you go on</p></div>'
    page = "<article><h1>T{0}</h1>{1}<div class='widget'><p>{2}</p></div></article><footer>f{0}</footer>"
    rows = [(i, f"https://h.x/{i}", page.format(i, notice, words(i, 20))) for i in range(4)]
    rows += [(10 + i, f"https://two.x/{i}", page.format(i, notice, words(i, 20))) for i in range(2)]
    rows += [(20 + i, f"https://copy.x/{i}", f"<article><h1>T{i}</h1><div class='widget'><p>{words(90, 20)}</p></div></article>") for i in range(4)]
    got = {r.page_id: r.text for r in pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in range(4)} == {i: f"T{i}\n{words(i, 20)}" for i in range(4)}
    assert {got[10], got[11]} == {f"T{i}\nplease read the terms of this good site before you go on" for i in range(2)}
    assert {i: got[20 + i] for i in range(4)} == {i: f"T{i}\n{words(90, 20)}" for i in range(4)}


def test_repeated_rows_meet_each_suffix_once(spark):
    """3,000 equal rows take neither 3,000 times the suffixes nor count as more than one page."""
    page = "<div>all about us and our many friends in here</div><p>{}</p>"
    rows = [(1, "https://h.x/1", page.format(words(1, 20)))] * 3000 + [(i, f"https://h.x/{i}", page.format(words(i, 20))) for i in (2, 3)]
    rows += [(7, "https://one.x/7", page.format(words(7, 20)))] * 3000
    got = pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).groupBy("page_id", "text").count().collect()
    want = {1: (words(1, 20), 3000), 2: (words(2, 20), 1), 3: (words(3, 20), 1), 7: (f"all about us and our many friends in here\n{words(7, 20)}", 3000)}
    assert {r.page_id: (r.text, r["count"]) for r in got} == want


def test_repeated_suffixes_brute(spark):
    """Suffixes of marked and unmarked pages alike, in batches that split the rows of one suffix."""
    r = np.random.default_rng(5)
    found = [(int(k), int(c), i) for i, (k, c) in enumerate(zip(r.integers(0, 300, 5000), r.integers(0, 4, 5000), strict=True))] + [(-7, i % 2, 6000 + i) for i in range(3000)] + [(-8, i // 1400, 9000 + i) for i in range(3000)]
    on = collections.defaultdict(set)
    for k, c, _ in found:
        on[k].add(c)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = pagetext.repeated_suffixes(spark.createDataFrame(found, "key long, content long, row long"), 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted((x.key, x.row) for x in got) == sorted((k, i) for k, _, i in found if len(on[k]) >= 3)


def test_no_pages(spark):
    assert pagetext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 10 -----------------------------------------------------------------------------------------------------

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_brute(text):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TEXTS = [
    "écris à jean.d@mail.example.com ou a@b.c_d@e.f, x@y", "ip 10.0.0.1 256.1.1.1 001.2.3.4 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111111", "+1 (319) 555-5132 +12 +1234567 +1-2.3(4)5 67890123",
    "4111 1111 1111 1111 +4111 1111 1111 1111", "", "😀 a@b.co 😀 10.0.0.1", "call 319-555-5132 now", "jane (at) mail (dot) com", "1" * 6000, None,
]


def test_pii(spark, empty):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.detect(df).collect():
        want = base_brute(TEXTS[r.doc_id] or "")
        assert r.base_list == want, TEXTS[r.doc_id]
        assert set(want.split(",")) <= set(r.span_list.split(",")) or not want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k, _ in PATTERNS]
    assert pii.detect(empty).count() == 0


def test_loose_spans_lie_where_they_matched(spark):
    texts = ["Call +1-212-555-0143 or phone 212-555-0143", "order 9-212-555-0143 ; phone 212-555-0143", "😀 phone 212-555-0143, 212-555-0143"]
    found = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"])
    got = {r.doc_id: [(c["at"], c["until"]) for c in r.cands if c.kind == 3] for r in found.collect()}
    assert got == {0: [(5, 20), (30, 42)], 1: [(29, 41)], 2: [(8, 20), (22, 34)]}


def spans_brute(text):
    """All candidate spans as (kind, at, until, base), each kind's base ones first."""
    out = []
    for k, (kind, _) in enumerate(PATTERNS):
        base = [tuple(map(int, x.split(":")[1:])) for x in base_brute(text).split(",") if x.startswith(kind + ":")]
        out += [(k, a, z, True) for a, z in base]
        loose = [m.span() for m in re.finditer(pii.LOOSE[kind], text, re.ASCII)]
        out += [(k, a, z, False) for a, z in loose if not any(b < z and a < e for b, e in base)]
    return out


MANY = "é phone 212-555-0143; a@b.co 10.0.0.1 card 4111-1111-1111-1111 " * 300


def test_all_candidates(spark):
    texts = [t or "" for t in TEXTS] + [
        "Call +1-212-555-0143 or phone 212-555-0143", "order 9-212-555-0143 ; phone 212-555-0143", "😀 phone 212-555-0143, 212-555-0143", "joe [at] mail [dot] org, a@b.c1@d.e", MANY,
        "2001:0db8:0000:0000:0000:ff00:0042:8329 host", "x" * 3000 + " a@b.co", "1.2.3." * 300, "a.b@c" * 100 + "@d.e",
    ]
    found = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"])
    for r in found.collect():
        assert [(c.kind, c["at"], c.until, c.base) for c in r.cands] == spans_brute(texts[r.doc_id]), texts[r.doc_id][:80]


def test_mask(spark):
    df = spark.createDataFrame([(1, "😀 a@b.co and 10.0.0.1!", 5, "x"), (2, "nothing", 7, "y"), (3, None, None, "z"), (3, None, None, "z")], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.mask(df).collect()}
    assert (got[1].text, got[1].n_chars, got[1].spans) == ("😀 <email> and <ip>!", 19, "x")
    assert (got[2].text, got[2].n_chars, got[3].text, got[3].n_chars) == ("nothing", 7, None, None)
    assert pii.mask(df).count() == 4 and pii.mask(df.limit(0)).count() == 0


def test_long_runs(spark):
    """Runs without an end take time in proportion to their length."""
    found = pii.candidates(spark.createDataFrame([(0, "x" * 300_000 + " a@b.co"), (1, "7" * 300_000 + " 1.2.3.4")], "doc_id long, text string"), ["doc_id"])
    got = {r.doc_id: [(c.kind, c["at"], c.until) for c in r.cands] for r in found.collect()}
    assert got == {0: [(0, 300_001, 300_007)], 1: [(1, 300_001, 300_008)]}


def masked_brute(text, spans):
    """The spans' places merged where they overlap, each replaced by the kind of its first."""
    out, last, kind = "", 0, None
    for k, a, z in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
        if kind is not None and a < last:
            last = max(last, z)
            continue
        out += text[last:a] + f"<{pii.KINDS[k]}>"
        last, kind = z, k
    return out + text[last:]


def test_mask_leaves_nothing(spark):
    """Whole spans go, also where they overlap and where there are hundreds of them."""
    texts = ["tel 1-555-123-4567 phone 555-123-4567 end", "+4111 1111 1111 1111 and +1 212 555 0143", MANY, "4111 1111 1111 1111" * 3 + " +4111 1111 1111 111 1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [(s.kind, s["at"], s.until) for s in r.spans] for r in pii.detect(df).collect()}
    got = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert got == {i: masked_brute(t, spans[i]) for i, t in enumerate(texts)}
    assert "555" not in got[0].replace("1-555-123-4567", "") and not re.search("[0-9]{3}", got[1])


def test_em():
    """Labelers that agree get a high posterior, those that vote no a low one; the classifier follows, and learns from shapes."""
    votes = {(0, 1, 1, 1, 0): 500, (0, -1, -1, 0, -1): 500, (0, 1, 1, 0, 0): 200, (0, -1, -1, 0, 0): 200}
    post = pii.em(votes)
    assert post[0, 1, 1, 1, 0] > 0.9 and post[0, -1, -1, 0, -1] < 0.1
    shape = {True: (3, 1, 1, 1), False: (5, 2, 2, 2)}
    patterns = {(p[0], *(v + 1 for v in p[1:]), *shape[post[p] > 0.5]): n for p, n in votes.items()}
    w = pii.classifier(patterns, post)
    logit = lambda p: sum(w[i] for i in pii._places(p[0], p[1:]))
    assert {pii.votes_of(p): logit(p) > 0 for p in patterns} == {p: post[p] > 0.5 for p in votes}
    unseen = (0, 2, 2, 1, 1)
    assert logit((*unseen, *shape[True])) > logit((*unseen, *shape[False]))


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """Fingerprints 0, 7 and 63: the middle one, whose row has no id, links the outer ones."""
    rows = spark.createDataFrame([(1, 0), (None, 0b111), (2, 0b111111), (9, -1), (None, 0x0F0F0F0F0F0F0F0F)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs.select("doc_id", "fp"))
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(rows).collect()}
    assert got == {(1, 0): 1, (None, 7): 1, (2, 63): 1, (9, -1): 9, (None, 0x0F0F0F0F0F0F0F0F): None}


def test_spread_join_broadcasts_small_tables_only(spark):
    """What the driver gathers for a broadcast stays at some thousand rows, however large the input is."""
    from quarry.llm.common import FEW, spread_join

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(60_000).select((F.col("id") % 40_000).alias("key"), "id")
        table = spark.range(30_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
        joined = spread_join(rows, table, "key")
        assert FEW < 30_000 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50_000 and joined.filter("v <> key * 2").isEmpty()
        few = spread_join(rows, table.filter("key < 100"), "key")
        assert "Broadcast" in few._jdf.queryExecution().executedPlan().toString() and few.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
