"""Operators 11 to 13: brute-force versions, small fixtures, odd input."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from quarry.llm import lexsearch, runs, urlfilter

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")

# --- periodic runs ------------------------------------------------------------------------------------------


def runs_brute(w, least=12):
    """Every stretch that agrees with itself q words on, for every q; of equal stretches the smallest q."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        j = 0
        while j < len(w) - q:
            if w[j] != w[j + q]:
                j += 1
                continue
            start = j
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - start >= max(least, 2 * q):
                found.setdefault((start, j + q), q)
    return sorted((s, t - s, q) for (s, t), q in found.items())


def collapsed_brute(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("least", [12, 4])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            w = [str(rng.randrange(rng.choice([1, 2, 3, 50]))) for _ in range(rng.randint(0, 80))]
            if len(w) > 20 and rng.random() < 0.5:
                a, p = rng.randrange(len(w)), rng.randint(1, 9)
                w = w[:a] + [w[a + (i - a) % min(p, len(w) - a)] for i in range(a, len(w))]
            texts.append(w)
        sizes, found, collapsed = runs.search([" ".join(w).encode() for w in texts], least)
        for w, n, r, c in zip(texts, sizes, found, collapsed, strict=True):
            want = runs_brute(w, least)
            assert n == len(w) and sorted(map(tuple, r.tolist())) == want and c == collapsed_brute(w, want).encode()


def test_runs_odd_input(spark):
    long = "x y " * 20_000
    rows = [(1, "a " * 12, "k"), (1, "a " * 12, "k"), (None, "b c " * 6, "k"), (2, None, None), (3, "", "k"), (4, long, "k"), (5, "a b c d e f a b c d e", "k"), (6, "w\tw\x0bw\n" * 4, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed string").withColumn("runs", F.lit(1))
    got = {(r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.find_runs(docs).collect()}
    assert got == {(1, ((0, 12, 1),), "a"), (None, ((0, 12, 2),), "b c"), (2, (), ""), (3, (), ""), (4, ((0, 40_000, 2),), "x y"), (5, (), "a b c d e f a b c d e"), (6, ((0, 12, 1),), "w")}
    assert runs.find_runs(docs).count() == len(rows) and runs.find_runs(docs.limit(0)).count() == 0


def planted_brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


@needs_data
def test_op13(spark):
    import pyarrow.parquet as pq

    documents = {r["doc_id"]: r["text"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = e.queries()["op13_runs"](spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(documents)
    periodic = 0
    for r in got:
        w = planted_brute(r.doc_id, documents[r.doc_id])
        found = sorted(runs_brute(w), key=lambda x: (x[0], x[2]))
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (None if not found else 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found)) and r.collapsed_sha256 == sha(collapsed_brute(w, found))
        periodic += bool(found)
    assert periodic >= 0.05 * len(got)


# --- url filter ---------------------------------------------------------------------------------------------


def judged_brute(url, rules, default="allow"):
    _, colon, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "allow", h + p) for h, p, v in rules if colon and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], default if best is None else ("allow" if best[2] else "block")


def test_urls_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.b.c", "b.c", "c", "x.a.b.c", "é.c", "b.c:80", "d"]
    paths = ["", "/", "/a", "/ab", "/ab/", "/é/x"]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)]
    urls = [rng.choice(["http://", "HTTPS://", "", "x://y://"]) + rng.choice([*hosts, "A.B.C", "zz.b.c", ""]) + rng.choice([*paths, "/ab/c?d#e", "?q", "#f", "/A"]) for _ in range(600)] + [None, "", "://", "no scheme/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(7)).withColumn("host", F.lit("h"))
    frame = spark.createDataFrame([*rules, rules[0], (None, "/", "block"), ("q", None, "block")], "host string, path string, verdict string")
    for rows in (1_000_000, 4):  # one file, and many
        index = urlfilter.build(frame, rows)
        assert len(index.files) == 1 if rows > 100 else len(index.files) > 3
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, index).collect()}
        assert got == {i: judged_brute(u, [*rules, ("q", "", "block")]) for i, u in enumerate(urls)}
    assert urlfilter.judge(pages.limit(0), index).count() == 0
    assert {(r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.build(frame.limit(0))).collect()} == {(None, "allow")}


def test_equal_digests_are_told_apart(tmp_path):
    strings = [b"one", b"two", b"two", b"three"]
    digests = np.array([5, 9, 9, 9], np.uint64)  # as if three strings' digests were equal
    (tmp_path / "x").write_bytes(urlfilter.DigestArray.content(digests, strings, np.array([1, 2, 3, 4])))
    asked = [b"two", b"one", b"three", b"four", b"five"]
    array = urlfilter.DigestArray(str(tmp_path / "x"))
    assert sorted(array.probe(np.array([9, 5, 9, 9, 7], np.uint64), asked)) == [(0, 2), (0, 3), (1, 1), (2, 4)]


# --- ranked search ------------------------------------------------------------------------------------------


def searched_brute(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    found = [(i, split(t)) for i, t in docs]
    held = [x for x in found if x[1]]
    documents, total = len(held), sum(len(w) for _, w in held)
    df = collections.Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in held:
            m, tf = 50 + 50 * len(w) * documents // total, collections.Counter(w)
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(split(text)) if tf[t])
            if s:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("cell,fan,seeds", [(64, 2, 10), (17, 3, 1000), (1 << 15, 8, 3)])
def test_search_against_brute_force(spark, cell, fan, seeds):
    rng = random.Random(cell)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ÉA", "naïve", "x1"]
    text = lambda n: "".join(rng.choice(vocabulary[: rng.choice([5, 20, 44])]).upper() + rng.choice([" ", ", ", "_", "\n"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(80)] + [(7, docs[7][1])] * 3 + [(None, docs[7][1]), (2000, None), (2001, ".,;"), (2002, text(4000))]
    rng.shuffle(docs)
    items = [(i, text(rng.randint(1, 9))) for i in range(9)] + [(20, docs[0][1]), (21, None), (22, ""), (23, "unheardof"), (24, "w1 w1 w1")]
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, n string, ids int").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit("q"))
    got = [tuple(r) for r in lexsearch.search(frame, asked, 12, cell, fan, seeds).orderBy("item_id", "rank").collect()]
    assert got == searched_brute(docs, items, 12)
    assert lexsearch.search(frame.limit(0), asked).count() == 0 and lexsearch.search(frame, asked.limit(0)).count() == 0


def test_search_prunes():
    """Rare terms in few ranges: the tree leads there without scoring the rest."""
    rng = np.random.default_rng(3)
    n = 20_000
    term = np.where(np.arange(n) // 50 == 77, 1, 0)
    tree = lexsearch.MaxTree(np.arange(n), np.arange(n + 1), term, rng.integers(1, 1000, n), 2)
    best, scored = tree.best(np.array([1]), np.array([0, 10]), 10)
    assert len(best) == 10 and all(3850 <= i < 3900 for _, i in best) and scored < 100


@needs_data
@pytest.mark.parametrize("name", ["op11_lexsearch", "op12_urlfilter"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    found = e.queries()[name](spark, DATA)
    columns, key = sorted(found.columns), lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key)
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({e.oracle_sql()[name]})").fetchall(), key=key) and got
