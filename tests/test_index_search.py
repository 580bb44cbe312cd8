"""Ranking corpus with exact scores, upserts, the items feed, chunks."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import chunk, index
from quarry.operators.search import SearchIndex, bm25, bounded_blocks, pruned_bm25, search, search_soft, strict_terms, surviving_blocks

SITE = "s"


def make(spark, pages, products=None):
    """pages: (url, title, heading, text)."""
    rows = spark.createDataFrame([(SITE, u, 0, t, h, x) for u, t, h, x in pages], "site string, page_url string, ord int, title string, heading_path string, text string")
    out = SearchIndex(rows, index.postings(rows, ["site", "page_url", "ord"], index.PAGE_WEIGHTS), index.corpus_stats(rows, index.PAGE_WEIGHTS))
    if products is not None:
        p = spark.createDataFrame([(SITE, u, n, d, 1.0, "USD", "in_stock", "", m) for u, n, d, m in products], "site string, page_url string, name string, description string, price double, currency string, availability string, image string, extraction_method string")
        out.products, out.product_postings, out.product_stats = p, index.product_postings(p), index.corpus_stats(p, index.PRODUCT_WEIGHTS)
    return out


def brute(pages, query, weights=(5, 2, 1)):
    import math
    import re

    docs = [[re.findall(r"\w+", c.lower()) for c in p[1:]] for p in pages]
    n, size = len(docs), [sum(map(len, d)) for d in docs]
    avg = sum(size) / n
    out = {}
    for q in query.split():
        f = [sum(w * c.count(q) for w, c in zip(weights, d, strict=True)) for d in docs]
        have = sum(x > 0 for x in f)
        idf = math.log((n - have + 0.5) / (have + 0.5))
        idf = idf if idf > 0 else 1e-6
        for i, x in enumerate(f):
            out.setdefault(i, []).append(-idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size[i] / avg)) if x else None)
    return {pages[i][0]: sum(v) for i, v in out.items() if None not in v}


PAGES = [
    ("blue", "Blue running shoes", "Shop > Shoes", "light blue shoes for running far and wide"),
    ("red", "Red running shoes", "Shop > Shoes", "red shoes for daily running"),
    ("hike", "Hiking guide", "Guides", "boots and blue shoes for hiking in the hills all day long"),
    ("tea", "Tea", "Kitchen", "green tea leaves"),
    ("cup", "Cups", "Kitchen", "a cup for tea"),
]


@pytest.mark.parametrize("query", ["tea", "hiking", "blue shoes", "running shoes", "kitchen tea tea"])
def test_exact_scores(spark, query):
    wanted = {}
    for url, rank in brute(PAGES, query).items():
        hay = " ".join(next(p for p in PAGES if p[0] == url)[1:]).lower()
        adj = rank - (3 if query in hay else 0)
        wanted[url] = max(0, -adj) / (1 + max(0, -adj))
    got = {r.url: r.score for r in search(make(spark, PAGES), query).collect()}
    assert got == pytest.approx(wanted, abs=1e-12)


def test_product_methods_and_merge(spark):
    products = [("blue", "Blue shoes", "d", "json-ld"), ("x", "Blue shoes", "d", "heuristic")]
    got = search(make(spark, PAGES, products), "blue shoes").collect()
    assert [(r.url, round(r.score, 5)) for r in got if r.type == "product"] == [("blue", 0.83333), ("x", 0.75)]
    assert got[0].url == "blue"
    assert [(r.url, r.type) for r in got if r.url == "blue"] == [("blue", "product")]
    assert {r.type for r in search(make(spark, PAGES, products), "blue shoes", kind="page").collect()} == {"page"}
    assert {r.type for r in search(make(spark, PAGES, products), "blue shoes", kind="product").collect()} == {"product"}


def test_soft_and_empty(spark):
    pages = [("a", "Echipa de marketing externalizat", "", "text"), ("b", "Altceva", "", "text")]
    ix = make(spark, pages)
    assert search(ix, "echipă marketing externalizată").count() == 0
    assert [r.url for r in search_soft(ix, "echipă marketing externalizată").collect()] == ["a"]
    assert search(ix, " … ") is None
    assert search(ix, "nothing").count() == 0
    assert len(search(make(spark, PAGES), "shoes", 1).collect()) == 1


def test_blocks_that_cannot_compete_are_not_read(spark):
    """Frequent terms over two sites: the same candidates as from all postings, from a part of the blocks."""
    rng = random.Random(4)
    common = [f"w{i}" for i in range(6)]
    pages = [(f"s{i % 2}", f"u{i}", 0, "", "", " ".join(rng.choices(common, [32, 16, 8, 4, 2, 1], k=rng.randint(30, 60))) + " r0" * (i % 3 == 0) + " r1" * (i % 4 == 0) + " r0 r1" * (20 if i % 97 == 0 else 0)) for i in range(1500)]
    rows = spark.createDataFrame(pages, "site string, page_url string, ord int, title string, heading_path string, text string")
    stats, keys = index.corpus_stats(rows, index.PAGE_WEIGHTS), ["site", "page_url", "ord"]
    found = index.by_term(index.postings(rows, keys, index.PAGE_WEIGHTS), 7).cache()
    lexicon, bounds = index.lexicon(found), index.block_bounds(found)
    for query, most in (("r0 r1", 10), ("w0 w1", 50), ("w3 w3 w2", 5), ("w1 nowhere", 5)):
        terms = strict_terms(query)
        want = {}
        for r in bm25(found, stats, keys, terms).collect():
            want.setdefault(r.site, []).append((r["rank"], r.page_url))
        got = {}
        for r in pruned_bm25(found, lexicon, bounds, stats, keys, terms, most, seeds=4).collect():
            got.setdefault(r.site, []).append((r["rank"], r.page_url))
        assert {s: sorted(x)[:most] for s, x in got.items()} == {s: sorted(x)[:most] for s, x in want.items()}
    counts, blocks = bounded_blocks(lexicon, bounds, stats, strict_terms("r0 r1"))
    ranked = bm25(found, stats, keys, strict_terms("r0 r1")).join(found.select("site", "page_url", "block").distinct(), ["site", "page_url"])
    left = surviving_blocks(blocks, lambda of: ranked.join(of.select("site", "block"), ["site", "block"], "left_semi"), 5, 4)
    assert 0 < left.count() < 0.7 * blocks.count() and blocks.count() < 0.5 * 2 * 128


def test_postings_need_no_shuffle(spark):
    rows = spark.createDataFrame([("s", "a", 0, "Tea Time", "", "tea, time; time"), ("s", "b", 1, None, "x", "")], "site string, page_url string, ord int, title string, heading_path string, text string")
    found = index.postings(rows, ["site", "page_url", "ord"], index.PAGE_WEIGHTS)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    assert sorted((r.page_url, r.term, r.f, r.doc_len) for r in found.collect()) == [("a", "tea", 6.0, 5), ("a", "time", 7.0, 5), ("b", "x", 2.0, 1)]


def test_soft_tiers_in_one_plan(spark):
    pages = [("a", "Marketing externalizat", "", "x"), ("b", "Marketing externe", "", "x"), ("c", "Market", "", "extern")]
    ix = make(spark, pages)
    ix.chunk_lexicon = index.lexicon(ix.chunk_postings)
    found = lambda q: [r.url for r in search_soft(ix, q).collect()]
    assert found("marketing externalizat") == ["a"] and found("marketing externalizata") == ["a"] and found("marketingul externalizatul") == ["a"]
    assert sorted(found("marketing exter")) == ["a", "b"] and found("externalize nothing") == []


def pages_of(spark, rows):
    ddl = "site string, url string, title string, hash string, crawled_at timestamp, etag string, seq bigint"
    return spark.createDataFrame([(SITE, u, t, "h", dt.datetime(2024, 1, 1), "", s) for u, t, s in rows], ddl)


def products_of(spark, rows):
    ddl = "site string, page_url string, name string, price double, currency string, availability string, extraction_method string, verified_at timestamp, seq bigint"
    return spark.createDataFrame([(SITE, u, n, 1.0, "USD", "in_stock", "json-ld", None, s) for u, n, s in rows], ddl)


def test_items(spark):
    p, q = pages_of(spark, [("a", "A", 1), ("b", "B", 2), ("c", "C", 4)]), products_of(spark, [("b", "Bee", 3)])
    feed = lambda *a: [(r.url, r.type, r.title, r.seq) for r in index.items(p, q, *a).collect()]
    assert feed(0) == [("a", "page", "A", 1), ("b", "product", "Bee", 3), ("c", "page", "C", 4)]
    assert feed(3) == [("c", "page", "C", 4)]
    assert feed(0, 200, "page") == [("a", "page", "A", 1), ("c", "page", "C", 4)]
    assert feed(0, 1, "product") == [("b", "product", "Bee", 3)]
    assert feed(0, 1, "other") == [("a", "page", "A", 1)]
    assert index.next_cursor(index.items(p, q, 9), 9) == 9


def test_seq_and_upsert(spark):
    new = spark.createDataFrame([(f"u{i:03}",) for i in range(100)], "url string")
    got = index.assign_seq(new, ["url"], 10).collect()
    assert sorted((r.url, r.seq) for r in got) == [(f"u{i:03}", 11 + i) for i in range(100)]
    p = pages_of(spark, [("a", "A", 1), ("b", "B", 2)])
    assert sorted((r.url, r.title) for r in index.keep_latest(p, pages_of(spark, [("a", "A2", 3)]), ["site", "url"]).collect()) == [("a", "A2"), ("b", "B")]
    old = index.ensure_columns(p.drop("seq"), {"seq": F.lit(0).cast("bigint"), "etag": F.lit("")})
    assert sorted(r.seq for r in index.backfill_seq(old, "url", 5).collect()) == [6, 7]


def test_chunks(spark):
    def run(md, target=1200, overlap=100):
        return [(r.heading_path, r.text) for r in chunk.chunk_pages(spark.createDataFrame([(1, md)], "id int, markdown string"), ["id"], "markdown", target, overlap).orderBy("ord").collect()]

    assert run("# Shoes\nall\n## Running\nfast\n## Casual\nslow") == [("Shoes", "all"), ("Shoes > Running", "fast"), ("Shoes > Casual", "slow")]
    assert run("intro\n# A\n## B\nb\n# C\nc\n```\n# D\nd") == [("", "intro"), ("A > B", "b"), ("C", "c\n```"), ("D", "d")]
    assert [len(t) for _, t in run("a" * 3000, 1000, 100)] == [1000, 1000, 1000, 300]
    assert run(" \n\n") == [] and run("") == []


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab c\nd", min_size=1, max_size=400), st.integers(60, 120))
def test_chunks_cover(spark, text, target):
    got = chunk.chunk_texts(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], "text", target, 55).orderBy("ord").collect()
    assert all(r.text in text for r in got)
    if text.strip():
        assert text.strip().startswith(got[0].text) and text.strip().endswith(got[-1].text)
        at = 0
        for r in got:
            found = text.find(r.text, max(0, at - 200))
            assert found >= 0
            at = found + len(r.text)


def test_lists_hold_what_postings_do(spark):
    """Lists of terms by block against postings, lexicon, bounds and statistics made row by row; no shuffle beside dealing the pages."""
    rng = random.Random(7)
    some = lambda n: " ".join(rng.choices([f"w{i}" for i in range(30)], k=n))
    rows = [(f"s{i % 2}", f"u{i // 3}", i % 3, some(2), some(1) if i % 5 == 0 else None, some(rng.randint(0, 40)) if i % 7 else "...") for i in range(600)]
    rows = spark.createDataFrame(rows, "site string, page_url string, ord int, title string, heading_path string, text string")
    keys = ["site", "page_url", "ord"]
    made = index.term_lists(index.dealt_by_block(rows, 5, 4), index.PAGE_WEIGHTS, 5)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = index.lists_read(made.cache(), keys)
    wanted = index.postings(rows, keys, index.PAGE_WEIGHTS).withColumn("block", index.block_of(bits=5))
    both = {"postings": wanted.select(*got["postings"].columns), "lexicon": index.lexicon(wanted), "bounds": index.block_bounds(wanted), "stats": index.corpus_stats(rows, index.PAGE_WEIGHTS)}
    for name, df in both.items():
        assert sorted(map(tuple, got[name].collect())) == sorted(map(tuple, df.select(*got[name].columns).collect()))


def test_long_texts_take_time_by_their_length():
    """24 million letters: each window is cut once, none looks through the text before it."""
    import time

    began = time.monotonic()
    assert sum(1 for _ in chunk.windows("ab cd " * 4_000_000, 1200, 1080)) > 20_000
    assert time.monotonic() - began < 20


def test_headings_as_lines_have_them():
    text = "intro\n# A \r\n#no\n####### no\n## B\n\n### C\nc\n# D\n \n## E\ne"
    assert list(chunk.sections(text)) == [("", "intro"), ("A", "#no\n####### no"), ("A > B > C", "c"), ("D > E", "e")]
