"""The registered queries over the driver's smallest tables, each against SQL or a brute-force reading of its contract."""

import collections
import hashlib
import os
import zlib

import numpy as np
import pytest

import __spark_entry__ as e
from quarry.llm import pagetext, tokencount
from tests.llm.test_operators import base_brute, components_brute, fp_brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def documents():
    import pyarrow.parquet as pq

    return {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}


def run(spark, name):
    return e.queries()[name](spark, DATA).collect()


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("name", ["op2_topk", "op5_mixing"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    columns = sorted(e.queries()[name](spark, DATA).columns)
    got = sorted(tuple(r[c] for c in columns) for r in run(spark, name))
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({e.oracle_sql()[name]})").fetchall()) and got


def test_op1(spark, documents):
    fps = {i: fp_brute(r["text"]) for i, r in documents.items()}
    want = components_brute(fps)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op1_simhash")) == [(i, f"{fps[i]:016x}", want[i]) for i in sorted(fps)]


def test_op3(spark, documents):
    from tokenizers import Tokenizer

    from quarry.llm.common import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for i, r in documents.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in run(spark, "op3_packing"):
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        assert sum(n for _, n in pieces[i]) == len(own) and all(a + n == b for (a, n), (b, _) in zip(sorted(pieces[i]), sorted(pieces[i])[1:], strict=False))
    padded, short, used = 0, 0, 0
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        size = sum(n for _, n in own)
        assert size <= 4096
        padded += 0 if size & (size - 1) == 0 else 4096 - size
        short, used = short + (size < 2048), used + 4096 - size
    # the parts of one last sequence may be sequences of their own; none but those are short
    assert padded <= 0.01 * sum(map(len, ids.values())) and short <= 12 and used - 12 * 4096 <= 0.01 * sum(map(len, ids.values()))


def test_op4(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op4_fingerprint")}
    order = sorted(documents, reverse=True)
    by = collections.defaultdict(list)
    for i, r in got.items():
        by[r.fingerprint].append(i)
    for k, i in enumerate(order):
        text, following = (documents[j]["text"] or "" for j in (i, order[(k + 1) % len(order)]))
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (got[i].class_id, got[i].copies) == (min(by[got[i].fingerprint]), len(by[got[i].fingerprint]))
        assert got[i].near_next == float(got[i].fingerprint == got[order[(k + 1) % len(order)]].fingerprint)
        assert got[i].near_edited == float(got[i].fingerprint == got[i].edited_fingerprint)


def test_op6(spark, documents):
    encode = tokencount.encoder().encode_ordinary
    assert sorted((r.doc_id, r.n_tokens) for r in run(spark, "op6_tokencount")) == sorted((i, len(encode(r["text"] or ""))) for i, r in documents.items())


def test_op7(spark, documents):
    got = run(spark, "op7_toxicity")
    assert sorted((r.doc_id, r.held_out) for r in got) == sorted((i, held(i)) for i in documents)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_op8(spark, documents):
    got = run(spark, "op8_langid")
    assert sorted((r.doc_id, r.held_out) for r in got) == sorted((i, held(i)) for i in documents)
    told = {r["lang"] for r in documents.values()} | {"und"}
    assert all(0 <= r.score <= 1 and r.lang_pred in told and (r.lang_pred == "und") == (not any(c.isalpha() for c in documents[r.doc_id]["text"] or "")) for r in got)
    known = [r for r in got if r.held_out and documents[r.doc_id]["lang"] and r.lang_pred != "und"]
    assert sum(r.lang_pred == documents[r.doc_id]["lang"] for r in known) >= 0.95 * len(known)


def test_op9(spark):
    import pyarrow.parquet as pq

    pages = {r["page_id"]: r for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist()}
    for r in run(spark, "op9_pagetext"):
        assert r.url == pages[r.page_id]["url"] and r.n_chars == len(r.text)
        # the article's own element, by string search alone: its words in order
        inner = (pages[r.page_id]["html"] or "").partition("<article>")[2].partition("</article>")[0]
        spaced = pagetext.re.sub(r"</?(?:p|h1|br|li|ul|div)\b[^>]*>", " ", inner)
        assert r.text.split() == pagetext.entities.unescape(pagetext.re.sub(r"<[^>]*>", "", spaced)).split()


def test_op10(spark, documents):
    for r in run(spark, "op10_pii"):
        want = base_brute(documents[r.doc_id]["text"] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in ("email", "ip", "card", "phone")]
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))


def test_pipeline(spark, documents):
    rows = run(spark, "pipeline")
    assert {r.doc_id for r in rows} <= set(documents) and rows
