"""The pipeline's stages one after another, each against a brute-force reading of its input."""

import re

import numpy as np

import corpus_pipeline as cp
from quarry.llm.queries import queries
from tests.llm.test_operators import check_packing

EN, DE = "the house is over there and that is what they said with this big old garden", "das haus ist da und das ist nicht was sie mit dem garten gesagt haben"


def test_stages(spark, tmp_path):
    rows = []
    for i in range(120):
        r = np.random.default_rng(i)
        text = " ".join(r.choice((EN if i % 2 else DE).split(), 60))
        rows.append((i, text + (" mail a.b@c.example.com now" if i % 10 == 0 else ""), "en" if i % 2 else "de", f"s{i % 4}", len(text)))
    rows += [(200 + i, rows[3][1], "en", "s1", 1) for i in range(5)] + [(300, "12 34", "en", "s1", 5), (301, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), ["doc_id", "text", "lang", "source", "n_chars"]
    out = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        out[name] = docs.collect()
        if k < 4:
            assert docs.columns == columns
    assert sorted(r.doc_id for r in out["language_id"]) == sorted(i for i, *_ in rows if i < 300)
    assert sorted(r.doc_id for r in out["near_dedup"]) == list(range(120))
    assert all(re.sub(r"\S+@\S+", "<email>", dict((r[0], r[1]) for r in rows)[r.doc_id]) == r.text for r in out["pii"])
    texts = {r.doc_id: r.text for r in out["pii"]}
    assert {r.doc_id for r in out["mixing"]} <= set(texts) and all(texts[r.doc_id] == r.text for r in out["mixing"])
    assert check_packing(before, out["packing"]) <= 128
    assert len(out["packing"]) == cp.run(spark, str(tmp_path)).count()


def test_queries_are_registered():
    assert sorted(queries()) == sorted(f"op{n}_{name}" for n, name in enumerate(["simhash", "topk", "packing", "fingerprint", "mixing", "tokencount", "toxicity", "langid", "pagetext", "pii"], 1))
