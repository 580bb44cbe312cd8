"""Every operator and stage on tables with clashing columns, repeated rows, very long texts, and no rows at all."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import fingerprint, langid, mixing, packing, pagetext, pii, simhash, tokencount, topk, toxicity
from tests.llm.test_operators import words

DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ["_text", "_row", "id", "k1", "node", "fp", "key", "label", "src", "size", "h", "b1", "taken", "row", "score", "lang_pred", "spans", "class_id", "bin", "bucket", "file", "ordinal", "data", "toxic_", "_salt", "text_", "w"]


def rows():
    en = "the house is over there and that is what they said with this big old garden mail me at a.b@c.example.com"
    de = "das haus ist da und das ist nicht was sie mit dem garten gesagt haben"
    out = [(i, f"{en if i % 2 else de} {words(i, 30)}", "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(40)]
    out += [(50, out[3][1], "en", "s0", 1)] * 3 + [(60, None, None, None, None), (None, out[4][1], "de", None, 2), (61, "", "en", "s1", 0)]
    return out + [(70, " ".join(words(k, 900) for k in range(60)) + " x" * 3000, "en", "s2", 9), (71, "y" * 200_000, "de", "s2", 9)]


def models(spark, docs):
    labels = docs.filter("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    return langid.train(docs), toxicity.train(docs, labels)


OPERATORS = {
    "near_duplicates": lambda docs, m: simhash.near_duplicates(docs),
    "keep_one": lambda docs, m: simhash.keep_one(docs),
    "pack": lambda docs, m: packing.pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
    "classified": lambda docs, m: fingerprint.classified(docs),
    "mix": lambda docs, m: mixing.mix(docs),
    "resample": lambda docs, m: mixing.resample(docs),
    "count_documents": lambda docs, m: tokencount.count_documents(docs).select("doc_id", "n_tokens"),
    "toxicity": lambda docs, m: toxicity.score(docs, m[1]).withColumn("score", F.round("score", 9)),
    "predict": lambda docs, m: langid.predict(docs, m[0]).withColumn("score", F.round("score", 6)),
    "keep_known": lambda docs, m: langid.keep_known(docs),
    "detect": lambda docs, m: pii.detect(docs),
    "mask": lambda docs, m: pii.mask(docs),
}
#: Operators that give docs' own columns back.
STAGES = ("keep_one", "resample", "keep_known", "mask")


@pytest.fixture(scope="module")
def tables(spark):
    plain = spark.createDataFrame(rows(), DDL).cache()
    odd = plain
    for i, name in enumerate(CLASHES):
        odd = odd.withColumn(name, F.lit(f"{name}{i}") if i % 2 else F.array(F.lit(i)))
    return plain, odd.cache(), models(spark, plain)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_input(tables, name):
    plain, odd, trained = tables
    run = OPERATORS[name]
    want, got = run(plain, trained), run(odd, trained)
    assert got.columns == (odd.columns if name in STAGES else want.columns)
    if name not in ("near_duplicates",):
        shown = got.select(*want.columns)
    else:
        shown, want = got.select("doc_id", "fp", "component_id"), want.select("doc_id", "fp", "component_id")
    assert sorted(map(str, shown.collect())) == sorted(map(str, want.collect())) and want.count() > 0
    assert run(odd.limit(0), trained).count() == 0


def test_odd_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "https://h.x/1", "<article>a</article>", "r", 1), (1, "https://h.x/1", "<article>a</article>", "r", 1), (2, None, None, "k", 2), (None, "u", "<p>" + "z " * 100_000, "s", 3)], "page_id long, url string, html string, row string, key int")
    got = sorted((r.page_id or 0, r.text) for r in pagetext.extract(pages).collect())
    assert got == [(0, ("z " * 100_000).strip()), (1, "a"), (1, "a"), (2, "")]
    vectors = spark.createDataFrame([(i % 3, [float(i % 3)] * 4, "v") for i in range(9)] + [(7, None, "v")], "vec_id long, embedding array<double>, g string")
    v = topk.integer_vectors(vectors)
    found = topk.top_k(v, v.filter("vec_id = 0"), 4, 2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted([(0, n, i, 0) for _ in range(3) for n, i in ((1, 1), (2, 1), (3, 1), (4, 2))])
