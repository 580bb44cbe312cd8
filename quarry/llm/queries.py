"""The registered query of each operator, under the operators' contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import fingerprint, langid, lexsearch, mixing, packing, pagetext, pii, runs, simhash, tokencount, topk, toxicity, urlfilter
from quarry.llm.common import held_out, lean, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.classified(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_pagetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_list", 256).alias("base_sha256"), F.col("span_list").alias("spans"))


def op11_lexsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The contract's rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op12_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.build(rules))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = runs.find_runs(docs.select("doc_id", runs.planted().alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shortness"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.shortness")
    exponent = F.floor(1000 * length / F.col("best.period"))
    return found.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def _lean(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lean(spark)
        return run(spark, sf_dir)

    return query


def queries() -> dict:
    found = {
        "op1_simhash": op1_simhash,
        "op2_topk": op2_topk,
        "op3_packing": op3_packing,
        "op4_fingerprint": op4_fingerprint,
        "op5_mixing": op5_mixing,
        "op6_tokencount": op6_tokencount,
        "op7_toxicity": op7_toxicity,
        "op8_langid": op8_langid,
        "op9_pagetext": op9_pagetext,
        "op10_pii": op10_pii,
        "op11_lexsearch": op11_lexsearch,
        "op12_urlfilter": op12_urlfilter,
        "op13_runs": op13_runs,
    }
    return {name: _lean(run) for name, run in found.items()}


#: Every pair of a query and another row, scored and ranked.
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

#: Targets by water filling; each source's rows in the order of their hashes, up to what is left of its target.
MIXING_SQL = """
WITH sized AS (
  SELECT doc_id, source AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
by_source AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY src),
weighted AS (SELECT *, ([1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE])[CAST((row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, source_size * 3.0::DOUBLE AS cap FROM by_source),
reached AS (SELECT *, cap / w AS reach, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM weighted),
levels AS (
  SELECT *, (total - sum(cap) OVER up) / sum(w) OVER down AS level, lead(reach) OVER (ORDER BY reach, src NULLS FIRST) AS next FROM reached
  WINDOW up AS (ORDER BY reach, src NULLS FIRST ROWS UNBOUNDED PRECEDING), down AS (ORDER BY reach, src NULLS FIRST ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT CASE WHEN min(total) / sum(w) <= min(reach) THEN min(total) / sum(w) ELSE coalesce(min(level) FILTER (WHERE level >= reach AND level <= next), max(reach)) END AS level FROM levels),
targets AS (SELECT src, source_size, least(cap, w * (SELECT level FROM level)) AS target FROM weighted),
plan AS (
  SELECT *, CAST(floor(target) AS BIGINT) - times * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM targets)),
places AS (
  SELECT *, sum(words) OVER (PARTITION BY src ORDER BY h) - words AS before FROM (SELECT src, h, sum(size) AS words, count(*) AS sharers FROM sized GROUP BY src, h)),
edge AS (
  SELECT p.src, p.h AS edge_at, CAST(floor((rest - before) / sharers) AS BIGINT) AS part FROM places p JOIN plan ON p.src IS NOT DISTINCT FROM plan.src
  WHERE before <= rest AND before + words > rest)
SELECT doc_id, size, source_size, target,
  CAST(times * size + CASE WHEN h < edge_at THEN size WHEN h = edge_at THEN least(part, size) ELSE 0 END AS BIGINT) AS taken
FROM sized JOIN plan ON sized.src IS NOT DISTINCT FROM plan.src LEFT JOIN edge ON sized.src IS NOT DISTINCT FROM edge.src"""

#: Every document scored for every item.
LEXSEARCH_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
e AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM e),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM e) GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, totals GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""

URLFILTER_SQL = """
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""


def oracle_sql() -> dict:
    return {"op2_topk": TOPK_SQL, "op5_mixing": MIXING_SQL, "op11_lexsearch": LEXSEARCH_SQL, "op12_urlfilter": URLFILTER_SQL}
