"""Stored tables: items feed, statistics, upserts, numbering, exports, metrics, scalar functions on products."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.engine import Engine
from quarry.functions import text as T
from quarry.operators import index
from quarry.plans import sqltext as S
from quarry.plans import tables
from quarry.sources import export
from quarry.sources.tables import BUCKETS, Store, bucket_of, shared_folder
from quarry.streaming import changefeed


def _items(since: int, limit: int, kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sold = tables.products(spark, sf_dir).filter("p_partkey % 3 <> 0")  # some pages have no product
        feed = index.items(tables.pages(spark, sf_dir), sold, since, limit, kind)
        return feed.select("url", "type", "title", "hash", "seq", "price", "availability", "extraction_method")

    p, q = S.pages(), f"SELECT * FROM ({S.products()}) WHERE p_partkey % 3 <> 0"
    keep = {"page": "AND q.page_url IS NULL", "product": "AND q.page_url IS NOT NULL"}.get(kind, "")
    sql = f"""SELECT p.url, CASE WHEN q.page_url IS NULL THEN 'page' ELSE 'product' END AS type, CASE WHEN coalesce(q.name, '') <> '' THEN q.name ELSE p.title END AS title, p.hash,
      greatest(p.seq, coalesce(q.seq, 0)) AS seq, q.price, q.availability, q.extraction_method FROM ({p}) p LEFT JOIN ({q}) q ON p.url = q.page_url
      WHERE greatest(p.seq, coalesce(q.seq, 0)) > {since} {keep} ORDER BY seq, url LIMIT {limit}"""
    return run, sql


def site_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.when(F.col("p_partkey") % 4 == 0, F.expr(f"timestamp'{tables.CRAWLED}' + make_interval(0, 0, 0, 0, 0, 0, p_partkey % 500)"))
    s = index.site_stats(tables.pages(spark, sf_dir), tables.chunks(spark, sf_dir), tables.products(spark, sf_dir).withColumn("verified_at", seen))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    methods_of = F.array_join(F.transform(F.array_sort(F.map_entries("extraction_methods")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return s.select("site", "pages", "chunks", "products", at("first_crawled"), at("last_crawled"), at("last_verified"), methods_of.alias("methods"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.extraction_methods(tables.products(spark, sf_dir)).select("extraction_method", "n")


def stats_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_stats() from the shares of 32 buckets."""
    seen = F.when(F.col("p_partkey") % 4 == 0, F.expr(f"timestamp'{tables.CRAWLED}' + make_interval(0, 0, 0, 0, 0, 0, p_partkey % 500)"))
    p = tables.pages(spark, sf_dir).withColumn("bucket", bucket_of("url"))
    c = p.select("site", F.col("url").alias("page_url"), "bucket")  # a row for each page's first chunk
    q = tables.products(spark, sf_dir).withColumn("verified_at", seen).withColumn("bucket", bucket_of("page_url"))
    s = index.merged_stats(index.partial_stats(p, c, q, ("bucket",)))
    methods_of = F.array_join(F.transform(F.array_sort(F.map_entries("extraction_methods")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return s.select("site", "pages", "products", F.date_format("last_verified", "yyyy-MM-dd HH:mm:ss").alias("last_verified"), methods_of.alias("methods"))


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as crawled pages, a third with products, written to a stored site; then every seventh again, changed, a fifth of
    these with products. The pages as stored, with their numbers, chunks and products."""
    engine = Engine(spark, Config(data_dir=f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"))
    named = "named_struct('name', concat('p', doc_id), 'description', '', 'price', cast(doc_id as double), 'currency', 'USD', 'availability', '', 'image', '', 'extraction_method', 'json-ld', 'raw_json', '')"
    d = tables.pages(spark, sf_dir).withColumnRenamed("text", "markdown")
    first = d.withColumn("product", F.expr(f"if(doc_id % 3 = 0, {named}, null)"))
    engine.write_pages(tables.SITE, first.drop("seq"))
    again = _changed(d.withColumn("text", F.col("markdown"))).drop("text").withColumn("product", F.expr(f"if(doc_id % 5 = 0, {named}, null)"))
    engine.write_pages(tables.SITE, again.drop("seq"))
    snap = engine.store.snapshot(tables.SITE)
    n = snap.read("chunks").groupBy(F.col("page_url").alias("url")).agg(F.count("*").alias("chunks"))
    sold = Engine.products_of(snap).select(F.col("page_url").alias("url"), "price", F.col("seq").alias("product_seq"))
    return snap.read("pages").join(n, "url", "left").join(sold, "url", "left").select("url", "title", "hash", "seq", F.coalesce("chunks", F.lit(0)).alias("chunks"), "price", "product_seq")


_STORED = f"""WITH p AS ({S.pages()}),
  a AS (SELECT doc_id, row_number() OVER (ORDER BY url) AS seq FROM p),
  b AS (SELECT doc_id, (SELECT count(*) FROM p) + row_number() OVER (ORDER BY url) AS seq FROM p WHERE doc_id % 3 = 0),
  done AS (SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS n),
  c AS (SELECT doc_id, (SELECT n FROM done) + row_number() OVER (ORDER BY url) AS seq FROM p WHERE doc_id % 7 = 0),
  d AS (SELECT doc_id, (SELECT n FROM done) + (SELECT count(*) FROM c) + row_number() OVER (ORDER BY url) AS seq FROM p WHERE doc_id % 35 = 0),
  k AS (SELECT doc_id, count(*) AS chunks FROM ({S.chunks()}) GROUP BY doc_id),
  u AS (SELECT url, CASE WHEN doc_id % 7 = 0 THEN title || ' again' ELSE title END AS title, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE hash END AS hash FROM p)
  SELECT u.url, u.title, u.hash, coalesce(c.seq, a.seq) AS seq, coalesce(k.chunks, 0) AS chunks,
    CASE WHEN p.doc_id % 35 = 0 OR (p.doc_id % 7 <> 0 AND p.doc_id % 3 = 0) THEN CAST(p.doc_id AS DOUBLE) END AS price, CASE WHEN p.doc_id % 7 = 0 THEN d.seq ELSE b.seq END AS product_seq
  FROM p JOIN u USING (url) JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN k USING (doc_id)"""


def verified_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of a stored site, every tenth seen again at another price: laid over on read, nothing rewritten."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    sold = tables.products(spark, sf_dir).withColumn("bucket", bucket_of("page_url"))
    store.commit(store.snapshot(tables.SITE), {"products": sold.repartition("bucket")}, list(range(BUCKETS)))
    seen = sold.filter("p_partkey % 10 = 0").withColumn("price", F.col("price") + 1).withColumn("verified_at", F.expr(f"timestamp'{tables.CRAWLED}'")).withColumn("seq", F.col("seq") + 1_000_000)
    store.commit(store.snapshot(tables.SITE), {"verified": seen.repartition("bucket")}, list(range(BUCKETS)))
    return Engine.products_of(store.snapshot(tables.SITE)).select("page_url", "price", "seq", F.col("verified_at").isNotNull().alias("verified"))


def _changed(df: DataFrame) -> DataFrame:
    """A second snapshot: every seventh page changed, with later numbers."""
    return df.filter("doc_id % 7 = 0").withColumn("title", F.concat(F.col("title"), F.lit(" again"))).withColumn("hash", F.sha2(F.concat("text", F.lit("!")), 256)).withColumn("seq", F.col("seq") + 1_000_000)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = tables.pages(spark, sf_dir)
    return index.keep_latest(old, _changed(old), ["site", "url"]).select("url", "title", "hash", "seq")


_UPSERT = f"SELECT url, CASE WHEN doc_id % 7 = 0 THEN title || ' again' ELSE title END AS title, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE hash END AS hash, CASE WHEN doc_id % 7 = 0 THEN seq + 1000000 ELSE seq END AS seq FROM ({S.pages()})"


def product_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.products(spark, sf_dir)
    gone = p.filter("p_partkey % 11 = 0").select("site", "page_url")
    new = p.filter("p_partkey % 5 = 0").withColumn("price", F.col("price") + 1).withColumn("seq", F.col("seq") + 1_000_000)
    return index.upsert_products(p, new, gone).select("page_url", "price", "seq")


def page_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c, q = tables.pages(spark, sf_dir), tables.chunks(spark, sf_dir), tables.products(spark, sf_dir)
    left = index.delete_pages(p, c, q, p.filter("doc_id % 3 = 0"))
    counts = [t.agg(F.lit(name).alias("kind"), F.count("*").alias("n")) for name, t in zip(("pages", "chunks", "products"), left, strict=True)]
    return counts[0].union(counts[1]).union(counts[2])


def seq_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.pages(spark, sf_dir).withColumn("seq", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(F.col("seq")).cast("bigint"))
    return index.backfill_seq(p, "url", 5_000_000).select("url", "seq")


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = export.latency_histogram(tables.read(spark, sf_dir, "events").select((F.col("value") / 10).alias("v")), "v")
    return h.select("le", "cumulative", "count", F.round("sum", 3).alias("sum"))


_BOUNDS = ", ".join(f"('{b:g}', {b}::DOUBLE)" for b in export.LATENCY_BOUNDS)
_LATENCY = f"""WITH e AS (SELECT value / 10 AS v FROM events), b(le, x) AS (VALUES {_BOUNDS}, ('+Inf', 'infinity'::DOUBLE))
  SELECT le, (SELECT count(*) FROM e WHERE v <= x) AS cumulative, (SELECT count(v) FROM e) AS count, (SELECT round(sum(v), 3) FROM e) AS sum FROM b"""


def export_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.pages(spark, sf_dir)
    lines = export.jsonl(index.all_chunks(tables.chunks(spark, sf_dir), p))
    return lines.select(*[F.get_json_object("value", f"$.{k}").alias(k) for k in ("url", "title", "lang", "text")], F.get_json_object("value", "$.ordinal").cast("bigint").alias("ordinal"), F.get_json_object("value", "$.heading_path").alias("heading_path"))


def export_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.all_chunks(tables.chunks(spark, sf_dir), tables.pages(spark, sf_dir))
    return rows.select("page_url", F.col("ord").cast("bigint").alias("ord"), "title", F.length("text").cast("bigint").alias("n"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.products(spark, sf_dir).withColumn("v", F.format_string("%.2f", F.col("price")))
    shown = (
        F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("$"), "v")).when(F.col("p_partkey") % 6 == 1, F.concat(F.regexp_replace("v", r"\.", ","), F.lit(" lei")))
        .when(F.col("p_partkey") % 6 == 2, F.concat(F.lit("1."), F.regexp_replace("v", r"\.", ","), F.lit(" €"))).when(F.col("p_partkey") % 6 == 3, F.concat(F.lit("£ 1,"), "v"))
        .when(F.col("p_partkey") % 6 == 4, F.lit("call for price")).otherwise(F.concat(F.lit("  "), "v", F.lit("  ")))
    )
    return d.select("p_partkey", shown.alias("shown")).select("p_partkey", T.price(F.col("shown")).alias("price"), T.currency(F.col("shown")).alias("currency"))


_PRICES = """SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN NULL WHEN 2 THEN ('1' || v)::DOUBLE WHEN 3 THEN ('1' || v)::DOUBLE ELSE v::DOUBLE END AS price,
  CASE p_partkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'RON' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' ELSE '' END AS currency FROM (SELECT p_partkey, printf('%.2f', p_retailprice) AS v FROM part)"""
_STOCK = [("https://schema.org/InStock", "in_stock"), ("http://schema.org/OutOfStock", "out_of_stock"), ("in stock", "in_stock"), ("SOLD OUT", "out_of_stock"), ("PreOrder", "in_stock"), ("oos", "out_of_stock"), ("Limited-Availability", "in_stock"), ("", "unknown"), ("soon", "unknown")]


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = F.element_at(F.array(*[F.lit(s) for s, _ in _STOCK]), (F.col("p_partkey") % len(_STOCK) + 1).cast("int"))
    return tables.products(spark, sf_dir).select("p_partkey", T.availability(says).alias("availability"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of changes, folded into the latest state of each user, read back."""
    base = f"{shared_folder(spark)}/changefeed-{uuid.uuid4().hex}"
    fields = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    changes = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(_stream_folder(spark, sf_dir, base))
    changefeed.keep_table(changes.withColumn("seq", F.col("event_id")), f"{base}/table", f"{base}/checkpoint", ["user_id"]).awaitTermination()
    return changefeed.read_table(spark, f"{base}/table").select("user_id", "event_id", "event_type", "value")


def _stream_folder(spark: SparkSession, sf_dir: str, base: str) -> str:
    """A folder that a file stream can follow: the log in four files, a micro-batch each."""
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4, "event_id").write.mode("append").parquet(f"{base}/log")
    return f"{base}/log"


def stale_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.crawl import stale_sites as due

    last = tables.read(spark, sf_dir, "events").groupBy("user_id").agg(T.rfc3339(F.max("ts")).alias("last_crawled"))
    last = last.withColumn("last_crawled", F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("last_crawled")))
    return due(last, F.expr("timestamp'2024-01-30 00:00:00'"), 24 * 3600).select("user_id")


QUERIES = {
    "items_feed": _items(0, 200, ""),
    "items_since": _items(500, 100, ""),
    "items_pages_only": _items(0, 200, "page"),
    "items_products_only": _items(0, 200, "product"),
    "site_stats": (site_stats, f"""SELECT '{S.SITE}' AS site, (SELECT count(*) FROM documents) AS pages, (SELECT count(*) FROM ({S.chunks()})) AS chunks, (SELECT count(*) FROM part) AS products,
        (SELECT strftime(max(TIMESTAMP '{tables.CRAWLED}' + to_seconds(p_partkey % 500)), '%Y-%m-%d %H:%M:%S') FROM part WHERE p_partkey % 4 = 0) AS last_verified,
        (SELECT string_agg(extraction_method || '=' || n, ',' ORDER BY extraction_method) FROM (SELECT extraction_method, count(*) AS n FROM ({S.products()}) GROUP BY 1)) AS methods,
        strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_crawled, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_crawled FROM (SELECT TIMESTAMP '{tables.CRAWLED}' + to_seconds(doc_id % 1000) AS t FROM documents)"""),
    "stats_merged": (stats_merged, f"""SELECT '{S.SITE}' AS site, (SELECT count(*) FROM documents) AS pages, (SELECT count(*) FROM part) AS products,
        (SELECT strftime(max(TIMESTAMP '{tables.CRAWLED}' + to_seconds(p_partkey % 500)), '%Y-%m-%d %H:%M:%S') FROM part WHERE p_partkey % 4 = 0) AS last_verified,
        (SELECT string_agg(extraction_method || '=' || n, ',' ORDER BY extraction_method) FROM (SELECT extraction_method, count(*) AS n FROM ({S.products()}) GROUP BY 1)) AS methods"""),
    "store_upsert": (store_upsert, _STORED),
    "verified_overlay": (verified_overlay, f"""SELECT page_url, CASE WHEN p_partkey % 10 = 0 THEN price + 1 ELSE price END AS price, CASE WHEN p_partkey % 10 = 0 THEN seq + 1000000 ELSE seq END AS seq,
        p_partkey % 10 = 0 AS verified FROM ({S.products()})"""),
    "extraction_method_counts": (methods, f"SELECT extraction_method, count(*) AS n FROM ({S.products()}) GROUP BY 1"),
    "upsert_latest": (upsert_latest, _UPSERT),
    "product_remove": (product_remove, f"SELECT page_url, CASE WHEN p_partkey % 5 = 0 THEN price + 1 ELSE price END AS price, CASE WHEN p_partkey % 5 = 0 THEN seq + 1000000 ELSE seq END AS seq FROM ({S.products()}) WHERE p_partkey % 11 <> 0"),
    "page_delete_cascade": (page_delete, f"""SELECT 'pages' AS kind, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'chunks', count(*) FROM ({S.chunks()}) WHERE doc_id % 3 <> 0
        UNION ALL SELECT 'products', count(*) FROM part WHERE NOT (p_partkey % 3 = 0 AND p_partkey IN (SELECT doc_id FROM documents))"""),
    "seq_backfill": (seq_backfill, f"SELECT url, CASE WHEN doc_id % 4 = 0 THEN 5000000 + row_number() OVER (PARTITION BY doc_id % 4 = 0 ORDER BY url) ELSE seq END AS seq FROM ({S.pages()})"),
    "latency_histogram": (latency, _LATENCY),
    "export_jsonl": (export_jsonl, f"SELECT c.page_url AS url, nullif(p.title, ' ') AS title, nullif(p.lang, '') AS lang, c.text, c.ord AS ordinal, CAST(NULL AS VARCHAR) AS heading_path FROM ({S.chunks()}) c JOIN ({S.pages()}) p ON p.url = c.page_url"),
    "export_chunks_sorted": (export_sorted, f"SELECT page_url, ord, title, length(text) AS n FROM ({S.chunks()})"),
    "price_parse": (prices, _PRICES),
    "currency_guess": (lambda spark, d: prices(spark, d).groupBy("currency").agg(F.count("*").alias("n")), f"SELECT currency, count(*) AS n FROM ({_PRICES}) GROUP BY 1"),
    "availability_norm": (stock, "SELECT p_partkey, CASE p_partkey % " + str(len(_STOCK)) + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, (_, v) in enumerate(_STOCK)) + " END AS availability FROM part"),
    "stream_changefeed": (stream, "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id"),
    "stale_sites": (stale_sites, "SELECT user_id FROM (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) WHERE user_id % 10 = 0 OR epoch(TIMESTAMP '2024-01-30') - epoch(date_trunc('second', t)) >= 86400"),
}
