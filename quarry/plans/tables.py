"""The engine's tables made from the driver's: documents as pages, part as products."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunk, index
from quarry.operators.search import SearchIndex
from quarry.sources.tables import shared_folder

SITE = "docs.example"
CRAWLED = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt to as many tasks as a shuffle has: reading is quick, but one row group of a file may hold a million rows to be cut or counted."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.lit(SITE).alias("site"), F.concat(F.lit(f"https://{SITE}/"), F.col("doc_id")).alias("url"), "doc_id",
        F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("title"), F.lit("").alias("description"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.sha2(text, 256).alias("hash"), F.expr(f"timestamp'{CRAWLED}' + make_interval(0, 0, 0, 0, 0, 0, doc_id % 1000)").alias("crawled_at"), F.lit("").alias("etag"), F.lit("").alias("last_modified"),
        (F.col("doc_id") + 1).alias("seq"), text.alias("text"),
    )


def chunks(spark: SparkSession, sf_dir: str, target: int = 1200, overlap: int = 100) -> DataFrame:
    p = pages(spark, sf_dir)
    return chunk.chunk_texts(dealt(p.select("site", F.col("url").alias("page_url"), "text"), "site", "page_url"), ["site", "page_url"], "text", target, overlap)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = F.array(*[F.lit(m) for m in ("json-ld", "microdata", "opengraph", "heuristic", "llm")])
    return read(spark, sf_dir, "part").select(
        F.lit(SITE).alias("site"), F.concat(F.lit(f"https://{SITE}/"), F.col("p_partkey")).alias("page_url"), "p_partkey", F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("description"),
        F.col("p_retailprice").alias("price"), F.lit("USD").alias("currency"), F.when(F.col("p_size") % 3 == 0, "out_of_stock").otherwise("in_stock").alias("availability"), F.lit("").alias("image"),
        F.element_at(methods, (F.col("p_partkey") % 5 + 1).cast("int")).alias("extraction_method"), F.lit("").alias("raw_json"), F.lit(None).cast("timestamp").alias("verified_at"), (2 * F.col("p_partkey") + 1).alias("seq"),
    )


def search_index(spark: SparkSession, sf_dir: str, with_products: bool = True, target: int = 1200, overlap: int = 100) -> SearchIndex:
    rows = index.indexed_chunks(chunks(spark, sf_dir, target, overlap), pages(spark, sf_dir))
    out = SearchIndex(rows, index.postings(rows, ["site", "page_url", "ord"], index.PAGE_WEIGHTS), index.corpus_stats(rows, index.PAGE_WEIGHTS))
    if with_products:
        p = products(spark, sf_dir)
        out.products, out.product_postings, out.product_stats = p, index.product_postings(p), index.corpus_stats(p, index.PRODUCT_WEIGHTS)
    return out


_STORED: dict[tuple, str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, stored once for each version of the input table of that name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    changed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = (spark.sparkContext.applicationId, sf_dir, name, changed)
    if key not in _STORED:
        root = f"{shared_folder(spark)}/search-index-{uuid.uuid4().hex}"
        make().write.parquet(root)
        _STORED[key] = root
    return spark.read.schema(index.LISTS).parquet(_STORED[key])


def stored_index(spark: SparkSession, sf_dir: str, with_products: bool = True, with_pages: bool = True) -> SearchIndex:
    """search_index() as a search finds it: lists of terms stored once for each version of the input. Texts stay where they are, those of
    candidates are cut anew; they are dealt to tasks by block before they are cut and counted, and nothing else is shuffled."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = SearchIndex()

    def lists_of(rows: DataFrame, rows_of: Callable[[DataFrame], DataFrame], weights: dict[str, float]) -> DataFrame:
        bits = index.block_bits(rows.count())
        return index.term_lists(rows_of(index.dealt_by_block(rows, bits, tasks)), weights, bits)

    if with_pages:
        out.texts = pages(spark, sf_dir).select("site", F.col("url").alias("page_url"), "title", "text")
        lists = _stored(spark, sf_dir, "documents", lambda: lists_of(out.texts, lambda d: chunk.chunk_texts(d, ["site", "page_url", "title"]), index.PAGE_WEIGHTS))
        read = index.lists_read(lists, ["site", "page_url", "ord"])
        out.chunk_postings, out.chunk_stats, out.chunk_lexicon, out.chunk_bounds = (read[k] for k in ("postings", "stats", "lexicon", "bounds"))
    if with_products:
        out.products = products(spark, sf_dir)
        read = index.lists_read(_stored(spark, sf_dir, "part", lambda: lists_of(out.products, lambda d: d, index.PRODUCT_WEIGHTS)), ["site", "page_url"])
        out.product_postings, out.product_stats, out.product_lexicon, out.product_bounds = (read[k] for k in ("postings", "stats", "lexicon", "bounds"))
    return out
