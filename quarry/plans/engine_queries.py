"""What the engine does around its tables: fetching, sitemaps, forms, model replies, cursors, migrations, files; all over the driver tables."""

from __future__ import annotations

import uuid
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.engine import search_url
from quarry.functions import text as T
from quarry.functions import urls
from quarry.html import product
from quarry.html.udfs import dealt, extracted
from quarry.operators import crawl, index
from quarry.plans import sqltext as S
from quarry.plans import tables
from quarry.plans.crawl_queries import DOMAIN
from quarry.sources import export
from quarry.sources.fetch import Fetched, fetch_all
from quarry.sources.tables import shared_folder

SHOP = "https://shop.example"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "part")


def _answer(url: str, user_agent: str = "", etag: str = "", last_modified: str = "", timeout: float = 0.0) -> Fetched:
    """Stands in for the network: what a page's number says."""
    n = int(url.rsplit("/", 1)[1])
    if n % 7 == 3:
        return Fetched(url, error="refused")
    if etag:
        return Fetched(url, 304, not_modified=True, etag=etag)
    return Fetched(url, 404 if n % 5 == 4 else 200, body=f"<p>{n}".encode(), content_type="text/html", etag=f"e{n}")


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("old"), "p_partkey"))
    asked = _parts(spark, sf_dir).select(F.concat(F.lit("https://h"), (F.col("p_partkey") % 10).cast("string"), F.lit(".example/"), "p_partkey").alias("url"), known.alias("etag"))
    got = fetch_all(asked, "quarry/0.1", _answer)
    return got.select("url", F.col("status").cast("bigint").alias("status"), "not_modified", F.decode("body", "UTF-8").alias("body"), "etag", "error")


_FETCHES = """SELECT 'https://h' || (p_partkey % 10) || '.example/' || p_partkey AS url, (CASE WHEN refused THEN 0 WHEN known THEN 304 WHEN p_partkey % 5 = 4 THEN 404 ELSE 200 END)::BIGINT AS status,
  known AND NOT refused AS not_modified, CASE WHEN refused OR known THEN '' ELSE '<p>' || p_partkey END AS body, CASE WHEN refused THEN '' WHEN known THEN 'old' || p_partkey ELSE 'e' || p_partkey END AS etag,
  CASE WHEN refused THEN 'refused' ELSE '' END AS error FROM (SELECT *, p_partkey % 7 = 3 AS refused, p_partkey % 3 = 0 AS known FROM part)"""


#: Page numbers from the first to the last of a url set at most: an eighth of them are in it, far fewer than a sitemap may hold.
SET_SPAN = 80_000


def sitemap_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of indexes of url sets, with a loop in it: each file is read once. A set's index names its files, however many it takes."""
    n, k = F.col("p_partkey") % 8, F.floor(F.col("p_partkey") / SET_SPAN)
    of = lambda *c: F.format_string("%s/set%d-%d.xml", F.lit(SHOP), *c)
    sets = _parts(spark, sf_dir).groupBy(n.alias("n"), k.alias("k")).agg(F.sort_array(F.collect_list(F.format_string("<url><loc>%s/p/%d</loc></url>", F.lit(SHOP), F.col("p_partkey")))).alias("u"))
    files = sets.select(of("n", "k").alias("url"), F.concat(F.lit("<urlset>"), F.array_join("u", ""), F.lit("</urlset>")).alias("xml"))
    named = _parts(spark, sf_dir).select(n.alias("n"), k.alias("k")).distinct().groupBy("n").agg(F.sort_array(F.collect_list(F.concat(F.lit("<sitemap><loc>"), of("n", "k"), F.lit("</loc></sitemap>")))).alias("u"))
    files = files.union(named.select(F.format_string("%s/set%d.xml", F.lit(SHOP), F.col("n")), F.concat(F.lit("<sitemapindex>"), F.array_join("u", ""), F.lit("</sitemapindex>"))))
    listed = lambda name, refs: (f"{SHOP}/{name}.xml", "<sitemapindex>" + "".join(f"<sitemap><loc>{SHOP}/{r}.xml</loc></sitemap>" for r in refs) + "</sitemapindex>")
    files = files.union(spark.createDataFrame([listed("top", ["a", "b", "set0"]), listed("a", ["set1", "set2", "top"]), listed("b", ["set3", "missing"])], "url string, xml string"))
    roots = spark.createDataFrame([(f"{SHOP}/top.xml",)], "url string")
    return crawl.expand_sitemaps(roots, lambda level: level.join(files, "url"), max_urls=None)


def search_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.array(*[F.lit(x) for x in (
        '<form role="search" action="/find"><input name="w" type="search"></form>', '<form class="search-form"><input type="hidden" name="h"><input name="q"></form>', '<form class="search-form" method="post"><input name="q"></form>',
        '<body class="woocommerce">', '<link href="https://cdn.shopify.com/a">', "<p>none</p>",
    )])
    rows = dealt(_parts(spark, sf_dir), "p_partkey").select("p_partkey", F.col("p_name").alias("query"), F.element_at(pages, (F.col("p_partkey") % 6 + 1).cast("int")).alias("home"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "target": [search_url(h, SHOP, q) for h, q in zip(pdf["home"], pdf["query"], strict=True)]})

    return rows.mapInPandas(run, "p_partkey long, target string")


_FORMS = f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '{SHOP}/find?w=' || q WHEN 1 THEN '{SHOP}/?q=' || q WHEN 3 THEN '{SHOP}/?s=' || q WHEN 4 THEN '{SHOP}/search?q=' || q END AS target
  FROM (SELECT *, replace(p_name, ' ', '+') AS q FROM part)"""


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dealt(_parts(spark, sf_dir), "p_partkey")
    sold = F.to_json(F.struct(F.lit(True).alias("is_product"), F.col("p_name").alias("name"), F.col("p_size").alias("price"), F.lit("EUR").alias("currency"), F.lit("sold out").alias("availability"), F.lit("i.png").alias("image")))
    kinds = [sold, F.concat(F.lit("```json\n"), sold, F.lit("\n```")), F.replace(sold, F.lit("true"), F.lit("false")), F.lit("no product here"), F.lit('{"is_product": true, "name": ""}')]
    rows = p.select("p_partkey", F.element_at(F.array(*kinds), (F.col("p_partkey") % 5 + 1).cast("int")).alias("reply"))

    def run(batches):
        for pdf in batches:
            told = [(k, product.parse_reply(r, f"{SHOP}/p/{k}")) for k, r in zip(pdf["p_partkey"], pdf["reply"], strict=True)]
            yield pd.DataFrame([{"p_partkey": k, **{f: asdict(x)[f] for f in ("name", "price", "currency", "availability", "image", "extraction_method")}} for k, x in told if x is not None], columns=["p_partkey", "name", "price", "currency", "availability", "image", "extraction_method"])

    return rows.mapInPandas(run, "p_partkey long, name string, price double, currency string, availability string, image string, extraction_method string")


def product_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address, image, offers in lists and aggregates, prices as numbers and texts, and the source itself."""
    p = dealt(_parts(spark, sf_dir), "p_partkey")
    k, price = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    offers = F.element_at(F.array(
        F.concat(F.lit('{"@type":"Offer","price":'), price, F.lit("}")), F.concat(F.lit('[{"price":"'), price, F.lit(',50"},{"price":1}]')),
        F.concat(F.lit('{"@type":"AggregateOffer","lowPrice":"'), price, F.lit('","highPrice":9}')), F.lit('{"price":true}'),
    ), (F.col("p_partkey") % 4 + 1).cast("int"))
    link = F.element_at(F.array(F.concat(F.lit('"url":"/u/'), k, F.lit('"')), F.concat(F.lit('"@id":"https://id.example/'), k, F.lit('"')), F.lit('"@id":"#x"')), (F.col("p_partkey") % 3 + 1).cast("int"))
    image = F.element_at(F.array(F.lit('["","a.png"]'), F.lit('{"url":"/b.png"}')), (F.col("p_partkey") % 2 + 1).cast("int"))
    source = F.concat(F.lit('{"@type":"Product","name":"'), F.col("p_name"), F.lit('",'), link, F.lit(',"image":'), image, F.lit(',"offers":'), offers, F.lit("}"))
    x = p.select("p_partkey", source.alias("source")).select("p_partkey", "source", extracted(F.concat(F.lit(f"{SHOP}/p/"), F.col("p_partkey").cast("string")), F.concat(F.lit('<script type="application/ld+json">'), "source", F.lit("</script>"))).alias("x"))
    return x.select("p_partkey", "x.product.url", "x.product.image", "x.product.price", (F.col("x.product.raw_json") == F.col("source")).alias("whole"))


_FIELDS = f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{SHOP}/u/' || p_partkey WHEN 1 THEN 'https://id.example/' || p_partkey ELSE '{SHOP}/p/' || p_partkey END AS url,
  CASE p_partkey % 2 WHEN 0 THEN '{SHOP}/p/a.png' ELSE '{SHOP}/b.png' END AS image, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 0.5::DOUBLE WHEN 2 THEN p_size::DOUBLE END AS price, TRUE AS whole FROM part"""


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next cursor of a full, a short and an empty batch, and the next sequence number."""
    p, q = tables.pages(spark, sf_dir), tables.products(spark, sf_dir)
    rows = [(since, index.next_cursor(index.items(p, q, since, 50), since)) for since in (0, 100, 10**9)]
    return spark.createDataFrame([*rows, (-1, index.next_seq(p, q))], "since bigint, next bigint")


_ITEMS = f"SELECT greatest(p.seq, coalesce(q.seq, 0)) AS seq FROM ({S.pages()}) p LEFT JOIN ({S.products()}) q ON p.url = q.page_url"
_CURSORS = " UNION ALL ".join(f"SELECT {s}::BIGINT AS since, coalesce(max(seq), {s})::BIGINT AS next FROM (SELECT seq FROM ({_ITEMS}) WHERE seq > {s} ORDER BY seq LIMIT 50)" for s in (0, 100, 10**9)) + f" UNION ALL SELECT -1, greatest((SELECT max(seq) FROM ({S.pages()})), (SELECT max(seq) FROM ({S.products()})))::BIGINT"


def migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table from before two columns were added."""
    old = tables.pages(spark, sf_dir).select("url", "title")
    return index.ensure_columns(old, {"etag": F.lit(""), "title": F.lit("never"), "seq": F.length("url").cast("bigint")}).select("url", "title", "etag", "seq")


def site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.sites(tables.read(spark, sf_dir, "pages").select(urls.registrable_domain(F.col("url")).alias("site")))


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = index.site_stats(tables.pages(spark, sf_dir), tables.chunks(spark, sf_dir), tables.products(spark, sf_dir))
    return export.prometheus(s)


def kb_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markdown files of a site: every fifth page shares a slug with the one after it, and the later one stays."""
    p = tables.pages(spark, sf_dir).withColumn("url", F.concat(F.lit(f"https://{tables.SITE}/d/"), (F.col("doc_id") - F.when(F.col("doc_id") % 5 == 1, 1).otherwise(0)).cast("string"), F.when(F.col("doc_id") % 5 == 1, "?again").otherwise("")))
    rows = p.withColumn("markdown", F.concat(F.lit("body "), F.col("doc_id").cast("string"))).withColumn("headings", F.array(F.struct(F.lit(1).alias("level"), F.lit("H").alias("text"))))
    return _kb_shown(export.markdown_documents(rows))


def kb_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files written by the sink, twice, and read back from the folder by their names."""
    folder = f"{shared_folder(spark)}/kb-{uuid.uuid4().hex}"
    p = tables.pages(spark, sf_dir)
    rows = p.withColumn("url", F.concat(F.lit(f"https://{tables.SITE}/d/"), F.col("doc_id").cast("string"))).withColumn("markdown", F.concat(F.lit("body "), F.col("doc_id").cast("string"))).withColumn("headings", F.expr("cast(array() as array<struct<level:int,text:string>>)"))
    for body in ("old", "text"):
        export.write_markdown(rows.withColumn("markdown", F.concat(F.lit(f"{body} "), F.col("doc_id").cast("string"))), folder)
    return _kb_shown(export.read_markdown(rows, folder))


def _kb_shown(out: DataFrame) -> DataFrame:
    return out.select("slug", F.regexp_extract("document", r"(?s)\n---\n\n(.*)\n$", 1).alias("body"), F.regexp_extract("document", r"(?m)^hash: '?([0-9a-f]+)", 1).alias("hash"), F.regexp_extract("document", r"^---\nurl: (.*)\n", 1).alias("url"))


_KB = f"""SELECT 'd/' || n || '.md' AS slug, 'body ' || doc_id AS body, hash, 'https://{tables.SITE}/d/' || n || CASE WHEN doc_id % 5 = 1 THEN '?again' ELSE '' END AS url
  FROM (SELECT *, doc_id - CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS n, row_number() OVER (PARTITION BY doc_id - CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END ORDER BY seq DESC) AS r FROM ({S.pages()})) WHERE r = 1"""


def recrawl_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-crawl times of sites from their last crawl."""
    from quarry.streaming.changefeed import due_sites

    crawls = tables.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("site"), F.col("ts").alias("crawled_at"))
    return due_sites(crawls, "36 hours").select("site", T.rfc3339(F.col("due")).alias("due"))


QUERIES = {
    "fetch_pages": (fetches, _FETCHES),
    "sitemap_tree": (sitemap_tree, f"SELECT '{SHOP}/p/' || p_partkey AS url FROM part WHERE p_partkey % 8 < 4"),
    "search_forms": (search_forms, _FORMS),
    "model_replies": (model_replies, f"SELECT p_partkey, p_name AS name, p_size::DOUBLE AS price, 'EUR' AS currency, 'out_of_stock' AS availability, '{SHOP}/p/i.png' AS image, 'llm' AS extraction_method FROM part WHERE p_partkey % 5 < 2"),
    "product_fields": (product_fields, _FIELDS),
    "feed_cursors": (cursors, _CURSORS),
    "ensure_columns": (migration, f"SELECT url, title, '' AS etag, length(url) AS seq FROM ({S.pages()})"),
    "site_list": (site_list, f"SELECT DISTINCT {DOMAIN} AS site FROM pages"),
    "prometheus_lines": (gauges, f"""SELECT 'quarry_index_' || k || '{{site="{tables.SITE}"}} ' || n AS value FROM (SELECT 'pages' AS k, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM ({S.chunks()}) UNION ALL SELECT 'products', count(*) FROM part)"""),
    "kb_files": (kb_files, _KB),
    "kb_written": (kb_written, f"SELECT 'd/' || doc_id || '.md' AS slug, 'text ' || doc_id AS body, hash, 'https://{tables.SITE}/d/' || doc_id AS url FROM ({S.pages()})"),
    "recrawl_due": (recrawl_due, "SELECT user_id::VARCHAR AS site, strftime(max(ts) + INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS due FROM events GROUP BY 1"),
}
