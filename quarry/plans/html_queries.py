"""Pages through the extraction function: content, links, products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.html.udfs import dealt, extracted
from quarry.plans import tables


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(tables.read(spark, sf_dir, "pages"), "page_id").select("page_id", "url", extracted("url", "html").alias("x"))


def title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", "x.title")


def lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", "x.lang")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.explode("x.links").alias("link"))


def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.size("x.links").cast("bigint").alias("n"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", "x.markdown")


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.inline("x.headings")).select("page_id", F.col("level").cast("bigint").alias("level"), "text")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", "x.hash", (F.sha2("x.markdown", 256) == F.col("x.hash")).alias("same"))


# --- products: pages synthesised from part ------------------------------------------------------------------


def _join(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a page of one of eight kinds. Class names and generators are the platforms' own, fixed values."""
    p = dealt(tables.read(spark, sf_dir, "part"), "p_partkey")
    name, price = F.col("p_name"), F.format_string("%.2f", F.col("p_retailprice"))
    offer = F.struct(F.lit("Offer").alias("@type"), price.alias("price"), F.lit("USD").alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability"))
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), name.alias("name"), F.col("p_type").alias("description"), offer.alias("offers")))
    html = F.element_at(
        F.array(
            _join('<html><head><script type="application/ld+json">{"broken"</script><script type="application/ld+json">', ld, "</script></head><body><h1>x</h1></body></html>"),
            _join('<div itemscope itemtype="https://schema.org/Product"><h2 itemprop="name">', name, '</h2><p itemprop="offers" itemscope><meta itemprop="price" content="', price, '"><meta itemprop="priceCurrency" content="USD"><link itemprop="availability" href="https://schema.org/InStock"></div>'),
            _join('<head><meta property="og:type" content="product"><meta property="og:title" content="', name, '"><meta property="product:price:amount" content="', price, '"><meta property="product:price:currency" content="USD"><meta property="product:availability" content="instock"></head>'),
            _join('<body class="woocommerce"><div class="product"><h1 class="product_title">', name, '</h1><span class="woocommerce-Price-amount">$', price, '</span><p class="stock in-stock">yes</p></div></body>'),
            _join('<head><meta name="generator" content="PrestaShop"></head><body><h1>', name, '</h1><span class="current-price">$', price, '</span><span class="product-available">yes</span></body>'),
            _join("<body><article><h1>", name, "</h1><p>An article about prices: $", price, "</p></article></body>"),
            _join('<script src="https://cdn.shopify.com/a.js"></script><h1 class="product__title">', name, '</h1><span class="price-item">$', price, "</span>"),
            _join('<meta name="generator" content="OpenCart"><div id="content"><h1>', name, '</h1><b class="price-new">$', price, '</b><i class="stock">In Stock</i></div>'),
        ),
        (F.col("p_partkey") % 8 + 1).cast("int"),
    )
    return p.select("p_partkey", _join("https://shop.example/", F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))


def chain_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _shops(spark, sf_dir).select("p_partkey", extracted("url", "html").alias("x"))
    return x.filter("x.product is not null").select("p_partkey", "x.product.name", "x.product.price", "x.product.currency", "x.product.availability", "x.product.extraction_method", "x.product.url")


_CHAIN = """SELECT p_partkey, p_name AS name, round(p_retailprice, 2) AS price, 'USD' AS currency, 'in_stock' AS availability, ['json-ld', 'microdata', 'opengraph', 'heuristic', 'heuristic', '', 'heuristic', 'heuristic'][CAST(p_partkey % 8 + 1 AS INT)] AS extraction_method,
  'https://shop.example/' || p_partkey AS url FROM part WHERE p_partkey % 8 <> 5"""


def json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_methods(spark, sf_dir).filter("extraction_method = 'json-ld'")


def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _shops(spark, sf_dir).select(extracted("url", "html").alias("x"))
    return x.groupBy(F.col("x.platform").alias("platform")).agg(F.count("*").alias("n"))


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a page of known markup: what the extraction makes of it can be said in SQL."""
    p = dealt(tables.read(spark, sf_dir, "part"), "p_partkey")
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    html = _join(
        '<html lang="en"><head><title>  ', name, ' \n shown</title><meta name="description" content="', F.col("p_type"), '"></head><body><nav><a href="/menu">menu</a></nav><main><h1>', name, "</h1><p>Made by <b>", F.col("p_brand"),
        '</b> as <a href="/types/', size, '/?q=1#top">type</a>, <em>so</em> it is.</p><ul><li>size ', size, "<ul><li>inner</li></ul></li><li>box</li></ul><ol><li>one</li><li>two</li></ol><h3>Table</h3><table><tr><th>size</th><th>price</th></tr><tr><td>", size,
        '</td><td>a | b</td></tr></table><pre>code ', size, "\n two</pre><blockquote><p>quoted</p></blockquote><hr><div class=\"newsletter\">no</div><p><img src=\"i.png\" alt=\"seen\"></p></main><footer>foot</footer></body></html>",
    )
    return p.select("p_partkey", extracted(_join("https://docs.example/parts/", F.col("p_partkey").cast("string")), html).alias("x")).select("p_partkey", "x.*")


def content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("headings", lambda h: F.concat_ws(":", h["level"].cast("string"), h["text"])), "|")
    return part_pages(spark, sf_dir).select("p_partkey", "title", "description", "lang", "markdown", "hash", shown.alias("headings"), F.array_join("links", " ").alias("links"))


_PARTS_MARKDOWN = """'# ' || p_name || chr(10) || chr(10) || 'Made by**' || p_brand || '**as[type](https://docs.example/types/' || p_size || '/?q=1#top),*so*it is.' || chr(10) || chr(10)
  || '- size ' || p_size || chr(10) || '  - inner' || chr(10) || '- box' || chr(10) || chr(10) || '1. one' || chr(10) || '2. two' || chr(10) || chr(10) || '### Table' || chr(10) || chr(10)
  || '| size | price |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_size || ' | a | b |' || chr(10) || chr(10) || '```' || chr(10) || 'code ' || p_size || chr(10) || ' two' || chr(10) || '```' || chr(10) || chr(10)
  || '> quoted' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '![seen](https://docs.example/parts/i.png)'"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in listings of thirty cards, of which twenty count."""
    p = tables.read(spark, sf_dir, "part")
    card = F.concat(F.lit('<li class="product"><a href="/p/'), F.col("p_partkey"), F.lit('"><img data-src="/i.png"><h2>'), F.col("p_name"), F.lit('</h2></a><span class="price">€'), F.format_string("%.2f", F.col("p_retailprice")), F.lit("</span></li>"))
    pages = p.groupBy(F.floor(F.col("p_partkey") / 30).alias("list")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("c")))), lambda s: s["c"]), "").alias("cards"))
    x = dealt(pages, "list").select("list", extracted(F.lit("https://shop.example/list"), F.concat(F.lit("<ul>"), "cards", F.lit("</ul>"))).alias("x"))
    return x.select("list", F.inline("x.items")).select("list", "url", "name", "price", "currency", "image")


def _decoded(x: str) -> str:
    return f"replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


_TITLE = "regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[\\t\\n\\f\\r ]+', ' ', 'g')"
_HEADING = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"

_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"

QUERIES = {
    "content_parts": (content_parts, f"""SELECT p_partkey, p_name || ' shown' AS title, p_type AS description, 'en' AS lang, markdown, sha256(markdown) AS hash, '1:' || p_name || '|3:Table' AS headings,
        'https://docs.example/menu https://docs.example/types/' || p_size || '?q=1' AS links FROM (SELECT *, {_PARTS_MARKDOWN} AS markdown FROM part)"""),
    "page_title": (title, f"SELECT page_id, trim({_decoded(_TITLE)}) AS title FROM pages"),
    "page_lang": (lang, "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages"),
    "page_links": (links, f"""SELECT DISTINCT page_id, {_ORIGIN} || replace(replace(url_encode(path), '%2F', '/'), '%2C', ',') AS link
        FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS path FROM pages)"""),
    "page_link_counts": (link_counts, "SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1))) AS n FROM pages"),
    "content_markdown": (markdown, None),
    "content_headings": (headings, f"SELECT page_id, 1::BIGINT AS level, trim({_decoded(_HEADING)}) AS text FROM pages"),
    "content_hash": (content_hash, None),
    "product_jsonld": (json_ld, _CHAIN + " AND p_partkey % 8 = 0"),
    "product_chain_methods": (chain_methods, _CHAIN),
    "product_platforms": (platforms, "SELECT ['', '', '', 'woocommerce', 'prestashop', '', 'shopify', 'opencart'][CAST(p_partkey % 8 + 1 AS INT)] AS platform, count(*) AS n FROM part GROUP BY 1"),
    "product_list": (listing, "SELECT p_partkey // 30 AS list, 'https://shop.example/p/' || p_partkey AS url, p_name AS name, round(p_retailprice, 2) AS price, 'EUR' AS currency, 'https://shop.example/i.png' AS image FROM part WHERE p_partkey % 30 < 20"),
}
