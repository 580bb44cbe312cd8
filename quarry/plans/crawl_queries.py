"""URLs, scope, robots, change detection, frontier, sitemaps, politeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import urls
from quarry.operators import crawl
from quarry.plans import sqltext as S
from quarry.plans import tables

HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract(url, '^[^?#]*(\\?[^#]*)?', 1)"
DOMAIN = f"regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1)"
NORMAL = f"lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || '://' || {HOST} || CASE WHEN {PATH} = '' THEN '/' WHEN length({PATH}) > 1 THEN regexp_replace({PATH}, '/$', '') ELSE {PATH} END || {QUERY}"
ROBOTS = "User-agent: *\nDisallow: /fr/\nAllow: /fr/1\nDisallow: /*?id=\nDisallow: /de/*.html$\nCrawl-delay: 2.5\nSitemap: https://example.com/sitemap.xml\n"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "pages").select("page_id", "url", "html")


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", urls.normalize(F.col("url")).alias("url"))


def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("host"))


def domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", urls.registrable_domain(F.col("url")).alias("domain"))


def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", urls.slug(F.col("url")).alias("slug"))


def robots_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", urls.path_and_query(F.col("url")).alias("path"))


def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = crawl.in_scope(F.col("url"), "example.com", ("/en/", "/fr/", "("), ("/cart", "[?]", "["))
    site = _pages(spark, sf_dir).select("page_id", "url", urls.registrable_domain(F.col("url")).alias("domain"))
    return site.filter(keep).select("page_id", "url")


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id", "url")
    both = p.select("url", (F.col("page_id") % 5).alias("depth")).union(p.select(F.concat("url", F.lit("#again")), (F.col("page_id") % 3).alias("depth")))
    return crawl.first_seen(both.withColumn("url", urls.normalize(F.col("url"))))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id", "url").withColumn("site", F.lit("example"))
    rules = crawl.robots_rules(spark.createDataFrame([("example", ROBOTS)], "site string, text string"), "quarry/0.1")
    return crawl.robots_allowed(p, rules).select("page_id", "allowed")


_ROBOTS = [("^/fr/", 4, False), ("^/fr/1", 5, True), ("^/.*\\?id=", 6, False), ("^/de/.*\\.html$", 11, False)]
_ROBOTS_SQL = f"""WITH r(re, n, ok) AS (VALUES {", ".join(f"('{re}', {n}, {ok})" for re, n, ok in _ROBOTS)})
  SELECT page_id, coalesce(arg_max(ok, n * 2 + ok::INT), true) AS allowed FROM pages LEFT JOIN r ON regexp_matches({PATH} || {QUERY}, re) GROUP BY page_id"""


def _snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    now = tables.pages(spark, sf_dir).select("site", "url", "doc_id", "text", "hash")
    then = now.filter("doc_id % 5 <> 0").withColumn("hash", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat("text", F.lit("old")), 256)).otherwise(F.col("hash")))
    return now, then


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.to_index(*_snapshot(spark, sf_dir)).select("url", "hash")


def unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.state_diff(*_snapshot(spark, sf_dir)).filter("change = 'unchanged'").select("url", "hash")


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 304, 404, 200, 200)]), (F.col("page_id") % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "image/png", "")]), (F.col("page_id") % 3 + 1).cast("int"))
    return crawl.run_counters(p.select(crawl.fetch_status(status, kind).alias("status")))


_COUNTERS = """WITH s AS (SELECT CASE WHEN page_id % 5 = 1 THEN 'skipped' WHEN page_id % 5 = 2 THEN 'failed' WHEN page_id % 3 = 1 THEN 'skipped' ELSE 'fetched' END AS status FROM pages)
  SELECT count(*) AS visited, count(*) FILTER (WHERE status = 'fetched') AS fetched, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed FROM s"""


def bfs(spark: SparkSession, sf_dir: str, max_pages: int | None = None) -> DataFrame:
    ids = tables.read(spark, sf_dir, "documents").select("doc_id")
    text = lambda c: c.cast("string")
    links = ids.select(text(F.col("doc_id")).alias("src"), F.explode(F.array(F.col("doc_id") * 2 + 1, F.col("doc_id") * 3 + 2, F.floor(F.col("doc_id") / 2))).alias("d")).select("src", text(F.col("d")).alias("dst"))
    seeds = spark.createDataFrame([("0", 0), ("7", 1)], "url string, depth int")
    known = ids.select(text(F.col("doc_id")).alias("url"))
    return crawl.bfs(seeds, links.join(known, F.col("dst") == F.col("url"), "left_semi"), 5, max_pages).select("url", F.col("depth").cast("bigint").alias("depth"))


_BFS = """WITH RECURSIVE l AS (SELECT doc_id AS s, unnest([doc_id * 2 + 1, doc_id * 3 + 2, doc_id // 2]) AS d FROM documents), k AS (SELECT s, d FROM l WHERE d IN (SELECT doc_id FROM documents)),
  r(u, depth) AS (SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (7, 1)) UNION SELECT d, depth + 1 FROM r JOIN k ON u = s WHERE depth < 5) SELECT u::VARCHAR AS url, min(depth) AS depth FROM r GROUP BY u"""


def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    file = p.groupBy((F.col("page_id") % 4).alias("file")).agg(F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    return crawl.sitemap_urls(file).select("kind", F.col("loc").alias("url"))


#: Hosts under rules of every kind, and their registrable domains; the pages' first host labels stand for x.
_HOSTS = [("x.b.co.uk", "b.co.uk"), ("x.github.io", "x.github.io"), ("a.x.github.io", "x.github.io"), ("a.x.kawasaki.jp", "a.x.kawasaki.jp"), ("x.city.kobe.jp", "city.kobe.jp"), ("x.www.ck", "www.ck"), ("a.x.bd", "a.x.bd"), ("x.example", "x.example"), ("co.uk", "co.uk")]


def domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.regexp_extract(urls.host(F.col("url")), r"^([^.]+)", 1)
    form = F.element_at(F.array(*[F.lit(h) for h, _ in _HOSTS]), (F.col("page_id") % len(_HOSTS) + 1).cast("int"))
    named = _pages(spark, sf_dir).select("page_id", F.concat(F.lit("https://"), F.regexp_replace(form, r"(^|\.)x\.", F.concat(F.lit("$1"), label, F.lit("."))), F.lit("/p")).alias("u"))
    return named.select("page_id", urls.registrable_domain(F.col("u")).alias("domain"))


_DOMAINS_SQL = f"""SELECT page_id, regexp_replace(({[d for _, d in _HOSTS]})[page_id % {len(_HOSTS)} + 1], '(^|\\.)x\\.', '\\1' || regexp_extract({HOST}, '^([^.]+)', 1) || '.') AS domain FROM pages"""


def sitemap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps with comments, CDATA, prefixes, pictures' addresses and, each fourth one, an error."""
    p = _pages(spark, sf_dir)
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    entry = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<s:url><s:loc>\n "), escaped, F.lit(" </s:loc><i:image><i:loc>https://x/picture</i:loc></i:image></s:url>"))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("<s:url><s:loc><![CDATA["), "url", F.lit("]]></s:loc></s:url>"))
    ).otherwise(F.concat(F.lit("<!-- <url><loc>https://x/hidden</loc></url> --><s:url><s:lastmod>x</s:lastmod><s:loc>"), escaped, F.lit("</s:loc></s:url>")))
    head, tail = F.lit('<?xml version="1.0" encoding="ISO-8859-1"?><s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:i="urn:i">'), F.when(F.col("file") == 3, "<unclosed></s:urlset>").otherwise("</s:urlset>")
    file = p.groupBy((F.col("page_id") % 4).alias("file")).agg(F.array_join(F.collect_list(entry), "").alias("body"))
    return crawl.sitemap_urls(file.select("file", F.concat(head, "body", tail).alias("xml"))).select("file", "kind", F.col("loc").alias("url"))


def politeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id", "url", urls.host(F.col("url")).alias("host"))
    wait = crawl.delay(crawl.parse_robots(ROBOTS, "quarry/0.1"))
    return crawl.schedule(p, F.lit(wait), order="page_id").select("page_id", "due")


QUERIES = {
    "url_normalize": (url_normalize, f"SELECT page_id, {NORMAL} AS url FROM pages"),
    "url_host": (url_host, f"SELECT page_id, {HOST} AS host FROM pages"),
    "registrable_domain": (domain, f"SELECT page_id, {DOMAIN} AS domain FROM pages"),
    "url_slug": (slug, f"SELECT page_id, CASE WHEN trim({PATH}, '/') = '' THEN 'index.md' ELSE array_to_string(list_transform(list_filter(string_split({PATH}, '/'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '[^\\p{{L}}\\p{{Nd}}\\-_.]', '-', 'g'), '^-+|-+$', '', 'g')), '/') || '.md' END AS slug FROM pages"),
    "robots_path": (robots_path, f"SELECT page_id, {PATH} || {QUERY} AS path FROM pages"),
    "scope_filter": (scope, f"SELECT page_id, url FROM pages WHERE {DOMAIN} = 'example.com' AND (contains(url, '/en/') OR contains(url, '/fr/')) AND NOT contains(url, '/cart') AND NOT contains(url, '?')"),
    "url_dedup": (dedup, f"SELECT {NORMAL} AS url, min(least(page_id % 5, page_id % 3)) AS depth FROM pages GROUP BY 1"),
    "robots_allowed": (robots, _ROBOTS_SQL),
    "state_diff_changed": (changed, f"SELECT url, hash FROM ({S.pages()}) WHERE doc_id % 5 = 0 OR doc_id % 3 = 0"),
    "state_diff_unchanged": (unchanged, f"SELECT url, hash FROM ({S.pages()}) WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0"),
    "crawl_counters": (counters, _COUNTERS),
    "bfs_frontier": (bfs, _BFS),
    "bfs_max_pages": (lambda spark, d: bfs(spark, d, 25), f"SELECT * FROM ({_BFS}) ORDER BY depth, url LIMIT 25"),
    "sitemap_urls": (sitemap, "SELECT 'urlset' AS kind, url FROM pages"),
    "registrable_rules": (domain_rules, _DOMAINS_SQL),
    "sitemap_events": (sitemap_events, "SELECT page_id % 4 AS file, 'urlset' AS kind, url FROM pages WHERE page_id % 4 <> 3"),
    "rate_limit_schedule": (politeness, f"SELECT page_id, 2.5::DOUBLE * (row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1) AS due FROM pages"),
}
