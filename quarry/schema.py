"""Schemas of the stored tables and of query results, as DDL. Every table carries its site."""

from __future__ import annotations

HEADINGS = "array<struct<level:int,text:string>>"
PAGES = ("site string, url string, title string, description string, lang string, hash string, crawled_at timestamp, etag string, last_modified string, seq bigint")
CHUNKS = ("site string, page_url string, ord int, heading_path string, text string, doc_len bigint")
#: Lookup tables of a search, sorted by term.
POSTINGS = "site string, term string, page_url string, ord int, doc_len bigint, f double, block int"
PRODUCT_POSTINGS = "site string, term string, page_url string, doc_len bigint, f double, block int"
#: Each bucket's share of a term's rows, and what a block of rows can reach.
LEXICON = "site string, term string, rows bigint"
BOUNDS = "site string, term string, block int, top double, shortest bigint"
#: Each bucket's share of a site's statistics.
COUNTS = "site string, pages bigint, chunks bigint, products bigint, first_crawled timestamp, last_crawled timestamp, last_verified timestamp, extraction_methods map<string,bigint>"
STATS = "site string, n bigint, total_len bigint"
PRODUCTS = (
    "site string, page_url string, name string, description string, price double, currency string, availability string, image string, extraction_method string, raw_json string, verified_at timestamp, seq bigint"
)
STATE = ("site string, url string, etag string, last_modified string, hash string, crawled_at timestamp")
RESULT = (
    "url string, type string, title string, heading_path string, snippet string, price double, currency string, availability string, image string, extraction_method string, score double, verified boolean, verified_at timestamp"
)
ITEM = ("url string, type string, title string, hash string, crawled_at timestamp, etag string, seq bigint, price double, currency string, availability string, extraction_method string, verified_at timestamp")
PRODUCT_STRUCT = "struct<url:string,name:string,description:string,price:double,currency:string,availability:string,image:string,extraction_method:string,raw_json:string>"
EXTRACTED = (
    f"struct<title:string,description:string,lang:string,markdown:string,hash:string,headings:{HEADINGS},links:array<string>,platform:string,product:{PRODUCT_STRUCT},items:array<{PRODUCT_STRUCT}>>"
)
