"""The one Arrow function through which pages pass: each is parsed once and gives all that is known of it."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import schema
from quarry.html import content, product
from quarry.html.tree import parse

NAMES = ["title", "description", "lang", "markdown", "hash", "headings", "links", "platform", "product", "items"]
#: Pages whose records a worker holds at a time, and pages that reach it at once.
SLICE, BATCH = 100, 1000
FIELDS = ("url", "name", "description", "price", "currency", "availability", "image", "extraction_method", "raw_json")


def _record(p: product.Product | None) -> dict | None:
    return None if p is None else {k: getattr(p, k) for k in FIELDS}


def understand(url: str | None, page: str | None, ask: Callable[[str], str] | None = None) -> dict:
    """Everything that can be read from one page. Links and products are read before boilerplate is pruned; ask is a language model's turn."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    url, doc = url or "", parse(page or "")
    doc.hold()
    sold = product.extract(doc, url)
    if sold is None and ask is not None:
        sold = product.extract_with_model(page or "", url, ask)
    found = {"links": content.links(doc, url), "platform": product.platform_of(doc), "product": _record(sold), "items": [_record(p) for p in product.extract_list(doc, url)]}
    out = content.extract("", url, doc)
    headings = [{"level": level, "text": text} for level, text in out.headings]
    return {"title": out.title, "description": out.description, "lang": out.lang, "markdown": out.markdown, "hash": out.hash, "headings": headings, **found}


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt to tasks by a key, in small batches: parsing takes far longer than reading, and one row group of a file may hold a million rows."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def extracted(url: Column | str, page: Column | str, ask: Callable[[str], str] | None = None) -> Column:
    def understood(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for urls, pages in batches:
            todo = zip(urls, pages, strict=True)
            while some := [understand(u, p, ask) for u, p in islice(todo, SLICE)]:
                yield pd.DataFrame(some, columns=NAMES)

    # not deterministic to the optimiser, which would else parse each page again for a filter on the result
    return F.pandas_udf(understood, schema.EXTRACTED, F.PandasUDFType.SCALAR_ITER).asNondeterministic()(url, page)


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html", ask: Callable[[str], str] | None = None) -> DataFrame:
    """pages' other columns with the extraction's fields as columns of the same names."""
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, extracted(F.col(url), F.col(html), ask).alias("_x")).select(*rest, "_x.*")
