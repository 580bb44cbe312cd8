"""Index tables: postings, statistics, sequence numbers, upserts, the items feed.

All statistics are kept by site. A stored index is postings sorted by term and one row of statistics; a chunk carries its
length, so statistics never read texts again. postings holds a row for each term of a row of an indexed table, with the
term's weighted frequency, so a search is a filtered scan and one small aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import terms

#: Column weights of the two indexes.
PAGE_WEIGHTS = {"title": 5.0, "heading_path": 2.0, "text": 1.0}
PRODUCT_WEIGHTS = {"name": 3.0, "description": 1.0}
MANY_ITEMS = 200
#: Blocks of postings: 2 ** bits by hash of the page.
BLOCK_BITS = 10
#: Stored lists: a row for each term of a block of rows, with its postings. The term "" has the block's rows and the terms of all of them.
LISTS = "site string, term string, block int, rows bigint, top double, shortest bigint, total_len bigint, postings array<struct<page_url:string,ord:int,doc_len:bigint,f:double>>"
#: Terms of texts that a task sorts at a time, and postings that it hands on at once.
RUN_TERMS, BATCH_POSTINGS = 4_000_000, 200_000


def indexed_chunks(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks with their page's title: site, page_url, ord, title, heading_path, text."""
    titles = pages.select("site", F.col("url").alias("page_url"), "title")
    return chunks.join(titles, ["site", "page_url"]).select("site", "page_url", "ord", "title", "heading_path", "text")


def all_chunks(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Every chunk with its page's fields, ordered by page and ordinal: a range-partitioned sort."""
    meta = pages.select("site", F.col("url").alias("page_url"), "title", "description", "lang")
    return chunks.join(meta, ["site", "page_url"]).orderBy("site", "page_url", "ord")


def postings(rows: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """keys, term, f (weighted frequency over the columns) and doc_len (terms of all the columns).

    A row's terms are counted where the row is: sorted in its array, each run of equal ones a posting, so nothing is shuffled.
    Whole weights repeat a column's terms; the few rows of other weights would need sums of their own.
    """
    if any(w != int(w) or w < 1 for w in weights.values()):
        raise ValueError("weights of columns are whole numbers from 1")
    listed = rows.select(*keys, *[terms(F.coalesce(F.col(c), F.lit(""))).alias(f"_{c}") for c in weights])
    length = sum((F.size(f"_{c}") for c in weights), F.lit(0)).cast("long")
    repeated = F.concat(*[F.flatten(F.array_repeat(F.col(f"_{c}"), int(w))) if w > 1 else F.col(f"_{c}") for c, w in weights.items()])
    ordered = listed.select(*keys, length.alias("doc_len"), F.sort_array(repeated).alias("_t"))
    at = F.filter(F.sequence(F.lit(1), F.size("_t")), lambda i: (i == 1) | (F.element_at("_t", i) != F.element_at("_t", F.greatest(i - 1, F.lit(1)))))
    starts = ordered.filter(F.size("_t") > 0).select("*", at.alias("_at"))
    ends = F.concat(F.slice("_at", 2, F.size("_at")), F.array(F.size("_t") + 1))
    found = F.zip_with("_at", ends, lambda i, j: F.struct(F.element_at("_t", i).alias("term"), (j - i).cast("double").alias("f")))
    return starts.select(*keys, "doc_len", F.explode(found).alias("_p")).select(*keys, "doc_len", "_p.term", "_p.f")


def doc_len(weights: dict[str, float]) -> Column:
    """The terms of all the columns of a row."""
    return sum((F.size(terms(F.coalesce(F.col(c), F.lit("")))) for c in weights), F.lit(0)).cast("long")


def corpus_stats(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """site, n (rows of the index) and total_len (terms of all rows): one row for each site. Lengths that rows carry are not counted again."""
    length = F.col("doc_len") if "doc_len" in rows.columns else doc_len(weights)
    return rows.groupBy("site").agg(F.count("*").alias("n"), F.sum(length).alias("total_len"))


def block_of(page_url: str = "page_url", bits: int = BLOCK_BITS) -> Column:
    """The block of a page's rows: the leading bits of a hash of its address, the same in every table and at every write."""
    return F.shiftrightunsigned(F.xxhash64(page_url), 64 - bits).cast("int")


def by_term(found: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Postings laid out for lookups: ranges of terms (a very common term spans several), each sorted, so that a filter on
    the term reaches few row groups. All rows of a page lie in one block."""
    return found.withColumn("block", block_of(bits=bits)).repartitionByRange("site", "term", "block").sortWithinPartitions("site", "term", "block", "page_url")


def lexicon(found: DataFrame) -> DataFrame:
    """site, term, rows (that hold it) of postings: a sorted dictionary, small beside them, for prefixes and weights."""
    return found.groupBy("site", "term").agg(F.count("*").alias("rows")).repartitionByRange("site", "term").sortWithinPartitions("site", "term")


def block_bounds(found: DataFrame) -> DataFrame:
    """site, term, block, top (greatest frequency), shortest (least length) of postings with blocks: with them, whatever the statistics,
    no row of the block can score higher for the term than a row of that frequency and length would."""
    tops = found.groupBy("site", "term", "block").agg(F.max("f").alias("top"), F.min("doc_len").alias("shortest"))
    return tops.repartitionByRange("site", "term", "block").sortWithinPartitions("site", "term", "block")


class _Run:
    """Rows (site, page_url, ord, block and an array of terms for each weight) of which only numbers are kept: of a token the number of its term."""

    def __init__(self) -> None:
        self.rows: list[pa.RecordBatch] = []
        self.words: list[pa.DictionaryArray] = []
        self.sizes: list[np.ndarray] = []
        self.tokens = 0

    def add(self, b: pa.RecordBatch, columns: int) -> None:
        """Tokens are held column after column."""
        lists = [b.column(f"t{i}") for i in range(columns)]
        words = pa.chunked_array([x.flatten() for x in lists], pa.string()).combine_chunks().dictionary_encode()
        self.rows.append(pa.RecordBatch.from_arrays([b.column(c) for c in ("site", "page_url", "ord", "block")], ["site", "page_url", "ord", "block"]))
        self.words.append(words)
        self.sizes.append(np.stack([np.diff(x.offsets.to_numpy()) for x in lists]))
        self.tokens += len(words)


def _run_lists(run: _Run, weights: list[float], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """LISTS of a run's rows, sorted by term, site and block."""
    table = pa.Table.from_batches(run.rows)
    column = lambda n: table.column(n).combine_chunks()
    sites = column("site").dictionary_encode()
    urls, ords, blocks = column("page_url"), column("ord").to_numpy(), column("block").to_numpy()
    groups, group = np.unique(sites.indices.to_numpy().astype(np.int64) << 32 | blocks, return_inverse=True)
    site_of, block_of_group = sites.dictionary.take(pa.array(groups >> 32)), (groups & 0xFFFFFFFF).astype(np.int32)
    order = np.argsort(group, kind="stable")  # rows of a group stand together, so a row's place tells its group
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    words = pa.chunked_array(run.words).unify_dictionaries()
    names = words.chunk(0).dictionary
    rank = np.empty(len(names), np.int64)
    by_name = pc.sort_indices(names)
    rank[by_name.to_numpy()] = np.arange(len(rank))
    keys, length = np.empty(run.tokens, np.int64), np.concatenate([x.sum(0) for x in run.sizes]).astype(np.int64)
    done = row = 0
    for chunk, sizes in zip(words.chunks, run.sizes, strict=True):  # term, row, column: one key a token
        own = rank[chunk.indices.to_numpy()] * (len(order) * len(weights))
        own += np.repeat(np.concatenate([place[row : row + sizes.shape[1]] * len(weights) + i for i in range(len(weights))]), sizes.reshape(-1))
        keys[done : done + len(own)] = own
        done, row = done + len(own), row + sizes.shape[1]
    run.words.clear()
    keys.sort()
    empty, n = pa.ListArray.from_arrays(pa.array(np.zeros(len(groups) + 1, np.int32)), pa.array([], schema.field("postings").type.value_type)), np.bincount(group)
    total = np.bincount(group, length).astype(np.int64)
    yield pa.RecordBatch.from_arrays([site_of, pa.array([""] * len(groups)), pa.array(block_of_group), pa.array(n), pa.nulls(len(groups), pa.float64()), pa.nulls(len(groups), pa.int64()), pa.array(total), empty], schema=schema)
    if not len(keys):
        return
    at = np.flatnonzero(np.diff(keys // len(weights), prepend=-1))  # where a posting starts
    f = np.add.reduceat(np.array(weights)[keys % len(weights)], at)
    term, row = np.divmod(keys[at] // len(weights), len(order))
    row = order[row]
    starts = np.flatnonzero(np.diff(term * len(groups) + group[row], prepend=-1))  # where a list starts
    ends = np.append(starts[1:], len(row))
    top, shortest = np.maximum.reduceat(f, starts), np.minimum.reduceat(length[row], starts)
    names, i = names.take(by_name), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BATCH_POSTINGS)))
        a, b = starts[i], ends[j - 1]
        of, g = row[a:b], group[row[starts[i:j]]]
        found = pa.StructArray.from_arrays([urls.take(pa.array(of)), pa.array(ords[of]), pa.array(length[of]), pa.array(f[a:b])], fields=list(schema.field("postings").type.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts[i:j], b) - a, pa.int32()), found)
        yield pa.RecordBatch.from_arrays([site_of.take(pa.array(g)), names.take(pa.array(term[starts[i:j]])), pa.array(block_of_group[g]), pa.array(ends[i:j] - starts[i:j]), pa.array(top[i:j]), pa.array(shortest[i:j]), pa.nulls(j - i, pa.int64()), lists], schema=schema)
        i = j


def term_lists(rows: DataFrame, weights: dict[str, float], bits: int = BLOCK_BITS) -> DataFrame:
    """LISTS of rows (site, page_url, perhaps ord, and the weighted columns), counted and sorted where the rows are: nothing is shuffled.

    A task sorts RUN_TERMS terms at a time, so a block whose rows are in several runs or tasks has as many rows of a term, which add up
    (see lists_read()). Deal rows with dealt_by_block() before, and blocks are whole as far as runs reach.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema, values = to_arrow_schema(StructType.fromDDL(LISTS)), list(map(float, weights.values()))
    ord_of = F.col("ord").cast("int") if "ord" in rows.columns else F.lit(0)
    listed = rows.select("site", "page_url", ord_of.alias("ord"), block_of(bits=bits).alias("block"), *[terms(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(weights)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Run()
        for b in batches:
            if b.num_rows:
                held.add(b, len(values))
            if held.tokens >= RUN_TERMS:
                yield from _run_lists(held, values, schema)
                held = _Run()
        if held.rows:
            yield from _run_lists(held, values, schema)

    return listed.mapInArrow(run, LISTS)


def block_bits(pages: int) -> int:
    """Bits of blocks of about 1,000 pages: from 32 blocks to 1,024. Of smaller ones a term's list would hold hardly more than one posting."""
    return min(BLOCK_BITS, max(5, round(pages / 1000).bit_length()))


def dealt_by_block(rows: DataFrame, bits: int, tasks: int) -> DataFrame:
    """rows (with page_url) dealt to tasks by ranges of blocks, each block to one task."""
    tasks = min(tasks, 1 << bits)
    return rows.repartitionById(tasks, F.floor(block_of(bits=bits) * F.lit(tasks) / F.lit(1 << bits)).cast("int"))


def lists_read(lists: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """postings, lexicon, bounds and stats of stored lists: only the columns that each needs are read, and of postings the terms that are asked for."""
    found, told = lists.filter("term <> ''"), lists.filter("term = ''")
    return {
        "postings": found.select("site", "term", "block", F.explode("postings").alias("_p")).select("site", "term", *[f"_p.{k}" for k in keys[1:]], "_p.doc_len", "_p.f", "block"),
        "lexicon": found.groupBy("site", "term").agg(F.sum("rows").alias("rows")),
        "bounds": found.select("site", "term", "block", "top", "shortest"),
        "stats": told.groupBy("site").agg(F.sum("rows").alias("n"), F.sum("total_len").alias("total_len")),
    }


def page_postings(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    return postings(indexed_chunks(chunks, pages), ["site", "page_url", "ord"], PAGE_WEIGHTS)


def product_postings(products: DataFrame) -> DataFrame:
    return postings(products, ["site", "page_url"], PRODUCT_WEIGHTS)


# --- sequence numbers and keep-latest tables ----------------------------------------------------------------


def assign_seq(batch: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """batch with dense sequence numbers after start, in the given order.

    Ranks come from range partitions: sort, number within a partition, add the sizes of those before. Only
    one count for each partition is gathered, so no single task sees the batch.
    """
    key = [F.col(c) for c in order]
    placed = batch.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    from quarry.sources.tables import compact

    placed, _ = compact(placed)  # range bounds are sampled: the numbering must not be computed twice
    sizes = placed.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn("seq", F.col("_before") + F.col("_at") + F.lit(start + 1)).drop("_part", "_at", "_id", "_before")


def next_seq(*tables: DataFrame) -> int:
    """The largest sequence number of the tables, which share one counter."""
    best = [t.agg(F.max("seq")).first()[0] for t in tables]
    return max([0, *(x for x in best if x is not None)])


def keep_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: of each key the row with the greatest seq. One shuffle by the key; max_by combines before it."""
    both = old.unionByName(new, allowMissingColumns=True)
    latest = both.groupBy(*keys).agg(F.max_by(F.struct("*"), "seq").alias("_row"))
    return latest.select("_row.*")


def upsert_pages(pages: DataFrame, chunks: DataFrame, new_pages: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New pages replace those of their url with all their chunks."""
    touched = new_pages.select("site", F.col("url").alias("page_url"))
    return keep_latest(pages, new_pages, ["site", "url"]), chunks.join(touched, ["site", "page_url"], "left_anti").unionByName(new_chunks)


def upsert_products(products: DataFrame, new: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """New products replace those of their page; removed holds (site, page_url) of pages without one. Removal takes no number."""
    kept = keep_latest(products, new, ["site", "page_url"])
    return kept if removed is None else kept.join(removed.select("site", "page_url"), ["site", "page_url"], "left_anti")


def delete_pages(pages: DataFrame, chunks: DataFrame, products: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the pages of gone (site, url)."""
    by_page = gone.select("site", F.col("url").alias("page_url"))
    return (
        pages.join(gone.select("site", "url"), ["site", "url"], "left_anti"),
        chunks.join(by_page, ["site", "page_url"], "left_anti"),
        products.join(by_page, ["site", "page_url"], "left_anti"),
    )


def ensure_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Additive migration: df with each missing column at its default; nothing where they are all there."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def backfill_seq(df: DataFrame, key: str, start: int) -> DataFrame:
    """Numbers for rows whose seq is 0, in key order, after start; other rows keep theirs."""
    todo = assign_seq(df.filter("seq = 0").drop("seq"), [key], start)
    return df.filter("seq <> 0").unionByName(todo.select(*df.columns))


# --- reports ------------------------------------------------------------------------------------------------


def items(pages: DataFrame, products: DataFrame, since: int = 0, limit: int = MANY_ITEMS, kind: str = "") -> DataFrame:
    """Changefeed: rows whose page or product changed after since, oldest change first; products overlay their page."""
    limit = MANY_ITEMS if limit <= 0 else limit
    p = pages.select("site", "url", "title", "hash", "crawled_at", "etag", F.col("seq").alias("page_seq"))
    q = products.select("site", F.col("page_url").alias("url"), F.col("seq").alias("product_seq"), "name", "price", "currency", "availability", "extraction_method", "verified_at")
    how = {"page": "left_anti", "product": "inner"}.get(kind, "left")
    rows = p.join(q, ["site", "url"], how)
    if kind == "page":
        rows = rows.select("*", F.lit(None).cast("bigint").alias("product_seq"), *[F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("price", "double"), ("currency", "string"), ("availability", "string"), ("extraction_method", "string"), ("verified_at", "timestamp"))])
    seq = F.greatest("page_seq", F.coalesce("product_seq", F.lit(0)))
    rows = rows.withColumn("seq", seq).filter(F.col("seq") > since)
    is_product = F.col("product_seq").isNotNull()
    shown = rows.select(
        "site", "url", F.when(is_product, "product").otherwise("page").alias("type"), F.when(is_product & (F.col("name") != ""), F.col("name")).otherwise(F.col("title")).alias("title"),
        "hash", "crawled_at", "etag", "seq", "price", "currency", "availability", "extraction_method", "verified_at",
    )
    return shown.orderBy("seq", "url").limit(limit)


def next_cursor(feed: DataFrame, since: int) -> int:
    """The greatest seq of a batch, or the old cursor if it is empty."""
    return feed.agg(F.coalesce(F.max("seq"), F.lit(since))).first()[0]


def sites(pages: DataFrame) -> DataFrame:
    return pages.select("site").distinct().orderBy("site")


def extraction_methods(products: DataFrame) -> DataFrame:
    return products.groupBy("site", "extraction_method").agg(F.count("*").alias("n"))


def site_stats(pages: DataFrame, chunks: DataFrame, products: DataFrame) -> DataFrame:
    """One row for each site: counts, first and last crawl, last verification, products by extraction method."""
    return merged_stats(partial_stats(pages, chunks, products))


def partial_stats(pages: DataFrame, chunks: DataFrame, products: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of statistics of each site (and of each value of `by`, which all three tables have) that add up: see merged_stats()."""
    keys = ["site", *by]
    p = pages.groupBy(*keys).agg(F.count("*").alias("pages"), F.min("crawled_at").alias("first_crawled"), F.max("crawled_at").alias("last_crawled"))
    c = chunks.groupBy(*keys).agg(F.count("*").alias("chunks"))
    m = products.groupBy(*keys, "extraction_method").agg(F.count("*").alias("n"), F.max("verified_at").alias("verified_at"))
    of = F.map_from_entries(F.array_sort(F.collect_list(F.struct("extraction_method", "n"))))
    q = m.groupBy(*keys).agg(F.sum("n").alias("products"), F.max("verified_at").alias("last_verified"), of.alias("extraction_methods"))
    both = p.unionByName(c, allowMissingColumns=True).unionByName(q, allowMissingColumns=True)
    return both.groupBy(*keys).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("pages", "chunks", "products")], F.min("first_crawled").alias("first_crawled"), F.max("last_crawled").alias("last_crawled"), F.max("last_verified").alias("last_verified"),
        F.first("extraction_methods", ignorenulls=True).alias("extraction_methods"),
    )


def merged_stats(parts: DataFrame) -> DataFrame:
    """Statistics of each site from rows of partial_stats(), however the rows were cut; sites without pages are left out."""
    sums = parts.groupBy("site").agg(*[F.sum(n).alias(n) for n in ("pages", "chunks", "products")], F.max("last_crawled").alias("last_crawled"), F.min("first_crawled").alias("first_crawled"), F.max("last_verified").alias("last_verified"))
    each = parts.select("site", F.explode("extraction_methods").alias("extraction_method", "n")).groupBy("site", "extraction_method").agg(F.sum("n").alias("n"))
    methods = each.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("extraction_method", "n")))).alias("extraction_methods"))
    return sums.filter("pages > 0").join(methods, "site", "left")


def merged_corpus_stats(parts: DataFrame) -> DataFrame:
    return parts.groupBy("site").agg(F.sum("n").alias("n"), F.sum("total_len").alias("total_len"))


def merged_lexicon(parts: DataFrame) -> DataFrame:
    return parts.groupBy("site", "term").agg(F.sum("rows").alias("rows"))
