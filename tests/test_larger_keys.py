"""Queries against their SQL on keys and numbers of rows that the smallest tables do not have."""

import __spark_entry__ as e
from quarry.html import content
from quarry.html.tree import parse
from quarry.html.udfs import dealt


def _matches(spark, name, **tables):
    import duckdb

    folder, con = tables.pop("folder"), duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = e.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    wanted = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({e.oracle_sql()[name]})").fetchall(), key=repr)
    assert got == wanted
    return len(got)


def _parts(spark, n, step=1):
    return spark.range(n).selectExpr(f"id * {step} AS p_partkey", "concat('blue bolt ', id) AS p_name", "'Brand#1' AS p_brand", "'SMALL BRASS' AS p_type", "cast(id % 50 AS int) AS p_size", "cast(900.5 + id % 100 AS double) AS p_retailprice")


def _documents(spark, n, step=1):
    return spark.range(n).selectExpr(f"id * {step} AS doc_id", "concat('text of ', id) AS text", "'en' AS lang", "'web' AS source", "10L AS n_chars")


def test_sitemap_tree_of_more_urls_than_a_file_holds(spark, tmp_path):
    assert _matches(spark, "sitemap_tree", folder=tmp_path, part=_parts(spark, 104_000)) == 52_000


def test_feed_of_numbers_beyond_the_first_stop(spark, tmp_path):
    """Products and pages whose first numbers are greater than those at which the stream is stopped."""
    assert _matches(spark, "stream_feed", folder=tmp_path, documents=_documents(spark, 60, 30_001), part=_parts(spark, 60, 30_001)) > 60


def test_references_in_titles(spark):
    """As HTML reads them: &quot; is a quotation mark, and &amp needs no semicolon before what is no letter."""
    doc = parse('<title>a &quot;b&quot; &lt;c&gt; d&amp</title><h1>a &quot;b&quot; d&amp</h1>')
    page = content.extract("", "https://a.example/", doc)
    assert page.title == 'a "b" <c> d&' and page.headings == [(1, 'a "b" d&')]


def test_pages_are_dealt_to_tasks(spark):
    """One row group, one task that reads it; parsing takes as many tasks as a shuffle has, and batches stay small."""
    rows = spark.range(0, 1000, 1, 1)
    assert rows.rdd.getNumPartitions() == 1
    got = dealt(rows, "id")
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert got.count() == 1000


def test_tables_made_of_those_just_written(spark, tmp_path):
    """A commit's lookups come from its postings as stored: nothing else is kept or shuffled for them."""
    from quarry.sources.tables import Store

    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("s", "u", 0, 3, "a", 2.0, 1, 0), ("s", "v", 0, 5, "a", 1.0, 1, 0), ("s", "w", 0, 5, "b", 1.0, 40, 1)], "site string, page_url string, ord int, doc_len long, term string, f double, block int, bucket int")
    count = lambda read: {"lexicon": read("postings").groupBy("site", "term", "bucket").agg({"*": "count"}).withColumnRenamed("count(1)", "rows")}
    store.commit(store.snapshot("s"), {"postings": rows}, [0, 1], then=count)
    assert sorted((r.term, r.rows) for r in store.read("lexicon", "s").collect()) == [("a", 2), ("b", 1)]


def test_chunks_are_cut_by_many_tasks(spark, tmp_path):
    """One row group of documents, one task that reads it; cutting and counting take as many tasks as a shuffle has."""
    from quarry.plans import tables

    _documents(spark, 50).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert tables.chunks(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_products_are_found_without_documents(spark, tmp_path):
    """A search for products builds and reads nothing of pages; one for pages nothing of products."""
    from quarry.plans import tables

    _parts(spark, 40).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert e.queries()["search_type_product"](spark, str(tmp_path)).count() == 0
    index = tables.stored_index(spark, str(tmp_path), with_pages=False)
    assert index.texts is None and index.product_stats.first()["n"] == 40 and index.product_lexicon.filter("term = 'bolt'").first()["rows"] == 40
    _documents(spark, 30).coalesce(1).write.parquet(f"{tmp_path}/only/documents.parquet")
    assert e.queries()["search_type_page"](spark, f"{tmp_path}/only").count() == 0


def test_stored_index_matches_its_sql(spark, tmp_path):
    documents = spark.range(3000).selectExpr("id AS doc_id", "concat(repeat(concat('word', id % 40, ' of the small ring '), cast(id % 90 as int)), if(id % 3 = 0, 'licensed under Äpfel', '')) AS text", "'en' AS lang", "'web' AS source", "10L AS n_chars")
    assert _matches(spark, "term_lexicon", folder=tmp_path, documents=documents, part=_parts(spark, 300)) > 40
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("search_flagship", "search_merged", "search_products", "search_type_page", "search_common"):
        got = e.queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()[name]})").fetchall(), key=repr)


def test_files_are_read_by_tasks(spark, tmp_path):
    """No driver lists the files: the plan has no file scan. A file that is missing is told."""
    import pytest
    from pyspark.errors import PythonException

    from quarry.sources import export

    assert _matches(spark, "kb_written", folder=tmp_path, documents=_documents(spark, 60)) == 60
    pages = spark.createDataFrame([("s", "https://s/a"), ("s", "https://s/b")], "site string, url string")
    (tmp_path / "s/kb").mkdir(parents=True)
    (tmp_path / "s/kb/a.md").write_text("---\nä")
    found = export.read_markdown(pages.limit(1), str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [("s", "a.md", "---\nä")] and "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(PythonException):
        export.read_markdown(pages, str(tmp_path)).collect()


def test_a_write_keeps_chunks_once(spark, tmp_path, monkeypatch):
    """Of the tables that a write keeps for a while one holds chunks; what is stored of pages written twice is what the SQL says."""
    from quarry import engine

    kept, compact = [], engine.compact
    monkeypatch.setattr(engine, "compact", lambda df: kept.append(df.columns) or compact(df))
    assert _matches(spark, "store_upsert", folder=tmp_path, documents=_documents(spark, 70)) == 70
    assert sum({"ord", "text"} <= set(c) for c in kept) == 2  # of two writes
