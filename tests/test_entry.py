"""The driver's contract, over the smallest tables."""

import os

import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


def test_entry(spark):
    rows = e.entry(spark).collect()
    assert 0 < len(rows) <= 10


def test_oracles_name_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["items_feed", "robots_allowed", "chunk_fixed", "page_title", "product_chain_methods", "price_parse", "bfs_frontier", "bfs_max_pages", "content_parts", "page_links", "fetch_pages", "sitemap_tree", "kb_files", "search_merged", "stream_changefeed", "site_stats", "chunk_heading_breadcrumbs", "search_soft_near", "search_common", "term_lexicon", "stats_merged", "verified_overlay", "registrable_rules", "sitemap_events", "stream_paced", "stream_recrawl_due"])
def test_against_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = e.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    wanted = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({e.oracle_sql()[name]})").fetchall(), key=repr)
    assert got == wanted
