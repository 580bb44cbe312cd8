"""Named queries over the driver tables and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import crawl_queries, engine_queries, html_queries, index_queries, search_queries, stream_queries

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def _all() -> dict[str, Query]:
    return dict(chain.from_iterable(m.QUERIES.items() for m in (search_queries, index_queries, crawl_queries, html_queries, engine_queries, stream_queries)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
