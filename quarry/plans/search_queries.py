"""Search, tokens, snippets, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunk, index
from quarry.operators.search import search, search_soft
from quarry.plans import sqltext as S
from quarry.plans import tables

QUERY, PRODUCT_QUERY = "licensed under", "blue bolt"
COMMON_QUERY = "the in"
#: Found by prefixes cut by three letters, by one, and by none.
SOFT_QUERY, SOFT_NEAR, SOFT_EXACT = "licensedabc underabc", "licensedx underz", "licensed under"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("url", "type", "title", "snippet", "price", "extraction_method", F.round("score", 6).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search(tables.stored_index(spark, sf_dir, False), QUERY))


def _search(query: str, kind: str = "", with_products: bool = True):
    return lambda spark, d: _shown(search(tables.stored_index(spark, d, with_products and kind != "page", kind != "product"), query, 10, kind)), S.search(query, 10, kind, with_products)


def _soft(query: str, with_products: bool = False):
    return lambda spark, d: _shown(search_soft(tables.stored_index(spark, d, with_products), query)), S.search_soft(query, with_products=with_products)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored dictionary of the chunks' terms."""
    return tables.stored_index(spark, sf_dir, False).chunk_lexicon.select("term", "rows")


def common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the commonest terms: blocks without a good row are not read."""
    return _shown(search(tables.stored_index(spark, sf_dir, False), COMMON_QUERY))


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.pages(spark, sf_dir).select(F.explode(T.terms(F.col("text"))).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("n"))


def fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pages(spark, sf_dir).select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pages(spark, sf_dir).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.col("doc_id").cast("double") / -7.0 + F.lit(3.0)
    return tables.pages(spark, sf_dir).select("doc_id", F.round(T.score_from_rank(rank), 9).alias("score"), F.round(T.positional_score(F.col("doc_id").cast("double") % 30), 9).alias("place_score"))


def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.search_index(spark, sf_dir, False).chunk_postings
    return p.groupBy("page_url", "ord").agg(F.count("*").alias("terms"), F.sum("f").alias("weight"), F.max("doc_len").alias("doc_len"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.search_index(spark, sf_dir, False).chunk_stats


def _chunks(target: int, overlap: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.chunks(spark, sf_dir, target, overlap).select("page_url", F.col("ord").cast("long").alias("ord"), "text")

    return run, f"SELECT page_url, ord, text FROM ({S.chunks(target, overlap)})"


#: A document as markdown: all its lines, before every third one a heading of a level given by its place.
_MARKED = "array_join(transform(split(text, '\\n', -1), (l, i) -> if(i % 3 = 0, concat(repeat('#', cast(i / 3 as int) % 3 + 1), ' ', substring(l, 1, 20), '\\n', l), l)), '\\n')"


def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = tables.pages(spark, sf_dir).withColumn("markdown", F.expr(_MARKED))
    return chunk.chunk_pages(marked, ["url"]).select("url", F.col("ord").cast("long").alias("ord"), "heading_path", "text")


def _breadcrumb_sql() -> str:
    mark = "CASE WHEN (i - 1) % 3 = 0 THEN repeat('#', CAST(((i - 1) // 3) % 3 + 1 AS INT)) || ' ' || substring(l, 1, 20) || chr(10) || l ELSE l END"
    marked = f"SELECT url, string_split(array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: {mark}), chr(10)), chr(10)) AS m FROM ({S.pages()})"
    lines = f"SELECT url, unnest(m) AS line, generate_subscripts(m, 1) - 1 AS i FROM ({marked})"
    path = ", ".join(f"coalesce(last_value(CASE WHEN lv = {n} THEN ti WHEN lv > 0 AND lv < {n} THEN '' END IGNORE NULLS) OVER w, '') AS h{n}" for n in (1, 2, 3))
    head = "regexp_matches(line, '^#{1,6}\\s+(.*)$')"
    return f"""
    SELECT url, row_number() OVER (PARTITION BY url ORDER BY section, piece) - 1 AS ord, heading_path, text FROM ({S.pieces(f'''
      SELECT url, section, array_to_string(list_filter([max(h1), max(h2), max(h3)], lambda x: x <> ''), ' > ') AS heading_path, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE lv = 0) AS text FROM (
        SELECT *, sum(CASE WHEN lv > 0 THEN 1 ELSE 0 END) OVER w AS section, {path} FROM (
          SELECT *, CASE WHEN {head} THEN length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) ELSE 0 END AS lv, trim(regexp_extract(line, '^#{{1,6}}\\s+(.*)$', 1)) AS ti FROM (
            SELECT * FROM ({lines})))
        WINDOW w AS (PARTITION BY url ORDER BY i ROWS UNBOUNDED PRECEDING)) GROUP BY url, section''', "url, section, heading_path")}) WHERE text <> ''"""


def queries_of() -> dict:
    return {
        "search_flagship": (flagship, S.search(QUERY, with_products=False)),
        "search_common": (common, S.search(COMMON_QUERY, with_products=False)),
        "search_soft": _soft(SOFT_QUERY),
        "search_soft_near": _soft(SOFT_NEAR, True),
        "search_soft_exact": _soft(SOFT_EXACT),
        "term_lexicon": (lexicon, f"""WITH c AS ({S.chunks()}), t AS (SELECT page_url, ord, unnest(list_concat({S.terms('title')}, {S.terms('text')})) AS term FROM c)
            SELECT term, count(*) AS rows FROM (SELECT DISTINCT page_url, ord, term FROM t) GROUP BY term"""),
        "search_products": _search(PRODUCT_QUERY),
        "search_merged": _search("small ring"),
        "search_type_page": _search(QUERY, "page"),
        "search_type_product": _search("red", "product"),
        "tokenize_terms": (tokenize_terms, f"SELECT term, count(*) AS n FROM (SELECT unnest({S.terms('text')}) AS term FROM documents) GROUP BY term"),
        "fold_accents": (fold_accents, f"SELECT doc_id, sha256({S.fold('''coalesce(text, '')''')}) AS folded FROM documents"),
        "snippet_200": (snippets, f"SELECT doc_id, {S.snippet('''coalesce(text, '')''')} AS snippet FROM documents"),
        "score_from_rank": (scores, f"SELECT doc_id, round({S.score('doc_id / -7.0::DOUBLE + 3.0')}, 9) AS score, round(greatest(0.1::DOUBLE, 1.0::DOUBLE - 0.05::DOUBLE * (doc_id % 30)), 9) AS place_score FROM documents"),
        "postings_build": (postings_build, f"""WITH c AS ({S.chunks()}), t AS (
            SELECT page_url, ord, unnest({S.terms('title')}) AS term, 5.0::DOUBLE AS w FROM c UNION ALL SELECT page_url, ord, unnest({S.terms('text')}), 1.0::DOUBLE FROM c)
            SELECT page_url, ord::INT AS ord, count(DISTINCT term) AS terms, sum(w) AS weight, count(*) AS doc_len FROM t GROUP BY ALL"""),
        "corpus_stats": (corpus_stats, f"SELECT site, count(*) AS n, sum(len({S.terms('title')}) + len({S.terms('text')}))::BIGINT AS total_len FROM ({S.chunks()}) GROUP BY site"),
        "chunk_fixed": _chunks(1200, 100),
        "chunk_overlap0_loss": _chunks(500, 0),
        "chunk_heading_breadcrumbs": (breadcrumbs, _breadcrumb_sql()),
    }


QUERIES = queries_of()
