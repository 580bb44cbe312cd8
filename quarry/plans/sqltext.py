"""The same operators spelled in SQL for DuckDB, used as oracles only."""

from __future__ import annotations

from quarry.functions.text import TERM, fold_table, query_tokens
from quarry.operators.index import PAGE_WEIGHTS, PRODUCT_WEIGHTS
from quarry.operators.search import B, FAN_OUT, K1, LEAST_CANDIDATES, LEAST_IDF, METHOD_BONUS, PHRASE_BONUS, Term, soft_terms, strict_terms

SITE = "docs.example"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    a, b = fold_table()
    return f"regexp_replace(translate(lower({x}), {quote(a)}, {quote(b)}), '\\p{{Mn}}', '', 'g')"


def terms(x: str) -> str:
    return f"regexp_extract_all({fold(f'coalesce({x}, {quote(str())})')}, {quote(TERM)})"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def pages() -> str:
    return (
        f"SELECT '{SITE}' AS site, 'https://{SITE}/' || doc_id AS url, doc_id, coalesce(source, '') || ' ' || coalesce(lang, '') AS title, coalesce(lang, '') AS lang, "
        "sha256(coalesce(text, '')) AS hash, coalesce(text, '') AS text, doc_id + 1 AS seq FROM documents"
    )


def pieces(src: str, keys: str, target: int = 1200, overlap: int = 100) -> str:
    step = target - overlap
    return f"""
    SELECT {keys}, piece, {trim("substring(t, piece * " + str(step) + " + 1, cut - piece * " + str(step) + ")")} AS text FROM (
      SELECT *, CASE WHEN e < n AND regexp_matches(tail, '\\s') THEN greatest(e - 49, 1) + length(regexp_extract(tail, '(?s)^(.*)\\s', 1)) ELSE e END AS cut FROM (
        SELECT *, substring(t, greatest(e - 49, 1) + 1, e - greatest(e - 49, 1) + 1) AS tail FROM (
          SELECT *, least(piece * {step} + {target}, n) AS e FROM (
            SELECT {keys}, t, length(t) AS n, unnest(generate_series(0, CASE WHEN length(t) > {target} THEN CAST(ceil((length(t) - {target}) / {step}.0) AS BIGINT) ELSE 0 END)) AS piece
            FROM (SELECT {keys}, {trim("text")} AS t FROM ({src}))))))"""


def chunks(target: int = 1200, overlap: int = 100) -> str:
    return f"""SELECT site, url AS page_url, doc_id, title, row_number() OVER (PARTITION BY url ORDER BY piece) - 1 AS ord, '' AS heading_path, text
    FROM ({pieces(pages(), "site, url, doc_id, title", target, overlap)}) WHERE text <> ''"""


def products() -> str:
    methods = ["json-ld", "microdata", "opengraph", "heuristic", "llm"]
    return (
        f"SELECT '{SITE}' AS site, 'https://{SITE}/' || p_partkey AS page_url, p_partkey, p_name AS name, p_brand || ' ' || p_type AS description, p_retailprice AS price, "
        f"'USD' AS currency, CASE WHEN p_size % 3 = 0 THEN 'out_of_stock' ELSE 'in_stock' END AS availability, {methods}[CAST(p_partkey % 5 + 1 AS INT)] AS extraction_method, "
        "2 * p_partkey + 1 AS seq FROM part"
    )


def _match(t: Term) -> str:
    return f"starts_with(term, {quote(t.text)})" if t.prefix else f"term = {quote(t.text)}"


def bm25(rows: str, keys: list[str], weights: dict[str, float], query: list[Term]) -> str:
    k = ", ".join(keys)
    distinct = list(dict.fromkeys(query))
    union = " UNION ALL ".join(f"SELECT {k}, unnest({terms(c)}) AS term, {w} AS w FROM ({rows})" for c, w in weights.items())
    length = " + ".join(f"len({terms(c)})" for c in weights)
    sums = ", ".join(f"coalesce(sum(w) FILTER (WHERE {_match(t)}), 0.0) AS f{i}" for i, t in enumerate(distinct))
    counts = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(distinct)))
    rank = " - ".join(
        ["0.0"]
        + [
            f"{query.count(t)}.0 * (CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE {LEAST_IDF} END) * f{i} * {K1 + 1} / (f{i} + {K1}::DOUBLE * ({1 - B} + {B}::DOUBLE * doc_len / (total_len / n)))"
            for i, t in enumerate(distinct)
        ]
    )
    every = " AND ".join(f"f{i} > 0" for i in range(len(distinct)))
    return f"""
    SELECT {k}, CAST({rank} AS DOUBLE) AS rank FROM
      (SELECT {k}, {sums} FROM ({union}) GROUP BY {k}) JOIN (SELECT {k}, {length} AS doc_len FROM ({rows})) USING ({k}),
      (SELECT {counts} FROM (SELECT {k}, {sums} FROM ({union}) GROUP BY {k})), (SELECT count(*)::DOUBLE AS n, sum({length})::DOUBLE AS total_len FROM ({rows}))
    WHERE {every}"""


def snippet(x: str) -> str:
    t = trim(x)
    head = f"substring({t}, 1, 201)"
    kept = f"regexp_extract({head}, '(?s)^(.*)\\s', 1)"
    return f"CASE WHEN length({t}) <= 200 THEN {t} ELSE (CASE WHEN {kept} = '' THEN substring({t}, 1, 200) ELSE regexp_replace({kept}, '\\s+$', '') END) || '…' END"


def score(x: str) -> str:
    return f"greatest(0.0, -({x})) / (1.0 + greatest(0.0, -({x})))"


def search(query: str, limit: int = 10, kind: str = "", with_products: bool = True, target: int = 1200, overlap: int = 100, parts: list[Term] | None = None) -> str:
    q = strict_terms(query) if parts is None else parts
    phrase = quote(" ".join(query_tokens(query)).lower())
    fan = max(LEAST_CANDIDATES, limit * FAN_OUT)
    out = []
    c, p = chunks(target, overlap), products()
    page = f"""SELECT url, 'page' AS type, title, {snippet("text")} AS snippet, CAST(NULL AS DOUBLE) AS price, '' AS extraction_method, adj FROM (
      SELECT *, row_number() OVER (PARTITION BY url ORDER BY adj, rank, ord) AS rn FROM (
        SELECT page_url AS url, ord, title, text, rank, rank - CASE WHEN contains(lower(title || ' ' || heading_path || ' ' || text), {phrase}) THEN {PHRASE_BONUS} ELSE 0.0 END AS adj
        FROM ({c}) JOIN (SELECT * FROM ({bm25(c, ["page_url", "ord"], PAGE_WEIGHTS, q)}) ORDER BY rank, page_url, ord LIMIT {fan}) USING (page_url, ord))) WHERE rn = 1"""
    bonus = "CASE extraction_method " + " ".join(f"WHEN {quote(m)} THEN {v}" for m, v in METHOD_BONUS.items()) + " ELSE 0.0 END"
    product = f"""SELECT page_url AS url, 'product' AS type, name AS title, {snippet("description")} AS snippet, price, extraction_method,
      rank - ({bonus}) - CASE WHEN contains(lower(name || ' ' || description), {phrase}) THEN {PHRASE_BONUS} ELSE 0.0 END AS adj
      FROM ({p}) JOIN (SELECT * FROM ({bm25(p, ["page_url"], PRODUCT_WEIGHTS, q)}) ORDER BY rank, page_url LIMIT {fan}) USING (page_url)"""
    if with_products and kind != "page":
        out.append(product)
    if kind != "product":
        out.append(f"SELECT * FROM ({page}) WHERE url NOT IN (SELECT url FROM ({product}))" if out else page)
    both = " UNION ALL ".join(out)
    return f"SELECT url, type, title, snippet, price, extraction_method, round({score('adj')}, 6) AS score FROM ({both}) ORDER BY {score('adj')} DESC, type <> 'product', adj, url LIMIT {limit}"


def search_soft(query: str, limit: int = 10, kind: str = "", with_products: bool = False) -> str:
    tiers = [search(query, limit, kind, with_products)] + [search(query, limit, kind, with_products, parts=soft_terms(query, k)) for k in (1, 2, 3)]
    union = " UNION ALL ".join(f"SELECT {i} AS tier, * FROM ({t})" for i, t in enumerate(tiers))
    return f"WITH t AS ({union}) SELECT * EXCLUDE (tier) FROM t WHERE tier = (SELECT min(tier) FROM t)"
