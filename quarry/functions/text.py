"""Scalar functions as Column expressions: folding, tokens, snippets, scores, prices, stock, currency."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Index terms are runs of letters, numbers and private-use characters; query tokens of letters and decimal digits.
TERM = r"[\p{L}\p{N}\p{Co}]+"
TOKEN = r"[\p{L}\p{Nd}]+"


@lru_cache
def fold_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their bare letters, derived from the Unicode decompositions, and final sigma."""
    accented, bare = [], []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(cp)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and d[0].isascii() and d[0].isalpha() and c == c.lower():
            accented.append(c)
            bare.append(d[0])
    return "".join(accented) + "ς", "".join(bare) + "σ"


def fold(c: Column) -> Column:
    """Lower-case, strip accents of Latin letters, drop combining marks."""
    a, b = fold_table()
    whole = F.regexp_replace(F.translate(F.lower(c), a, b), r"\p{Mn}", "")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(whole)  # ASCII has no accents


def terms(c: Column) -> Column:
    """Index terms of a text, repeats included."""
    return F.regexp_extract_all(fold(c), F.lit(TERM), F.lit(0))


def query_tokens(query: str) -> list[str]:
    """Runs of letters and decimal digits; everything else, combining marks too, separates."""
    out, run = [], []
    for ch in query + " ":
        if ch.isalpha() or unicodedata.category(ch) == "Nd":
            run.append(ch)
        elif run:
            out.append("".join(run))
            run = []
    return out


def fold_text(s: str) -> str:
    """fold() for driver-side strings."""
    a, b = fold_table()
    s = s.lower().translate(str.maketrans(a, b))
    return "".join(ch for ch in s if unicodedata.category(ch) != "Mn")


def normalised_query(tokens: list[str]) -> str:
    return " ".join(tokens).lower()


def snippet(c: Column, limit: int = 200) -> Column:
    """The trimmed text if it has at most limit code points; else cut at the last white space there, with an ellipsis."""
    t = F.regexp_replace(c, r"^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$", "")
    head = F.substring(t, 1, limit)
    kept = F.regexp_extract(F.substring(t, 1, limit + 1), r"(?s)^(.*)\s", 1)
    cut = F.when(kept == "", head).otherwise(F.regexp_replace(kept, r"\s+$", ""))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(cut, F.lit("…")))


def score_from_rank(rank: Column) -> Column:
    d = F.greatest(F.lit(0.0), -rank)
    return d / (F.lit(1.0) + d)


def positional_score(position: Column) -> Column:
    """Score of the n-th result (from 0) of a site's own search."""
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.05) * position)


def decimal_point(s: Column) -> Column:
    """The later of comma and full stop is the decimal point; of a winning comma only the first one."""
    comma = F.length(s) - F.instr(F.reverse(s), ",") + 1
    dot = F.when(F.instr(s, ".") > 0, F.length(s) - F.instr(F.reverse(s), ".") + 1).otherwise(0)
    plain = F.replace(s, F.lit(","), F.lit(""))
    swapped = F.regexp_replace(F.replace(s, F.lit("."), F.lit("")), r"^([^,]*),", "$1.")
    return F.when(F.instr(s, ",") == 0, s).when(comma > dot, swapped).otherwise(plain)


def price(c: Column) -> Column:
    """A price in free text, null if there is none."""
    return decimal_point(F.regexp_replace(c, r"[^0-9.,-]", "")).try_cast("double")


def currency(c: Column) -> Column:
    """Symbols and codes in order of precedence."""
    return (
        F.when(c.contains("$"), "USD")
        .when(c.contains("€"), "EUR")
        .when(c.contains("£"), "GBP")
        .when(F.lower(c).contains("lei") | c.contains("RON"), "RON")
        .otherwise("")
    )


#: What a stock text may say, out of stock first.
OUT_OF_STOCK = ("outofstock", "out of stock", "soldout", "sold out", "discontinued")
IN_STOCK = ("instock", "in stock", "limitedavailability", "limited availability", "available for order", "preorder", "presale")


def availability(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), "[_-]", "")
    says = lambda words: s.rlike("|".join(words))
    return F.when(says(OUT_OF_STOCK) | (s == "oos"), "out_of_stock").when(says(IN_STOCK), "in_stock").otherwise("unknown")


def rfc3339(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_rfc3339(c: Column) -> Column:
    """Null where the text is no such time."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def stale(last: Column, now: Column, interval_seconds: int) -> Column:
    """Whether a time (RFC 3339 text) is missing, unreadable or at least the interval ago."""
    then = from_rfc3339(last)
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(then)) >= interval_seconds, F.lit(True))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)
