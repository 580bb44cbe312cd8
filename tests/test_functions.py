"""Scalar functions: the same table-driven cases on Spark and, where there is a twin, in Python."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import urls
from quarry.html import product as P

#: By rule: only digits and signs count; the later of comma and full stop is the decimal point, and of several commas only the first.
PRICES = [
    *[("gratis", None), ("p.o.a.", None), ("", None), ("3-4", None)],
    *[("8", 8.0), ("\t615 \n", 615.0), ("approx 88", 88.0), ("-5.5 off", -5.5)],
    *[("7.25", 7.25), ("USD 0.99", 0.99), ("12,345.5", 12345.5), ("1,000,000.25", 1000000.25)],
    *[("7,25", 7.25), ("6.543,10 €", 6543.1), ("315,5 lei", 315.5), ("2,718", 2.718)],
    *[("9,876,543", None), ("5.000.000", None)],
]
#: By rule: what says no wins; case, underscores and hyphens don't count.
STOCK = [
    *[(x, "out_of_stock") for x in ("SoldOut", "this item is SOLD OUT", "https://schema.org/Discontinued", "out_of_stock", "OOS", "not in stock: out of stock")],
    *[(x, "in_stock") for x in ("InStock", "3 left in stock", "Pre-Order now", "available for order", "https://schema.org/LimitedAvailability", "presale")],
    *[(x, "unknown") for x in ("", "ask us", "oos?", "stock")],
]
CURRENCIES = [("", ""), ("100", ""), ("CA$ 3", "USD"), ("from €9 or £8", "EUR"), ("£8", "GBP"), ("20 Lei", "RON"), ("RON20", "RON"), ("ron 20", "")]
#: By rule: scheme and host in lower case, default ports, fragment and one closing slash go, the rest stays.
NORMAL = [
    ("HTTP://Docs.Quarry.TEST/Guide/", "http://docs.quarry.test/Guide"), ("https://quarry.test", "https://quarry.test/"), ("https://quarry.test/", "https://quarry.test/"), ("https://quarry.test//", "https://quarry.test/"),
    ("http://quarry.test:80/x/y", "http://quarry.test/x/y"), ("https://quarry.test:443", "https://quarry.test/"), ("http://quarry.test:443/x", "http://quarry.test:443/x"), ("https://quarry.test:9000/", "https://quarry.test:9000/"),
    ("https://quarry.test/x/#a/b", "https://quarry.test/x"), ("https://quarry.test/find?q=A&&r", "https://quarry.test/find?q=A&&r"), ("https://quarry.test/two words|bar", "https://quarry.test/two words|bar"),
]
DOMAINS = [("quarry.test", "quarry.test"), ("a.b.c.quarry.test", "quarry.test"), ("news.bbc.co.uk", "bbc.co.uk"), ("https://Www.Quarry.Test:81/p", "quarry.test"), ("10.1.2.3:99", "10.1.2.3"), ("devbox", "devbox"), ("a.b.github.io", "b.github.io"), ("github.io", "github.io"), ("w.x.y.kawasaki.jp", "x.y.kawasaki.jp"), ("www.city.kobe.jp", "city.kobe.jp"), ("y.kawasaki.jp", "y.kawasaki.jp"), ("a.www.ck", "www.ck"), ("", "")]
SLUGS = [("https://q.test", "index.md"), ("https://q.test/docs/", "docs.md"), ("https://q.test/Docs/Set%20up/step+1?lang=en#x", "Docs/Set-up/step-1.md"), ("https://q.test/x/y/../../z", "z.md"), ("https://q.test/naïve/Übung", "naïve/Übung.md"), ("https://q.test/(((/", "page.md")]


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


@pytest.mark.parametrize(
    ("cases", "native", "twin"),
    [(PRICES, T.price, P.parse_price), (STOCK, T.availability, P.availability_of), (CURRENCIES, T.currency, P.currency_of), (NORMAL, urls.normalize, urls.normalize_py), (DOMAINS, urls.registrable_domain, urls.registrable_domain_py), (SLUGS, urls.slug, urls.slug_py)],
    ids=["price", "stock", "currency", "normalize", "domain", "slug"],
)
def test_tables(spark, cases, native, twin):
    values, wanted = [a for a, _ in cases], [b for _, b in cases]
    assert column(spark, values, native) == wanted
    assert [twin(v) for v in values] == wanted


def test_terms(spark):
    got = column(spark, ["Straße foo_bar don't 1,234.5 x² Ⅷ ăbc½x", "ăb й й", "ΣΑΣ"], T.terms)
    assert got[0] == ["straße", "foo", "bar", "don", "t", "1", "234", "5", "x²", "ⅷ", "abc½x"]
    assert got[1] == ["ab", "й", "и"]
    assert got[2] == ["σασ"]


def test_query_tokens():
    assert T.query_tokens("Blue-shoes, 42 x²!") == ["Blue", "shoes", "42", "x"]
    assert T.query_tokens("ăb") == ["a", "b"]
    assert T.query_tokens(" … ") == []


def test_snippet(spark):
    long = "word " * 60
    short, cut, hard = column(spark, ["  hi  ", long, "😀" * 300], T.snippet)
    assert short == "hi"
    assert cut == ("word " * 40).strip() + "…"
    assert hard == "😀" * 200 + "…"


def test_stale(spark):
    now = F.expr("timestamp'2024-01-02 00:00:00'")
    assert column(spark, ["", "never", "2024-01-01T00:00:00Z", "2024-01-01T12:00:00Z"], lambda c: T.stale(c, now, 86400)) == [True, True, True, False]


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"https?://[A-Za-z.]{1,8}(:80|:443)?(/[a-z]{0,3}){0,3}(\?[a-z=&]{0,5})?(#[a-z]{0,3})?", fullmatch=True))
def test_normalize_twice(url):
    """One closing slash goes at a time, so only paths that end in several are changed again."""
    once = urls.normalize_py(url)
    path = url.split("#")[0].split("?")[0]
    assert urls.normalize_py(once) == once or path.endswith("//")
