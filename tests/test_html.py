"""Trees, markdown and products."""

import pytest

from quarry.html import content, product
from quarry.html.tree import parse
from quarry.html.udfs import understand

URL = "https://shop.example/a/page"


def markdown(body: str) -> str:
    return content.Markdown(URL).render(parse(body).first("body"))


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("<h2>A</h2><p>b <b>c</b> d</p>", "## A\n\nb**c**d"),
        ("<ul><li>a<ul><li>b</ul><li><li>c</ul><ol><li>x</li><li></li><li>y</li></ol>", "- a\n  - b\n- c\n\n1. x\n3. y"),
        ("<blockquote><p>q<p>r</blockquote>", "> q\n> \n> r"),
        ("<pre>\n  x\n\ty\n</pre><hr>", "```\n  x\n\ty\n```\n\n---"),
        ("<table><tr><th>a<th>b<tr><td>1</table>", "| a | b |\n| --- | --- |\n| 1 |  |"),
        ('<p>see <a href="/für">it</a> <a href="javascript:x">no</a> <img alt=" i " data-src="i.png">', "see[it](https://shop.example/f%C3%BCr)no![i](https://shop.example/a/i.png)"),
        ("<p><b>one<br><p>two</p><p>three", "**one**\n\n**two**\n\n**three**"),
        ("<p><b>1<p><b>2<p><b>3<p><b>4<p>5", "**1**\n\n****2****\n\n******3******\n\n********4********\n\n******5******"),
        ("<p>1<b>2<i>3</b>4</i>5</p>", "1**2*3****4*5"),
        ("<table><p>x</p><tr><td>y</table>", "x\n\n| y |\n| --- |"),
    ],
)
def test_markdown(html, wanted):
    assert markdown(html) == wanted


def test_tree_implied():
    doc = parse("<title>a &amp; b</title><script>var t='</p>';</script>hello<p>x<div>y")
    assert doc.first("title").children[0].text == "a & b"
    assert [n.tag for n in doc.first("html").children] == ["head", "body"]
    assert doc.first("script").children[0].text == "var t='</p>';"
    assert [c.tag for c in doc.first("body").children] == [None, "p", "div"]


def test_extract_content():
    words = "word " * 60
    page = content.extract(f'<html lang=en><head><title> T </title><meta name="Description" content="d"></head><body><nav>n</nav><main><h1>H</h1><p>{words}</p><div class="newsletter">no</div></main></body>', URL)
    assert (page.title, page.description, page.lang, page.headings) == ("T", "d", "en", [(1, "H")])
    assert page.markdown == "# H\n\n" + words.strip()
    assert content.extract("<body class=has-sidebar><p>x", URL).markdown == ""
    assert content.extract("<p>a   b", URL).hash == content.extract("<p>a b ", URL).hash


def test_density_prefers_text():
    links = "".join(f'<a href="/{i}">some link text {i}</a>' for i in range(40))
    page = content.extract(f"<div>{links}</div><div id=x>{'plain words ' * 30}</div>", URL)
    assert page.markdown.startswith("plain words")


def test_links():
    doc = parse('<a href="/b/">1</a><a href="#x">2</a><a href="mailto:a@b">3</a><a href="HTTP://Other.com:80">4</a><a href="/b">5</a><a href="ftp://x">6</a>')
    assert content.links(doc, URL) == ["http://other.com/", "https://shop.example/b"]


def ld(text: str) -> str:
    return f'<script type="application/ld+json">{text}</script>'


def microdata(*props: str) -> str:
    return '<section itemscope itemtype="https://schema.org/Product">' + "".join(props) + "</section>"


def opengraph(**props: str) -> str:
    return "".join(f'<meta property="{k.replace("_", ":")}" content="{v}">' for k, v in props.items())


#: The platforms' class names, generators and vocabularies are fixed values of the web; names and numbers are made up.
PRODUCTS = {
    "structured data, absolute image": (
        ld('{"@context":"https://schema.org","@type":"Product","name":"Oak\\n desk","image":"https://cdn.example/desk.jpg","offers":{"@type":"Offer","price":480,"priceCurrency":"CHF","availability":"SoldOut"}}'),
        ("Oak desk", 480.0, "CHF", "out_of_stock", "json-ld", "https://cdn.example/desk.jpg"),
    ),
    "structured data in a list of types, inside a graph": (
        ld('{"@graph":[{"@type":"WebPage","name":"no"},{"@type":["Car","PRODUCT"],"name":"Kite","image":[],"offers":{"@type":"AggregateOffer","lowPrice":"6.125,5","highPrice":9000}}]}'),
        ("Kite", 6125.5, "", "unknown", "json-ld", ""),
    ),
    "an aggregate offer in a list has no price": (ld('[{"@type":"Product","name":"Rope","offers":[{"@type":"AggregateOffer","lowPrice":1}]}]'), ("Rope", None, "", "unknown", "json-ld", "")),
    "a broken script is passed over": (ld("{") + ld('{"@type":"Product","name":"Bell","offers":{"price":"17.5","priceCurrency":"SEK"}}'), ("Bell", 17.5, "SEK", "unknown", "json-ld", "")),
    "microdata with contents, links and texts": (
        microdata('<b itemprop="name">Clay pot</b>', '<img itemprop="image" src="/pots/3.webp">', '<p itemprop="offers" itemscope><meta itemprop="price" content="8.4"><i itemprop="priceCurrency">NOK</i><a itemprop="availability" href="OutOfStock">gone</a></p>'),
        ("Clay pot", 8.4, "NOK", "out_of_stock", "microdata", "https://shop.example/pots/3.webp"),
    ),
    "open graph": (
        opengraph(og_type="product", og_title="Wool hat", product_price_amount="21", product_price_currency="DKK", og_image="hat.gif"),
        ("Wool hat", 21.0, "DKK", "unknown", "opengraph", "https://shop.example/a/hat.gif"),
    ),
    "woocommerce": (
        '<body class="single-product woocommerce"><div class="product"><h1 class="product_title">Tea tin</h1><span class="woocommerce-Price-amount">£3,75</span><p class="out-of-stock">later</p>',
        ("Tea tin", 3.75, "GBP", "out_of_stock", "heuristic", ""),
    ),
    "shopify": (
        '<script src="//cdn.shopify.com/s/a.js"></script><h1 class="product__title"> Sun  dial </h1><div class="price-item">1.250 lei</div>',
        ("Sun dial", 1.25, "RON", "in_stock", "heuristic", ""),
    ),
    "prestashop": (
        '<meta name="generator" content="PrestaShop 8"><h1>Fern</h1><div class="current-price">€ 6,60</div><span class="unavailable">no</span>',
        ("Fern", 6.6, "EUR", "out_of_stock", "heuristic", ""),
    ),
    "opencart": (
        '<meta name="generator" content="OpenCart"><div id="content"><h1>Axe</h1><s class="price-old">$50</s><em class="price-new">$41.10</em><u class="stock">in stock</u><img src="axe.png"></div>',
        ("Axe", 41.1, "USD", "in_stock", "heuristic", "https://shop.example/a/axe.png"),
    ),
    "no product": ("<article><h1>On trade</h1><p>It was $1 then.</p></article>", None),
}


@pytest.mark.parametrize(("html", "wanted"), PRODUCTS.values(), ids=PRODUCTS)
def test_product(html, wanted):
    p = product.extract(html, URL)
    assert (p and (p.name, p.price, p.currency, p.availability, p.extraction_method, p.image)) == wanted


def test_listing():
    cards = "".join(f'<li class="product"><a href="/p{i}">n{i}</a><span class="price">{i},50</span></li>' for i in range(25))
    got = product.extract_list(f"<ul>{cards}</ul>", URL)
    assert [(p.url, p.name, p.price) for p in got[:2]] == [("https://shop.example/p0", "n0", 0.5), ("https://shop.example/p1", "n1", 1.5)]
    assert len(got) == 20
    named = product.extract_list(ld('[{"@type":"Product","name":"a","url":"/x"},{"@type":"Product"},{"@type":"Product","name":"b"}]'), URL)
    assert [(p.name, p.url) for p in named] == [("a", "https://shop.example/x"), ("b", URL)]


def test_model_replies():
    p = product.parse_reply('```json\n{"is_product": true, "name": "N", "price": null, "availability": "in_stock"}\n```', URL)
    assert (p.name, p.price, p.availability, p.extraction_method) == ("N", None, "in_stock", "llm")
    assert product.parse_reply('{"is_product": false, "name": "N"}', URL) is None
    assert product.parse_reply("no", URL) is None
    assert product.extract_with_model("<p>text", URL, None) is None
    assert product.extract_with_model("<p>text", URL, lambda t: '{"is_product": true, "name": "M"}').name == "M"


def test_registry():
    product.register("none", lambda doc, url: None)
    product.DETECTORS.pop()
    assert [n for n, _ in product.DETECTORS] == ["woocommerce", "shopify", "prestashop", "opencart"]


def test_deep_and_empty_pages():
    assert understand(None, None)["markdown"] == ""
    assert understand(URL, "<div>" * 3000 + "x")["markdown"] == "x"
    assert understand(URL, "<p>&nbsp;</p><")["product"] is None
