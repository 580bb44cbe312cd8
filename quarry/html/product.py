"""Product records from a page: structured data first, then shop platforms, one record or a listing."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from quarry.functions.text import IN_STOCK, OUT_OF_STOCK
from quarry.functions.urls import resolve
from quarry.html.content import meta, squeeze, text_of
from quarry.html.tree import Node, parse

MOST_LISTED = 20
LLM_INPUT = 6000

# The classes that shops use.
CARD_CLASSES = ("product", "product-item", "product-card", "grid__item", "product-miniature", "product-thumb", "product-layout")
CARD_TITLES = ("woocommerce-loop-product__title", "product-item-meta__title", "product-title", "card__heading")
CARD_PRICES = ("woocommerce-Price-amount", "price-item", "price", "product-price")


@dataclass
class Product:
    url: str
    name: str
    extraction_method: str
    description: str = ""
    price: float | None = None
    currency: str = ""
    availability: str = "unknown"
    image: str = ""
    raw_json: str = field(default="", compare=False)


# --- values -------------------------------------------------------------------------------------------------


def parse_price(text: str) -> float | None:
    kept = "".join(c for c in text if c.isdecimal() or c in ".,-")
    comma, dot = kept.rfind(","), kept.rfind(".")
    if comma > dot:
        kept = kept.replace(".", "").replace(",", ".", 1)
    kept = kept.replace(",", "") if comma <= dot else kept
    if not re.fullmatch(r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", kept):
        return None
    return float(kept)


def price_of(value: object) -> float | None:
    """A JSON number as it is, a text by its digits, anything else (booleans too) nothing."""
    if isinstance(value, str):
        return parse_price(value)
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def currency_of(text: str) -> str:
    for mark, code in (("$", "USD"), ("€", "EUR"), ("£", "GBP")):
        if mark in text:
            return code
    return "RON" if "lei" in text.lower() or "RON" in text else ""


def availability_of(value: object) -> str:
    s = value.lower().strip().replace("_", "").replace("-", "") if isinstance(value, str) else ""
    if s == "oos" or any(w in s for w in OUT_OF_STOCK):
        return "out_of_stock"
    return "in_stock" if any(w in s for w in IN_STOCK) else "unknown"


# --- looking things up in a tree ----------------------------------------------------------------------------


def has_class(n: Node, name: str) -> bool:
    own = n.attrs.get("class")
    return own is not None and name.lower() in own.lower().split()


def by_class(scope: Node, *names: str) -> Node | None:
    """The first element of the first class that occurs at all."""
    for name in names:
        for n in scope.walk():
            if n.attrs and n.tag and has_class(n, name):
                return n
    return None


def text_by_class(scope: Node, *names: str) -> str:
    n = by_class(scope, *names)
    return text_of(n) if n is not None else ""


def text_by_tag(scope: Node, *tags: str) -> str:
    for tag in tags:
        n = scope.first(tag)
        if n is not None:
            return text_of(n)
    return ""


def image_by_class(scope: Node, *names: str) -> str:
    n = by_class(scope, *names)
    img = n if n is None or n.tag == "img" else n.first("img")
    return img.get("src") if img is not None else ""


# --- structured data ----------------------------------------------------------------------------------------


def _no_constant(name: str) -> float:
    raise ValueError(f"{name} is no JSON")


def json_blocks(doc: Node) -> Iterator[tuple[str, object]]:
    """(source, value) of each well-formed JSON-LD script."""
    for n in doc.walk():
        if n.tag == "script" and n.get("type").strip().lower() == "application/ld+json":
            source = "".join(c.text for c in n.children)
            try:
                yield source, json.loads(source, parse_constant=_no_constant)
            except (ValueError, RecursionError):
                continue


def typed(value: dict, kind: str) -> bool:
    t = value.get("@type")
    return any(isinstance(x, str) and x.lower() == kind.lower() for x in (t if isinstance(t, list) else [t]))


def json_products(value: object) -> Iterator[dict]:
    """Objects of type Product at any depth, parents first, members by key."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if typed(v, "Product"):
                yield v
            todo += [v[k] for k in sorted(v, reverse=True)]
        elif isinstance(v, list):
            todo += reversed(v)


def _image(v: object) -> str:
    if isinstance(v, list):
        return next((s for s in map(_image, v) if s), "")
    if isinstance(v, dict):
        v = v.get("url")
    return v if isinstance(v, str) else ""


def _offer(v: object) -> dict | None:
    """A list gives its first object as it stands; an aggregate's low price is its price."""
    if isinstance(v, list):
        return next((x for x in v if isinstance(x, dict)), None)
    if not isinstance(v, dict):
        return None
    return {**v, "price": v["lowPrice"]} if typed(v, "AggregateOffer") and "lowPrice" in v else v


def from_json(v: dict, url: str) -> Product:
    words = lambda k: squeeze(v[k]) if isinstance(v.get(k), str) else ""
    link, ident = v.get("url"), v.get("@id")
    if isinstance(link, str) and link:
        target = resolve(url, link)
    else:
        target = ident if isinstance(ident, str) and ident.startswith(("http://", "https://")) else url
    p = Product(target, words("name"), "json-ld", words("description"), image=resolve(url, _image(v.get("image"))))
    offer = _offer(v.get("offers"))
    if offer is not None:
        p.price = price_of(offer.get("price"))
        p.currency = offer["priceCurrency"] if isinstance(offer.get("priceCurrency"), str) else ""
        p.availability = availability_of(offer.get("availability"))
    if p.price is None:
        p.price = price_of(v.get("price"))
    return p


def json_ld(doc: Node, url: str) -> Product | None:
    """Of each script only the first product counts; the first with a name wins."""
    for source, value in json_blocks(doc):
        first = next(json_products(value), None)
        if first is not None and (p := from_json(first, url)).name:
            p.raw_json = source
            return p
    return None


def scope_props(scope: Node) -> dict[str, list[Node]]:
    """Elements by itemprop, without looking into nested items."""
    out: dict[str, list[Node]] = {}
    todo = list(reversed(scope.children))
    while todo:
        n = todo.pop()
        if n.tag is None:
            continue
        if n.get("itemprop"):
            out.setdefault(n.get("itemprop"), []).append(n)
        if "itemscope" not in n.attrs:
            todo += reversed(n.children)
    return out


#: Where an element of each kind keeps its property.
PROPERTY_AT = {"meta": "content", "link": "href", "a": "href", "img": "src", "source": "src", "time": "datetime"}


def prop(props: dict[str, list[Node]], name: str) -> str:
    if name not in props:
        return ""
    n = props[name][0]
    if n.tag == "meta":
        return n.get("content")
    return n.get(PROPERTY_AT.get(n.tag, "content")) or n.get("content") or text_of(n)


def microdata(doc: Node, url: str) -> Product | None:
    root = next((n for n in doc.walk() if n.tag and "itemscope" in n.attrs and "schema.org/product" in n.get("itemtype").lower()), None)
    if root is None:
        return None
    props = scope_props(root)
    offers = props.get("offers", [])
    deal = scope_props(offers[0]) if offers and "itemscope" in offers[0].attrs else props
    p = Product(url, squeeze(prop(props, "name")), "microdata", squeeze(prop(props, "description")), parse_price(prop(deal, "price")), prop(deal, "priceCurrency"), availability_of(prop(deal, "availability")))
    p.image = resolve(url, prop(props, "image"))
    return p if p.name else None


def open_graph(doc: Node, url: str) -> Product | None:
    og = lambda *keys: next((v for v in (meta(doc, "property", k) for k in keys) if v), "")
    if og("og:type").lower() not in ("product", "product.item"):
        return None
    p = Product(url, squeeze(og("og:title", "product:title")), "opengraph", squeeze(og("og:description")), parse_price(og("product:price:amount", "og:price:amount")))
    p.currency, p.availability = og("product:price:currency", "og:price:currency"), availability_of(og("product:availability"))
    p.image = resolve(url, og("og:image"))
    return p if p.name else None


# --- shop platforms -----------------------------------------------------------------------------------------


def made_by(doc: Node, platform: str) -> bool:
    return platform in meta(doc, "name", "generator").lower()


def is_woocommerce(doc: Node) -> bool:
    return by_class(doc, "woocommerce") is not None


def is_shopify(doc: Node) -> bool:
    return any(n.tag in ("script", "link") and any(h in n.get("src") + n.get("href") for h in ("cdn.shopify.com", "shopifycdn.com")) for n in doc.walk())


def _shop(url: str, name: str, price_text: str, availability: str, image: str) -> Product | None:
    if not name:
        return None
    return Product(url, squeeze(name), "heuristic", "", parse_price(price_text), currency_of(price_text), availability, resolve(url, image))


def _either(scope: Node, yes: tuple[str, ...], no: tuple[str, ...]) -> str:
    return "in_stock" if by_class(scope, *yes) is not None else "out_of_stock" if by_class(scope, *no) is not None else "unknown"


def woocommerce(doc: Node, url: str) -> Product | None:
    if not is_woocommerce(doc):
        return None
    root = by_class(doc, "product") or doc
    return _shop(url, text_by_class(root, "product_title", "entry-title"), text_by_class(root, "woocommerce-Price-amount"), _either(root, ("in-stock",), ("out-of-stock",)), image_by_class(root, "wp-post-image", "woocommerce-product-gallery__image"))


def shopify(doc: Node, url: str) -> Product | None:
    if not is_shopify(doc):
        return None
    price = text_by_class(doc, "price-item--regular", "product__price", "price__regular", "price-item")
    stock = "out_of_stock" if by_class(doc, "badge--sold-out", "product__price--sold-out") is not None else "in_stock" if parse_price(price) is not None else "unknown"
    return _shop(url, text_by_class(doc, "product__title", "product-single__title", "product-meta__title"), price, stock, image_by_class(doc, "product__media", "product-single__photo", "product__image"))


def prestashop(doc: Node, url: str) -> Product | None:
    if not made_by(doc, "prestashop"):
        return None
    name = text_by_class(doc, "product-title") or text_by_tag(doc, "h1")
    stock = _either(doc, ("product-available", "available"), ("product-unavailable", "unavailable"))
    return _shop(url, name, text_by_class(doc, "current-price", "product-price"), stock, image_by_class(doc, "product-cover", "js-qv-product-cover"))


def opencart(doc: Node, url: str) -> Product | None:
    if not made_by(doc, "opencart"):
        return None
    scope = next((n for n in doc.walk() if n.get("id") == "content"), doc)
    says = text_by_class(scope, "stock").lower()
    stock = "in_stock" if "in stock" in says else "out_of_stock" if "out of stock" in says or "unavailable" in says else "unknown"
    first = scope.first("img")
    image = image_by_class(scope, "img-thumbnail") or (first.get("src") if first is not None else "")
    return _shop(url, text_by_tag(scope, "h1"), text_by_class(scope, "price-new", "price"), stock, image)


Detector = Callable[[Node, str], "Product | None"]
#: The registry: tried in order, the first that finds a product wins. Add to it to support another platform.
DETECTORS: list[tuple[str, Detector]] = [("woocommerce", woocommerce), ("shopify", shopify), ("prestashop", prestashop), ("opencart", opencart)]
STRUCTURED: list[Detector] = [json_ld, microdata, open_graph]


def register(name: str, detector: Detector) -> None:
    DETECTORS.append((name, detector))


def platform_of(doc: Node) -> str:
    if is_woocommerce(doc):
        return "woocommerce"
    if is_shopify(doc):
        return "shopify"
    return next((p for p in ("prestashop", "opencart") if made_by(doc, p)), "")


def extract(doc: Node | str, url: str) -> Product | None:
    doc = parse(doc) if isinstance(doc, str) else doc
    for tier in (*STRUCTURED, *(d for _, d in DETECTORS)):
        p = tier(doc, url)
        if p is not None:
            if not p.raw_json:
                p.raw_json = json.dumps({k: v for k, v in vars(p).items() if k != "raw_json"}, ensure_ascii=False)
            return p
    return None


# --- listings -----------------------------------------------------------------------------------------------


def _cards(doc: Node) -> Iterator[Node]:
    """Cards class by class, outermost first; an element counts once."""
    seen: set[int] = set()
    met = {c for n in doc.walk() if n.attrs for c in n.get("class").lower().split()}
    for name in filter(met.__contains__, CARD_CLASSES):
        todo = [doc]
        while todo:
            n = todo.pop()
            if n.tag and has_class(n, name):
                if id(n) not in seen:
                    seen.add(id(n))
                    yield n
            else:
                todo += reversed(n.children)


def from_card(card: Node, url: str) -> Product | None:
    link = card.first("a")
    if link is None or not link.get("href"):
        return None
    name = text_by_class(card, *CARD_TITLES) or text_by_tag(card, "h2", "h3") or text_of(link)
    price = text_by_class(card, *CARD_PRICES)
    img = card.first("img")
    p = _shop(resolve(url, link.get("href")), name, price, "unknown", "")
    if p is not None and img is not None:
        p.image = resolve(url, img.get("src") or img.get("data-src"))
    return p


def extract_list(doc: Node | str, url: str) -> list[Product]:
    """Up to 20 products of a listing: all named ones of the structured data, or else the page's cards."""
    doc = parse(doc) if isinstance(doc, str) else doc
    out: list[Product] = []
    for source, value in json_blocks(doc):
        for v in json_products(value):
            if (p := from_json(v, url)).name:
                p.raw_json = source
                out.append(p)
    if not out:
        for card in _cards(doc):
            if len(out) < MOST_LISTED and (p := from_card(card, url)) is not None:
                out.append(p)
    return out[:MOST_LISTED]


# --- last resort --------------------------------------------------------------------------------------------


def without_fence(reply: str) -> str:
    reply = reply.strip().removeprefix("```json").removeprefix("```")
    return reply.removesuffix("```").strip()


def parse_reply(reply: str, url: str) -> Product | None:
    """A language model's answer: one JSON object, perhaps in a code fence; nothing unless it names a product."""
    try:
        v = json.loads(without_fence(reply), parse_constant=_no_constant)
    except ValueError:
        return None
    texts = ("name", "description", "currency", "availability", "image")
    if not isinstance(v, dict) or v.get("is_product") is not True or not all(isinstance(v.get(k, ""), str) for k in texts) or not v.get("name"):
        return None
    price = v.get("price")
    if price is not None and (isinstance(price, bool) or not isinstance(price, (int, float))):
        return None
    return Product(url, squeeze(v["name"]), "llm", squeeze(v.get("description", "")), None if price is None else float(price), v.get("currency", ""), availability_of(v.get("availability", "")), resolve(url, v.get("image", "")))


def extract_with_model(page: str, url: str, ask: Callable[[str], str] | None) -> Product | None:
    """extract(), then ask (a callable from text to a reply; off if None) about pages that no tier understands."""
    doc = parse(page)
    found = extract(doc, url)
    if found is not None or ask is None:
        return found
    title = doc.first("title")
    body = text_of(doc)[:LLM_INPUT]
    if not body:
        return None
    try:
        reply = ask(f"{text_of(title) if title is not None else ''}\n\n{body}".strip())
    except Exception:  # whatever the callable's transport raises: the page is then no product
        return None
    return parse_reply(reply, url)


# --- a site's own search ------------------------------------------------------------------------------------


def search_form(doc: Node) -> tuple[str, str] | None:
    """(action, parameter) of the page's GET search form."""
    forms = [n for n in doc.walk() if n.tag == "form"]
    form = next((n for n in forms if n.get("role").lower() == "search"), None) or next((n for n in forms if has_class(n, "search-form")), None)
    if form is None or form.get("method").lower() not in ("", "get"):
        return None
    name = next((n.get("name") for n in form.walk() if n.tag == "input" and n.get("name") and n.get("type").lower() in ("search", "text", "")), None)
    return (form.get("action"), name) if name else None
