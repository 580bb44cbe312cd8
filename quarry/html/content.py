"""A page's readable content: metadata, main element, markdown, outline, links."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from quarry.functions.urls import normalize_py, resolve
from quarry.html.tree import Node, parse

# Elements that never hold content, and what a class or id of boilerplate contains.
BOILERPLATE_TAGS = frozenset(["script", "style", "noscript", "iframe", "svg", "nav", "footer", "aside", "form", "button", "select", "textarea", "input", "template", "object", "embed"])
BOILERPLATE_HINTS = (
    "cookie", "consent", "gdpr", "banner", "advert", "sidebar", "popup", "modal", "newsletter", "subscribe", "breadcrumb", "social-share",
    "share-buttons", "site-header", "site-footer", "skip-link", "back-to-top", "site-nav",
)
LEAST_BYTES = 140
BLOCKS = frozenset(["p", "div", "section", "article", "main", "header", "ul", "ol", "table", "blockquote", "pre", "hr", "figure", "h1", "h2", "h3", "h4", "h5", "h6"])
SILENT = frozenset(["script", "style", "noscript", "svg", "button", "form", "select", "textarea"])
DENSE = frozenset(["div", "section", "article", "main"])

_ASCII_SPACE = re.compile(r"[\t\n\f\r ]+")


def squeeze(s: str) -> str:
    """Runs of ASCII white space become one space; the ends lose all white space."""
    return _ASCII_SPACE.sub(" ", s).strip()


def text_of(n: Node) -> str:
    return squeeze(" ".join([x.text for x in n.walk() if x.tag is None] + [""]))


def raw_text(n: Node) -> str:
    return "".join(x.text for x in n.walk() if x.tag is None)


def meta(doc: Node, key: str, value: str) -> str:
    """Content of the first meta element whose attribute has the value, whatever the case."""
    for n in doc.walk():
        if n.tag == "meta" and n.get(key).lower() == value:
            return n.get("content").strip()
    return ""


def _size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def is_boilerplate(n: Node) -> bool:
    if n.tag in BOILERPLATE_TAGS:
        return True
    label = (n.get("class") + "\0" + n.get("id")).lower()
    return len(label) > 1 and any(h in label for h in BOILERPLATE_HINTS)


def strip_boilerplate(doc: Node) -> None:
    doc.release()
    todo = [doc]
    while todo:
        n = todo.pop()
        kept = []
        for c in n.children:
            if c.tag is not None and is_boilerplate(c):
                c.parent = None
            else:
                kept.append(c)
        n.children = kept
        todo.extend(c for c in kept if c.tag is not None)


def _densest(doc: Node) -> Node | None:
    """The container with the most bytes of text outside links, by one pass up the tree.

    Sizes are those of the space-joined, squeezed text, so each node carries its words' bytes and count.
    """
    best, best_score = None, 0.0
    sizes: dict[int, tuple[int, int]] = {}
    order = [n for n in doc.walk()]
    for n in reversed(order):
        if n.tag is None:
            words = squeeze(n.text)
            sizes[id(n)] = (_size(words), 0)
            continue
        total = link = 0
        for c in n.children:
            t, k = sizes[id(c)]
            total += t + (1 if t and total else 0)
            link += k
        sizes[id(n)] = (total, total + 1 if n.tag == "a" else link)
    for n in order:
        if n.tag in DENSE:
            total, link = sizes[id(n)]
            if total >= LEAST_BYTES:
                score = total * (1 - link / total)
                if score > best_score:
                    best, best_score = n, score
    return best


def select_content(doc: Node) -> Node:
    for tag in ("main", "article"):
        n = doc.first(tag)
        if n is not None and _size(text_of(n)) >= LEAST_BYTES:
            return n
    return _densest(doc) or doc.first("body") or doc


class Markdown:
    """Renders a content element; collects its outline on the way."""

    def __init__(self, base: str | None) -> None:
        self.base = base
        self.headings: list[tuple[int, str]] = []

    def render(self, n: Node) -> str:
        return re.sub("\n{3,}", "\n\n", self.blocks(n)).strip()

    def blocks(self, n: Node) -> str:
        return "".join(self.block(c) for c in n.children)

    def block(self, n: Node) -> str:
        tag = n.tag
        if tag is None:
            return self._paragraph(squeeze(n.text))
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            words = self.inline(n).strip()
            if words:
                self.headings.append((int(tag[1]), words))
                words = "#" * int(tag[1]) + " " + words
            return self._paragraph(words)
        if tag in ("ul", "ol"):
            return self.items(n, tag == "ol", 0) + "\n"
        if tag == "blockquote":
            inner = self.blocks(n).strip()
            return "".join(f"> {line}\n" for line in inner.split("\n")) + "\n" if inner else ""
        if tag == "pre":
            code = raw_text(n).strip("\n")
            return f"```\n{code}\n```\n\n" if code.strip() else ""
        if tag == "hr":
            return "---\n\n"
        if tag == "table":
            return self.table(n)
        if tag == "img":
            return self._paragraph(self.image(n))
        if tag in SILENT or tag == "input":
            return ""
        if tag != "p" and any(c.tag in BLOCKS for c in n.children):
            return self.blocks(n)
        return self._paragraph(self.inline(n).strip())

    @staticmethod
    def _paragraph(words: str) -> str:
        return words + "\n\n" if words else ""

    def items(self, n: Node, numbered: bool, depth: int) -> str:
        out = []
        for i, li in enumerate((c for c in n.children if c.tag == "li"), 1):
            inner = [c for c in li.children if c.tag in ("ul", "ol")]
            words = squeeze("".join(self.piece(c) for c in li.children if c.tag not in ("ul", "ol")))
            if words:
                out.append("  " * depth + (f"{i}. " if numbered else "- ") + words + "\n")
            out += [self.items(c, c.tag == "ol", depth + 1) for c in inner]
        return "".join(out)

    def table(self, n: Node) -> str:
        rows: list[list[str]] = []
        todo = [n]
        while todo:
            x = todo.pop()
            if x.tag == "tr":
                cells = [squeeze(self.inline(c)) for c in x.children if c.tag in ("td", "th")]
                if cells:
                    rows.append(cells)
            else:
                todo.extend(reversed(x.children))
        if not rows:
            return ""
        width = max(map(len, rows))
        lines = [[*r, *[""] * (width - len(r))] for r in rows]
        lines.insert(1, ["---"] * width)
        return "".join("| " + " | ".join(r) + " |\n" for r in lines) + "\n"

    def inline(self, n: Node) -> str:
        return "".join(self.piece(c) for c in n.children)

    def piece(self, n: Node) -> str:
        tag = n.tag
        if tag is None:
            return squeeze(n.text)
        if tag == "br":
            return "\n"
        if tag == "img":
            return self.image(n)
        if tag in SILENT:
            return ""
        inner = self.inline(n)
        if tag in ("strong", "b", "em", "i"):
            mark = "**" if tag in ("strong", "b") else "*"
            inner = inner.strip()
            return mark + inner + mark if inner else ""
        if tag == "code":
            return f"`{inner}`" if inner.strip() else ""
        if tag == "a":
            inner, href = inner.strip(), n.get("href")
            return f"[{inner}]({resolve(self.base, href)})" if inner and href and not href.startswith("javascript:") else inner
        return inner

    def image(self, n: Node) -> str:
        src = n.get("src") or n.get("data-src")
        return f"![{squeeze(n.get('alt'))}]({resolve(self.base, src)})" if src else ""


@dataclass
class Page:
    title: str = ""
    description: str = ""
    lang: str = ""
    markdown: str = ""
    hash: str = ""
    headings: list[tuple[int, str]] = field(default_factory=list)


def title_of(doc: Node) -> str:
    for n in (doc.first("title"), None, doc.first("h1")):
        words = text_of(n) if n is not None else ""
        if n is None:
            words = meta(doc, "property", "og:title")
        if words:
            return words
    return ""


def extract(page: str, url: str | None, doc: Node | None = None) -> Page:
    """Reads metadata, then prunes doc (parsed from page if not given) and renders its content element."""
    doc = parse(page) if doc is None else doc
    html = doc.first("html")
    out = Page(title_of(doc), meta(doc, "name", "description") or meta(doc, "property", "og:description"), html.get("lang").strip() if html else "")
    strip_boilerplate(doc)
    writer = Markdown(url)
    out.markdown = writer.render(select_content(doc))
    out.headings = writer.headings
    out.hash = hashlib.sha256(out.markdown.encode("utf-8", "surrogatepass")).hexdigest()
    return out


def links(doc: Node, base: str | None) -> list[str]:
    """Distinct normalised http(s) targets of the whole document's anchors, sorted."""
    found = set()
    for n in doc.walk():
        href = n.get("href").strip() if n.tag == "a" else ""
        if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")):
            continue
        target = resolve(base, href)
        try:
            target = normalize_py(target)
        except ValueError:
            continue
        if target.startswith(("http://", "https://")):
            found.add(target)
    return sorted(found)
