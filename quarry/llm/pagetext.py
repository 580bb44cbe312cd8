"""HTML extraction (operator 9): a host suffix array over every page, then an exact check by the page's own marks.

A page is read as a stream of blocks, and each block gets a kind from the containers around it:
* BAD: menus, page headers, footers, sidebars, dialogs, scripts and reader comments (by tag, role, class or id);
* MAIN: what the page marks as its article (article, main, role=main), also inside a form or a labelled wrapper;
* WEAK: what only a class name or a form speaks against (ASIDE inside an article, INNER for an article in it). Such containers
  may be wrappers: INNER counts as MAIN where there is no other. The rest are judged by their place, whatever their length:
  one that holds the headline is text, and so is the first one with a paragraph where what is around it has no text
  of its own but headings; one that the host repeats as a whole gives way to one that it does not. Else they are boilerplate;
* PLAIN: the rest.

The pages of a host are token streams. The suffixes that start at a token outside of articles are cut to `RUN` tokens (fewer
only from a block's start to the page's end) and named by a hash of host and tokens; sorted by name they are the host's suffix array as
far as a common prefix of RUN tokens can tell. A longer common prefix of two suffixes is a chain of those of RUN tokens, so
no more of the order is needed to cover repeated substrings exactly. Neighbours of one name are a repeated substring; one on `least_pages`
pages of the host with distinct token streams covers its tokens, wherever in a block it lies. Every page meets its covered suffixes.

What the array covers goes: a whole block, or RUN tokens of it and more; the rest of each block stays. The check that
follows sets right what the page itself marks: MAIN blocks are whole, whatever repeats elsewhere, since copied articles and quoted
passages are still articles (README has figures of what repetition alone would take from them); if there are any, and of BAD blocks always, what is
outside goes too where nothing repeats it.

Nulls: a null html is an empty page with an empty text; a null url is a host of its own. Repeated rows come
back each, and a page given many times counts as one; there are no ties to break. Pages of any length are read whole, in time
in proportion to their length. Columns of any other names do no harm. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tidy

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements whose content is no text of the page.
DROPPED = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "textarea", "button", "head", "title", "map", "datalist"}
#: Those of them that are no part of a line.
BREAKING = {"head", "title"}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6", "header"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "select", "object", "canvas"}
BOILERPLATE = {"nav", "footer", "aside", "menu", "dialog"}
PHRASE = {"a", "abbr", "b", "big", "cite", "code", "del", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u"}
#: Elements that may also hold a whole page.
WRAPPERS = {"form", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"}
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|newsletter|subscri\w+|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|"
    r"sidebar|widget|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|respond|footer|masthead|site-header|page-header|toolbar|login|signup|pagination|pager|skip-link)(?:$|[\s_-])",
    re.I,
)
NOTES = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?:$|[\s_-])", re.I)
RUN = 8
MAIN, PLAIN, BAD, WEAK, ASIDE, INNER = range(6)
IN_ARTICLE = (MAIN, ASIDE, INNER)


def _kind(name: str, attributes: str, inside: int) -> int | None:
    """What an opening container says about its content, or nothing (None)."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
    role = found.get("role", "").lower()
    label = f"{found.get('class', '')} {found.get('id', '')}".strip()
    notes = bool(label and NOTES.search(label))
    if notes or name in BOILERPLATE or (role in ROLES and role != "form") or (name == "header" and inside not in IN_ARTICLE) or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return BAD if not notes or name not in ("html", "body") else None
    if name in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return MAIN if inside in (PLAIN, MAIN) else INNER if inside in (WEAK, INNER) else ASIDE
    if name in WRAPPERS or role == "form" or (label and name not in ("html", "body") and HINTS.search(label)):
        return ASIDE if inside in IN_ARTICLE else WEAK
    return None


@dataclass
class _Box:
    """A container in doubt: what only a class name or a form speaks against."""

    around: int | None  # the box that holds it
    kind: int
    text: bool = False  # text of its own, other than headings
    headline: bool = False  # an h1, also in a box within
    paragraph: bool = False  # a p, also in a box within


def _settle(found: list[tuple[int, str, int | None]], boxes: list[_Box], text: set[int], repeated: set[int] | None = None) -> list[tuple[int, str]]:
    """Boxes are judged by their place. One that holds the headline is text; so is the first one with a paragraph where
    what is around it (the article, the page or a box that is text) has no text of its own but headings and its header.
    Boxes that the host repeats come after the others of their place."""
    article = MAIN in text or INNER in text or any(b.kind == ASIDE and (b.headline or b.paragraph) for b in boxes)
    kept: set[int | None] = {None}
    filled: set[tuple[int | None, int]] = set()
    fresh = {(b.around, b.kind) for i, b in enumerate(boxes) if b.paragraph and i not in repeated} if repeated else set()
    for i, b in enumerate(boxes):  # outer ones come first
        root = article and (MAIN in text or INNER in text) if b.kind == ASIDE else PLAIN in text
        own = root if b.around is None else boxes[b.around].text
        if b.around not in kept or b.kind == WEAK and article:
            continue
        late = repeated and i in repeated and (b.around, b.kind) in fresh
        if b.headline or b.paragraph and not own and not late and (b.around, b.kind) not in filled:
            kept.add(i)
            filled.add((b.around, b.kind))
    told = {INNER: BAD if MAIN in {k for k, _, _ in found} else MAIN, ASIDE: MAIN, WEAK: PLAIN}
    return [(BAD if box not in kept else told.get(kind, kind), t) for kind, t, box in found]


def parse(page: str) -> tuple[list[tuple[int, str, int | None]], list[_Box], set[int]]:
    """(kind, text, box) of the page's blocks in order, its boxes, and the kinds that have text outside of them; texts are
    decoded, white space folded, never empty."""
    out: list[tuple[int, str, int | None]] = []
    boxes: list[_Box] = []
    parts: list[str] = []
    text_of: set[int] = set()  # kinds with text outside of boxes, other than headings
    stack: list[tuple[str, int, int | None, list[str] | None]] = []  # name, kind and box around it, and the block that it interrupts
    kind, box, pos, n = PLAIN, None, 0, len(page)
    heads = 0  # open headings and headers

    def close() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((kind, text, box))
                if not heads and box is not None:
                    boxes[box].text = True
                elif not heads:
                    text_of.add(kind)

    def holds(what: str) -> None:
        at = box
        while at is not None:
            setattr(boxes[at], what, True)
            at = boxes[at].around

    while pos < n:
        m = TAG.search(page, pos)
        if m is None:
            parts.append(page[pos:])
            break
        if m.start() > pos:
            parts.append(page[pos : m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, ends = name.lower(), bool(m[1] or m[4])
        inline = name in DROPPED and name not in BREAKING
        if name in BLOCK or name in BREAKING:
            close()
        elif name == "br":
            parts.append(" ")
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for was, around, outer, held in reversed(stack[k:]):
                        if held is not None:
                            close()
                            parts, kind, box = held, around, outer
                        heads -= was in HEADS
                    if name in BLOCK:
                        close()
                    kind, box = stack[k][1:3]
                    del stack[k:]
                    break
            continue
        if name in VOID:
            continue
        if name == "body":  # also ends a head that was never closed
            stack, kind, box, heads = [], PLAIN, None, 0
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
            pos = stop.end() if stop else n
            continue
        if inline:  # the block goes on after it
            stack.append((name, kind, box, parts))
            parts, kind = [], BAD
            continue
        if name not in BLOCK and name not in DROPPED:
            if kind != BAD and (m[3] or m[6]):
                told = _kind(name, m[3] or m[6], kind)
                if told in (BAD, WEAK, ASIDE):
                    if name in PHRASE:
                        stack.append((name, kind, box, parts))
                        parts, kind = [], BAD
                    else:
                        close()
                        stack.append((name, kind, box, None))
                        kind = told
                        if told != BAD:
                            boxes.append(_Box(box, told))
                            box = len(boxes) - 1
                    continue
            stack.append((name, kind, box, None))
            continue
        stack.append((name, kind, box, None))
        heads += name in HEADS
        if kind != BAD:
            told = BAD if name in DROPPED else _kind(name, m[3] or m[6] or "", kind)
            if told is not None:
                kind = told
            if told == INNER:  # an article is judged by itself
                box = None
            if told in (WEAK, ASIDE) and not (name in WRAPPERS and box is not None):
                boxes.append(_Box(box, told))
                box = len(boxes) - 1
            if kind != BAD and box is not None and name in ("h1", "p"):
                holds("headline" if name == "h1" else "paragraph")
    close()
    for _, around, outer, held in reversed(stack):
        if held is not None:
            parts, kind, box = held, around, outer
            close()
    return out, boxes, text_of


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def suffix_keys(url: str | None, texts: list[str], wanted: list[bool]) -> list[int | None]:
    """For each token of the page, the host's name of the RUN tokens from it; at the stream's end fewer, and only from a block's start. Tokens of wanted blocks only."""
    host = host_of(url)
    stream: list[str] = []
    starts, places = set(), []
    for text, asked in zip(texts, wanted, strict=True):
        tokens = text.split()
        if asked:
            starts.add(len(stream))
            places.append(range(len(stream), len(stream) + len(tokens)))
        stream += tokens
    full = len(stream) - RUN
    keys: list[int | None] = [None] * len(stream)
    for block in places:
        for a in block:
            if a <= full or a in starts:
                keys[a] = xxhash.xxh64_intdigest(f"{host}\n{' '.join(stream[a : a + RUN])}") - 2**63
    return keys


def unique_runs(texts: list[str], keys: list[int | None], repeated: set[int]) -> list[str]:
    """What of each block no repeated suffix covers; ends of under RUN tokens that a neighbour's suffix reaches into stay."""
    covered = np.zeros(len(keys), dtype=bool)
    for k, key in enumerate(keys):
        if key in repeated:
            covered[k : k + RUN] = True
    out, at = [], 0
    for text in texts:
        tokens = text.split()
        own = covered[at : at + len(tokens)].copy()
        if own.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]))).reshape(-1, 2)
            for a, b in edges.tolist():
                if b - a < min(RUN, len(tokens)):
                    own[a:b] = False
            text = " ".join(t for t, gone in zip(tokens, own.tolist(), strict=True) if not gone)
        out.append(text)
        at += len(tokens)
    return out


def page_keys(url: str | None, page: str) -> tuple[list[tuple[int, str, int | None]], list[_Box], set[int], list[int | None]]:
    """The parsed page, and the names of its suffixes. An article's tokens say nothing about boilerplate, and have none; those of boxes in doubt do."""
    found, boxes, text = parse(page)
    settled = _settle(found, boxes, text)
    return found, boxes, text, suffix_keys(url, [t for _, t in settled], [k != MAIN or box is not None for (k, _), (_, _, box) in zip(settled, found, strict=True)])


def main_text(url: str | None, page: str, repeated: set[int]) -> str:
    """What the suffix array leaves of a page, set right by the page's own marks."""
    if repeated:
        found, boxes, text, keys = page_keys(url, page)
        left = unique_runs([t for _, t, _ in found], keys, repeated)
    else:
        found, boxes, text = parse(page)
        left = [t for _, t, _ in found]
    told, kept = set(), set()  # boxes with text, their own or of boxes within, and those of which something is left
    for (_, _, box), rest in zip(found, left, strict=True):
        while box is not None:
            told.add(box)
            if rest:
                kept.add(box)
            box = boxes[box].around
    settled = _settle(found, boxes, text, told - kept)
    if any(k == MAIN for k, _ in settled):
        return "\n".join(t for k, t in settled if k == MAIN)
    return "\n".join(rest for (k, _), rest in zip(settled, left, strict=True) if k == PLAIN and rest)


def _rows(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select("page_id", "url", html.alias("html")).withColumn("row", F.xxhash64("page_id", "url", "html"))


def suffixes(rows: DataFrame) -> DataFrame:
    """(key, content, row) of each different suffix of each page; content is the same for pages with equal token streams."""

    def batch(columns: tuple[list[int], list[int], list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "content", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [], [], []
            for row, url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found, _, _, named = page_keys(url, page.as_py())
                own = {k for k in named if k is not None}
                content = xxhash.xxh64_intdigest("\n".join(t for _, t, _ in found)) - 2**63
                for column, values in zip(out, (own, [content] * len(own), [row] * len(own)), strict=True):
                    column.extend(values)
                if len(out[0]) > 200_000:
                    yield batch(out)
                    out = [], [], []
            yield batch(out)

    return rows.select("row", "url", "html").mapInArrow(tidy(run), "key long, content long, row long")


def repeated_suffixes(found: DataFrame, least_pages: int) -> DataFrame:
    """(row, key) of the suffixes that stand on least_pages distinct contents: neighbours in the sorted array.

    A task reads its sorted part once; it holds the rows of one suffix only as long as that is not on enough pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pages, held = None, 0, []  # the last suffix and content, on how many contents that suffix is, its rows if on too few
        for b in batches:
            if not b.num_rows:
                continue
            key, content, row = (c.to_numpy() for c in b.columns)
            other = key[1:] != key[:-1]
            starts = np.flatnonzero(np.concatenate([[True], other]))
            fresh = np.concatenate([[last != (key[0], content[0])], other | (content[1:] != content[:-1])])
            counts = np.add.reduceat(fresh.astype(np.int64), starts)
            if last is not None and last[0] == key[0]:
                counts[0] += pages
            else:
                held = []
            enough = counts >= least_pages
            taken = np.repeat(enough, np.diff(np.append(starts, len(key))))
            before = np.concatenate(held) if held and enough[0] else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([before, row[taken]])), pa.array(np.concatenate([np.full(len(before), key[0]), key[taken]]))], ["row", "key"])
            if len(starts) > 1 or enough[0]:
                held = []
            if not enough[-1]:
                held.append(row[starts[-1] :].copy())
            last, pages = (key[-1], content[-1]), int(counts[-1])

    return found.repartition("key").sortWithinPartitions("key", "content").mapInArrow(tidy(run), "row long, key long")


def extract(pages: DataFrame, least_pages: int = 3) -> DataFrame:
    """page_id, url, text of each row of pages."""
    rows = _rows(pages)
    ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(url, page.as_py(), set(hit or [])) for url, page, hit in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    hits = repeated_suffixes(suffixes(rows), least_pages).groupBy("row").agg(F.collect_set("key").alias("hit"))  # once each, however often a row is repeated
    # a page's hits are as long as what it has outside of articles: joined by size as Spark knows it, never broadcast by their number
    return rows.join(hits.hint("shuffle_hash"), "row", "left").select("page_id", "url", "html", "hit").mapInArrow(tidy(sift), f"{ids}, text string")
