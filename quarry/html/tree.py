"""A tree builder for the part of the HTML parsing rules that real pages exercise.

Implied html, head and body; void elements; raw text; paragraphs, list items, headings, options and table
parts that end implicitly; reopened formatting elements (three equal ones at most) and the adoption agency;
content misplaced in tables moved before them. Scripting is taken as off for noscript in the body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p pre search section summary table ul dd dt".split()
) | HEADINGS
SPECIAL = CLOSES_P | VOID | frozenset(
    "applet body button caption colgroup frame frameset head html iframe marquee noembed noframes noscript object plaintext script select style tbody td template textarea tfoot th thead title tr xmp".split()
) - frozenset(["search"])
SCOPE = frozenset("applet caption html table td th marquee object template".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
IN_TABLE = frozenset("table tbody tfoot thead tr".split())

_MARKUP = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:\s|/|[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*?)(/?)>|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*|=[^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class Node:
    """An element (tag set) or a text (tag None)."""

    __slots__ = ("attrs", "children", "order", "parent", "tag", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = "") -> None:
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.order: list[Node] | None = None

    def append(self, child: Node) -> None:
        child.detach()
        child.parent = self
        self.children.append(child)

    def insert_before(self, child: Node, anchor: Node) -> None:
        child.detach()
        child.parent = self
        self.children.insert(self.children.index(anchor), child)

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order; no recursion, so depth does not matter."""
        return self._walk() if self.order is None else iter(self.order)

    def _walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            if n.children:
                todo.extend(reversed(n.children))

    def hold(self) -> None:
        """Keeps the order for the walks that follow; release() it before the tree changes."""
        self.order = list(self._walk())

    def release(self) -> None:
        self.order = None

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c) if a or b or c else "")
    return out


class _Builder:
    def __init__(self) -> None:
        self.root = Node("#document")
        self.html = self._element("html", {}, self.root)
        self.head: Node | None = None
        self.body: Node | None = None
        self.head_open = False
        self.stack: list[Node] = [self.html]
        self.active: list[Node | None] = []  # formatting elements, None for a marker

    @staticmethod
    def _element(tag: str, attrs: dict[str, str], parent: Node) -> Node:
        n = Node(tag, attrs)
        parent.append(n)
        return n

    # -- places ---------------------------------------------------------------------------------------------

    def _place(self, node: Node) -> None:
        """Insert at the current node, or before the table where the current node is a table part."""
        here = self.stack[-1]
        if here.tag in IN_TABLE and (node.tag is None or node.tag not in TABLE_PARTS | {"script", "style", "template"}):
            table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                parent, at = table.parent, table.parent.children.index(table)
                before = parent.children[at - 1] if at else None
                if node.tag is None and before is not None and before.tag is None:
                    before.text += node.text
                else:
                    parent.insert_before(node, table)
                return
        if node.tag is None and here.children and here.children[-1].tag is None:
            here.children[-1].text += node.text
        else:
            here.append(node)

    def _open(self, tag: str, attrs: dict[str, str]) -> Node:
        n = Node(tag, attrs)
        self._place(n)
        self.stack.append(n)
        return n

    def _in_scope(self, tags: frozenset[str] | set[str], extra: frozenset[str] = frozenset()) -> bool:
        for n in reversed(self.stack):
            if n.tag in tags:
                return True
            if n.tag in SCOPE or n.tag in extra:
                return False
        return False

    def _imply_ends(self, but: str = "") -> None:
        while self.stack[-1].tag in IMPLIED and self.stack[-1].tag != but:
            self.stack.pop()

    def _pop_to(self, tags: frozenset[str] | set[str]) -> None:
        while len(self.stack) > 1:
            if self.stack.pop().tag in tags:
                return

    def _close_p(self) -> None:
        if self._in_scope({"p"}, frozenset(["button"])):
            self._imply_ends("p")
            self._pop_to({"p"})

    # -- formatting elements --------------------------------------------------------------------------------

    def _remember(self, n: Node) -> None:
        same = [i for i in range(self._after_marker(), len(self.active)) if self.active[i].tag == n.tag and self.active[i].attrs == n.attrs]
        if len(same) >= 3:
            del self.active[same[0]]
        self.active.append(n)

    def _after_marker(self) -> int:
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i] is None:
                return i + 1
        return 0

    def _clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def _reopen(self) -> None:
        """Open again the formatting elements that an enclosing end closed."""
        opened = {id(n) for n in self.stack}
        i = len(self.active)
        while i > 0 and self.active[i - 1] is not None and id(self.active[i - 1]) not in opened:
            i -= 1
        for k in range(i, len(self.active)):
            self.active[k] = self._open(self.active[k].tag, dict(self.active[k].attrs))

    def _adopt(self, tag: str) -> None:
        """End of a formatting element, wherever it stands relative to open blocks."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            element = next((n for n in reversed(self.active[self._after_marker() :]) if n.tag == tag), None)
            if element is None:
                self._end_other(tag)
                return
            if element not in self.stack:
                self.active.remove(element)
                return
            at = self.stack.index(element)
            if any(n.tag in SCOPE for n in self.stack[at + 1 :]):
                return
            block = next((n for n in self.stack[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(element)
                return
            ancestor, mark = self.stack[at - 1], self.active.index(element)
            last, i = block, self.stack.index(block)
            for step in range(1, len(self.stack)):
                i -= 1
                node = self.stack[i]
                if node is element:
                    break
                if node not in self.active or step > 3:
                    if node in self.active:
                        k = self.active.index(node)
                        mark -= k < mark
                        del self.active[k]
                    del self.stack[i]
                    continue
                clone = Node(node.tag, dict(node.attrs))
                self.active[self.active.index(node)] = clone
                self.stack[i] = clone
                if last is block:
                    mark = self.active.index(clone) + 1
                clone.append(last)
                last = clone
            if ancestor.tag in IN_TABLE:
                self.stack, kept = self.stack[: self.stack.index(ancestor) + 1], self.stack
                last.detach()
                self._place(last)
                self.stack = kept
            else:
                ancestor.append(last)
            clone = Node(element.tag, dict(element.attrs))
            for c in list(block.children):
                clone.append(c)
            block.append(clone)
            k = self.active.index(element)
            del self.active[k]
            self.active.insert(mark - (k < mark), clone)
            self.stack.remove(element)
            self.stack.insert(self.stack.index(block) + 1, clone)

    # -- tokens ---------------------------------------------------------------------------------------------

    def _need_head(self) -> None:
        if self.head is None:
            self.head = self._element("head", {}, self.html)

    def _need_body(self) -> None:
        if self.body is None:
            self._need_head()
            self.head_open = False
            self.body = self._element("body", {}, self.html)
            self.stack = [self.html, self.body]

    def text(self, data: str) -> None:
        if self.body is None:
            if self.head_open and len(self.stack) > 2:
                self._place(Node(None, text=data))
                return
            if not data.strip(" \t\n\f\r"):
                return
            data = data.lstrip(" \t\n\f\r")
        self._need_body()
        if data.strip(" \t\n\f\r"):
            self._reopen()
        elif self.stack[-1].tag in IN_TABLE:
            self.stack[-1].append(Node(None, text=data))
            return
        self._place(Node(None, text=data))

    def raw(self, tag: str, attrs: dict[str, str], data: str) -> None:
        """An element whose content is text only."""
        if self.body is None and tag in HEAD_ONLY:
            self._need_head()
            n = self._element(tag, attrs, self.head)
        else:
            self._need_body()
            if tag == "textarea" or tag in ("iframe", "xmp"):
                self._reopen()
            n = Node(tag, attrs)
            self._place(n)
        if data:
            n.append(Node(None, text=data))

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "html":
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.head is None:
                self.head = self._element("head", attrs, self.html)
                self.head_open = True
                self.stack = [self.html, self.head]
            return
        if tag == "body":
            if self.body is None:
                self._need_body()
                self.body.attrs.update(attrs)
            else:
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
            return
        if self.body is None and tag in HEAD_ONLY:
            self._need_head()
            if tag in VOID:
                (self.stack[-1] if self.head_open and len(self.stack) > 2 else self.head).append(Node(tag, attrs))
            elif tag in ("noscript", "template"):
                self.head_open = True
                self.stack = [self.html, self.head]
                self._open(tag, attrs)
            return
        self._need_body()
        if tag in TABLE_PARTS:
            self._table_part(tag, attrs)
            return
        if tag in CLOSES_P:
            if tag == "form" and any(n.tag == "form" for n in self.stack):
                return
            if tag in ("li", "dd", "dt"):
                self._end_item({"li"} if tag == "li" else {"dd", "dt"})
            self._close_p()
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.stack.pop()
            n = self._open(tag, attrs)
            if tag == "hr":
                self.stack.remove(n)
            return
        if tag == "a" and any(n is not None and n.tag == "a" for n in self.active[self._after_marker() :]):
            old = next(n for n in reversed(self.active) if n is not None and n.tag == "a")
            self._adopt("a")
            if old in self.active:
                self.active.remove(old)
            if old in self.stack:
                self.stack.remove(old)
        if tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self.stack.pop()
        if tag == "button" and self._in_scope({"button"}):
            self._imply_ends()
            self._pop_to({"button"})
        if tag == "image":
            tag = "img"
        if tag not in ("param", "source", "track"):
            self._reopen()
        n = self._open(tag, attrs)
        if tag in VOID or closed and tag not in FORMATTING and "-" not in tag and tag in ("path", "circle", "rect", "line", "use", "polygon", "g"):
            self.stack.remove(n)
        elif tag in FORMATTING:
            self._remember(n)
        elif tag in ("applet", "marquee", "object"):
            self.active.append(None)

    def _end_item(self, tags: set[str]) -> None:
        for n in reversed(self.stack):
            if n.tag in tags:
                self._imply_ends(n.tag)
                self._pop_to(tags)
                return
            if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                return

    def _table_part(self, tag: str, attrs: dict[str, str]) -> None:
        if not any(n.tag == "table" for n in self.stack):
            return
        keep = {"caption": {"table"}, "colgroup": {"table"}, "col": {"colgroup", "table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "tr": {"tbody", "thead", "tfoot", "table"}}.get(tag, {"tr", "tbody", "thead", "tfoot", "table"})
        while self.stack[-1].tag not in keep and self.stack[-1].tag != "html":
            if self.stack.pop().tag in ("td", "th", "caption"):
                self._clear_to_marker()
        if tag == "tr" and self.stack[-1].tag == "table":
            self._open("tbody", {})
        if tag in ("td", "th"):
            if self.stack[-1].tag == "table":
                self._open("tbody", {})
            if self.stack[-1].tag != "tr":
                self._open("tr", {})
        n = self._open(tag, attrs)
        if tag == "col":
            self.stack.remove(n)
        elif tag in ("td", "th", "caption"):
            self.active.append(None)

    def end(self, tag: str) -> None:
        if tag == "head":
            if self.body is None:
                self._need_head()
                self.head_open, self.stack = False, [self.html]
            return
        if self.body is None:
            if self.head_open and any(n.tag == tag for n in self.stack[2:]):
                self._pop_to({tag})
                return
            if tag not in ("br", "p"):
                return
        self._need_body()
        if tag in ("body", "html"):
            return
        if tag == "br":
            self.start("br", {}, False)
        elif tag == "p":
            if not self._in_scope({"p"}, frozenset(["button"])):
                self._open("p", {})
            self._close_p()
        elif tag == "li":
            if self._in_scope({"li"}, frozenset(["ol", "ul"])):
                self._imply_ends("li")
                self._pop_to({"li"})
        elif tag in HEADINGS:
            if self._in_scope(HEADINGS):
                self._imply_ends()
                self._pop_to(HEADINGS)
        elif tag in FORMATTING:
            self._adopt(tag)
        elif tag == "table" or tag in TABLE_PARTS:
            if any(n.tag == tag for n in self.stack):
                while self.stack[-1].tag != "html":
                    done = self.stack.pop()
                    if done.tag in ("td", "th", "caption"):
                        self._clear_to_marker()
                    if done.tag == tag:
                        break
        elif tag in CLOSES_P or tag in ("button", "applet", "marquee", "object"):
            if self._in_scope({tag}):
                self._imply_ends(tag if tag in ("dd", "dt") else "")
                self._pop_to({tag})
                if tag in ("applet", "marquee", "object"):
                    self._clear_to_marker()
        else:
            self._end_other(tag)

    def _end_other(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if self.stack[i].tag in SPECIAL:
                return


def parse(page: str) -> Node:
    """The document's tree; html, head and body are always there."""
    b, pos, n = _Builder(), 0, len(page)
    drop_newline = False
    while pos < n:
        m = _MARKUP.search(page, pos)
        stop = m.start() if m else n
        if stop > pos:
            data = page[pos:stop]
            if drop_newline and data.startswith(("\n", "\r\n")):
                data = data[data.index("\n") + 1 :]
            if data:
                b.text(unescape(data.replace("\r\n", "\n").replace("\0", "")))
        drop_newline = False
        if m is None:
            break
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            b.end(tag)
        elif tag in RAW or tag in RCDATA:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            data = page[pos : end.start() if end else n]
            b.raw(tag, attributes(m[3]), unescape(data) if tag in RCDATA else data)
            pos = end.end() if end else n
        else:
            b.start(tag, attributes(m[3]) if m[3] else {}, bool(m[4]))
            drop_newline = tag in ("pre", "listing")
    b._need_body()
    return b.root
