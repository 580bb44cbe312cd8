"""URL functions as Column expressions, with Python twins for code that runs inside a UDF or on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from importlib import resources
from urllib.parse import quote, unquote, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query (RFC 3986, appendix B); the fragment falls away.
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def normalize(url: Column) -> Column:
    """Lower-case scheme and authority, no fragment, no default port, no empty path, no single trailing slash."""
    scheme = F.lower(_part(url, 1))
    host = F.lower(_part(url, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = _part(url, 3)
    path = F.when(path == "", "/").when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.concat(scheme, F.lit("://"), host, path, _part(url, 4))


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), ":[0-9]*$", ""))


def path_and_query(url: Column) -> Column:
    """What robots rules are matched against."""
    return F.concat(_part(url, 3), _part(url, 4))


@dataclass(frozen=True)
class Suffixes:
    """Public suffix rules: plain ones, *.x (any label before x) and !y (y is no suffix, its parent is)."""

    plain: frozenset[str]
    wild: frozenset[str]
    exceptions: frozenset[str]
    labels: int  # of the longest rule

    @staticmethod
    def of(lines: Iterable[str]) -> Suffixes:
        rules = {x for line in lines if (x := line.strip().lower()) and not x.startswith("//")}
        plain, wild, exceptions = {r for r in rules if r[0] not in "*!"}, {r[2:] for r in rules if r.startswith("*.")}, {r[1:] for r in rules if r.startswith("!")}
        return Suffixes(frozenset(plain), frozenset(wild), frozenset(exceptions), max((r.count(".") + 1 for r in rules), default=1))

    def trie(self) -> dict:
        """The rules by label from the last on; "" marks an end: its kind."""
        root: dict = {}
        for kind, rules in (("plain", self.plain), ("plain", {f"*.{x}" for x in self.wild}), ("exception", self.exceptions)):
            for rule in rules:
                node = root
                for label in reversed(rule.split(".")):
                    node = node.setdefault(label, {})
                node[""] = kind
        return root


@lru_cache
def suffixes() -> Suffixes:
    """The bundled public suffix rules; QUARRY_SUFFIXES names a longer list, in the public list's own form."""
    import os

    path = os.environ.get("QUARRY_SUFFIXES")
    return Suffixes.of((open(path, encoding="utf-8").read() if path else resources.files("quarry.functions").joinpath("suffixes.txt").read_text("utf-8")).splitlines())


@lru_cache
def _suffix_trie() -> dict:
    return suffixes().trie()


def registrable_domain(url_or_host: Column) -> Column:
    """The public suffix and one label more; IP addresses, single labels and suffixes stay as they are.

    The longest rule counts, an exception before all others; without a rule the last label is the suffix. A few look-ups of
    the host's last labels in hashed sets, inside generated code.
    """
    rules = suffixes()
    h = F.when(url_or_host.contains("://"), host(url_or_host)).otherwise(F.lower(F.regexp_replace(url_or_host, ":[0-9]*$", "")))
    h = F.regexp_replace(h, r"\.+$", "")
    last = lambda k: F.substring_index(h, ".", -k)  # noqa: E731  # the whole host if it is shorter
    dots = F.length(h) - F.length(F.replace(h, F.lit(".")))
    among = lambda c, values: c.isin(sorted(values)) if values else F.lit(False)
    size = F.lit(1)  # labels of the suffix; the longest rule is looked at last
    for k in range(1, rules.labels + 1):
        hit = among(last(k), rules.plain) | (among(last(k - 1), rules.wild) if k > 1 else F.lit(False))
        size = F.when(hit & (dots >= k - 1), F.lit(k)).otherwise(size)
    for k in range(2, rules.labels + 1):
        size = F.when(among(last(k), rules.exceptions) & (dots >= k - 1), F.lit(k - 1)).otherwise(size)
    out = F.call_function("substring_index", h, F.lit("."), -(size + 1))
    return F.when(h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), h).otherwise(out)


def slug(url: Column) -> Column:
    """Relative file path of a page's markdown; the query does not count."""
    path = F.regexp_replace(_part(url, 3), "/+", "/")
    # dot segments, without a loop: fold over the segments with a stack
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))

    def clean(s: Column) -> Column:
        raw = F.replace(s, F.lit("+"), F.lit("%2B"))  # a plus sign is no space in a path
        decoded = F.coalesce(F.try_url_decode(raw), s)
        out = F.regexp_replace(F.regexp_replace(decoded, r"[^\p{L}\p{Nd}\-_.]", "-"), "^-+|-+$", "")
        return F.when(out == "", "page").otherwise(out)

    return F.when(F.size(kept) == 0, "index.md").otherwise(F.concat(F.array_join(F.transform(kept, clean), "/"), F.lit(".md")))


# --- Python twins -----------------------------------------------------------------------------------------


def normalize_py(url: str) -> str:
    p = urlsplit(url)
    scheme, netloc = p.scheme.lower(), p.netloc.lower()
    if (scheme, netloc[-3:]) == ("http", ":80"):
        netloc = netloc[:-3]
    if (scheme, netloc[-4:]) == ("https", ":443"):
        netloc = netloc[:-4]
    path = p.path or "/"
    if len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    return urlunsplit((scheme, netloc, path, p.query, ""))


def escape(url: str) -> str:
    """Percent-encode what a URL's text form may not hold, keeping what is encoded already."""
    p = urlsplit(url)
    path = quote(p.path, safe="/%:@!$&'()*+,;=~-._[]")
    return urlunsplit((p.scheme, p.netloc, path, p.query, quote(p.fragment, safe="/%:@!$&'()*+,;=~-._?")))


def resolve(base: str | None, ref: str) -> str:
    """ref against base, in text form; ref itself where either is no URL."""
    ref = ref.strip()
    if not base or not ref:
        return ref
    try:
        return escape(urljoin(base, ref))
    except ValueError:
        return ref


def with_query(base: str, path: str, values: dict[str, str]) -> str:
    p = urlsplit(base)
    return urlunsplit((p.scheme, p.netloc, path, urlencode(sorted(values.items())), ""))


def seed_url(text: str) -> str:
    """A crawl's start, https by default; raises where there is no host."""
    url = text if "://" in text else f"https://{text}"
    if not urlsplit(url).hostname:
        raise ValueError(f"invalid URL {text!r}: no host")
    return url


def slug_py(url: str) -> str:
    import posixpath

    path = posixpath.normpath("/" + urlsplit(url).path).lstrip("/")
    if not path or path == ".":
        return "index.md"
    out = []
    for s in path.split("/"):
        s = "".join(c if c.isalpha() or c.isdecimal() or c in "-_." else "-" for c in unquote(s)).strip("-")
        out.append(s or "page")
    return "/".join(out) + ".md"


def registrable_domain_py(text: str) -> str:
    """registrable_domain() for one text: one walk down a trie of labels."""
    h = (urlsplit(text).hostname if "://" in text else re.sub(r":\d*$", "", text)) or ""
    h = h.lower().rstrip(".")
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", h):
        return h
    labels = h.split(".")
    nodes, size, exempt = [_suffix_trie()], 1, None
    for k, label in enumerate(reversed(labels), 1):
        nodes = [n[x] for n in nodes for x in (label, "*") if x in n]
        ends = {n.get("") for n in nodes}
        if "exception" in ends:
            exempt = k - 1
        elif "plain" in ends:
            size = k
    return ".".join(labels[-(exempt or size) - 1 :])
