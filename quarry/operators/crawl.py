"""Crawl-side relational operators: scope, robots, change detection, frontier, politeness, staleness."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quarry.functions import urls
from quarry.functions.text import stale
from quarry.sources.tables import materialise

#: Default exclusions and limits.
EXCLUDE = ("/cart", "/checkout", "/wp-admin")
MOST_SITEMAP_URLS, SITEMAP_DEPTH, MOST_SITEMAP_BYTES = 50_000, 5, 32 << 20
HTML_TYPES = ("text/html", "application/xhtml+xml")


def usable(patterns: list[str] | tuple[str, ...]) -> list[str]:
    """The patterns that compile; others are passed over."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
            out.append(p)
        except re.error:
            continue
    return out


def in_scope(url: Column, site: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = EXCLUDE) -> Column:
    """Same registrable domain, some include pattern found (if any given), no exclude pattern found anywhere in the URL."""
    keep = urls.registrable_domain(url) == site
    wanted, unwanted = usable(include), usable(exclude)
    if wanted:
        some = F.lit(False)
        for p in wanted:
            some = some | url.rlike(p)
        keep = keep & some
    for p in unwanted:
        keep = keep & ~url.rlike(p)
    return keep


# --- robots -------------------------------------------------------------------------------------------------


@dataclass
class Robots:
    """The rules for one user agent: (pattern, allow) pairs, a delay in seconds (0: none) and all sitemaps."""

    rules: list[tuple[str, bool]] = field(default_factory=list)
    delay: float = 0.0
    sitemaps: list[str] = field(default_factory=list)

    def allowed(self, path: str) -> bool:
        return RobotsAutomaton(self.rules).allowed(path)


def parse_robots(text: str, user_agent: str) -> Robots:
    """Rules of the group whose agent is the longest one named in user_agent, else of the first * group."""
    groups: list[dict] = []
    sitemaps, open_ = [], False
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "sitemap":
            sitemaps += [value] if value else []
        elif key == "user-agent":
            if not open_:
                groups.append({"agents": [], "rules": [], "delay": 0.0})
                open_ = True
            groups[-1]["agents"].append(value.lower())
        elif groups and key in ("allow", "disallow", "crawl-delay"):
            open_ = False
            if key == "crawl-delay":
                try:
                    groups[-1]["delay"] = seconds if (seconds := float(value)) >= 0 else groups[-1]["delay"]
                except ValueError:
                    pass
            elif value:
                groups[-1]["rules"].append((value, key == "allow"))
    ua = user_agent.lower()
    named = [(len(a), -i) for i, g in enumerate(groups) for a in g["agents"] if a not in ("", "*") and a in ua]
    if named:
        mine = groups[-max(named)[1]]
    else:
        mine = next((g for g in groups if "*" in g["agents"]), None)
    return Robots(mine["rules"] if mine else [], mine["delay"] if mine else 0.0, sitemaps)


class RobotsAutomaton:
    """All patterns of a site in one trie, * an edge to a node that stays; read as a deterministic automaton that is built as paths need it.

    The longest pattern (in bytes) that matches from the start wins, allow among equally long ones; none allows.
    """

    def __init__(self, rules: list[tuple[str, bool]], most_states: int = 50_000) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.star: list[int | None] = [None]  # where * leads
        self.stays = [False]
        self.here: list[tuple[int, bool] | None] = [None]  # the rule that ends at the node
        self.at_end: list[tuple[int, bool] | None] = [None]  # the one that ends there at the path's end only
        for pattern, allow in rules:
            node = 0
            for c in pattern.removesuffix("$"):
                node = self._star(node) if c == "*" else self._child(node, c)
            told = self.at_end if pattern.endswith("$") else self.here
            told[node] = max(filter(None, (told[node], (len(pattern.encode()), allow))))
        self.most_states = most_states
        self._reset()

    def _new(self) -> int:
        for part, value in ((self.next, {}), (self.star, None), (self.stays, False), (self.here, None), (self.at_end, None)):
            part.append(value)
        return len(self.next) - 1

    def _child(self, node: int, c: str) -> int:
        if c not in self.next[node]:
            self.next[node][c] = self._new()
        return self.next[node][c]

    def _star(self, node: int) -> int:
        if self.star[node] is None:
            self.star[node] = self._new()
            self.stays[self.star[node]] = True
        return self.star[node]

    def _reset(self) -> None:
        self.number: dict[frozenset[int], int] = {}
        self.nodes: list[frozenset[int]] = []
        self.step: list[dict[str, int]] = []
        self.best: list[tuple[int, bool] | None] = []
        self.last: list[tuple[int, bool] | None] = []
        self.start = self._state({0})

    def _state(self, nodes: set[int]) -> int:
        todo = list(nodes)
        while todo:
            if (star := self.star[todo.pop()]) is not None and star not in nodes:
                nodes.add(star)
                todo.append(star)
        key = frozenset(nodes)
        if key not in self.number:
            self.number[key] = len(self.nodes)
            self.nodes.append(key)
            self.step.append({})
            self.best.append(max((self.here[x] for x in key if self.here[x]), default=None))
            self.last.append(max((self.at_end[x] for x in key if self.at_end[x]), default=None))
        return self.number[key]

    def allowed(self, path: str) -> bool:
        if len(self.nodes) > self.most_states:
            self._reset()
        state, best = self.start, self.best[self.start] or (0, True)
        for c in path:
            after = self.step[state].get(c)
            if after is None:
                nodes = {self.next[x][c] for x in self.nodes[state] if c in self.next[x]} | {x for x in self.nodes[state] if self.stays[x]}
                after = self.step[state][c] = self._state(nodes)
            state = after
            if (found := self.best[state]) and found > best:
                best = found
        return max(best, self.last[state] or best)[1]


def robots_rules(robots: DataFrame, user_agent: str) -> DataFrame:
    """(site, pattern, allow) of each site's robots text (site, text): files are read where they are."""

    def rules(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"pattern": p, "allow": allow} for p, allow in parse_robots(t or "", user_agent).rules])

    parse = F.pandas_udf(rules, "array<struct<pattern:string,allow:boolean>>")
    return robots.select("site", F.explode(parse("text")).alias("r")).select("site", "r.*")


def robots_allowed(pages: DataFrame, rules: DataFrame, url: str = "url", salts: int = 16) -> DataFrame:
    """pages with allowed: the longest rule that matches path and query wins, allow on a tie; no rule allows.

    A site's rules come first in its stretch of a sorted partition and are compiled there once, into one automaton that all
    its pages are read by; no page carries rules and none is matched rule by rule. Pages of one site are dealt to `salts`
    stretches, each with its own copy of the rules, so a large site is no task of its own.
    """
    listed = rules.groupBy("site").agg(F.collect_list(F.struct("pattern", "allow")).alias("_rules"))
    listed = listed.select("site", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), "_rules")
    path = urls.path_and_query(F.col(url))
    rows = pages.select("site", F.pmod(F.xxhash64(url), F.lit(salts)).cast("int").alias("_salt"), path.alias("_path"), F.struct(*pages.columns).alias("_row"))
    both = rows.unionByName(listed, allowMissingColumns=True)
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, "site", "_salt").sortWithinPartitions("site", "_salt", F.col("_rules").isNull())

    def run(batches):
        key, automaton = None, RobotsAutomaton([])
        for b in batches:
            keep, allowed = [], []
            for i, (site, salt, told, where) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 4, 2)), strict=True)):
                if (site, salt) != key or told is not None:
                    key, automaton = (site, salt), RobotsAutomaton([(r["pattern"], r["allow"]) for r in told or []])
                if told is None:
                    keep.append(i)
                    allowed.append(automaton.allowed(where or ""))
            yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(keep, pa.int64())), pa.array(allowed, pa.bool_())], ["_row", "allowed"])

    schema = StructType([StructField("_row", rows.schema["_row"].dataType), StructField("allowed", BooleanType())])
    return dealt.mapInArrow(run, schema).select("_row.*", "allowed")


def delay(robots: Robots, rps: float = 1.0) -> float:
    """Seconds between requests: the file's own delay if there is one (even a shorter one), else 1 / rps."""
    return robots.delay if robots.delay > 0 else 1.0 / (rps if rps > 0 else 1.0)


# --- fetch results ------------------------------------------------------------------------------------------


def is_html(content_type: Column) -> Column:
    t = F.lower(F.trim(content_type))
    return (t == "") | t.startswith(HTML_TYPES[0]) | t.startswith(HTML_TYPES[1])


def fetch_status(status: Column, content_type: Column) -> Column:
    """skipped (304 or no HTML), failed (any other status than 200) or fetched."""
    return F.when(status == 304, "skipped").when(status != 200, "failed").when(~is_html(content_type), "skipped").otherwise("fetched")


def state_diff(fetched: DataFrame, state: DataFrame) -> DataFrame:
    """fetched (site, url, hash, ...) with change: new, changed or unchanged against the stored state. One equi-join."""
    prior = state.select("site", "url", F.col("hash").alias("_prior"))
    kind = F.when(F.col("_prior").isNull(), "new").when(F.col("_prior") == F.col("hash"), "unchanged").otherwise("changed")
    return fetched.join(prior, ["site", "url"], "left").withColumn("change", kind).drop("_prior")


def to_index(fetched: DataFrame, state: DataFrame) -> DataFrame:
    """The fetched pages whose content is not the stored one: an anti-join on url and hash."""
    return fetched.join(state.select("site", "url", "hash"), ["site", "url", "hash"], "left_anti").select(*fetched.columns)


def next_state(state: DataFrame, seen: DataFrame) -> DataFrame:
    """state with the rows of this crawl (also unchanged ones) in place of older ones."""
    return state.join(seen.select("site", "url"), ["site", "url"], "left_anti").unionByName(seen.select(*state.columns))


def run_counters(results: DataFrame) -> DataFrame:
    """One row: visited, fetched, skipped, failed; rows blocked by robots count as visited only."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.agg(F.count("*").alias("visited"), of("fetched"), of("skipped"), of("failed"))


# --- frontier -----------------------------------------------------------------------------------------------


def bfs(seeds: DataFrame, links: DataFrame, max_depth: int = 5, max_pages: int | None = None) -> DataFrame:
    """(url, depth) reachable from seeds (url, depth) over links (src, dst), each at its least depth.

    One join for each level against that level's new urls only; the visited table is cut from its lineage
    each time. max_pages keeps the first by depth, then url.
    """
    visited = materialise(seeds.filter(F.col("depth") <= max_depth).groupBy("url").agg(F.min("depth").alias("depth")))
    for depth in range(max_depth):
        level = visited.filter(F.col("depth") == depth)
        new = links.join(level, links.src == level.url).select(F.col("dst").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
        grown = materialise(new.withColumn("depth", F.lit(depth + 1)))
        if grown.isEmpty() and visited.filter(F.col("depth") > depth).isEmpty():
            break
        visited = materialise(visited.unionByName(grown))
    return visited.orderBy("depth", "url").limit(max_pages) if max_pages else visited


def first_seen(candidates: DataFrame, key: str = "url") -> DataFrame:
    """(url, depth) once each, at the least depth."""
    return candidates.groupBy(key).agg(F.min("depth").alias("depth"))


def schedule(pages: DataFrame, interval: Column, host: str = "host", order: str = "url", start: Column | None = None) -> DataFrame:
    """pages with due: seconds after start at which each may be fetched, one interval apart on a host."""
    nth = F.row_number().over(Window.partitionBy(host).orderBy(order)) - 1
    return pages.withColumn("due", (F.lit(0.0) if start is None else start) + nth * interval)


def stale_sites(crawled: DataFrame, now: Column, interval_seconds: int) -> DataFrame:
    """Sites (site, last_crawled as RFC 3339 text) that are due for another crawl."""
    return crawled.filter(stale(F.col("last_crawled"), now, interval_seconds))


# --- sitemaps -----------------------------------------------------------------------------------------------


class _Sitemap:
    """Events of one sitemap: the root's name, and the text of each loc right below a url or sitemap right below the root."""

    def __init__(self) -> None:
        self.path: list[str] = []
        self.locs: list[str] = []
        self.root, self.text = "", None

    def start(self, name: str, _: dict) -> None:
        self.path.append(name.rsplit(":", 1)[-1])
        self.root = self.root or self.path[0]
        if self.path in (["urlset", "url", "loc"], ["sitemapindex", "sitemap", "loc"]):
            self.text = []

    def data(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)

    def end(self, _: str) -> None:
        if self.text is not None and len(self.path) == 3:
            self.locs.append("".join(self.text).strip())
            self.text = None
        self.path.pop()


def read_sitemap(xml: str, most_bytes: int = MOST_SITEMAP_BYTES, piece: int = 1 << 16) -> tuple[str, list[str]]:
    """The kind (urlset or sitemapindex) and locs of a sitemap, by an incremental parser; ("", []) if it is malformed, longer
    than most_bytes, declares entities, or is something else."""
    data, found = xml.lstrip("\ufeff \t\r\n").encode("utf-8", "replace"), _Sitemap()
    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = found.start, found.end, found.data

    def refuse(*_) -> None:
        raise ValueError("entities are not read")

    parser.EntityDeclHandler = refuse
    try:
        if len(data) > most_bytes:
            raise ValueError("too long")
        for at in range(0, len(data), piece):
            parser.Parse(data[at : at + piece], False)
        parser.Parse(b"", True)
    except (expat.ExpatError, ValueError):
        return "", []
    return (found.root, [u for u in found.locs if u][:MOST_SITEMAP_URLS]) if found.root in ("urlset", "sitemapindex") else ("", [])


def sitemap_urls(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    """sitemaps' other columns with kind (urlset or sitemapindex) and each loc, at most 50,000 a file. Malformed files give none."""

    def read(texts: pd.Series) -> pd.DataFrame:
        found = [read_sitemap(t or "") for t in texts]
        return pd.DataFrame({"kind": [k for k, _ in found], "locs": [u for _, u in found]})

    parsed = F.pandas_udf(read, "kind string, locs array<string>")
    rest = [c for c in sitemaps.columns if c != xml]
    return sitemaps.select(*rest, parsed(F.col(xml)).alias("_s")).select(*rest, F.col("_s.kind").alias("kind"), F.explode("_s.locs").alias("loc"))


def expand_sitemaps(roots: DataFrame, fetch, max_depth: int = SITEMAP_DEPTH, max_urls: int | None = MOST_SITEMAP_URLS) -> DataFrame:
    """Page urls of the sitemaps (url) that fetch, a function from a DataFrame (url) to one (url, xml), resolves.

    Indexes are followed level by level; a sitemap is read once however often it is named. The first max_urls urls by name; all if None.
    """
    seen = materialise(roots.select("url").distinct())
    level, found = seen, None
    for _ in range(max_depth + 1):
        listed = materialise(sitemap_urls(fetch(level)))
        pages = listed.filter("kind = 'urlset'").select(F.col("loc").alias("url"))
        found = pages if found is None else found.unionByName(pages)
        level = materialise(listed.filter("kind = 'sitemapindex'").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"))
        if level.isEmpty():
            break
        seen = materialise(seen.unionByName(level))
    return found.distinct() if max_urls is None else found.distinct().orderBy("url").limit(max_urls)
