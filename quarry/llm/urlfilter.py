"""URL filters (operator 12): allow and block rules looked up in a memory-mapped sorted array of digests.

A rule is a host and the start of a path. The index holds two kinds of strings: each rule, as host, NUL, path, with its verdict,
and each rule's host alone, once for each length of path that its rules have. The strings' 64-bit xxHash digests are a sorted
array in a file; beside it lie the strings and their values. Spark sorts the strings by digest and its tasks write the files, one
for each range of digests, into the session's shared folder; Spark ships them to every executor, where workers map
them into memory. A batch of urls is answered by two vectorised binary searches: the suffixes of its distinct
hosts, then, for those hosts that have rules, the starts of the paths at the lengths found. Every digest met is confirmed by the
stored string, so equal digests of unlike strings do no harm.

A rule fits its host and all subdomains, and paths that start with its path. The rule with the longest string (host and path)
wins, of equally long ones the one with the longer host; of equal rules with both verdicts, allow. Where no rule fits, the default
holds.

Nulls: a null url, or one without "://", has an empty host and path, and the default. A rule without a host is left out; a null path
is an empty one. Repeated rules and rows do no harm. Urls of any length and columns of any other names do no harm; without rules
each url gets the default, and an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import shared_folder, tidy

#: After the first "://": the host up to / ? # or the end, the path up to ? # or the end.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEED = 42
#: Strings in a file.
ROWS = 1_000_000
VERDICTS = ("block", "allow")
SIGN = -(1 << 63)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


# --- the index ----------------------------------------------------------------------------------------------


class DigestArray:
    """One file: the number of strings, their sorted digests, their values, their ends, their bytes."""

    def __init__(self, path: str) -> None:
        self.n = n = int(np.fromfile(path, "<u8", 1)[0])
        at = lambda kind, offset, size: np.memmap(path, kind, "r", offset, (size,)) if size else np.zeros(0, kind)
        self.digests, self.values, self.ends = at("<u8", 8, n), at("<i8", 8 + 8 * n, n), at("<i8", 8 + 16 * n, n)
        self.text = at("u1", 8 + 24 * n, int(self.ends[-1]) if n else 0)

    @staticmethod
    def content(digests: np.ndarray, strings: list[bytes], values: np.ndarray) -> bytes:
        ends = np.cumsum([len(s) for s in strings]).astype("<i8")
        return b"".join([np.array([len(strings)], "<u8").tobytes(), digests.astype("<u8").tobytes(), values.astype("<i8").tobytes(), ends.tobytes(), *strings])

    def probe(self, digests: np.ndarray, strings: list[bytes]) -> Iterator[tuple[int, int]]:
        """(place of the string, value) of every stored string that is one of strings."""
        low, high = np.searchsorted(self.digests, digests, "left"), np.searchsorted(self.digests, digests, "right")
        for k in np.flatnonzero(high > low):
            for at in range(low[k], high[k]):
                if self.text[self.ends[at - 1] if at else 0 : self.ends[at]].tobytes() == strings[k]:
                    yield int(k), int(self.values[at])


@dataclass
class UrlFilter:
    """Names of the shipped files in order of digests, with the first digest of each."""

    files: list[str] = field(default_factory=list)
    firsts: list[int] = field(default_factory=list)

    def lookup(self, strings: list[str]) -> dict[str, list[int]]:
        """The values of those strings that are stored."""
        found: dict[str, list[int]] = {}
        if not self.files or not strings:
            return found
        coded = [s.encode() for s in strings]
        digests = np.fromiter([xxhash.xxh64_intdigest(s, SEED) for s in coded], np.uint64, len(coded))
        of = np.searchsorted(np.array(self.firsts, np.uint64), digests, "right") - 1
        for f in np.unique(of[of >= 0]):
            mine = np.flatnonzero(of == f)
            for k, value in _opened(self.files[f]).probe(digests[mine], [coded[i] for i in mine]):
                found.setdefault(strings[mine[k]], []).append(value)
        return found


_open: dict[str, DigestArray] = {}


def _opened(name: str) -> DigestArray:
    """The worker's own map of a shipped file."""
    if name not in _open:
        _open[name] = DigestArray(SparkFiles.get(name))
    return _open[name]


def strings_of(rules: DataFrame) -> DataFrame:
    """(text, value): host NUL path with the verdict, and the host with the lengths of its rules' paths."""
    r = rules.filter(F.col("host").isNotNull()).select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.when(F.col("verdict") == "allow", 1).otherwise(0).cast("long").alias("value"))
    whole = r.groupBy(F.concat("host", F.lit("\0"), "path").alias("text")).agg(F.max("value").alias("value"))
    return whole.unionByName(r.select(F.col("host").alias("text"), F.length("path").cast("long").alias("value")).distinct())


def build(rules: DataFrame, rows: int = ROWS) -> UrlFilter:
    """The index of rules (host, path, verdict: allow or block). A file a range of digests reaches the driver as its name alone.

    The files stay in the shared folder as long as the session may start new executors.
    """
    spark = rules.sparkSession
    texts = strings_of(rules)
    parts = -(-texts.count() // rows)
    if not parts:
        return UrlFilter()
    # the signed order of a digest with its highest bit turned is the unsigned one
    keyed = texts.withColumn("u", F.xxhash64("text").bitwiseXOR(F.lit(SIGN))).repartitionByRange(parts, "u").sortWithinPartitions("u", "text", "value")
    folder = f"{shared_folder(spark)}/url-filter-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        digests = (t.column("u").to_numpy() ^ np.int64(SIGN)).view(np.uint64)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.digests"  # a task that runs twice writes two files; only the reported one is read
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(DigestArray.content(digests, [s.encode() for s in t.column("text").to_pylist()], t.column("value").to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array([int(t.column("u")[0].as_py())]), pa.array([name])], ["u", "name"])

    files = keyed.select("u", "text", "value").mapInArrow(tidy(run), "u long, name string").collect()
    files.sort()
    for f in files:
        spark.sparkContext.addFile(f"{folder}/{f.name}")
    return UrlFilter([f.name for f in files], [(f.u ^ SIGN) & ((1 << 64) - 1) for f in files])


# --- lookups ------------------------------------------------------------------------------------------------


def suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    labels = host.split(".")
    return [".".join(labels[k:]) for k in range(len(labels))]


def decide(index: UrlFilter, hosts: list[str], paths: list[str], default: str = "allow") -> list[tuple[str | None, str]]:
    """(rule, verdict) of each pair of a host and a path."""
    parents = {h: suffixes(h) for h in set(hosts)}
    ruled = index.lookup(list({s for own in parents.values() for s in own}))
    tries = {h: sorted(((len(s) + n, len(s), s, n) for s in own for n in ruled.get(s, ())), reverse=True) for h, own in parents.items()}
    asked = [[(s, p[:n]) for _, _, s, n in tries[h] if len(p) >= n] for h, p in zip(hosts, paths, strict=True)]
    found = index.lookup(list({f"{s}\0{p}" for own in asked for s, p in own}))
    out: list[tuple[str | None, str]] = []
    for own in asked:
        hit = next(((s + p, found[f"{s}\0{p}"][0]) for s, p in own if f"{s}\0{p}" in found), None)
        out.append((None, default) if hit is None else (hit[0], VERDICTS[hit[1]]))
    return out


def judge(pages: DataFrame, index: UrlFilter, key: str = "page_id", default: str = "allow") -> DataFrame:
    """key, host, path, rule (its string; null if none fits) and verdict of each row of pages (key, url)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = decide(index, b.column(1).to_pylist(), b.column(2).to_pylist(), default)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r for r, _ in told], pa.string()), pa.array([v for _, v in told], pa.string())], [key, "host", "path", "rule", "verdict"])

    url = F.col("url").cast("string")
    rows = pages.select(F.col(key), host_of(url).alias("host"), path_of(url).alias("path"))
    kind = pages.schema[key].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"`{key}` {kind}, host string, path string, rule string, verdict string")
