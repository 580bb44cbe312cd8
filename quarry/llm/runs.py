"""Periodic runs of words (operator 13): Karp-Miller-Rosenberg naming and grid candidates.

A run is a stretch of consecutive words with smallest period q, at least `least` words and 2q long, that no neighbouring
word extends. Naming: level 0 gives equal words of one text one number; level k + 1 numbers pairs of names of level k that
lie 2^k apart, so equal names stand for equal stretches of 2^(k+1) words. How far two places agree (LCE), forwards or
backwards, is read off the names from the highest level down. Candidates: a run of period q covers two grid places i and
i + q, i a multiple of q; its agreement around them sums to its length less q, so on one side of i it is at least
half of that, which one comparison of names at one level tells for a whole grid at a time. Survivors are extended both ways.
There are no hashes of stretches and no suffix sorting. Names that occur once are not sorted again, and a level
without a repeated name ends the search: plain prose costs little more than its words.

Many texts are named and searched at once, in blocks of BLOCK words or one longer text; words of different texts have
different names, so no run crosses texts. Memory is about 8 bytes a word and level of names, at most log2 of the longest
text's words levels.

Nulls: a null text has no words, no runs and the empty collapsed text; a null id stays. Empty texts are like null ones. Repeated rows
and equal ids are answered row by row. Of equal stretches the smallest period counts. Texts of any length and columns of
any other names do no harm; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD, tidy

LEAST = 12
BLOCK = 1 << 18
#: Candidates that are extended at a time.
PAIRS = 1 << 16


def name_levels(first: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names by level; names[k][i] stands for the 2^k words from i. A last, unlike name ends each level."""
    n = len(first)
    names = [np.append(first, 2 * n).astype(np.int64)]
    often = np.bincount(first, minlength=1)[first] > 1
    step = 1
    while 2 * step <= longest:
        at = np.flatnonzero(often[: n - 2 * step + 1] & often[step : n - step + 1])
        if not len(at):
            break
        low = names[-1]
        _, name, count = np.unique(low[at] * (2 * n + 1) + low[at + step], return_inverse=True, return_counts=True)
        level = np.arange(n, 2 * n + 1)  # unlike all others, and unlike ranks, which stay below n
        level[at] = name
        often = np.zeros(n, bool)
        often[at] = count[name] > 1
        if not often.any():
            break
        names.append(level)
        step *= 2
    return names


def agree_after(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on (i < j)."""
    far = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        far += (names[k][i + far] == names[k][j + far]).astype(np.int64) << k
    return far


def agree_before(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j (i < j)."""
    far = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        a = i - far - (1 << k)
        b = np.maximum(a, 0) + (j - i)
        far += ((a >= 0) & (names[k][np.maximum(a, 0)] == names[k][b])).astype(np.int64) << k
    return far


def _extended(names: list[np.ndarray], i: np.ndarray, q: np.ndarray, least: int) -> np.ndarray:
    """(start, end, period) of the stretches around the grid places i and i + q that are long enough."""
    back, on = agree_before(names, i, i + q), agree_after(names, i, i + q)
    good = back + on + q >= np.maximum(least, 2 * q)
    return np.stack([i - back, i + q + on, q])[:, good]


def _smallest(found: list[np.ndarray]) -> np.ndarray:
    """Each stretch once, with its smallest period; in order of start, then period."""
    start, end, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return np.stack([start[order], end[order], q[order]])


def runs_of(first: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of all runs over numbered words; longest: words of the longest text among them."""
    n = len(first)
    none = np.zeros((3, 0), np.int64)
    if n < least:
        return none
    names, found, waiting, held = name_levels(first, longest), [none], [], 0
    for q in range(1, longest // 2 + 1):
        side = (max(least, 2 * q) - q + 1) // 2  # on one side at least so many words agree
        k = side.bit_length() - 1
        if k >= len(names):  # nothing so long is met twice, and longer periods ask for more
            break
        level, h = names[k], 1 << k
        on = np.flatnonzero(level[: n - q : q] == level[q:n:q]) * q
        start = -(-h // q) * q  # the first grid place with h words before it
        back = np.flatnonzero(level[start - h : n - q - h : q] == level[start - h + q : n - h : q]) * q + start if start + q < n else on[:0]
        i = np.union1d(on, back) if len(on) and len(back) else on if len(on) else back
        if len(i):
            waiting.append(np.stack([i, np.full(len(i), q)]))
            held += len(i)
        if held >= PAIRS:
            found = [_smallest([*found, _extended(names, *np.concatenate(waiting, axis=1), least)])]
            waiting, held = [], 0
    if waiting:
        found.append(_extended(names, *np.concatenate(waiting, axis=1), least))
    return _smallest(found)


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word of the texts, the same for equal words of one text only."""
    out, base = [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        out.append(np.fromiter([seen.setdefault(w, base + len(seen)) for w in words], np.int64, len(words)))
        base += len(seen)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _blocks(sizes: np.ndarray, least: int) -> Iterator[list[int]]:
    """Texts that may hold a run, by length, in blocks of at most BLOCK words or one text."""
    block, held = [], 0
    for d in np.argsort(sizes, kind="stable"):
        if sizes[d] < least:
            continue
        if block and held + sizes[d] > BLOCK:
            yield block
            block, held = [], 0
        block.append(int(d))
        held += int(sizes[d])
    if block:
        yield block


def search(texts: list[bytes | None], least: int = LEAST) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    """Words, runs (start, length, period) and collapsed text of each text, by position."""
    words = [(t or b"").split() for t in texts]  # bytes split at 0x20 and 0x09-0x0D only
    none = np.zeros((0, 3), np.int64)
    runs: list[np.ndarray] = [none] * len(words)
    kept: list[list[bytes]] = list(words)
    sizes = np.array([len(w) for w in words], np.int64)
    for block in _blocks(sizes, least):
        ends = np.cumsum(sizes[block])
        begins = ends - sizes[block]
        start, end, q = runs_of(_numbered([words[d] for d in block]), int(sizes[block].max()), least)
        if not len(start):
            continue
        change = np.zeros(int(ends[-1]) + 1, np.int64)
        np.add.at(change, start + q, 1)
        np.add.at(change, end, -1)
        stays = np.cumsum(change)[:-1] == 0
        of = np.searchsorted(ends, start, side="right")
        for x in np.unique(of):
            d, mine = block[x], of == x
            runs[d] = np.stack([start[mine] - begins[x], (end - start)[mine], q[mine]], axis=1)
            kept[d] = list(compress(words[d], stays[begins[x] : ends[x]].tolist()))
    return [len(w) for w in words], runs, [b" ".join(w) for w in kept]


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the words that no run repeats) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, runs, collapsed = search(b.column(1).cast(pa.binary()).to_pylist(), least)
            at = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32)
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            listed = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), listed, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text; every tenth one, by crc32 of its id, periodic from some word on: the words of one stretch over and over. A null id plants nothing."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))

    def repeated(x: Column) -> Column:
        a = (x["g"] % F.size(x["w"])).cast("int")
        rest = F.size(x["w"]) - a
        p = (1 + F.floor(rest / (3 + x["g"] % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), rest - 1), lambda i: F.get(x["w"], a + i % p))
        return F.array_join(F.concat(F.slice(x["w"], F.lit(1), a), tail), " ")

    once = F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), repeated)[0]
    return F.when((h % 10 == 0) & (F.size(words) > 0), once).otherwise(F.col(text))
