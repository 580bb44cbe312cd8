"""Ranked lexical search (operator 11): best-first branch and bound over a hierarchical max tree of document ranges.

A text's terms are its runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. One pass over the documents
keeps, of each, its length and the frequencies of those terms that some query asks for. With the counts over all documents (documents,
terms, documents a term) this gives each term's impact on each document. Cells of at most CELL documents, in the order in
which they lie, hold the tree: its leaves are documents, a node above is a range of FAN nodes below it, with each term's greatest
impact in that range. A query's summed weights and impacts of a node bound all scores in it. The search descends from the
node with the highest bound and ends when no bound reaches the k-th best score; nodes with just that bound are opened
too if they hold a small enough id, as ties go to smaller ids. So results are exact, and ranges that can't compete are never looked at.

A cell starts from the k-th best score of a sample of the documents (nested samples, each SPREAD times the one before, the first of
about SEEDS documents). A sample's scores are real ones, so they bound the answer from below, drop nothing, and keep what
cells return in proportion to k, however many cells there are. Queries are read in blocks of at most BLOCK_TERMS terms, so what
tasks are handed doesn't grow with the query set.

Nulls: a null text has no terms; it is no result, and no query. Null document ids come last among equals. Each row of documents and of queries
counts and is answered for itself, repeated or not; equal scores of equal ids are ranked one after the other. Texts of any length
and columns of any other names do no harm. Without documents or queries there are no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, tidy

CELL = 1 << 15
FAN = 8
#: Nodes that are opened at a time.
WAVE = 64
SEEDS, SPREAD = 1 << 13, 64
BLOCK_TERMS, BLOCK_ITEMS = 50_000, 2_000
#: Each byte of a term as itself, A-Z lower-cased; any other byte as a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LAST = (1 << 63) - 1


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the whole text, repeats counted), ids and tfs (its terms of the vocabulary and how often each occurs)."""
    v = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for b in batches:
            lengths, found, sizes = [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                own = terms(text or b"")
                lengths.append(len(own))
                known = [i for i in map(number, own) if i is not None]
                found.append(known)
                sizes.append(len(known))
            row = np.repeat(np.arange(b.num_rows, dtype=np.int64), sizes)
            pair, tf = np.unique(row * v + np.fromiter(chain.from_iterable(found), np.int64, len(row)), return_counts=True)
            at = pa.array(np.searchsorted(pair // v, np.arange(b.num_rows + 1)).astype(np.int32))
            listed = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in ((pair % v).astype(np.int32), tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), *listed], ["doc_id", "n", "ids", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n long, ids array<int>, tfs array<int>")


# --- one cell -----------------------------------------------------------------------------------------------


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one after the other."""
    sizes = end - begin
    ends = np.cumsum(sizes)
    return np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class MaxTree:
    """A max tree of each term over ranges of the documents in order of their ids.

    Leaves lie by document: (ends of its rows, terms, impacts). Levels above lie by term: (ends of its rows, nodes, greatest impacts).
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray, term: np.ndarray, impact: np.ndarray, vocabulary: int, fan: int = FAN) -> None:
        order = np.argsort(ids, kind="stable")
        sizes = np.diff(starts)
        self.ids, self.fan = ids[order], fan
        at = np.append(0, np.cumsum(sizes[order]))
        pick = np.repeat(starts[:-1][order] - at[:-1], sizes[order]) + np.arange(at[-1])
        self.leaves = (at, term[pick], impact[pick])
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.smallest = [self.ids]  # of each node, by level
        node, term, impact = np.repeat(np.arange(len(ids)), sizes[order]), term[pick], impact[pick]
        while not self.levels or len(self.smallest[-1]) > fan:
            self.smallest.append(self.smallest[-1][::fan])
            nodes = len(self.smallest[-1])
            key = term * nodes + node // fan
            order = np.argsort(key, kind="stable")
            key, impact = key[order], impact[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            term, node = key[first] // nodes, key[first] % nodes
            impact = np.maximum.reduceat(impact, first) if len(first) else impact
            self.levels.append((np.searchsorted(term, np.arange(vocabulary + 1)), node, impact))

    def bounds(self, asked: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """The query's trees summed: of each level above the leaves, what no document in each node scores above. Sums are far below 2^53."""
        out = []
        for (at, node, impact), smallest in zip(self.levels, self.smallest[1:], strict=True):
            rows = _ranges(at[asked], at[asked + 1])
            out.append(np.bincount(node[rows], np.repeat(weights[asked], at[asked + 1] - at[asked]) * impact[rows], len(smallest)).astype(np.int64))
        return out

    def scores(self, weights: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of nodes of the lowest level, and their scores."""
        at, term, impact = self.leaves
        begin, end = nodes * self.fan, np.minimum((nodes + 1) * self.fan, len(self.ids))
        docs, rows = _ranges(begin, end), _ranges(at[begin], at[end])
        total = np.append(0, np.cumsum(weights[term[rows]] * impact[rows]))
        ends = np.cumsum(at[docs + 1] - at[docs])
        return docs, total[ends] - total[np.append(0, ends[:-1])]

    def best(self, asked: np.ndarray, weights: np.ndarray, k: int, floor: tuple[int, int] = (1, LAST), wave: int = WAVE) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) not behind floor, and how many documents were scored.

        asked: the query's terms; weights: those of all terms, 0 where not asked. The nodes with the highest bounds are opened, `wave` at a time.
        """
        bounds, top = self.bounds(asked, weights), len(self.levels)
        score, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least, last = floor  # what a document must not be behind: a higher score, or the same and no greater id
        scored = 0
        waiting = [(-LAST, top + 1, 0)]  # (-bound, level, node): the root over the highest level
        while waiting:
            leaves: list[int] = []
            for _ in range(min(wave, len(waiting))):
                if not waiting:
                    break
                bound, level, node = heapq.heappop(waiting)
                if -bound < least:
                    waiting.clear()
                    break
                if -bound == least and self.smallest[level][node] > last:
                    continue
                if level == 1:
                    leaves.append(node)
                    continue
                begin = node * self.fan
                below = bounds[level - 2][begin : begin + self.fan]
                for x in np.flatnonzero(below >= least).tolist():
                    heapq.heappush(waiting, (-int(below[x]), level - 1, begin + x))
            if leaves:
                docs, found = self.scores(weights, np.array(leaves))
                scored += len(docs)
                good = (found > least) | (found == least) & (self.ids[docs] <= last)
                score, doc = np.append(score, found[good]), np.append(doc, self.ids[docs[good]])
                order = np.lexsort((doc, -score))[:k]
                score, doc = score[order], doc[order]
                if len(score) == k:
                    least, last = int(score[-1]), int(doc[-1])
        return list(zip(score.tolist(), doc.tolist(), strict=True)), scored


def _cells(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, size - n)
            b = b.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == size:
                yield held
                held, n = [], 0
    if held:
        yield held


def _tree(held: list[pa.RecordBatch], documents: int, total: int, vocabulary: int, fan: int) -> MaxTree:
    sizes, ids, ns, term, tf = [], [], [], [], []
    for b in held:
        sizes.append(np.diff(b.column(2).offsets.to_numpy()))
        ids.append(b.column(0).fill_null(LAST).to_numpy(zero_copy_only=False))
        ns.append(b.column(1).to_numpy(zero_copy_only=False))
        term.append(b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        tf.append(b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    sizes, ids, ns, term, tf = (np.concatenate(x) for x in (sizes, ids, ns, term, tf))
    m = np.repeat(50 + 50 * ns * documents // total, sizes)
    return MaxTree(ids, np.append(0, np.cumsum(sizes)).astype(np.int64), term, 1_000_000_000 * tf // (1000 * tf + 20 * m), vocabulary, fan)


# --- queries ------------------------------------------------------------------------------------------------


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple[int | None, list[int]]], dict[bytes, int]]]:
    """Queries (item_id, its terms' numbers) with the numbers of their terms, some at a time."""
    queries: list[tuple[int | None, list[int]]] = []
    vocabulary: dict[bytes, int] = {}
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        own = dict.fromkeys(terms((r[1] or "").encode()))
        if own:
            queries.append((r[0], [vocabulary.setdefault(t, len(vocabulary)) for t in own]))
        if len(vocabulary) >= BLOCK_TERMS or len(queries) >= BLOCK_ITEMS:
            yield queries, vocabulary
            queries, vocabulary = [], {}
    if queries:
        yield queries, vocabulary


def weights_of(found: DataFrame, documents: int, vocabulary: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term of the vocabulary."""
    df = np.zeros(vocabulary, np.int64)
    for r in found.select(F.explode("ids").alias("t")).groupBy("t").count().collect():
        df[r[0]] = r[1]
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def answer(found: DataFrame, queries: list[tuple[int | None, list[int]]], weights: np.ndarray, documents: int, total: int, k: int, floors: dict[int, tuple[int, int]], cell: int = CELL, fan: int = FAN) -> DataFrame:
    """q (place of the query), doc_id, score: of each cell of frequencies() the k best of each query that are not below the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers = np.zeros(len(weights), np.int64), [np.array(asked) for _, asked in queries]
        for held in _cells(batches, cell):
            tree = _tree(held, documents, total, len(weights), fan)
            q, doc, score = [], [], []
            for i, asked in enumerate(numbers):
                own[asked] = weights[asked]
                best, _ = tree.best(asked, own, k, floors.get(i, (1, LAST)))
                own[asked] = 0
                q += [i] * len(best)
                score += [s for s, _ in best]
                doc += [None if d == LAST else d for _, d in best]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["q", "doc_id", "score"])

    return found.select("doc_id", "n", "ids", "tfs").mapInArrow(tidy(run), "q int, doc_id long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, cell: int = CELL, fan: int = FAN, seeds: int = SEEDS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best rows of docs (doc_id, text) for each row of items (item_id, text)."""
    spark, out = docs.sparkSession, None
    for queries, vocabulary in _blocks(items):
        found = cut(frequencies(docs, vocabulary).withColumn("place", F.xxhash64(F.monotonically_increasing_id())))
        rows, documents, total = found.agg(F.count("*"), F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            continue
        weights = weights_of(found, documents, len(vocabulary))
        shares, floors = [], {}
        while rows // (seeds * SPREAD ** len(shares)) > 1:
            shares.append(rows // (seeds * SPREAD ** len(shares)))
        for share in shares:
            sample = answer(found.filter(F.pmod("place", F.lit(share)) == 0), queries, weights, documents, total, k, floors, cell, fan)
            floors |= {r.q: (r.score, LAST if r.doc_id is None else r.doc_id) for r in _ranked(sample, k).filter(F.col("rank") == k).collect()}
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(queries)], "q int, item_id long")
        best = _ranked(answer(found, queries, weights, documents, total, k, floors, cell, fan), k)
        best = best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
