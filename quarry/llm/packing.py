"""Packing (operator 3): cutting-stock column generation over a length histogram.

1. One pass tokenises each document, cuts it at multiples of the sequence length and writes a small row
   for each piece (its place, length and checksum); token ids themselves are never shuffled.
2. The pieces' lengths form a histogram of at most capacity rows: the only thing the driver sees, at any size
   of input. They are rounded up to the finest of 1, 2, 4 or 8 tokens that leaves at most 512 bins.
3. A linear program chooses how often to use each pattern (a multiset of bins that fits one sequence). It starts from
   greedily filled patterns; further ones are generated as columns: a knapsack dynamic program prices them against the duals.
4. Patterns are rounded down; what is left is placed best-fit decreasing. Sequences of the rest that would
   be padded by more than `spare` are dissolved: their pieces are cut at powers of two, and the parts of all of them, largest
   first, fill sequences to the last token. The parts of the last one are sequences of their own if its padding exceeded `spare` of all tokens.
5. Pieces are ranked within their bin (counts by hash bucket, then ranks within a bucket) and the ranks
   are looked up in the patterns' runs, a table bounded by the number of bins.

Nulls: a null text is empty, so its document is the end token alone. Null ids, equal ids and repeated rows are packed
like any other row; ties within a bin are ranked by id, place and checksum. Texts of any length are cut into pieces one
document at a time. Only doc_id and text are read, so further columns of any name do no harm. An empty table gives no rows.
"""

from __future__ import annotations

import logging
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, tidy
from quarry.llm.wordtokens import tokens

CAPACITY = 4096
GRAINS = (1, 2, 4, 8)
MOST_BINS = 512
#: Pricings of a plan: about 15 ms each on the driver.
MOST_PRICINGS = 100
END = np.array([2], dtype="<u4").tobytes()


def binary_cuts(length: int) -> list[int]:
    """The powers of two that sum to length, largest first."""
    return [1 << i for i in range(length.bit_length() - 1, -1, -1) if length >> i & 1]


def document_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "word_bpe_49k.json", cache_words: int = 1_500_000) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and parts_crc32 of its power-of-two cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(vocabulary, cache_words).encode
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts_crc32")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + END)
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    part = ids[4 * start : 4 * (start + length)]
                    crcs, at = [], 0
                    if length < capacity:
                        for k in binary_cuts(length):
                            crcs.append(zlib.crc32(part[4 * at : 4 * (at + k)]))
                            at += k
                    for k, v in zip(out, (doc_id, start, length, zlib.crc32(part), n, crcs), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(pa.int64()) if k == "parts_crc32" else pa.int64()) for k, v in out.items()], list(out))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, parts_crc32 array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(tidy(run), schema)


def _price(sizes: np.ndarray, worth: np.ndarray, capacity: int, most: int = 8) -> list[np.ndarray]:
    """Unbounded knapsack, solved once: for each size the best fill of a sequence that holds it; the most valuable fills above 1, best first."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            gain = best[c - sizes[: upto[c]]] + worth[: upto[c]]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], took[c] = gain[i], i
    value = worth + best[capacity - sizes]
    columns = []
    for i in np.argsort(-value, kind="stable")[:most].tolist():
        if value[i] <= 1 + 1e-9:
            break
        column, c = np.zeros(len(sizes)), capacity - int(sizes[i])
        column[i] = 1
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                column[took[c]] += 1
                c -= sizes[took[c]]
        columns.append(column)
    return columns


def _invert(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchanges. Elementwise, like all of solve(): the driver starts no BLAS threads beside the JVM's."""
    n = len(a)
    work = np.concatenate([a, np.eye(n)], axis=1)
    for i in range(n):
        p = i + int(np.abs(work[i:, i]).argmax())
        if p != i:
            work[[i, p]] = work[[p, i]]
        work[i] /= work[i, i]
        rows = np.flatnonzero(work[:, i])
        rows = rows[rows != i]
        work[rows] -= work[rows, i][:, None] * work[i]
    return work[:, n:]


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", a, x)


def _greedy(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """A first basis: the largest size left, filled up with the largest that fit, used in parts until one size is spent.

    Each pattern holds sizes that no earlier one has spent, so the patterns in their order are a triangular matrix.
    """
    m = len(sizes)
    left, todo = counts.astype(float).copy(), set(range(m))
    basis = np.zeros((m, m))
    for j in range(m):
        lead = max(todo)
        column, room = np.zeros(m), capacity - int(sizes[lead])
        column[lead] = 1
        for i in np.flatnonzero(left[: lead + 1] > 0)[::-1].tolist() if left[lead] > 0 else [lead]:
            column[i] += room // int(sizes[i])
            room %= int(sizes[i])
        used = np.flatnonzero(column)
        share = left[used] / column[used]
        spent = int(used[share.argmin()])
        left[used] -= share.min() * column[used]
        left[spent] = 0
        todo.remove(spent)
        left[np.array([i for i in used if i not in todo], int)] = 0
        basis[:, j] = column
    return basis


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 1e-3, most: int = MOST_PRICINGS) -> tuple[np.ndarray, np.ndarray, float]:
    """Revised simplex with generated columns: the basis' patterns (as columns), how often each is used, and the gap left.

    Each pricing gives several columns, which enter while their reduced cost lasts. It stops when the bound from the best
    column, or the number of tokens, proves the plan within `gap` of the optimum, when no column improves it, or after `most`
    pricings; the gap that is left is returned. Counts are moved by tiny different amounts, so few pivots leave the plan as it was.
    """
    m = len(sizes)
    moved = counts * (1 + 1e-7 * (np.arange(m) + 1) / m) + 1e-6 * (np.arange(m) + 1) / m
    basis = _greedy(sizes, moved, capacity)
    inverse = _invert(basis)
    x, duals = np.maximum(_times(inverse, moved), 0), inverse.sum(axis=0)
    pivots, bound, left = 0, float(sizes @ moved) / capacity, 1.0  # no plan beats the tokens there are
    for _ in range(most):
        columns = _price(sizes, np.maximum(duals, 0), capacity)
        total = float(x.sum())
        value = float(np.maximum(duals, 0) @ columns[0]) if columns else 1.0
        bound = max(bound, total / value)
        left = 1 - bound / total
        if not columns or left <= gap:
            break
        entered = 0
        for column in columns:
            if duals @ column <= 1 + 1e-9:
                continue
            d = _times(inverse, column)
            ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
            r = int(ratio.argmin())
            if not np.isfinite(ratio[r]):
                continue
            basis[:, r] = column
            pivot = inverse[r] / d[r]
            rows = np.flatnonzero(d)
            inverse[rows] -= d[rows, None] * pivot
            inverse[r] = pivot
            duals = duals + (1 - d.sum()) * pivot
            x = np.maximum(x - d * ratio[r], 0)
            x[r] = ratio[r]
            entered, pivots = entered + 1, pivots + 1
            if pivots % 200 == 0:
                inverse = _invert(basis)
                x, duals = np.maximum(_times(inverse, moved), 0), inverse.sum(axis=0)
        if not entered:
            break
    return basis, np.maximum(_times(_invert(basis), counts), 0), left


def plan(histogram: dict[int, int], capacity: int, spare: float = 0.01) -> list[tuple[dict[int, int], int, bool]]:
    """(pattern, times, dissolve) whose items are exactly those of the histogram {bin: count}."""
    left = Counter({b: n for b, n in histogram.items() if n > 0})
    out: list[tuple[dict[int, int], int, bool]] = []
    if capacity in left:
        out.append(({capacity: 1}, left.pop(capacity), False))
    if not left:
        return out
    sizes = np.array(sorted(left))
    basis, x, gap = solve(sizes, np.array([float(left[s]) for s in sizes.tolist()]), capacity)
    logging.getLogger(__name__).info("packing plan for %d bins: within %.2f %% of the optimum", len(sizes), 100 * gap)
    for j in np.argsort(-x).tolist():
        pattern = {int(s): int(a) for s, a in zip(sizes, np.rint(basis[:, j]), strict=True) if a > 0}
        times = min([int(x[j] + 1e-6), *(left[s] // a for s, a in pattern.items())])
        if times > 0 and pattern:
            out.append((pattern, times, False))
            for s, a in pattern.items():
                left[s] -= a * times
    room: dict[int, list[Counter]] = {}
    for s in sorted(left, reverse=True):
        for _ in range(left[s]):
            fit = min((r for r, open_ in room.items() if r >= s and open_), default=None)
            bag = room[fit].pop() if fit is not None else Counter()
            bag[s] += 1
            room.setdefault((capacity if fit is None else fit) - s, []).append(bag)
    for r, bags in sorted(room.items()):
        out += [(dict(b), 1, r > spare * capacity) for b in bags]
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, spare: float = 0.01, bucket_rows: int = 500_000, cache_words: int = 1_500_000) -> DataFrame:
    """Pieces of docs with their sequence_id and offset: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = cut(document_pieces(docs, capacity, cache_words=cache_words))
    lengths = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    grain = next((g for g in GRAINS if capacity % g == 0 and len({-(-n // g) for n in lengths}) <= MOST_BINS), GRAINS[-1])
    histogram: Counter = Counter()
    for n, count in lengths.items():
        histogram[-(-n // grain)] += count
    pieces = pieces.withColumn("bin", F.ceil(F.col("length") / grain).cast("int"))
    runs, taken, base = [], Counter(), 0
    for pattern, times, dissolve in plan(histogram, capacity // grain, spare):
        for b, a in pattern.items():
            runs.append((b, taken[b], taken[b] + a * times, base, a, dissolve))
            taken[b] += a * times
        base += 0 if dissolve else times
    table = spark.createDataFrame(runs, "run_bin int, lo long, hi long, base long, each int, dissolve boolean")
    buckets = max(16, -(-sum(histogram.values()) // bucket_rows))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = dealt.groupBy("bin", "bucket").count().select("bin", "bucket", (F.sum("count").over(Window.partitionBy("bin").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = dealt.withColumn("place", F.row_number().over(Window.partitionBy("bin", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")))
    ranked = ranked.join(before, ["bin", "bucket"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    # the runs' number is bounded by the bins and their patterns, whatever the input
    placed = ranked.join(F.broadcast(table), (F.col("bin") == F.col("run_bin")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    within = Window.partitionBy("sequence_id").orderBy(F.col("bin").desc(), "rank")
    whole = (
        placed.filter("not dissolve")
        .withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("each")))
        .withColumn("offset", F.sum("length").over(within) - F.col("length"))
        .select(*columns, F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    )
    # what is dissolved is less than one use of each pattern; its parts, largest first, fill sequences without a gap, as each size divides the next
    top = capacity.bit_length() - 1
    size = F.element_at(F.expr(f"filter(transform(sequence({top}, 0), i -> shiftleft(1L, i)), p -> (length & p) <> 0)"), (F.col("k") + 1).cast("int"))
    parts = placed.filter("dissolve").select(*columns, F.posexplode("parts_crc32").alias("k", "crc")).withColumn("size", size)
    tokens_of = F.col("count") * F.col("size")
    larger = parts.groupBy("size").count().select("size", (F.sum(tokens_of).over(Window.orderBy(F.col("size").desc())) - tokens_of).alias("larger"), F.sum(tokens_of).over(Window.partitionBy()).alias("all"))
    nth = F.row_number().over(Window.partitionBy("size").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "k")) - 1
    parts = parts.withColumn("nth", nth).join(F.broadcast(larger), "size").withColumn("at", F.col("larger") + F.col("nth") * F.col("size"))
    ahead = F.col("length") - F.expr("length % (size * 2)")  # the larger powers of a piece come first
    # the parts of the last, short sequence are sequences of their own where its padding would tell
    tail = F.col("all") % capacity
    alone = (F.col("at") >= F.col("all") - tail) & (capacity - tail > spare * sum(n * count for n, count in lengths.items()))
    sequence = F.when(alone, F.col("at") - (F.col("all") - tail) + F.floor(F.col("all") / capacity)).otherwise(F.floor(F.col("at") / capacity))
    single = parts.select(
        "doc_id", (F.col("start") + ahead).alias("start"), F.col("size").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens",
        (F.lit(base) + sequence).cast("long").alias("sequence_id"), F.when(alone, 0).otherwise(F.col("at") % capacity).cast("long").alias("offset"),
    )
    return whole.unionByName(single)
