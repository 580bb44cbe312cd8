"""SimHash near-duplicates (operator 1): a Gray-order hierarchical index.

Fingerprints are 64 bits, kept as signed longs. Two link when they differ in at most `radius` bits.

* Equal fingerprints are one node, so exact copies cost one row however many there are.
* All nodes are sorted by Gray rank (range partitioning) and cut into blocks. Index nodes are groups of
  neighbours: FAN fingerprints, FAN such groups and so on up to the block, and blocks in turn. A node holds the
  masked pattern that all below it share; a pair of nodes adds only the bits that its parents did not
  share yet, and the differences accumulated on the way down prune the whole pair once they pass the radius.
* Two fingerprints within the radius differ in at most half of it in one of their 32-bit halves. So the index is
  built twice, with either half leading, and descends only with `radius // 2` differences in the leading half
  (exact by the pigeonhole principle). Without that bound a block would meet cubically many others.
* What all blocks share, at most `most_blocks` patterns, is gathered; each block then travels, packed, to
  the blocks that no pattern rules out, and every pair of blocks is a task of its own, so no key is hot.
* Pairs of blocks emit a bounded-degree forest of their links, never all pairs; components come from min-label
  propagation with pointer jumping over checkpointed tables.

Nulls: a null text is an empty text (fingerprint zero). Rows with a null doc_id get the component of the
rows that share their fingerprint, null where none of those has an id. Repeated rows come back once each, ties
(equal fingerprints, equal ids) have one class. Texts of any length are hashed whole, in flat memory beside their
shingles. Only doc_id and text are read, so further columns of any name do no harm. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, small, spread_join, tidy

SEED = 42
FAN = 16
CHILDREN = 32
#: The leading half of a turned fingerprint.
LEADING = np.uint64(0xFFFFFFFF00000000)
UPPER = bytes(range(65, 91))
FOLD = bytes.maketrans(UPPER, UPPER.lower())


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, bit 0 first; in slices so memory stays flat for long texts."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65535):
        part = np.unpackbits(hashes[i : i + 65535].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += part.sum(axis=0, dtype=np.uint16)
    return total


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included, in order; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    whole = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(whole, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1)
    starts = (ends - lengths - 1)[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([h(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: the bits set in over half of the hashes; 0 for none."""
    return int(np.packbits(_bits(hashes) * 2 > len(hashes), bitorder="little").view("<i8")[0]) if len(hashes) else 0


def fingerprint(text: str | None, width: int = 3) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of each row; only these two columns are read from docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(x.as_py(), width) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each (unsigned) fingerprint in the reflected Gray sequence."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def levels(ones: np.ndarray, some: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The index over neighbours, top first: at each node the bits that are one in all below it, and those that are alike in all."""
    out = [(ones, ones | ~some)]
    while len(ones) > 1:
        pad = -len(ones) % FAN
        ones = np.bitwise_and.reduce(np.concatenate([ones, np.repeat(ones[-1:], pad)]).reshape(-1, FAN), axis=1)
        some = np.bitwise_or.reduce(np.concatenate([some, np.repeat(some[-1:], pad)]).reshape(-1, FAN), axis=1)
        out.append((ones, ones | ~some))
    return out[::-1]


def descend(left: list, right: list, radius: int, same: bool = False, run: int = 4096) -> Pairs:
    """Pairs of bottom places that no accumulated difference rules out: over `radius`, or over half of it in the leading bits."""
    depth = max(len(left), len(right))
    left, right = ([x[0]] * (depth - len(x)) + x for x in (left, right))
    zero = np.zeros(1, dtype=np.int64)
    stack = [(0, zero, zero, np.zeros(1, dtype=np.uint64), zero, zero)]
    step = np.arange(FAN)
    while stack:
        at, a, b, known, lead, total = stack.pop()
        if len(a) > run:
            stack.append((at, *(x[run:] for x in (a, b, known, lead, total))))
            a, b, known, lead, total = (x[:run] for x in (a, b, known, lead, total))
        (ones_a, like_a), (ones_b, like_b) = left[at], right[at]
        common = like_a[a] & like_b[b]
        apart = (ones_a[a] ^ ones_b[b]) & common & ~known
        lead = lead + np.bitwise_count(apart & LEADING)
        total = total + np.bitwise_count(apart)
        ok = (lead <= radius // 2) & (total <= radius)
        a, b, common, lead, total = a[ok], b[ok], common[ok], lead[ok], total[ok]
        if not len(a):
            continue
        if at == depth - 1:
            yield a, b
            continue
        # a tree that is less deep stays at its top
        grow_a, grow_b = (len(x[at + 1][0]) > 1 for x in (left, right))
        u = (a[:, None] * FAN + step).reshape(len(a), -1, 1) if grow_a else a[:, None, None]
        v = (b[:, None] * FAN + step).reshape(len(b), 1, -1) if grow_b else b[:, None, None]
        u, v = np.broadcast_arrays(u, v)
        here = (u < len(left[at + 1][0])) & (v < len(right[at + 1][0]))
        if same:
            here &= u <= v
        row = np.nonzero(here)[0]
        stack.append((at + 1, u[here], v[here], common[row], lead[row], total[row]))


class _Forest:
    """Union-find over places; the smaller place wins."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def _flat(self) -> None:
        while not np.array_equal(nxt := self.up[self.up], self.up):
            self.up = nxt

    def join(self, pairs: Pairs) -> None:
        for i, j in pairs:
            self._flat()
            new = self.up[i] != self.up[j]
            for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
                a, b = self._find(a), self._find(b)
                if a != b:
                    self.up[max(a, b)] = min(a, b)

    def _find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each component as a tree of at most CHILDREN children a node: no member becomes a hub."""
        self._flat()
        order = np.argsort(self.up, kind="stable")
        root = self.up[order]
        first = np.searchsorted(root, root)
        nth = np.arange(len(order)) - first
        at = np.flatnonzero(nth)
        return order[first[at] + (nth[at] - 1) // CHILDREN], order[at]


def block_edges(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links in one block (node, fp) or between two; fps turned, in Gray order."""
    a = levels(left[1], left[1])
    if right is None:
        forest, node = _Forest(len(left[0])), left[0]
        forest.join(descend(a, a, radius, same=True))
    else:
        shift, node = len(left[0]), np.concatenate([left[0], right[0]])
        forest = _Forest(len(node))
        forest.join((i, j + shift) for i, j in descend(a, levels(right[1], right[1]), radius))
    i, j = forest.edges()
    return node[i], node[j]


def _packer(rows: int):
    """mapInArrow body over (turn, rank, node, fp) in order: packed blocks of at most so many rows of one turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        made = 0

        def emit(turn: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            at = (TaskContext.get().partitionId() << 32) + made
            made += 1
            ones, some = (int(f.reduce(fp).view(np.int64)) for f in (np.bitwise_and, np.bitwise_or))
            return pa.RecordBatch.from_pydict({"block": [at], "turn": [int(turn[0])], "ones": [ones], "some": [some], "nodes": [node.tobytes()], "fps": [fp.tobytes()]}, PACKED)

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            turn, node, fp = (np.concatenate([x[c] for x in held]) for c in range(3))
            held.clear()
            cuts = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1).tolist(), len(turn)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while b - a >= rows or (a < b and (final or b < len(turn))):
                    z = min(b, a + rows)
                    yield emit(turn[a:z], node[a:z], fp[a:z])
                    a = z
                if a < b:
                    held.append((turn[a:b], node[a:b], fp[a:b]))

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy().view(np.uint64)))
                if sum(len(x[0]) for x in held) >= rows:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


PACKED = pa.schema([("block", pa.int64()), ("turn", pa.int32()), ("ones", pa.int64()), ("some", pa.int64()), ("nodes", pa.binary()), ("fps", pa.binary())])


def links(nodes: DataFrame, radius: int = 3, block_rows: int = 16_384, most_blocks: int = 16_384) -> DataFrame:
    """Links (a < b) that connect all of `nodes` (node long, fp long, distinct fps) within radius.

    Not every pair: a spanning forest of each pair of blocks. Blocks grow beyond `block_rows` where there would be more
    than about `most_blocks` of them.
    """
    spark = nodes.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 2 * nodes.count()
    rows = max(block_rows, -(-n // most_blocks))
    turned = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    both = nodes.select("node", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("fp").alias("fp")), F.struct(F.lit(1).alias("turn"), turned.alias("fp")))).alias("x")).select("node", "x.turn", "x.fp")
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    ranked = both.select("turn", rank.alias("rank"), "node", "fp")
    # pieces of a block at most: a task packs its own range of ranks
    parts = max(1, -(-n // rows))
    blocks = cut(ranked.repartitionByRange(parts, "turn", "rank").sortWithinPartitions("turn", "rank", "node").mapInArrow(tidy(_packer(rows)), "block long, turn int, ones long, some long, nodes binary, fps binary"))
    tops = {}  # bounded: two patterns for each of most_blocks blocks and of the partitions' last ones
    known = sorted((r.turn, r.block, r.ones, r.some) for r in blocks.select("turn", "block", "ones", "some").collect())
    for turn in (0, 1):
        own = [x for x in known if x[0] == turn]
        patterns = [np.array([x[c] for x in own], dtype=np.int64).view(np.uint64) for c in (2, 3)]
        tops[turn] = (np.array([x[1] for x in own], dtype=np.int64), levels(*patterns) if own else [])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block once for every block that it may link with."""
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k] for c in ("block", "turn", "ones", "some", "nodes", "fps")}
                mine = row["block"].as_py()
                ids, top = tops[row["turn"].as_py()]
                own = levels(*(np.array([row[c].as_py()], dtype=np.int64).view(np.uint64) for c in ("ones", "some")))
                for _, j in descend(own, top, radius):
                    for others in np.array_split(ids[j], -(-len(j) // 32)):
                        m = len(others)
                        columns = [pa.array(np.minimum(others, mine)), pa.array(np.maximum(others, mine)), pa.array(np.full(m, mine))]
                        yield pa.RecordBatch.from_arrays([*columns, *(pa.array([row[c].as_py()] * m, pa.binary()) for c in ("nodes", "fps"))], ["lo", "hi", "mine", "nodes", "fps"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            for k in range(b.num_rows):
                lo, hi = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                own = (np.frombuffer(b.column(3)[k].as_py(), dtype=np.int64), np.frombuffer(b.column(4)[k].as_py(), dtype=np.uint64))
                if lo != hi and (held is None or held[:2] != (lo, hi)):
                    held = (lo, hi, own)
                    continue
                i, j = block_edges(own, None, radius) if lo == hi else block_edges(held[2], own, radius)
                held = None
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    dealt = blocks.mapInArrow(tidy(deal), "lo long, hi long, mine long, nodes binary, fps binary")
    pairs = dealt.repartition(max(shuffles, len(known) // 2), "lo", "hi").sortWithinPartitions("lo", "hi", "mine")
    return pairs.mapInArrow(tidy(link), "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node it can reach.

    Each round takes the smallest label among the neighbours, then the label of that label, so a
    chain of n nodes needs about log n rounds. Both joins key on nodes of bounded degree or are plain
    shuffled joins whose large side adaptive execution may split.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(max_rounds):
        seen = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = cut(labels.join(seen, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")))
        jump = step.select(F.col("node").alias("at"), F.col("label").alias("next"))
        after = cut(step.join(jump, step.label == jump["at"], "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "was"))
        labels = after.select("node", "label")
        if after.filter("label <> was").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), rep (smallest id with that fp), component_id.

    A fingerprint is a node whether or not one of its rows has an id, so rows without an id link others too.
    """
    fps = cut(fingerprints(docs, width))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()))
    labels = components(cut(links(reps.select("node", "fp"), radius)))
    classes = cut(reps.join(labels, "node", "left").select("fp", "rep", F.coalesce("label", "node").alias("label")))
    smallest = cut(classes.groupBy("label").agg(F.min("rep").alias("component_id")))
    classes = cut(spread_join(classes, smallest, "label").select("fp", "rep", "component_id"))
    return spread_join(fps, classes, "fp").select("doc_id", "fp", "rep", "component_id")


def partial_fingerprints(hashes: np.ndarray, parts: int = 16, rows: int = 3) -> list[int]:
    """SimHashes of `rows` shingles each, drawn min-wise: two texts share one with about similarity ** rows.

    The hash space is cut into parts x rows slots and each slot gives its least hash; an empty slot borrows
    from the next one that isn't.
    """
    slots = parts * rows
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    top = np.uint64(2**64 - 1)
    least = np.full(slots, top)
    np.minimum.at(least, ((mixed >> np.uint64(32)) % np.uint64(slots)).astype(np.int64), mixed)
    full = np.flatnonzero(least != top)
    if len(full) < slots:
        take = full[np.searchsorted(full, np.arange(slots)) % len(full)]
        least = least[take] + (take != np.arange(slots)) * np.arange(slots, dtype=np.uint64)
    if rows == 3:  # the majority of three, for all parts at once
        a, b, c = least.reshape(parts, 3).T
        return ((a & b) | (a & c) | (b & c)).view(np.int64).tolist()
    return [majority(x) for x in least.reshape(parts, rows)]


#: Rows (of three numbers) that are broadcast to be joined with whole texts, at most: a larger table shuffles the texts.
KEYS = 60_000
#: Stands for a null id in the order of rows: after all others.
LAST = 2**63 - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, text): a row's id and two hashes of its text, which tell rows of equal id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"), text.alias("text"))


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """(id, k1, k2, fp, words_key, parts): whole and partial fingerprints, and a 128-bit digest of the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, keys, parts = [], [], []
            for x in b.column(3):
                text = x.as_py()
                h = shingle_hashes(text, width)
                fp.append(majority(h))
                keys.append(xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8", "surrogatepass").translate(FOLD).split())))
                parts.append(partial_fingerprints(h) if len(h) else [])
            found = [pa.array(fp, pa.int64()), pa.array(keys, pa.binary()), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *found], ["id", "k1", "k2", "fp", "words_key", "parts"])

    return _keyed(docs).mapInArrow(tidy(run), "id long, k1 long, k2 int, fp long, words_key binary, parts array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, hashes): the distinct shingles of the texts of nodes (node, id, k1, k2); repeated rows give a set each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(shingle_hashes(x.as_py(), width)).view(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64()))], ["node", "hashes"])

    rows = _keyed(docs).join(small(nodes, KEYS), ["id", "k1", "k2"]).select("node", "text")
    return rows.mapInArrow(tidy(run), "node long, hashes array<long>")


def _groups(batches: Iterator[pa.RecordBatch], heads: int) -> Iterator[tuple[list, list[list], list[np.ndarray]]]:
    """Runs of rows with equal leading columns: that key, the columns between as lists, and the arrays of the last one."""
    key, rows, sets = None, [], []
    for batch in batches:
        hashes = batch.column(batch.num_columns - 1)
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns - 1)), strict=True)):
            if row[:heads] != key:
                if rows:
                    yield key, [list(c) for c in zip(*rows, strict=True)], sets
                key, rows, sets = row[:heads], [], []
            rows.append(row[heads:])
            sets.append(np.array(hashes[i].values))
    if rows:
        yield key, [list(c) for c in zip(*rows, strict=True)], sets


def _pieces(rows: DataFrame, key: str, sizes: DataFrame, piece_rows: int, piece_shingles: int) -> DataFrame:
    """rows (key, node, ...) with the number of pieces that their key's rows are to be cut into."""
    need = F.greatest(F.ceil(F.count("*") / piece_rows), F.ceil(F.sum("size") / piece_shingles)).cast("int")
    heavy = rows.join(sizes, "node").groupBy(key).agg(need.alias("cuts")).filter("cuts > 1")
    return spread_join(rows, heavy, key, "left").withColumn("cuts", F.coalesce(F.col("cuts"), F.lit(1)))


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, order[0]).sortWithinPartitions(*order)


def star_matches(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, similarity: float, piece_rows: int = 256, piece_shingles: int = 100_000) -> DataFrame:
    """Links that join each node b of the pairs (a, b) with a, where their shingle sets are similar.

    The partners of one a are dealt into pieces of a bounded size, each with its own copy of a's set, so that a
    text with very many partners is no task of its own. A piece gives a bounded-degree tree.
    """
    cut_pairs = _pieces(pairs.select("a", F.col("b").alias("node")), "a", sizes, piece_rows, piece_shingles)
    dealt = cut_pairs.select("a", "node", F.xxhash64("a", F.pmod(F.xxhash64("node"), "cuts")).alias("key"))
    hubs = dealt.select("a", F.col("a").alias("node"), "key").distinct()
    rows = dealt.unionByName(hubs).join(sets, "node").select("key", "a", (F.col("node") != F.col("a")).alias("partner"), "node", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, a), (partner, node), own in _groups(batches, 2):
            if partner[0]:
                continue
            found = [a]
            for b, x in zip(node[1:], own[1:], strict=True):
                both = len(np.intersect1d(own[0], x, assume_unique=True))
                if b != a and both >= similarity * (len(own[0]) + len(x) - both):
                    found.append(b)
            links = [(min(found[(k - 1) // CHILDREN], found[k]), max(found[(k - 1) // CHILDREN], found[k])) for k in range(1, len(found))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    return _dealt(rows, "key", "a", "partner", "node").mapInArrow(tidy(run), "a long, b long")


def unlike_buckets(members: DataFrame, sizes: DataFrame, piece_rows: int = 256, piece_shingles: int = 100_000) -> DataFrame:
    """(key, common, mains, rests) of the buckets whose members (key, node, label) have unlike labels: the most frequent label,
    and into how many pieces the members that have it, and the rest, are to be cut."""
    by = members.join(sizes, "node").groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    whole = by.groupBy("key").agg(F.max(F.struct("n", "s", "label")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s")).filter("main.n < n")
    pieces = lambda n, s: F.greatest(F.ceil(n / piece_rows), F.ceil(s / piece_shingles), F.lit(1)).cast("int")
    return cut(whole.select("key", F.col("main.label").alias("common"), pieces(F.col("main.n"), F.col("main.s")).alias("mains"), pieces(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("rests")))


def matches(members: DataFrame, buckets: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a < b) between texts of a bucket: every two members (key, node, label) of unlike labels are compared exactly.

    Members whose labels a link has joined are not compared again. A bucket's most frequent label (its main members) needs no
    comparison within itself, so only the rest meet each other and the main members. Both are cut into pieces of a bounded
    size, and every pair of pieces that must meet is a group of its own.
    """
    parted = spread_join(members, buckets, "key").withColumn("main", F.col("label") == F.col("common"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests")))
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1)
    with_rest = F.transform(upto("rests"), lambda j: F.xxhash64("key", F.lit("main"), mine, j))
    with_main = F.transform(upto("mains"), lambda i: F.xxhash64("key", F.lit("main"), i, mine))
    among = F.transform(upto("rests"), lambda j: F.xxhash64("key", F.lit("rest"), F.least(j, mine), F.greatest(j, mine)))
    groups = F.explode(F.when(F.col("main"), with_rest).otherwise(F.concat(with_main, among)))
    rows = parted.select(groups.alias("key"), "node", "label").join(sets, "node").select("key", "node", "label", "hashes")

    def solve(node: list[int], label: list[int], own_sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        ids = np.array(node, dtype=np.int64)
        label = np.unique(np.array(label, dtype=np.int64), return_inverse=True)[1]
        size = np.array([len(x) for x in own_sets], dtype=np.int64)
        owner, flat = np.repeat(np.arange(len(size)), size), np.concatenate(own_sets)
        shingle, count = np.unique(flat, return_inverse=True, return_counts=True)[1:]
        holders = owner[np.argsort(shingle, kind="stable")]  # of each shingle in turn
        first, ends = np.cumsum(count) - count, np.cumsum(size)
        for i in range(len(size)):
            if (label == label[i]).all():
                continue
            own = shingle[ends[i] - size[i] : ends[i]]
            n = count[own]
            at = np.arange(n.sum()) + np.repeat(first[own] - (np.cumsum(n) - n), n)
            both = np.bincount(holders[at], minlength=len(size))
            for j in np.flatnonzero((both >= similarity * (size + size[i] - both)) & (label != label[i])).tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    yield int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (node, label), own in _groups(batches, 1):
            found = np.array(list(solve(node, label, own)), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return _dealt(rows, "key", "node").mapInArrow(tidy(run), "a long, b long").distinct()


def representatives(docs: DataFrame, width: int = 5, radius: int = 3, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(id, k1, k2, words_key) of all rows, and the texts: words_key, id, k1, k2 of the first row with it, and label, which near copies share."""
    found = cut(sketches(docs, width))
    first = F.min(F.struct("id", "k1", "k2", "fp", "parts")).alias("x")
    texts = cut(found.groupBy("words_key").agg(first).select("words_key", "x.*").withColumn("node", F.monotonically_increasing_id()))
    reps = cut(texts.groupBy("fp").agg(F.min("node").alias("node")))
    families = components(cut(links(reps.select("node", "fp"), radius)))
    classes = reps.join(families, "node", "left").select("fp", F.coalesce("label", "node").alias("family"))
    whole = texts.select("node", "fp").join(classes, "fp").select("node", F.xxhash64(F.lit(-1), "family").alias("key"))
    buckets = cut(texts.select("node", F.posexplode("parts").alias("i", "part")).select("node", F.xxhash64("i", "part").alias("key")).union(whole))
    shared = cut(buckets.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1"))
    met = spread_join(buckets, shared, "key")
    pairs = cut(met.filter("node <> a").select("a", F.col("node").alias("b")).distinct())
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = shingle_sets(docs, cut(texts.join(ids, "node").select("node", "id", "k1", "k2")), width)
    repeats = found.groupBy("id", "k1", "k2").count().filter("count > 1")
    sets = cut(sets if repeats.isEmpty() else sets.dropDuplicates(["node"]))
    sizes = sets.select("node", F.size("hashes").alias("size"))
    edges = cut(star_matches(pairs, sets, sizes, similarity))
    labels = components(edges)
    others = met.filter("n > 2 and node <> a").select("key", "node")
    others = cut(others.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    unlike = unlike_buckets(others, sizes)
    if not unlike.isEmpty():
        labels = components(edges.union(matches(others, unlike, sets, similarity)))
    texts = texts.select("words_key", "id", "k1", "k2", "node").join(labels, "node", "left")
    return found.select("id", "k1", "k2", "words_key"), cut(texts.select("words_key", "id", "k1", "k2", F.coalesce("label", "node").alias("label")))


def keep_one(docs: DataFrame, width: int = 5, radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each near-duplicate class: the one with the smallest id.

    Equal word sequences are one text. Texts at a similarity of 0.8 differ in up to 18 of 64 bits, beyond any
    exact index, and texts that repeat a line agree in all bits whatever else they hold. So fingerprints only
    give candidates: a bucket is the texts of an equal partial fingerprint, or those whose whole fingerprints
    are connected within `radius` bits (the Gray-order index). Shingle sets are compared exactly: each text of a
    bucket with the bucket's first one, then every two of the others that no link has joined yet.

    Rows of equal id are told apart by their texts, so different texts of one id are different documents; among ties
    the smaller hash of the text stays. A null id comes after all others. Rows equal in id and text are one document; if
    their other columns differ, the row with the smallest hash stays. A null text is an empty one. Columns of any other
    names and types are kept as they are. An empty table stays empty.
    """
    rows, texts = representatives(docs, width, radius, similarity)
    best = texts.groupBy("label").agg(F.min(F.struct("id", "words_key", "k1", "k2")).alias("x")).select("x.id", "x.k1", "x.k2")
    counted = cut(rows.groupBy("id", "k1", "k2").agg(F.count("*").alias("n")).join(best.withColumn("stays", F.lit(True)), ["id", "k1", "k2"], "left"))
    keyed = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = keyed.select("_row", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"))
    # one table of what is to be done with rows, in one join: gone, and stays but given more than once
    told = cut(counted.filter("stays is null or n > 1").select("id", "k1", "k2", F.col("stays").isNotNull().alias("twice")))
    marked = keyed.join(small(told, KEYS), ["id", "k1", "k2"], "left")
    left = marked.filter("twice is null").select("_row")
    if not told.filter("twice").isEmpty():
        one = marked.filter("twice").groupBy("id", "k1", "k2").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row")
        left = left.unionByName(one)
    return left.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
