"""Document fingerprints (operator 4): a canonical exact digest.

A text is normalised (NFKC), case-folded and its white-space runs become one space; the digest is the
128-bit XXH3 of its UTF-8 bytes. Rows are grouped by digest. Equal digests are trusted only after the canonical bytes
are compared: texts are read again for digests met twice alone, each task keeps one copy of equal bytes, and what is
left is grouped by digest and bytes. So a text's class is exact, and a hot group is one row a task in the shuffle. The
likeness of two texts is 1 if they are of one class and 0 if not.

For edits, rows are dealt into ranges of doc_id. The first row of each range is also sent to the range
before it, so every row meets its successor in one task and texts move once, compressed. There digests, and bytes where
those are equal, tell whether the two, or a text and its edited text, are of one class.

Nulls: a null text is empty. Rows with a null id come last in the order; rows of equal id (ties) have a
fixed order given by their texts; repeated rows come back each. The rows of one id lie in one range, so ids should
be near unique. Lone rows are their own successor. Texts of any length are taken whole. Columns of any other names do no
harm. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, small, tidy

NO_ID = -(2**63)


def canonical(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def likeness(a: bytes, b: bytes) -> float:
    """Of two canonical texts: digests first, bytes where those are equal."""
    return float(digest(a) == digest(b) and a == b)


def second(data: bytes) -> int:
    """Tells texts that share a digest apart where their bytes are not at hand."""
    return xxhash.xxh64_intdigest(data, 1) - 2**63


def canonical_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, also, canon) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            canon = [canonical(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(digest, canon), pa.string()), pa.array(map(second, canon), pa.int64()), pa.array(canon, pa.binary())], ["doc_id", "fingerprint", "also", "canon"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fingerprint string, also long, canon binary")


def shared_classes(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """(of, also, class_id, copies) of the canonical texts whose digest two rows have; digests: doc_id, fingerprint of all rows."""
    twice = cut(digests.groupBy("fingerprint").count().filter("count > 1").select(F.col("fingerprint").alias("of")))
    in_twice = F.col("fingerprint") == F.col("of")
    ids = digests.join(small(twice, 300_000), in_twice, "left_semi").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).distinct()
    some = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "doc_id", "text").join(small(cut(ids), 300_000), "id", "left_semi")
    # bytes are compared here; rows that came along by their ids alone go again
    grouped = canonical_digests(some).groupBy("fingerprint", "also", "canon").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    found = cut(grouped.join(small(twice, 300_000), in_twice, "left_semi").select(F.col("fingerprint").alias("of"), "also", "class_id", "copies"))
    if not found.groupBy("of", "also").count().filter("count > 1").isEmpty():
        raise ValueError("different texts share both their digests")
    return found


def _joined(rows: DataFrame, classes: DataFrame, salts: int = 16, most: int = 300_000) -> DataFrame:
    """rows (fingerprint, also, doc_id, ...) with class_id and copies."""
    named = classes.select("of", F.col("also").alias("too"), F.col("class_id").alias("first"), F.col("copies").alias("n"))
    equal = (F.col("fingerprint") == F.col("of")) & (F.col("also") == F.col("too"))
    if named.limit(most + 1).count() <= most:
        found = rows.join(F.broadcast(named), equal, "left")
    else:  # a class may hold a third of all rows
        spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = rows.join(spread, equal & (F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int") == F.col("salt")), "left")
    return found.select(*rows.columns, F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("class_id"), F.coalesce("n", F.lit(1)).alias("copies"))


def exact_classes(docs: DataFrame) -> DataFrame:
    """One row for each distinct canonical text: fingerprint, class_id (smallest doc_id), copies."""
    digests = cut(canonical_digests(docs).select("doc_id", "fingerprint", "also"))
    found = _joined(digests, shared_classes(docs, digests))
    return found.select("fingerprint", "also", "class_id", "copies").distinct().drop("also")


def classified(docs: DataFrame) -> DataFrame:
    """edited(), with class_id (smallest doc_id of the row's canonical text) and copies (rows that have it)."""
    rows = cut(edited(docs))
    return _joined(rows, shared_classes(docs, rows.select("doc_id", "fingerprint"))).drop("also")


def _bounds(ids: DataFrame, rows: int, per_range: int, most: int) -> list[int]:
    """Ids (of the table) that open each range, largest first; the largest id opens the first."""
    n = min(most, -(-rows // per_range))
    got = ids.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n)).alias("cuts")).first()
    return sorted({got.top, *(got.cuts if n > 1 else [])}, reverse=True)


def edited(docs: DataFrame, per_range: int = 1000, most_ranges: int = 65_536) -> DataFrame:
    """Fingerprints of each text and of its edited text (see the contract of op4), and their likenesses."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = keyed.count()
    if not rows:
        bounds = [0]
    else:
        bounds = _bounds(keyed.select("doc_id"), rows, per_range, most_ranges)
    opens = np.array(bounds[::-1], dtype=np.int64)  # ascending
    ranges = len(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            ids = b.column(0).to_numpy()
            # range r holds the ids above the opening of range r + 1, up to its own
            at = ranges - 1 - np.minimum(np.searchsorted(opens, ids, side="left"), ranges - 1)
            texts = [squeeze(x.as_py().encode("utf-8", "surrogatepass")) for x in b.column(1)]
            first = np.flatnonzero(opens[ranges - 1 - at] == ids)
            take = np.concatenate([np.arange(len(ids)), first])
            where = np.concatenate([at, (at[first] - 1) % ranges])
            halo = np.concatenate([np.zeros(len(ids), dtype=bool), np.ones(len(first), dtype=bool)])
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(halo), pa.array(ids[take]), pa.array([texts[i] for i in take], pa.binary())], ["at", "halo", "doc_id", "packed"])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "also"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        held: tuple | None = None  # range, id, text, canonical text

        def row(text: str, mine: bytes, following: str, theirs: bytes, doc_id: int) -> tuple:
            half = len(text) // 2
            other = text[: len(text) - half] + following[:half]
            changed = canonical(other)
            sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
            return (None if doc_id == NO_ID else doc_id, len(text), sha, digest(mine), digest(changed), likeness(mine, changed), likeness(mine, theirs), second(mine))

        for b in batches:
            out: list[tuple] = []
            for at, halo, doc_id, packed in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                if halo and (held is None or held[0] != at):
                    continue
                text = expand(packed.as_py()).decode("utf-8", "surrogatepass")
                mine = canonical(text)
                if held is not None and held[0] == at:
                    out.append(row(held[2], held[3], text, mine, held[1]))
                held = None if halo else (at, doc_id, text, mine)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names)

    dealt = keyed.mapInArrow(tidy(deal), "at int, halo boolean, doc_id long, packed binary")
    parts = max(ranges, 1)
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(min(parts, max(shuffles, parts // 64)), "at").sortWithinPartitions("at", "halo", F.col("doc_id").desc(), "packed")
    return ordered.mapInArrow(tidy(edit), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, also long")
