"""Helpers shared by the operators: tables, checkpoints, words, deterministic samples."""

from __future__ import annotations

import ctypes
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import materialise, shared_folder  # noqa: F401

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the session's reliable checkpoint folder and cut its lineage; the loss of any executor does no harm."""
    return materialise(df)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is not needed any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of a table that is broadcast at most: some MB in the driver, however many such tables a plan has.
FEW = 20_000


def small(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df to be broadcast if it is seen to have no more than so many rows; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined with a table of distinct keys, where one key may have a large part of the rows and no task may have them all.

    A small table is broadcast; else its rows are repeated for each salt and rows are dealt to the salts by all their columns.
    """
    if table.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(table), key, how)
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(spread, [key, "_salt"], how).drop("_salt")


def lean(spark: SparkSession, rows: int = 1000) -> None:
    """Small Arrow batches: whole texts travel in them, in the JVM's and the workers' memory beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(run):
    """A mapInArrow body that gives the worker's unused memory back when its task is over, as workers outlive tasks."""

    def body(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return body


def held_out(doc_id: str | Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def hash_sample(rows: DataFrame, stratum: str, per_stratum: int, key: list[str], bits: int = 12, levels: int = 3) -> DataFrame:
    """At most per_stratum rows of each stratum, at least half as many if there are so many: the same rows on every run.

    A row's place is a hash of its key columns. Nested histograms (map-side combined counts by stratum and bucket, then
    of the boundary bucket by the next bits) give each stratum the threshold below which its rows are taken. Rows that share
    the one place on the boundary are equal in their keys; they are taken, up to the bound, only where there is nothing below.
    Only counts reach the driver: strata x 2^bits at a time.
    """
    h, s = F.shiftrightunsigned(F.xxhash64(*key, F.lit("sample")), 64 - bits * levels), F.col(stratum)
    below: dict = {}  # stratum: (hashes below this are taken, how many rows that is)
    refine: dict = {}  # stratum: boundary bucket
    for level in range(levels):
        shift = bits * (levels - 1 - level)
        bucket = F.shiftrightunsigned(h, shift)
        part = rows if not level else rows.filter(_any(s, {x: F.shiftrightunsigned(h, shift + bits) == b for x, b in refine.items()}))
        counts: dict = {}
        for r in part.groupBy(s.alias("s"), bucket.alias("b")).count().collect():
            counts.setdefault(r.s, {})[r.b] = r["count"]
        refine = {}
        for x, by in counts.items():
            taken = below.get(x, (0, 0))[1]
            last = max(by) + 1
            for b in sorted(by):
                if taken + by[b] > per_stratum:
                    last = b
                    if 2 * taken < per_stratum:
                        refine[x] = b
                    break
                taken += by[b]
            below[x] = (last << shift, taken)
        if not refine:
            break
    chosen = rows.filter(_any(s, {x: h < F.lit(t) for x, (t, _) in below.items()}))
    for x, b in refine.items():
        if not below[x][1]:
            chosen = chosen.unionByName(rows.filter(s.eqNullSafe(F.lit(x)) & (h == F.lit(b))).limit(per_stratum))
    return chosen


def _any(stratum: Column, conditions: dict) -> Column:
    """Whether the condition of a row's stratum holds."""
    out = F.lit(False)
    for x, c in conditions.items():
        out = out | (stratum.eqNullSafe(F.lit(x)) & c)
    return out


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies. QUARRY_TOKENIZERS names another folder."""
    folder = os.environ.get("QUARRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
