"""Token counts (operator 6): a separator scan over flat token files.

A token file is nothing but ids of a fixed width, each document ended by an end-of-document id; there is no
index. Files are read in blocks of a bounded size: in each, one vectorised comparison finds the separators, and with
them where each document of the block starts and ends. A prefix scan over the blocks' small summaries (lengths, numbers of
separators, last separators) stitches documents that cross boundaries, so no block waits for another and no
document is ever gathered. Memory is one block, whatever the file's or a document's length.

Files are written by Spark's text sink, each document a line of raw ids and the line's end the end-of-document id. That id
must therefore be valid UTF-8: ids are big-endian 16-bit numbers and the end is 0xC480, an id that the vocabulary leaves
free. Which document is which in a file (file, ordinal, doc_id) is a table of its own that the scan doesn't use.

Nulls: a null text is an empty document of 0 tokens. Repeated rows, equal and null ids are counted like others, in the
table's order, so there are no ties. Texts of any length, and columns of any other names, do no harm. An empty table or
file gives no rows; a file that doesn't end in a separator has one last, unclosed document.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, remove, shared_folder, small, tidy, tokenizer_path

END = 0xC480
BLOCK = 1 << 20
KIND = ">u2"
#: Files up to so many bytes are read whole, by Spark; byte ranges are read of larger ones.
WHOLE = 1 << 28

_loaded: dict = {}


def encoder(name: str = "byte_bpe_50k.tiktoken"):
    """The worker's own encoder of the public byte-level vocabulary; special strings are ordinary text."""
    if name not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[name]


def write_token_files(docs: DataFrame, path: str) -> DataFrame:
    """Writes docs as flat token files under path, one for each partition; returns (file, ordinal, doc_id).

    docs should be a scan or a checkpoint, whose partitions and their order stay the same when they are read again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.array(encode(x.as_py()), dtype=KIND).tobytes() for x in b.column(0)], pa.binary())], ["data"])

    encoded = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(tidy(run), "data binary")
    encoded.select(F.col("data").cast("string").alias("value")).write.option("lineSep", END.to_bytes(2, "big").decode()).text(path)
    place = F.monotonically_increasing_id()
    return cut(docs.select(F.shiftright(place, 33).cast("int").alias("file"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal"), F.col("doc_id").cast("long").alias("doc_id")))


def read_token_files(spark: SparkSession, path: str, kind: str = KIND, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """(file, block, data): blocks of the flat binary files under path.

    Files above `whole` bytes are read by byte ranges, each range by the task that scans it; their path must then be one that
    pyarrow's file systems open (local, hdfs, s3, gs).
    """
    size = block * np.dtype(kind).itemsize
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0")
    number = F.expr(f"sequence(0L, (length - 1) div {size})")
    cuts = F.transform(number, lambda i: F.struct(i.alias("block"), F.substring(F.col("content"), (i * size + 1).cast("int"), F.lit(size)).alias("data")))
    short = files.filter(F.col("length") <= whole).select(F.col("path").alias("file"), F.explode(cuts).alias("x")).select("file", "x.block", "x.data")
    large = files.filter(F.col("length") > whole).select(F.col("path").alias("file"), F.explode(number).alias("block"))
    if large.isEmpty():
        return short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for i in range(b.num_rows):
                store, name = fs.FileSystem.from_uri(b.column(0)[i].as_py())
                with store.open_input_file(name) as f:
                    f.seek(b.column(1)[i].as_py() * size)
                    data = f.read(size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([data], pa.binary())], ["file", "block", "data"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return short.unionByName(large.repartition(parts, "file", "block").mapInArrow(tidy(run), "file string, block long, data binary"))


def scan(blocks: DataFrame, end: int = END, kind: str = KIND) -> DataFrame:
    """Each block's summary: its length, separators, the last one's place, and the documents (k, start, stop) that end in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = np.frombuffer(b.column(2)[i].as_buffer(), dtype=kind)
                at = np.flatnonzero(t == end)
                ended = [pa.array(np.arange(len(at))), pa.array(np.concatenate([[0], at[:-1] + 1])[: len(at)].astype(np.int64)), pa.array(at)]
                ended = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.StructArray.from_arrays(ended, ["k", "start", "stop"]))
                told = [pa.array([v], pa.int64()) for v in (len(t), len(at), int(at[-1]) if len(at) else None)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *told, ended], ["file", "block", "length", "separators", "last", "ended"])

    rows = blocks.select("file", "block", "data")
    file = rows.schema["file"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"file {file}, block long, length long, separators long, last long, ended array<struct<k:long,start:long,stop:long>>")


def token_counts(blocks: DataFrame, end: int = END, kind: str = KIND) -> DataFrame:
    """A row for each document of the files: file, ordinal, start, n_tokens (without the separator), closed. The files are read here, once."""
    found = cut(scan(blocks, end, kind))
    order = Window.partitionBy("file").orderBy("block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    s = found.select("file", "block", "length", "separators", "last")
    s = s.withColumn("before", F.coalesce(F.sum("length").over(past), F.lit(0))).withColumn("nth", F.coalesce(F.sum("separators").over(past), F.lit(0)))
    s = s.withColumn("open", F.col("before") + F.col("last") + 1)
    s = s.withColumn("opened", F.coalesce(F.last("open", ignorenulls=True).over(past), F.lit(0)))  # where the document at the block's start began
    s = cut(s.withColumn("final", F.lead("block").over(order).isNull()))
    rows = found.select("file", "block", "ended").join(small(s.select("file", "block", "before", "nth", "opened")), ["file", "block"])
    rows = rows.select("file", "before", "nth", "opened", F.explode("ended").alias("x"))
    start = F.when(F.col("x.k") == 0, F.col("opened")).otherwise(F.col("before") + F.col("x.start"))
    closed = rows.select("file", (F.col("nth") + F.col("x.k")).alias("ordinal"), start.alias("start"), (F.col("before") + F.col("x.stop") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    begun, stop = F.coalesce("open", "opened"), F.col("before") + F.col("length")
    rest = s.filter("final").filter(stop > begun)
    return closed.unionByName(rest.select("file", (F.col("nth") + F.col("separators")).alias("ordinal"), begun.alias("start"), (stop - begun).alias("n_tokens"), F.lit(False).alias("closed")))


def count_documents(docs: DataFrame) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens of each row of docs, by way of token files in the session's shared folder."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    names = write_token_files(docs, path)
    found = token_counts(read_token_files(spark, path))
    remove(spark, path)
    number = F.regexp_extract(F.col("file"), r"part-([0-9]+)-[^/]*$", 1).cast("int")
    found = found.select(number.alias("file"), "ordinal", "start", "n_tokens")
    ends = found.groupBy("file").agg(F.count("*").alias("n")).join(names.groupBy("file").agg(F.count("*").alias("m")), "file", "full")
    if not ends.filter(~F.col("n").eqNullSafe(F.col("m"))).isEmpty():
        raise RuntimeError("the documents' partitions changed between two reads: checkpoint them first")
    return found.join(names, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
