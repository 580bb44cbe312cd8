"""Text to chunks: heading sections, then fixed windows cut at white space, in one Arrow function."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space is ASCII's; a line ends at a line feed only, but a heading's text ends at other line terminators too.
SPACE = " \t\n\x0b\f\r"
HEADING = re.compile("(#{1,6})[ \t\n\x0b\f\r]+([^\n\r\x85\u2028\u2029]*)(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z")
LOOK_BACK = 50
#: Texts that reach a worker at once.
BATCH = 1000


def sections(text: str) -> Iterator[tuple[str, str]]:
    """(heading path, body) of each heading's own text that is not blank.

    A heading sets its level and clears the deeper ones; lines before the first heading have an empty path.
    """
    path, body = [""] * 6, []
    for line in text.split("\n"):
        found = HEADING.match(line) if line.startswith("#") else None
        if found is None:
            body.append(line)
            continue
        if (own := "\n".join(body)).strip(SPACE):
            yield " > ".join(filter(None, path)), own
        level = len(found[1])
        path, body = [*path[: level - 1], found[2].strip(" "), *[""] * (6 - level)], []
    if (own := "\n".join(body)).strip(SPACE):
        yield " > ".join(filter(None, path)), own


def _plan(target: int, overlap: int) -> tuple[int, int]:
    """Length of a window and the step between two."""
    target = 1200 if target <= 0 else target
    return target, target - (overlap if 0 <= overlap < target else 0)


def windows(text: str, target: int, step: int) -> Iterator[str]:
    """The windows of a text that are not blank, trimmed: they start every step code points, wherever the one before was cut, and end at the
    last white space among their final 50 code points, if any. Each is cut once, so a text takes time in proportion to its length."""
    text = text.strip(SPACE)
    n = len(text)
    for start in range(0, max(n - target + step - 1, 0) // step * step + 1 if n > target else 1, step):
        end = cut = min(start + target, n)
        if end < n:
            first = max(end - LOOK_BACK + 1, 1)  # the look-back's first place
            last = max(text.rfind(c, first, end + 1) for c in SPACE)
            cut = last if last >= 0 else end
        if own := text[start:cut].strip(SPACE):
            yield own


def _chunks(c: Column, target: int, overlap: int, by_heading: bool) -> Column:
    """A text's chunks in order, as an array of (heading_path, text)."""
    target, step = _plan(target, overlap)

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            at, paths, found = [0], [], []
            for t in texts.to_pylist():
                for path, body in () if t is None else sections(t) if by_heading else (("", t),):
                    own = list(windows(body, target, step))
                    found += own
                    paths += [path] * len(own)
                at.append(len(found))
            pair = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.string())], ["heading_path", "text"])
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), pair)

    return F.arrow_udf(cut, "array<struct<heading_path:string,text:string>>", F.ArrowUDFType.SCALAR_ITER)(c)


def _chunked(df: DataFrame, keys: list[str], text: str, target: int, overlap: int, by_heading: bool) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    rows = df.select(*keys, _chunks(F.col(text), target, overlap, by_heading).alias("_c"))
    return rows.select(*keys, F.posexplode("_c").alias("ord", "_p")).select(*keys, "ord", "_p.heading_path", "_p.text")


def chunk_pages(df: DataFrame, keys: list[str], markdown: str = "markdown", target: int = 1200, overlap: int = 100) -> DataFrame:
    """keys, ord (from 0), heading_path, text of every non-blank chunk of each document. A document's chunks are numbered where it is, so
    nothing is shuffled. Below an overlap of 50 a cut at white space loses text."""
    return _chunked(df, keys, markdown, target, overlap, True)


def chunk_texts(df: DataFrame, keys: list[str], text: str = "text", target: int = 1200, overlap: int = 100) -> DataFrame:
    """chunk_pages for texts without headings."""
    return _chunked(df, keys, text, target, overlap, False)
