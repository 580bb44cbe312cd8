"""The changefeed of a stored site as a streaming source: spark.readStream.format("quarry_feed").

Options: root and site, of the store; since, where a new stream starts (0: all); rows, changes that a task reads, about
(10,000); changes, sequence numbers that a batch covers at most (0: up to the newest).

An offset is a sequence number. A batch covers what was committed up to a manifest: each task reads one bucket of pages and products, which
lie in the same bucket by their address, and a slice of the numbers. A row is the state of a page or product whose last change
falls into the slice. What changes again before it is read comes with its later number, so a stream that stops and resumes loses no
change and repeats none. A stream that resumes takes all that is new in its first batch, cut into bounded tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quarry import schema

PAGE = ("url", "title", "hash", "crawled_at", "etag", "seq")
PRODUCT = ("page_url", "name", "price", "currency", "availability", "extraction_method", "verified_at", "seq")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_feed"

    def schema(self) -> str:
        return schema.ITEM

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(self.options)


@dataclass
class Slice(InputPartition):
    """The changes of a bucket with numbers after low, up to high."""

    low: int
    high: int
    pages: tuple[str, ...]
    products: tuple[str, ...]


class FeedReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.root, self.site = options["root"].rstrip("/"), options["site"]
        self.since, self.rows, self.changes = int(options.get("since", 0)), int(options.get("rows", 10_000)), int(options.get("changes", 0))
        self.last: int | None = None

    def _manifest(self) -> dict:
        """The newest manifest that can be read."""
        store, base = fs.FileSystem.from_uri(f"{self.root}/{quote(self.site, safe='')}/manifests")
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        for name in sorted((f.path for f in found if f.path.endswith(".json")), reverse=True):
            with store.open_input_file(name) as f:
                try:
                    return json.loads(f.read())
                except ValueError:
                    continue
        return {"versions": {}, "seq": 0}

    def initialOffset(self) -> dict:
        self.last = self.since
        return {"seq": self.since}

    def latestOffset(self) -> dict:
        newest = max(self._manifest()["seq"], self.last or 0)
        if self.changes and self.last is not None:
            newest = min(newest, self.last + self.changes)
        self.last = newest
        return {"seq": newest}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        low, high = start["seq"], end["seq"]
        self.last = max(self.last or 0, high)
        versions = self._manifest()["versions"]
        folder = f"{self.root}/{quote(self.site, safe='')}/tables"
        of = lambda t, b: (f"{folder}/{versions[t][b]}/{t}/bucket={b}",) if b in versions.get(t, {}) else ()
        buckets = sorted(versions.get("pages", {}))
        step = self.rows * max(1, len(buckets))  # numbers are spread evenly over the buckets
        return [Slice(at, min(at + step, high), of("pages", b), of("products", b) + of("verified", b)) for b in buckets for at in range(low, high, step)]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        low, high = partition.low, partition.high
        # a row's number is its page's or its product's: one of the two lies in the slice
        fresh = (pc.field("seq") > low) & (pc.field("seq") <= high)
        changed = set(_rows(partition.pages, ("url",), fresh).column(0).to_pylist())
        changed |= set(_rows(partition.products, ("page_url",), fresh).column(0).to_pylist())
        if not changed:
            return
        own = pa.array(sorted(changed), pa.string())
        products: dict[str, dict] = {}
        for r in _rows(partition.products, PRODUCT, pc.field("page_url").isin(own)).to_pylist():
            if r["page_url"] not in products or products[r["page_url"]]["seq"] < r["seq"]:
                products[r["page_url"]] = r
        out = []
        for p in _rows(partition.pages, PAGE, pc.field("url").isin(own)).to_pylist():
            q = products.get(p["url"])
            seq = max(p["seq"], q["seq"] if q else 0)
            if low < seq <= high:
                sold = {c: q[c] if q else None for c in PRODUCT[2:-1]}
                out.append({**p, "seq": seq, "type": "product" if q else "page", "title": q["name"] if q and q["name"] else p["title"], **sold})
        out.sort(key=lambda r: (r["seq"], r["url"]))
        if out:
            yield pa.Table.from_pylist(out, schema=ITEM).combine_chunks().to_batches()[0]


KINDS = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}
ITEM = pa.schema([(name, KINDS[kind]) for name, kind in (f.split() for f in schema.ITEM.split(", "))])


def _rows(folders: tuple[str, ...], columns: tuple[str, ...], wanted: pc.Expression) -> pa.Table:
    """The wanted rows of Parquet folders; the filter reaches their row groups."""
    found = []
    for folder in folders:
        store, base = fs.FileSystem.from_uri(folder)
        found.append(ds.dataset(base, filesystem=store, format="parquet").to_table(columns=list(columns), filter=wanted))
    return pa.concat_tables(found, promote_options="permissive") if found else pa.table({c: pa.array([], pa.string()) for c in columns})
