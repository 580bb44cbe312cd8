"""Stored tables: versioned Parquet folders of each site, bucketed by page, and cut points in a plan."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry import schema

SCHEMAS: dict[str, str] = {
    "pages": schema.PAGES, "chunks": schema.CHUNKS, "products": schema.PRODUCTS, "verified": schema.PRODUCTS, "state": schema.STATE, "counts": schema.COUNTS, "postings": schema.POSTINGS, "product_postings": schema.PRODUCT_POSTINGS,
    "stats": schema.STATS, "product_stats": schema.STATS, "lexicon": schema.LEXICON, "product_lexicon": schema.LEXICON, "bounds": schema.BOUNDS, "product_bounds": schema.BOUNDS,
}
#: Tables are cut into so many buckets by a hash of the page's address.
BUCKETS = 32
#: Tables that a commit writes at a time.
WRITES = 4


@lru_cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="quarry-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


def materialise(df: DataFrame) -> DataFrame:
    """df computed once, in the session's reliable checkpoint folder, which survives the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def compact(df: DataFrame) -> tuple[DataFrame, str]:
    """df computed once, as compressed columns in the shared folder, and that folder: for whole texts and postings, of which a
    checkpoint's plain rows take several times the room. discard() it when the table is no longer read."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that are not read any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Makes tables of those that a commit has written.
Then = Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]]


class Conflict(RuntimeError):
    """Another writer has committed since the snapshot was taken."""


def bucket_of(url: Column | str) -> Column:
    """The bucket of a page: the leading bits of a hash of its address, so that blocks of postings lie within buckets."""
    return F.shiftrightunsigned(F.xxhash64(url), 64 - (BUCKETS.bit_length() - 1)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """What a site's manifest says: which version of each bucket of each table counts, and the site's last sequence number."""

    store: Store
    site: str
    name: str = ""  # of the newest manifest, whether or not it can be read; "" before the first
    versions: dict[str, dict[str, str]] = field(default_factory=dict)
    seq: int = 0

    def paths(self, table: str, buckets: list[int] | None = None) -> list[str]:
        wanted = None if buckets is None else set(map(str, buckets))
        return [f"{self.store.folder(self.site)}/tables/{v}/{table}/bucket={b}" for b, v in sorted(self.versions.get(table, {}).items()) if wanted is None or b in wanted]

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        return self.store.load(table, self.paths(table, buckets))


class Store:
    """Tables of each site under <root>/<site>/tables/<version>/<table>/bucket=<b>; the newest manifest says which versions count.

    A write puts the touched buckets of the changed tables into a new version and commits a manifest, so readers see all of a write
    or none, a failed write leaves the old state, an upsert of a few pages rewrites a few buckets, and no write touches another
    site. Manifests are numbered. A commit creates the number after its snapshot's, and fails if another writer has taken it
    (Conflict): no update is lost. That is as safe as the file system's exclusive create.
    Versions that no kept manifest names are removed once they are `retain` seconds old, which readers may take.
    """

    def __init__(self, spark: SparkSession, root: str, retain: float = 3600) -> None:
        self.spark, self.root, self.retain = spark, root.rstrip("/"), retain
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def folder(self, site: str) -> str:
        return f"{self.root}/{quote(site, safe='')}"

    def _manifests(self, site: str) -> list[str]:
        return [n for n in self._names(f"{self.folder(site)}/manifests") if n.endswith(".json")]

    def _manifest(self, site: str, name: str) -> dict | None:
        """The manifest's content; None if its writer has not finished it."""
        stream = self._fs.open(self._path(f"{self.folder(site)}/manifests/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def has(self, site: str) -> bool:
        return bool(self._manifests(site))

    def sites(self) -> list[str]:
        """Sites with tables, in order of their names."""
        return sorted(site for site in map(unquote, self._names(self.root)) if self.has(site))

    def snapshot(self, site: str) -> Snapshot:
        names = self._manifests(site)
        for name in reversed(names):
            if (found := self._manifest(site, name)) is not None:
                return Snapshot(self, site, names[-1], found["versions"], found["seq"])
        return Snapshot(self, site, names[-1] if names else "")

    def load(self, table: str, paths: list[str]) -> DataFrame:
        """A table from its folders, empty without one; columns added since are null."""
        wanted = StructType.fromDDL(SCHEMAS[table])
        return self.spark.read.schema(wanted).parquet(*paths) if paths else self.spark.createDataFrame([], wanted)

    def read(self, table: str, site: str | None = None) -> DataFrame:
        """A table of one site or of all. Shares of buckets (lexicon, stats, counts) come as they are stored."""
        return self.load(table, [p for s in ([site] if site is not None else self.sites()) for p in self.snapshot(s).paths(table)])

    def commit(self, snap: Snapshot, tables: dict[str, DataFrame], buckets: dict[str, list[int]] | list[int], seq: int | None = None, then: Then | None = None) -> str:
        """Writes tables, whose rows (with a column bucket) are all there is of the given buckets, as the site's next state; its manifest's name.

        then makes further tables of those that have just been written: it gets a function that reads one of them, with its buckets.
        """
        version, folder = f"{time.time_ns():020d}", self.folder(snap.site)
        versions = {t: dict(v) for t, v in snap.versions.items()}

        def write(table: str) -> None:
            columns = StructType.fromDDL(SCHEMAS[table]).fieldNames()
            tables[table].select(*columns, "bucket").write.partitionBy("bucket").parquet(f"{folder}/tables/{version}/{table}")

        def written(table: str) -> DataFrame:
            wanted, path = StructType.fromDDL(f"{SCHEMAS[table]}, bucket int"), f"{folder}/tables/{version}/{table}"
            return self.spark.read.schema(wanted).parquet(path) if any(n.startswith("bucket=") for n in self._names(path)) else self.spark.createDataFrame([], wanted)

        with ThreadPoolExecutor(WRITES) as pool:  # jobs of a site's tables run side by side
            list(pool.map(write, tables))
            if then is not None:
                more = then(written)
                tables = tables | more
                list(pool.map(write, more))
        for table in tables:
            there = set(self._names(f"{folder}/tables/{version}/{table}"))
            own = versions.setdefault(table, {})
            for b in buckets if isinstance(buckets, list) else buckets[table]:
                own.pop(str(b), None)
                if f"bucket={b}" in there:
                    own[str(b)] = version
        number = int(snap.name.removesuffix(".json") or 0) + 1
        name = f"{number:020d}.json"
        self._create(f"{folder}/manifests/{name}", json.dumps({"versions": versions, "seq": snap.seq if seq is None else seq}).encode())
        self._clean(snap.site)
        return name

    def _create(self, path: str, data: bytes) -> None:
        """A new file; Conflict if there is one."""
        if any(n >= path.rsplit("/", 1)[1] for n in self._names(path.rsplit("/", 1)[0])):
            raise Conflict(path)
        try:
            out = self._fs.create(self._path(path), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or self._fs.exists(self._path(path)):
                raise Conflict(path) from e
            raise
        out.write(bytearray(data))
        out.close()

    def _clean(self, site: str, keep: int = 2) -> None:
        """Removes what only old manifests name, and those manifests, if it was written long enough ago."""
        folder, names = self.folder(site), self._manifests(site)
        used = {v for n in names[-keep:] for own in ((self._manifest(site, n) or {}).get("versions") or {}).values() for v in own.values()}
        due = f"{time.time_ns() - int(self.retain * 1e9):020d}"
        old = [v for v in self._names(f"{folder}/tables") if v not in used and v < due]
        for version in old:
            self._fs.delete(self._path(f"{folder}/tables/{version}"), True)
        for name in names[:-keep]:
            if self._fs.getFileStatus(self._path(f"{folder}/manifests/{name}")).getModificationTime() < time.time() * 1000 - self.retain * 1000:
                self._fs.delete(self._path(f"{folder}/manifests/{name}"), False)
