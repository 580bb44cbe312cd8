"""The changefeed as a stream: an append-only log of changes, the latest of each key kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Of each key the change with the greatest seq; combined before the shuffle."""
    return changes.groupBy(*keys).agg(F.max_by(F.struct("*"), seq).alias("_row")).select("_row.*")


def poll(log: DataFrame, since: int, limit: int, keys: list[str], seq: str = "seq") -> DataFrame:
    """The latest state of keys that changed after since, oldest first. Reading again after a failure repeats rows, never loses any."""
    return latest(log.filter(F.col(seq) > since), keys, seq).orderBy(seq).limit(limit)


def latest_stream(changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """A streaming aggregation that holds one row for each key."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*")


def keep_table(changes: DataFrame, path: str, checkpoint: str, keys: list[str], seq: str = "seq") -> StreamingQuery:
    """Runs the stream to the end of what is there, folding each batch into a table of versions under path.

    Each batch writes <path>/v=<batch> from the version before it and itself, so a batch that is run again
    after a failure gives the same version.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, seq)
        if batch_id > 0:
            old = spark.read.parquet(f"{path}/v={batch_id - 1}")
            new = latest(old.unionByName(new), keys, seq)
        new.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a table that keep_table() keeps."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder(path))]
    versions = [int(n.removeprefix("v=")) for n in names if n.startswith("v=") and fs.exists(folder(f"{path}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/v={max(versions)}")


def due_sites(crawls: DataFrame, interval: str = "24 hours") -> DataFrame:
    """Streaming state of re-crawls: (site, last) from a stream of (site, crawled_at); late crawls only raise the maximum."""
    return crawls.groupBy("site").agg(F.max("crawled_at").alias("last")).withColumn("due", F.col("last") + F.expr(f"interval {interval}"))


def numbered(batch: DataFrame, start: int, order: list[str]) -> DataFrame:
    """A micro-batch's rows with numbers after start. One task numbers it: batches are bounded by the trigger's limits."""
    return batch.withColumn("seq", F.row_number().over(Window.orderBy(*order)) + F.lit(start))
