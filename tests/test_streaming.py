"""Streams: the feed of a stored site, polite requests, re-crawls by timers."""

import time
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from quarry.sources.tables import SCHEMAS, Store, bucket_of
from quarry.streaming import feed, polite

SITE = "s.example"


def put(spark, store, pages, products, seq):
    """The site's pages (url, seq) and products (url, name, seq)."""
    at = datetime(2024, 1, 1)
    p = spark.createDataFrame([(SITE, u, f"t{s}", "", "", "h", at, "", "", s) for u, s in pages], SCHEMAS["pages"]).withColumn("bucket", bucket_of("url"))
    q = spark.createDataFrame([(SITE, u, n, "", 1.0, "USD", "in_stock", "", "json-ld", "", None, s) for u, n, s in products], SCHEMAS["products"]).withColumn("bucket", bucket_of("page_url"))
    store.commit(store.snapshot(SITE), {"pages": p.repartition("bucket"), "products": q.repartition("bucket")}, list(range(32)), seq)


def test_feed_resumes_without_loss(spark, tmp_path):
    feed.register(spark)
    store = Store(spark, str(tmp_path / "store"))
    read = lambda **o: spark.readStream.format("quarry_feed").options(root=str(tmp_path / "store"), site=SITE, **o).load()
    run = lambda: read(rows=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    told = lambda: sorted((r.seq, r.url, r.type, r.title) for r in spark.read.schema(read().schema).parquet(str(tmp_path / "out")).collect())
    put(spark, store, [("a", 1), ("b", 2), ("c", 3)], [("b", "Bee", 4)], 4)
    run()
    first = [(1, "a", "page", "t1"), (3, "c", "page", "t3"), (4, "b", "product", "Bee")]
    assert told() == first
    run()  # nothing new
    put(spark, store, [("a", 5), ("b", 2), ("c", 3), ("d", 6)], [("b", "Bee 2", 7), ("c", "", 8)], 8)
    run()
    assert told() == first + [(5, "a", "page", "t5"), (6, "d", "page", "t6"), (7, "b", "product", "Bee 2"), (8, "c", "product", "t3")]
    reader = feed.FeedReader({"root": str(tmp_path / "store"), "site": SITE, "changes": "3"})
    assert reader.initialOffset() == {"seq": 0} and [reader.latestOffset()["seq"] for _ in range(4)] == [3, 6, 8, 8]
    assert feed.FeedReader({"root": str(tmp_path / "store"), "site": "none"}).latestOffset() == {"seq": 0}


def batches(spark, tmp_path, rows, ddl):
    """A stream of a micro-batch for each list of rows."""
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i + 1 < len(rows):
            time.sleep(1.1)  # files are taken in the order of their times
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def finish(spark, stream, tmp_path):
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_hosts_remember_over_batches(spark, tmp_path):
    stream = batches(spark, tmp_path, [[("h", "a", 0.0, 2.0), ("h", "b", 0.5, 2.0), ("k", "x", 0.0, 1.0)], [("h", "c", 1.0, 2.0), ("h", "d", 99.0, 2.0)]], "host string, url string, at double, interval double")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        got = finish(spark, polite.paced(stream), tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted((r.host, r.url, r.due) for r in got) == [("h", "a", 0.0), ("h", "b", 2.0), ("h", "c", 4.0), ("h", "d", 99.0), ("k", "x", 0.0)]


def test_held_requests_come_by_timer(spark, tmp_path):
    now = time.time()
    stream = batches(spark, tmp_path, [[("h", u, now, 1.0) for u in "abc"]], "host string, url string, at double, interval double")
    q = polite.paced(stream, hold=True).withColumn("seen", F.current_timestamp()).writeStream.format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 60
        while spark.table("held").count() < 3 and time.time() < until:
            time.sleep(0.5)
        got = spark.table("held").collect()
    finally:
        q.stop()
    assert sorted((r.url, round(r.due - now)) for r in got) == [("a", 0), ("b", 1), ("c", 2)]
    assert all(r.seen.timestamp() >= r.due - 1e-3 for r in got)


def test_sites_fall_due_by_timer(spark, tmp_path):
    t = lambda h: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=h)
    stream = batches(spark, tmp_path, [[("a", t(0)), ("b", t(1)), ("b", t(30))], [("c", t(40))], [("b", t(50)), ("c", t(63))]], "site string, crawled_at timestamp")
    got = finish(spark, polite.due_stream(stream, timedelta(hours=24)), tmp_path)
    hours = lambda x: round((x.replace(tzinfo=UTC) - t(0)).total_seconds() / 3600)
    assert sorted((r.site, hours(r["last"]), hours(r.due)) for r in got) == [("a", 0, 24), ("b", 1, 25)]
