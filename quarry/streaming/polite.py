"""Politeness and re-crawls as keyed state: what a host or a site has to remember between batches, with timeouts as timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A host that nothing was asked of for so long is forgotten.
FORGET = timedelta(days=2)
PACED = "host string, url string, due double"
DUE = "site string, last timestamp, due timestamp"


def _utc(ms: float) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC)


def paced(requests: DataFrame, hold: bool = False, forget: timedelta = FORGET) -> DataFrame:
    """host, url, due of a stream of requests (host, url, at, interval; seconds): the first at once, each later one not
    before its own time nor its interval after the host's last one, over all batches.

    A host's state is when it may next be asked. With hold, requests wait there too and are given out only when they are due, by
    a timer. A host without requests is forgotten after a while.
    """
    rest = max(1, int(forget.total_seconds() * 1000))

    def pace(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free, urls, dues = state.get if state.exists else (float("-inf"), [], [])
        urls, dues = list(urls), list(dues)
        if not state.hasTimedOut:
            asked = pd.concat(list(rows)).sort_values(["at", "url"], kind="stable")
            for url, at, interval in zip(asked["url"], asked["at"], asked["interval"], strict=True):
                urls.append(url)
                dues.append(max(at, free))
                free = dues[-1] + interval
        now = state.getCurrentProcessingTimeMs() / 1000
        ready = [i for i, d in enumerate(dues) if not hold or d <= now]
        left = [i for i in range(len(dues)) if i not in set(ready)]
        if state.hasTimedOut and not ready and not left:
            state.remove()
        else:
            state.update((free, [urls[i] for i in left], [dues[i] for i in left]))
            state.setTimeoutDuration(max(1, int((min(dues[i] for i in left) - now) * 1000)) if left else rest)
        if ready:
            yield pd.DataFrame({"host": [key[0]] * len(ready), "url": [urls[i] for i in ready], "due": [dues[i] for i in ready]})

    asked = requests.select("host", "url", F.col("at").cast("double").alias("at"), F.col("interval").cast("double").alias("interval"))
    return asked.groupBy("host").applyInPandasWithState(pace, PACED, "free double, urls array<string>, dues array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def due_stream(crawls: DataFrame, interval: timedelta, late: str = "0 seconds") -> DataFrame:
    """site, last, due: each time a site's last crawl of a stream (site, crawled_at) is an interval old, by event-time timers.

    A site's state is its last crawl; it goes when the site is told to be due, so a site is told once until it is crawled
    again. Crawls that come more than `late` after later ones don't count.
    """
    step = int(interval.total_seconds() * 1000)

    def watch(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        told: list[int] = []
        if not state.hasTimedOut:
            for at in sorted(int(x.timestamp() * 1000) for pdf in rows for x in pdf["crawled_at"]):
                if last is not None and at - last >= step:  # the stream learnt of both at once
                    told.append(last)
                last = at if last is None else max(last, at)
        if state.hasTimedOut or last + step <= state.getCurrentWatermarkMs():
            told.append(last)
            state.remove()
        else:
            state.update((last,))
            state.setTimeoutTimestamp(last + step)
        if told:
            yield pd.DataFrame({"site": [key[0]] * len(told), "last": pd.Series([_utc(x) for x in told], dtype="datetime64[us, UTC]"), "due": pd.Series([_utc(x + step) for x in told], dtype="datetime64[us, UTC]")})

    seen = crawls.select("site", "crawled_at").withWatermark("crawled_at", late)
    return seen.groupBy("site").applyInPandasWithState(watch, DUE, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
