"""Keyed state that ends: miss counters with a time to live, and cache entries that expire by timers."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State with timers and times to live needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def prepare(spark: SparkSession) -> None:
    """The state store that these operators need, and this package on the workers' path."""
    spark.conf.set(*STORE)
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


class _Misses(StatefulProcessor):
    """Runs of one (entity, source): the state is the last run, the misses on end up to it, and when its life ends."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("misses", "misses long, last long, until_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        misses, last, until = self.state.get() if self.state.exists() else (0, -1, 0)
        out, frame = [], pd.concat(list(rows))
        # within a run a sighting wins; runs that are not newer than the state are late or repeated
        for run, seen in frame.groupby("run")["seen"].max().sort_index().items():
            if run > last:
                misses, last = (0 if seen else misses + 1), int(run)
                out.append((key[0], key[1], last, misses))
        if out:
            if self.ttl_ms:
                end = max(until, int(frame["at"].max().timestamp() * 1000) + self.ttl_ms)
                if until and end != until:
                    self.handle.deleteTimer(until)
                if end != until:
                    self.handle.registerTimer(end)
                until = end
            self.state.update((misses, last, until))
        yield pd.DataFrame(out, columns=["entity", "source", "run", "misses"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        self.state.clear()
        yield pd.DataFrame([], columns=["entity", "source", "run", "misses"])

    def close(self) -> None:
        pass


def miss_counters(runs: DataFrame, ttl_ms: int = 0, delay: str = "0 seconds") -> DataFrame:
    """A stream of (entity, source, run, seen) to (entity, source, run, misses).

    With ``ttl_ms`` the rows have a time ``at``, and a pair without a new run
    for so long is forgotten: its next run begins at nothing, as for a new
    pair. The stream's own time counts (the newest ``at`` of any pair, less
    ``delay``), so a rerun of the same files forgets the same pairs, and runs
    over all that is available come to an end. Rows no newer than that time are
    late and left out. Replays and late runs give no row.
    """
    prepare(runs.sparkSession)
    rows = runs.withWatermark("at", delay) if ttl_ms else runs
    return rows.groupBy("entity", "source").transformWithStateInPandas(_Misses(ttl_ms), "entity long, source string, run long, misses long", "Append", "EventTime" if ttl_ms else "None")


class _Cache(StatefulProcessor):
    """Responses of one url: the newest fetch, and a timer at its end."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "etag string, fetched_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        had = self.entry.get() if self.entry.exists() else None
        frame = pd.concat(list(rows)).sort_values(["fetched_at", "etag"], kind="stable")
        at, etag = int(frame["fetched_at"].iloc[-1].timestamp() * 1000), frame["etag"].iloc[-1]
        out = []
        if had is None or (at, str(etag)) > (had[1], str(had[0])):
            if had is not None:
                self.handle.deleteTimer(had[1] + self.ttl_ms)
            self.entry.update((etag, at))
            self.handle.registerTimer(at + self.ttl_ms)
            out.append((key[0], etag, "stored" if had is None else "unchanged" if had[0] == etag else "replaced", pd.Timestamp(at, unit="ms")))
        yield pd.DataFrame(out, columns=["url", "etag", "change", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        etag, _ = self.entry.get()
        self.entry.clear()
        yield pd.DataFrame([(key[0], etag, "expired", pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))], columns=["url", "etag", "change", "at"])

    def close(self) -> None:
        pass


def cache_log(fetches: DataFrame, ttl_ms: int, delay: str = "0 seconds") -> DataFrame:
    """A stream of (url, etag, fetched_at) to (url, etag, change, at): stored, replaced, unchanged, expired.

    An entry expires when the stream's own time (the newest fetch of any url,
    less ``delay``) passes the end of its life; a newer fetch of the url moves
    that end. Fetches older than the entry change nothing.
    """
    prepare(fetches.sparkSession)
    known = fetches.withWatermark("fetched_at", delay)
    return known.groupBy("url").transformWithStateInPandas(_Cache(ttl_ms), "url string, etag string, change string, at timestamp", "Append", "EventTime")
