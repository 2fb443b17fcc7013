"""The rate limit as a stateful streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.intake import PER_WINDOW, WINDOW_MS, Limiter

#: How much later than the latest call one may arrive and still be answered.
LATE_MS = 3_600_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LimitProcessor(StatefulProcessor):
    """One value a key (when its window began, how many calls it saw) and one
    timer, at the window's end: when the watermark passes it the key goes."""

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, count int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Sixteen bytes a call of this key and micro-batch; the frames go as they come.
        parts = [(f["ms"].to_numpy(np.int64), f["req_id"].to_numpy(np.int64)) for f in rows]
        ms, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, ms))
        start, count = self.window.get() if self.window.exists() else (None, 0)
        limiter = Limiter(self.limit, self.window_ms, start, count)
        allowed = np.fromiter((limiter.allows(x) for x in ms[order].tolist()), bool, len(order))
        self.window.update((limiter.start, limiter.count))
        ends = max(limiter.start + self.window_ms, timerValues.getCurrentWatermarkInMs() + 1)
        if limiter.start != start:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ends)
        yield pd.DataFrame({"req_id": ids[order], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(
    requests: DataFrame, limit: int = PER_WINDOW, window_ms: int = WINDOW_MS, late_ms: int = LATE_MS
) -> DataFrame:
    """(req_id, allowed) of a stream (key, req_id, ms).  State is one window
    start and one count a key, kept across batches and executors in RocksDB
    (the session's provider of state stores is set to it).

    State expires by timers: when the watermark (the latest call less
    ``late_ms``) passes the end of a key's window the key is forgotten, so
    state follows the keys of the last windows and not all keys ever seen.
    Calls behind the watermark get no answer."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = requests.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", f"{late_ms} milliseconds")
    return timed.groupBy("key").transformWithStateInPandas(
        LimitProcessor(limit, window_ms), "req_id long, allowed boolean", "append", "eventTime"
    )


def live_windows(spark, checkpoint: str) -> DataFrame:
    """(key, start, count) that a stream's state store holds."""
    state = spark.read.format("statestore").option("stateVarName", "window").load(checkpoint)
    return state.select("key.key", "value.start", "value.count")
