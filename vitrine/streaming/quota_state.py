"""State of one quota key: when its window opened and how many hits it has had."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


class QuotaProcessor(StatefulProcessor):
    """Counts a key's hits in time order inside each micro-batch.

    Two integers per hit of one key in one micro-batch are held, which the source's trigger options
    bound. The state goes when the watermark passes the end of its window, as every later hit opens
    a new one.
    """

    def __init__(self, limit: int, window_seconds: int) -> None:
        self.limit = limit
        self.window_us = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("opened", LongType()), StructField("count", LongType())])
        self.handle = handle
        self.window = handle.getValueState("window", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(batch["at"].to_numpy(np.int64), batch["hit_id"].to_numpy(np.int64)) for batch in rows]
        at, hit_id = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((hit_id, at))
        at, hit_id = at[order], hit_id[order]
        opened, count = self.window.get() if self.window.exists() else (int(at[0]), 0)
        openings, counts = np.empty_like(at), np.empty_like(at)
        start = 0
        while start < len(at):
            if at[start] >= opened + self.window_us:
                opened, count = int(at[start]), 0
            end = int(np.searchsorted(at, opened + self.window_us))
            openings[start:end] = opened
            counts[start:end] = count + 1 + np.arange(end - start)
            count, start = count + end - start, end
        self.window.update((opened, int(count)))
        self.handle.registerTimer(-(-(opened + self.window_us) // 1000))
        yield pd.DataFrame(
            {"key": key[0], "hit_id": hit_id, "opened": openings, "count": counts, "allowed": counts <= self.limit}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A later hit may have opened another window since the timer was set.
        if self.window.exists() and self.window.get()[0] + self.window_us <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.window.clear()
        return iter([])

    def close(self) -> None:
        pass
