"""The online form of the checkpoint job: trailing windows and first alerts on an event stream."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def trailing_windows(stream: DataFrame, entity: str, fam: str, ts: str, value: str, width: str = "24 hours", step: str = "6 hours", late: str = "6 hours") -> DataFrame:
    """Sliding window statistics per entity and family; rows later than the watermark are dropped.

    Spark windows are ``[start, end)`` while checkpoints use ``(t - width, t]``: times are moved back by one microsecond,
    so a window that ends at ``t`` holds exactly the rows of the checkpoint at ``t``.
    """
    moved = stream.withColumn("_ts", F.col(ts).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")).withWatermark("_ts", late)
    order = F.struct(F.col("_ts").alias("t"), F.col(value).alias("v"))
    out = moved.groupBy(F.window("_ts", width, step).alias("w"), entity, fam).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.max(order).alias("_l"), F.min(order).alias("_f"))
    return out.select(entity, fam, F.col("w.end").alias("at"), "n", "min", "max", F.col("_l.v").alias("last"), (F.col("_l.v") - F.col("_f.v")).alias("delta"))


def first_alerts(stream: DataFrame, entity: str, ts: str, score: str, threshold: float) -> DataFrame:
    """Earliest alert per entity as a running aggregate (update mode)."""
    return stream.filter(F.col(score) >= threshold).groupBy(entity).agg(F.min(ts).alias("first_alert"))


class FirstAlert(StatefulProcessor):
    """Emits an entity once, at its first alert. State: one timestamp per entity, whatever the number of rows."""

    def __init__(self, entity: str, ts: str):
        self.entity, self.ts = entity, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("first_alert", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            at = pdf[self.ts].min()
            first = at if first is None or at < first else first
        if first is not None and not self.seen.exists():
            self.seen.update((first.to_pydatetime(),))
            yield pd.DataFrame({self.entity: [key[0]], "first_alert": [first]})

    def close(self) -> None:
        pass


def alert_once(stream: DataFrame, entity: str, ts: str, score: str, threshold: float) -> DataFrame:
    """One row per entity, emitted in the batch of its first alert (append mode). Needs the RocksDB state store."""
    alerts = stream.filter(F.col(score) >= threshold).select(entity, F.col(ts).cast("timestamp").alias(ts))
    kind = stream.schema[entity].dataType.simpleString()
    return alerts.groupBy(entity).transformWithStateInPandas(
        statefulProcessor=FirstAlert(entity, ts), outputStructType=f"{entity} {kind}, first_alert timestamp", outputMode="Append", timeMode="None")


class AlertEpisodes(StatefulProcessor):
    """Emits the first alert of each episode. State: the latest alert per entity, cleared by a timer once the episode is over.

    The timer fires when the watermark has passed the quiet time after the latest alert, so only entities in an episode keep state. A new alert
    moves the timer. The alert times of one entity in one batch are held in memory, eight bytes each.
    """

    def __init__(self, entity: str, ts: str, quiet_ms: int):
        self.entity, self.ts, self.quiet_ms = entity, ts, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest_alert", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([pdf[self.ts].to_numpy("datetime64[us]").astype("int64") for pdf in rows]))
        quiet = self.quiet_ms * 1000
        # Every call to the state is a round trip: one that reads it, and no other for a batch without a younger alert.
        state = self.latest.get()
        known = None if state is None else state[0]
        gaps = np.diff(times, prepend=times[0] - quiet if known is None else min(known, times[0]))
        starts = times[gaps >= quiet]
        latest = int(times[-1]) if known is None else max(int(times[-1]), known)
        if latest != known:
            if known is not None:
                self.handle.deleteTimer(self._over(known))  # state and timer come and go together
            self.latest.update((latest,))
            self.handle.registerTimer(self._over(latest))
        if len(starts):
            yield pd.DataFrame({self.entity: [key[0]] * len(starts), "started": starts.astype("datetime64[us]")})

    def _over(self, latest: int) -> int:
        """Time of the timer of an episode whose latest alert this is, in milliseconds."""
        return -(-latest // 1000) + self.quiet_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        return iter([])

    def close(self) -> None:
        pass


def alert_episodes(stream: DataFrame, entity: str, ts: str, score: str, threshold: float, quiet: datetime.timedelta, late: str = "0 seconds") -> DataFrame:
    """One row per alert that has no alert of its entity in the quiet time before it (append mode). Needs the RocksDB state store.

    Batches may hold their rows in any order. An alert that comes in a later batch than a younger one of its entity belongs to the episode in progress;
    one behind the watermark is dropped. Null entities, times and scores give nothing.
    """
    alerts = stream.filter((F.col(score) >= threshold) & F.col(entity).isNotNull()).select(entity, F.col(ts).cast("timestamp").alias(ts)).filter(F.col(ts).isNotNull())
    kind = stream.schema[entity].dataType.simpleString()
    return alerts.withWatermark(ts, late).groupBy(entity).transformWithStateInPandas(
        statefulProcessor=AlertEpisodes(entity, ts, int(quiet.total_seconds() * 1000)), outputStructType=f"{entity} {kind}, started timestamp", outputMode="Append", timeMode="EventTime")
