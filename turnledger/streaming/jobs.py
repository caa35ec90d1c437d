"""Live versions of daily and weekly cost, limit clusters, anchored windows and usage rate.

Prices are joined as a static dimension; every state is bounded by a watermark. Input needs ``event_time`` besides
the columns of the batch twin.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnledger.functions.pricing import price_calls
from turnledger.operators.limits import WINDOW_MS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(turns: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Priced calls with an event-time watermark."""
    calls = price_calls(turns.where((F.col("output_tokens") > 0) & F.col("ts_ms").isNotNull()))
    return calls.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)


def _windowed(calls: DataFrame, window, *keys: str) -> DataFrame:
    out = calls.groupBy(window.alias("w"), *keys).agg(F.sum("cost_nusd").alias("cost_nusd"),
                                                      F.count(F.lit(1)).alias("calls"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "cost_nusd", "calls")


def daily_cost(turns: DataFrame, delay: str = "1 hour") -> DataFrame:
    return _windowed(timed(turns, delay), F.window("event_time", "1 day"), "display")


def weekly_cost(turns: DataFrame, anchor_weekday: int = 0, delay: str = "1 hour") -> DataFrame:
    """Weeks that start on the anchor weekday: 1970-01-01 was a Thursday, so Monday weeks are shifted by 4 days."""
    shift = f"{(anchor_weekday + 4) % 7} days"
    return _windowed(timed(turns, delay), F.window("event_time", "7 days", "7 days", shift), "account")


def usage_rate(turns: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cost over the last five hours, every quarter of an hour."""
    return _windowed(timed(turns, delay), F.window("event_time", "5 hours", "15 minutes"), "account")


def limit_clusters(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events chained within 15 minutes, per account."""
    e = events.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)
    out = e.groupBy("account", F.session_window("event_time", "15 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("merged_count"), F.min("ts_ms").alias("ts_ms"), F.max("ts_ms").alias("last_ms"))
    return out.select("account", "ts_ms", "last_ms", "merged_count")


WINDOW_SCHEMA = "account string, start_ms bigint, end_ms bigint, cost_nusd bigint, turn_count bigint"


class AnchoredWindows(StatefulProcessor):
    """State per account: the open window and the calls that wait for the watermark, folded per millisecond.

    Calls are buffered until the watermark passes them, so their order does not matter. The buffer holds sums per
    distinct millisecond of the watermark delay and the running batch, never a history.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "start_ms long, end_ms long, cost_nusd long, turn_count long")
        self._buffer = handle.getMapState("buffer", "ts_ms long", "cost_nusd long, turn_count long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            sums = part.groupby("ts_ms")["cost_nusd"].agg(["sum", "count"])
            for ts, cost, n in zip(sums.index.tolist(), sums["sum"].tolist(), sums["count"].tolist()):
                old = self._buffer.getValue((int(ts),)) if self._buffer.containsKey((int(ts),)) else (0, 0)
                self._buffer.updateValue((int(ts),), (int(old[0]) + int(cost), int(old[1]) + int(n)))
        self._handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        current = tuple(self._open.get()) if self._open.exists() else None
        done, late = [], False
        ready = sorted((k[0], v[0], v[1]) for k, v in self._buffer.iterator())
        for ts, cost, n in ready:
            if ts > watermark:
                late = True
                break
            if current is None or ts >= current[0] + WINDOW_MS:
                if current is not None:
                    done.append(current)
                current = (ts, ts, 0, 0)
            current = (current[0], ts, current[2] + cost, current[3] + n)
            self._buffer.removeKey((ts,))
        if current is not None and watermark >= current[0] + WINDOW_MS:
            done.append(current)
            current = None
        if current is None:
            self._open.clear()
        else:
            self._open.update(tuple(int(x) for x in current))
        if late or current is not None:
            self._handle.registerTimer(watermark + 1)
        if done:
            yield pd.DataFrame([(key[0], *w) for w in done],
                               columns=["account", "start_ms", "end_ms", "cost_nusd", "turn_count"])

    def close(self) -> None:
        pass


def windows_5h(turns: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Anchored five-hour windows per account; a window is emitted once the watermark passes its end.

    Needs the RocksDB state store (``use_rocksdb``). Rows below the watermark are dropped by Spark and counted in
    the query progress.
    """
    calls = timed(turns, delay).select(F.col("account").cast("string").alias("account"), "ts_ms", "cost_nusd", "event_time")
    return calls.groupBy("account").transformWithStateInPandas(
        statefulProcessor=AnchoredWindows(), outputStructType=WINDOW_SCHEMA, outputMode="Append", timeMode="EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
