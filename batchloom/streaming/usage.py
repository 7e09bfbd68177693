"""Quota use and lane states on a stream of attempts (`created_at` is the event time)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from batchloom.operators.audit import lane_keys
from batchloom.schemas import struct_type


def quota_usage_stream(
    attempts: DataFrame,
    delay: str = "10 minutes",
    lanes: DataFrame | None = None,
    shared: bool = False,
) -> DataFrame:
    """Requests and tokens per lane and minute, given out once the watermark passes the minute.

    Rows are combined before the shuffle, so a busy lane costs one row per task and minute. With a
    lane table the limits are there too, and `over_limit` tells if either was exceeded. Lanes are those of
    a job where attempts have one, unless they are `shared`.
    """
    keys = lane_keys(attempts, shared)
    usage = (
        attempts.withWatermark("created_at", delay)
        .groupBy(*keys, F.window("created_at", "1 minute"))
        .agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("tokens"))
        .select(*keys, F.col("window.start").alias("minute"), "requests", "tokens")
    )
    if lanes is None:
        return usage
    on = [key for key in keys if key in lanes.columns]
    limits = ["requests_per_minute", "input_tokens_per_minute"]
    over = (F.col("requests") > F.col(limits[0])) | (F.col("tokens") > F.col(limits[1]))
    return usage.join(lanes.select(*on, *limits), on, "left").withColumn(
        "over_limit", F.coalesce(over, F.lit(False))
    )


_SUMS = "virtual_window bigint, requests bigint, tokens bigint, failures bigint, seen_at timestamp"
_STORED = "last bigint, requests bigint, tokens bigint, failures bigint"
LANE_STATE = struct_type(
    state=T.StringType(),
    as_of_window=T.LongType(),
    cooldown_until_window=T.LongType(),
    last_request_window=T.LongType(),
    requests_used=T.LongType(),
    input_tokens_used=T.LongType(),
    failure_count=T.LongType(),
)


def _combine(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per lane and window of each Arrow batch."""
        for rows in batches:
            rows["failures"] = (rows["status"] == "failed").astype("int64")
            combined = rows.groupby([*keys, "virtual_window"], as_index=False, dropna=False).agg(
                requests=("failures", "size"),
                tokens=("input_tokens", "sum"),
                failures=("failures", "sum"),
                seen_at=("created_at", "max"),
            )
            yield combined.astype({"requests": "int64"})

    return run


class LaneStates(StatefulProcessor):
    """Follows one lane: cooling down in the window of its last request, ready when event time has
    passed that window, failed for good after a failed batch."""

    def __init__(self, first_window_ms: int, window_ms: int, keys: list[str]):
        self.first_window_ms, self.window_ms = first_window_ms, window_ms
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._lane = handle.getValueState("lane", _STORED)

    def _end_of(self, window: int) -> int:
        return self.first_window_ms + (window + 1) * self.window_ms

    def _row(self, key: tuple, state: str, as_of: int, stored: tuple) -> pd.DataFrame:
        last, requests, tokens, failures = stored
        until = last + 1 if state == "cooldown" else None
        row = (*key, state, as_of, until, last, requests, tokens, failures)
        return pd.DataFrame([row], columns=[*self.keys, *LANE_STATE.fieldNames()]).astype(
            {"cooldown_until_window": "Int64"}
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._lane.get() if self._lane.exists() else None
        last, requests, tokens, failures = before or (-1, 0, 0, 0)
        for frame in rows:
            last = max(last, int(frame["virtual_window"].max()))
            requests += int(frame["requests"].sum())
            tokens += int(frame["tokens"].sum())
            failures += int(frame["failures"].sum())
        stored = (last, requests, tokens, failures)
        self._lane.update(stored)
        if before:
            self._handle.deleteTimer(self._end_of(before[0]))
        if not failures:
            self._handle.registerTimer(self._end_of(last))
        yield self._row(key, "failed" if failures else "cooldown", last, stored)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stored = self._lane.get()
        yield self._row(key, "ready", stored[0] + 1, stored)

    def close(self) -> None:
        pass


def lane_state_stream(
    attempts: DataFrame,
    first_window: datetime,
    window: timedelta = timedelta(minutes=1),
    delay: str = "10 minutes",
    shared: bool = False,
) -> DataFrame:
    """A row per change of a lane's state, in update mode; the highest `as_of_window` counts.

    Windows are counted from `first_window` (UTC). Attempts are combined per lane and window in
    each task first, so a busy lane does not send all its rows to one place. Needs the RocksDB
    state store, which the session sets with `spark.sql.streaming.stateStore.providerClass`. Lanes are
    those of a job where attempts have one, unless they are `shared`.
    """
    keys = lane_keys(attempts, shared)
    origin = int((first_window - datetime(1970, 1, 1)).total_seconds() * 1000)
    length = int(window.total_seconds() * 1000)
    columns = [*keys, "virtual_window", "status", "input_tokens", "created_at"]
    names = ", ".join(f"{key} string" for key in keys)
    combined = attempts.select(*columns).mapInPandas(_combine(keys), f"{names}, {_SUMS}")
    kind = T.StructType([*(T.StructField(key, T.StringType()) for key in keys), *LANE_STATE.fields])
    return (
        combined.withWatermark("seen_at", delay)
        .groupBy(*keys)
        .transformWithStateInPandas(
            LaneStates(origin, length, keys), kind, outputMode="Update", timeMode="EventTime"
        )
    )
