"""Sessions of event time: runs of a user's events with gaps below a limit; late events are told, not lost."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

SESSION_SCHEMA = "user_id long, kind string, started timestamp, ended timestamp, events long, total double"


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, started, ended (the last event's time plus the gap), events, total of batch or stream events (user_id, ts, value).

    A stream's sessions come when the watermark passes their end; Spark drops events behind the watermark. Events without a time are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    made = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return made.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events", "total")


class _Sessions(StatefulProcessor):
    """A user's open sessions as a short list, and a timer at each one's end."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [StructField(n, LongType()) for n in ("started", "ended", "events")]
        self.open = handle.getListState("open", StructType([*fields, StructField("total", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        late: list[tuple] = []
        for part in rows:
            for at, value in zip(part["at"], part["value"]):
                value = 0.0 if pd.isna(value) else float(value)
                (late if at < mark else held).append((int(at), int(at) + self.gap, 1, value))
        merged: list[tuple] = []
        for start, end, n, total in sorted(held):
            if merged and start < merged[-1][1]:
                a, b, m, s = merged[-1]
                merged[-1] = (a, max(b, end), m + n, s + total)
            else:
                merged.append((start, end, n, total))
        if merged:
            self.open.put(merged)
            for _, end, _, _ in merged:
                self.handle.registerTimer(-(-end // 1000))
        if late:
            yield _rows(key, "late", late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        over, rest = [s for s in held if s[1] <= now], [s for s in held if s[1] > now]
        if rest:
            self.open.put(rest)
        else:
            self.open.clear()
        if over:
            yield _rows(key, "session", over)

    def close(self) -> None:
        pass


def _rows(key, kind: str, rows: list[tuple]) -> pd.DataFrame:
    time = lambda k: pd.to_datetime([r[k] for r in rows], unit="us")
    return pd.DataFrame({"user_id": key[0], "kind": kind, "started": time(0), "ended": time(1), "events": [r[2] for r in rows], "total": [r[3] for r in rows]})


def sessions_and_late(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The sessions of a stream (kind `session`) and, as rows of their own, the events that came behind the watermark (kind `late`).

    The state of a user is the list of open sessions; a session goes to the result, and from the state, when the
    watermark passes its end. Every event with a time is in one row of the result, once the stream has moved on."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null").withWatermark("ts", late)
    plain: Column = F.unix_micros("ts")  # a number, which Spark doesn't hold against the watermark
    return timed.select("user_id", plain.alias("at"), "value").groupBy("user_id").transformWithStateInPandas(
        _Sessions(_micros(events, gap)), SESSION_SCHEMA, "append", "eventTime"
    )


def _micros(df: DataFrame, text: str) -> int:
    """Microseconds of an interval of days, hours, minutes or seconds."""
    units = {"day": 86_400, "hour": 3_600, "minute": 60, "second": 1}  # fixed values
    number, unit = text.split()
    return int(float(number) * units[unit.rstrip("s")] * 1_000_000)
