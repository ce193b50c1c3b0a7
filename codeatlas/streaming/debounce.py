"""Debouncing: of a user's inputs, those followed by a quiet gap (an extension; the batch and two streaming forms)."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def debounce(events: DataFrame, gap: str = "6 hours", user: str = "user_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The rows with no later row of the same user within ``gap``; the last row always stays."""
    after = F.lead(at).over(W.partitionBy(user).orderBy(at, tie))
    return events.withColumn("__next", after).where(F.col("__next").isNull() | (F.col("__next") > F.col(at) + F.expr(f"interval {gap}"))).drop("__next")


def debounce_stream(events: DataFrame, value: str, gap: str = "6 hours", late: str = "1 hour", user: str = "user_id", at: str = "ts") -> DataFrame:
    """The last value of each session of a stream: ``user, at, value``; append mode, sessions end by watermark."""
    sessions = events.withWatermark(at, late).groupBy(user, F.session_window(at, gap))
    return sessions.agg(F.max(at).alias(at), F.max_by(value, at).alias(value)).select(user, at, value)


def debounce_by_clock(events: DataFrame, value: str, gap: datetime.timedelta, user: str = "user_id", at: str = "ts") -> DataFrame:
    """As ``debounce`` for a stream, ``user, at, value``, by the clock: a user's last input comes out when ``gap`` has passed since it
    came in, whether or not anything follows.

    Inputs that come in together, or before the gap has passed, are told apart by their own times.  Of inputs at one time the largest value
    counts.  One that comes late, after a later one, is dropped if it lies within the gap before that, else it comes out at once.  A user's state is one row and one timer, and
    goes with the timer.  The session's state store must keep timers (``STATE_STORE``).
    """
    user_kind, value_kind = (events.schema[c].dataType.simpleString() for c in (user, value))
    quiet = gap // datetime.timedelta(microseconds=1)

    class Last(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getValueState("held", f"at long, value {value_kind}")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            found = sorted(((r[at], r[value]) for r in rows if r[at] is not None), key=lambda x: (x[0], x[1] is not None, x[1]))
            if not found:
                return
            last = tuple(self.held.get()) if self.held.exists() else None
            for x in found:
                if last is not None and x[0] < last[0]:
                    if last[0] - x[0] > quiet:
                        yield out(key, x)
                    continue
                if last is not None and x[0] - last[0] > quiet:
                    yield out(key, last)
                last = x
            self.held.update(last)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + quiet // 1000)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            if self.held.exists():
                last = tuple(self.held.get())
                self.held.clear()
                yield out(key, last)

        def close(self) -> None:
            pass

    def out(key: tuple, x: tuple) -> Row:
        return Row(**{user: key[0], at: x[0], value: x[1]})

    # times as microseconds: state and rows would give them with and without a zone
    picked = events.select(user, F.unix_micros(at).alias(at), value)
    found = picked.groupBy(user).transformWithState(Last(), f"{user} {user_kind}, {at} long, {value} {value_kind}", "append", "processingTime")
    return found.select(user, F.timestamp_micros(at).alias(at), value)
