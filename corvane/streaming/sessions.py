"""Tutoring sessions as a stream: keyed state over replies, and the turn log as a date-partitioned JSON sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from corvane.operators.dialogue import STATES, step


def stream_states(replies: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """replies(session_id, turn, aside, level) as they come -> the same rows as dialogue_states, turn by turn.

    State is a stage and a count a session and goes after ``idle_ms`` without replies, if given (such a query runs on and
    can't be one that stops when its input ends); replies of a batch are taken in turn order.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stage, rounds = state.get if state.exists else ("DIAGNOSE", 0)
        out = []
        for row in pd.concat(list(parts)).sort_values("turn").itertuples():
            stage, rounds, kind = step(stage, rounds, bool(row.aside) if row.aside is not None else False, row.level)
            out.append((key[0], row.turn, stage, rounds, kind))
        state.update((stage, rounds))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

    return replies.groupBy("session_id").applyInPandasWithState(fold, STATES, "stage string, rounds int", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


EVENTS = f"{STATES}, at timestamp"


class Sessions(StatefulProcessor):
    """A session's stage and rounds as typed state, with a timer that ends it and one that forgets that it was.

    ``idle_ms`` after a session's last reply, by the times of replies and the stream's watermark, the session expires: a row of kind EXPIRED says so, and
    its state goes.  Replies that come later get the kind EXPIRED_ERROR and change nothing, for ``keep_ms`` more; then the
    id is free.
    """

    def __init__(self, idle_ms: int, keep_ms: int) -> None:
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "stage string, rounds int, turn long, last long")
        self.gone = handle.getValueState("gone", "at long")

    def _row(self, key: tuple, turn: int | None, stage: str, rounds: int, kind: str, at: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], turn, stage, rounds, kind, pd.Timestamp(at, unit="ms"))], columns=[c.split()[0] for c in EVENTS.split(", ")])

    def _restart(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = pd.concat(list(rows)).sort_values("turn")
        times = found["at"].map(lambda t: int(t.timestamp() * 1000))
        held = self.state.exists()
        gone = self.gone.get()[0] if self.gone.exists() else None  # when it expired
        stage, rounds, turn, last = self.state.get() if held else ("DIAGNOSE", 0, 0, 0)
        for row, at in zip(found.itertuples(), times, strict=True):
            if held and at > last + self.idle_ms:  # later than the timer, though that has not gone off
                yield self._expire(key, turn, stage, rounds, last + self.idle_ms)
                gone, held = last + self.idle_ms, False
            if gone is not None and at > gone + self.keep_ms:
                self.gone.clear()
                gone, stage, rounds, last = None, "DIAGNOSE", 0, 0
            if gone is not None:
                yield self._row(key, row.turn, "EXPIRED", 0, "EXPIRED_ERROR", at)
                continue
            stage, rounds, kind = step(stage, rounds, bool(row.aside) if row.aside is not None else False, row.level)
            held, turn, last = True, int(row.turn), max(last, at)
            yield self._row(key, row.turn, stage, rounds, kind, at)
        if held:
            self.state.update((stage, rounds, turn, last))
            self._restart(last + self.idle_ms)

    def _expire(self, key: tuple, turn: int, stage: str, rounds: int, at: int) -> pd.DataFrame:
        self.state.clear()
        self.gone.update((at,))
        self._restart(at + self.keep_ms)
        return self._row(key, turn, stage, rounds, "EXPIRED", at)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.gone.exists():
            self.gone.clear()
            return
        stage, rounds, turn, _ = self.state.get()
        yield self._expire(key, turn, stage, rounds, at)

    def close(self) -> None:
        pass


def session_events(replies: DataFrame, idle_ms: int, keep_ms: int, late: str = "0 seconds") -> DataFrame:
    """replies(session_id, turn, aside, level, at timestamp) as a stream -> EVENTS: dialogue_states' rows, expiries and errors.

    The state store must be RocksDB's (see ROCKSDB); replies of a batch are taken in turn order.
    """
    timed = replies.withWatermark("at", late)
    return timed.groupBy("session_id").transformWithStateInPandas(Sessions(idle_ms, keep_ms), EVENTS, "Append", "EventTime")


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def write_turn_log(turns: DataFrame, path: str, checkpoint: str, time_col: str = "time") -> StreamingQuery:
    """Append turns as JSON lines below date=... folders, exactly once."""
    dated = turns.withColumn("date", F.to_date(time_col))
    return dated.writeStream.format("json").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
