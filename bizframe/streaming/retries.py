"""Due work as a stream with state: attempts, back-off timers and giving up per transaction, and the same from a table.

Events say that a transaction failed or was done. A failure plans a retry after a delay that grows with the attempt; an
event that comes before it replaces or cancels it; more failures than attempts give the transaction up until it is done.
The stream keeps four numbers a transaction and a timer of event time for its planned retry, so a planned retry comes out
when the watermark passes it though no event follows, and a stopped query goes on from its checkpoint. retry_actions() is
the same as windows over a table.

Defined cases: events of other kinds, or with a null key, time or kind, change nothing; events of one time are taken by
their id; an event later than the watermark is left out by the stream; within a micro-batch events are taken by time; a
retry planned for the very time of an event comes before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: An event's columns; a processor may get them without their names.
COLUMNS = ["__key", "__ts", "__kind", "__id", "__ms"]
FAILED, DONE = "failed", "done"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def delay_ms(attempt: int, minutes: float, factor: float) -> int:
    return int(minutes * 60_000 * factor ** (attempt - 1))


class Retries(StatefulProcessor):
    """Per transaction: attempts, the planned retry (0: none)."""

    def __init__(self, most: int, minutes: float, factor: float):
        self.most, self.minutes, self.factor = most, minutes, factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("retry", "attempts int, planned bigint")

    def _get(self) -> tuple[int, int]:
        return tuple(self.state.get()) if self.state.exists() else (0, 0)

    def _row(self, key, at: int, action: str, attempt: int) -> tuple:
        return key[0], pd.Timestamp(at, unit="ms"), action, attempt

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "at", "action", "attempt"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        attempts, planned = self._get()
        before, out = planned, []
        events = pd.concat(frames).set_axis(COLUMNS, axis=1).sort_values(["__ms", "__id"])
        for ms, kind in zip(events["__ms"].tolist(), events["__kind"].tolist()):
            if planned and planned <= ms:
                out.append(self._row(key, planned, "retry", attempts))
            planned = 0
            if kind == DONE:
                if attempts:
                    out.append(self._row(key, ms, "closed", attempts))
                attempts = 0
                continue
            attempts += 1
            if attempts <= self.most:
                planned = ms + delay_ms(attempts, self.minutes, self.factor)
            elif attempts == self.most + 1:
                out.append(self._row(key, ms, "give_up", attempts))
        if before != planned:
            if before:
                self.handle.deleteTimer(before)
            if planned:
                self.handle.registerTimer(planned)
        self.state.update((attempts, planned))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, planned = self._get()
        out = []
        if planned and planned == expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._row(key, planned, "retry", attempts))
            self.state.update((attempts, 0))
        yield self._frame(out)

    def close(self) -> None:
        pass


def _events(events: DataFrame, key: str, ts: str, kind: str, id_col: str) -> DataFrame:
    e = events.select(F.col(key).alias("__key"), F.col(ts).cast("timestamp").alias("__ts"), F.col(kind).alias("__kind"), F.col(id_col).alias("__id"))
    return e.where(F.col("__kind").isin(FAILED, DONE) & F.col("__key").isNotNull() & F.col("__ts").isNotNull()).withColumn("__ms", F.unix_millis("__ts"))


def retry_stream(events: DataFrame, key: str, ts: str, kind: str, id_col: str, most: int = 3, minutes: float = 15, factor: float = 2, late: str = "10 minutes") -> DataFrame:
    """key, at, action ('retry', 'give_up', 'closed'), attempt, as they fall due. The session keeps state in RocksDB."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kept = _events(events, key, ts, kind, id_col).withWatermark("__ts", late)
    schema = f"key {dict(events.dtypes)[key]}, at timestamp, action string, attempt int"
    return kept.groupBy("__key").transformWithStateInPandas(Retries(most, minutes, factor), schema, "append", "eventTime")


def retry_actions(events: DataFrame, key: str, ts: str, kind: str, id_col: str, most: int = 3, minutes: float = 15, factor: float = 2, late_minutes: float = 10) -> DataFrame:
    """What retry_stream() has given out when all events have come: planned retries up to the last event's time less the lateness."""
    e = _events(events, key, ts, kind, id_col)
    by_time = Window.partitionBy("__key").orderBy("__ms", "__id")
    upto = by_time.rowsBetween(Window.unboundedPreceding, -1)
    failed = (F.col("__kind") == FAILED).cast("int")
    spell = e.withColumn("__spell", F.coalesce(F.count_if(F.col("__kind") == DONE).over(upto), F.lit(0)))
    within = Window.partitionBy("__key", "__spell").orderBy("__ms", "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = spell.withColumn("__n", F.sum(failed).over(within).cast("int")).withColumn("__next", F.lead("__ms").over(by_time))
    planned = F.col("__ms") + (F.lit(minutes * 60_000.0) * F.pow(F.lit(float(factor)), F.col("__n") - 1)).cast("bigint")
    last = e.agg(F.max("__ms")).first()[0] or 0
    due = F.coalesce(F.col("__next"), F.lit(last - int(late_minutes * 60_000)))
    action = (
        F.when((F.col("__kind") == DONE) & (F.col("__n") > 0), "closed")
        .when((F.col("__kind") == FAILED) & (F.col("__n") <= most) & (planned <= due), "retry")
        .when((F.col("__kind") == FAILED) & (F.col("__n") == most + 1), "give_up")
    )
    at = F.timestamp_millis(F.when(action == "retry", planned).otherwise(F.col("__ms")))
    return seen.select(F.col("__key").alias("key"), at.alias("at"), action.alias("action"), F.col("__n").alias("attempt")).where("action is not null")
