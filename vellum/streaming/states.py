"""States of batches as a stream: each change updates what is kept of its batch, in any order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vellum.operators.batches import ENDED

#: The store that state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "status string, at long, tie long, started long"


class _Changes(StatefulProcessor):
    """Keeps of each batch its last change, by time and tie, and when it first left ``pending``; times are microseconds."""

    def __init__(self, stale: int | None):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.state.get()) if self.state.exists() else (None, None, None, None)
        for part in rows:
            top = part.sort_values(["at", "tie"], kind="stable").iloc[-1]
            began = part.loc[part["status"].notna() & (part["status"] != "pending"), "at"].min()
            began = min((int(x) for x in (last[3], began) if pd.notna(x)), default=None)
            if last[1] is None or (int(top["at"]), int(top["tie"])) >= (last[1], last[2]):
                last = (top["status"], int(top["at"]), int(top["tie"]), began)
            else:
                last = (*last[:3], began)
        self.state.update(last)
        if self.stale is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if last[0] not in ENDED:
                self.handle.registerTimer((last[1] + self.stale) // 1000)
        yield self._row(key, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and (last := tuple(self.state.get()))[0] not in ENDED:
            yield self._row(key, last, True)

    @staticmethod
    def _row(key, last, stale: bool) -> pd.DataFrame:
        status, at, _, started = last
        return pd.DataFrame({"key": [key[0]], "status": [status], "started": pd.array([started], "Int64"), "ended": pd.array([at if status in ENDED else None], "Int64"), "stale": [stale]})

    def close(self) -> None:
        pass


def states(changes: DataFrame, key: str, status: str, time: str, ties: str, stale: str | None = None, delay: str = "1 day") -> DataFrame:
    """(key, status, started_at, completed_at, stale) of each batch whenever changes of it arrive, as ``batches.current`` has it of all changes so far.

    Changes are ordered by time and ties (a whole number), not by arrival; those without a time are left out. With ``stale`` (an interval), a
    batch that has not ended and has no change for so long is given once more, marked: then time is that of the changes, and those that come more than ``delay`` late are left out.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = changes.where(F.col(time).isNotNull())
    at = F.unix_micros(F.col(time).cast("timestamp"))
    columns = [F.col(key).alias("key"), F.col(status).alias("status"), at.alias("at"), F.coalesce(F.col(ties).cast("long"), F.lit(-(2**62))).alias("tie")]
    micros = None
    if stale is not None:
        columns.append(F.col(time).cast("timestamp").alias("time"))
        rows = rows.select(*columns).withWatermark("time", delay)
        micros = spark.range(1).select((F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {stale}"))).alias("n")).first().n
    else:
        rows = rows.select(*columns)
    if stale is None:  # without timers, what is kept is an aggregate
        last = rows.groupBy("key").agg(F.max(F.struct("at", "tie", "status")).alias("last"), F.min(F.when(F.col("status") != "pending", F.col("at"))).alias("started"))
        ended = F.when(F.col("last.status").isin(*ENDED), F.col("last.at"))
        found = last.select("key", "last.status", "started", ended.alias("ended"), F.lit(False).alias("stale"))
    else:
        kind = rows.schema["key"].dataType.simpleString()
        found = rows.groupBy("key").transformWithStateInPandas(_Changes(micros), f"key {kind}, status string, started long, ended long, stale boolean", "Update", "EventTime")
    moment = lambda c: F.timestamp_micros(c).cast(changes.schema[time].dataType)
    return found.select(F.col("key").alias(key), "status", moment("started").alias("started_at"), moment("ended").alias("completed_at"), "stale")


def kept(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what a stream updates to a folder, a partition for each micro-batch, then ends; a micro-batch that is done again takes the place of its first try."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_updates(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key of what :func:`kept` has written."""
    names = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("batch", "stale")).alias("last")).select(key, "last.*")
