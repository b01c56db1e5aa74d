"""Streams with a state for each service: pairs of starts and ends, circuit breakers, and an upserted table of alerts.

Rows of a service wait until the watermark has passed them and are then taken in the order of (ts, event_id), so that a
stream gives the rows of the batch operator however its rows arrive; rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from leakdrift.operators import breaker
from leakdrift.operators.snapshots import Versions

WAITING = "at long, event_id long, kind string, success boolean"
#: A step takes the state (two numbers), the time in microseconds, the row's id, kind and success; it gives the new
#: state and the rows that come out.
Step = Callable[[tuple[int, int], int, int, str, bool], tuple[tuple[int, int], list[tuple]]]


class InOrder(StatefulProcessor):
    """Steps through each service's rows in the order of their times; state that is `keep_us` old when its turn comes is forgotten."""

    def __init__(self, step: Step, columns: list[str], start: tuple[int, int], keep_us: int | None) -> None:
        self.step, self.columns, self.start, self.keep_us = step, columns, start, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.state = handle.getValueState("state", "a long, b long, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        known = {t for t in self.handle.listTimers()} if hasattr(self.handle, "listTimers") else set()
        for batch in rows:
            new = list(batch[["at", "event_id", "kind", "success"]].itertuples(index=False, name=None))
            self.waiting.appendList([(int(a), int(i), str(k), bool(s)) for a, i, k, s in new])
            # A timer goes off when the watermark is later than it.
            for at in {int(a) // 1000 for a, *_ in new} - known:
                self.handle.registerTimer(at)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] // 1000 <= end]
        if not due:
            yield pd.DataFrame(columns=self.columns)
            return
        later = rows[len(due) :]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        a, b, last = self.state.get() if self.state.exists() else (*self.start, due[0][0])
        state, out = (a, b), []
        for at, event_id, kind, success in due:
            if self.keep_us is not None and at - last > self.keep_us:
                state = self.start
            state, found = self.step(state, at, event_id, kind, success)
            last = at
            out += [(event_id, key[0], *f) for f in found]
        self.state.update((*state, last))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def in_order(log: DataFrame, step: Step, start: tuple[int, int], more: str, late: str, keep_us: int | None = None) -> DataFrame:
    """Rows (event_id, service, more) that `step` gives for a stream (event_id, service, ts, op_type, success)."""
    at = F.unix_micros(F.col("ts")).alias("at")
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select(F.col("service").cast("long").alias("service"), "event_id", "ts", at, F.col("op_type").alias("kind"), "success").na.drop()
    schema = f"event_id long, service long, {more}"
    columns = [c.split()[0] for c in schema.split(", ")]
    return rows.groupBy("service").transformWithStateInPandas(InOrder(step, columns, start, keep_us), schema, "Append", "eventTime")


def paired(log: DataFrame, start: str = "Read", end: str = "Write", late: str = "10 minutes", keep: int | None = None) -> DataFrame:
    """(end_id, service, start_id, micros): each end with the start that is open for its service, as soon as the watermark allows.

    A later start replaces an open one and an end closes it; a start that has been open for more than `keep` seconds
    without any row of its service is forgotten.
    """

    def step(state: tuple[int, int], at: int, event_id: int, kind: str, success: bool) -> tuple[tuple[int, int], list[tuple]]:
        if kind == start:
            return (event_id, at), []
        if kind != end or state[1] < 0:
            return state, []
        return (-1, -1), [(state[0], at - state[1])]

    found = in_order(log, step, (-1, -1), "start_id long, micros long", late, None if keep is None else keep * 1_000_000)
    return found.withColumnRenamed("event_id", "end_id")


def breaker_states(log: DataFrame, threshold: int = 5, timeout_ms: int = 60_000, late: str = "10 minutes") -> DataFrame:
    """The rows of operators.breaker.breaker_states of a stream."""

    def step(state: tuple[int, int], at: int, event_id: int, kind: str, success: bool) -> tuple[tuple[int, int], list[tuple]]:
        met, outcome, state = breaker.step(state, at, success, threshold, timeout_ms * 1000)
        return state, [(met, outcome, "Open" if state[0] >= threshold else "Closed")]

    return in_order(log, step, (0, -1), "state string, outcome string, after string", late)


def upserted(rows: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps a table of each key's last row: every micro-batch is a version of it, merged once however often it is replayed.

    A batch that Spark runs again after a failure has the number of a version that counts already, or of one that was
    not finished; so neither is merged twice. The table belongs to one checkpoint, whose numbers it has; it is read by Versions(spark, path).current().
    """

    def merge(batch: DataFrame, number: int) -> None:
        table = Versions(batch.sparkSession, path)
        if not table.merge(batch.select("*", F.lit(False).alias("deleted")), keys, order, number):
            # State is only kept of batches that are read.
            batch.write.format("noop").mode("overwrite").save()

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def minute_alerts(log: DataFrame, slow_ms: float = 1000, critical_ms: float = 5000, late: str = "10 minutes") -> DataFrame:
    """(alert, start, n, value, severity): slow operations by the minute, revised as long as rows arrive."""
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where(F.col("duration_ms") > slow_ms)
    rows = rows.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"), F.avg("duration_ms").alias("value"))
    severity = F.when(F.col("value") > critical_ms, "Critical").otherwise("Warning").alias("severity")
    return rows.select(F.lit("slow_operations").alias("alert"), F.col("w.start").alias("start"), "n", "value", severity)
