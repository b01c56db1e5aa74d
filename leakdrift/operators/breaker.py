"""Replay of circuit breakers over a log of calls.

A breaker's state after a call follows from the state before it, so that one service's log is a chain. The log is cut
into chunks of time; each becomes a function of the state before it, worked out once for every state that there can be;
the functions of a service are applied in order, one step for each chunk; and the chunks are replayed from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "struct<n:int,since:long>"
SUMMARY = f"service long, chunk long, closed array<{STATE}>, wakes array<struct<until:long,n:int,since:long>>"
STATES = "event_id long, service long, state string, outcome string, after string"

State = tuple[int, int]
#: Rows that a task gives at once, about: chunks can be small.
FRAME = 5_000


def step(state: State, at: int, success: bool, threshold: int, timeout: int) -> tuple[str, str, State]:
    """What a call meets and comes to, and the state after it: failures in a row up to the threshold, and the last one's time.

    At the threshold the breaker is open. It rejects calls until more than the timeout has gone by since the last
    failure; the next call is let through half-open, and closes it or opens it again.
    """
    n, since = state
    if n >= threshold and at - since <= timeout:
        return "Open", "rejected", state
    met = "HalfOpen" if n >= threshold else "Closed"
    if success:
        return met, "ok", (0, -1)
    n = min(n + 1, threshold)
    return met, "opened" if n >= threshold else "failed", (n, at)


def summary(at: np.ndarray, success: np.ndarray, threshold: int, timeout: int) -> tuple[list[State], list[tuple[int, int, int]]]:
    """A chunk as a function of the state before it.

    The state after it for each number of failures below the threshold; and for an open breaker, which depends on the
    first call that is let through: the times up to which the same state comes out, with that state. Worked out from
    the last call to the first.
    """
    m = len(at)
    woken = np.searchsorted(at, at + timeout, side="right").tolist()
    times, good = at.tolist(), success.tolist()
    closed: list[State] = [(c, -1) for c in range(threshold)]
    let_through: list[State] = [(0, -1)] * m
    for k in reversed(range(m)):
        if good[k]:
            after, closed = closed[0], [closed[0]] * threshold
        else:
            after = let_through[woken[k]] if woken[k] < m else (threshold, times[k])
            closed = [*closed[1:], after]
        let_through[k] = after
    wakes: list[tuple[int, int, int]] = []
    for k in range(m):
        if wakes and wakes[-1][1:] == let_through[k]:
            wakes[-1] = (times[k], *let_through[k])
        else:
            wakes.append((times[k], *let_through[k]))
    return closed, wakes


def applied(state: State, closed: list, wakes: list, threshold: int, timeout: int) -> State:
    n, since = state
    if n < threshold:
        out = closed[n]
        return out["n"], out["since"]
    for w in wakes:
        if w["until"] > since + timeout:
            return w["n"], w["since"]
    return state


def runs_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of sorted batches' rows with equal keys, whole though batches cut them."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        cuts = np.flatnonzero((rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(1)) + 1
        ends = [0, *cuts.tolist()]
        for a, b in zip(ends, ends[1:], strict=False):
            yield rows.iloc[a:b]
        rest = rows.iloc[ends[-1] :]
    if rest is not None and len(rest):
        yield rest


def breaker_states(log: DataFrame, threshold: int = 5, timeout_ms: int = 60_000, chunk_s: int = 3600) -> DataFrame:
    """(event_id, service, ts, success) to (event_id, service, state, outcome, after), one row for each call.

    `state` is what the call meets (Closed, Open, HalfOpen), `outcome` ok, failed, opened or rejected, `after` the state
    it leaves (Closed, Open). Calls at the same time go by event_id. Services are whole numbers. A service's calls of
    `chunk_s` seconds lie in one task, its whole log does not; of each chunk one row goes to the service's task. Rows
    with a null among the four columns are left out, since they have no place in the order; an empty log has no rows.
    """
    timeout = timeout_ms * 1000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.select("event_id", F.col("service").cast("long").alias("service"), at.alias("at"), "success").na.drop()
    rows = rows.withColumn("chunk", F.floor(F.col("at") / (chunk_s * 1_000_000)))

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, out = ["service", "chunk", "closed", "wakes"], []
        for rows in runs_of(batches, ["service", "chunk"]):
            closed, wakes = summary(rows["at"].to_numpy(), rows["success"].to_numpy(dtype=bool), threshold, timeout)
            named = [{"n": n, "since": s} for n, s in closed], [{"until": u, "n": n, "since": s} for u, n, s in wakes]
            out.append((rows["service"].iloc[0], rows["chunk"].iloc[0], *named))
            if len(out) >= FRAME:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    def before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, (0, -1)
        for batch in batches:
            out = []
            for service, chunk, closed, wakes in batch.itertuples(index=False):
                if service != last:
                    last, state = service, (0, -1)
                out.append((service, chunk, *state))
                state = applied(state, closed, wakes, threshold, timeout)
            yield pd.DataFrame(out, columns=["service", "chunk", "n", "since"])

    def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, out = ["event_id", "service", "state", "outcome", "after"], []
        for rows in runs_of(batches, ["service", "chunk"]):
            state = (int(rows["n"].iloc[0]), int(rows["since"].iloc[0]))
            for event_id, service, when, success in zip(rows["event_id"], rows["service"], rows["at"].tolist(), rows["success"].tolist(), strict=True):
                met, outcome, state = step(state, when, success, threshold, timeout)
                out.append((event_id, service, met, outcome, "Open" if state[0] >= threshold else "Closed"))
            if len(out) >= FRAME:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    dealt = rows.repartition("service", "chunk").sortWithinPartitions("service", "chunk", "at", "event_id")
    found = dealt.mapInPandas(summaries, SUMMARY)
    found = found.repartition("service").sortWithinPartitions("service", "chunk").select("service", "chunk", "closed", "wakes")
    states = found.mapInPandas(before, "service long, chunk long, n int, since long")
    dealt = rows.join(states, ["service", "chunk"]).repartition("service", "chunk").sortWithinPartitions("service", "chunk", "at", "event_id")
    return dealt.select("event_id", "service", "chunk", "at", "success", "n", "since").mapInPandas(replayed, STATES)
