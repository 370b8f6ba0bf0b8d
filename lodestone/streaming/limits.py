"""Rate limits and job leases as stateful streams, and the same results as batch plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISIONS = "key string, event_id bigint, ts timestamp, allowed boolean, remaining int"


def fixed_window(times: list[float], limit: int, window: float, state: tuple[int, float] | None = None) -> tuple[list[tuple[bool, int]], tuple[int, float] | None]:
    """Decisions of a limit per window, which begins with the first request after the last one's end: (allowed, remaining)."""
    out = []
    for now in times:
        if state is None or now > state[1]:
            state = (1, now + window)
            out.append((limit >= 1, max(0, limit - 1)))
        elif state[0] >= limit:
            out.append((False, 0))
        else:
            state = (state[0] + 1, state[1])
            out.append((True, limit - state[0]))
    return out, state


def sliding_window(times: list[float], limit: int, window: float, kept: list[float] | None = None) -> tuple[list[tuple[bool, int]], list[float]]:
    """Decisions of a limit over the last ``window``; only allowed requests count."""
    kept, out = list(kept or []), []
    for now in times:
        kept = [t for t in kept if t > now - window]
        allowed = len(kept) < limit
        if allowed:
            kept.append(now)
        out.append((allowed, max(0, limit - len(kept))))
    return out, kept


def _decide(kind: str, limit: int, window: float):
    rule = {"fixed": fixed_window, "sliding": sliding_window}[kind]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        held = None
        if state.exists:
            (values,) = state.get
            held = (int(values[0]), values[1]) if kind == "fixed" else list(values)
        seconds = [t.timestamp() for t in rows.ts]
        out, held = rule(seconds, limit, window, held)
        state.update((list(map(float, held)),))
        # What is older than a window behind the watermark can't matter any more.
        last = int(max(seconds) * 1000 + window * 1000) + 1
        if last > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(last)
        yield pd.DataFrame({"key": key[0], "event_id": rows.event_id, "ts": rows.ts, "allowed": [x[0] for x in out], "remaining": [x[1] for x in out]})

    return run


def limit_stream(events: DataFrame, kind: str, limit: int, window: float, delay: str = "10 minutes") -> DataFrame:
    """Decisions for a stream of (key, event_id, ts). State is a key's open window and goes when the watermark has passed it."""
    rows = events.withWatermark("ts", delay)
    return rows.groupBy("key").applyInPandasWithState(_decide(kind, limit, window), DECISIONS, "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def limit_batch(events: DataFrame, kind: str, limit: int, window: float) -> DataFrame:
    """The decisions of ``limit_stream`` for a finished table. A key's events are sorted by Spark and pass through a task in order; what is
    held is the key's open window, so a hot key costs time but not memory."""
    rule = {"fixed": fixed_window, "sliding": sliding_window}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for batch in batches:
            if batch.empty:
                continue
            keys, seconds, out = batch.key.to_numpy(), batch.ts.to_numpy().astype("datetime64[us]").astype("int64") / 1e6, []
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(starts, starts[1:]):  # the rows of a key at once
                held = held if keys[a] == key else None
                key = keys[a]
                found, held = rule(seconds[a:b].tolist(), limit, window, held)
                out += found
            yield batch.assign(allowed=[x[0] for x in out], remaining=[x[1] for x in out])[["key", "event_id", "ts", "allowed", "remaining"]]

    rows = events.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(run, DECISIONS)


def recent_count(key: str, ts: Column, seconds: int) -> Column:
    """Events of a key in the last seconds, itself included. Times are told apart by milliseconds, rounded half away from the epoch, as written on the clock (no zone shifts them)."""
    elapsed = (ts.cast("timestamp_ntz") - F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("interval second").cast("decimal(20, 6)")
    return F.count("*").over(Window.partitionBy(key).orderBy(F.round(elapsed * 1000, 0).cast("bigint")).rangeBetween(-1000 * seconds + 1, 0))


def windowed(events: DataFrame, size: str, delay: str, **aggregates: Column) -> DataFrame:
    """Aggregates over tumbling windows of event time; in a stream late rows count until the watermark has passed."""
    found = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "key").agg(*(c.alias(n) for n, c in aggregates.items()))
    return found.select(F.col("window.start").alias("start"), "key", *aggregates)


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions of a key, which end after a gap."""
    found = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "key").agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), "key", "n")


def _lease(seconds: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (attempts, status) = state.get
            state.remove()
            if status == "running":
                yield pd.DataFrame({"job_id": [key[0]], "status": ["lease-expired"], "attempts": [attempts]})
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        attempts, status = state.get if state.exists else (0, "queued")
        until = None
        for kind, t in zip(rows.kind, rows.ts, strict=True):
            attempts += kind == "claim"
            status = {"claim": "running", "finish": "done", "fail": "retry-wait", "enqueue": "queued", "heartbeat": status}.get(kind, kind)
            until = t.timestamp() + seconds
        state.update((int(attempts), status))
        if status == "running":
            state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [int(attempts)]})

    return run


def job_stream(events: DataFrame, lease: float, delay: str = "1 minute") -> DataFrame:
    """(job_id, status, attempts) as job events (job_id, seq, kind, ts) arrive; a running job whose lease the watermark passes has expired."""
    rows = events.withWatermark("ts", delay)
    return rows.groupBy("job_id").applyInPandasWithState(_lease(lease), "job_id bigint, status string, attempts int", "attempts int, status string", "append", GroupStateTimeout.EventTimeTimeout)
