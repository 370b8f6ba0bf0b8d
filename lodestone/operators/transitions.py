"""Jobs and snapshots as ordered folds of their events.

An event counts only if the state it meets allows it; otherwise it changes nothing and is reported with the reason. The events of a
key are sorted by Spark and pass through a task in their order, of which only the key's state is held, so a key with very many
events costs time but no memory. The same rules run in a stream, with the state in the store.

Events have key, seq, kind and at, and may have fence, value and until. An event whose seq is not beyond the last one of
its key is a repetition; events without a key, seq, kind or time are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that a snapshot and its lease live where none are given, and a job's lease. Fixed values.
SNAPSHOT_TTL, JOB_LEASE = 300, 60
#: Claims of a job before it is dead. Fixed value.
ATTEMPTS = 3


@dataclass(frozen=True)
class Event:
    """One event; ``at`` and ``until`` in microseconds."""

    seq: int
    kind: str
    at: int
    fence: int | None = None
    value: str | None = None
    until: int | None = None


@dataclass(frozen=True)
class Job:
    """What is known of a job after its events so far."""

    status: str | None = None
    fence: int = 0
    attempts: int = 0
    lease: int | None = None
    available: int | None = None
    cancelling: bool = False
    checkpoint: str | None = None
    seq: int | None = None

    @staticmethod
    def columns() -> str:
        return "status string, fence bigint, attempts bigint, lease bigint, available bigint, cancelling boolean, checkpoint string, seq bigint"


@dataclass(frozen=True)
class Snapshot:
    """What is known of an ingest snapshot after its events so far."""

    status: str | None = None
    failure: str | None = None
    expires: int | None = None
    lease: int | None = None
    approved: int | None = None
    seq: int | None = None

    @staticmethod
    def columns() -> str:
        return "status string, failure string, expires bigint, lease bigint, approved bigint, seq bigint"


def job_rules(lease: float = JOB_LEASE, attempts: int = ATTEMPTS, delay: float = 0.001) -> Callable[[Job, Event], Job | str]:
    """What an event makes of a job, or why it doesn't count. A claim raises the fence by one; whoever works must name the fence it was given, before its lease is over."""
    waiting = ("queued", "retry-wait", "blocked-review")
    span, pause = round(lease * 1e6), round(delay * 1e6)
    ended = {"lease": None, "cancelling": False}

    def owned(job: Job, e: Event, stoppable: bool = True) -> str | None:
        """Why the event's sender doesn't own the job."""
        if job.status != "running":
            return f"status {job.status}"
        if e.fence != job.fence:
            return "stale fence"
        if job.lease <= e.at:
            return "lease over"
        return "cancel requested" if stoppable and job.cancelling else None

    def gone(job: Job) -> str:
        """Where a run that failed leads."""
        return "cancelled" if job.cancelling else "dead-letter" if job.attempts >= attempts else "retry-wait"

    def step(job: Job, e: Event) -> Job | str:
        if e.kind == "enqueue":
            return Job("queued", available=e.at) if job.status is None else "exists"
        if job.status is None:
            return "no job"
        if e.kind == "claim":
            lost = job.status == "running" and job.lease <= e.at
            if not lost and job.status not in ("queued", "retry-wait"):
                return f"status {job.status}"
            if not lost and job.available > e.at:
                return "not available"
            if job.attempts >= attempts:
                return "no attempts left"
            if job.cancelling:
                return "cancel requested"
            return replace(job, status="running", fence=job.fence + 1, attempts=job.attempts + 1, lease=e.at + span, available=e.at)
        if e.kind == "recover":
            if job.status != "running" or job.lease > e.at:
                return "nothing to recover"
            to = gone(job)
            return replace(job, status=to, available=e.at + pause if to == "retry-wait" else e.at, **ended)
        if e.kind == "request-cancel":
            return replace(job, cancelling=True) if job.status == "running" and job.lease > e.at else "not running"
        if e.kind == "resume":
            return replace(job, status="queued", available=e.at, cancelling=False) if job.status in ("blocked-review", "retry-wait") else f"status {job.status}"
        if e.kind in ("cancel", "dead-letter") and e.fence is None:
            return replace(job, status="cancelled" if e.kind == "cancel" else e.kind, **ended) if job.status in waiting else f"status {job.status}"
        if e.kind not in ("renew", "checkpoint", "block", "finish", "fail", "cancel", "dead-letter"):
            return "unknown kind"
        if why := owned(job, e, e.kind in ("checkpoint", "block", "finish")):
            return why
        if e.kind == "renew":
            return replace(job, lease=e.at + span)
        if e.kind == "checkpoint":
            return replace(job, checkpoint=e.value)
        if e.kind == "fail":
            to = gone(job)
            return replace(job, status=to, available=e.at + pause if to == "retry-wait" else e.at, **ended)
        to = {"block": "blocked-review", "finish": "succeeded", "cancel": "cancelled", "dead-letter": "dead-letter"}[e.kind]
        return replace(job, status=to, **ended)

    return step


def snapshot_rules(ttl: float = SNAPSHOT_TTL) -> Callable[[Snapshot, Event], Snapshot | str]:
    """What an event makes of a snapshot, or why it doesn't count."""
    span = round(ttl * 1e6)

    def step(snap: Snapshot, e: Event) -> Snapshot | str:
        if e.kind == "prepare":
            return Snapshot("PREPARED", expires=e.at + span) if snap.status is None else "exists"
        if snap.status is None:
            return "no snapshot"
        if snap.status in ("CONSUMED", "FAILED", "EXPIRED"):
            return f"status {snap.status}"
        over = snap.expires <= e.at
        if e.kind == "fail":
            return replace(snap, status="FAILED", failure=e.value or "SYSTEM_ERROR", lease=None)
        if e.kind == "sweep":
            return swept(snap, e.at) or "nothing to sweep"
        if e.kind in ("review", "approve", "reject", "defer"):
            if snap.status != ("PREPARED" if e.kind == "review" else "REVIEW_REQUIRED"):
                return f"status {snap.status}"
            if over:
                return "expired"
            if e.kind == "review":
                return replace(snap, status="REVIEW_REQUIRED")
            if e.kind == "reject":
                return replace(snap, status="FAILED", failure="REVIEW_REJECTED") if snap.approved is None else "approved before"
            return replace(snap, approved=e.until if e.until is not None else snap.expires) if e.kind == "approve" else snap
        if e.kind == "claim":
            if snap.status == "CONSUMING":
                return f"status {snap.status}"
            if over:
                return "expired"
            if snap.status == "REVIEW_REQUIRED" and (snap.approved is None or snap.approved <= e.at):
                return "not approved"
            return replace(snap, status="CONSUMING", lease=e.at + span)
        if e.kind in ("renew", "consume"):
            if snap.status != "CONSUMING":
                return f"status {snap.status}"
            if snap.lease <= e.at:
                return "lease over"
            return replace(snap, lease=e.at + span) if e.kind == "renew" else replace(snap, status="CONSUMED", lease=None)
        return "unknown kind"

    return step


def swept(snap: Snapshot, now: int) -> Snapshot | None:
    """A snapshot whose time is over by now; None for others."""
    if snap.status in ("PREPARED", "REVIEW_REQUIRED") and snap.expires <= now:
        return replace(snap, status="EXPIRED")
    if snap.status == "CONSUMING" and snap.lease <= now:
        return replace(snap, status="FAILED", failure="CLAIM_LEASE_ABANDONED", lease=None)
    return None


def advanced(state, event: Event, step) -> tuple[object, str | None]:
    """The state after an event, and why the event doesn't count if it doesn't."""
    if state.seq is not None and event.seq <= state.seq:
        return state, "repeated"
    found = step(state, event)
    return (replace(state, seq=event.seq), found) if isinstance(found, str) else (replace(found, seq=event.seq), None)


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a time."""
    return F.unix_micros(c.cast("timestamp"))


def prepared(events: DataFrame, key: str = "key") -> DataFrame:
    """key, seq, kind, at, fence, value, until of events that are whole, times as microseconds."""
    other = {"fence": "bigint", "value": "string", "until": "timestamp"}
    rows = events.withColumns({c: F.lit(None).cast(k) for c, k in other.items() if c not in events.columns})
    rows = rows.select(F.col(key).alias("key"), F.col("seq").cast("bigint").alias("seq"), "kind", micros(F.col("at")).alias("at"), F.col("fence").cast("bigint").alias("fence"), F.col("value").cast("string").alias("value"), micros(F.col("until")).alias("until"))
    return rows.dropna(subset=["key", "seq", "kind", "at"])


def fold(events: DataFrame, kind: type[Job] | type[Snapshot], step, key: str = "key", now: Column | None = None) -> DataFrame:
    """One row for each key, with its state, and one for each event that doesn't count (``reason`` is not null), with the state it met. ``now``: snapshots
    whose time is over by then are swept."""
    rows, names = prepared(events, key), [f.name for f in fields(kind)]
    schema = f"key {rows.schema['key'].dataType.simpleString()}, kind string, reason string, {kind.columns()}"
    rows = rows.withColumn("now", micros(now) if now is not None else F.lit(None).cast("bigint"))
    types = [pa.string(), pa.string(), *(pa.bool_() if f.type.startswith("bool") else pa.string() if f.type.startswith("str") else pa.int64() for f in fields(kind))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, moment, key_type = None, kind(), None, None

        def ended() -> tuple:
            last = swept(state, moment) if moment is not None and kind is Snapshot else None
            return (current, None, None, *asdict(last or state).values())

        for batch in batches:
            out, key_type = [], batch.schema.field("key").type
            for name, moment_now, *values in zip(*(batch.column(c).to_pylist() for c in ("key", "now", "seq", "kind", "at", "fence", "value", "until")), strict=True):
                if name != current:
                    if current is not None:
                        out.append(ended())
                    current, state = name, kind()
                moment, event = moment_now, Event(*values)
                state, why = advanced(state, event, step)
                if why:
                    out.append((name, event.kind, why, *asdict(replace(state, seq=event.seq)).values()))
            if out:
                yield made(out, key_type)
        if current is not None:
            yield made([ended()], key_type)

    def made(out: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [key_type, *types], strict=True)], ["key", "kind", "reason", *names])

    return rows.repartition("key").sortWithinPartitions("key", "seq", "at", "kind").mapInArrow(run, schema)


def states(folded: DataFrame) -> DataFrame:
    """The states of a fold."""
    return folded.filter("kind is null").drop("kind", "reason")


def rejected(folded: DataFrame) -> DataFrame:
    """(key, seq, kind, reason): the events of a fold that don't count."""
    return folded.filter("kind is not null").select("key", "seq", "kind", "reason")


class JobProcessor(StatefulProcessor):
    """Jobs in a stream: each batch's events of a job in order, and the job after them. The state of an ended job goes ``keep`` milliseconds after its last event."""

    def __init__(self, lease: float, attempts: int, keep: int):
        self.step, self.keep = job_rules(lease, attempts), keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", Job.columns())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, refused, last = Job(*self.job.get()) if self.job.exists() else Job(), 0, 0
        found = pd.concat(list(rows)).sort_values(["seq", "at"])
        whole = lambda v: None if pd.isna(v) else v
        for row in found.itertuples(index=False):
            event = Event(int(row.seq), row.kind, int(row.at), *(whole(v) if v is None or isinstance(v, str) or pd.isna(v) else int(v) for v in (row.fence, row.value, row.until)))
            state, why = advanced(state, event, self.step)
            refused, last = refused + bool(why), max(last, event.at)
        self.job.update(tuple(asdict(state).values()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state.status in ("succeeded", "cancelled", "dead-letter"):
            self.handle.registerTimer(last // 1000 + self.keep)
        yield pd.DataFrame({"key": [key[0]], "status": [state.status], "fence": [state.fence], "attempts": [state.attempts], "refused": [refused]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, lease: float = JOB_LEASE, attempts: int = ATTEMPTS, keep: int = 86_400_000, delay: str = "1 minute", key: str = "key") -> DataFrame:
    """(key, status, fence, attempts, refused) of jobs as their events arrive. Needs the RocksDB state store. ``refused`` counts the batch's events that don't count."""
    rows = prepared(events, key).withColumn("time", F.timestamp_micros("at")).withWatermark("time", delay)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, status string, fence bigint, attempts bigint, refused bigint"
    return rows.groupBy("key").transformWithStateInPandas(JobProcessor(lease, attempts, keep), schema, "Update", "EventTime")
