"""Catalogue versions, ordered folds in a table and in a stream, and ingests that end as one."""

import datetime
import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lifecycle, transitions
from lodestone.operators.publication import Catalogue, Conflict, Refused
from lodestone.operators.transitions import Event, Job, Snapshot
from lodestone.plans import lifecycle as plans

SF = "/root/testdata/sf0.001"
EVENTS = "key int, seq long, kind string, at timestamp, fence long, value string, until timestamp"


def at(second: float) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def log(spark, rows):
    """(key, seq, kind, second, and maybe fence, value, until)."""
    full = [(k, s, kind, at(t), *(list(rest) + [None] * 3)[:2], at(rest[2]) if len(rest) > 2 else None) for k, s, kind, t, *rest in rows]
    return spark.createDataFrame(full, EVENTS)


def test_one_of_many_publishers_wins(spark, tmp_path):
    won, lost = [], []
    first = Catalogue(spark, str(tmp_path / "c"))
    rows = spark.range(3)
    first.publish(0, {"a": rows, "b": rows})

    def publish(n):
        try:
            won.append(first.commit(1, {"a": [first.stage("a", spark.range(n))]}))
        except Conflict:
            lost.append(n)

    threads = [threading.Thread(target=publish, args=(n,)) for n in range(4, 9)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won == [2] and len(lost) == 4 and first.version() == 2
    assert first.read("a", 1).count() == 3 and first.read("a").count() >= 4
    with pytest.raises(KeyError):
        first.read("b")
    for bad, why in ((lambda: first.publish(2, {"a": rows.limit(0)}), "empty"), (lambda: first.publish(2, {"a": rows}, expected={"a": 4}), "has 3 rows, not 4")):
        with pytest.raises(Refused, match=why):
            bad()
    assert first.version() == 2 and first.publish(2, {"a": rows.limit(0)}, allow_empty=True) == 3
    assert [(r.version, r.status) for r in first.history().orderBy("version").collect()] == [(1, "retired"), (2, "retired"), (3, "published")]
    assert len(first.collect_garbage(0, age=-10)) >= 8 and first.read("a").count() == 0
    assert [r.version for r in first.history().collect()] == [3]


def plain(rows, state, step):
    """A fold in plain Python: states and refused events."""
    out, refused = {}, []
    for key, seq, kind, t, *rest in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2])):
        fence, value, until = (list(rest) + [None] * 3)[:3]
        micro = lambda s: None if s is None else (at(s) - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
        now = out.get(key, state())
        now, why = transitions.advanced(now, Event(seq, kind, micro(t), fence, value, micro(until)), step)
        out[key] = now
        if why:
            refused.append((key, seq, kind, why))
    return out, refused


def test_jobs_step_by_step():
    step = transitions.job_rules(lease=60, attempts=2, delay=5)
    s = 10**6

    def run(*events):
        job, told = Job(), []
        for n, (kind, t, *rest) in enumerate(events):
            job, why = transitions.advanced(job, Event(n, kind, round(t * s), *rest), step)
            told.append(why)
        return job, told

    job, told = run(("claim", 0), ("enqueue", 1), ("enqueue", 2), ("claim", 3), ("checkpoint", 4, 1, "half"), ("finish", 5, 2), ("renew", 60, 1), ("checkpoint", 119, 1, "most"), ("finish", 121, 1))
    assert told == ["no job", None, "exists", None, None, "stale fence", None, None, "lease over"] and (job.status, job.checkpoint, job.fence) == ("running", "most", 1)
    # The one that took over has the next fence; the first can't overwrite it.
    job, told = run(("enqueue", 0), ("claim", 0), ("claim", 30), ("claim", 60), ("finish", 61, 1), ("finish", 61, 2))
    assert told == [None, None, "status running", None, "stale fence", None] and job.status == "succeeded" and job.attempts == 2
    job, told = run(("enqueue", 0), ("claim", 0), ("fail", 1, 1), ("claim", 3), ("claim", 6), ("fail", 7, 2), ("claim", 99))
    assert told == [None, None, None, "not available", None, None, "status dead-letter"] and job.status == "dead-letter"
    job, told = run(("enqueue", 0), ("claim", 0), ("request-cancel", 1), ("checkpoint", 2, 1), ("finish", 2, 1), ("fail", 3, 1))
    assert told == [None, None, None, "cancel requested", "cancel requested", None] and job.status == "cancelled"
    job, told = run(("enqueue", 0), ("claim", 0), ("block", 1, 1), ("resume", 2), ("dead-letter", 3), ("resume", 4))
    assert told == [None] * 5 + ["status dead-letter"] and job.status == "dead-letter"
    job, told = run(("enqueue", 0), ("claim", 0), ("recover", 59), ("recover", 60), ("cancel", 61), ("nonsense", 62))
    assert told == [None, None, "nothing to recover", None, None, "unknown kind"] and job.status == "cancelled"


def test_snapshots_refuse_what_the_state_does_not_allow(spark):
    hour = 3600
    rows = [
        (1, 1, "prepare", 0), (2, 1, "prepare", 0), (2, 2, "claim", 100), (3, 1, "prepare", 0), (3, 2, "claim", 10), (3, 3, "renew", 250), (4, 1, "prepare", 0), (4, 2, "claim", 10), (4, 3, "renew", 3 * hour),
        (5, 1, "consume", 1), (5, 2, "prepare", 2), (5, 3, "consume", 3), (6, 1, "prepare", 0), (6, 2, "claim", 2 * hour), (7, 1, "prepare", 300), (7, 2, "review", 301), (7, 3, "claim", 302), (7, 4, "approve", 303, None, None, 350), (7, 5, "claim", 351),
        (8, 1, "prepare", 300), (8, 2, "review", 301), (8, 3, "approve", 303, None, None, 350), (8, 4, "reject", 304), (8, 5, "claim", 305), (8, 6, "consume", 306), (8, 7, "fail", 307), (9, 1, "prepare", 300), (9, 2, "review", 301), (9, 3, "reject", 302), (9, 4, "approve", 303),
    ]
    folded = transitions.fold(log(spark, rows), Snapshot, transitions.snapshot_rules(300), now=F.timestamp_seconds(F.lit(int(at(400).timestamp()))))
    found = {r.key: (r.status, r.failure) for r in transitions.states(folded).collect()}
    assert found == {1: ("EXPIRED", None), 2: ("FAILED", "CLAIM_LEASE_ABANDONED"), 3: ("CONSUMING", None), 4: ("FAILED", "CLAIM_LEASE_ABANDONED"), 5: ("PREPARED", None) if at(302) > at(400) else ("EXPIRED", None), 6: ("EXPIRED", None), 7: ("REVIEW_REQUIRED", None), 8: ("CONSUMED", None), 9: ("FAILED", "REVIEW_REJECTED")}
    refused = {(r.key, r.seq): r.reason for r in transitions.rejected(folded).collect()}
    assert refused == {(4, 3): "lease over", (5, 1): "no snapshot", (5, 3): "status PREPARED", (6, 2): "expired", (7, 3): "not approved", (7, 5): "not approved", (8, 4): "approved before", (8, 7): "status CONSUMED", (9, 4): "status FAILED"}


def random_log(seed):
    rnd = random.Random(seed)
    kinds = ["claim", "claim", "checkpoint", "renew", "fail", "block", "resume", "finish", "recover", "request-cancel", "cancel", "dead-letter"]
    rows = []
    for key in range(60):
        t = 0
        for seq in range(rnd.randint(1, 25)):
            t += rnd.choice([1, 5, 50])
            kind = "enqueue" if seq == 0 else rnd.choice(kinds)
            rows.append((key, seq, kind, t, rnd.choice([None, 1, 1, 2, 3]), "c" if kind == "checkpoint" else None))
    rows += rows[5:9]
    return rows


def test_folds_equal_plain_python_and_odd_events_are_left_out(spark):
    rows, step = random_log(3), transitions.job_rules(60, 3, 0.001)
    expected, refused = plain(rows, Job, step)
    odd = spark.createDataFrame([(None, 1, "claim", at(0), None, None, None), (1, None, "claim", at(0), None, None, None), (1, 99, None, at(0), None, None, None), (1, 99, "claim", None, None, None, None)], EVENTS)
    folded = transitions.fold(log(spark, rows).unionByName(odd).repartition(5), Job, step).cache()
    names = list(Job.__dataclass_fields__)
    assert {r.key: tuple(r[n] for n in names) for r in transitions.states(folded).collect()} == {k: tuple(getattr(v, n) for n in names) for k, v in expected.items()}
    assert sorted(tuple(r) for r in transitions.rejected(folded).collect()) == sorted(refused)
    assert {r.status for r in transitions.states(folded).collect()} >= {"running", "succeeded", "cancelled", "dead-letter", "queued"}
    assert transitions.fold(log(spark, rows).limit(0), Job, step).count() == 0


def test_jobs_in_a_stream_equal_the_fold(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = random_log(8)
    rows.sort(key=lambda r: (r[3], r[0], r[1]))
    for n, part in enumerate((rows[:200], rows[200:450], rows[450:])):
        log(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = transitions.job_stream(stream, 60, 3, keep=10**9).writeStream.format("memory").queryName("jobs_seen").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    seen = {}
    for r in spark.table("jobs_seen").collect():  # rows of a key come in the order of their batches
        seen[r.key] = (r.status, r.fence, r.attempts, seen.get(r.key, (0,) * 4)[3] + r.refused)
    expected, refused = plain(rows, Job, transitions.job_rules(60, 3, 0.001))
    counts = {k: sum(x[0] == k for x in refused) for k in expected}
    assert seen == {k: (v.status, v.fence, v.attempts, counts[k]) for k, v in expected.items()}


def test_state_of_ended_jobs_goes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log(spark, [(1, 1, "enqueue", 0), (1, 2, "cancel", 1), (2, 1, "enqueue", 0)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    for rows in ([(3, 1, "enqueue", 1000)], [(4, 1, "enqueue", 1001)], [(1, 3, "resume", 1002)]):
        log(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        writer = transitions.job_stream(stream, keep=60_000).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")))
        query = writer.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    held = spark.read.parquet(str(tmp_path / "out")).filter("key = 1").orderBy(F.desc("status")).collect()
    # Job 1 was cancelled; its state has gone with the watermark, so what comes later meets no job.
    assert [(r.status, r.refused) for r in held] == [("cancelled", 0), (None, 1)]


def test_an_ingest_ends_as_one_or_not_at_all(spark, tmp_path):
    catalogue = Catalogue(spark, str(tmp_path / "c"))
    jobs = log(spark, [(1, 1, "enqueue", 0), (1, 2, "claim", 1), (2, 1, "enqueue", 0)])
    snapshots = log(spark, [(5, 1, "prepare", 0), (5, 2, "claim", 1), (6, 1, "prepare", 0)])
    rows = {"documents": spark.range(4)}
    for job, fence, snapshot, second, why in ((1, 2, 5, 10, "stale fence"), (1, 1, 5, 62, "lease over"), (1, 1, 6, 10, "status PREPARED"), (2, 0, 5, 10, "status queued")):
        with pytest.raises(Refused, match=why):
            lifecycle.complete_ingest(catalogue, 0, rows, jobs, snapshots, job, fence, snapshot, str(at(second)))
    assert catalogue.version() == 0
    assert lifecycle.complete_ingest(catalogue, 0, rows, jobs, snapshots, 1, 1, 5, str(at(10)), {"documents": 4}) == 1
    with pytest.raises(Conflict):
        lifecycle.complete_ingest(catalogue, 0, rows, jobs, snapshots, 1, 1, 5, str(at(10)))
    assert {r.key: r.status for r in transitions.states(transitions.fold(catalogue.read("jobs"), Job, transitions.job_rules())).collect()} == {1: "succeeded", 2: "queued"}
    more = lifecycle.complete_ingest(catalogue, 1, rows, jobs, snapshots, 1, 1, 5, str(at(10)), aborted="SYSTEM_ERROR")
    assert more == 2 and catalogue.read("documents").count() == 4
    state = transitions.states(transitions.fold(catalogue.read("snapshots"), Snapshot, transitions.snapshot_rules())).filter("key = 5").first()
    assert (state.status, state.failure) == ("FAILED", "SYSTEM_ERROR")


def test_the_queries_see_all_kinds_of_ends(spark):
    found = plans.jobs_fenced(spark, SF).collect()
    assert {r.status for r in found} >= {"queued", "running", "succeeded", "retry-wait"} and sum(r.stale for r in found) > 0


def test_idle_keys_leave_the_store_of_a_rate_limit(spark, tmp_path):
    """Every user's events of the test table through the stream limiter, a week at a time: what is held is bounded by who was active lately, and an event that is later than the watermark is not decided again."""
    from lodestone.streaming import limits

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    day = F.dayofmonth("ts")
    late = events.filter(day == 2).limit(1).withColumn("event_id", F.lit(10**9).cast("bigint"))
    last = spark.sql("select 'nobody' as key, 2000000000L as event_id, timestamp'2024-03-01 00:00:00' as ts")
    held, sizes = [], []
    for n, part in enumerate((events.filter(day <= 10), events.filter((day > 10) & (day <= 20)), events.filter(day > 20).unionByName(late), last)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        writer = limits.limit_stream(stream, "sliding", 3, 3600).writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")))
        query = writer.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        progress = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        sizes.append(progress[-1])
        held.append(part.select("key").distinct().count())
    decided = spark.read.parquet(str(tmp_path / "out"))
    # Of ten days' users those of the last hour are held, and none but the last one's at the end.
    assert all(size < users / 2 for size, users in zip(sizes[:3], held[:3], strict=True)) and sizes[3] <= 1
    assert decided.filter("event_id = 1000000000").count() == 0
    one = {(r.event_id, r.allowed, r.remaining) for r in decided.filter("event_id < 1000000000").collect()}
    assert one == {(r.event_id, r.allowed, r.remaining) for r in limits.limit_batch(events, "sliding", 3, 3600).collect()}


def test_recent_events_are_counted_by_rounded_milliseconds_in_any_zone(spark):
    """Microseconds round as in the SQL (half away from the epoch), and a session's zone with a changed clock moves nothing."""
    from lodestone.streaming import limits

    rows = [(1, "2024-03-10 01:30:00"), (2, "2024-03-10 02:30:00"), (4, "2024-03-11 01:45:00"), (5, "2024-03-11 02:29:59.9999"), (6, None), (11, "1969-12-30 23:59:59.9999"), (14, "1969-12-31 00:00:00.0002"), (10, "1969-12-31 23:59:59.9995"), (13, "1970-01-02 00:00:00")]
    want = {1: 1, 2: 2, 4: 2, 5: 2, 6: 1, 11: 2, 14: 2, 10: 3, 13: 1}
    events = spark.createDataFrame(rows, "event_id int, at string").select("event_id", F.lit(7).alias("user_id"), F.col("at").cast("timestamp_ntz").alias("ts"))
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert {r.event_id: r.recent for r in events.select("event_id", limits.recent_count("user_id", F.col("ts"), 86400).alias("recent")).collect()} == want
