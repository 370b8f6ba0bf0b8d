"""Publication, jobs and ingests whose steps may be refused."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.io import scratch_dir, table, written
from lodestone.operators import lifecycle as L
from lodestone.operators import transitions as T
from lodestone.operators.publication import Catalogue, Conflict, Refused
from lodestone.plans.book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


def _catalogue(spark: SparkSession, label: str) -> Catalogue:
    return Catalogue(spark, f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}")


_KINDS = ["claim", "claim", "checkpoint", "renew", "fail", "claim", "block", "resume", "finish", "recover", "request-cancel", "cancel", "claim"]
_DAY = 86_400_000_000
_JOBS = f"""e as (select user_id * 6 + event_id % 6 as k, event_id as seq, {_KINDS}[(event_id // 6) % 13 + 1] as kind0, epoch_us(ts) as moment, case when event_id % 5 <> 0 then 1 + (event_id // 6) % 2 end as token from events),
    o as (select k, seq, moment, token, row_number() over w as n, case when row_number() over w = 1 then 'enqueue' else kind0 end as kind from e window w as (partition by k order by seq))"""


def job_events(spark: SparkSession, d: str) -> DataFrame:
    """Six jobs for each user, from all events; the first event of a job enqueues it."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.floor(F.col("event_id") / 6) % 13 + 1).cast("int"))
    token = F.when(F.col("event_id") % 5 != 0, 1 + F.floor(F.col("event_id") / 6) % 2)
    rows = table(spark, d, "events").select((F.col("user_id") * 6 + F.col("event_id") % 6).alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").alias("at"), token.alias("fence"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("seq")) == 1
    return rows.withColumn("kind", F.when(first, "enqueue").otherwise(F.col("kind")))


@book.query(f"""with recursive {_JOBS}, r as (select distinct k, 0::bigint as n, null::varchar as status, 0::bigint as fence, 0::bigint as attempts, null::bigint as lease, null::bigint as available, false as cancelling, 0 as refused, 0 as stale from o union all
    select k, n, case when why is not null then status when kind = 'enqueue' or kind = 'resume' then 'queued' when kind = 'claim' then 'running' when kind in ('recover', 'fail') then gone when kind = 'block' then 'blocked-review' when kind = 'finish' then 'succeeded' when kind = 'cancel' then 'cancelled' else status end,
        fence + (why is null and kind = 'claim')::int, attempts + (why is null and kind = 'claim')::int, case when why is not null then lease when kind in ('claim', 'renew') then moment + 8 * {_DAY} when kind in ('recover', 'fail', 'block', 'finish', 'cancel') then null else lease end,
        case when why is not null then available when kind in ('enqueue', 'claim', 'resume') then moment when kind in ('recover', 'fail') then moment + case when gone = 'retry-wait' then 1000 else 0 end else available end, case when why is not null then cancelling when kind = 'request-cancel' then true when kind in ('enqueue', 'resume', 'recover', 'fail', 'block', 'finish', 'cancel') then false else cancelling end,
        refused + (why is not null)::int, stale + coalesce(why = 'stale', false)::int
    from (select r.*exclude (n), o.n, kind, moment, case when cancelling then 'cancelled' when attempts >= 3 then 'dead-letter' else 'retry-wait' end as gone, case when kind = 'enqueue' then case when status is not null then 'exists' end when status is null then 'no job'
            when kind = 'claim' then case when not (status = 'running' and lease <= moment) and status not in ('queued', 'retry-wait') then 'status' when not (status = 'running' and lease <= moment) and available > moment then 'not available' when attempts >= 3 then 'no attempts' when cancelling then 'cancel' end
            when kind = 'recover' then case when status <> 'running' or lease > moment then 'nothing' end when kind = 'request-cancel' then case when status <> 'running' or lease <= moment then 'not running' end when kind = 'resume' then case when status not in ('blocked-review', 'retry-wait') then 'status' end
            when kind = 'cancel' and token is null then case when status not in ('queued', 'retry-wait', 'blocked-review') then 'status' end
            else case when status <> 'running' then 'status' when token is distinct from fence then 'stale' when lease <= moment then 'lease over' when cancelling and kind in ('checkpoint', 'block', 'finish') then 'cancel' end end as why from r join o on o.k = r.k and o.n = r.n + 1))
    select k as job_id, status, fence, attempts, cancelling, refused::bigint as refused, stale::bigint as stale from (select *, row_number() over (partition by k order by n desc) as last from r) where last = 1""")
def jobs_fenced(spark: SparkSession, d: str) -> DataFrame:
    """Every job folded in the order of its events, with fences, leases and attempts; events that don't count are refused and counted."""
    found = written(T.fold(job_events(spark, d), T.Job, T.job_rules(8 * 86400)), "jobs")
    refused = T.rejected(found).groupBy("key").agg(F.count("*").alias("refused"), F.count_if(F.col("reason") == "stale fence").alias("stale"))
    nothing = [F.coalesce(c, F.lit(0)).alias(c) for c in ("refused", "stale")]
    return T.states(found).join(refused, "key", "left").select(F.col("key").alias("job_id"), "status", "fence", "attempts", "cancelling", *nothing)


@book.query("""select 1 as version, 'retired' as status, 'published' as outcome, (select count(*) from orders where o_orderkey % 4 = 0) as orders, (select count(*) from lineitem where l_orderkey % 4 = 0) as lines
    union all select 2, 'retired', 'published', (select count(*) from orders where o_orderkey % 4 = 1), (select count(*) from lineitem where l_orderkey % 4 = 1)
    union all select 2, null, 'conflict', null, null union all select 2, null, 'refused', null, null
    union all select 3, 'published', 'published', (select count(*) from orders where o_orderkey % 4 in (1, 2)), (select count(*) from lineitem where l_orderkey % 4 in (1, 2))""")
def publish_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Two publishers that have seen the same version: one wins, the other adds its rows to the winner's; an empty build is refused. Every version has both its tables."""
    catalogue, told = _catalogue(spark, "publish"), []
    part = lambda *k: {"orders": table(spark, d, "orders").filter(F.col("o_orderkey").bitwiseAND(3).isin(*k)), "lines": table(spark, d, "lineitem").filter(F.col("l_orderkey").bitwiseAND(3).isin(*k))}
    catalogue.publish(0, part(0))
    seen = catalogue.version()
    catalogue.publish(seen, part(1))
    try:
        catalogue.publish(seen, part(2))
    except Conflict:
        told.append((2, "conflict"))
    try:
        catalogue.publish(catalogue.version(), part(9))
    except Refused:
        told.append((2, "refused"))
    catalogue.retried(lambda v: catalogue.publish(v, {name: catalogue.read(name, v).unionByName(rows) for name, rows in part(2).items()}))
    counts = [c.agg(F.lit(v).alias("version"), F.count("*").alias(name)) for v in (1, 2, 3) for name in ("orders", "lines") for c in [catalogue.read(name, v)]]
    pairs = [a.join(b, "version") for a, b in zip(counts[::2], counts[1::2], strict=True)]
    good = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).join(catalogue.history().select("version", "status"), "version").withColumn("outcome", F.lit("published"))
    return good.unionByName(spark.createDataFrame(told, "version int, outcome string"), allowMissingColumns=True)


@book.query("""select * from (values ('stale fence', null), ('lease over', null), ('wrong count', null)) t(outcome, documents) union all select 'published', (select count(*) from documents) union all select 'visible before', 0
    union all select 'succeeded', (select count(*) from documents) union all select 'CONSUMED', (select count(*) from documents)""")
def ingest_completion(spark: SparkSession, d: str) -> DataFrame:
    """An ingest of all documents that ends as one: a stale fence, a lease that is over or a wrong count leave nothing behind; the last try publishes documents, job and snapshot together."""
    catalogue, docs = _catalogue(spark, "ingest"), table(spark, d, "documents")
    n, told = docs.count(), []
    make = lambda rows: spark.createDataFrame(rows, "key string, seq int, kind string, at string, fence bigint").withColumn("at", F.col("at").cast("timestamp"))
    jobs = make([("j", 1, "enqueue", "2024-01-01 00:00:00", None), ("j", 2, "claim", "2024-01-01 00:00:01", None), ("j", 3, "recover", "2024-01-01 00:05:00", None), ("j", 4, "claim", "2024-01-01 00:06:00", None)])
    snapshots = make([("s", 1, "prepare", "2024-01-01 00:05:00", None), ("s", 2, "claim", "2024-01-01 00:06:00", None)])
    for fence, at, expected, name in ((1, "2024-01-01 00:06:30", n, "stale fence"), (2, "2024-01-01 00:09:00", n, "lease over"), (2, "2024-01-01 00:06:30", n + 1, "wrong count")):
        try:
            L.complete_ingest(catalogue, 0, {"documents": docs}, jobs, snapshots, "j", fence, "s", at, {"documents": expected})
        except Refused as why:
            told.append((name if name in str(why) or name == "wrong count" else str(why), None))
    told.append(("visible before", catalogue.version()))
    L.complete_ingest(catalogue, 0, {"documents": docs}, jobs, snapshots, "j", 2, "s", "2024-01-01 00:06:30", {"documents": n})
    count = catalogue.read("documents").agg(F.count("*").alias("documents"))
    done = [T.states(T.fold(catalogue.read(name), kind, rules)).select(F.col("status").alias("outcome")) for name, kind, rules in (("jobs", T.Job, T.job_rules()), ("snapshots", T.Snapshot, T.snapshot_rules()))]
    done.append(spark.createDataFrame([("published",)], "outcome string"))
    found = done[0].unionByName(done[1]).unionByName(done[2]).crossJoin(F.broadcast(count))
    return found.unionByName(spark.createDataFrame(told, "outcome string, documents bigint"))
