"""Generations, builds, file versions, jobs and freshness as folds and joins over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.io import small
from lodestone.operators.publication import Catalogue, Refused
from lodestone.operators.relational import first_of


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins: the newest row of each key."""
    return first_of(existing.unionByName(incoming), keys, F.desc(version))


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def processing_decision(state: DataFrame, now: DataFrame) -> DataFrame:
    """(path, decision): process what is new or changed (content or profile), repair what lacks chunks or embeddings, skip the
    rest. ``state``: path, hash, profile, chunks, embeddings; ``now``: path, hash, profile."""
    old = state.select("path", F.col("hash").alias("_h"), F.col("profile").alias("_p"), "chunks", "embeddings")
    same = F.col("hash").eqNullSafe(F.col("_h")) & F.col("profile").eqNullSafe(F.col("_p"))
    lacking = (F.coalesce("chunks", F.lit(0)) == 0) | (F.coalesce("embeddings", F.lit(0)) < F.coalesce("chunks", F.lit(0)))
    return now.join(old, "path", "left").select("path", F.when(~same, "process").when(lacking, "repair").otherwise("skip").alias("decision"))


def source_gate(rows: DataFrame, source: str, failed: str) -> DataFrame:
    """Rows of sources in which nothing failed; one failed file blocks its source."""
    bad = rows.filter(failed).select(source).distinct()
    return rows.join(bad, source, "left_anti")


def publish_problems(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, expected: int) -> DataFrame:
    """(problem, n): what keeps a generation from being published. ``documents``: document_id, content, hash; ``chunks``: chunk_id,
    document_id, chunk_index, content, enabled; ``embeddings``: chunk_id, input_hash."""
    ordered = chunks.groupBy("document_id").agg(F.max("chunk_index").alias("top"), F.countDistinct("chunk_index").alias("n"))
    inputs = chunks.select("chunk_id", F.sha2(F.substring("content", 1, 2000), 256).alias("wanted"))
    vectors = embeddings.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("input_hash").alias("input_hash"))
    checks = [
        documents.agg(F.lit("document-count").alias("problem"), F.abs(F.count("*") - expected).alias("n")),
        documents.filter(~F.col("hash").rlike("^[0-9a-f]{64}$")).agg(F.lit("hash-shape").alias("problem"), F.count("*").alias("n")),
        documents.filter(~F.col("hash").eqNullSafe(F.sha2("content", 256))).agg(F.lit("content-hash").alias("problem"), F.count("*").alias("n")),
        chunks.filter(~F.col("enabled")).agg(F.lit("disabled-chunk").alias("problem"), F.count("*").alias("n")),
        documents.join(chunks, "document_id", "left_anti").agg(F.lit("no-chunk").alias("problem"), F.count("*").alias("n")),
        ordered.filter(F.col("top") + 1 != F.col("n")).agg(F.lit("chunk-gap").alias("problem"), F.count("*").alias("n")),
        inputs.join(vectors, "chunk_id", "left").filter(~F.col("n").eqNullSafe(F.lit(1))).agg(F.lit("embedding-count").alias("problem"), F.count("*").alias("n")),
        inputs.join(vectors, "chunk_id").filter(F.col("wanted") != F.col("input_hash")).agg(F.lit("embedding-input").alias("problem"), F.count("*").alias("n")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.select("problem", F.col("n").cast("bigint").alias("n"))


POINTERS = "source_id string, generation_id string, published_at timestamp"


class GenerationStore:
    """Immutable generations of sources in a folder, and a pointer to the published one of each.

    A generation is a partition folder that is written once; the pointers are a table of a catalogue, whose commit is the commit point."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.catalogue = Catalogue(spark, f"{self.root}/pointers")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def stage(self, rows: DataFrame, source: str, generation: str) -> None:
        """Writes a generation; one that is there is left as it is, since it is immutable."""
        path = f"{self.root}/generations/source_id={source}/generation_id={generation}"
        if not self._exists(f"{path}/_SUCCESS"):
            rows.drop("source_id", "generation_id").write.mode("overwrite").parquet(path)

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def pointers(self, version: int | None = None) -> DataFrame:
        """(source_id, generation_id, published_at) of the published generations."""
        entry = self.catalogue.entry(version)
        if "pointers" not in entry["tables"]:
            return self.spark.createDataFrame([], POINTERS)
        return self.spark.read.schema(POINTERS).parquet(*entry["tables"]["pointers"])

    def publish(self, source: str, generation: str, at: str, expected: int, seen: int | None = None) -> int:
        """Points a source to a staged generation that has the expected number of rows; gives the version of the pointers. Publishing it again changes nothing. A publisher
        that names the version it has ``seen`` gets a ``Conflict`` if there is a newer one; without it the step is repeated on the newest."""
        path = f"{self.root}/generations/source_id={source}/generation_id={generation}"
        found = self.spark.read.parquet(path).count() if self._exists(f"{path}/_SUCCESS") else -1
        if found != expected:
            raise ValueError(f"generation {generation} of {source} has {found} rows, not {expected}")

        def step(version: int) -> int:
            now = self.pointers(version)
            if not now.filter((F.col("source_id") == source) & (F.col("generation_id") == generation)).isEmpty():
                return version
            one = self.spark.createDataFrame([(source, generation)], "source_id string, generation_id string").withColumn("published_at", F.lit(at).cast("timestamp"))
            return self.catalogue.publish(version, {"pointers": now.filter(F.col("source_id") != source).unionByName(one)})

        return self.catalogue.retried(step) if seen is None else step(seen)

    def serving(self) -> DataFrame:
        """Rows of the published generations."""
        rows = self.spark.read.option("basePath", f"{self.root}/generations").parquet(f"{self.root}/generations")
        return rows.withColumns({c: F.col(c).cast("string") for c in ("source_id", "generation_id")}).join(small(self.pointers().select("source_id", "generation_id")), ["source_id", "generation_id"])

    def collect_garbage(self, keep: int) -> list[str]:
        """Removes all but the ``keep`` newest unpublished generations of each source, never a published one; the paths removed."""
        path, files = self._files()
        serving = {(r.source_id, r.generation_id) for r in self.pointers().collect()}
        gone = []
        for source in files.listStatus(path(f"{self.root}/generations")):
            name = source.getPath().getName().split("=", 1)[1]
            own = sorted(((s.getModificationTime(), s.getPath()) for s in files.listStatus(source.getPath())), key=lambda x: (-x[0], x[1].getName()))
            rest = [p for _, p in own if (name, p.getName().split("=", 1)[1]) not in serving]
            for p in rest[keep:]:
                files.delete(p, True)
                gone.append(f"{name}/{p.getName().split('=', 1)[1]}")
        return gone


def retention(generations: DataFrame, pointers: DataFrame, keep: int) -> DataFrame:
    """Generations to remove: all but the ``keep`` newest superseded ones of each source, never one that is pointed to."""
    old = generations.join(pointers, ["source_id", "generation_id"], "left_anti")
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc_nulls_last("published_at"), F.desc("generation_id"))) - 1
    return old.withColumn("_n", n).filter(F.col("_n") >= keep).drop("_n")


def active_versions(versions: DataFrame) -> DataFrame:
    """The newest ready version of each file."""
    return first_of(versions.filter("status = 'ready'"), ["file_id"], F.desc("version_id"))


def promote(versions: DataFrame, complete: DataFrame) -> DataFrame:
    """Status after promotion: pending versions whose embeddings are complete become ready, ready ones behind them are replaced.
    Only pending to ready, pending to failed and ready to replaced are possible."""
    done = complete.select("version_id").distinct().withColumn("_done", F.lit(True))
    rows = versions.join(done, "version_id", "left")
    ready = F.when((F.col("status") == "pending") & F.col("_done"), "ready").otherwise(F.col("status"))
    rows = rows.withColumn("_s", ready)
    newest = F.max(F.when(F.col("_s") == "ready", F.col("version_id"))).over(Window.partitionBy("file_id"))
    return rows.withColumn("status", F.when((F.col("_s") == "ready") & (F.col("version_id") < newest), "replaced").otherwise(F.col("_s"))).drop("_s", "_done")


def file_freshness(index: DataFrame, disk: DataFrame, hash_first: bool) -> DataFrame:
    """(path, state): missing, fresh, stale, metadata-drift or unverified, new for unknown files. One rule compares hashes first, the other
    modification times. Both: path, hash, mtime."""
    i = index.select("path", F.col("hash").alias("ih"), F.col("mtime").alias("im"), F.lit(True).alias("indexed"))
    o = disk.select("path", F.col("hash").alias("dh"), F.col("mtime").alias("dm"), F.lit(True).alias("there"))
    same_hash, same_time = F.col("ih") == F.col("dh"), F.col("im") == F.col("dm")
    unknown = F.col("dh").isNull() | F.col("ih").isNull()
    by_hash = F.when(unknown, "unverified").when(~same_hash, "stale").when(~same_time, "metadata-drift").otherwise("fresh")
    by_time = F.when(same_time, "fresh").when(unknown, "unverified").when(same_hash, "metadata-drift").otherwise("stale")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("indexed").isNull(), "new").otherwise(by_hash if hash_first else by_time)
    return i.join(o, "path", "full").select("path", state.alias("state"))


def source_freshness(reports: DataFrame, expected: DataFrame, now: str, hours: float) -> DataFrame:
    """(source_id, state, age_hours) of each expected source by its latest report (source_id, finished_at, ok)."""
    last = reports.groupBy("source_id").agg(F.max_by("ok", "finished_at").alias("ok"), F.max("finished_at").alias("at"))
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))) / 3600
    state = F.when(F.col("at").isNull(), "missing").when(~F.col("ok"), "alert").when(F.col("age_hours") < 0, "invalid").when(F.col("age_hours") > hours, "stale").otherwise("ok")
    return expected.join(last, "source_id", "left").withColumn("age_hours", age).select("source_id", state.alias("state"), "age_hours")


def fold_jobs(events: DataFrame) -> DataFrame:
    """(job_id, status, attempts, at): the state of each job from its events (job_id, seq, kind, at)."""
    status = F.max_by("kind", "seq")
    return events.groupBy("job_id").agg(F.when(status == "claim", "running").when(status == "enqueue", "queued").when(status == "finish", "done").when(status == "fail", "retry-wait").otherwise(status).alias("status"), F.count_if(F.col("kind") == "claim").alias("attempts"), F.max("at").alias("at"))


def next_claim(jobs: DataFrame, now: Column, most: int) -> DataFrame:
    """The job to run next: the oldest that is available, or whose lease is over, with attempts left."""
    free = F.col("status").isin("queued", "retry-wait") & (F.col("available_at") <= now)
    lost = (F.col("status") == "running") & (F.col("lease_until") <= now)
    return jobs.filter((free | lost) & (F.col("attempts") < most)).orderBy("available_at", "job_id").limit(1)


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease is over: cancelled, dead or waiting for another try."""
    lost = jobs.filter((F.col("status") == "running") & (F.col("lease_until") <= now))
    return lost.withColumn("status", F.when(F.col("cancel_requested"), "cancelled").when(F.col("attempts") >= F.col("max_attempts"), "dead-letter").otherwise("retry-wait"))


def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests whose key no active job has, one for each key."""
    active = jobs.filter(F.col("status").isin("queued", "running", "retry-wait")).select("dedupe_key").distinct()
    return first_of(requests.join(active, "dedupe_key", "left_anti"), ["dedupe_key"], F.asc("request_id"))


def scan_completeness(issues: DataFrame) -> DataFrame:
    """(status, issues, evidence): blocked with a fatal issue, incomplete with any, complete without; and a digest of the issues."""
    n = issues.agg(F.count("*").alias("issues"), F.count_if("fatal").alias("_f"), F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", "code", "path"))), "\n"), 256).alias("evidence"))
    return n.select(F.when(F.col("_f") > 0, "blocked").when(F.col("issues") > 0, "incomplete").otherwise("complete").alias("status"), "issues", "evidence")


def deletions(tracked: DataFrame, candidates: DataFrame, complete: bool, key: str = "path") -> DataFrame:
    """Tracked rows without a candidate; none may go unless the scan was complete and found something."""
    gone = tracked.join(candidates.select(key).distinct(), key, "left_anti")
    return gone if complete and not candidates.isEmpty() else gone.limit(0)


def build_overlay(published: Column, current: Column, clean: Column) -> Column:
    """(status, context, lane) of a build, from its identity and the workspace's."""
    status = F.when(published.isNull(), "unpublished").when(published == current, "published").otherwise("invalid")
    context = F.when(current.isNull(), "unverified").when((published == current) & clean, "covered").otherwise("drift")
    lane = F.when(published.isNotNull(), "published_hybrid").otherwise("unavailable")
    return F.struct(status.alias("status"), context.alias("context"), lane.alias("lane"))


def complete_ingest(catalogue: Catalogue, seen: int, rows: dict[str, DataFrame], jobs: DataFrame, snapshots: DataFrame, job: object, fence: int, snapshot: object, at: str, expected: dict[str, int] | None = None, aborted: str | None = None, rules: dict | None = None) -> int:
    """Ends an ingest as one: the build's tables, the job's ``finish`` and the snapshot's ``consume`` become visible by one commit, or nothing does. ``jobs`` and ``snapshots`` are all
    events so far (see ``transitions``); an event that its fold would refuse (a stale fence, a lease that is over, an illegal state) refuses the whole. With
    ``aborted``, a failure code, both fail instead and the tables of the version before stay. ``rules``: ``job_rules`` and ``snapshot_rules`` other than the usual ones."""
    from lodestone.operators import transitions as T

    new = {"jobs": ("fail" if aborted else "finish", job, fence, jobs, T.Job), "snapshots": ("fail" if aborted else "consume", snapshot, None, snapshots, T.Snapshot)}
    steps = {"jobs": T.job_rules(), "snapshots": T.snapshot_rules()} | (rules or {})
    events: dict[str, DataFrame] = {}
    for name, (kind, key, token, before, state) in new.items():
        own = before.filter(F.col("key") == key)
        last = own.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))
        event = last.select(F.lit(key).cast(before.schema["key"].dataType).alias("key"), F.col("seq").cast(before.schema["seq"].dataType).alias("seq"), F.lit(kind).alias("kind"), F.lit(at).cast(before.schema["at"].dataType).alias("at"), F.lit(token).cast("bigint").alias("fence"), F.lit(aborted).cast("string").alias("value"))
        whole = before.unionByName(event, allowMissingColumns=True)
        why = T.rejected(T.fold(whole.filter(F.col("key") == key), state, steps[name])).join(last, "seq").first()
        if why is not None:
            raise Refused(f"{kind} of {name} {key}: {why.reason}")
        events[name] = whole
    if not aborted:
        return catalogue.publish(seen, rows | events, expected=expected)
    kept = {k: v for k, v in catalogue.entry(seen)["tables"].items() if k not in events}
    return catalogue.commit(seen, kept | {name: [catalogue.stage(name, df)] for name, df in events.items()}, {"aborted": aborted})
