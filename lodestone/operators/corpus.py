"""Building a corpus: documents from files, their metadata, pairing with processed files, manifests and checks of payloads."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.batches import sliced
from lodestone.functions import text as T
from lodestone.io import small
from lodestone.operators import chunking, lifecycle
from lodestone.operators.digests import tree_digest
from lodestone.sources import files as S


def build_documents(found: DataFrame) -> DataFrame:
    """Documents of files (path, content): the header goes, the title is the header's, the first heading or the file's name, and
    digests name the raw file and the body. The searchable text is title, path and the first 2000 characters."""
    rows = found.withColumn("_f", S.frontmatter("content"))
    body = F.col("_f.body")
    title = S.display_title(F.col("_f.metadata"), body, F.col("path"))
    searchable = F.concat_ws("\n\n", title, F.col("path"), F.substring(body, 1, 2000))
    return rows.select("path", title.alias("title"), F.sha2("content", 256).alias("content_hash"), F.sha2(body, 256).alias("processed_hash"), searchable.alias("searchable_text"), body.alias("content"), F.col("_f.metadata").alias("metadata"))


def document_chunks(documents: DataFrame) -> DataFrame:
    """(path, chunk_index, content, searchable_text, section and lines) by the canonical chunker."""
    return chunking.chunks(documents, "path", "content", "canonical", title="title", path="path").drop("profile")


def ingest(store: lifecycle.GenerationStore, found: DataFrame, source: str, generation: str, at: str) -> int:
    """Builds the documents of a source, stages them as a generation and points the source to it; the number of documents. What
    was staged before is not written again, so a repeated call changes nothing."""
    documents = build_documents(found)
    store.stage(documents, source, generation)
    expected = found.count()
    store.publish(source, generation, at, expected)
    return expected


def upsert_payload(changes: DataFrame, found: DataFrame, size: int = 512, overlap: int = 64) -> tuple[DataFrame, DataFrame]:
    """(path, chunk_index, content) of added and modified files in windows, and (path) of the deleted ones, from changes (path, op):
    A, M or D."""
    from lodestone.operators.retrieval import windows

    new = changes.filter(F.col("op").isin("A", "M")).select("path")
    chunks = windows(found.join(new, "path", "left_semi").select("path", F.col("content").alias("text")), size, overlap)
    return chunks, changes.filter("op = 'D'").select("path")


def normalised_metadata(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows (id, source_id, source_path, category, language, tags) with the registry's values in place of their own: looked up by id, then by
    the longest path prefix, then by category. Tags are the registry's and the row's, distinct. ``registry``: source_id, prefix, category, language, tags."""
    fields = ["source_id", "category", "language"]
    entry = lambda name: registry.select(F.struct(*fields, "tags", "prefix").alias(name))
    by_id, by_category = entry("a"), entry("c")
    out = rows.join(small(by_id), F.col("source_id") == F.col("a.source_id"), "left")
    # A path meets every prefix of its own folders, as equality.
    parts = F.split("source_path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    path_hit = rows.select("id", F.explode(above).alias("prefix")).join(small(registry), "prefix")
    best = path_hit.groupBy("id").agg(F.max_by(F.struct(*fields, "tags", "prefix"), F.length("prefix")).alias("p"))
    out = out.join(best, "id", "left").join(small(by_category), F.col("category") == F.col("c.source_id"), "left")
    hit = F.coalesce("a", "p", "c")
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    own_tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    tags = F.array_distinct(F.concat(F.coalesce(hit["tags"], F.array().cast("array<string>")), own_tags))
    return out.select("id", *(F.coalesce(hit[f], blank(f)).alias(f) for f in fields), tags.alias("tags"))


def coverage(sources: DataFrame, processed: DataFrame) -> DataFrame:
    """(path, state) of source and processed files (path, mtime): covered, stale (processed before the source's last change), missing, or
    orphaned. An ``.mdx`` source may have become ``.md``; the same path is preferred. Generated ``_index.md`` files are no orphans."""
    done = processed.select(F.col("path").alias("target"), F.col("mtime").alias("done_at"))
    names = F.when(F.col("path").endswith(".mdx"), F.array("path", F.regexp_replace("path", r"\.mdx$", ".md"))).otherwise(F.array("path"))
    tried = sources.select("path", "mtime", F.posexplode(names).alias("at", "target")).join(done, "target", "left")
    best = tried.groupBy("path").agg(F.min_by("done_at", F.when(F.col("done_at").isNotNull(), F.col("at"))).alias("done_at"), F.max("mtime").alias("mtime"))
    state = F.when(F.col("done_at").isNull(), "missing").when(F.col("done_at") < F.col("mtime"), "stale").otherwise("covered")
    taken = sources.select(F.explode(names).alias("path")).distinct()
    orphans = processed.filter(~F.col("path").endswith("_index.md")).join(taken, "path", "left_anti").select("path", F.lit("orphaned").alias("state"))
    return best.select("path", state.alias("state")).unionByName(orphans)


def coverage_summary(states: DataFrame) -> DataFrame:
    """Counts by state, the percentage of sources that are not missing, and whether all are covered."""
    n = lambda s: F.count_if(F.col("state") == s)
    sources = F.count_if(F.col("state") != "orphaned")
    percent = F.when(sources > 0, (sources - n("missing")) / sources * 100).otherwise(0.0)
    return states.agg(sources.alias("sources"), n("missing").alias("missing"), n("stale").alias("stale"), n("orphaned").alias("orphaned"), percent.alias("coverage"), ((n("missing") + n("stale")) == 0).alias("passed"))


def headings(content: Column | str) -> Column:
    """(depth, text, slug) of a Markdown text's headings, in order; lines between code fences have none."""
    content = F.col(content) if isinstance(content, str) else content
    lines = F.split(content, r"\r?\n")
    # Fences switch; the parts between them at even places are outside.
    marked = F.array_join(F.transform(lines, lambda x: F.when(F.trim(x).startswith("```"), F.lit("\x1e")).otherwise(x)), "\n")
    outside = F.filter(F.split(marked, "\x1e"), lambda _, i: i % 2 == 0)
    found = F.filter(F.flatten(F.transform(outside, lambda x: F.split(x, "\n"))), lambda x: x.rlike(r"^#{1,6}\s+\S"))

    def one(x: Column) -> Column:
        text = F.regexp_extract(x, r"^#{1,6}\s+(.+?)\s*#*\s*$", 1)
        return F.struct(F.length(F.regexp_extract(x, "^(#{1,6})", 1)).alias("depth"), text.alias("text"), T.slug(text).alias("slug"))

    return F.transform(found, one)


#: Bounds of a job's result. Fixed values.
RESULT_DEPTH, RESULT_ITEMS, RESULT_BYTES = 8, 512, 64 * 1024


def result_problem(raw: str | None) -> str | None:
    """Why a JSON text is no result of a job: depth, items, bytes, a number that is not finite, or no JSON at all; None for a good one."""

    def refuse(_: str):
        raise ArithmeticError

    try:
        value = json.loads(raw or "", parse_constant=refuse)
    except ArithmeticError:
        return "not-finite"
    except (ValueError, RecursionError):
        return "not-json"
    todo, items = [(value, 0)], 1
    while todo:
        value, depth = todo.pop()
        if depth > RESULT_DEPTH:
            return "depth"
        if isinstance(value, float) and not math.isfinite(value):
            return "not-finite"
        if isinstance(value, dict | list):
            items += len(value)
            if items > RESULT_ITEMS:
                return "items"
            todo += [(v, depth + 1) for v in (value.values() if isinstance(value, dict) else value)]
    compact = json.dumps(json.loads(raw), separators=(",", ":"), ensure_ascii=False)
    return "bytes" if len(compact.encode()) > RESULT_BYTES else None


#: Bounds of a root manifest. Fixed values.
MANIFEST_BYTES, MANIFEST_ROOTS, MANIFEST_RULES, MANIFEST_PATH, MANIFEST_ERRORS = 65_536, 64, 256, 1024, 50
#: Folders that may be no part of a manifest's path. Fixed values.
BLOCKED = frozenset([
    ".git", ".hg", ".svn", ".jj", "node_modules", "vendor", ".bundle", ".cache", "__pycache__", ".pytest_cache", ".mypy_cache", "tmp", "temp", "dist", "build", "coverage", ".turbo", ".next", "out", ".data", "_generated", "generated", "logs", "playwright-report", "test-results", ".eslint", ".nyc_output",
])
#: Ends of folder names that may be no part of it either. Fixed values.
BLOCKED_ENDS = (".egg-info",)
_DEVICE = re.compile(r"(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?", re.I)
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def manifest_path_problems(path: str, blocked: frozenset[str] = BLOCKED) -> list[str]:
    """What is wrong with a folder of a manifest. ``blocked``: names that may be no part of it."""
    if not path:
        return ["empty"]
    parts = path.split("/")
    checks = [
        (len(path) > MANIFEST_PATH, "too long"), (bool(_CONTROL.search(path)), "control character"), ("\\" in path, "backslash"), (path.startswith("/"), "absolute"),
        (bool(re.match("[A-Za-z]:", path)), "drive letter"), ("" in parts, "empty segment"), (bool({".", ".."} & set(parts)), "dot segment"),
        (bool(blocked & set(parts)) or any(p.endswith(BLOCKED_ENDS) for p in parts), "blocked name"), (any(_DEVICE.fullmatch(p) for p in parts), "device name"),
        (any(p not in (".", "..") and p.endswith((".", " ")) for p in parts), "ends with a dot or blank"),
    ]
    return [name for hit, name in checks if hit]


def manifest_errors(raw: str, blocked: frozenset[str] = BLOCKED) -> list[str]:
    """What is wrong with a root manifest; nothing for a valid one. No key but the known ones, no duplicates."""
    if len(raw.encode()) > MANIFEST_BYTES:
        return [f"more than {MANIFEST_BYTES} bytes"]
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return ["not JSON"]
    if not isinstance(found, dict):
        return ["no object"]
    out = [f"unknown key {k}" for k in found if k not in ("manifestVersion", "includeRoots", "ignoreRules")]
    if found.get("manifestVersion") != 1 or isinstance(found.get("manifestVersion"), bool):
        out.append("manifestVersion must be 1")
    for key, most in (("includeRoots", MANIFEST_ROOTS), ("ignoreRules", MANIFEST_RULES)):
        values = found.get(key, [])
        if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
            out.append(f"{key} must be a list of texts")
        elif len(values) > most:
            out.append(f"{key} has more than {most} entries")
    if out:
        return out[:MANIFEST_ERRORS]
    for key in ("includeRoots", "ignoreRules"):
        seen: set[str] = set()
        for i, value in enumerate(found.get(key, [])):
            wrong = manifest_path_problems(value, blocked) if key == "includeRoots" else [n for hit, n in ((not value.strip(), "empty"), (len(value) > MANIFEST_PATH, "too long"), (bool(_CONTROL.search(value)), "control character")) if hit]
            out += [f"{key}[{i}]: {w}" for w in [*wrong, *(["duplicate"] if value in seen else [])]]
            seen.add(value)
    return out[: MANIFEST_ERRORS + 1]


def checked(rows: DataFrame, key: str, column: str, check, name: str) -> DataFrame:
    """(key, name): the result of ``check``, a list of texts or a text, for each value of a text column, in Arrow batches."""
    kind = rows.schema[key].dataType.simpleString()
    many = name.endswith("s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "value"):
            found = pa.array([check(x) for x in batch.column("value").to_pylist()], pa.list_(pa.string()) if many else pa.string())
            yield pa.record_batch([batch.column(key), found], [key, name])

    return rows.select(key, F.col(column).cast("string").alias("value")).mapInArrow(run, f"{key} {kind}, {name} {'array<string>' if many else 'string'}")


#: Longest failure detail that is kept. Fixed value.
DETAIL = 1024


def failure_detail(c: Column | str) -> Column:
    """A failure's text without absolute paths and control characters, at most DETAIL characters; null for an empty one."""
    c = F.col(c) if isinstance(c, str) else c
    paths = F.regexp_replace(F.regexp_replace(c, r"/[^\s/](?:/?[^\s/]++)*+/?", "<path>"), r"[A-Za-z]:\\[^\s]*", "<path>")
    return F.nullif(F.substring(F.regexp_replace(paths, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), 1, DETAIL), F.lit(""))


def provenance(rows: DataFrame) -> DataFrame:
    """Results with provenance_status (complete or degraded) and missing_fields, of canonical_url, source_revision, synced_at and authority;
    blank texts count as missing."""
    wanted = {"canonicalUrl": "canonical_url", "sourceRevision": "source_revision", "syncedAt": "synced_at", "authority": "authority"}
    absent = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    missing = F.array_compact(F.array(*(F.when(absent(c), F.lit(n)) for n, c in wanted.items())))
    return rows.withColumn("missing_fields", missing).withColumn("provenance_status", F.when(F.size("missing_fields") == 0, "complete").otherwise("degraded"))


def sync_alerts(reports: DataFrame, most_failed: int, highest_rate: float) -> DataFrame:
    """(alert, sources, value) of a run's reports (source, total, attempted, processed, skipped, failed): sources without documents or without
    fit ones, and failures beyond the bounds."""
    zero = lambda *c: reduce(lambda a, b: a & b, (F.col(x) == 0 for x in c))
    names = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("source"))))
    rate = F.when(F.sum("attempted") > 0, F.sum("failed") / F.sum("attempted")).otherwise(0.0)
    one = reports.agg(names(zero("total", "attempted", "processed", "skipped", "failed")).alias("e"), names((F.col("total") > 0) & zero("attempted", "processed", "skipped")).alias("n"), F.sum("failed").cast("double").alias("f"), rate.alias("r"))
    none = F.array().cast("array<string>")
    alert = lambda name, sources, value: F.struct(F.lit(name).alias("alert"), sources.alias("sources"), value.alias("value"))
    all_ = F.array(
        F.when(F.size("e") > 0, alert("no-documents", F.col("e"), F.size("e").cast("double"))), F.when(F.size("n") > 0, alert("none-eligible", F.col("n"), F.size("n").cast("double"))),
        F.when(F.col("f") > most_failed, alert("failed-files", none, F.col("f"))), F.when(F.col("r") > highest_rate, alert("failure-rate", none, F.col("r"))),
    )
    return one.select(F.inline(F.array_compact(all_)))


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    rows.write.mode("overwrite").json(path)


def markdown_report(title: str, rows: DataFrame, order: list[str], most: int = 1000) -> str:
    """A report of at most ``most`` rows as a Markdown table, for reading; what is left out is told."""
    found = rows.orderBy(*order).limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", r"\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in found[:most]]
    return "\n".join(lines + (["", f"More than {most} rows."] if len(found) > most else []) + [""])


def preflight(spark: SparkSession, candidates: DataFrame, tracked: DataFrame, findings: DataFrame, issues: DataFrame | None, force: bool = False, target: str | None = None, root: str = "", scope: DataFrame | None = None, rules: DataFrame | None = None, allow: DataFrame | None = None) -> DataFrame:
    """One row: what an ingest would do, and six digests that bind it. ``candidates`` and ``tracked``: path, hash; ``findings``: path, reason; ``issues``: code, path, fatal, or None where no
    scan gave evidence, in which case the plan is not complete and deletes nothing. With ``force`` every tracked candidate, or the target, is an update. ``root``: what is scanned;
    ``scope``: path of each folder; ``rules``: rule; ``allow``: path, category of findings that don't block, which the policy's digest binds too. Each digest is that of a hash tree."""
    from lodestone.operators.relational import delta

    changes = delta(tracked, candidates)
    if force:
        again = (F.col("change") == "unchanged") & (F.lit(True) if target is None else F.col("path") == target)
        changes = changes.withColumn("change", F.when(again, "update").otherwise(F.col("change")))
    n = lambda c: F.count_if(F.col("change") == c)
    counts = changes.agg(n("add").alias("adds"), n("update").alias("updates"), n("delete").alias("deletes"), F.count_if(F.col("change") != "delete").alias("eligible"), F.count_if(F.col("change") != "add").alias("tracked"))
    blocked = findings.agg(F.count("*").alias("blocked"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    none = spark.createDataFrame([], "path string, category string, rule string")
    allow = none if allow is None else allow
    digests = [tree_digest(candidates, "path", "hash", name="inventory_hash"), tree_digest(tracked, "path", "hash", name="baseline_hash"), tree_digest(changes.filter("change = 'delete'"), "path", name="stale_hash"), tree_digest(none if scope is None else scope, "path", name="scope_hash"), tree_digest(none if rules is None else rules, "rule", name="rules_hash"), tree_digest(allow, "path", "category", name="allow_hash")]
    if issues is None:
        verdict = spark.range(1).select(F.lit("incomplete").alias("status"), F.lit("none").alias("evidence"))
    else:
        verdict = lifecycle.scan_completeness(issues).select("status", "evidence")
    out = counts
    for side in (blocked, *digests, verdict):  # each is one row
        out = out.crossJoin(F.broadcast(side))
    out = out.withColumn("deletion_allowed", (F.col("status") == "complete") & (F.col("eligible") > 0) & F.lit(issues is not None))
    out = out.withColumns({"root_hash": F.sha2(F.lit(root), 256), "policy_hash": F.sha2(F.concat_ws("|", "rules_hash", "allow_hash"), 256)})
    return out.withColumn("plan_hash", F.sha2(F.concat_ws("|", "adds", "updates", "deletes", "stale_hash", "inventory_hash", "baseline_hash", "scope_hash", "policy_hash", "root_hash", "status", "evidence", "deletion_allowed", F.lit(str(force)), F.lit(target or "")), 256))


def review_allowed(reviewer: Column | str, operator: Column | str, expires: Column | str, now: Column) -> Column:
    """Why a review may not count: self-approval, or a token that is over; null where it may."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.when(col(reviewer) == col(operator), "self-approval").when(col(expires) <= now, "expired")
