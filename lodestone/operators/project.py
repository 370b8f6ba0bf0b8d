"""Search and reports over an indexed source repository: rows bound to a build, hybrid search with its fallback, coverage and gates."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import score as S
from lodestone.functions import text as T
from lodestone.io import small, written
from lodestone.operators import retrieval as R
from lodestone.operators.digests import bounded_samples

if TYPE_CHECKING:
    from lodestone.operators.fulltext import TextIndex


def serving(rows: DataFrame, build_files: DataFrame, build: int | None = None) -> DataFrame:
    """Rows of the files and versions of a build; without a number, of the published one. ``build_files``: build_id, file_id, version_id, status."""
    bound = build_files.filter(F.col("build_id") == build if build is not None else F.col("status") == "published")
    return rows.join(bound.select("file_id", "version_id").distinct(), ["file_id", "version_id"], "left_semi")


def search(chunks: DataFrame, files: DataFrame, query: str, limit: int = 5, vectors: DataFrame | None = None, query_vector: list[float] | None = None, profile: dict | None = None, index: TextIndex | None = None) -> DataFrame:
    """Ranked chunks of a build. ``files`` are the build's: file_id, version_id, source_path; ``chunks`` have chunk_id, file_id, version_id, chunk_index,
    start_line, end_line, content, searchable_text, symbol_name, symbol_kind, symbol_signature; ``vectors`` chunk_id, embedding and the columns of
    ``profile``, which must be equal to its values. The text of all chunks is read once, for the match; only candidates are ranked. With an ``index`` of the build's chunks
    (by ``code_search_text``) no text is read but the candidates'."""
    query = query.strip()
    if not query:
        raise ValueError("a query is needed")
    limit = min(max(limit, 1), 50)
    candidates = max(200, 50 * limit)
    bound = chunks.join(files.select("file_id", "version_id", "source_path"), ["file_id", "version_id"])
    seen = T.code_search_text("symbol_name", "symbol_kind", "symbol_signature", "searchable_text", "content") if index is None else F.col("search_text")
    words = R.lexemes("search_text")
    if index is None:
        hit = bound.withColumn("search_text", seen).filter(R.matches_text("search_text", query)).select("chunk_id", R.rank_cover_density(words, query).alias("text_rank"))
        hit = hit.orderBy(F.desc("text_rank"), "chunk_id").limit(candidates)
    else:
        hit = index.lane(query, candidates)
    lanes = [hit.select("chunk_id", F.lit(0.0).alias("vector_score"))]
    if vectors is not None and query_vector is not None:
        for column, value in (profile or {}).items():
            vectors = vectors.filter(F.col(column) == value)
        own = vectors.join(bound.select("chunk_id"), "chunk_id", "left_semi")
        scored = own.withColumn("vector_score", F.greatest(S.cosine("embedding", F.lit([float(x) for x in query_vector])), F.lit(0.0)))
        lanes.append(scored.orderBy(F.desc("vector_score"), "chunk_id").limit(candidates).select("chunk_id", "vector_score"))
    # Two lanes of at most 2500 rows; texts are normalised behind the join, for candidates alone.
    found = R.candidates_of(bound, R.merge_lanes(*lanes), index).withColumn("search_text", seen)
    path, asked = T.search_text("source_path"), T.search_text(F.lit(query))
    terms = [w for w in R.query_terms_plain(query) if len(w) >= 3]
    score = R.rank_cover_density(words, query) * 10 + R.similarity("search_text", asked) + R.similarity(path, asked) + R.term_hits(terms, "search_text", path) * 0.25 + F.col("vector_score") * 12
    ranked = found.withColumn("score", score).orderBy(F.desc("score"), "source_path", "chunk_index").limit(limit)
    return ranked.select("source_path", "chunk_index", "start_line", "end_line", "content", "symbol_name", "symbol_kind", "vector_score", "score")


@dataclass
class Answer:
    """Results of a search, what it fell back to, and how it went."""

    results: DataFrame
    fallback: str | None = None
    warnings: list[str] = field(default_factory=list)
    lanes: list[tuple[str, str]] = field(default_factory=list)


def search_with_fallback(chunks: DataFrame, files: DataFrame, query: str, limit: int = 10, vectors: DataFrame | None = None, query_vector: list[float] | None = None, profile: dict | None = None, mode: str = "hybrid", active: str | None = None, most_characters: int | None = None, most_each: int = 4000, index: TextIndex | None = None) -> Answer:
    """Hybrid search; where there is no query vector, or it finds nothing, the lexical lane alone. The open file raises its own and its
    neighbours' scores, and a budget of characters cuts what is shown."""
    warnings, lanes = [], []
    if mode == "keyword":
        warnings.append("keyword mode is deprecated; hybrid search is used")
    elif mode != "hybrid":
        warnings.append(f"hybrid search is used for {mode}")
    fallback = None if vectors is not None and query_vector is not None else "embedding_unavailable"
    results = None
    if fallback is None:
        # At most fifty rows, written once: asking whether there are any and reading them doesn't run the search twice.
        results = written(search(chunks, files, query, limit, vectors, query_vector, profile, index), "results")
        empty = results.isEmpty()
        lanes.append(("hybrid", "executed"))
        fallback = "hybrid_empty" if empty else None
    else:
        lanes.append(("hybrid", "skipped"))
    if fallback is not None:
        warnings.append("the embedding was unavailable; the lexical lane answered" if fallback == "embedding_unavailable" else "hybrid search found nothing; the lexical lane answered")
        lanes.append(("lexical", "executed"))
        results = search(chunks, files, query, limit, index=index)
    if active:
        results = R.active_file_bias(results, active)
    if most_characters is not None:
        from lodestone.operators.relational import capped

        results = capped(results, "content", most_characters, most_each, F.desc("score"), F.asc("source_path"), F.asc("chunk_index"))
    return Answer(results, fallback, warnings, lanes)


def graph_files(files: DataFrame, symbols: DataFrame, rows: int = 5000) -> DataFrame:
    """(file_id, source_path, lang, symbols): the files of a build with their symbols' names in order. As the view it serves, it is cut to a number of
    file and symbol rows before they are grouped; ``files`` has file_id, version_id, source_path, lang."""
    from lodestone.operators.relational import fallback_join

    own = fallback_join(files.select("file_id", "version_id"), symbols).select("file_id", "name", "start_line")
    joined = files.select("file_id", "source_path", "lang").join(own, "file_id", "left")
    first = joined.orderBy("source_path", F.asc_nulls_last("start_line"), F.asc_nulls_last("name")).limit(rows)
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("start_line", "name")))), lambda x: x["name"])
    return first.groupBy("file_id", "source_path", "lang").agg(listed.alias("symbols"))


def embedding_coverage(chunks: DataFrame, embeddings: DataFrame, expected: dict, samples: bool = False) -> DataFrame:
    """One row of counts over served chunks (chunk_id, version_id, active_version_id, source_hash) and their embeddings (chunk_id, version_id, source_hash,
    model, provider, dimensions, profile, and maybe length, that of the vector), with a status. One join gives all; each chunk's embeddings are folded before it. With ``samples`` the least
    owners that are missing, stale, mismatched (model, provider or dimensions) or of another version are shown, and those are counted whose vector has another length."""
    length = F.col("length") if "length" in embeddings.columns else F.lit(None).cast("int")
    e = embeddings.select("chunk_id", F.col("version_id").alias("ev"), F.col("source_hash").alias("eh"), "model", "provider", "dimensions", "profile", length.alias("length"))
    c = chunks.select("chunk_id", F.col("version_id").alias("cv"), F.col("active_version_id").alias("av"), F.col("source_hash").alias("ch"))
    model, provider = F.col("model") == expected["model"], F.coalesce("provider", F.lit("")) == expected["provider"]
    size = F.col("dimensions") == expected["dimensions"]
    current = F.col("cv") == F.col("av")
    flags = {
        "valid": model & provider & size & (F.col("profile") == expected["profile"]) & current & (F.col("ev") == F.col("cv")) & (F.col("eh").isNull() | (F.col("eh") == F.col("ch"))),
        "stale": model & provider & size & F.col("eh").isNotNull() & (F.col("eh") != F.col("ch")),
        "model_mismatch": F.col("model") != expected["model"],
        "provider_mismatch": model & ~provider,
        "dimension_mismatch": model & (F.col("dimensions") != expected["dimensions"]),
        "version_gap": model & F.col("ev").isNull(),
        "invalid_length": F.col("length") != expected["dimensions"],
        "version_mismatch": model & F.col("cv").isNotNull() & F.col("ev").isNotNull() & (F.col("ev") != F.col("cv")),
    }
    joined = c.join(e.withColumn("there", F.lit(1)), "chunk_id", "left")
    folded = joined.groupBy("chunk_id").agg(F.count("there").alias("records"), F.bool_or(F.coalesce(~current, F.lit(True))).alias("gap"), *(F.bool_or(F.coalesce(x, F.lit(False))).alias(n) for n, x in flags.items()))
    n = lambda x: F.count_if(F.col(x) if isinstance(x, str) else x)
    out = folded.agg(
        F.count("*").alias("chunk_owners"), n(F.col("records") > 0).alias("embedding_owners"), F.coalesce(F.sum("records"), F.lit(0)).alias("embedding_records"), n("valid").alias("owners_valid"), n(~F.col("valid")).alias("missing_owners"),
        n("stale").alias("stale_owners"), n("model_mismatch").alias("model_mismatch_owners"), n("provider_mismatch").alias("provider_mismatch_owners"), n("dimension_mismatch").alias("dimension_mismatch_owners"),
        n("gap").alias("chunk_version_gaps"), n("version_gap").alias("embedding_version_gaps"), n("version_mismatch").alias("embedding_version_mismatch_owners"),
    )
    if samples:
        mismatch = F.col("model_mismatch") | F.col("provider_mismatch") | F.col("dimension_mismatch")
        shown = {"missing_owner": ~F.col("valid"), "stale_owner": F.col("stale"), "mismatch_owner": mismatch, "version_mismatch_owner": F.col("version_mismatch"), "invalid_vector_length_owners": F.col("invalid_length")}
        shown = counted(folded, "chunk_id", shown).select("invalid_vector_length_owners", *(f"{n}_sample" for n in list(shown)[:4]))
        out = out.crossJoin(F.broadcast(shown))
    bad = sum((F.col(c) for c in out.columns if c not in ("chunk_owners", "embedding_owners", "embedding_records", "owners_valid") and not c.endswith("_sample")), F.lit(0))
    return out.withColumn("status", F.when(bad > 0, "drift").otherwise("covered"))


#: Paths or owners that a report shows of each problem. Fixed value.
SHOWN = 10


def counted(rows: DataFrame, path: str, flags: dict[str, Column], n: int = SHOWN) -> DataFrame:
    """One row with the number of rows for which each flag holds, and of each flag its ``n`` least paths, as texts (``<flag>_sample``). Every row is read once; samples are bounded on the way."""
    named = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in flags.items())))
    found = bounded_samples(rows.select(F.col(path).cast("string").alias("path"), F.explode(named).alias("flag")), "flag", "path", n)
    at = lambda name, c: F.max(F.when(F.col("flag") == name, F.col(c)))
    none = F.array().cast("array<string>")
    return found.agg(*(F.coalesce(at(name, "count"), F.lit(0)).alias(name) for name in flags), *(F.coalesce(at(name, "sample"), none).alias(f"{name}_sample") for name in flags))


def disk_freshness(indexed: DataFrame, disk: DataFrame, n: int = SHOWN) -> DataFrame:
    """One row: indexed files (path, hash, mtime, size) against the disk (path, hash, mtime, size; a null hash could not be read): counts, samples and a status."""
    d = disk.select("path", *(F.col(c).alias(f"_{c}") for c in ("hash", "mtime", "size")), F.lit(True).alias("_there"))
    rows = indexed.join(d, "path", "left")
    there, readable, same = F.col("_there").isNotNull(), F.col("_hash").isNotNull(), F.col("_hash") == F.col("hash")
    alike = F.col("_mtime").eqNullSafe(F.col("mtime")) & F.col("_size").eqNullSafe(F.col("size"))
    flags = {"missing_files": ~there, "unverified_files": there & ~readable, "stale_files": readable & ~same, "metadata_drift_files": readable & same & ~alike, "fresh_files": readable & same & alike}
    out = counted(rows, "path", flags, n).drop("fresh_files_sample")
    status = F.when(F.col("unverified_files") > 0, "unverified").when(F.col("missing_files") > 0, "missing").when(F.col("stale_files") > 0, "stale").when(F.col("metadata_drift_files") > 0, "fresh_with_metadata_drift").otherwise("fresh")
    return out.withColumn("freshness_status", status)


def scope_coverage(expected: DataFrame, tracked: DataFrame, n: int = SHOWN) -> DataFrame:
    """One row: the files that a scan expects (path, ignored) against those that are tracked (path, status): counts, samples and a status."""
    e = expected.groupBy("path").agg(F.bool_and("ignored").alias("ignored"), F.lit(True).alias("wanted"))
    t = tracked.groupBy("path").agg(F.bool_or(F.col("status") == "indexed").alias("indexed"), F.bool_or(F.col("status") == "blocked").alias("blocked"), F.lit(True).alias("tracked"))
    known = lambda c: F.coalesce(c, F.lit(False))
    wanted, ignored, indexed = known(F.col("wanted")) & ~known(F.col("ignored")), known(F.col("ignored")), known(F.col("indexed"))
    flags = {
        "expected_files": wanted, "missing_expected_files": wanted & ~known(F.col("tracked")), "blocked_expected_files": wanted & known(F.col("blocked")), "extra_indexed_files": indexed & ~known(F.col("wanted")),
        "ignored_expected_files": ignored, "ignored_indexed_files": indexed & ignored,
    }
    out = counted(e.join(t, "path", "full"), "path", flags, n).drop("expected_files_sample")
    return out.withColumn("scope_status", F.when((F.col("missing_expected_files") > 0) | (F.col("extra_indexed_files") > 0) | (F.col("ignored_indexed_files") > 0), "drift").otherwise("covered"))


def invariant_report(expected: DataFrame, tracked: DataFrame, indexed: DataFrame, disk: DataFrame, chunks: DataFrame, embeddings: DataFrame, wanted: dict, ownership: DataFrame, readiness: DataFrame, context: str = "covered") -> DataFrame:
    """One row with everything that is checked of an index: scope, freshness, embeddings with samples, the one-row reports ``ownership`` and ``readiness``, and the gate's answer."""
    parts = [
        scope_coverage(expected, tracked), disk_freshness(indexed, disk), embedding_coverage(chunks, embeddings, wanted, samples=True).withColumnRenamed("status", "embedding_status"),
        ownership.withColumnRenamed("status", "ownership_status"), readiness.withColumnRenamed("status", "readiness_status"),
        tracked.agg(F.count_if(F.col("status") == "indexed").alias("indexed_files")),
    ]
    out = parts[0]
    for part in parts[1:]:  # each is one row
        out = out.crossJoin(F.broadcast(part))
    fresh = F.when(F.col("freshness_status") == "fresh_with_metadata_drift", "fresh").otherwise(F.col("freshness_status"))
    code = gate(F.col("indexed_files"), F.col("chunk_owners"), fresh, F.lit(context), F.col("scope_status"), F.col("embedding_status"), F.col("ownership_status"), F.col("readiness_status"))
    return out.withColumn("failure_code", code)


def ownership_coverage(files: DataFrame, chunks: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts of references that lead nowhere or to deleted files, with a status. ``files``: file_id, status; ``chunks``: chunk_id, file_id; ``symbols``:
    symbol_id, file_id, chunk_id; ``edges``: source_file, target_file, source_symbol, target_symbol."""
    known = files.select(F.col("file_id").alias("key"), (F.col("status") == "deleted").alias("deleted"))

    def to(rows: DataFrame, column: str, parent: DataFrame, name: str, deleted: str | None = None) -> DataFrame:
        side = rows.select(F.col(column).alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("n")).join(parent, "key", "left")
        counts = [F.coalesce(F.sum(F.when(F.col("deleted").isNull(), F.col("n"))), F.lit(0)).alias(name)]
        counts += [F.coalesce(F.sum(F.when(F.col("deleted"), F.col("n"))), F.lit(0)).alias(deleted)] if deleted else []
        return side.agg(*counts)

    there = lambda rows, key: rows.select(F.col(key).alias("key"), F.lit(False).alias("deleted")).distinct()
    ends = edges.select(F.monotonically_increasing_id().alias("edge"), F.explode(F.array_compact(F.array("source_file", "target_file"))).alias("key")).join(known.filter("deleted"), "key", "left_semi")
    sides = [
        to(chunks, "file_id", known, "chunk_file_orphans", "deleted_file_chunks"), to(symbols, "file_id", known, "symbol_file_orphans", "deleted_file_symbols"),
        to(symbols, "chunk_id", there(chunks, "chunk_id"), "symbol_chunk_orphans"), to(edges, "source_file", known, "edge_missing_source_files"), to(edges, "target_file", known, "edge_missing_target_files"),
        to(edges, "source_symbol", there(symbols, "symbol_id"), "edge_missing_source_symbols"), to(edges, "target_symbol", there(symbols, "symbol_id"), "edge_missing_target_symbols"),
        ends.agg(F.countDistinct("edge").alias("deleted_file_edges")),
    ]
    out = sides[0]
    for side in sides[1:]:
        out = out.crossJoin(F.broadcast(side))
    return out.withColumn("status", F.when(sum((F.col(c) for c in out.columns), F.lit(0)) > 0, "drift").otherwise("covered"))


def version_readiness(files: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """One row of counts of files (file_id, status, active_version_id, latest_version_id) by their versions (version_id, status, created_at). A pending version is
    stale after an hour."""
    live = files.filter(F.coalesce("status", F.lit("")) != "deleted")
    v = lambda key, name: versions.select(F.col("version_id").alias(key), F.struct("status", "created_at").alias(name))
    rows = live.join(v("active_version_id", "a"), "active_version_id", "left").join(v("latest_version_id", "l"), "latest_version_id", "left")
    pending = (F.col("l.status") == "pending") & ~F.col("latest_version_id").eqNullSafe(F.col("active_version_id"))
    old = pending & (F.unix_seconds(F.col("l.created_at").cast("timestamp")) < F.unix_seconds(now.cast("timestamp")) - 3600)
    none = F.col("active_version_id").isNull()
    out = rows.agg(
        F.count_if(~none).alias("with_version"), F.count_if(F.col("a.status") == "ready").alias("active_ready"), F.count_if(F.col("a.status") != "ready").alias("active_not_ready"), F.count_if(none).alias("pending_backfill"), F.count_if(none).alias("legacy_reads"), F.count_if(pending).alias("pending_versions"), F.count_if(old).alias("stale_pending"),
    )
    return out.withColumn("status", F.when((F.col("active_not_ready") > 0) | (F.col("pending_backfill") > 0) | (F.col("legacy_reads") > 0), "unverified").otherwise("covered"))


#: Failure codes of the gate. Fixed values.
EMPTY, STALE, UNVERIFIED, SCOPE, GAP = "PROJECT_INDEX_EMPTY", "PROJECT_INDEX_STALE", "PROJECT_INDEX_UNVERIFIED", "PROJECT_INDEX_SCOPE_DRIFT", "PROJECT_INDEX_EMBEDDING_GAP"


def gate(files: Column, owners: Column, freshness: Column, context: Column, scope: Column, embedding: Column, ownership: Column, readiness: Column) -> Column:
    """The failure code that keeps an index from serving, null where it is ready. Statuses are covered, drift or unverified; of freshness fresh, stale, missing or
    unverified. The checks count in this order, and drift before what is not verified."""
    code = F.when((files <= 0) | (owners <= 0), EMPTY).when(freshness.isin("stale", "missing"), STALE).when(freshness == "unverified", UNVERIFIED)
    for status, drifted in ((context, STALE), (scope, SCOPE), (embedding, GAP), (ownership, SCOPE), (readiness, UNVERIFIED)):
        code = code.when(status == "drift", drifted).when(status == "unverified", UNVERIFIED)
    return code.otherwise(F.lit(None).cast("string"))


def gate_summary(*statuses: Column) -> Column:
    """(status, drifted, unverified) over the checks: one that is not verified weighs more than any drift."""
    n = lambda s: sum((F.coalesce((x == s).cast("int"), F.lit(0)) for x in statuses), F.lit(0))
    return F.struct(F.when(n("unverified") > 0, "unverified").when(n("drift") > 0, "drift").otherwise("covered").alias("status"), n("drift").alias("drifted"), n("unverified").alias("unverified"))


def skeleton_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals: files, symbols by kind (methods count as functions), exports and imported modules."""
    kind = lambda *k: F.count_if(F.col("kind").isin(*k))
    by = symbols.agg(F.count("*").alias("symbols"), kind("class").alias("classes"), kind("function", "method").alias("functions"), kind("interface").alias("interfaces"), kind("type").alias("types"), kind("enum").alias("enums"), F.count_if("exported").alias("exports"))
    imports = edges.filter("relation = 'IMPORTS' and via is null").agg(F.count("*").alias("imports"))
    return files.agg(F.count("*").alias("files")).crossJoin(F.broadcast(by)).crossJoin(F.broadcast(imports))


def edge_backfill(files: DataFrame, found: DataFrame, blocked: Column) -> DataFrame:
    """One row: what writing the missing edges would give; nothing is written. ``files``: path, status, content; ``found``: the edges; ``blocked``: why a file may not be read."""
    live = files.filter("status = 'indexed'")
    code = live.filter(T.extension("path").isin("ts", "tsx", "js", "jsx")).withColumn("blocked", blocked)
    counts = found.groupBy("path").agg(F.count_if(F.col("relation") == "CALLS").alias("calls"), F.count_if(F.col("relation") == "IMPORTS").alias("imports"))
    rows = code.join(counts, "path", "left").fillna({"calls": 0, "imports": 0})
    fit = F.col("content").isNotNull() & F.col("blocked").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(fit, F.col(c))), F.lit(0)).alias(c)
    out = rows.agg(F.count("*").alias("code_files"), F.count_if(F.col("content").isNull()).alias("missing"), F.count_if(F.col("content").isNotNull() & F.col("blocked").isNotNull()).alias("blocked"), total("calls"), total("imports"), F.count_if(fit & (F.col("calls") + F.col("imports") == 0)).alias("without_edges"))
    return out.crossJoin(F.broadcast(live.agg(F.count("*").alias("indexed"))))


def clusters(vectors: DataFrame, k: int, rounds: int = 50, key: str = "chunk_id", seed: int = 7) -> DataFrame:
    """(key, cluster): k-means by cosine distance; rows without a direction are left out. Only the centres come to the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = vectors.filter(length > 0).select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k, maxIter=rounds, seed=seed, distanceMeasure="cosine").fit(rows)
    return model.transform(rows).select(key, F.col("prediction").alias("cluster"))


#: Metrics of a comparison, and whether a bound is on the fall or on the rise. Fixed values.
COMPARED = {"hit_rate": "least", "exact_path_rate": "least", "exact_symbol_rate": "least", "quality": "least", "latency_p95": "most"}


def compare_variants(reports: DataFrame, experiments: DataFrame) -> DataFrame:
    """(experiment, metric, baseline, candidate, delta, lift_percent, passed): two variants' metrics side by side. ``reports``: variant, metric, value;
    ``experiments``: experiment, baseline, candidate and a map of bounds by metric; a metric without a bound passes, one that a variant lacks does not. A rise from 0 is a lift of 100."""
    metrics = F.explode(F.array(*map(F.lit, COMPARED))).alias("metric")
    asked = experiments.select("experiment", F.col("baseline").alias("b"), F.col("candidate").alias("c"), "bounds", metrics)
    side = lambda key, name: reports.select(F.col("variant").alias(key), "metric", F.col("value").alias(name))
    both = asked.join(small(side("b", "baseline")), ["b", "metric"], "left").join(small(side("c", "candidate")), ["c", "metric"], "left")
    delta, bound = F.col("candidate") - F.col("baseline"), F.element_at("bounds", F.col("metric"))
    lift = F.when(F.col("baseline") == 0, F.when(F.col("candidate") > 0, 100.0).otherwise(0.0)).otherwise(delta / F.col("baseline") * 100)
    upper = F.col("metric").isin([m for m, way in COMPARED.items() if way == "most"])
    passed = F.when(delta.isNull(), False).when(bound.isNull(), True).when(upper, delta <= bound).otherwise(delta >= bound)
    return both.select("experiment", "metric", "baseline", "candidate", delta.alias("delta"), lift.alias("lift_percent"), passed.alias("passed"))
