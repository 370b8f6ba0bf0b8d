"""Search and reports over a source repository made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.io import table
from lodestone.operators import chunking, code, quality
from lodestone.operators import project as P
from lodestone.operators.fulltext import TextIndex
from lodestone.plans.book import Book
from lodestone.plans.content import FILE_PATH, FILE_TEXT, files_of
from lodestone.plans.search import kept_index

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

_FILES = f"files as (select p_partkey, {FILE_PATH} as path, {FILE_TEXT} as content, p_type as lang from part)"
#: Chunks, a file version for each document, and builds: the same in both engines.
_CHUNKS = "select doc_id as chunk_id, doc_id as file_id, doc_id % 3 as version_id, 0 as chunk_index, 1 as start_line, 9 as end_line, coalesce(text, '') as content, '' as searchable_text, 'fn' || doc_id as symbol_name, 'function' as symbol_kind, null as symbol_signature, lang, source from documents"
_BUILD = "select doc_id as file_id, doc_id % 3 as version_id, case when doc_id % 7 = 0 then 1 else 2 end as build_id, case when doc_id % 7 = 0 then 'building' else 'published' end as status, 'src/' || source || '/' || doc_id || '.ts' as source_path, lang from documents"


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    """The chunks."""
    return table(spark, d, "documents").selectExpr("doc_id as chunk_id", "doc_id as file_id", "doc_id % 3 as version_id", "0 as chunk_index", "1 as start_line", "9 as end_line", "coalesce(text, '') as content", "'' as searchable_text", "'fn' || doc_id as symbol_name", "'function' as symbol_kind", "cast(null as string) as symbol_signature", "lang", "source")


def build_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of all builds."""
    return table(spark, d, "documents").selectExpr("doc_id as file_id", "doc_id % 3 as version_id", "case when doc_id % 7 = 0 then 1 else 2 end as build_id", "case when doc_id % 7 = 0 then 'building' else 'published' end as status", "'src/' || source || '/' || doc_id || '.ts' as source_path", "lang")


def _published(spark: SparkSession, d: str) -> DataFrame:
    return build_files(spark, d).filter("status = 'published'")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    rows = table(spark, d, "embeddings").selectExpr("vec_id as chunk_id", "embedding", "case when label = 2 then 'old' else 'now' end as profile")
    return rows, [float(x) for x in rows.filter("chunk_id = 3").first()["embedding"]]


def project_index(spark: SparkSession, d: str) -> TextIndex:
    """The index of the published build's chunks."""
    bound = chunks_of(spark, d).join(_published(spark, d).select("file_id", "version_id", "source_path"), ["file_id", "version_id"])
    return kept_index(spark, d, "project", bound, T.code_search_text("symbol_name", "symbol_kind", "symbol_signature", "searchable_text", "content"))


@book.query(f"select chunk_id from ({_CHUNKS}) c join ({_BUILD}) b using (file_id, version_id) where status = 'published'")
def project_serving(spark: SparkSession, d: str) -> DataFrame:
    """Chunks bound to the published build."""
    return P.serving(chunks_of(spark, d), build_files(spark, d)).select("chunk_id")


_TERMS = r"list_filter(string_split_regex(lower(strip_accents(concat_ws(' ', symbol_name, symbol_kind, symbol_signature, content))), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"


@book.query(f"with w as (select chunk_id, unnest({_TERMS}) as term from ({_CHUNKS}) c join ({_BUILD}) b using (file_id, version_id) where status = 'published') select term, count(distinct chunk_id) as chunks, count(*) as occurrences from w group by 1")
def project_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Every term of the published build's index with its chunks and occurrences."""
    return project_index(spark, d).vocabulary().filter("field = 0").select("term", "chunks", "occurrences")


_GRAMS = r"list_distinct(flatten(list_transform(string_split_regex({0}, '[^\p{{L}}\p{{N}}]+'), lambda w: case when w = '' then [] else list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)) end)))"


def _search_sql(vector: bool) -> str:
    near = "select vec_id as chunk_id, greatest(coalesce(list_cosine_similarity(embedding::double[], (select embedding from embeddings where vec_id = 3)::double[]), 0), 0) as v from embeddings join bound on bound.chunk_id = vec_id where label <> 2 order by v desc, vec_id limit 500" if vector else "select null::bigint as chunk_id, 0::double as v where false"
    return f"""with bound as (select c.*, b.source_path from ({_CHUNKS}) c join ({_BUILD}) b using (file_id, version_id) where status = 'published'),
    t as (select *, lower(strip_accents(concat_ws(' ', symbol_name, symbol_kind, symbol_signature, content))) as s from bound), w as (select *, list_filter(string_split_regex(s, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') as w from t),
    k as (select *, 0.1::double * len(list_filter(w, lambda x: x = 'que')) as r from w), lex as (select chunk_id, 0::double as v from k where r > 0 order by r desc, chunk_id limit 500), near as ({near}),
    m as (select chunk_id, max(v) as v from (select * from lex union all select * from near) group by 1),
    g as (select k.*, m.v, {_GRAMS.format("s")} as a, {_GRAMS.format("lower(strip_accents(source_path))")} as p, {_GRAMS.format("'que'")} as q from k join m using (chunk_id))
    select source_path, chunk_index, symbol_name, round(v, 5) as vector_score, round(r * 10 + len(list_intersect(a, q)) / len(list_distinct(list_concat(a, q))) + len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q))) + (s like '%que%' or lower(source_path) like '%que%')::int * 0.25 + v * 12, 4) as score
    from g order by score desc, source_path, chunk_index limit 10"""


@book.query(_search_sql(True))
def project_search(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search over the published build."""
    vectors, asked = _vectors(spark, d)
    found = P.search(chunks_of(spark, d), _published(spark, d), "que", 10, vectors, asked, {"profile": "now"}, project_index(spark, d))
    return found.select("source_path", "chunk_index", "symbol_name", F.round("vector_score", 5).alias("vector_score"), F.round("score", 4).alias("score"))


@book.query(_search_sql(False))
def project_search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The same without an embedding: the lexical lane answers."""
    answer = P.search_with_fallback(chunks_of(spark, d), _published(spark, d), "que", 10, index=project_index(spark, d))
    return answer.results.select("source_path", "chunk_index", "symbol_name", F.round("vector_score", 5).alias("vector_score"), F.round("score", 4).alias("score"))


_EMB = "select doc_id as chunk_id, case when doc_id % 11 = 0 then null else doc_id % 3 end as version_id, case when doc_id % 5 = 0 then 'old' when doc_id % 7 = 0 then null else md5(coalesce(text, '')) end as source_hash, case when doc_id % 13 = 0 then 'm0' else 'm1' end as model, case when doc_id % 17 = 0 then 'p0' else 'p1' end as provider, case when doc_id % 19 = 0 then 64 else 1024 end as dimensions, 'x' as profile from documents where doc_id % 6 <> 0"
_OWN = "select doc_id as chunk_id, doc_id % 3 as version_id, case when doc_id % 4 = 0 then 9 else doc_id % 3 end as active_version_id, md5(coalesce(text, '')) as source_hash from documents"


@book.query(f"""with e as (select chunk_id, version_id as ev, source_hash as eh, model, provider, dimensions, profile from ({_EMB}) union all select chunk_id, version_id, source_hash, 'm0', provider, dimensions, profile from ({_EMB}) where chunk_id % 8 = 1), c as ({_OWN}),
    j as (select c.chunk_id, e.chunk_id is not null as there, coalesce(version_id <> active_version_id, true) as gap, coalesce(model = 'm1' and provider = 'p1' and dimensions = 1024 and profile = 'x' and version_id = active_version_id and ev = version_id and (eh is null or eh = source_hash), false) as valid, coalesce(model = 'm1' and provider = 'p1' and dimensions = 1024 and eh <> source_hash, false) as stale,
        coalesce(model <> 'm1', false) as mm, coalesce(model = 'm1' and provider <> 'p1', false) as pm, coalesce(model = 'm1' and dimensions <> 1024, false) as dm, coalesce(model = 'm1' and ev is null, false) as vg, coalesce(model = 'm1' and ev <> version_id, false) as vm from c left join e on e.chunk_id = c.chunk_id),
    f as (select chunk_id, sum(there::int) as n, bool_or(gap) as gap, bool_or(valid) as valid, bool_or(stale) as stale, bool_or(mm) as mm, bool_or(pm) as pm, bool_or(dm) as dm, bool_or(vg) as vg, bool_or(vm) as vm from j group by 1)
    select count(*) as chunk_owners, count(*) filter (where n > 0) as embedding_owners, sum(n)::bigint as embedding_records, count(*) filter (where valid) as owners_valid, count(*) filter (where not valid) as missing_owners, count(*) filter (where stale) as stale_owners, count(*) filter (where mm) as model_mismatch_owners, count(*) filter (where pm) as provider_mismatch_owners,
        count(*) filter (where dm) as dimension_mismatch_owners, count(*) filter (where gap) as chunk_version_gaps, count(*) filter (where vg) as embedding_version_gaps, count(*) filter (where vm) as embedding_version_mismatch_owners, 'drift' as status from f""")
def project_embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Chunks against their embeddings."""
    docs = table(spark, d, "documents")
    e = docs.filter("doc_id % 6 <> 0").selectExpr("doc_id as chunk_id", "case when doc_id % 11 = 0 then null else doc_id % 3 end as version_id", "case when doc_id % 5 = 0 then 'old' when doc_id % 7 = 0 then null else md5(coalesce(text, '')) end as source_hash", "case when doc_id % 13 = 0 then 'm0' else 'm1' end as model", "case when doc_id % 17 = 0 then 'p0' else 'p1' end as provider", "case when doc_id % 19 = 0 then 64 else 1024 end as dimensions", "'x' as profile")
    e = e.unionByName(e.filter("chunk_id % 8 = 1").withColumn("model", F.lit("m0")))
    c = docs.selectExpr("doc_id as chunk_id", "doc_id % 3 as version_id", "case when doc_id % 4 = 0 then 9 else doc_id % 3 end as active_version_id", "md5(coalesce(text, '')) as source_hash")
    return P.embedding_coverage(c, e, {"model": "m1", "provider": "p1", "dimensions": 1024, "profile": "x"})


_EMBEDDINGS = f"""e as (select chunk_id, version_id as ev, source_hash as eh, model, provider, dimensions, profile, case when chunk_id % 23 = 0 then 3 else dimensions end as length from ({_EMB})), c as ({_OWN}),
    j as (select c.chunk_id, coalesce(model = 'm1' and provider = 'p1' and dimensions = 1024 and profile = 'x' and version_id = active_version_id and ev = version_id and (eh is null or eh = source_hash), false) as valid, coalesce(model = 'm1' and provider = 'p1' and dimensions = 1024 and eh <> source_hash, false) as stale,
        coalesce(model <> 'm1' or provider <> 'p1' or dimensions <> 1024, false) as mis, coalesce(model = 'm1' and ev <> version_id, false) as vm, coalesce(length <> 1024, false) as short from c left join e on e.chunk_id = c.chunk_id),
    k as (select chunk_id::varchar as chunk_id, bool_or(valid) as valid, bool_or(stale) as stale, bool_or(mis) as mis, bool_or(vm) as vm, bool_or(short) as short from j group by 1)"""


def _embeddings_with_lengths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    e = docs.filter("doc_id % 6 <> 0").selectExpr("doc_id as chunk_id", "case when doc_id % 11 = 0 then null else doc_id % 3 end as version_id", "case when doc_id % 5 = 0 then 'old' when doc_id % 7 = 0 then null else md5(coalesce(text, '')) end as source_hash", "case when doc_id % 13 = 0 then 'm0' else 'm1' end as model", "case when doc_id % 17 = 0 then 'p0' else 'p1' end as provider", "case when doc_id % 19 = 0 then 64 else 1024 end as dimensions", "'x' as profile")
    c = docs.selectExpr("doc_id as chunk_id", "doc_id % 3 as version_id", "case when doc_id % 4 = 0 then 9 else doc_id % 3 end as active_version_id", "md5(coalesce(text, '')) as source_hash")
    return c, e.withColumn("length", F.when(F.col("chunk_id") % 23 == 0, 3).otherwise(F.col("dimensions")))


_LEAST = "coalesce(list_sort(list(distinct {0}) filter (where {1}))[1:10], [])"
_SAMPLES = ", ".join(f"{_LEAST.format('chunk_id', flag)} as {name}_sample" for name, flag in (("missing_owner", "not valid"), ("stale_owner", "stale"), ("mismatch_owner", "mis"), ("version_mismatch_owner", "vm")))


@book.query(f"with {_EMBEDDINGS} select count(*) filter (where short) as invalid_vector_length_owners, {_SAMPLES}, 'drift' as status from k")
def project_embedding_samples(spark: SparkSession, d: str) -> DataFrame:
    """The least owners of each problem, and those with vectors of another length."""
    c, e = _embeddings_with_lengths(spark, d)
    found = P.embedding_coverage(c, e, {"model": "m1", "provider": "p1", "dimensions": 1024, "profile": "x"}, samples=True)
    return found.select("invalid_vector_length_owners", *(f"{n}_owner_sample" for n in ("missing", "stale", "mismatch", "version_mismatch")), "status")


_TRACKED = "select 'src/' || o_orderkey as path, case when o_orderkey % 17 = 0 then 'blocked' when o_orderkey % 19 = 0 then 'deleted' else 'indexed' end as status, o_orderkey as k from orders where o_orderkey % 11 <> 0"
_INVARIANTS = f"""t as ({_TRACKED}), x as (select 'src/' || o_orderkey as path, o_orderkey % 23 = 0 as ignored from orders where o_orderkey % 13 <> 0), i as (select path, k from t where status = 'indexed'),
    s as (select coalesce(x.path, t.path) as path, x.path is not null as wanted, coalesce(ignored, false) as ignored, t.path is not null as tracked, coalesce(status = 'indexed', false) as indexed, coalesce(status = 'blocked', false) as blocked from x full join t on t.path = x.path),
    d as (select path, k % 29 = 0 as gone, k % 31 = 0 as unread, k % 37 = 0 as changed, k % 41 = 0 as touched from i), g as (select path, gone as missing, not gone and unread as unverified, not gone and not unread and changed as stale, not gone and not unread and not changed and touched as drift from d)"""


@book.query(f"""with {_INVARIANTS}, {_EMBEDDINGS}, a as (select count(*) filter (where wanted and not ignored) as expected_files, count(*) filter (where wanted and not ignored and not tracked) as missing_expected_files, count(*) filter (where wanted and not ignored and blocked) as blocked_expected_files, count(*) filter (where indexed and not wanted) as extra_indexed_files,
        count(*) filter (where ignored) as ignored_expected_files, count(*) filter (where indexed and ignored) as ignored_indexed_files, {_LEAST.format("path", "wanted and not ignored and not tracked")} as missing_expected_files_sample, {_LEAST.format("path", "indexed and not wanted")} as extra_indexed_files_sample, count(*) filter (where indexed) as indexed_files from s),
    b as (select count(*) filter (where missing) as missing_files, count(*) filter (where unverified) as unverified_files, count(*) filter (where stale) as stale_files, count(*) filter (where drift) as metadata_drift_files, count(*) filter (where not (missing or unverified or stale or drift)) as fresh_files, {_LEAST.format("path", "stale")} as stale_files_sample from g),
    e2 as (select count(*) as chunk_owners, count(*) filter (where valid) as owners_valid, count(*) filter (where short) as invalid_vector_length_owners, {_SAMPLES} from k)
    select *, 'unverified' as freshness_status, 'drift' as scope_status, 'drift' as embedding_status, 'PROJECT_INDEX_UNVERIFIED' as failure_code from a, b, e2""")
def project_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Scope, freshness, embeddings, ownership and readiness of an index in one row, with samples and the gate's answer."""
    tracked = table(spark, d, "orders").filter("o_orderkey % 11 <> 0").selectExpr("'src/' || o_orderkey as path", "case when o_orderkey % 17 = 0 then 'blocked' when o_orderkey % 19 = 0 then 'deleted' else 'indexed' end as status", "o_orderkey as k")
    expected = table(spark, d, "orders").filter("o_orderkey % 13 <> 0").selectExpr("'src/' || o_orderkey as path", "o_orderkey % 23 = 0 as ignored")
    indexed = tracked.filter("status = 'indexed'").selectExpr("path", "md5(path) as hash", "k as mtime", "1 as size", "k")
    disk = indexed.filter("k % 29 <> 0").selectExpr("path", "case when k % 31 = 0 then null when k % 37 = 0 then 'other' else hash end as hash", "case when k % 41 = 0 then mtime + 1 else mtime end as mtime", "size")
    c, e = _embeddings_with_lengths(spark, d)
    found = P.invariant_report(expected, tracked.drop("k"), indexed.drop("k"), disk, c, e, {"model": "m1", "provider": "p1", "dimensions": 1024, "profile": "x"}, project_ownership_coverage(spark, d), project_version_readiness(spark, d))
    scope = ["expected_files", "missing_expected_files", "blocked_expected_files", "extra_indexed_files", "ignored_expected_files", "ignored_indexed_files", "missing_expected_files_sample", "extra_indexed_files_sample", "indexed_files", "scope_status"]
    fresh = ["missing_files", "unverified_files", "stale_files", "metadata_drift_files", "fresh_files", "stale_files_sample", "freshness_status"]
    return found.select(*scope, *fresh, "chunk_owners", "owners_valid", "invalid_vector_length_owners", *(f"{n}_owner_sample" for n in ("missing", "stale", "mismatch", "version_mismatch")), "embedding_status", "failure_code")


@book.query("""with f as (select c_custkey as file_id, case when c_custkey % 9 = 0 then 'deleted' else 'indexed' end as status from customer where c_custkey % 10 <> 3), c as (select o_orderkey as chunk_id, o_custkey as file_id from orders), s as (select l_orderkey * 10 + l_linenumber as symbol_id, l_suppkey as file_id, l_orderkey as chunk_id from lineitem),
    e as (select o_custkey as source_file, case when o_orderkey % 2 = 0 then o_custkey + 1 end as target_file, o_orderkey * 10 + 1 as source_symbol, case when o_orderkey % 3 = 0 then o_orderkey * 10 + 9 end as target_symbol from orders)
    select (select count(*) from c left join f using (file_id) where f.status is null) as chunk_file_orphans, (select count(*) from c join f using (file_id) where f.status = 'deleted') as deleted_file_chunks, (select count(*) from s left join f using (file_id) where f.status is null) as symbol_file_orphans, (select count(*) from s join f using (file_id) where f.status = 'deleted') as deleted_file_symbols,
        (select count(*) from s where chunk_id not in (select chunk_id from c)) as symbol_chunk_orphans, (select count(*) from e where source_file not in (select file_id from f)) as edge_missing_source_files, (select count(*) from e where target_file not in (select file_id from f)) as edge_missing_target_files,
        (select count(*) from e where source_symbol not in (select symbol_id from s)) as edge_missing_source_symbols, (select count(*) from e where target_symbol not in (select symbol_id from s)) as edge_missing_target_symbols,
        (select count(*) from e where source_file in (select file_id from f where status = 'deleted') or target_file in (select file_id from f where status = 'deleted')) as deleted_file_edges, 'drift' as status""")
def project_ownership_coverage(spark: SparkSession, d: str) -> DataFrame:
    """References of chunks, symbols and edges that lead nowhere or to deleted files."""
    orders = table(spark, d, "orders")
    files = table(spark, d, "customer").filter("c_custkey % 10 <> 3").selectExpr("c_custkey as file_id", "case when c_custkey % 9 = 0 then 'deleted' else 'indexed' end as status")
    chunks = orders.selectExpr("o_orderkey as chunk_id", "o_custkey as file_id")
    symbols = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as symbol_id", "l_suppkey as file_id", "l_orderkey as chunk_id")
    edges = orders.selectExpr("o_custkey as source_file", "case when o_orderkey % 2 = 0 then o_custkey + 1 end as target_file", "o_orderkey * 10 + 1 as source_symbol", "case when o_orderkey % 3 = 0 then o_orderkey * 10 + 9 end as target_symbol")
    return P.ownership_coverage(files, chunks, symbols, edges)


_NOW = "1998-01-01 00:00:00"


@book.query(f"""with f as (select c_custkey, case when c_custkey % 8 = 0 then 'deleted' end as status, case when c_custkey % 5 <> 0 then c_custkey * 2 end as active, c_custkey * 2 + (c_custkey % 3 = 0)::int as latest from customer), v as (select o_orderkey as version_id, case o_orderkey % 3 when 0 then 'ready' when 1 then 'pending' else 'replaced' end as status, o_orderdate as created_at from orders),
    x as (select f.*, a.status as sa, l.status as sl, l.created_at as created from f left join v a on a.version_id = f.active left join v l on l.version_id = f.latest where coalesce(f.status, '') <> 'deleted'), p as (select *, coalesce(sl = 'pending' and latest is distinct from active, false) as pending from x)
    select count(active) as with_version, count(*) filter (where sa = 'ready') as active_ready, count(*) filter (where sa <> 'ready') as active_not_ready, count(*) filter (where active is null) as pending_backfill, count(*) filter (where active is null) as legacy_reads, count(*) filter (where pending) as pending_versions, count(*) filter (where pending and created < timestamp '{_NOW}' - interval 1 hour) as stale_pending, 'unverified' as status from p""")
def project_version_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Files by the state of their versions."""
    files = table(spark, d, "customer").selectExpr("c_custkey as file_id", "case when c_custkey % 8 = 0 then 'deleted' end as status", "case when c_custkey % 5 <> 0 then c_custkey * 2 end as active_version_id", "c_custkey * 2 + cast(c_custkey % 3 = 0 as int) as latest_version_id")
    versions = table(spark, d, "orders").selectExpr("o_orderkey as version_id", "case o_orderkey % 3 when 0 then 'ready' when 1 then 'pending' else 'replaced' end as status", "o_orderdate as created_at")
    return P.version_readiness(files, versions, F.lit(_NOW))


@book.query("""with s as (select l_orderkey, l_linenumber, l_quantity::int % 5 as files, l_suppkey % 4 as owners, ['fresh', 'fresh', 'fresh', 'stale', 'unverified', 'missing'][l_partkey % 6 + 1] as fr, ['covered', 'covered', 'drift', 'unverified'][l_orderkey % 4 + 1] as a, ['covered', 'drift', 'covered'][l_partkey % 3 + 1] as b, ['covered', 'covered', 'unverified', 'drift', 'covered'][l_suppkey % 5 + 1] as c, ['covered', 'drift'][l_linenumber % 2 + 1] as e, ['covered', 'unverified'][(l_orderkey + l_partkey) % 2 + 1] as v from lineitem)
    select l_orderkey, l_linenumber, case when files <= 0 or owners <= 0 then 'PROJECT_INDEX_EMPTY' when fr in ('stale', 'missing') then 'PROJECT_INDEX_STALE' when fr = 'unverified' then 'PROJECT_INDEX_UNVERIFIED' when a = 'drift' then 'PROJECT_INDEX_STALE' when a = 'unverified' then 'PROJECT_INDEX_UNVERIFIED' when b = 'drift' then 'PROJECT_INDEX_SCOPE_DRIFT'
        when c = 'drift' then 'PROJECT_INDEX_EMBEDDING_GAP' when c = 'unverified' then 'PROJECT_INDEX_UNVERIFIED' when e = 'drift' then 'PROJECT_INDEX_SCOPE_DRIFT' when v = 'unverified' then 'PROJECT_INDEX_UNVERIFIED' end as code, case when 'unverified' in (a, b, c, e, v) then 'unverified' when 'drift' in (a, b, c, e, v) then 'drift' else 'covered' end as status, ((a = 'drift')::int + (b = 'drift')::int + (c = 'drift')::int + (e = 'drift')::int + (v = 'drift')::int) as drifted from s""")
def project_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate's answer for the statuses that every line item stands for."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    c, o, g, u = "covered", F.col("l_orderkey"), "drift", "unverified"
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    fresh = pick(["fresh", "fresh", "fresh", "stale", u, "missing"], p % 6)
    checks = [pick([c, c, g, u], o % 4), pick([c, g, c], p % 3), pick([c, c, u, g, c], s % 5), pick([c, g], F.col("l_linenumber") % 2), pick([c, u], (o + p) % 2)]
    summary = P.gate_summary(*checks)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.gate(F.col("l_quantity").cast("int") % 5, s % 4, fresh, *checks).alias("code"), summary["status"].alias("status"), summary["drifted"].alias("drifted"))


@book.query(f"""with f as (select o_custkey as file_id, 1 as version_id, 'src/' || o_custkey as source_path, 'ts' as lang from (select distinct o_custkey from orders)), s as (select o_custkey as file_id, case when o_custkey % 2 = 0 then 1 when o_custkey % 3 = 0 then 2 end as version_id, 's' || o_orderkey as name, o_orderkey % 50 as start_line from orders),
    j as (select f.file_id, source_path, lang, s.name, s.start_line from f left join s on s.file_id = f.file_id and (s.version_id = f.version_id or s.version_id is null)), t as (select * from j order by source_path, start_line nulls last, name nulls last limit 5000)
    select file_id, source_path, lang, coalesce(list(name order by start_line, name) filter (where name is not null), []) as symbols from t group by 1, 2, 3""")
def project_graph_files(spark: SparkSession, d: str) -> DataFrame:
    """Files with their symbols, cut to the view's 5000 rows."""
    orders = table(spark, d, "orders")
    files = orders.select("o_custkey").distinct().selectExpr("o_custkey as file_id", "1 as version_id", "'src/' || o_custkey as source_path", "'ts' as lang")
    symbols = orders.selectExpr("o_custkey as file_id", "case when o_custkey % 2 = 0 then 1 when o_custkey % 3 = 0 then 2 end as version_id", "'s' || o_orderkey as name", "o_orderkey % 50 as start_line")
    return P.graph_files(files, symbols)


@book.query(f"with {_FILES}, b as (select *, contains(content, 'class Box') as x from files) select count(*) as files, count(*) + count(*) filter (where x) as symbols, count(*) filter (where x) as classes, count(*) as functions, 0::bigint as interfaces, 0::bigint as types, 0::bigint as enums, count(*) + count(*) filter (where x) as exports, count(*) as imports from b")
def skeleton_stats(spark: SparkSession, d: str) -> DataFrame:
    """Totals over all files."""
    files = files_of(spark, d)
    return P.skeleton_stats(files, code.symbols(files), code.edges(files))


@book.query(f"""with {_FILES}, x as (select *, p_partkey % 5 = 0 as gone, p_partkey % 7 = 0 as secret from files where p_partkey % 3 <> 0) select count(*) as code_files, count(*) filter (where gone) as missing, count(*) filter (where secret and not gone) as blocked, 2 * count(*) filter (where not gone and not secret) as calls, 2 * count(*) filter (where not gone and not secret) as imports, 0::bigint as without_edges, count(*) as indexed from x""")
def edge_backfill(spark: SparkSession, d: str) -> DataFrame:
    """What writing the edges of all files would give."""
    part = F.regexp_extract("path", r"f([0-9]+)\.ts$", 1).cast("bigint")
    files = files_of(spark, d).withColumn("status", F.when(part % 3 == 0, "deleted").otherwise("indexed"))
    files = files.withColumn("content", F.when(part % 5 != 0, F.col("content")))
    return P.edge_backfill(files, code.edges(files.filter("content is not null")), F.when(part % 7 == 0, "dot-env"))


@book.query(f"""with {_FILES} select path, 'function' as kind, 'part' || p_partkey as name, 'export function part' || p_partkey || '(a)' as signature from files union all select path, 'class', 'Box' || regexp_extract(content, 'class Box([0-9]+)', 1), 'export class Box' || regexp_extract(content, 'class Box([0-9]+)', 1) from files where contains(content, 'class Box')""")
def symbol_chunks(spark: SparkSession, d: str) -> DataFrame:
    """One chunk for each declaration of every file."""
    return chunking.symbol_chunks(files_of(spark, d)).select("path", "kind", "name", "signature")


@book.query()
def vector_clusters(spark: SparkSession, d: str) -> DataFrame:
    """All vectors in ten clusters by cosine distance."""
    return P.clusters(table(spark, d, "embeddings"), 10, key="vec_id")


@book.query("""with m as (select 'v' || (doc_id % 4) as variant, avg(quality::double) as hit_rate, avg(toxic::double) as exact_path_rate, avg((doc_id % 3 = 0)::int::double) as exact_symbol_rate, avg(quality * 0.5 + toxic * 0.25) as quality, max(doc_id)::double as latency_p95 from labels group by 1),
    r as (unpivot m on hit_rate, exact_path_rate, exact_symbol_rate, quality, latency_p95 into name metric value value), x as (select 'e' || i || j as experiment, 'v' || i as b, 'v' || j as c, i from range(0, 5) t(i), range(0, 4) u(j)),
    k as (select experiment, i, n.metric, rb.value as baseline, rc.value as candidate from x, (values ('hit_rate'), ('exact_path_rate'), ('exact_symbol_rate'), ('quality'), ('latency_p95')) n(metric) left join r rb on rb.variant = b and rb.metric = n.metric left join r rc on rc.variant = c and rc.metric = n.metric)
    select experiment, metric, round(baseline, 6) as baseline, round(candidate, 6) as candidate, round(candidate - baseline, 6) as delta, round(case when baseline = 0 then case when candidate > 0 then 100 else 0 end else (candidate - baseline) / baseline * 100 end, 5) as lift_percent,
        case when candidate - baseline is null then false when metric = 'hit_rate' then candidate - baseline >= 0.01 when metric = 'latency_p95' then candidate - baseline <= 2 else true end as passed from k""")
def variant_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of four variants, whose metrics come from all labels, and one that is not there."""
    q, t = F.col("quality"), F.col("toxic")
    m = table(spark, d, "labels").groupBy(F.concat(F.lit("v"), (F.col("doc_id") % 4).cast("string")).alias("variant")).agg(F.avg(q.cast("double")).alias("hit_rate"), F.avg(t.cast("double")).alias("exact_path_rate"), F.avg((F.col("doc_id") % 3 == 0).cast("double")).alias("exact_symbol_rate"), F.avg(q * 0.5 + t * 0.25).alias("quality"), F.max("doc_id").cast("double").alias("latency_p95"))
    reports = m.unpivot(["variant"], list(P.COMPARED), "metric", "value")
    bounds = F.create_map(F.lit("hit_rate"), F.lit(0.01), F.lit("latency_p95"), F.lit(2.0))
    pairs = spark.range(5).select(F.col("id").cast("string").alias("i"), F.explode(F.array(*(F.lit(str(j)) for j in range(4)))).alias("j"))
    asked = pairs.select(F.concat(F.lit("e"), "i", "j").alias("experiment"), F.concat(F.lit("v"), "i").alias("baseline"), F.concat(F.lit("v"), "j").alias("candidate"), bounds.alias("bounds"))
    found = P.compare_variants(reports, asked)
    return found.select("experiment", "metric", *(F.round(c, 6).alias(c) for c in ("baseline", "candidate", "delta")), F.round("lift_percent", 5).alias("lift_percent"), "passed")


@book.query(r"""with x as (select o_orderkey, o_orderkey % 12 as n from orders) select o_orderkey, ['aws-dir', 'ssh-dir', 'dot-env', 'dot-env', 'pem-file', 'kubeconfig', 'ssh-id-rsa', 'api-key-in-name', 'credentials-json', null, null, 'github-pat'][n + 1] as reason from x""")
def path_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rule that blocks each of many paths; some are safe, one is blocked by its content."""
    paths = ["/h/.aws/config", "/h/.ssh/id_rsa", "/a/.env", "/a/.env.local", "/a/Server.PEM", "/a/kubeconfig", "/a/id_rsa", "/a/my_api-key.ts", "/a/x.credentials.json", "/a/environment.ts", "/a/.envrc", "/a/b.ts"]
    at = (F.col("o_orderkey") % 12 + 1).cast("int")
    content = F.when(at == 12, "x = ghp_" + "a1B2" * 9).otherwise("")
    return table(spark, d, "orders").select("o_orderkey", quality.path_security(F.element_at(F.array(*map(F.lit, paths)), at), content).alias("reason"))
