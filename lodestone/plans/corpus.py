"""Building a corpus: documents, metadata, pairing, payloads, plans and snapshots over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.io import table, written
from lodestone.operators import corpus as C
from lodestone.operators import digests, transitions
from lodestone.plans.book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

#: A Markdown file for each document, the same text in both engines.
MD_PATH = "'docs/' || source || '/' || doc_id || case when doc_id % 3 = 0 then '.mdx' else '.md' end"
MD_TEXT = "case when doc_id % 4 = 0 then '---' || chr(10) || 'title: \"Paper ' || doc_id || '\"' || chr(10) || 'lang: ' || coalesce(lang, 'none') || chr(10) || '---' || chr(10) else '' end || case when doc_id % 2 = 0 then '# About ' || source || chr(10) else '' end || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '## Part of ' || doc_id || ' ##' || chr(10) || coalesce(text, '')"
_MD = f"md as (select doc_id, source, lang, {MD_PATH} as path, {MD_TEXT} as content, text from documents)"


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """The files."""
    return table(spark, d, "documents").selectExpr("doc_id", "source", "lang", f"{MD_PATH} as path", f"{MD_TEXT} as content")


@book.query(f"""with {_MD}, b as (select *, case when doc_id % 4 = 0 then substring(content, length('---' || chr(10) || 'title: "Paper ' || doc_id || '"' || chr(10) || 'lang: ' || coalesce(lang, 'none') || chr(10) || '---' || chr(10)) + 1) else content end as body,
    case when doc_id % 4 = 0 then 'Paper ' || doc_id when doc_id % 2 = 0 then 'About ' || source else 'no heading' end as title from md)
    select path, title, sha256(content) as content_hash, sha256(body) as processed_hash, sha256(title || chr(10) || chr(10) || path || chr(10) || chr(10) || substring(body, 1, 2000)) as searchable_sha256 from b""")
def document_build(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every file: title, digests, searchable text."""
    found = C.build_documents(markdown(spark, d))
    return found.select("path", "title", "content_hash", "processed_hash", F.sha2("searchable_text", 256).alias("searchable_sha256"))


@book.query()
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of every built document."""
    found = C.document_chunks(C.build_documents(markdown(spark, d)))
    return found.select("path", "chunk_index", F.sha2("searchable_text", 256).alias("sha256"), "section", "start_line", "end_line")


@book.query(f"""with {_MD}, h as (select doc_id, unnest(case when doc_id % 2 = 0 then [{{'depth': 1, 'text': 'About ' || source}}, {{'depth': 2, 'text': 'Part of ' || doc_id}}] else [{{'depth': 2, 'text': 'Part of ' || doc_id}}] end) as h from md),
    x as (select doc_id, t.i as at, string_split(t.line, chr(10)) as l from (select doc_id, 1 as i, coalesce(text, '') as line from md) t), y as (select doc_id, unnest(l) as line from x)
    select doc_id, h.depth as depth, h.text as text from h union all select doc_id, length(regexp_extract(line, '^(#+)', 1)), regexp_extract(line, '^#+\\s+(.+?)\\s*#*\\s*$', 1) from y where regexp_matches(line, '^#{{1,6}}\\s+\\S')""")
def document_headings(spark: SparkSession, d: str) -> DataFrame:
    """The headings of every file, none of those between code fences."""
    rows = markdown(spark, d).select("doc_id", F.explode(C.headings("content")).alias("h"))
    return rows.select("doc_id", F.col("h.depth").alias("depth"), F.col("h.text").alias("text"))


_CHANGES = "changes as (select doc_id, case doc_id % 5 when 0 then 'A' when 1 then 'M' when 2 then 'D' else 'R' end as op from documents)"


@book.query(f"""with {_CHANGES}, t as (select doc_id, coalesce(text, '') as text from documents join changes using (doc_id) where op in ('A', 'M')),
    w as (select doc_id, i as chunk_index, trim(substring(text, i * 448 + 1, 512), ' ') as content from (select *, unnest(range(0, cast(ceil(greatest(length(text) - 512, 0) / 448.0) as bigint) + 1)) as i from t where length(text) > 512) union all select doc_id, 0, text from t where length(text) <= 512),
    c as (select * , row_number() over (partition by doc_id order by chunk_index) - 1 as n from w where content <> '')
    select 'docs/' || doc_id as path, 'upsert' as kind, n::int as chunk_index, md5(content) as md5 from c union all select 'docs/' || doc_id, 'delete', null, null from changes where op = 'D'""")
def delta_payload(spark: SparkSession, d: str) -> DataFrame:
    """Windows of added and modified documents, and the deleted ones."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
    op = F.element_at(F.array(*map(F.lit, "AMDRR")), (F.col("doc_id") % 5 + 1).cast("int"))
    chunks, gone = C.upsert_payload(docs.select("path", op.alias("op")), docs.select("path", "content"))
    chunks = chunks.select("path", F.lit("upsert").alias("kind"), F.col("chunk_index").cast("int").alias("chunk_index"), F.md5("content").alias("md5"))
    return chunks.unionByName(gone.select("path", F.lit("delete").alias("kind"), F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("md5")))


@book.query("""with r as (select 'src' || i as source_id, 'lib/src' || i || '/' as prefix, 'cat' || (i % 2) as category, 'l' || i as language, ['registry', 't' || i] as tags from range(0, 4) t(i)),
    x as (select doc_id as id, case when doc_id % 3 = 0 then source when doc_id % 3 = 1 then ' own ' end as source_id, case when doc_id % 2 = 0 then 'lib/' || source || '/a/' || doc_id || '.md' else 'misc/' || doc_id end as source_path, case when doc_id % 5 = 0 then 'src1' else 'plain' end as category, lang as language, [' B ', 'registry'] as tags from documents)
    select x.id, coalesce(a.source_id, p.source_id, c.source_id, nullif(trim(x.source_id), '')) as source_id, coalesce(a.category, p.category, c.category, x.category) as category, coalesce(a.language, p.language, c.language, nullif(trim(x.language), '')) as language,
        case when coalesce(a.source_id, p.source_id, c.source_id) is null then ['b', 'registry'] else list_concat(coalesce(a.tags, p.tags, c.tags), ['b']) end as tags
    from x left join r a on a.source_id = x.source_id left join r p on starts_with(x.source_path, p.prefix) left join r c on c.source_id = x.category""")
def source_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of every document after the registry's."""
    registry = spark.range(4).selectExpr("'src' || id as source_id", "'lib/src' || id || '/' as prefix", "'cat' || (id % 2) as category", "'l' || id as language", "array('registry', 't' || id) as tags")
    rows = table(spark, d, "documents").selectExpr("doc_id as id", "case when doc_id % 3 = 0 then source when doc_id % 3 = 1 then ' own ' end as source_id", "case when doc_id % 2 = 0 then 'lib/' || source || '/a/' || doc_id || '.md' else 'misc/' || doc_id end as source_path", "case when doc_id % 5 = 0 then 'src1' else 'plain' end as category", "lang as language", "array(' B ', 'registry') as tags")
    return C.normalised_metadata(rows, registry)


_PAIRS = "s as (select 'a/' || doc_id || case when doc_id % 2 = 0 then '.mdx' else '.md' end as path, doc_id % 10 as mtime, doc_id from documents), p as (select case when doc_id % 4 = 0 then 'a/' || doc_id || '.md' when doc_id % 9 = 1 then 'b/' || doc_id || case when doc_id % 5 = 0 then '_index.md' else '.md' end else 'a/' || doc_id || case when doc_id % 2 = 0 then '.mdx' else '.md' end end as path, 5 as mtime from documents where doc_id % 7 <> 0)"
_STATES = f"""{_PAIRS}, m as (select s.path, s.mtime, coalesce(p.mtime, q.mtime) as done from s left join p on p.path = s.path left join p q on s.path like '%.mdx' and q.path = regexp_replace(s.path, '\\.mdx$', '.md')),
    st as (select path, case when done is null then 'missing' when done < mtime then 'stale' else 'covered' end as state from m union all select path, 'orphaned' from p where path not like '%\\_index.md' escape '\\' and path not in (select path from s) and path not in (select regexp_replace(path, '\\.mdx$', '.md') from s where path like '%.mdx'))"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    end = F.when(F.col("doc_id") % 2 == 0, ".mdx").otherwise(".md")
    i = F.col("doc_id").cast("string")
    sources = docs.select(F.concat(F.lit("a/"), i, end).alias("path"), (F.col("doc_id") % 10).alias("mtime"))
    done = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("a/"), i, F.lit(".md"))).when(F.col("doc_id") % 9 == 1, F.concat(F.lit("b/"), i, F.when(F.col("doc_id") % 5 == 0, "_index.md").otherwise(".md"))).otherwise(F.concat(F.lit("a/"), i, end))
    return C.coverage(sources, docs.filter("doc_id % 7 <> 0").select(done.alias("path"), F.lit(5).alias("mtime")))


@book.query(f"with {_STATES} select path, state from st")
def processed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Source files and their processed ones."""
    return _states(spark, d)


@book.query(f"""with {_STATES} select count(*) filter (where state <> 'orphaned') as sources, count(*) filter (where state = 'missing') as missing, count(*) filter (where state = 'stale') as stale, count(*) filter (where state = 'orphaned') as orphaned,
    (count(*) filter (where state <> 'orphaned') - count(*) filter (where state = 'missing')) / count(*) filter (where state <> 'orphaned') * 100 as coverage, count(*) filter (where state in ('missing', 'stale')) = 0 as passed from st""")
def processed_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the pairing."""
    return C.coverage_summary(_states(spark, d))


@book.query("""select event_id, case when event_id % 12 > 8 then 'depth' when event_id % 13 = 0 then 'not-json' when event_id % 17 = 0 then 'items' end as problem from events""")
def result_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Results of jobs, made of every event, against their bounds."""
    depth = (F.col("event_id") % 12).cast("int")
    nested = F.concat(F.repeat(F.lit('{"a":'), depth), F.col("props"), F.repeat(F.lit("}"), depth))
    bad = F.col("event_id")
    raw = F.when(depth > 8, nested).when(bad % 13 == 0, F.concat("props", F.lit("x"))).when(bad % 17 == 0, F.concat(F.lit("[0"), F.repeat(F.lit(",1"), 511), F.lit("]"))).otherwise(F.when(depth < 8, nested).otherwise(F.col("props")))
    rows = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return C.checked(rows, "event_id", "raw", C.result_problem, "problem")


@book.query("""select doc_id, case when doc_id % 6 = 0 then ['includeRoots[0]: absolute', 'includeRoots[0]: empty segment'] when doc_id % 6 = 1 then ['includeRoots[1]: duplicate'] when doc_id % 6 = 2 then ['unknown key extra'] when doc_id % 6 = 3 then ['not JSON'] when doc_id % 6 = 4 then ['includeRoots[0]: blocked name', 'ignoreRules[0]: empty'] else [] end as errors from documents""")
def manifest_checks(spark: SparkSession, d: str) -> DataFrame:
    """Root manifests, one for each document, and what is wrong with them."""
    docs = table(spark, d, "documents").withColumn("raw", F.element_at(F.array(
        F.concat(F.lit('{"manifestVersion":1,"includeRoots":["/'), "source", F.lit('"]}')), F.concat(F.lit('{"manifestVersion":1,"includeRoots":["'), "source", F.lit('","'), "source", F.lit('"]}')),
        F.lit('{"manifestVersion":1,"extra":0}'), F.concat(F.lit("{"), "source"), F.concat(F.lit('{"manifestVersion":1,"includeRoots":["a/'), F.when(F.col("doc_id") % 12 == 4, "node_modules").otherwise(F.concat("source", F.lit(".egg-info"))), F.lit('/b"],"ignoreRules":[" "]}')), F.concat(F.lit('{"manifestVersion":1,"includeRoots":["'), "source", F.lit('"],"ignoreRules":["**/x"]}')),
    ), (F.col("doc_id") % 6 + 1).cast("int")))
    return C.checked(docs, "doc_id", "raw", C.manifest_errors, "errors")


@book.query(r"""select doc_id, md5(nullif(substring(regexp_replace(regexp_replace(regexp_replace(t, '/(?:[^\s/]+/?)+', '<path>', 'g'), '[A-Za-z]:\\[^\s]*', '<path>', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), 1, 1024), '')) as detail_md5
    from (select doc_id, case when doc_id % 9 = 0 then '' else 'failed at /srv/app//' || source || '/' || doc_id || '.ts or C:\tmp\x ' || chr(7) || coalesce(text, '') end as t from documents)""")
def failure_details(spark: SparkSession, d: str) -> DataFrame:
    """Failure texts made of whole documents, without paths and control characters."""
    t = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(F.lit("failed at /srv/app//"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".ts or C:\\tmp\\x \x07"), F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", F.md5(C.failure_detail(t)).alias("detail_md5"))


@book.query("""with x as (select page_id, case when page_id % 2 = 0 then url end as canonical_url, case when page_id % 3 = 0 then ' ' else 'r' || page_id end as source_revision, case when page_id % 5 <> 0 then timestamp '2024-01-01' end as synced_at, case when page_id % 7 <> 0 then 'official' end as authority from pages),
    m as (select page_id, list_filter([case when canonical_url is null then 'canonicalUrl' end, case when trim(source_revision) = '' then 'sourceRevision' end, case when synced_at is null then 'syncedAt' end, case when authority is null then 'authority' end], lambda v: v is not null) as missing_fields from x)
    select page_id, missing_fields, case when len(missing_fields) = 0 then 'complete' else 'degraded' end as provenance_status from m""")
def result_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Provenance of every page as a result."""
    n = F.col("page_id")
    rows = table(spark, d, "pages").select("page_id", F.when(n % 2 == 0, F.col("url")).alias("canonical_url"), F.when(n % 3 == 0, " ").otherwise(F.concat(F.lit("r"), n.cast("string"))).alias("source_revision"), F.when(n % 5 != 0, F.lit("2024-01-01").cast("timestamp")).alias("synced_at"), F.when(n % 7 != 0, "official").alias("authority"))
    return C.provenance(rows).select("page_id", "missing_fields", "provenance_status")


@book.query("""with r as (select source, case when source = 'src0' then 0 else count(*) end as total, case when source in ('src0', 'src1') then 0 else count(*) end as attempted, case when source in ('src0', 'src1') then 0 else count(*) filter (where coalesce(lang, '') <> 'fr') end as processed, 0 as skipped, case when source = 'src0' then 0 else count(*) filter (where coalesce(lang, '') = 'fr') end as failed from documents group by 1),
    t as (select sum(failed)::double as f, case when sum(attempted) > 0 then sum(failed) / sum(attempted) else 0 end as rate from r)
    select 'no-documents' as alert, list_sort(list(source)) as sources, count(*)::double as value from r where total = 0 and failed = 0 having count(*) > 0 union all select 'none-eligible', list_sort(list(source)), count(*)::double from r where total > 0 and attempted = 0 having count(*) > 0
    union all select 'failed-files', [], f from t where f > 3 union all select 'failure-rate', [], rate from t where rate > 0.01""")
def sync_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of a synchronisation made of all documents."""
    s, n = F.col("source"), F.count("*")
    french = F.count_if(F.coalesce("lang", F.lit("")) == "fr")
    none = s.isin("src0", "src1")
    rows = table(spark, d, "documents").groupBy("source").agg(n.alias("n"), french.alias("f"))
    rows = rows.select("source", F.when(s == "src0", 0).otherwise(F.col("n")).alias("total"), F.when(none, 0).otherwise(F.col("n")).alias("attempted"), F.when(none, 0).otherwise(F.col("n") - F.col("f")).alias("processed"), F.lit(0).alias("skipped"), F.when(s == "src0", 0).otherwise(F.col("f")).alias("failed"))
    return C.sync_alerts(rows, 3, 0.01)


def _tree(rows: str, *columns: str) -> str:
    """SQL of a digest of rows with the given columns, of which the first is the key."""
    text = ["coalesce('=' || " + c + ", '-')" for c in columns]
    entry = " || chr(31) || ".join(text)
    return f"""(with recursive_ as (select sha256({text[0]}) as place, sha256({entry}) as entry from ({rows})), counted as (select left(place, 6) as node, sha256(entry || chr(31) || count(*)) as part from recursive_ group by place, entry),
    l6 as (select node, sha256(string_agg(part, '' order by part)) as d from counted group by 1), l4 as (select left(node, 4) as up, sha256(string_agg(node || d, '' order by node || d)) as d from l6 group by 1), l2 as (select left(up, 2) as up2, sha256(string_agg(up || d, '' order by up || d)) as d from l4 group by 1)
    select coalesce(sha256(string_agg(up2 || d, '' order by up2 || d)), sha256('')) from l2)"""


_C, _T = "select doc_id::varchar as path, case when doc_id % 5 = 0 then 'new' else md5(coalesce(text, '')) end as hash from documents where doc_id % 4 <> 0", "select doc_id::varchar as path, md5(coalesce(text, '')) as hash from documents where doc_id % 3 <> 0"


@book.query(f"""with x as (select coalesce(t.path, c.path) as path, case when t.path is null then 'add' when c.path is null then 'delete' when t.hash <> c.hash then 'update' else 'unchanged' end as change from ({_T}) t full join ({_C}) c on c.path = t.path),
    p as (select count(*) filter (where change = 'add') as adds, count(*) filter (where change = 'update') as updates, count(*) filter (where change = 'delete') as deletes, count(*) filter (where change <> 'delete') as eligible, count(*) filter (where change <> 'add') as tracked, (select count(*) from documents where doc_id % 11 = 0) as blocked, 'incomplete' as status, false as deletion_allowed,
        {_tree(_C, "path", "hash")} as inventory_hash, {_tree(_T, "path", "hash")} as baseline_hash, {_tree("select path from x where change = 'delete'", "path")} as stale_hash, {_tree("select distinct 'src/' || source as path from documents", "path")} as scope_hash, sha256('corpus') as root_hash,
        sha256({_tree("select distinct lang || '/**' as rule from documents", "rule")} || '|' || {_tree("select doc_id::varchar as path, 'dot-env' as category from documents where doc_id % 22 = 0", "path", "category")}) as policy_hash,
        (select sha256(string_agg(v, chr(10) order by v)) from (select distinct 'unreadable|' || doc_id as v from documents where doc_id % 13 = 0)) as evidence from x)
    select adds, updates, deletes, eligible, tracked, blocked, status, deletion_allowed, inventory_hash, baseline_hash, scope_hash, root_hash, policy_hash,
        sha256(concat_ws('|', adds, updates, deletes, stale_hash, inventory_hash, baseline_hash, scope_hash, policy_hash, root_hash, status, evidence, 'false', 'False', '')) as plan_hash from p""")
def preflight_plan(spark: SparkSession, d: str) -> DataFrame:
    """What an ingest of all documents would do, after a scan with an issue, and the six digests that bind it."""
    docs = table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string")).withColumn("hash", F.md5(F.coalesce("text", F.lit(""))))
    tracked = docs.filter("doc_id % 3 <> 0").select("path", "hash")
    candidates = docs.filter("doc_id % 4 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, "new").otherwise(F.col("hash")).alias("hash"))
    findings = docs.filter("doc_id % 11 = 0").select("path", F.lit("dot-env").alias("reason"))
    issues = docs.filter("doc_id % 13 = 0").select(F.lit("unreadable").alias("code"), "path", F.lit(False).alias("fatal"))
    scope = docs.select(F.concat(F.lit("src/"), "source").alias("path")).distinct()
    rules, allow = docs.select(F.concat("lang", F.lit("/**")).alias("rule")).distinct(), docs.filter("doc_id % 22 = 0").select("path", F.lit("dot-env").alias("category"))
    found = C.preflight(spark, candidates, tracked, findings, issues, root="corpus", scope=scope, rules=rules, allow=allow)
    return found.select("adds", "updates", "deletes", "eligible", "tracked", "blocked", "status", "deletion_allowed", "inventory_hash", "baseline_hash", "scope_hash", "root_hash", "policy_hash", "plan_hash")


_FOUND = "select 'src/' || source || '/' || doc_id as path, coalesce(lang, 'none') as category, doc_id from documents where doc_id % 3 <> 0"


@book.query(f"""with f as ({_FOUND}), s as (select category, case when doc_id % 10 = 7 then 'suppressed' else 'blocked' end as state, path from f union all select 'none', 'not encountered', 'src/' || r_name from region)
    select category, state, least(count(*), 50000) as count, list_sort(list(distinct path))[1:32] as sample from s group by 1, 2""")
def blocked_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings by category with bounded samples, after an allow list of which some entries were not encountered."""
    path = F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path")
    found = table(spark, d, "documents").filter("doc_id % 3 <> 0").select(path, F.coalesce("lang", F.lit("none")).alias("category"), "doc_id")
    unknown = table(spark, d, "region").select(F.concat(F.lit("src/"), "r_name").alias("path"), F.lit("none").alias("category"))
    return digests.blocked_findings(found.drop("doc_id"), found.filter("doc_id % 10 = 7").drop("doc_id").unionByName(unknown))


_SNAP_KINDS = ["claim", "review", "approve", "reject", "renew", "consume", "fail", "sweep", "claim", "defer", "consume"]
_NOW = "2024-01-20 00:00:00"
_DAY = 86_400_000_000
#: Half of the snapshots start under review; the time of everything is their events' own.
_SNAPS = f"""e as (select user_id * 8 + event_id % 8 as k, event_id as seq, {_SNAP_KINDS}[(event_id // 8) % 11 + 1] as kind0, epoch_us(ts) as moment from events),
    o as (select k, seq, moment, row_number() over w as n, case when row_number() over w = 1 then 'prepare' when row_number() over w = 2 and k % 2 = 0 then 'review' else kind0 end as kind from e window w as (partition by k order by seq))"""


@book.query(f"""with recursive {_SNAPS}, r as (select distinct k, 0::bigint as n, null::varchar as status, null::varchar as failure, null::bigint as expires, null::bigint as lease, null::bigint as approved, 0 as refused, 0 as late from o union all
    select k, n, case when why is not null then status when kind = 'prepare' then 'PREPARED' when kind = 'fail' or kind = 'reject' then 'FAILED' when kind = 'sweep' then case when status = 'CONSUMING' then 'FAILED' else 'EXPIRED' end when kind = 'review' then 'REVIEW_REQUIRED' when kind = 'claim' then 'CONSUMING' when kind = 'consume' then 'CONSUMED' else status end,
        case when why is not null then failure when kind = 'fail' then 'SYSTEM_ERROR' when kind = 'reject' then 'REVIEW_REJECTED' when kind = 'sweep' and status = 'CONSUMING' then 'CLAIM_LEASE_ABANDONED' else failure end, case when why is null and kind = 'prepare' then moment + 6 * {_DAY} else expires end,
        case when why is null and kind in ('claim', 'renew') then moment + 6 * {_DAY} when why is null and kind in ('fail', 'sweep', 'consume') then null else lease end, case when why is null and kind = 'approve' then moment + 4 * {_DAY} else approved end, refused + (why is not null)::int, late + coalesce(why = 'lease over', false)::int
    from (select r.k, o.n, kind, moment, status, failure, expires, lease, approved, refused, late, case when kind = 'prepare' then case when status is not null then 'exists' end when status is null then 'no snapshot' when status in ('CONSUMED', 'FAILED', 'EXPIRED') then 'status' when kind = 'fail' then null
            when kind = 'sweep' then case when not (status in ('PREPARED', 'REVIEW_REQUIRED') and expires <= moment or status = 'CONSUMING' and lease <= moment) then 'nothing to sweep' end
            when kind = 'review' and status <> 'PREPARED' or kind in ('approve', 'reject', 'defer') and status <> 'REVIEW_REQUIRED' then 'status' when kind in ('review', 'approve', 'reject', 'defer') then case when expires <= moment then 'expired' when kind = 'reject' and approved is not null then 'approved before' end
            when kind = 'claim' then case when status = 'CONSUMING' then 'status' when expires <= moment then 'expired' when status = 'REVIEW_REQUIRED' and (approved is null or approved <= moment) then 'not approved' end
            else case when status <> 'CONSUMING' then 'status' when lease <= moment then 'lease over' end end as why from r join o on o.k = r.k and o.n = r.n + 1)),
    z as (select *, row_number() over (partition by k order by n desc) as last, epoch_us(timestamp '{_NOW}') as now from r)
    select k as snapshot_id, case when status in ('PREPARED', 'REVIEW_REQUIRED') and expires <= now then 'EXPIRED' when status = 'CONSUMING' and lease <= now then 'FAILED' else status end as status, case when status = 'CONSUMING' and lease <= now then 'CLAIM_LEASE_ABANDONED' else failure end as failure, refused::bigint as refused, late::bigint as late from z where last = 1""")
def snapshot_states(spark: SparkSession, d: str) -> DataFrame:
    """Ingest snapshots folded in the order of their events; what the state doesn't allow is refused and counted."""
    key, own = (F.col("user_id") * 8 + F.col("event_id") % 8).alias("key"), Window.partitionBy("key").orderBy("seq")
    kind = F.element_at(F.array(*map(F.lit, _SNAP_KINDS)), (F.floor(F.col("event_id") / 8) % 11 + 1).cast("int"))
    rows = table(spark, d, "events").select(key, F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").alias("at")).withColumn("n", F.row_number().over(own))
    rows = rows.withColumn("kind", F.when(F.col("n") == 1, "prepare").when((F.col("n") == 2) & (F.col("key") % 2 == 0), "review").otherwise(F.col("kind")))
    rows = rows.withColumn("until", F.when(F.col("kind") == "approve", F.col("at") + F.expr("interval 4 day")))
    found = written(transitions.fold(rows, transitions.Snapshot, transitions.snapshot_rules(6 * 86400), now=F.lit(_NOW)), "snapshots")
    refused = transitions.rejected(found).groupBy("key").agg(F.count("*").alias("refused"), F.count_if(F.col("reason") == "lease over").alias("late"))
    nothing = [F.coalesce(c, F.lit(0)).alias(c) for c in ("refused", "late")]
    return transitions.states(found).join(refused, "key", "left").select(F.col("key").alias("snapshot_id"), "status", "failure", *nothing)


@book.query(r"""with p as (select doc_id, lang, source, coalesce(text, '') as text from documents), u as (select doc_id, lower(strip_accents(concat_ws(' ', 'Café ' || source, 'cat', 'kind', lang, case when doc_id % 2 = 0 then 'Official' end, case when doc_id % 3 = 0 then 'Über' else text end))) as a,
    lower(strip_accents(concat_ws(' ', 'Head ' || doc_id, source, text))) as b, lower(strip_accents(concat_ws(' ', 'src/' || source, lang, 'skéleton'))) as c, lower(strip_accents(concat_ws(' ', 'fnName', 'function', '(a: B)', text))) as e from p)
    select doc_id, md5(regexp_replace(a, '[^\x00-\x7F]', '', 'g')) as document, md5(regexp_replace(b, '[^\x00-\x7F]', '', 'g')) as chunk, md5(c) as file, md5(regexp_replace(e, '[^\x00-\x7F]', '', 'g')) as code from u""")
def search_projections(spark: SparkSession, d: str) -> DataFrame:
    """What search sees of documents, chunks, files and code; characters outside ASCII are left out of the comparison."""
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    ascii_ = lambda c: F.md5(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    document = T.document_search_text(F.concat(F.lit("Café "), "source"), F.lit("cat"), F.lit("kind"), "lang", F.when(F.col("doc_id") % 2 == 0, "Official"), F.when(F.col("doc_id") % 3 == 0, "Über").otherwise(""), "text")
    chunk = T.chunk_search_text(F.concat(F.lit("Head "), F.col("doc_id").cast("string")), "source", F.lit(None).cast("string"), "text")
    file = T.file_search_text(F.concat(F.lit("src/"), "source"), "lang", F.lit("skéleton"))
    code = T.code_search_text(F.lit("fnName"), F.lit("function"), F.lit("(a: B)"), F.lit(""), "text")
    return docs.select("doc_id", ascii_(document).alias("document"), ascii_(chunk).alias("chunk"), F.md5(file).alias("file"), ascii_(code).alias("code"))


