"""Cleaning, redaction, code metrics, chunks and code structure over documents, pages and generated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.io import dealt, shuffled, table
from lodestone.operators import chunking, code, quality
from lodestone.plans.book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

#: A source file for each part, the same text in both engines.
FILE_PATH = "'src/' || lower(replace(p_brand, '#', '')) || '/m' || (p_partkey % 7) || '/f' || p_partkey || '.ts'"
FILE_TEXT = """'import { helper } from ''../m' || ((p_partkey + 7) % 7) || '/f' || (p_partkey + 7) || ''';' || chr(10) || '// TODO check ' || p_name || chr(10) || case when p_size % 5 = 0 then '// FIXME and HACK' || chr(10) else '' end || 'export function part' || p_partkey || '(a) {' || chr(10)
    || '  if (a && ' || p_size || ' > 10 || b) {' || chr(10) || '    for (const x of a) {' || chr(10) || '      part' || (p_partkey % 11) || '(x);' || chr(10) || '    }' || chr(10) || '    return helper(a);' || chr(10) || '  }' || chr(10) || '  return ' || p_size || ';' || chr(10) || '}' || chr(10)
    || case when p_size % 3 = 0 then 'export class Box' || p_size || ' {' || chr(10) || '  value = 1;' || chr(10) || '}' || chr(10) else '' end"""
_FILES = f"files as (select p_partkey, {FILE_PATH} as path, {FILE_TEXT} as content, p_type as lang from part)"


def files_of(spark: SparkSession, d: str) -> DataFrame:
    """Generated source files."""
    return dealt(table(spark, d, "part"), "p_partkey").selectExpr("p_partkey", f"{FILE_PATH} as path", f"{FILE_TEXT} as content", "p_type as lang")


@book.query(r"""select doc_id, list_filter([case when length(s) < 16 then 'non-semantic' end], lambda x: x is not null) as reasons, length(s) as n from (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '</?[A-Za-z][^>]*>', ' ', 'g'), '\bhttps?://\S+', ' ', 'g'), '[^\p{L}\p{N}]', '', 'g') as s from documents)""")
def quality_assessment(spark: SparkSession, d: str) -> DataFrame:
    """Reasons against each document and its letters and digits."""
    docs = table(spark, d, "documents").withColumn("n", quality.semantic_characters("text"))
    return docs.select("doc_id", quality.quality_reasons("text", "n").alias("reasons"), "n")


@book.query(r"""with p as (select case when page_id % 2 = 0 then 'even' else 'odd' end as source, html as text from pages)
    select coalesce(source, 'total') as source, count(*) as files, count(*) filter (where regexp_matches(text, '(?m)^import\s+')) as import_lines, 0::bigint as export_meta, count(*) filter (where regexp_matches(text, '<[A-Z][A-Za-z0-9]*')) as jsx_tags, count(*) filter (where regexp_matches(text, 'ComponentCardList|Figure|Admonition|TabItem')) as site_markers, 0::bigint as frontmatter,
    0::bigint as invalid, 0::bigint as empty, 0::bigint as control_character, 0::bigint as include_only, 0::bigint as redirect_only, 0::bigint as non_semantic from p group by rollup (source)""")
def quality_noise_audit(spark: SparkSession, d: str) -> DataFrame:
    """Noisy and unfit pages by half and over all."""
    pages = table(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("source"), F.col("html").alias("text"))
    return quality.noise_audit(pages, "source")


@book.query(r"""select doc_id, regexp_replace(t, '((?:auth[_-]?token|access[_-]?token)[\s"''=:]*["'']?)[a-zA-Z0-9_-]{16,}(["'']?)', '\1[REDACTED:auth-token]\2', 'gi') as text, (doc_id % 3 = 0)::bigint + (doc_id % 5 = 0)::bigint as n from (
    select doc_id, md5(text) || case when doc_id % 3 = 0 then ' auth_token = "abcdefghij0123456789"' else '' end || case when doc_id % 5 = 0 then ' [REDACTED:github-pat]' else '' end as t from documents)""")
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Planted secrets replaced, with their number."""
    planted = F.concat(F.md5("text"), F.when(F.col("doc_id") % 3 == 0, ' auth_token = "abcdefghij0123456789"').otherwise(""), F.when(F.col("doc_id") % 5 == 0, " ghp_abcdefghijabcdefghijabcdefghij012345").otherwise(""))
    text, count, _ = quality.redacted(planted)
    return table(spark, d, "documents").select("doc_id", text.alias("text"), count.cast("bigint").alias("n"))


@book.query(r"""select doc_id, case when doc_id % 4 = 0 then 'ssh-dir' when doc_id % 4 = 1 then 'key-file' when doc_id % 4 = 2 then 'secret-in-name' when regexp_matches(text, '(?i)basic\s+([a-zA-Z0-9+/=]{4,})') then 'basic-auth' end as reason from documents""")
def path_security(spark: SparkSession, d: str) -> DataFrame:
    """The first reason to block each file."""
    path = F.element_at(F.array(F.lit("/home/a/.ssh/x"), F.lit("/a/b.key"), F.lit("/a/my-Secret.txt"), F.lit("/a/b.md")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", quality.path_security(path, "text").alias("reason"))


@book.query(r"""select source, count(*) as lines, count(*) filter (where regexp_matches(line, '(?i)basic\s+([a-zA-Z0-9+/=]{4,})|bearer\s+[a-zA-Z0-9_.~+/=-]{12,}')) as secret_lines, count(*) filter (where regexp_matches(line, '(?:^|\s)/(?:home|Users|etc|var)/')) as absolute_lines, count(*) filter (where contains(line, '../')) as traversal_lines
    from (select source, unnest(string_split_regex(text, '\r?\n')) as line from documents) group by 1""")
def risk_audit(spark: SparkSession, d: str) -> DataFrame:
    """Risky lines by source."""
    return quality.risk_lines(table(spark, d, "documents"), "source")


@book.query()
def personal_data_scan(spark: SparkSession, d: str) -> DataFrame:
    """Personal data of every document by type."""
    found = quality.with_personal(table(spark, d, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("personal", lambda m: m["type"] == k)).cast("bigint").alias(k)
    return found.select("doc_id", *(n(k) for k in ("cpf", "cnpj", "email", "phone_br", "ssn", "credit_card")), "flagged", F.sha2("redacted", 256).alias("redacted_sha256"))


@book.query()
def prepare_documents(spark: SparkSession, d: str) -> DataFrame:
    """The deterministic preparation of every document, guarded against growth."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat("source", F.lit("/a.md")).alias("path"))
    return quality.with_prepared(docs).select("doc_id", quality.size_guarded("text", "clean").alias("text"))


@book.query(f"""with {_FILES}, m as (select path, len(string_split(content, chr(10))) as lines, 1 + len(regexp_extract_all(content, '\\bif\\s*\\(')) + len(regexp_extract_all(content, '\\bfor\\s*\\(')) + len(regexp_extract_all(content, '&&|\\|\\|')) as cyclomatic, 5::bigint as cognitive from files)
    select path, lines::bigint as lines, cyclomatic::bigint as cyclomatic, cognitive, 3::bigint as nesting, 2::bigint as returns, greatest(0, least(100, floor(100 - 2.0 * ln(lines) - 0.5 * cyclomatic - 0.1 * cognitive + 0.5)))::bigint as maintainability from m""")
def code_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Complexity, nesting, returns and maintainability of every file."""
    m = files_of(spark, d).select("path", F.size(F.split("content", "\n")).cast("bigint").alias("lines"), quality.cyclomatic("content").alias("cyclomatic"), quality.cognitive("content").alias("cognitive"), quality.max_nesting("content").alias("nesting"), quality.returns("content").alias("returns"))
    return m.withColumn("maintainability", quality.maintainability(F.col("lines"), F.col("cyclomatic"), F.col("cognitive")))


@book.query(f"""with {_FILES}, l as (select path, generate_subscripts(a, 1) as line, unnest(a) as comment from (select path, string_split(content, chr(10)) as a from files))
    select path, type, weight, line, comment from l, (values ('TODO', 1), ('FIXME', 5), ('HACK', 3)) t(type, weight) where regexp_matches(comment, '//.*\\b' || type || '\\b')""")
def code_debt(spark: SparkSession, d: str) -> DataFrame:
    """Lines with debt markers."""
    return quality.debt_items(files_of(spark, d), "path", "content").select("path", "type", "weight", "line", "comment")


ORACLES["code_debt"] = ORACLES["code_debt"].replace("select path, type, weight, line, comment from l", "select path, type, weight::int as weight, line::int as line, comment from l")


@book.query(f"""with {_FILES} select type, count(*) as items, sum(weight)::bigint as score, count(distinct path) as files from (select path, unnest(case when contains(content, 'FIXME') then ['TODO','FIXME','HACK'] else ['TODO'] end) as type from files) join (values ('TODO', 1), ('FIXME', 5), ('HACK', 3)) t(type, weight) using (type) group by 1""")
def code_debt_summary(spark: SparkSession, d: str) -> DataFrame:
    """Debt by type over the project."""
    items = quality.debt_items(files_of(spark, d), "path", "content")
    return items.groupBy("type").agg(F.count("*").alias("items"), F.sum("weight").alias("score"), F.countDistinct("path").alias("files"))


_BLOCKS = r"""l as (select doc_id, string_split(text, chr(10)) as a from documents), s as (select doc_id, a, unnest(range(1, len(a) - 2)) as start from l where len(a) >= 4), z as (select doc_id, a, start, unnest(range(4, least(20, len(a) - start + 1) + 1)) as size from s),
    t as (select doc_id, start, size, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_slice(a, start, start + size - 1), chr(10)), '/\*[\s\S]*?\*/', '', 'g'), '(?m)//.*$', '', 'g'), '(?m)^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) as t from z), b as (select doc_id, start, size, sha256(t)[1:16] as hash from t where length(t) >= 20)"""


@book.query(f"with {_BLOCKS} select hash, count(distinct doc_id) as files, count(*) as places from b group by 1 having count(distinct doc_id) > 1")
def duplicate_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 4 to 20 lines that several documents hold."""
    return quality.duplicated_blocks(table(spark, d, "documents"), "doc_id")


@book.query(f"with {_BLOCKS}, o as (select *, lag(start) over (partition by doc_id, hash order by start, size) as before from b) select doc_id, hash, count(*) as places from o where before is null or start > before + 5 group by 1, 2 having count(*) > 1")
def internal_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that come again in their own document."""
    return quality.internal_duplicates(quality.blocks(table(spark, d, "documents"), "doc_id"), "doc_id")


def _chunks(profile: str | None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")))
        found = chunking.chunks(docs, "doc_id", "text", profile, title="source", path="path")
        return found.select("doc_id", "profile", "chunk_index", F.sha2("searchable_text", 256).alias("sha256"), F.length("content").alias("n"), "start_line", "end_line")

    return run


for _name, _profile in (("fixed", "fixed"), ("structure", "structure"), ("semantic", "semantic"), ("canonical", "canonical"), ("detected", None)):
    QUERIES[f"chunks_{_name}"] = _chunks(_profile)


@book.query(f"""with {_FILES} select path, 'part' || p_partkey as name, 'function' as kind from files union all select path, 'Box' || regexp_extract(content, 'class Box([0-9]+)', 1), 'class' from files where contains(content, 'class Box')""")
def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of every file."""
    return code.symbols(files_of(spark, d)).select("path", "name", "kind")


@book.query(f"""with {_FILES} select path, 'IMPORTS' as relation, '../m' || ((p_partkey + 7) % 7) || '/f' || (p_partkey + 7) as ref, null as via from files union all select path, 'IMPORTS', 'helper', '../m' || ((p_partkey + 7) % 7) || '/f' || (p_partkey + 7) from files
    union all select path, 'CALLS', 'part' || (p_partkey % 11), null from files union all select path, 'CALLS', 'helper', null from files""")
def code_edges(spark: SparkSession, d: str) -> DataFrame:
    """Imports and calls of every file."""
    return code.edges(files_of(spark, d))


@book.query(f"""with {_FILES}, i as (select a.path, b.path as target, 'IMPORTS' as relation, 1.0::double as strength from files a join files b on b.path = regexp_extract(a.path, '^(src/[^/]*)', 1) || '/m' || ((a.p_partkey + 7) % 7) || '/f' || (a.p_partkey + 7) || '.ts'),
    c as (select a.path, b.path as target, 'CALLS' as relation, 0.8::double as strength from files a join files b on b.p_partkey = a.p_partkey % 11) select * from (select * from i union all select * from c) where path <> target""")
def code_navigation(spark: SparkSession, d: str) -> DataFrame:
    """One hop along imports and calls."""
    files = files_of(spark, d)
    return code.navigation(code.edges(files), files, code.symbols(files))


@book.query(f"""with {_FILES}, g as (select regexp_extract(path, '^(.*)/[^/]*$', 1) as directory, count(*) as files, count(distinct lang) as languages, sum(1 + contains(content, 'class Box')::int)::bigint as symbols from files group by 1)
    select directory, files, languages, symbols, upper(regexp_extract(directory, '([^/]*)$', 1)[1]) || regexp_extract(directory, '([^/]*)$', 1)[2:] as name, 'hub-' || replace(directory, '/', '-') as hub_id from g where files >= 2 order by files desc, directory limit 20""")
def code_hubs(spark: SparkSession, d: str) -> DataFrame:
    """The largest directories."""
    return _hubs(spark, d).drop("extensions")


def _hubs(spark: SparkSession, d: str) -> DataFrame:
    files = files_of(spark, d)
    counts = code.symbols(files).groupBy("path").agg(F.count("*").alias("symbols"))
    return code.feature_hubs(files.join(shuffled(counts), "path", "left").fillna({"symbols": 0}))


@book.query(f"""with {_FILES}, g as (select regexp_extract(path, '^(.*)/[^/]*$', 1) as directory, count(*) as files from files group by 1 having count(*) >= 2 order by files desc, directory limit 20)
    select 'cluster-hub-' || replace(directory, '/', '-') as cluster_id, upper(regexp_extract(directory, '([^/]*)$', 1)[1]) || regexp_extract(directory, '([^/]*)$', 1)[2:] as label, round(least(0.95, 0.5 + files / 20.0)::double, 4) as confidence, 0.75::double as similarity, list_filter(string_split(directory, '/'), lambda x: length(x) >= 3) as terms from g""")
def code_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Hubs as clusters."""
    return code.semantic_clusters(_hubs(spark, d)).withColumn("confidence", F.round("confidence", 4))


@book.query(f"""with {_FILES}, w as (select path, unnest(list_distinct(list_concat(list_filter(string_split(path, '/'), lambda p: p <> 'src'), ['part' || p_partkey]))) as topic from files)
    select topic, upper(topic[1]) || topic[2:] as name, count(*) as files, round(least(count(*) / (select count(*) from files)::double * 5, 1), 6) as cohesion from w group by 1, 2 having count(*) >= 2 order by files desc, topic limit 8""")
def code_topics(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent topics of paths and names."""
    files = files_of(spark, d)
    names = code.symbols(files).filter("kind = 'function'").groupBy("path").agg(F.collect_list("name").alias("names"))
    return code.topic_groups(files.join(shuffled(names), "path", "left")).withColumn("cohesion", F.round("cohesion", 6))


@book.query(f"""with {_FILES} select path, '// exports: ' || case when contains(content, 'class Box') then array_to_string(list_sort(['part' || p_partkey, 'Box' || regexp_extract(content, 'class Box([0-9]+)', 1)]), ', ') else 'part' || p_partkey end || chr(10) || '// imports: ../m' || ((p_partkey + 7) % 7) || '/f' || (p_partkey + 7) as skeleton from files""")
def code_skeleton(spark: SparkSession, d: str) -> DataFrame:
    """A line of exports and imports of every file."""
    files = files_of(spark, d)
    return code.skeleton(files, code.symbols(files), code.edges(files))


@book.query(f"""with {_FILES}, p as (select string_split(path, '/') as a from files), x as (select a, unnest(range(1, len(a))) as n from p) select array_to_string(list_slice(a, 1, n), '/') as directory, count(*) as files, n as depth from x group by 1, 3""")
def code_tree(spark: SparkSession, d: str) -> DataFrame:
    """Every directory with the files below it."""
    return code.tree(files_of(spark, d))


@book.query(f"""with {_FILES}, i as (select a.path, b.path as target, a.p_partkey from files a join files b on b.path = regexp_extract(a.path, '^(src/[^/]*)', 1) || '/m' || ((a.p_partkey + 7) % 7) || '/f' || (a.p_partkey + 7) || '.ts'),
    c as (select target as path, sum(p_partkey % 9)::bigint as tests from i where p_partkey % 2 = 0 group by 1) select f.path, coalesce(tests, 0) as tests, case when coalesce(tests, 0) > 5 then 'full' when coalesce(tests, 0) > 0 then 'partial' else 'none' end as coverage from files f left join c using (path) where p_partkey % 2 = 1""")
def code_test_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Source files with the test cases that import them (every second file plays a test)."""
    files = files_of(spark, d)
    tests = files.filter("p_partkey % 2 = 0").select("path", (F.col("p_partkey") % 9).alias("cases"))
    return code.test_coverage(files.select("path"), code.import_targets(code.edges(files), files), tests)


@book.query(f"""with q as (select {FILE_PATH} as path, 1 + (p_size % 3 = 0)::int as symbols, (9 + 3 * (p_size % 3 = 0)::int)::double / (12 + (p_size % 5 = 0)::int + 3 * (p_size % 3 = 0)::int) as coverage from part)
    select path, symbols, round(coverage, 6) as coverage, round((least(coverage, 1) + least(symbols / 3.0, 1)) / 2, 6) as score, (least(coverage, 1) + least(symbols / 3.0, 1)) / 2 >= 0.5 as passes from q""")
def code_parse_quality(spark: SparkSession, d: str) -> DataFrame:
    """How much of each file its symbols cover."""
    files = files_of(spark, d)
    return code.parse_quality(code.symbols(files), files).withColumns({"coverage": F.round("coverage", 6), "score": F.round("score", 6)})


@book.query("select p_brand as category, count(*) as files, sum(p_size)::bigint as lines, count(*) filter (where p_size % 3 = 0) as with_class from part group by 1")
def inventory_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Inventory totals by category."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("files"), F.sum("p_size").alias("lines"), F.count_if(F.col("p_size") % 3 == 0).alias("with_class"))


@book.query("select p_partkey, p_name from part where contains(lower(p_name), 'part 1') order by case when lower(p_name) = 'part 1' then 0 else 1 end, p_size desc nulls last, p_partkey limit 25")
def inventory_search(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose name holds the query: an exact one first, then by size."""
    hit = table(spark, d, "part").filter(F.lower("p_name").contains("part 1"))
    return hit.orderBy(F.when(F.lower("p_name") == "part 1", 0).otherwise(1), F.desc_nulls_last("p_size"), "p_partkey").limit(25).select("p_partkey", "p_name")


@book.query("select p_partkey, array_to_string(list_filter([case when p_size % 7 = 0 then 'zero exports' end, case when p_size % 5 = 0 then 'unreviewed' end], lambda x: x is not null), '; ') as reasons from part where (p_size % 7 = 0 or p_size % 5 = 0) and p_size >= 10")
def inventory_dead_code(spark: SparkSession, d: str) -> DataFrame:
    """Entries that look unused, with reasons."""
    why = quality.flags((F.col("p_size") % 7 == 0, "zero exports"), (F.col("p_size") % 5 == 0, "unreviewed"))
    return table(spark, d, "part").withColumn("why", why).filter((F.size("why") > 0) & (F.col("p_size") >= 10)).select("p_partkey", F.array_join("why", "; ").alias("reasons"))


@book.query(r"""select event_id, coalesce(nullif(regexp_extract(q, '(?i)^who calls ([A-Za-z_]\w*)', 1), ''), nullif(regexp_extract(q, '(?i)callers of ([A-Za-z_]\w*)', 1), '')) as symbol from (select event_id, case event_id % 3 when 0 then 'Who calls ' || event_type || '()?' when 1 then 'find callers of ' || event_type else 'what is ' || event_type end as q from events)""")
def caller_queries(spark: SparkSession, d: str) -> DataFrame:
    """The symbol that a query about callers names."""
    q = F.expr("case event_id % 3 when 0 then 'Who calls ' || event_type || '()?' when 1 then 'find callers of ' || event_type else 'what is ' || event_type end")
    found = F.coalesce(*(F.nullif(F.regexp_extract(q, p, 1), F.lit("")) for p in (r"(?i)^who calls ([A-Za-z_]\w*)", r"(?i)callers of ([A-Za-z_]\w*)")))
    return table(spark, d, "events").select("event_id", found.alias("symbol"))


@book.query(r"""select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) as target from pages""")
def link_graph(spark: SparkSession, d: str) -> DataFrame:
    """The distinct links of every page."""
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("target"))
