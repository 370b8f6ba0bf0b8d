"""Sources: frontmatter, titles, policies, tables and listings, over generated contents of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.io import table
from lodestone.plans.book import Book
from lodestone.sources import files as S

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

_HEAD = "case when doc_id % 2 = 0 then '---' || chr(10) || 'title: \"Doc ' || doc_id || '\"' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) else '' end || case when doc_id % 3 = 0 then '# Head ' || doc_id || chr(10) else '' end || text"


@book.query("select doc_id, case when doc_id % 2 = 0 then 'Doc ' || doc_id when doc_id % 3 = 0 then 'Head ' || doc_id else doc_id || '.md' end as title, case when doc_id % 2 = 0 then lang end as lang, md5(case when doc_id % 3 = 0 then '# Head ' || doc_id || chr(10) else '' end || text) as body_md5 from documents")
def source_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    """Header, body and title of every document."""
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{_HEAD} as content")
    found = docs.withColumn("f", S.frontmatter("content"))
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return found.select("doc_id", S.display_title(F.col("f.metadata"), F.col("f.body"), path).alias("title"), F.element_at(F.col("f.metadata"), "lang").alias("lang"), F.md5("f.body").alias("body_md5"))


@book.query("select doc_id, case when n_chars <= 0 then 'empty_file' when n_chars > 5000 then 'size_exceeded' when lang = 'fr' then 'policy_excluded_extension' end as reason, case lang when 'en' then 'typescript' when 'de' then 'python' when 'es' then 'go' end as language, lang = 'es' as ignored from documents")
def source_policy(spark: SparkSession, d: str) -> DataFrame:
    """Eligibility, language and ignore rules of every file."""
    end = F.when(F.col("lang") == "en", "ts").when(F.col("lang") == "de", "PY").when(F.col("lang") == "es", "go").otherwise("exe")
    path = F.concat(F.lit("src/"), "lang", F.lit("/a"), F.col("doc_id").cast("string"), F.lit("."), end)
    return table(spark, d, "documents").select("doc_id", S.eligibility(path, "n_chars", 5000).alias("reason"), S.language(path).alias("language"), S.ignored(path, ["**/es/*.go", "node_modules"]).alias("ignored"))


@book.query("select doc_id // 2 as stem, min(case doc_id % 2 when 0 then 'md' else 'mdx' end) as ext from documents group by 1")
def source_doc_files(spark: SparkSession, d: str) -> DataFrame:
    """One documentation file for each stem, by preference of extension."""
    rows = table(spark, d, "documents").selectExpr("'d/' || (doc_id div 2) || case doc_id % 2 when 0 then '.md' else '.mdx' end as path")
    return S.doc_files(rows).select(F.regexp_extract("path", "/([0-9]+)[.]", 1).cast("bigint").alias("stem"), F.regexp_extract("path", "[.](.*)$", 1).alias("ext"))


_HOSTS = ["ththre.example.com", "m.ththth.example.net", "ththther.example.org", "thther.example.org"]


@book.query(f"select page_id, case when regexp_extract(url, '^https?://([^/:]+)', 1) in ({', '.join(repr(h) for h in _HOSTS)}) then [url] else [] end as links from pages")
def source_llms_links(spark: SparkSession, d: str) -> DataFrame:
    """Page links on allowed hosts, from a Markdown list made of each page's URL."""
    text = F.concat(F.lit("- [a]("), "url", F.lit(") and [b](/rel)"))
    return table(spark, d, "pages").select("page_id", S.llms_links(text, _HOSTS).alias("links"))


@book.query("select n_nationkey, n_name as name, n_regionkey::varchar as region from nation")
def source_markdown_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows of Markdown tables."""
    text = F.expr("'| id | name |\n|---|:--|\n| ' || n_regionkey || ' | ' || n_name || ' |\n'")
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(S.markdown_table(text)).alias("r"))
    return rows.select("n_nationkey", F.col("r")[1].alias("name"), F.col("r")[0].alias("region"))


@book.query("""select doc_id, ' M' as status, 'src/' || source || '/' || doc_id || '.ts' as path from documents union all select doc_id, '??', 'new ' || doc_id || '.md' from documents where doc_id % 2 = 0
    union all select doc_id, 'R ', 'to/' || doc_id from documents where doc_id % 3 = 0""")
def source_git_status(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a status listing for each document, with new and renamed files."""
    k = F.col("doc_id").cast("string")
    raw = F.concat(F.lit(" M src/"), "source", F.lit("/"), k, F.lit(".ts\0"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("?? new "), k, F.lit(".md\0"))).otherwise(""), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("R  to/"), k, F.lit("\0from/"), k, F.lit("\0"))).otherwise(""))
    return table(spark, d, "documents").select("doc_id", F.inline(S.porcelain(raw)))


@book.query("select event_id, event_id as item_id, cast(regexp_extract(props, '[0-9]+') as bigint) as rank from events union all select event_id, -event_id, user_id from events where event_id % 3 = 0")
def source_json_rows(spark: SparkSession, d: str) -> DataFrame:
    """JSON arrays of rows, one for each event, as a relation."""
    one, k = lambda a, b: F.concat(F.lit('{"item_id": '), a.cast("string"), F.lit(', "rank": '), b.cast("string"), F.lit("}")), F.col("event_id")
    raw = F.concat(F.lit("["), one(k, F.get_json_object("props", "$.k")), F.when(k % 3 == 0, F.concat(F.lit(", "), one(-k, F.col("user_id")))).otherwise(""), F.lit("]"))
    return S.json_relation(table(spark, d, "events").select("event_id", raw.alias("raw")), "raw", "item_id:bigint,rank:bigint", "event_id")


@book.query("select doc_id, 'added' as change from documents where source = 'src1' union all select doc_id, 'removed' from documents where source = 'src2'")
def source_changelog(spark: SparkSession, d: str) -> DataFrame:
    """Files added and removed between two inventories."""
    docs = table(spark, d, "documents")
    return S.changelog(docs.filter("source <> 'src1'"), docs.filter("source <> 'src2'"), "doc_id")


@book.query("select doc_id from documents where source in ('src1', 'src2', 'src3') and (lang = 'en' or source = 'en')")
def source_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source, category and tags."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"), F.col("lang").alias("category"), F.array("lang", F.lit("all")).alias("tags"))
    return docs.filter(S.source_filter({"source_ids": ["src1", "src2", "src3"], "category": "en", "tags": ["en", "all"]})).select("doc_id")
