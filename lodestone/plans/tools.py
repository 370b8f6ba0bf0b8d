"""The tools as a user calls them, over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import api
from lodestone.io import scratch_dir, table
from lodestone.operators import code as C
from lodestone.operators.publication import Catalogue
from lodestone.plans import code, content, search
from lodestone.plans.book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


def _docs(spark: SparkSession, d: str) -> api.Docs:
    index = search.search_index(spark, d)
    chunks = index.chunks()
    return api.Docs(chunks, chunks.filter("doc_id % 3 <> 0").select("chunk_id", F.array(F.lit(1.0)).alias("embedding")), index=index)


def _project(spark: SparkSession, d: str) -> api.Project:
    return api.Project(code.files_of(spark, d), cache=C.ParseCache(Catalogue(spark, f"{scratch_dir(spark)}/tools-{uuid.uuid4().hex}")))


@book.query(f"with {search._WINDOWS} select source as source_id, count(distinct doc_id) as documents, count(*) as chunks from chunks group by 1")
def tool_categories(spark: SparkSession, d: str) -> DataFrame:
    """Documents and chunks of each source."""
    return _docs(spark, d).categories()


@book.query(f"with {search._WINDOWS} select chunk_id, chunk_index, md5(content) as content_md5 from chunks where source = 'src4' and doc_id = 4")
def tool_document(spark: SparkSession, d: str) -> DataFrame:
    """A document by its path, chunk by chunk."""
    return _docs(spark, d).document("docs/src4/4.md").select("chunk_id", "chunk_index", F.md5("content").alias("content_md5"))


@book.query(f"with {search._WINDOWS} select count(distinct doc_id) as documents, count(*) as chunks, 0::bigint as empty, count(*) filter (where doc_id % 3 = 0) as without_embedding from chunks")
def tool_health(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index is fit to serve."""
    return _docs(spark, d).health()


@book.query(f"with {code._G} select path, name, kind, start_line, end_line, parent, depth from d where path like '%/f5.%' ")
def tool_outline(spark: SparkSession, d: str) -> DataFrame:
    """The outline of a file, from the cache of parses."""
    return _project(spark, d).outline("src/f5.ts").select("path", "name", "kind", "start_line", "end_line", "parent", "depth")


@book.query(f"with {code._G} select path, name, kind, start_line from d where lower(name) = 'box7' and kind = 'type'")
def tool_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of a name of a kind, case ignored."""
    return _project(spark, d).symbols("BOX7", "type").select("path", "name", "kind", "start_line")


@book.query(f"with {content._FILES} select path, 'CALLS' as relation, 'part5' as ref from files where p_partkey % 11 = 5 order by path limit 20")
def tool_references(spark: SparkSession, d: str) -> DataFrame:
    """The first files that call a name."""
    return api.Project(content.files_of(spark, d)).references("part5")


@book.query(f"""with {code._G}, n as (select path, count(*) as symbols from d group by 1), h as (select 'src' as directory, count(*) as files, count(distinct regexp_extract(g.path, '[a-z]+$')) as languages, sum(coalesce(symbols, 0))::bigint as symbols from g left join n using (path))
    select directory, files, languages, symbols from h""")
def tool_hubs(spark: SparkSession, d: str) -> DataFrame:
    """The largest directories with their languages and symbols."""
    return _project(spark, d).hubs().select("directory", "files", "languages", "symbols")
