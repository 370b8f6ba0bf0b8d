"""The write rules over orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.io import table
from lodestone.operators import writes as W
from lodestone.plans.book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

_OLD = "select o_orderkey as path, o_orderstatus as source, 'old' as content, o_orderdate as created_at, 0 as seq from orders where o_orderkey % 3 <> 0"
_NEW = "select l_orderkey as path, l_returnflag as flag, 'new ' || l_linenumber as content, l_shipdate as created_at, l_linenumber as seq from lineitem where l_orderkey % 2 = 0"


@book.query(f"""with old as ({_OLD}), n as (select * from (select *, row_number() over (partition by path order by seq desc, content desc, created_at desc) as r from ({_NEW})) where r = 1)
    select path, source, content, created_at from old where path not in (select path from n) union all select n.path, coalesce(old.source, 'N'), n.content, coalesce(old.created_at, n.created_at) from n left join old using (path)""")
def write_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents by path: the last line of an order takes the place of what was there; source and creation stay."""
    old = table(spark, d, "orders").filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey as path", "o_orderstatus as source", "'old' as content", "o_orderdate as created_at", "0 as seq")
    new = table(spark, d, "lineitem").filter("l_orderkey % 2 = 0").selectExpr("l_orderkey as path", "'N' as source", "'new ' || l_linenumber as content", "l_shipdate as created_at", "l_linenumber as seq")
    return W.merged(old, new, ["path"], "seq", keep=("source", "created_at")).drop("seq")


_LINES = "l_orderkey as document_id, l_linenumber as chunk_index, l_partkey as content from lineitem"


@book.query(f"""select document_id, chunk_index, content from (select {_LINES}) where document_id % 4 <> 1 union all select document_id, chunk_index, -content from (select {_LINES}) where document_id % 4 = 1 and document_id % 8 <> 5 and chunk_index < 3""")
def write_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a document are replaced as a set; documents that come in without any lose theirs."""
    chunks = table(spark, d, "lineitem").selectExpr("l_orderkey as document_id", "l_linenumber as chunk_index", "l_partkey as content")
    new = chunks.filter("document_id % 4 = 1 and document_id % 8 <> 5 and chunk_index < 3").withColumn("content", -F.col("content"))
    return W.replaced(chunks, new, ["document_id"], table(spark, d, "orders").selectExpr("o_orderkey as document_id").filter("document_id % 4 = 1"))


_TEXT = "case when doc_id % 7 = 0 then '  ' else coalesce(text, '') end"


@book.query(f"""with new as (select doc_id as chunk_id, 'm' || doc_id % 2 as model, sha256({_TEXT}) as input_hash, trim({_TEXT}) <> '' as good, doc_id % 5 <> 0 as hashed from documents)
    select chunk_id, model, input_hash, 'kept' as state from new where good and hashed union all select chunk_id, model, null, case when not good then 'empty text' else 'no hash' end from new where not (good and hashed)
    union all select doc_id, 'm' || doc_id % 2, 'old', 'kept' from documents where doc_id % 3 = 0 and doc_id not in (select chunk_id from new where good and hashed) union all select doc_id, 'm9', 'old', 'kept' from documents where doc_id % 3 = 0""")
def write_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings by chunk and model; empty inputs and inputs without a hash are refused."""
    docs, model = table(spark, d, "documents"), F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string"))
    text = F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.coalesce("text", F.lit("")))
    new = docs.select(F.col("doc_id").alias("chunk_id"), model.alias("model"), text.alias("input_text"), F.when(F.col("doc_id") % 5 != 0, F.sha2(text, 256)).alias("input_hash"), F.lit(1).alias("seq"))
    old = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("chunk_id"), F.explode(F.array(model, F.lit("m9"))).alias("model"), F.lit("old").alias("input_hash"), F.lit(0).alias("seq"))
    kept, refused = W.embeddings_merged(old, new, "seq")
    return kept.select("chunk_id", "model", "input_hash", F.lit("kept").alias("state")).unionByName(refused.select("chunk_id", "model", F.lit(None).cast("string").alias("input_hash"), F.col("reason").alias("state")))


@book.query("""with v as (select l_orderkey as file_id, l_linenumber as version, md5(l_returnflag) as h, case when l_linenumber % 3 = 0 then 'failed' else 'ready' end as status from lineitem where l_orderkey % 4 <> 3), n as (select * from (select *, row_number() over (partition by file_id order by version desc, h desc, status desc) as r from v) where r = 1)
    select o_orderkey as file_id, coalesce(version, 0) + 1 as version, md5('R') as content_hash, 'pending' as status from orders left join n on n.file_id = o_orderkey where version is null or h <> md5('R') or n.status = 'failed'""")
def write_file_versions(spark: SparkSession, d: str) -> DataFrame:
    """A pending version for each file that comes in with another content than its newest version has, or whose newest version failed."""
    versions = table(spark, d, "lineitem").filter("l_orderkey % 4 <> 3").selectExpr("l_orderkey as file_id", "l_linenumber as version", "md5(l_returnflag) as content_hash", "case when l_linenumber % 3 = 0 then 'failed' else 'ready' end as status")
    incoming = table(spark, d, "orders").selectExpr("o_orderkey as file_id", "md5('R') as content_hash", "1 as seq")
    return W.pending_versions(versions, incoming, "seq")


@book.query("""select l_orderkey as version_id, l_partkey as symbol, l_linenumber as line from lineitem where l_orderkey % 5 <> 2 union all select l_orderkey, l_suppkey, l_linenumber from lineitem where l_orderkey % 5 = 2 and l_linenumber > 1""")
def write_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of a version are replaced as a set; a version that comes in with none keeps what it had, since it isn't named."""
    lines = table(spark, d, "lineitem")
    new = lines.filter("l_orderkey % 5 = 2 and l_linenumber > 1").selectExpr("l_orderkey as version_id", "l_suppkey as symbol", "l_linenumber as line")
    single = lines.filter("l_orderkey % 5 = 2").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n")).filter("n = 1").select(F.col("l_orderkey").alias("version_id"))
    old = lines.selectExpr("l_orderkey as version_id", "l_partkey as symbol", "l_linenumber as line").join(single, "version_id", "left_anti")
    return W.replaced(old, new, ["version_id"])


@book.query("""with i as (select l_orderkey as owner_ref, 'p' || l_suppkey % 2 as profile_hash, l_linenumber as version, l_partkey as vector from lineitem where l_linenumber < 4), o as (select o_orderkey as owner_ref, 1 + o_orderkey % 3 as candidate from orders where o_orderkey % 7 <> 0),
    g as (select * from (select i.*, row_number() over (partition by i.owner_ref, profile_hash order by version desc, vector desc) as r from i join o using (owner_ref) where version = candidate) where r = 1)
    select owner_ref, profile_hash, version, vector, 'kept' as state from g union all select o_orderkey, 'p0', 0, -1, 'kept' from orders where not exists (select 1 from g where g.owner_ref = o_orderkey and g.profile_hash = 'p0')
    union all select i.owner_ref, profile_hash, version, vector, case when candidate is null then 'no owner' else 'another version' end from i left join o using (owner_ref) where candidate is null or version <> candidate""")
def write_project_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings by owner and profile; those of another version than the owner's candidate are refused."""
    shared = [F.lit(1).alias("project_id"), F.lit("chunk").alias("owner_type")]
    new = table(spark, d, "lineitem").filter("l_linenumber < 4").select(*shared, F.col("l_orderkey").alias("owner_ref"), F.concat(F.lit("p"), (F.col("l_suppkey") % 2).cast("string")).alias("profile_hash"), F.col("l_linenumber").alias("version"), F.col("l_partkey").alias("vector"))
    orders = table(spark, d, "orders")
    owners = orders.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("owner_ref"), (1 + F.col("o_orderkey") % 3).alias("candidate_version"))
    old = orders.select(*shared, F.col("o_orderkey").alias("owner_ref"), F.lit("p0").alias("profile_hash"), F.lit(0).cast(new.schema["version"].dataType).alias("version"), F.lit(-1).cast(new.schema["vector"].dataType).alias("vector"))
    kept, refused = W.owned_embeddings(old, new, owners, "version")
    columns = ["owner_ref", "profile_hash", "version", "vector"]
    return kept.select(*columns, F.lit("kept").alias("state")).unionByName(refused.select(*columns, F.col("reason").alias("state")))


@book.query("""with old as (select s_name as slug, s_suppkey as project_id, 'r' || s_suppkey as root, 0 as seq from supplier where s_suppkey % 2 = 0), new as (select s_name as slug, 'r' || (case when s_suppkey % 5 = 0 then s_suppkey + 1 when s_suppkey % 5 = 1 then s_suppkey - 1 else s_suppkey end) as root, s_suppkey as seq from supplier where s_suppkey % 3 <> 0),
    stay as (select old.slug, old.root from old left join new using (slug) where new.root is null or new.root = old.root), f as (select root, arg_min(slug, seq) as first from new group by 1), j as (select new.*, coalesce((select min(slug) from stay where stay.root = new.root), f.first) = new.slug as good from new join f using (root))
    select slug, root, project_id, 'kept' as state from old where slug not in (select slug from j where good) union all select j.slug, j.root, coalesce(old.project_id, -1), 'kept' from j left join old using (slug) where good union all select slug, root, null, 'root of another' from j where not good""")
def write_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Repositories by slug; a root belongs to one of them, and ids stay."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    root = lambda c: F.concat(F.lit("r"), c.cast("string")).alias("root")
    old = s.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("slug"), k.alias("project_id"), root(k), F.lit(0).cast("bigint").alias("seq"))
    new = s.filter("s_suppkey % 3 <> 0").select(F.col("s_name").alias("slug"), F.lit(-1).cast(s.schema["s_suppkey"].dataType).alias("project_id"), root(F.when(k % 5 == 0, k + 1).when(k % 5 == 1, k - 1).otherwise(k)), k.cast("bigint").alias("seq"))
    kept, refused = W.registered(old, new, "seq")
    return kept.select("slug", "root", "project_id", F.lit("kept").alias("state")).unionByName(refused.select("slug", "root", F.lit(None).cast(s.schema["s_suppkey"].dataType).alias("project_id"), F.col("reason").alias("state")))
