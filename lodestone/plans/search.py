"""Search queries over documents, embeddings and parts."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.io import fingerprint, scratch_dir, table, written
from lodestone.operators import retrieval as R
from lodestone.operators.fulltext import TextIndex
from lodestone.operators.publication import Catalogue
from lodestone.operators.vector_index import VectorIndex
from lodestone.plans.book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

_WINDOWS = """chunked as (select doc_id, source, lang, i as chunk_index, trim(substring(text, i * 350 + 1, 400)) as content from
    (select *, unnest(range(0, cast(ceil(greatest(length(text) - 400, 0) / 350.0) as bigint) + 1)) as i from documents where length(text) > 400) union all
    select doc_id, source, lang, 0, text from documents where length(text) <= 400),
    chunks as (select *, doc_id * 100000 + row_number() over (partition by doc_id order by chunk_index) - 1 as chunk_id from chunked where content <> '')"""


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of 400 characters that overlap by 50."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"), "lang", "text")
    found = R.windows(docs, 400, 50)
    path = F.concat(F.lit("docs/"), "source_id", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return found.select("doc_id", "source_id", "lang", (F.col("doc_id") * 100000 + F.col("chunk_index")).alias("chunk_id"), "chunk_index", "content", path.alias("source_path"), F.concat("lang", F.lit(" "), "source_id").alias("title"), F.lit(True).alias("enabled"))


_INDEXES: dict[tuple[str, str], TextIndex] = {}


def kept_index(spark: SparkSession, d: str, label: str, chunks: DataFrame, text: Column, path: Column | None = None) -> TextIndex:
    """An index of chunks made of ``documents``, in the session's folder; made at the first call for a table, and again where its files have changed."""
    key = f"{scratch_dir(spark)}/index-{label}", fingerprint(spark, f"{d}/documents.parquet")
    if key not in _INDEXES:
        index = TextIndex(Catalogue(spark, f"{key[0]}-{uuid.uuid4().hex}"))
        index.add(chunks, text, path)
        _INDEXES[key] = index
    return _INDEXES[key]


def search_index(spark: SparkSession, d: str) -> TextIndex:
    """The index of all chunks, with their paths and hashed embeddings."""
    chunks = chunks_of(spark, d)
    return kept_index(spark, d, "chunks", chunks, T.chunk_search_text(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), "content"), F.lower("source_path"))


@book.query(f"with {_WINDOWS} select doc_id, chunk_id, md5(content) as content_md5 from chunks")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Fixed windows of every document."""
    return chunks_of(spark, d).select("doc_id", "chunk_id", F.md5("content").alias("content_md5"))


@book.query(f"""with {_WINDOWS}, s as (select *, lower(strip_accents(content)) as t, 'docs/' || source || '/' || doc_id || '.md' as source_path from chunks)
    select chunk_id, source_path, round((t like '%them%' or source_path like '%them%')::int * 0.25 + (t like '%nother%' or source_path like '%nother%')::int * 0.25 + (t like '%src1%' or source_path like '%src1%')::int * 0.25 + (t like '%tion%')::int * 0.25 + contains(t, 'src1')::int * 0 , 4) as score
    from s where score > 0 order by score desc, source_path, chunk_id limit 50""")
def search_keyword(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by term hits in text and path, the best fifty, from the index."""
    index = search_index(spark, d)
    hits = index.substring_hits(R.query_terms("them nother src1 tion"))
    scored = hits.join(index.chunks().select("chunk_id", "source_path"), "chunk_id").withColumn("score", F.round(F.col("hits") * R.WEIGHTS["term"], 4))
    return scored.orderBy(F.desc("score"), "source_path", "chunk_id").limit(50).select("chunk_id", "source_path", "score")


def kept_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Hashed embeddings of all chunks, made once for a table like the index."""
    key = f"{scratch_dir(spark)}/vectors", fingerprint(spark, f"{d}/documents.parquet")
    if key not in _VECTORS:
        _VECTORS[key] = written(R.hashed_embeddings(search_index(spark, d).chunks(), "chunk_id", "content"), "vectors")
    return _VECTORS[key]


_VECTORS: dict[tuple[str, str], DataFrame] = {}
_LEXEMES = r"list_filter(string_split_regex(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"


@book.query(f"""with {_WINDOWS}, w as (select chunk_id, unnest({_LEXEMES.format("content")}) as term from chunks)
    select term, count(distinct chunk_id) as chunks, count(*) as occurrences from w group by 1""")
def fulltext_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Every term of the index with its chunks and occurrences."""
    return search_index(spark, d).vocabulary().filter("field = 0").select("term", "chunks", "occurrences")


#: A phrase, words, a negated word and an alternative, in this order; and the same in SQL.
_ASKED = '"et le" que -pour or "the of" on or -que -the -de -que'


@book.query(f"""with {_WINDOWS}, w as (select chunk_id, {_LEXEMES.format("content")} as w from chunks), t as (select chunk_id, w, ' ' || array_to_string(w, ' ') || ' ' as s from w)
    select chunk_id from t where (contains(s, ' et le ') and list_contains(w, 'que') and not list_contains(w, 'pour')) or (contains(s, ' the of ') and list_contains(w, 'on')) or not (list_contains(w, 'que') or list_contains(w, 'the') or list_contains(w, 'de'))""")
def fulltext_match(spark: SparkSession, d: str) -> DataFrame:
    """Phrases, negations and alternatives, one of them with negated words alone, answered by postings."""
    return search_index(spark, d).match(_ASKED).select("chunk_id")


_PAIR = "select chunk_id, p, term, lag(p) over k as q, lag(term) over k as other from (select chunk_id, generate_subscripts(w, 1) as p, unnest(w) as term from w) where term in ('que', 'de') window k as (partition by chunk_id order by p)"


@book.query(f"""with {_WINDOWS}, w as (select chunk_id, {_LEXEMES.format("content")} as w from chunks), x as ({_PAIR})
    select chunk_id, round(sum(0.1::double / (1 + p - q - 1)), 5) as rank from x where other <> term group by 1 order by rank desc, chunk_id limit 100""")
def fulltext_cover_density(spark: SparkSession, d: str) -> DataFrame:
    """The best hundred for two words: a cover is an occurrence of one next to one of the other, and words between them lower its weight."""
    found = search_index(spark, d).match("que de").withColumn("rank", F.round("rank", 5))
    return found.orderBy(F.desc("rank"), "chunk_id").limit(100)


@book.query(f"""with {_WINDOWS}, kept as (select chunk_id, case when doc_id % 20 = 1 then 'que ' || content else content end as content from chunks where doc_id % 50 <> 0), w as (select chunk_id, {_LEXEMES.format("content")} as w from kept)
    select chunk_id, len(list_filter(w, lambda x: x = 'que')) as n from w where list_contains(w, 'que')""")
def fulltext_segments(spark: SparkSession, d: str) -> DataFrame:
    """An index of three segments: documents are added, some are replaced, others removed; only what is new is indexed."""
    index = TextIndex(Catalogue(spark, f"{scratch_dir(spark)}/segments-{uuid.uuid4().hex}"))
    chunks, text = chunks_of(spark, d).select("chunk_id", "doc_id", "content"), T.search_text("content")
    index.add(chunks.filter("doc_id % 20 <> 7"), text)
    index.add(chunks.filter("doc_id % 20 = 7"), text)
    index.add(chunks.filter("doc_id % 20 = 1").withColumn("content", F.concat(F.lit("que "), "content")), text)
    index.remove(chunks.filter("doc_id % 50 = 0"))
    return index.match("que").select("chunk_id", F.round(F.col("rank") * 10).cast("bigint").alias("n"))


@book.query(r"""with t as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '') as w from documents)
    select doc_id from t where (list_contains(w, 'the') and contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') and not list_contains(w, 'whon')) or list_contains(w, 'les')""")
def search_websearch(spark: SparkSession, d: str) -> DataFrame:
    """Full-text match of words, a phrase, a negated word and an alternative."""
    return table(spark, d, "documents").filter(R.matches_websearch(R.lexemes("text"), 'the "of the" -whon or les')).select("doc_id")


@book.query(r"""with t as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '') as w from documents)
    select doc_id, round(0.1::double * len(list_filter(w, lambda x: x = 'que')), 6) as rank from t where list_contains(w, 'que') order by rank desc, doc_id limit 100""")
def search_cover_density(spark: SparkSession, d: str) -> DataFrame:
    """The best hundred by cover density; for one word each occurrence is a cover."""
    words = table(spark, d, "documents").select("doc_id", R.lexemes("text").alias("w"))
    hit = words.filter(R.matches_websearch("w", "que"))
    return hit.select("doc_id", F.round(R.rank_cover_density("w", "que"), 6).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(100)


@book.query(r"""with q as (select list_distinct(flatten(list_transform(string_split_regex(lower(n), '[^\p{L}\p{N}]+'), lambda w: case when w = '' then [] else list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)) end))) as g, k from
    (select p_name as n, p_partkey as k from part union all select 'large part 10', -1))
    select a.k as p_partkey, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) as similarity from q a, (select g from q where k = -1) b where a.k >= 0""")
def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Trigram similarity of every part's name to a query."""
    return table(spark, d, "part").select("p_partkey", F.round(R.similarity("p_name", F.lit("large part 10")), 6).alias("similarity"))


_NEAR = "select vec_id, label, round(greatest(coalesce(list_cosine_similarity(embedding::double[], q::double[]), 0), 0), 5) as vector_score from embeddings, (select embedding as q from embeddings where vec_id = 3)"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").filter("vec_id = 3").first()["embedding"]]


@book.query(f"with n as ({_NEAR} order by vector_score desc, vec_id limit 40) select vec_id, vector_score from n where label <> 2")
def vector_search_global(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors; the serving filter comes after the cut, so fewer may remain."""
    found = R.vector_lane(table(spark, d, "embeddings"), _query_vector(spark, d), 10, serving=F.col("label") != 2, key="vec_id")
    return found.withColumn("vector_score", F.round("vector_score", 5))


@book.query(f"with n as ({_NEAR} where label in (1, 4) order by vector_score desc, vec_id limit 100) select vec_id, vector_score from n")
def vector_search_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of given sources; the filter comes first."""
    found = R.vector_lane(table(spark, d, "embeddings"), _query_vector(spark, d), 10, serving=F.col("label").isin(1, 4), scoped=True, key="vec_id")
    return found.withColumn("vector_score", F.round("vector_score", 5))


@book.query("""with q as (select vec_id as query_id, embedding as qe from embeddings where vec_id % 20 = 0)
    select query_id, vec_id, cosine from (select query_id, vec_id, round(list_cosine_similarity(embedding::double[], qe::double[]), 4) as cosine, row_number() over (partition by query_id order by list_cosine_similarity(embedding::double[], qe::double[]) desc, vec_id) as n from embeddings, q where vec_id <> query_id) where n <= 5""")
def vector_knn_join(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every twentieth vector, in blocks of queries against all rows."""
    e = table(spark, d, "embeddings")
    return knn_blocks(e, e.filter("vec_id % 20 = 0"), 5)


def vector_index(spark: SparkSession, d: str) -> VectorIndex:
    """The index of all embeddings, made at the first call for a table."""
    key = f"{scratch_dir(spark)}/ann", fingerprint(spark, f"{d}/embeddings.parquet")
    if key not in _ANN:
        rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
        index = VectorIndex(Catalogue(spark, f"{key[0]}-{uuid.uuid4().hex}"))
        index.fit(rows)
        index.add(rows)
        _ANN[key] = index
    return _ANN[key]


_ANN: dict[tuple[str, str], VectorIndex] = {}


def _twentieth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("vec_id").alias("skip"))


@book.query("""with q as (select vec_id as query_id, embedding as qe from embeddings where vec_id % 20 = 0)
    select query_id, vec_id, cosine from (select query_id, vec_id, round(list_cosine_similarity(embedding::double[], qe::double[]), 4) as cosine, row_number() over (partition by query_id order by list_cosine_similarity(embedding::double[], qe::double[]) desc, vec_id) as n from embeddings, q where vec_id <> query_id) where n <= 10""")
def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every twentieth vector from the index, by the exact path."""
    return vector_index(spark, d).search(_twentieth(spark, d), 10, exact=True).select("query_id", F.col("id").alias("vec_id"), F.round("cosine", 4).alias("cosine"))


@book.query("select count(*) as queries, count(*) * 10 as wanted, true as at_least_nine_tenths from embeddings where vec_id % 20 = 0")
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the exact ten nearest of every twentieth vector the index finds in the cells it asks."""
    found = vector_index(spark, d).recall(_twentieth(spark, d), 10)
    return found.select("queries", "wanted", (F.col("recall") >= 0.9).alias("at_least_nine_tenths"))


@book.query()
def vector_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every twentieth vector, from the index."""
    return vector_index(spark, d).search(_twentieth(spark, d), 10).select("query_id", F.col("id").alias("vec_id"), F.round("cosine", 4).alias("cosine"), "rank")


def knn_blocks(vectors: DataFrame, queries: DataFrame, k: int, asked_rows: int = 4096, part_rows: int = 16384, least_parts: int = 16) -> DataFrame:
    """The ``k`` nearest vectors of each query. Queries are dealt into blocks and vectors into parts, as many as their counts ask for, so that a
    task's share doesn't grow with the table; each part meets each block once, as matrix products of a few queries at a time. A
    task gives k rows for each query, which are then merged."""

    def nearest(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "cosine": []})
        a, b = (np.array(x.embedding.tolist(), float) for x in (left, right))
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) for x in (a, b))
        own, ids, out = left.vec_id.to_numpy(), right.vec_id.to_numpy(), []
        for start in range(0, len(a), 128):
            scores = a[start : start + 128] @ b.T
            scores[own[start : start + 128, None] == ids] = -np.inf
            # Only what reaches the k-th score is sorted, ties included.
            least = np.partition(scores, -k, axis=1)[:, -k] if len(b) > k else np.full(len(scores), -np.inf)
            for query, row, bound in zip(own[start : start + 128], scores, least, strict=True):
                some = np.flatnonzero((row >= bound) & (row > -np.inf))
                out += [(query, ids[j], row[j]) for j in some[np.lexsort((ids[some], -row[some]))[:k]]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "cosine"])

    blocks, parts = max(1, -(-queries.count() // asked_rows)), max(least_parts, -(-vectors.count() // part_rows))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("vec_id", "embedding", deal(blocks).alias("block"), every(parts).alias("part"))
    rows = vectors.select("vec_id", "embedding", deal(parts).alias("part"), every(blocks).alias("block"))
    met = asked.groupBy("block", "part").cogroup(rows.groupBy("block", "part")).applyInPandas(nearest, "query_id bigint, vec_id bigint, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return met.withColumn("n", rank).filter(F.col("n") <= k).select("query_id", "vec_id", F.round("cosine", 4).alias("cosine"))


@book.query("""select p_partkey, round(1 / (1 + exp(-(len(list_intersect(['large','part','1'], string_split_regex(lower(p_name), '[^a-z0-9]+'))) / 3.0 * 8 - 4))), 6) as rerank_score, true as degraded from part""")
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    """The default rerank score of every part's name."""
    return R.rerank(table(spark, d, "part"), "large part 1", "p_name").select("p_partkey", F.round("rerank_score", 6).alias("rerank_score"), "degraded")


@book.query("""select doc_id, round(0.5::double + case when p = 'docs/src4/4.md' then 0.2::double when d = 'docs/src4' then 0.1 when starts_with(p, 'docs/src4/') then 0.05 else 0 end, 4) as score
    from (select doc_id, 'docs/' || source || case when doc_id % 3 = 0 then '/sub/' else '/' end || doc_id || '.md' as p, 'docs/' || source || case when doc_id % 3 = 0 then '/sub' else '' end as d from documents)""")
def active_file_bias(spark: SparkSession, d: str) -> DataFrame:
    """Scores raised for the open file and its neighbours."""
    path = F.concat(F.lit("docs\\"), "source", F.when(F.col("doc_id") % 3 == 0, "/sub/").otherwise("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    rows = table(spark, d, "documents").select("doc_id", path.alias("source_path"), F.lit(0.5).alias("score"))
    return R.active_file_bias(rows, "docs/src4/4.md").select("doc_id", F.round("score", 4).alias("score"))


@book.query("""select page_id, greatest(case when a = 'en/25' then 120 when p = 'en/25' then 110 when t = 'en/25' then 100 when s = 'en/25' then 90 else 0 end, case when contains(a, 'en/25') then 80 when contains(p, 'en/25') then 70 when contains(t, 'en/25') then 65 when contains(s, 'en/25') then 55 else 0 end) as score
    from (select page_id, lower(regexp_extract(url, '/([a-z]+/[0-9]+)', 1)) as a, lower(url) as p, lower(regexp_extract(html, '<title>([^<]*)', 1)) as t, lower(html) as s from pages)""")
def vault_search(spark: SparkSession, d: str) -> DataFrame:
    """Match scores of every page for a query."""
    pages = table(spark, d, "pages")
    alias, title = F.regexp_extract("url", "/([a-z]+/[0-9]+)", 1), F.regexp_extract("html", "<title>([^<]*)", 1)
    return pages.select("page_id", R.vault_score("EN/25", alias, F.col("url"), title, F.col("html")).alias("score"))


@book.query("""with pages_ as (select page_id, lower(url) as wiki, regexp_extract(url, 'https?://[^/]*(/.*)', 1) as path, regexp_extract(url, '/([a-z]+/[0-9]+)', 1) as alias, regexp_extract(html, '<title>([^<]*)', 1) as title from pages),
    links as (select distinct alias as ref from pages_ union select distinct title from pages_),
    h as (select ref, page_id, min(p) as p from (select ref, page_id, 0 as p from links join pages_ on wiki = ref union all select ref, page_id, 1 from links join pages_ on path = ref union all select ref, page_id, 2 from links join pages_ on alias = ref union all select ref, page_id, 3 from links join pages_ on title = ref) group by 1, 2)
    select ref, page_id, p as priority, n > 1 as ambiguous from (select *, row_number() over (partition by ref order by p, page_id) as r, count(*) over (partition by ref, p) as n from h) where r = 1""")
def link_resolver(spark: SparkSession, d: str) -> DataFrame:
    """Every page's alias and title resolved as a reference."""
    pages = table(spark, d, "pages").select("page_id", F.lower("url").alias("wiki"), F.regexp_extract("url", "https?://[^/]*(/.*)", 1).alias("path"), F.regexp_extract("url", "/([a-z]+/[0-9]+)", 1).alias("alias"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    links = pages.select(F.col("alias").alias("ref")).union(pages.select("title")).distinct()
    return R.resolve_links(links, pages)


@book.query()
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Lexical, identifier and vector lanes merged, scored and diversified; embeddings by the offline provider."""
    index = search_index(spark, d)
    chunks = index.chunks()
    query = "the src1/4.md of then"
    ask = R.hashed_embeddings(spark.createDataFrame([(0, query)], "chunk_id bigint, content string"), "chunk_id", "content").first()["embedding"]
    found = R.hybrid_search(chunks, query, 10, kept_vectors(spark, d), list(ask), index=index)
    return found.withColumn("score", F.round("score", 6))


_GRAMS = r"list_distinct(flatten(list_transform(string_split_regex({0}, '[^\p{{L}}\p{{N}}]+'), lambda w: case when w = '' then [] else list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)) end)))"


def _hybrid_sql(vector: bool, candidates: int) -> str:
    near = "select vec_id * 100000 as chunk_id, greatest(coalesce(list_cosine_similarity(embedding::double[], (select embedding from embeddings where vec_id = 3)::double[]), 0), 0) as v from embeddings order by v desc, vec_id limit 40" if vector else "select null::bigint as chunk_id, 0::double as v where false"
    similar = lambda c: f"len(list_intersect({c}, q)) / len(list_distinct(list_concat({c}, q)))"
    return f"""with {_WINDOWS}, x as (select chunk_id, chunk_index, source, 'docs/' || source || '/' || doc_id || '.md' as path, coalesce(lower(lang || ' ' || source), '') as title, lower(strip_accents(content)) as s from chunks),
    w as (select *, len(list_filter({_LEXEMES.format("s")}, lambda w: w in ('que', 'src1'))) * 0.1::double as cr, len(list_filter({_LEXEMES.format("title || ' ' || path")}, lambda w: w in ('que', 'src1'))) * 0.1::double as dr, (contains(path, 'src1') or contains(title, 'src1'))::int * 4 as n from x),
    l as (select chunk_id, 0::double as v from w where cr > 0 order by cr desc, chunk_id limit {candidates}), e as (select chunk_id, 0::double as v from w where n > 0 order by n desc, chunk_index, chunk_id limit {candidates}), near as ({near}),
    m as (select chunk_id, max(v) as v from (select * from l union all select * from e union all select * from near) group by 1), g as (select w.*, v, {_GRAMS.format("s")} as a, {_GRAMS.format("path")} as b, {_GRAMS.format("'que or src1.'")} as q from w join m using (chunk_id))
    select chunk_id, source as source_id, path as source_path, round(v * 12.0::double + dr * 5.0 + cr * 10.0 + {similar("a")} + {similar("b")} + ((s like '%que%' or path like '%que%')::int + (s like '%src1.%' or path like '%src1.%')::int) * 0.25::double + contains(s, 'src1')::int * 4.0::double + contains(path, 'src1')::int * 16.0::double + contains(title, 'src1')::int * 6.0::double, 4) as score
    from g order by v * 12.0::double + dr * 5.0 + cr * 10.0 + {similar("a")} + {similar("b")} + ((s like '%que%' or path like '%que%')::int + (s like '%src1.%' or path like '%src1.%')::int) * 0.25::double + contains(s, 'src1')::int * 4.0::double + contains(path, 'src1')::int * 16.0::double + contains(title, 'src1')::int * 6.0::double desc, path, chunk_index, source limit 40"""


@book.query(_hybrid_sql(True, 100))
def search_hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    """The forty best of lexical, identifier and vector lanes with every part of the score, before they are diversified."""
    index = search_index(spark, d)
    vectors = table(spark, d, "embeddings").select((F.col("vec_id") * 100000).alias("chunk_id"), "embedding")
    found = R.hybrid_ranked(index.chunks(), "que or src1.", 10, vectors, _query_vector(spark, d), index=index)
    return found.select("chunk_id", "source_id", "source_path", F.round("score", 4).alias("score"))


@book.query(_hybrid_sql(False, 500))
def search_keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    """The same in keyword mode: no vectors, more candidates."""
    index = search_index(spark, d)
    found = R.hybrid_ranked(index.chunks(), "que or src1.", 10, mode="keyword", index=index)
    return found.select("chunk_id", "source_id", "source_path", F.round("score", 4).alias("score"))


@book.query("select source as source_id, count(*) as documents, sum(n)::bigint as chunks from (select source, doc_id, greatest(1, cast(ceil(greatest(length(text) - 400, 0) / 350.0) as bigint) + 1) as n from documents) group by 1")
def list_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources with their documents and windows."""
    found = table(spark, d, "documents").select("source", "doc_id", (F.ceil(F.greatest(F.length("text") - 400, F.lit(0)) / 350) + 1).alias("n"))
    return found.groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("documents"), F.sum("n").alias("chunks"))
