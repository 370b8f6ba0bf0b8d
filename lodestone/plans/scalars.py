"""Scalar functions over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import score as S
from lodestone.functions import text as T
from lodestone.io import table
from lodestone.plans.book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

CORPUS = "'ingest/processed/external/' || source || '/' || doc_id || '.md'"


@book.query("""select doc_id, md5(lower(strip_accents(concat_ws(' ', source, lang, text)))) as search_md5,
    length(lower(strip_accents(concat_ws(' ', source, lang, text)))) as n from documents""")
def text_search_projection(spark: SparkSession, d: str) -> DataFrame:
    """Normalised search text of every document: joined parts, no diacritics, lower case."""
    found = table(spark, d, "documents").select("doc_id", T.search_text("source", "lang", "text").alias("s"))
    return found.select("doc_id", F.md5("s").alias("search_md5"), F.length("s").cast("bigint").alias("n"))


@book.query("""select item_id, list_transform(string_split_regex(lower(regexp_replace(strip_accents(text), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9_./-]+'), lambda x: x) as terms,
    len(string_split_regex(lower(strip_accents(text)), '[^a-z0-9_./-]+')) as n_code_terms from benchmark""")
def text_terms(spark: SparkSession, d: str) -> DataFrame:
    """Query terms for prose (camel case split) and their number for code (not split)."""
    return table(spark, d, "benchmark").select("item_id", T.terms("text").alias("terms"), F.size(T.terms("text", camel=False)).cast("bigint").alias("n_code_terms"))


@book.query("""select event_id, list_distinct(list_filter(list_transform(list_filter(string_split_regex(q, '[^\\p{L}\\p{N}_./-]+'), lambda w: regexp_matches(w, '[a-z][A-Z]|[_./]')),
    lambda w: regexp_replace(lower(w), '[^a-z0-9]+', '', 'g')), lambda w: length(w) >= 3)) as ids
    from (select event_id, 'open src/' || event_type || '/userProfile' || user_id || '.ts of user_' || user_id || ' now' as q from events)""")
def text_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that a query names exactly."""
    q = F.expr("'open src/' || event_type || '/userProfile' || user_id || '.ts of user_' || user_id || ' now'")
    return table(spark, d, "events").select("event_id", F.array_sort(T.identifiers(q)).alias("ids"))


ORACLES["text_identifiers"] = ORACLES["text_identifiers"].replace("list_distinct(", "list_sort(list_distinct(", 1).replace(">= 3)) as ids", ">= 3))) as ids")


@book.query(f"""select doc_id, regexp_extract(p, '^(.*)/[^/]*$', 1) as dir, regexp_extract(p, '([^/]*)$', 1) as base, 'md' as ext,
    upper(p[1]) || p[2:] as title, p like '%/' || source || '/' || doc_id || '.md' as suffix_match
    from (select doc_id, source, {CORPUS} as p from documents)""")
def text_paths(spark: SparkSession, d: str) -> DataFrame:
    """Directory, name, extension, title case and suffix match of stored paths (built with backslashes and doubled slashes)."""
    raw = F.expr("'.\\\\\\\\ingest//processed\\\\\\\\external//' || source || '/' || doc_id || '.md'")
    p = table(spark, d, "documents").withColumn("p", T.stored_path(raw))
    return p.select("doc_id", T.directory("p").alias("dir"), T.basename("p").alias("base"), T.extension("p").alias("ext"), T.title_case("p").alias("title"), T.paths_match("p", F.expr("source || '/' || doc_id || '.md'")).alias("suffix_match"))


@book.query(r"""select p_partkey, k as kebab, case when length(k) < 2 or k in ('the', 'and') then null else k end as topic,
    case when k like '%ies' and length(k) > 4 then k[:-4] || 'y' when k like '%s' and length(k) > 3 and k not like '%ss' then k[:-2] else k end as canonical
    from (select p_partkey, array_to_string(list_filter(list_transform(string_split_regex(trim(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')), '\s+'), lambda x: lower(x)), lambda x: x <> ''), '-') as k from part)""")
def text_topics(spark: SparkSession, d: str) -> DataFrame:
    """Names as topics: kebab case, stop words dropped, singular."""
    k = T.kebab("p_name")
    return table(spark, d, "part").select("p_partkey", k.alias("kebab"), T.normalised_topic("p_name", ["the", "and"]).alias("topic"), T.canonical_topic(k).alias("canonical"))


@book.query(r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(string_split(text, chr(10))[1])), '[`*_#\[\]()<>{}]', '', 'g'), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from documents""")
def text_slug(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each document as an anchor."""
    return table(spark, d, "documents").select("doc_id", T.slug(F.substring_index("text", "\n", 1)).alias("slug"))


@book.query(r"""select doc_id, case when hit > 0 then trim(regexp_replace(substring(text, s, least(hit + 3 + 72, length(text) + 1) - s), '\s+', ' ', 'g')) end as snippet
    from (select *, greatest(1, hit - 48) as s from (select doc_id, text, instr(lower(text), 'the') as hit from documents))""")
def text_snippet(spark: SparkSession, d: str) -> DataFrame:
    """The text around the first match of a word."""
    return table(spark, d, "documents").select("doc_id", T.snippet("text", "The").alias("snippet"))


@book.query(r"""select doc_id, list_filter(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> ''),
    lambda p: contains(lower(p), 'the') and contains(lower(p), 'ing'))[1] as snippet from documents""")
def text_term_snippet(spark: SparkSession, d: str) -> DataFrame:
    """The first paragraph that holds all words."""
    return table(spark, d, "documents").select("doc_id", T.term_snippet("text", ["the", "ing"]).alias("snippet"))


@book.query(r"""select doc_id, case when length(text) <= 200 then text else regexp_replace(case when b > 80 then substring(c, 1, b) else c end, '\s+$', '') || '...' end as short
    from (select *, greatest(case when contains(c, chr(10)) then 197 - instr(reverse(c), chr(10)) else -1 end, case when contains(c, '. ') then 197 - instr(reverse(c), ' .') - 1 else -1 end, case when contains(c, '; ') then 197 - instr(reverse(c), ' ;') - 1 else -1 end) as b
    from (select doc_id, text, substring(text, 1, 197) as c from documents))""")
def text_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to 200 characters at a boundary."""
    return table(spark, d, "documents").select("doc_id", T.truncate("text", 200).alias("short"))


@book.query(r"""select doc_id, case when regexp_matches(lower(text), 'concurrency|vector|embedding|distributed|consistency|transaction|benchmark|optimization') then 'advanced'
    when length(text) >= 2500 then 'intermediate' else 'beginner' end as complexity, cast(ceil(length(text) / 4.0) as bigint) as tokens,
    sha256(substring(text, 1, 2000)) as input_sha256, length('Instruct: find' || chr(10) || 'Query: ' || text) as n_instructed from documents""")
def text_labels(spark: SparkSession, d: str) -> DataFrame:
    """Complexity label, token estimate, digest of the embedding input and length of the instructed query."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.complexity("text").alias("complexity"), T.token_estimate("text").alias("tokens"), S.sha256(T.embedding_input(F.lit(""), "text")).alias("input_sha256"), F.length(T.query_instruction("text", "find")).cast("bigint").alias("n_instructed"))


@book.query(r"""select doc_id, list_filter([case when length(trim(a)) < 50 then 'too-short' end, case when length(a) > 2 * length(text) then 'too-long' end,
    case when len(w) > 5 and 2 * len(list_filter(w, lambda x: contains(lower(a), x))) < len(w) then 'terms-lost' end], lambda x: x is not null) as issues
    from (select doc_id, text, substring(text, 1, 400) as a, list_distinct(list_filter(list_transform(regexp_extract_all(text, '\b[a-zA-Z]{4,}\b'), lambda x: lower(x)),
    lambda x: x not in ('that','this','with','from','have','will','your','which','their','there','would','could','should'))) as w from documents)""")
def text_adaptation_issues(spark: SparkSession, d: str) -> DataFrame:
    """Checks of texts shortened to 400 characters."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.adaptation_issues("text", F.substring("text", 1, 400)).alias("issues"))


@book.query("""select doc_id, list_slice(list_distinct_ordered, 1, 3) as lines from (select doc_id,
    list_filter(l, lambda x, i: list_position(l, x) = i) as list_distinct_ordered from (select doc_id, list_filter(list_transform(string_split_regex(
    regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as l
    from documents))""")
def text_key_lines(spark: SparkSession, d: str) -> DataFrame:
    """First three key lines of every document."""
    return table(spark, d, "documents").select("doc_id", T.key_lines("text", 3).alias("lines"))


@book.query(r"""select doc_id, regexp_replace(text || chr(7) || 'x', '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g') = text || ' x' as clean,
    'Ingest Processed ' || source as name, 'ingest-processed-' || source as slug from documents""")
def text_control_and_names(spark: SparkSession, d: str) -> DataFrame:
    """Control characters become blanks; project names and slugs from root paths."""
    docs = table(spark, d, "documents")
    name = T.project_name(F.concat(F.lit("/srv/ingest_processed-"), F.col("source"), F.lit("/")))
    fixed = T.without_control(F.concat("text", F.lit("\x07x"))) == F.concat("text", F.lit(" x"))
    return docs.select("doc_id", fixed.alias("clean"), F.regexp_replace(name, "Src", "src").alias("name"), T.project_slug(name).alias("slug"))


@book.query("""select event_id, floor(age)::bigint as age_days, floor(age * 24 + 1e-6)::bigint as age_hours, round(1 / (1 + 0.01 * greatest(0, age)), 6) as recency,
    round(6.5 * greatest(0, least(1, value / 100)) + 3.5 * exp(-(user_id % 7) / 5.0) + 0.12 * greatest(0, least(1, 1 / (1 + 0.01 * greatest(0, age)))) + 0.9 * greatest(0, least(1, value / 50)) + 1.2 * 0.5, 6) as fused,
    round(1 / (1 + exp(-(value / 100))), 6) as sigmoid, round(case when user_id % 4 > 0 then value * (1 + 0.2 * (user_id % 4)) else value end, 6) as boosted,
    value / 100 >= 0.25 as passes from (select *, epoch(timestamp '2024-02-01' - ts) / 86400 as age from (select event_id, user_id, value, date_trunc('second', ts) as ts from events))""")
def score_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Age, recency, weighted fusion, sigmoid, tag boost and threshold for every event."""
    e = table(spark, d, "events").withColumn("age", S.age_days(F.date_trunc("second", "ts"), "2024-02-01 00:00:00"))
    fused = S.fusion(F.col("value") / 100, S.rank_score(F.col("user_id") % 7), S.recency("age"), F.col("value") / 50, F.lit(0.5))
    return e.select("event_id", F.floor("age").alias("age_days"), F.floor(F.col("age") * 24 + 1e-6).alias("age_hours"), F.round(S.recency("age"), 6).alias("recency"), F.round(fused, 6).alias("fused"), F.round(S.sigmoid(F.col("value") / 100), 6).alias("sigmoid"), F.round(S.tag_boost("value", F.col("user_id") % 4), 6).alias("boosted"), (F.col("value") / 100 >= S.THRESHOLD).alias("passes"))


@book.query("""select vec_id, round(coalesce(list_cosine_similarity(embedding::double[], q::double[]), 0), 5) as cosine, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 5) as norm, len(embedding) = 64 as valid
    from embeddings, (select embedding as q from embeddings where vec_id = 0)""")
def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine similarity to one vector, length and validity of every vector."""
    e = table(spark, d, "embeddings")
    q = [float(x) for x in e.filter("vec_id = 0").first()["embedding"]]
    return e.select("vec_id", F.round(S.cosine("embedding", F.lit(q)), 5).alias("cosine"), F.round(S.norm("embedding"), 5).alias("norm"), S.valid_vector("embedding", 64).alias("valid"))


@book.query("""select c_custkey, list_transform(range(0, 4), lambda j: round(sin(c_custkey + j) * 0.1, 6)) as wave, 'v1|local|m|64|doc|off|512|' || sha256(c_name) as cache_key from customer""")
def vector_test_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Test embeddings and embedding cache keys."""
    c = table(spark, d, "customer")
    wave = F.transform(S.wave_vector("c_custkey", 4), lambda x: F.round(x, 6))
    return c.select("c_custkey", wave.alias("wave"), S.cache_key(F.lit("local"), F.lit("m"), F.lit("64"), F.lit("doc"), F.lit("off"), F.lit("512"), S.sha256("c_name")).alias("cache_key"))


@book.query("""select source, sha256(string_agg(sha256(text), chr(10) order by sha256(text))) as list_hash, sha256(string_agg(p || chr(0) || sha256(text) || chr(0), '' order by p || chr(0) || sha256(text))) as manifest_hash, count(*) as n
    from (select source, text, 'd/' || doc_id as p from documents) group by source""")
def hash_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each source's sorted content hashes and of its manifest of paths and hashes."""
    docs = table(spark, d, "documents").withColumn("p", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))
    return docs.groupBy("source").agg(S.list_hash(S.sha256("text")).alias("list_hash"), S.manifest_hash("p", S.sha256("text")).alias("manifest_hash"), F.count("*").alias("n"))


@book.query("""select n_nationkey, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(n_name, ''), lambda c: ascii(c)::bigint)), lambda h, v: ((xor(h, v)) * 16777619::hugeint % 4294967296)::bigint) as fnv from nation""")
def hash_fnv1a(spark: SparkSession, d: str) -> DataFrame:
    """The 32-bit FNV-1a hash of names."""
    return table(spark, d, "nation").select("n_nationkey", S.fnv1a("n_name").alias("fnv"))


@book.query("""with s as (select event_type, list_sort(list(value)) as v, count(*) as n from events group by 1)
    select event_type, round(v[cast(floor((n - 1) * 0.95) as bigint) + 1], 6) as p95_floor, round(v[cast(ceil(0.95 * n) as bigint)], 6) as p95_nearest, round(v[least(cast(floor(n * 0.95) as bigint) + 1, n)], 6) as p95_index from s""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The three percentile definitions side by side."""
    return table(spark, d, "events").groupBy("event_type").agg(F.round(S.percentile_floor(F.col("value"), 0.95), 6).alias("p95_floor"), F.round(S.percentile_nearest("value", 0.95), 6).alias("p95_nearest"), F.round(S.percentile_index(F.col("value"), 0.95), 6).alias("p95_index"))


@book.query("""select event_id, cast(json_extract(props, '$.k') as bigint) as k, len(json_keys(props)) as n_keys, json_exists(props, '$.k') as has_k, json_type(props) = 'OBJECT' as is_object, ts - interval 1 hour as hour_before,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' as iso, greatest(value, 50.0) as floor50 from events""")
def json_and_time(spark: SparkSession, d: str) -> DataFrame:
    """JSON fields and keys, interval arithmetic and ISO formatting."""
    e = table(spark, d, "events")
    keys = F.json_object_keys("props")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.size(keys).cast("bigint").alias("n_keys"), F.array_contains(keys, "k").alias("has_k"), keys.isNotNull().alias("is_object"), (F.col("ts") - F.expr("interval 1 hour")).alias("hour_before"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.greatest("value", F.lit(50.0)).alias("floor50"))
