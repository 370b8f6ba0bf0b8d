"""Joins, aggregates, windows, orders and set operations over the star tables and documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.io import small, table
from lodestone.operators import relational as R
from lodestone.plans.book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


@book.query("select o_orderpriority, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem join orders on l_orderkey = o_orderkey group by 1")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    """Inner equi join and hash aggregate."""
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@book.query("select l.l_orderkey, l.l_linenumber, l.l_quantity from lineitem l join (select l_orderkey, max(l_linenumber) as l_linenumber from lineitem group by 1) m using (l_orderkey, l_linenumber)")
def join_composite(spark: SparkSession, d: str) -> DataFrame:
    """Join on a composite key: the active (last) line of each order."""
    lines = table(spark, d, "lineitem")
    active = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    return lines.join(active, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity")


@book.query("select c_custkey, count(o_orderkey) as n_open from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'O' group by 1")
def join_left_on_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Left join whose predicate belongs to the join, not to the result."""
    orders = table(spark, d, "orders").filter("o_orderstatus = 'O'")
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_open"))


@book.query("select n_name, r_name from nation cross join (select r_name from region where r_regionkey = 0)")
def join_single_row(spark: SparkSession, d: str) -> DataFrame:
    """A one-row relation beside every candidate."""
    one = table(spark, d, "region").filter("r_regionkey = 0").select("r_name").limit(1)
    return table(spark, d, "nation").select("n_name").crossJoin(F.broadcast(one))


@book.query("""select doc_id, len(list_filter(['the','ing','tion','qu_'], lambda t: length(t) >= 3 and (lower(text) like '%' || t || '%' or source like '%' || t || '%'))) as term_hits,
    len(list_filter(['src1','est'], lambda i: contains(lower(text), i))) as content_hits, len(list_filter(['src1','est'], lambda i: contains(source, i))) as path_hits from documents""")
def lateral_counts(spark: SparkSession, d: str) -> DataFrame:
    """Correlated counts over query terms (LIKE, so ``_`` is a wildcard) and identifiers: filters over literal arrays, no join."""
    like = "size(filter(array('the','ing','tion','qu_'), t -> length(t) >= 3 and (lower(text) like concat('%', t, '%') or source like concat('%', t, '%'))))"
    ids = F.array(F.lit("src1"), F.lit("est"))
    return table(spark, d, "documents").select("doc_id", F.expr(like).cast("bigint").alias("term_hits"), F.size(F.filter(ids, lambda i: F.contains(F.lower("text"), i))).cast("bigint").alias("content_hits"), F.size(F.filter(ids, lambda i: F.contains("source", i))).cast("bigint").alias("path_hits"))


@book.query("""select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by (o_orderpriority = '1-URGENT') desc, o_orderkey) as n
    from customer left join orders on c_custkey = o_custkey) where n = 1""")
def lateral_first(spark: SparkSession, d: str) -> DataFrame:
    """The best match of each row, null without one."""
    joined = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return R.first_of(joined, ["c_custkey"], F.desc(F.col("o_orderpriority") == "1-URGENT"), F.asc("o_orderkey")).select("c_custkey", "o_orderkey")


@book.query("select n_name, coalesce(k, 0) as n from nation left join (select c_nationkey, count(*) as k from customer group by 1) on n_nationkey = c_nationkey")
def lateral_count(spark: SparkSession, d: str) -> DataFrame:
    """A count beside every row: aggregated first, then joined."""
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k"))
    return table(spark, d, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("k", F.lit(0)).alias("n"))


@book.query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    """EXISTS."""
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@book.query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey) and not exists (select 1 from supplier where s_suppkey = c_custkey)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    """Two NOT EXISTS."""
    c = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return c.join(table(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left_anti").select("c_custkey")


@book.query("""with f as (select p_partkey as file_id, cast(p_size as bigint) as version_id from part),
    s as (select l_partkey as file_id, case when l_linenumber % 2 = 0 then null else cast(l_quantity as bigint) end as version_id, l_orderkey * 10 + l_linenumber as symbol from lineitem),
    v as (select f.file_id, f.version_id, symbol from f join s using (file_id, version_id))
    select * from v union all select f.file_id, f.version_id, symbol from f join s on f.file_id = s.file_id and s.version_id is null where not exists (select 1 from v where v.file_id = f.file_id and v.version_id = f.version_id)""")
def join_null_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of a file's version, else those without a version."""
    files = table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_size").cast("bigint").alias("version_id"))
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("file_id"), F.when(F.col("l_linenumber") % 2 != 0, F.col("l_quantity").cast("bigint")).alias("version_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("symbol"))
    return R.fallback_join(files, rows)


@book.query("""select 'orders.customer' as relation, count(*) as orphans from orders where o_custkey not in (select c_custkey from customer) union all
    select 'lineitem.supplier', count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier) union all
    select 'labels.document', count(*) from labels where doc_id not in (select item_id from benchmark)""")
def orphan_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows that name a missing parent, by relation."""
    t = lambda n: table(spark, d, n)
    found = R.orphans(t("orders"), t("customer"), "o_custkey", "c_custkey", "orders.customer").unionByName(R.orphans(t("lineitem"), t("supplier"), "l_suppkey", "s_suppkey", "lineitem.supplier"))
    return found.unionByName(R.orphans(t("labels"), t("benchmark"), "doc_id", "item_id", "labels.document"))


@book.query("select l_orderkey, g as missing from (select l_orderkey, unnest(range(0, max(l_linenumber) + 1)) as g from lineitem group by 1) where (l_orderkey, g) not in (select (l_orderkey, l_linenumber::bigint) from lineitem)")
def series_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Indices that are missing between 0 and each order's last line."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")).distinct()
    return R.gaps(lines, "l_orderkey", "l_linenumber")


@book.query("""select doc_id, r_name from (select doc_id, 'eu/' || lang || '/' || source as path from documents) left join (select case r_regionkey when 0 then 'eu/en/' when 1 then 'eu/de/' when 2 then 'eu/fr/' else 'none/' || r_regionkey end as prefix, r_name from region) on starts_with(lower(path), prefix)""")
def join_prefix(spark: SparkSession, d: str) -> DataFrame:
    """A source registry looked up by path prefix: a size-checked broadcast theta join."""
    prefix = F.when(F.col("r_regionkey") == 0, "eu/en/").when(F.col("r_regionkey") == 1, "eu/de/").when(F.col("r_regionkey") == 2, "eu/fr/").otherwise(F.concat(F.lit("none/"), F.col("r_regionkey").cast("string")))
    docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("eu/"), "lang", F.lit("/"), "source"))
    return R.prefix_lookup(docs, "path", table(spark, d, "region").select(prefix.alias("prefix"), "r_name"), "prefix").select("doc_id", "r_name")


@book.query("select item_id, count(*) as n_docs from benchmark join documents on contains(documents.text, benchmark.text) group by 1")
def join_contains(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark passage: a nested loop over a size-checked side."""
    items = small(table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")))
    return table(spark, d, "documents").join(items, F.contains("text", F.col("passage"))).groupBy("item_id").agg(F.count("*").alias("n_docs"))


@book.query("select coalesce(nullif(lang, ''), source, 'docs') as category, count(distinct d.doc_id) as n_docs, count(l.doc_id) as n_labels from documents d left join labels l on d.doc_id = l.doc_id group by 1")
def aggregate_categories(spark: SparkSession, d: str) -> DataFrame:
    """Documents and labels by category."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("label_id"))
    joined = table(spark, d, "documents").join(labels, F.col("doc_id") == F.col("label_id"), "left")
    return joined.groupBy(F.coalesce(F.nullif("lang", F.lit("")), "source", F.lit("docs")).alias("category")).agg(F.countDistinct("doc_id").alias("n_docs"), F.count("label_id").alias("n_labels"))


@book.query("""select user_id % 10 as bucket, count(*) filter (where event_type = 'click') as clicks, count(*) filter (where value > 50) as high,
    coalesce(list_sort(list(distinct event_type) filter (where value > 120)), []) as types, list_slice(list_sort(list(distinct event_id)), 1, 5) as sample from events group by 1""")
def aggregate_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Filtered counts, ordered distinct arrays and a bounded sample of ids."""
    bounded = F.row_number().over(Window.partitionBy("bucket").orderBy("event_id")) <= 5
    e = table(spark, d, "events").withColumn("bucket", F.col("user_id") % 10).withColumn("first", bounded)
    return e.groupBy("bucket").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value") > 50).alias("high"), F.sort_array(F.collect_set(F.when(F.col("value") > 120, F.col("event_type")))).alias("types"), F.sort_array(F.collect_set(F.when(F.col("first"), F.col("event_id")))).alias("sample"))


@book.query("""select n_nationkey, (select count(*) from customer where c_nationkey = n_nationkey) as customers, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers,
    (select count(*) from customer where c_nationkey = n_nationkey and c_acctbal < 0) as overdrawn from nation""")
def aggregate_stats(spark: SparkSession, d: str) -> DataFrame:
    """Several counts per row: one conditional aggregate for each table, joined."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("overdrawn"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    joined = table(spark, d, "nation").select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return joined.select("n_nationkey", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("customers", "suppliers", "overdrawn")))


@book.query("select md5(text) as text_md5, count(*) as n from documents group by 1 having count(*) > 1")
def aggregate_having(spark: SparkSession, d: str) -> DataFrame:
    """Identities that occur more than once."""
    return table(spark, d, "documents").groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n")).filter("n > 1")


@book.query("select l_returnflag, l_linestatus, round(max(greatest(coalesce(l_discount, 1.0), 0)), 4) as strength, count(distinct l_suppkey) as suppliers from lineitem group by 1, 2")
def aggregate_max_expression(spark: SparkSession, d: str) -> DataFrame:
    """A maximum over an expression, and a distinct count."""
    strength = F.max(F.greatest(F.coalesce("l_discount", F.lit(1.0)), F.lit(0.0)))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(strength, 4).alias("strength"), F.countDistinct("l_suppkey").alias("suppliers"))


@book.query("select coalesce(lang, 'total') as lang, count(*) as files, sum(n_chars)::bigint as chars, round(avg(n_chars), 4) as mean from documents group by rollup (lang)")
def aggregate_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals by category and over all."""
    return table(spark, d, "documents").rollup("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean")).withColumn("lang", F.coalesce("lang", F.lit("total")))


@book.query("""select count(*) as files, count(*) filter (where n_chars <> length(text)) as wrong_size, count(*) filter (where text is null or text = '') as empty, count(*) filter (where lang is null) as without_language,
    count(*) filter (where doc_id not in (select doc_id from labels)) as unlabelled from documents""")
def invariant_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of broken invariants in a single pass."""
    labels = table(spark, d, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    docs = table(spark, d, "documents").join(labels, "doc_id", "left")
    checks = {"wrong_size": F.col("n_chars") != F.length("text"), "empty": F.coalesce("text", F.lit("")) == "", "without_language": F.col("lang").isNull(), "unlabelled": F.col("labelled").isNull()}
    return docs.agg(F.count("*").alias("files"), *R.invariant_counts(**checks))


@book.query("""select c_nationkey, c_custkey, row_number() over w - 1 as retained from customer where true window w as (partition by c_nationkey order by c_acctbal desc nulls last, c_custkey desc) qualify retained >= 3""")
def window_retention(spark: SparkSession, d: str) -> DataFrame:
    """Row numbers by key for retention: all but the three newest."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc_nulls_last("c_acctbal"), F.desc("c_custkey"))
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", (F.row_number().over(w) - 1).alias("retained")).filter("retained >= 3")


@book.query("select o_orderkey, o_totalprice, count(*) over () as total from orders order by o_totalprice desc, o_orderkey limit 20")
def window_total(spark: SparkSession, d: str) -> DataFrame:
    """A page with the number of all rows."""
    return R.with_total(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 20, F.desc("o_totalprice"), F.asc("o_orderkey"))


@book.query("select distinct on (o_custkey) o_custkey, o_orderkey, o_orderdate from orders order by o_custkey, o_orderdate desc, o_orderkey")
def window_distinct_on(spark: SparkSession, d: str) -> DataFrame:
    """The newest order of each customer."""
    return R.first_of(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.desc("o_orderdate"), F.asc("o_orderkey"))


@book.query("""select event_type, day, mean, case when abs(mean - prev) / prev >= 0.05 then true else false end as changed from (select *, lag(mean) over (partition by event_type order by day) as prev
    from (select event_type, strftime(ts, '%Y-%m-%d') as day, round(avg(value), 6) as mean from events group by 1, 2))""")
def window_changes(spark: SparkSession, d: str) -> DataFrame:
    """Daily means with a mark where they moved by 5 per cent or more."""
    days = table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean"))
    before = F.lag("mean").over(Window.partitionBy("event_type").orderBy("day"))
    return days.withColumn("prev", before).select("event_type", "day", "mean", F.coalesce(F.abs(F.col("mean") - F.col("prev")) / F.col("prev") >= 0.05, F.lit(False)).alias("changed"))


@book.query("select n_nationkey, rank from (select n_nationkey, row_number() over (order by length(n_name) desc, n_nationkey) as rank from nation)")
def window_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks 1 to n by score, ties by position, of a short list."""
    return table(spark, d, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(F.desc(F.length("n_name")), "n_nationkey")).cast("bigint").alias("rank"))


@book.query("select s_suppkey, s_acctbal from supplier order by s_acctbal desc nulls last, s_suppkey offset 10 limit 15")
def order_offset(spark: SparkSession, d: str) -> DataFrame:
    """A page behind an offset, nulls last."""
    return table(spark, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey").offset(10).limit(15)


@book.query("""with r as (select p_partkey, p_name, row_number() over (order by p_retailprice desc, p_partkey) as n from part order by n limit 50),
    s as (select *, 300 - coalesce(sum(least(length(p_name), 12)) over (order by n rows between unbounded preceding and 1 preceding), 0) as left_ from r)
    select p_partkey, substring(p_name, 1, least(least(length(p_name), 12), left_)::int) as p_name from s where left_ > 0""")
def content_budget(spark: SparkSession, d: str) -> DataFrame:
    """Ranked entries within a budget of 300 characters, 12 each."""
    top = table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)
    return R.capped(top, "p_name", 300, 12, F.desc("p_retailprice"), F.asc("p_partkey")).select("p_partkey", "p_name")


@book.query("select k, max(score) as score from (select c_nationkey as k, c_acctbal as score from customer union all select s_nationkey, 0.0 from supplier) group by 1")
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    """Candidate lanes merged, the best score of each kept."""
    lanes = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("score")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(0.0).alias("score")))
    return lanes.groupBy("k").agg(F.max("score").alias("score"))


@book.query("select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    """Distinct union."""
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@book.query("(select l_partkey as k from lineitem where l_quantity > 25 except select l_partkey from lineitem where l_discount > 0.05) union all (select l_suppkey from lineitem intersect select c_custkey from customer)")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Difference and intersection of keys."""
    lines = table(spark, d, "lineitem")
    gone = lines.filter("l_quantity > 25").select(F.col("l_partkey").alias("k")).distinct().join(lines.filter("l_discount > 0.05").select(F.col("l_partkey").alias("k")), "k", "left_anti")
    return gone.union(lines.select("l_suppkey").intersect(table(spark, d, "customer").select("c_custkey")))


_DELTA = """with old as (select doc_id as path, md5(text) as hash from documents where source <> 'src3'), new as (select doc_id as path, case when lang = 'fr' then md5(text || '!') else md5(text) end as hash from documents where source <> 'src5'),
    c as (select coalesce(o.path, n.path) as path, case when o.hash is null then 'add' when n.hash is null then 'delete' when o.hash <> n.hash then 'update' else 'unchanged' end as change from old o full join new n on o.path = n.path)"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    old = docs.filter("source <> 'src3'").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    changed = F.when(F.col("lang") == "fr", F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text"))
    return old, docs.filter("source <> 'src5'").select(F.col("doc_id").alias("path"), changed.alias("hash"))


@book.query(_DELTA + " select path, change from c")
def delta_classes(spark: SparkSession, d: str) -> DataFrame:
    """Additions, updates, deletions and unchanged paths between two snapshots."""
    return R.delta(*_snapshots(spark, d))


@book.query(_DELTA + """ , s as (select count(*) filter (where change = 'add') as adds, count(*) filter (where change = 'update') as updates, count(*) filter (where change = 'delete') as deletes, count(*) filter (where change = 'unchanged') as unchanged from c)
    select *, adds + updates + deletes as total_delta, updates + deletes + unchanged as tracked, adds + updates + deletes >= 500 or adds + updates + deletes >= 0.25 * (updates + deletes + unchanged) as needs_review from s""")
def delta_review(spark: SparkSession, d: str) -> DataFrame:
    """The delta's counts and whether it needs a review."""
    return R.delta_summary(R.delta(*_snapshots(spark, d)))


@book.query("select event_id from events where event_type = 'click' and user_id is distinct from 7 and regexp_matches(md5(props), '^[0-9a-f]{32}$') and not regexp_matches(props, '(?i)\"K\": 1}') and ts < timestamp '2024-01-20' - interval 1 hour")
def filter_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Optional, null-safe, regular-expression and interval predicates."""
    e = R.optional_filter(table(spark, d, "events"), event_type="click", user_id=None)
    return e.filter(~F.col("user_id").eqNullSafe(F.lit(7)) & F.md5("props").rlike("^[0-9a-f]{32}$") & ~F.col("props").rlike('(?i)"K": 1\\}') & (F.col("ts") < F.expr("timestamp_ntz'2024-01-20' - interval 1 hour"))).select("event_id")
