"""Evaluation, monitoring, lifecycle and rate limits over the test tables, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import score as S
from lodestone.io import table
from lodestone.operators import evaluation as E
from lodestone.operators import lifecycle as L
from lodestone.operators import relational as R
from lodestone.plans.book import Book
from lodestone.streaming import limits

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

_RANKED = "r as (select user_id as key, event_id, value, row_number() over (partition by user_id order by ts, event_id) as rank, case when event_type = 'click' then 1.0::double when event_type = 'purchase' then 0.5::double else 0.0::double end as rel from events)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rel = F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "purchase", 0.5).otherwise(0.0)
    return table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "value", rank.alias("rank"), rel.alias("rel"))


@book.query(f"""with {_RANKED}, t as (select *, row_number() over (partition by key order by rel desc, rank) as best from r where rank <= 10)
    select key, round(coalesce(sum(rel / log2(rank + 1)) / nullif(sum(rel / log2(best + 1)), 0), 0), 6) as ndcg from t group by 1""")
def eval_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """nDCG at 10 of each user's events as a ranked list."""
    return E.ndcg_retrieved(_ranked(spark, d), "key").withColumn("ndcg", F.round("ndcg", 6))


@book.query(f"with {_RANKED} select key, round(coalesce(1.0 / min(case when rel > 0 then rank end), 0), 6)::double as mrr, coalesce(bool_or(rel > 0 and rank <= 5), false) as hit from r group by 1")
def eval_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank of the first relevant result and hits within five."""
    return _ranked(spark, d).groupBy("key").agg(F.round(F.coalesce(1 / F.min(F.when(F.col("rel") > 0, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"), F.coalesce(F.bool_or((F.col("rel") > 0) & (F.col("rank") <= 5)), F.lit(False)).alias("hit"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a case: the orders above 150000 are expected, the newest are retrieved (up to eight, at most three are asked for)."""
    o = table(spark, d, "orders").withColumn("path", F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    ranked = o.withColumn("n", rank)
    # At most eight entries a case.
    retrieved = ranked.filter("n <= 8").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("n", "path"))).alias("r"))
    # Orders of one customer: bounded by nature.
    expected = o.filter("o_totalprice > 150000").groupBy("o_custkey").agg(F.array_sort(F.collect_set("path")).alias("expected"))
    shown = F.transform("r", lambda x: F.struct(x["path"].alias("path"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("citation")))
    source = F.when(F.col("o_custkey") % 2 == 0, F.lit("s1"))
    return retrieved.join(expected, "o_custkey").select(F.col("o_custkey").alias("id"), source.alias("source_id"), "expected", F.lit(None).cast("string").alias("citation"), F.when(F.col("o_custkey") % 3 == 0, 3).alias("k"), shown.alias("retrieved"))


_CASES = """o as (select *, 'o/' || o_orderkey as path, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders), k as (select distinct o_custkey, case when o_custkey % 3 = 0 then 3 else 5 end as k from o),
    e as (select o_custkey, list_sort(list(distinct path)) as expected, count(distinct path) as ne from o where o_totalprice > 150000 group by 1),
    t as (select o.o_custkey, n, path, o_totalprice > 150000 as rel from o join k using (o_custkey) where n <= least(k, 8)),
    c as (select k.o_custkey as id, k.k, ne, count(t.n) as returned, count(*) filter (where rel) as hits, min(case when rel then t.n end) as first_rank, max(case when t.n = 1 then path end) as top, any_value(expected[1]) as wanted from k join e using (o_custkey) join t using (o_custkey) group by 1, 2, 3)"""


@book.query(f"with {_CASES} select id, hits > 0 as hit, round(hits / ne, 6) as recall, round(coalesce(1.0 / first_rank, 0), 6)::double as mrr, top = wanted as citation_hit, returned >= k as full_k from c")
def eval_cases(spark: SparkSession, d: str) -> DataFrame:
    """Hit, recall, reciprocal rank and citation of every case."""
    return E.case_metrics(_cases(spark, d)).select("id", "hit", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "citation_hit", "full_k")


@book.query(f"""with {_CASES}, s as (select 'all' as scope, * from c union all select case when id % 2 = 0 then 'scoped' else 'unscoped' end, * from c), m as (select scope, count(*) as cases, avg((hits > 0)::int) as hit, avg(hits / ne) as recall, avg(coalesce(1.0 / first_rank, 0)::double) as mrr, avg((top = wanted)::int) as cite from s group by 1)
    select scope, cases, round(hit, 5) as hit, round(recall, 5) as recall, round(mrr, 5) as mrr, list_filter([case when hit < 0.95 then 'hit' end, case when recall < 0.95 then 'recall' end, case when mrr < 0.8 then 'mrr' end, case when cite < 0.8 then 'citation_hit' end], lambda x: x is not null) as failures from m""")
def eval_gate(spark: SparkSession, d: str) -> DataFrame:
    """Means over all, scoped and unscoped cases, and the bars they miss."""
    s = E.summary(E.case_metrics(_cases(spark, d)))
    return s.select("scope", "cases", *(F.round(c, 5).alias(c) for c in ("hit", "recall", "mrr")), E.gate_failures().alias("failures"))


@book.query("""with r as (select l_orderkey as scenario, l_linenumber as rank, 'p/' || l_partkey as path, l_shipmode as symbol, l_quantity::int as first, l_quantity::int + 3 as last from (select *, l_returnflag as l_shipmode from lineitem)),
    t as (select o_orderkey as scenario, 'p/' || (o_orderkey % 2000) as path, case when o_orderkey % 2 = 0 then 'R' end as symbol, case when o_orderkey % 3 = 0 then 10 end as first, case when o_orderkey % 3 = 0 then 25 end as last from orders)
    select r.scenario, rank, round(max(case when r.path = t.path then case when (t.symbol is null or t.symbol = r.symbol) and (t.first is null or (r.first <= t.last and r.last >= t.first)) then 1.0 else least(1.0, 0.55 + case when t.symbol is null then 0.2 when t.symbol = r.symbol then 0.25 else 0 end + case when t.first is null then 0.05 when r.first <= t.last and r.last >= t.first then 0.2 else 0 end) end else 0 end), 4)::double as rel
    from r left join t using (scenario) group by 1, 2""")
def eval_graded(spark: SparkSession, d: str) -> DataFrame:
    """Graded relevance of every order's lines against its target."""
    q = F.col("l_quantity").cast("int")
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scenario"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_returnflag").alias("symbol"), F.lit(None).cast("string").alias("kind"), q.alias("first"), (q + 3).alias("last"))
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(k.alias("scenario"), F.concat(F.lit("p/"), (k % 2000).cast("string")).alias("path"), F.when(k % 2 == 0, "R").alias("symbol"), F.lit(None).cast("string").alias("kind"), F.when(k % 3 == 0, 10).alias("first"), F.when(k % 3 == 0, 25).alias("last"), F.lit(False).alias("strict"))
    return E.graded_relevance(r, t).withColumn("rel", F.round("rel", 4))


@book.query("select event_type, round(greatest(0, least(1, case when event_type = 'error' then s * 0.7 + 0.3 else s * 0.3 + 0.2 + s * 0.15 + m * 0.15 end)), 5) as quality, round(coalesce(h::double / nullif(k, 0), 0), 5) as known_rate from (select event_type, avg((value > 50)::int) as s, avg(value) / 200 as m, count(*) filter (where value > 90) as h, count(case when value > 40 then 1 end) as k from events group by 1)")
def eval_scenario_quality(spark: SparkSession, d: str) -> DataFrame:
    """Scenario quality and a rate over known values only."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.avg((F.col("value") > 50).cast("int")).alias("s"), (F.avg("value") / 200).alias("m"), E.null_aware_rate(F.when(F.col("value") > 40, F.col("value") > 90)).alias("known_rate"))
    find = S.clamp(F.col("s") * 0.3 + 0.2 + F.col("s") * 0.15 + F.col("m") * 0.15)
    quality = F.when(F.col("event_type") == "error", S.clamp(F.col("s") * 0.7 + 0.3)).otherwise(find)
    return e.select("event_type", F.round(quality, 5).alias("quality"), F.round("known_rate", 5).alias("known_rate"))


_DAYS = "d as (select event_type as metric, strftime(ts, '%Y-%m-%d') as captured_at, round(avg(value), 6) as value from events group by 1, 2)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("metric"), F.date_format("ts", "yyyy-MM-dd").alias("captured_at")).agg(F.round(F.avg("value"), 6).alias("value"))


@book.query(f"""with {_DAYS}, p as (select *, lag(value) over (partition by metric order by captured_at) as previous, row_number() over (partition by metric order by captured_at desc) as n from d)
    select metric, round((value - previous) / previous * 100, 4) as change_percent, case when (value - previous) / previous < -0.05 then 'regression' when (value - previous) / previous > 0.05 then 'improvement' else 'unchanged' end as direction from p where n = 1""")
def monitor_regressions(spark: SparkSession, d: str) -> DataFrame:
    """The last day against the one before, by metric."""
    return E.regressions(_daily(spark, d)).select("metric", F.round("change_percent", 4).alias("change_percent"), "direction")


@book.query("""with s as (select avg(value) as a from events where ts >= timestamp '2024-01-30' - interval 24 hour and ts < timestamp '2024-01-30'), b as (select avg(value) as a from events), m as (select unnest(['hit_rate','ndcg','mrr']) as metric, unnest([100, 50, 30]) as c)
    select metric, round(x, 4) as current, round((x - y) / y * 100, 3) as delta_percent, (x - y) / y * 100 < -10 as alert from (select metric, least(1.0, s.a / c) as x, least(1.0, b.a / c) as y from m, s, b)""")
def monitor_drift(spark: SparkSession, d: str) -> DataFrame:
    """Metrics estimated from the last day's samples against those of all."""
    e = table(spark, d, "events").withColumn("top_score", F.col("value")).withColumn("latency_ms", F.col("value"))
    day = e.filter((F.col("ts") >= F.expr("timestamp_ntz'2024-01-30' - interval 24 hours")) & (F.col("ts") < F.expr("timestamp_ntz'2024-01-30'")))
    found = E.drift(E.proxy_metrics(day), E.proxy_metrics(e)).filter("metric <> 'latency_p95'")
    return found.select("metric", F.round("current", 4).alias("current"), F.round("delta_percent", 3).alias("delta_percent"), "alert")


@book.query(f"""with {_DAYS}, g as (select metric, captured_at, value, substring('▁▂▃▄▅▆▇█', (floor((value - min(value) over w) / (max(value) over w - min(value) over w) * 7) + 1)::int, 1) as c from d window w as (partition by metric))
    select metric, string_agg(c, '' order by captured_at) as line, case when abs((arg_max(value, captured_at) - arg_min(value, captured_at)) / arg_min(value, captured_at)) < 0.01 then 'flat' when arg_max(value, captured_at) > arg_min(value, captured_at) then 'up' else 'down' end as trend from g group by 1""")
def monitor_trend(spark: SparkSession, d: str) -> DataFrame:
    """A sparkline of daily means by metric."""
    return E.sparkline(_daily(spark, d), "metric", "captured_at", "value")


@book.query("""select event_type as tool, count(*) as total, count(*) filter (where value <= 100) as success, count(*) filter (where value > 100) as errors, count(*) filter (where value > 110) as timeouts, percentile_disc(0.5) within group (order by value) as p50, percentile_disc(0.95) within group (order by value) as p95, percentile_disc(0.99) within group (order by value) as p99, min(value) as least, max(value) as most from events group by 1""")
def monitor_latency(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes and latency percentiles by tool."""
    e = table(spark, d, "events").select(F.col("event_type").alias("tool"), "value", (F.col("value") <= 100).alias("ok"), (F.col("value") > 110).alias("slow"))
    return E.latency_summary(e, "tool", "value", "ok", "slow")


@book.query("""with r as (select p_brand as key, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) - row_number() over (partition by p_brand order by p_size desc, p_partkey) as d from part)
    select key, round(1 - 6 * sum(d * d) / (count(*) * (count(*) * count(*) - 1.0)), 6)::double as rho from r group by 1""")
def monitor_rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of price and size within each brand."""
    return E.spearman(table(spark, d, "part"), "p_brand", "p_retailprice", "p_size", "p_partkey").select(F.col("p_brand").alias("key"), F.round("rho", 6).alias("rho"))


@book.query("""with m as (select event_type as mode, avg((value > 50)::int) as hit_rate from events group by 1) select mode, round(hit_rate, 6) as hit_rate, round((select max(hit_rate) from m) - hit_rate, 6) as drop, (select max(hit_rate) from m) - hit_rate > 0.005 as severe from m""")
def monitor_mode_divergence(spark: SparkSession, d: str) -> DataFrame:
    """How far each mode's hit rate stays behind the best."""
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("mode")).agg(F.avg((F.col("value") > 50).cast("int")).alias("hit_rate"))
    return E.mode_divergence(m, 0.005).select("mode", F.round("hit_rate", 6).alias("hit_rate"), F.round("drop", 6).alias("drop"), "severe")


@book.query("""with a as (select o_custkey as key, list(o_orderkey order by o_orderdate desc, o_orderkey) as p, list(o_orderkey order by o_totalprice desc, o_orderkey) as q from orders group by 1)
    select count(*) as queries, count(*) filter (where p <> q) as changed, round(count(*) filter (where p <> q) / count(*), 6) as changed_rate, count(*) filter (where p <> q) / count(*) <= 0.1 as ineffective from a""")
def monitor_rerank_effect(spark: SparkSession, d: str) -> DataFrame:
    """How many result lists another order changes."""
    o = table(spark, d, "orders")
    paths = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, "o_orderkey"))), lambda x: x["o_orderkey"]).alias("paths")
    a = o.withColumn("x", -F.unix_micros(F.col("o_orderdate").cast("timestamp"))).groupBy(F.col("o_custkey").alias("key")).agg(paths("x"))
    b = o.withColumn("x", -F.col("o_totalprice")).groupBy(F.col("o_custkey").alias("key")).agg(paths("x"))
    return E.rerank_effect(a, b).withColumn("changed_rate", F.round("changed_rate", 6))


@book.query("select distinct unnest(case when source = 'src1' then ['docs', 'search'] when source like 'src1_' then ['search'] else [] end) as gate from documents")
def monitor_required_gates(spark: SparkSession, d: str) -> DataFrame:
    """The gates that changed paths require."""
    return E.required_gates(table(spark, d, "documents").select(F.col("source").alias("path")), [("^src1$", "docs"), ("^src1.?$", "search")])


@book.query("select case when lang = 'de' then 'security' when lang = 'fr' then 'graph' else 'general' end as grp, count(*) as n, round(avg(n_chars), 4) as mean from documents group by 1")
def monitor_golden_groups(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by scenario group."""
    tags = F.array(F.when(F.col("lang") == "de", "secret").when(F.col("lang") == "fr", "relation").otherwise("other"))
    return table(spark, d, "documents").groupBy(E.golden_group(tags, F.lit("none")).alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"))


_MEASURED = """m as (select 'hit' as metric, round(avg((lang is not null)::int), 6) as value from documents union all select 'mrr', round(avg(1.0::double / (1 + doc_id % 4)), 6) from documents union all select 'contamination', round(avg((source = 'src3')::int), 6) from documents union all select 'p95', max(n_chars)::double from documents)"""


@book.query(f"""with {_MEASURED}, b as (select unnest(['hit', 'mrr', 'contamination', 'p95']) as metric, unnest([0.88::double, 0.75::double, 0.02::double, 1550.0::double]) as bar)
    select metric, value, bar from m join b using (metric) where case when metric in ('contamination', 'p95') then value > bar else value < bar end""")
def monitor_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of all documents that miss the target level."""
    docs = table(spark, d, "documents")
    share = lambda c: F.round(F.avg(c), 6)
    wide = docs.agg(share(F.col("lang").isNotNull().cast("int")).alias("hit"), share(1.0 / (1 + F.col("doc_id") % 4)).alias("mrr"), share((F.col("source") == "src3").cast("int")).alias("contamination"), F.max("n_chars").cast("double").alias("p95"))
    return E.threshold_failures(wide.unpivot([], ["hit", "mrr", "contamination", "p95"], "metric", "value"))


_EVAL = """r as (select l_orderkey as scenario, rank, 'p/' || l_partkey as path, l_returnflag as symbol, l_quantity::int as first, l_quantity::int + 3 as last from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) as rank from lineitem)),
    t as (select o_orderkey as scenario, k as target, 'p/' || (case k when 0 then o_orderkey % 2000 else coalesce((select min(l_partkey) from lineitem where l_orderkey = o_orderkey), 0) end) as path, case when (o_orderkey + k) % 2 = 0 then 'R' end as symbol, case when (o_orderkey + k) % 3 = 0 then 10 end as first, case when (o_orderkey + k) % 3 = 0 then 25 end as last, (o_orderkey + k) % 6 = 0 as strict from orders, (select unnest([0, 1]) as k) where o_orderkey % 5 <> 0),
    f as (select l_orderkey as scenario, 'p/' || max(l_partkey) as path, case when l_orderkey % 4 = 1 then 'N' end as symbol from lineitem where l_orderkey % 7 in (1, 2) group by l_orderkey),
    s as (select o_orderkey as scenario, case o_orderkey % 4 when 0 then 'must_avoid' when 1 then 'mixed' when 2 then 'must_find' end as mode, case when o_orderkey % 9 = 0 then 2 end as min_hits from orders),
    g as (select r.scenario, rank, max(case when r.path = t.path then case when sy and li then 1.0 else least(1.0, 0.55 + case when t.symbol is null then 0.2 when sy then 0.25 else 0 end + case when t.first is null then 0.05 when li then 0.2 else 0 end) end else 0 end)::double as rel from
        (select r.*, t.target, t.path as tp from r left join t using (scenario)) r left join (select t.*, r.rank as rr, t.symbol is null or t.symbol = r.symbol as sy, t.first is null or case when strict then r.first = t.first and r.last = t.last else r.first <= t.last and r.last >= t.first end as li from t join r using (scenario)) t on t.scenario = r.scenario and t.target = r.target and t.rr = r.rank group by 1, 2),
    n as (select scenario, case when sum(rel / log2(b + 1)) > 0 then sum(rel / log2(rank + 1)) / sum(rel / log2(b + 1)) else 0 end as ndcg from (select *, row_number() over (partition by scenario order by rel desc, rank) as b from g where rank <= 10) group by 1),
    h as (select scenario, count(*) as hits, min(rank) as first_rank from g where rel > 0 group by 1),
    e as (select t.scenario, t.target, t.symbol, t.first, bool_or(coalesce(r.path = t.path, false)) as p, bool_or(coalesce(r.path = t.path and r.symbol = t.symbol, false)) as s, bool_or(coalesce(r.path = t.path and (t.symbol is null or r.symbol = t.symbol) and case when strict then r.first = t.first and r.last = t.last else r.first <= t.last and r.last >= t.first end, false)) as l from t left join r using (scenario) group by 1, 2, 3, 4),
    x as (select scenario, bool_or(p) as path_hit, coalesce(bool_or(s) filter (where symbol is not null), false) or (bool_or(symbol is null) and bool_or(p)) as symbol_hit, coalesce(bool_or(l) filter (where first is not null), false) as l, bool_or(first is null) as al from e group by 1),
    c as (select distinct r.scenario from r join f on f.scenario = r.scenario and f.path = r.path and (f.symbol is null or f.symbol = r.symbol)),
    a as (select s.scenario, coalesce(mode, 'must_find') as mode, c.scenario is not null as contamination, coalesce(hits, 0) as hits, coalesce(first_rank, 0) as first_rank, coalesce(1.0::double / first_rank, 0) as mrr, coalesce(ndcg, 0) as ndcg, case when mode is distinct from 'must_avoid' then path_hit end as path_hit, case when mode is distinct from 'must_avoid' then symbol_hit end as symbol_hit, case when mode is distinct from 'must_avoid' then l or (al and symbol_hit) end as line_hit, coalesce(min_hits, 1) as need, (s.scenario % 50)::double as latency_ms from s left join h using (scenario) left join n using (scenario) left join x using (scenario) left join c using (scenario)),
    z as (select *, not contamination and (mode = 'must_avoid' or hits >= need) as success from a),
    ev as (select *, greatest(0, least(1, case when mode = 'must_avoid' then success::int * 0.7::double + (not contamination)::int * 0.3::double else success::int * 0.3::double + coalesce(path_hit, false)::int * 0.2::double + coalesce(symbol_hit, false)::int * 0.15::double + coalesce(line_hit, false)::int * 0.1::double + mrr * 0.15 + ndcg * 0.15 - contamination::int * 0.3::double end)) as quality from z)"""


def _scenarios(spark: SparkSession, d: str) -> DataFrame:
    lines, orders, k = table(spark, d, "lineitem"), table(spark, d, "orders"), F.col("scenario")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    q, name = F.col("l_quantity").cast("int"), lambda c: F.concat(F.lit("p/"), c.cast("string"))
    none = F.lit(None).cast("string")
    results = lines.select(F.col("l_orderkey").alias("scenario"), F.row_number().over(order).alias("rank"), name(F.col("l_partkey")).alias("path"), F.col("l_returnflag").alias("symbol"), none.alias("kind"), q.alias("first"), (q + 3).alias("last"))
    least = lines.groupBy(F.col("l_orderkey").alias("scenario")).agg(F.min("l_partkey").alias("least"))
    both = orders.select(F.col("o_orderkey").alias("scenario")).filter(k % 5 != 0).join(least, "scenario", "left").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    n = k + F.col("k")
    targets = both.select("scenario", name(F.when(F.col("k") == 0, k % 2000).otherwise(F.coalesce("least", F.lit(0)))).alias("path"), F.when(n % 2 == 0, "R").alias("symbol"), none.alias("kind"), F.when(n % 3 == 0, 10).alias("first"), F.when(n % 3 == 0, 25).alias("last"), (n % 6 == 0).alias("strict"))
    forbidden = lines.filter("l_orderkey % 7 in (1, 2)").groupBy(F.col("l_orderkey").alias("scenario")).agg(name(F.max("l_partkey")).alias("path")).withColumn("symbol", F.when(k % 4 == 1, "N"))
    asked = orders.select(F.col("o_orderkey").alias("scenario"))
    scenarios = asked.select("scenario", F.when(k % 4 == 0, "must_avoid").when(k % 4 == 1, "mixed").when(k % 4 == 2, "must_find").alias("mode"), F.when(k % 9 == 0, 2).alias("min_hits"))
    return E.evaluate_scenarios(scenarios, targets, forbidden, results, asked.select("scenario", (k % 50).cast("double").alias("latency_ms")))


@book.query(f"with {_EVAL} select scenario, mode, success, path_hit, symbol_hit, line_hit, contamination, hits, first_rank, round(mrr, 5) as mrr, round(ndcg, 5) as ndcg, round(quality, 4) as quality from ev")
def eval_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a scenario: its lines are results, with targets to find and targets to avoid."""
    found = _scenarios(spark, d)
    return found.drop("answered", "latency_ms").withColumns({"mrr": F.round("mrr", 5), "ndcg": F.round("ndcg", 5), "quality": F.round("quality", 4)})


@book.query(f"""with {_EVAL} select mode, count(*) as scenarios, round(avg(success::int), 5) as success_rate, round(coalesce(avg(path_hit::int), 0), 5) as exact_path_rate, round(coalesce(avg(symbol_hit::int), 0), 5) as exact_symbol_rate, round(coalesce(avg(line_hit::int), 0), 5) as exact_line_rate,
    round(avg(contamination::int), 5) as contamination_rate, round(avg(mrr), 4) as mrr, round(avg(ndcg), 4) as ndcg, round(avg(quality), 4) as quality, list_sort(list(latency_ms))[(floor((count(*) - 1) * 0.5::double) + 1)::int] as latency_p50, list_sort(list(latency_ms))[(floor((count(*) - 1) * 0.95::double) + 1)::int] as latency_p95 from ev group by 1""")
def eval_variants(spark: SparkSession, d: str) -> DataFrame:
    """Rates with their own denominators, means and latencies of the scenarios of each mode."""
    found = E.variant_metrics(_scenarios(spark, d), "mode")
    fine = {c: F.round(c, 5) for c in found.columns if c.endswith("_rate")} | {c: F.round(c, 4) for c in ("mrr", "ndcg", "quality")}
    return found.withColumns(fine)


@book.query("select p_partkey as path, case when p_size % 4 = 0 or p_size % 5 = 0 then 'process' when p_size % 3 = 0 then 'repair' else 'skip' end as decision from part")
def lifecycle_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What to do with each file, from its state and content."""
    p = table(spark, d, "part")
    state = p.filter("p_size % 5 <> 0").select(F.col("p_partkey").alias("path"), F.md5("p_name").alias("hash"), F.lit("v1").alias("profile"), F.lit(2).alias("chunks"), F.when(F.col("p_size") % 3 == 0, 1).otherwise(2).alias("embeddings"))
    now = p.select(F.col("p_partkey").alias("path"), F.md5("p_name").alias("hash"), F.when(F.col("p_size") % 4 == 0, "v2").otherwise("v1").alias("profile"))
    return L.processing_decision(state, now)


@book.query("select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) - 1 as n from orders where o_orderkey not in (select max(o_orderkey) from orders group by o_custkey)) where n >= 2")
def lifecycle_retention(spark: SparkSession, d: str) -> DataFrame:
    """Superseded generations beyond the two newest, never the one pointed to."""
    g = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("generation_id"), F.col("o_orderdate").alias("published_at"))
    pointers = g.groupBy("source_id").agg(F.max("generation_id").alias("generation_id"))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("published_at"), F.desc("generation_id"))) - 1
    gone = L.retention(g, pointers, 2)
    ranked = g.join(pointers, ["source_id", "generation_id"], "left_anti").withColumn("n", rank.cast("bigint"))
    return gone.select("source_id", "generation_id").join(ranked, ["source_id", "generation_id"]).select(F.col("source_id").alias("o_custkey"), F.col("generation_id").alias("o_orderkey"), "n")


@book.query("""with v as (select o_orderkey as version_id, o_custkey as file_id, case o_orderstatus when 'O' then 'pending' when 'F' then 'ready' else 'failed' end as status from orders), s as (select *, case when status = 'pending' and version_id % 2 = 0 then 'ready' else status end as s from v)
    select version_id, case when s = 'ready' and version_id < max(case when s = 'ready' then version_id end) over (partition by file_id) then 'replaced' else s end as status from s""")
def lifecycle_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Version status after promotion of complete versions."""
    o = table(spark, d, "orders")
    v = o.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("file_id"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "ready").otherwise("failed").alias("status"))
    return L.promote(v, v.filter("version_id % 2 = 0").select("version_id")).select("version_id", "status")


@book.query("""with i as (select doc_id as path, md5(text) as h, n_chars as m from documents where doc_id % 7 <> 0), o as (select doc_id as path, case when doc_id % 5 = 0 then 'x' else md5(text) end as h, case when doc_id % 3 = 0 then n_chars + 1 else n_chars end as m from documents where doc_id % 11 <> 0)
    select coalesce(i.path, o.path) as path, case when o.path is null then 'missing' when i.path is null then 'new' when i.h <> o.h then 'stale' when i.m <> o.m then 'metadata-drift' else 'fresh' end as by_hash,
    case when o.path is null then 'missing' when i.path is null then 'new' when i.m = o.m then 'fresh' when i.h = o.h then 'metadata-drift' else 'stale' end as by_time from i full join o on i.path = o.path""")
def lifecycle_freshness(spark: SparkSession, d: str) -> DataFrame:
    """File freshness by both rules."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    index = docs.filter(k % 7 != 0).select(k.alias("path"), F.md5("text").alias("hash"), F.col("n_chars").alias("mtime"))
    disk = docs.filter(k % 11 != 0).select(k.alias("path"), F.when(k % 5 == 0, "x").otherwise(F.md5("text")).alias("hash"), F.when(k % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("mtime"))
    return L.file_freshness(index, disk, True).withColumnRenamed("state", "by_hash").join(L.file_freshness(index, disk, False).withColumnRenamed("state", "by_time"), "path")


@book.query("""with l as (select user_id as source_id, arg_max(value <= 100, (ts, event_id)) as ok, max(ts) as fin from events where user_id % 2 = 0 group by 1) select u.source_id, case when fin is null then 'missing' when not ok then 'alert' when epoch(timestamp '2024-01-31' - date_trunc('second', fin)) / 3600 < 0 then 'invalid' when epoch(timestamp '2024-01-31' - date_trunc('second', fin)) / 3600 > 24 then 'stale' else 'ok' end as state
    from (select distinct user_id as source_id from events) u left join l using (source_id)""")
def lifecycle_source_freshness(spark: SparkSession, d: str) -> DataFrame:
    """The state of every source by its latest report."""
    e = table(spark, d, "events")
    reports = R.first_of(e.filter("user_id % 2 = 0"), ["user_id"], F.desc("ts"), F.desc("event_id")).select(F.col("user_id").alias("source_id"), F.date_trunc("second", "ts").alias("finished_at"), (F.col("value") <= 100).alias("ok"))
    return L.source_freshness(reports, e.select(F.col("user_id").alias("source_id")).distinct(), "2024-01-31 00:00:00", 24).select("source_id", "state")


_JOBS = "j as (select o_orderkey as job_id, case o_orderstatus when 'O' then 'queued' when 'F' then 'running' else 'retry-wait' end as status, o_orderdate as available_at, o_orderdate + interval 1 day as lease_until, o_orderkey % 4 as attempts, 3 as max_attempts, o_custkey % 5 = 0 as cancel_requested, o_custkey * 2 as dedupe_key from orders)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "running").otherwise("retry-wait")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("available_at"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("lease_until"), (F.col("o_orderkey") % 4).alias("attempts"), F.lit(3).alias("max_attempts"), (F.col("o_custkey") % 5 == 0).alias("cancel_requested"), (F.col("o_custkey") * 2).alias("dedupe_key"))


@book.query(f"with {_JOBS} select job_id, available_at from j where ((status in ('queued', 'retry-wait') and available_at <= timestamp '1996-01-01') or (status = 'running' and lease_until <= timestamp '1996-01-01')) and attempts < 3 order by available_at, job_id limit 1")
def jobs_next_claim(spark: SparkSession, d: str) -> DataFrame:
    """The job to run next."""
    return L.next_claim(_jobs(spark, d), F.expr("timestamp_ntz'1996-01-01'"), 3).select("job_id", "available_at")


@book.query(f"with {_JOBS} select job_id, case when cancel_requested then 'cancelled' when attempts >= max_attempts then 'dead-letter' else 'retry-wait' end as status from j where status = 'running' and lease_until <= timestamp '1996-01-01'")
def jobs_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Running jobs whose lease is over."""
    return L.recovered(_jobs(spark, d), F.expr("timestamp_ntz'1996-01-01'")).select("job_id", "status")


@book.query(f"with {_JOBS} select l_suppkey as dedupe_key, min(l_orderkey * 10 + l_linenumber) as request_id from lineitem where l_suppkey not in (select dedupe_key from j) group by 1")
def jobs_enqueue(spark: SparkSession, d: str) -> DataFrame:
    """Requests that no active job covers."""
    requests = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("dedupe_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"))
    return L.enqueue(_jobs(spark, d), requests).select("dedupe_key", "request_id")


@book.query("""with e as (select user_id as job_id, event_id as seq, case event_type when 'click' then 'claim' when 'view' then 'enqueue' when 'purchase' then 'finish' else 'fail' end as kind from events)
    select job_id, case arg_max(kind, seq) when 'claim' then 'running' when 'enqueue' then 'queued' when 'finish' then 'done' else 'retry-wait' end as status, count(*) filter (where kind = 'claim') as attempts from e group by 1""")
def jobs_folded(spark: SparkSession, d: str) -> DataFrame:
    """The state of every job from its events."""
    kind = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "enqueue").when(F.col("event_type") == "purchase", "finish").otherwise("fail")
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").alias("at"))
    return L.fold_jobs(e).select("job_id", "status", "attempts")


@book.query("select event_id, count(*) over (partition by user_id order by epoch_ms(ts) range between 86399999 preceding and current row) as recent from events")
def limit_recent(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events of the last day, by a range frame."""
    return table(spark, d, "events").select("event_id", limits.recent_count("user_id", F.col("ts"), 86400).alias("recent"))


def _limit(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", "ts")
        return limits.limit_batch(e, kind, 3, 86400.0).select("event_id", "allowed", "remaining")

    return run


QUERIES["limit_fixed_window"] = _limit("fixed")
QUERIES["limit_sliding_window"] = _limit("sliding")
_ORDERED = "e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events)"
ORACLES["limit_fixed_window"] = f"""with recursive {_ORDERED}, r(user_id, event_id, n, c, until, allowed, remaining) as (select user_id, event_id, n, 1, t + 86400000000, true, 2 from e where n = 1 union all
    select e.user_id, e.event_id, e.n, case when e.t > r.until then 1 else least(r.c + 1, 3) end, case when e.t > r.until then e.t + 86400000000 else r.until end, e.t > r.until or r.c < 3, case when e.t > r.until then 2 else greatest(2 - r.c, 0) end from r join e on e.user_id = r.user_id and e.n = r.n + 1)
    select event_id, allowed, remaining::int as remaining from r"""
ORACLES["limit_sliding_window"] = f"""with recursive {_ORDERED}, r(user_id, event_id, n, kept, allowed) as (select user_id, event_id, n, [t], true from e where n = 1 union all
    select user_id, event_id, n, case when len(k) < 3 then list_append(k, t) else k end, len(k) < 3 from (select e.*, list_filter(r.kept, lambda x: x > e.t - 86400000000) as k from r join e on e.user_id = r.user_id and e.n = r.n + 1))
    select event_id, allowed, greatest(0, 3 - len(kept))::int as remaining from r"""


@book.query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type as key, count(*) as n, round(avg(value), 5) as mean from events group by 1, 2")
def window_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows by event time (with a watermark, which a finished table ignores)."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), "value")
    return limits.windowed(e, "1 day", "1 hour", n=F.count("*"), mean=F.avg("value")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "key", "n", F.round("mean", 5).alias("mean"))


@book.query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g)
    select user_id::varchar as key, count(*) as n, floor(epoch(min(ts)))::bigint as start_s from s group by user_id, s.n""")
def window_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users that end after six hours."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("key"))
    return limits.sessions(e, "6 hours", "1 hour").select("key", "n", F.unix_seconds("start").alias("start_s"))


@book.query("select sum(tokens)::bigint as tokens, round(sum(tokens) / 1000.0 * 0.002, 6)::double as cost, sum(tokens) <= 100000000 as within from (select cast(ceil(length(text) / 4.0) as bigint) as tokens from documents)")
def budget_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and cost of a run against its cap."""
    t = table(spark, d, "documents").agg(F.sum(F.ceil(F.length("text") / 4)).alias("tokens"))
    return t.select("tokens", F.round(F.col("tokens") / 1000 * 0.002, 6).alias("cost"), (F.col("tokens") <= 100_000_000).alias("within"))


@book.query("select event_type as tool, count(*) as n, floor((row_number() over (order by event_type) - 1) / 2)::bigint as batch from events group by 1")
def batches(spark: SparkSession, d: str) -> DataFrame:
    """Tools grouped into batches of two."""
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("n"))
    return g.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("tool")) - 1) / 2))
