"""Retrieval evaluation, gates, comparisons and monitoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import score as S
from lodestone.functions import text as T


def gain(relevance: Column | str, rank: Column | str) -> Column:
    """A result's discounted gain; ranks from 1."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return col(relevance) / F.log2(col(rank) + 1)


def ndcg_retrieved(results: DataFrame, key: str, relevance: str = "rel", rank: str = "rank", k: int = 10) -> DataFrame:
    """(key, ndcg): the ideal is the retrieved list itself in the best order, so what was missed costs nothing."""
    top = results.filter(F.col(rank) <= k)
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(relevance), rank))
    sums = top.withColumn("_best", best).groupBy(key).agg(F.sum(gain(relevance, rank)).alias("dcg"), F.sum(gain(relevance, "_best")).alias("ideal"))
    return sums.select(key, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def case_metrics(cases: DataFrame, default_k: int = 5) -> DataFrame:
    """One row per case. ``cases``: id, source_id, expected (array), citation, k, retrieved (array of path, source_id, citation)."""
    k = F.coalesce("k", F.lit(default_k))
    top = cases.withColumn("k", k).withColumn("top", F.slice("retrieved", F.lit(1), k))
    match = lambda p, e: (p == e) | F.endswith(p, F.concat(F.lit("/"), e))
    found = F.filter("expected", lambda e: F.exists("top", lambda r: match(r["path"], e)))
    relevant = F.transform("top", lambda r: F.exists("expected", lambda e: match(r["path"], e)))
    first = F.array_position(relevant, True)
    wanted = F.coalesce("citation", F.get("expected", 0))
    cited = F.coalesce(F.get("top", 0)["citation"], F.get("top", 0)["path"], F.lit(""))
    unique = F.size(F.array_distinct(F.transform("top", lambda r: F.concat(F.coalesce(r["source_id"], F.col("source_id"), F.lit("")), F.lit(":"), r["path"]))))
    n = F.size("top")
    return top.select(
        "id", "source_id", "k", (F.size(found) > 0).alias("hit"), (F.size(found) / F.size("expected")).alias("recall"), first.alias("first_rank"),
        F.when(first > 0, 1 / first).otherwise(0.0).alias("mrr"), ((cited != "") & match(cited, wanted)).alias("citation_hit"), n.alias("returned"),
        F.when(n > 0, (n - unique) / n).otherwise(0.0).alias("duplicate_share"), (n >= F.col("k")).alias("full_k"),
    )


def summary(cases: DataFrame) -> DataFrame:
    """Means over all, scoped and unscoped cases."""
    scope = F.explode(F.array(F.lit("all"), F.when(F.col("source_id").isNull(), "unscoped").otherwise("scoped")))
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return cases.select("*", scope.alias("scope")).groupBy("scope").agg(F.count("*").alias("cases"), rate("hit"), rate("recall"), rate("mrr"), rate("citation_hit"), rate("duplicate_share"), rate("full_k"))


#: Bars of the documentation gate: metric, direction, bound. Fixed values.
GATE = [("hit", "min", 0.95), ("recall", "min", 0.95), ("mrr", "min", 0.8), ("citation_hit", "min", 0.8), ("duplicate_share", "max", 0.3)]
#: Bars of project evaluation by level. Fixed values.
PROJECT_BARS = {
    "minimum": {"hit": 0.80, "path": 0.80, "symbol": 0.65, "line": 0.55, "mrr": 0.65, "ndcg": 0.70, "quality": 0.72, "contamination": 0.05, "p95": 1800},
    "target": {"hit": 0.88, "path": 0.85, "symbol": 0.75, "line": 0.65, "mrr": 0.75, "ndcg": 0.80, "quality": 0.80, "contamination": 0.02, "p95": 1550},
    "stretch": {"hit": 0.92, "path": 0.90, "symbol": 0.82, "line": 0.72, "mrr": 0.82, "ndcg": 0.86, "quality": 0.86, "contamination": 0.0, "p95": 900},
}
LOWER_IS_BETTER = {"contamination", "p95", "duplicate_share", "latency_p95"}


def gate_failures(bars: list[tuple[str, str, float]] = GATE) -> Column:
    """The metrics of a summary row that miss their bars."""
    return F.array_compact(F.array(*(F.when(F.col(m) < b if way == "min" else F.col(m) > b, F.lit(m)) for m, way, b in bars)))


def threshold_failures(metrics: DataFrame, level: str = "target") -> DataFrame:
    """(metric, value, bar): metrics (metric, value) that miss the bar of a level."""
    spark = metrics.sparkSession
    bars = spark.createDataFrame([(m, float(b), m in LOWER_IS_BETTER) for m, b in PROJECT_BARS[level].items()], "metric string, bar double, lower boolean")
    missed = F.when(F.col("lower"), F.col("value") > F.col("bar")).otherwise(F.col("value") < F.col("bar"))
    return metrics.join(F.broadcast(bars), "metric").filter(missed).select("metric", "value", "bar")


def graded_relevance(results: DataFrame, targets: DataFrame, key: str = "scenario") -> DataFrame:
    """(key, rank, rel): the best score of each result over its scenario's targets: 0.55 for the path, 0.25 for the symbol (0.2
    where none is asked), 0.2 for the lines (0.05), 1 for a full match. ``targets``: path, symbol, kind, first, last, strict."""
    r, t = results.alias("r"), targets.alias("t")
    joined = r.join(t, F.col(f"r.{key}") == F.col(f"t.{key}"), "left")
    path = T.paths_match(F.col("r.path"), F.col("t.path"))
    same = F.col("t.symbol").isNull() | F.col("r.symbol").eqNullSafe(F.col("t.symbol"))
    kind = F.col("t.kind").isNull() | F.col("r.kind").eqNullSafe(F.col("t.kind"))
    lines = F.when(F.col("t.first").isNull(), True).when(F.col("r.first").isNull(), False).when(F.col("t.strict"), (F.col("r.first") == F.col("t.first")) & (F.col("r.last") == F.col("t.last"))).otherwise((F.col("r.first") <= F.col("t.last")) & (F.col("r.last") >= F.col("t.first")))
    score = 0.55 + F.when(F.col("t.symbol").isNull(), 0.2).when(same, 0.25).otherwise(0.0) + F.when(F.col("t.first").isNull(), 0.05).when(lines, 0.2).otherwise(0.0)
    score = F.when(same & kind & lines, 1.0).otherwise(F.least(score, F.lit(1.0)))
    return joined.groupBy(F.col(f"r.{key}").alias(key), F.col("r.rank").alias("rank")).agg(F.max(F.when(path, score).otherwise(0.0)).alias("rel"))


def evaluate_scenarios(scenarios: DataFrame, targets: DataFrame, forbidden: DataFrame, results: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per scenario (scenario, mode, min_hits): success, path_hit, symbol_hit, line_hit, contamination, hits, first_rank, mrr, ndcg, quality, answered and latency_ms. ``targets``: see
    ``graded_relevance``; ``forbidden``: scenario, path, symbol; ``results``: scenario, rank, path, symbol, kind, first, last; ``responses``: scenario, latency_ms. The mode is must_find (also where
    it is null), must_avoid or mixed. A hit is null where it doesn't apply: without targets, and where results are only to be avoided."""
    known = lambda c: F.coalesce(c, F.lit(False))
    graded = graded_relevance(results, targets)
    found = graded.filter("rel > 0").groupBy("scenario").agg(F.count("*").alias("hits"), F.min("rank").alias("first_rank"))
    r, t = results.alias("r"), targets.withColumn("_target", F.monotonically_increasing_id()).alias("t")
    near = t.join(r, F.col("r.scenario") == F.col("t.scenario"), "left")
    path = known(T.paths_match(F.col("r.path"), F.col("t.path")))
    symbol = path & F.col("r.symbol").eqNullSafe(F.col("t.symbol"))
    same = (F.col("t.symbol").isNull() | F.col("r.symbol").eqNullSafe(F.col("t.symbol"))) & (F.col("t.kind").isNull() | F.col("r.kind").eqNullSafe(F.col("t.kind")))
    lines = known(F.when(F.col("t.strict"), (F.col("r.first") == F.col("t.first")) & (F.col("r.last") == F.col("t.last"))).otherwise((F.col("r.first") <= F.col("t.last")) & (F.col("r.last") >= F.col("t.first"))))
    each = near.groupBy(F.col("t.scenario").alias("scenario"), "t._target", F.col("t.symbol").alias("symbol"), F.col("t.first").alias("first")).agg(F.bool_or(path).alias("p"), F.bool_or(symbol).alias("s"), F.bool_or(path & same & lines).alias("l"))
    # What a target doesn't ask for counts as its scenario's wider hit.
    some = each.groupBy("scenario").agg(F.bool_or("p").alias("path_hit"), F.bool_or(F.when(F.col("symbol").isNotNull(), F.col("s"))).alias("_s"), F.bool_or(F.col("symbol").isNull()).alias("_any_symbol"), F.bool_or(F.when(F.col("first").isNotNull(), F.col("l"))).alias("_l"), F.bool_or(F.col("first").isNull()).alias("_any_line"))
    some = some.withColumn("symbol_hit", known(F.col("_s")) | (F.col("_any_symbol") & F.col("path_hit")))
    some = some.withColumn("line_hit", known(F.col("_l")) | (F.col("_any_line") & F.col("symbol_hit"))).select("scenario", "path_hit", "symbol_hit", "line_hit")
    f = forbidden.select("scenario", F.col("path").alias("_path"), F.col("symbol").alias("_symbol"))
    bad = results.join(f, "scenario").filter(T.paths_match(F.col("path"), F.col("_path")) & (F.col("_symbol").isNull() | F.col("symbol").eqNullSafe(F.col("_symbol")))).select("scenario").distinct().withColumn("contamination", F.lit(True))
    rows = scenarios.withColumn("mode", F.coalesce("mode", F.lit("must_find")))
    for side in (found, ndcg_retrieved(graded, "scenario"), some, bad, responses.select("scenario", "latency_ms", F.lit(True).alias("answered"))):
        rows = rows.join(side, "scenario", "left")
    avoid, clean = F.col("mode") == "must_avoid", ~known(F.col("contamination"))
    rows = rows.withColumns({"contamination": ~clean, "hits": F.coalesce("hits", F.lit(0)), "ndcg": F.coalesce("ndcg", F.lit(0.0)), "mrr": F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), "first_rank": F.coalesce("first_rank", F.lit(0)), "answered": known(F.col("answered")), "latency_ms": F.coalesce("latency_ms", F.lit(0.0))})
    rows = rows.withColumns({c: F.when(~avoid, F.col(c)) for c in ("path_hit", "symbol_hit", "line_hit")})
    rows = rows.withColumn("success", clean & (avoid | (F.col("hits") >= F.coalesce("min_hits", F.lit(1)))))
    quality = scenario_quality(F.col("success"), F.col("path_hit"), F.col("symbol_hit"), F.col("line_hit"), F.col("mrr"), F.col("ndcg"), F.col("contamination"), avoid)
    return rows.select("scenario", "mode", "success", "path_hit", "symbol_hit", "line_hit", "contamination", "hits", "first_rank", "mrr", "ndcg", quality.alias("quality"), "answered", "latency_ms")


def variant_metrics(evaluated: DataFrame, *by: str) -> DataFrame:
    """One row of rates, means and latencies of evaluated scenarios, for each group; rates of hits are over the scenarios to which they apply. Latencies at half and at 95 of a hundred are those of
    rank floor((n - 1) p), found by counts of equal values rather than by a list of all."""
    rates = {"exact_path": "path_hit", "exact_symbol": "symbol_hit", "exact_line": "line_hit"}
    n, none = F.count("*"), F.lit(0.0)
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c), n), none)
    out = evaluated.groupBy(*by).agg(
        n.alias("scenarios"), share("success").alias("success_rate"), *(F.coalesce(F.try_divide(F.count_if(c), F.count(c)), none).alias(f"{name}_rate") for name, c in rates.items()), share("contamination").alias("contamination_rate"),
        *(F.coalesce(F.avg(c), none).alias(c) for c in ("mrr", "ndcg", "quality")),
    )
    counts = evaluated.groupBy(*by, "latency_ms").agg(n.alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    up = F.sum("_n").over(group.orderBy("latency_ms"))
    ranked = counts.withColumns({"_up": up, "_all": F.sum("_n").over(group)})
    at = lambda p: F.min(F.when(F.col("_up") > F.floor((F.col("_all") - 1) * p), F.col("latency_ms")))
    latency = ranked.groupBy(*by).agg(at(0.5).alias("latency_p50"), at(0.95).alias("latency_p95"))
    return out.join(latency, list(by)) if by else out.crossJoin(F.broadcast(latency))


def scenario_quality(success: Column, path: Column, symbol: Column, line: Column, mrr: Column, ndcg: Column, contaminated: Column, avoid: Column) -> Column:
    """The quality score of a scenario; one that only has to avoid results is judged on staying clean."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    find = one(success) * 0.3 + one(path) * 0.2 + one(symbol) * 0.15 + one(line) * 0.1 + mrr * 0.15 + ndcg * 0.15 - one(contaminated) * 0.3
    return S.clamp(F.when(avoid, one(success) * 0.7 + (1 - one(contaminated)) * 0.3).otherwise(find))


def null_aware_rate(c: Column | str) -> Column:
    """True over known values; 0 without any."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) > 0, F.count_if(c) / F.count(c)).otherwise(0.0)


def regressions(baselines: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(metric, previous, current, change_percent, direction) of each metric's last two values (metric, captured_at, value)."""
    w = Window.partitionBy("metric").orderBy("captured_at")
    last = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("captured_at")))
    rows = baselines.withColumn("previous", F.lag("value").over(w)).withColumn("_n", last).filter("_n = 1")
    change = S.percent_change(F.coalesce("previous", F.lit(0.0)), F.col("value"))
    worse = F.when(F.col("metric").contains("latency"), change > threshold * 100).otherwise(change < -threshold * 100)
    better = F.when(F.col("metric").contains("latency"), change < -threshold * 100).otherwise(change > threshold * 100)
    return rows.select("metric", F.coalesce("previous", F.lit(0.0)).alias("previous"), F.col("value").alias("current"), change.alias("change_percent"), F.when(worse, "regression").when(better, "improvement").otherwise("unchanged").alias("direction"))


def drift(current: DataFrame, baseline: DataFrame, threshold: float = 10.0) -> DataFrame:
    """(metric, current, baseline, delta_percent, alert): metrics that fell by more than the threshold give an alert."""
    both = current.join(baseline.withColumnRenamed("value", "baseline"), "metric")
    delta = (F.col("value") - F.col("baseline")) / F.col("baseline") * 100
    return both.select("metric", F.col("value").alias("current"), "baseline", delta.alias("delta_percent"), (delta < -threshold).alias("alert"))


def proxy_metrics(samples: DataFrame) -> DataFrame:
    """(metric, value) estimated from live samples: top score over fixed ceilings, mean latency in seconds."""
    top = F.coalesce(F.avg("top_score"), F.lit(0.0))
    proxy = lambda ceiling: F.when(top > 0, F.least(F.lit(1.0), top / ceiling)).otherwise(0.5)
    wide = samples.agg(proxy(100).alias("hit_rate"), proxy(50).alias("ndcg"), proxy(30).alias("mrr"), (F.coalesce(F.avg("latency_ms"), F.lit(0.0)) / 1000).alias("latency_p95"))
    return wide.unpivot([], ["hit_rate", "ndcg", "mrr", "latency_p95"], "metric", "value")


GLYPHS = "▁▂▃▄▅▆▇█"


def sparkline(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, line, trend) of short series: a glyph for each value between the least and the largest. A series is a metric's history."""
    w = Window.partitionBy(key)
    low, span = F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)
    glyph = F.when(span == 0, F.lit("─")).otherwise(F.substring(F.lit(GLYPHS), (F.floor((F.col(value) - low) / span * (len(GLYPHS) - 1)) + 1).cast("int"), F.lit(1)))
    rows = series.withColumn("_g", F.when(F.count("*").over(w) == 1, "●").otherwise(glyph))
    out = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_g"))), lambda x: x["_g"]), "").alias("line"), F.min_by(value, order).alias("_a"), F.max_by(value, order).alias("_b"), F.count("*").alias("_n"))
    change = (F.col("_b") - F.col("_a")) / F.col("_a") * 100
    return out.select(key, "line", F.when((F.col("_n") < 2) | (F.abs(change) < 1), "flat").when(change > 0, "up").otherwise("down").alias("trend"))


def rerank_effect(before: DataFrame, after: DataFrame, least: float = 0.1) -> DataFrame:
    """How many queries (key, paths) changed their results, and whether reranking looks ineffective."""
    both = before.select("key", F.col("paths").alias("a")).join(after.select("key", F.col("paths").alias("b")), "key")
    out = both.agg(F.count("*").alias("queries"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
    rate = F.when(F.col("queries") > 0, F.col("changed") / F.col("queries")).otherwise(0.0)
    return out.withColumn("changed_rate", rate).withColumn("ineffective", F.col("changed_rate") <= least)


def mode_divergence(modes: DataFrame, severe: float = 0.1) -> DataFrame:
    """(mode, hit_rate, drop, severe): how far each mode stays behind the best."""
    best = modes.agg(F.max("hit_rate").alias("best"))
    return modes.crossJoin(F.broadcast(best)).select("mode", "hit_rate", (F.col("best") - F.col("hit_rate")).alias("drop"), (F.col("best") - F.col("hit_rate") > severe).alias("severe"))


def spearman(pairs: DataFrame, key: str, a: str, b: str, order: str) -> DataFrame:
    """(key, rho): rank correlation within each key, ties ranked by ``order``."""
    rank = lambda c: F.row_number().over(Window.partitionBy(key).orderBy(F.desc(c), order))
    ranked = pairs.withColumn("_d", (rank(a) - rank(b)).cast("double"))
    sums = ranked.groupBy(key).agg(F.sum(F.col("_d") * F.col("_d")).alias("s"), F.count("*").alias("n"))
    return sums.select(key, F.when(F.col("n") < 2, 1.0).otherwise(1 - 6 * F.col("s") / (F.col("n") * (F.col("n") * F.col("n") - 1))).alias("rho"))


def latency_summary(calls: DataFrame, key: str, value: str, ok: str, timeout: str) -> DataFrame:
    """Calls, outcomes and nearest-rank percentiles by key."""
    return calls.groupBy(key).agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~F.col(ok)).alias("errors"), F.count_if(timeout).alias("timeouts"), *(S.percentile_nearest(value, p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)), F.min(value).alias("least"), F.max(value).alias("most"))


def required_gates(changed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(gate): gates whose pattern matches a changed path."""
    hits = reduce(lambda a, b: F.concat(a, b), (F.when(F.col("path").rlike(p), F.array(F.lit(g))).otherwise(F.array().cast("array<string>")) for p, g in rules))
    return changed.select(F.explode(hits).alias("gate")).distinct()


def golden_group(tags: Column | str, category: Column | str) -> Column:
    """The group of a scenario, by its tags and category."""
    has = lambda *names: F.exists(tags, lambda t: t.isin(*names)) | (F.col(category) if isinstance(category, str) else category).isin(*names)
    return F.when(has("security", "secret"), "security").when(has("graph", "relation"), "graph").when(has("symbol", "definition"), "symbol").when(has("limit", "edge"), "limits").otherwise("general")
