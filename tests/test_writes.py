"""Write rules, scenario evaluation and reports on small cases, against plain Python where rules are many."""

import math
import random

from pyspark.sql import functions as F

from lodestone.operators import evaluation, project, writes


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_last_row_of_a_key_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "n"), (None, 3, "m"), (None, 4, "k")], "key string, seq int, v string")
    assert rows_of(writes.last_of(rows, ["key"], "seq")) == [("a", 2, "z"), ("b", None, "n"), (None, 4, "k")]
    old = spark.createDataFrame([("a", 9, "old", "t0"), ("c", 1, "stays", "t1")], "key string, seq int, v string, made string")
    new = rows.filter("key is not null").withColumn("made", F.lit("now"))
    assert rows_of(writes.merged(old, new, ["key"], "seq", keep=("made",))) == [("a", 2, "z", "t0"), ("b", None, "n", "now"), ("c", 1, "stays", "t1")]
    assert rows_of(writes.merged(old, new.limit(0), ["key"], "seq")) == rows_of(old)


def test_sets_of_an_owner_are_replaced(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "owner int, v string")
    new = spark.createDataFrame([(1, "z")], "owner int, v string")
    assert rows_of(writes.replaced(old, new, ["owner"])) == [(1, "z"), (2, "c"), (3, "d")]
    owners = spark.createDataFrame([(1,), (2,)], "owner int")
    assert rows_of(writes.replaced(old, new, ["owner"], owners)) == [(1, "z"), (3, "d")]


def test_rows_that_break_a_rule_are_told(spark):
    rows = spark.createDataFrame([(1, "m", " ", "0" * 64, 1), (2, "m", "t", "short", 1), (3, "m", None, None, 1), (4, "m", "t", "a" * 64, 1), (4, "m", "t", "b" * 64, 2)], "chunk_id int, model string, input_text string, input_hash string, seq int")
    old = spark.createDataFrame([(4, "m", "old", 0), (5, "m", "old", 0)], "chunk_id int, model string, input_hash string, seq int")
    kept, refused = writes.embeddings_merged(old, rows, "seq")
    assert rows_of(kept) == [(4, "m", "b" * 64, 2), (5, "m", "old", 0)]
    assert {r.chunk_id: r.reason for r in refused.collect()} == {1: "empty text", 2: "no hash", 3: "empty text"}


def test_versions_are_made_for_changed_contents_only(spark):
    versions = spark.createDataFrame([(1, 1, "a", "replaced"), (1, 2, "b", "ready"), (2, 1, "a", "failed"), (3, 4, None, "ready")], "file_id int, version int, content_hash string, status string")
    incoming = spark.createDataFrame([(1, "b", 1), (1, "a", 0), (2, "a", 1), (3, "c", 1), (4, "d", 1)], "file_id int, content_hash string, seq int")
    assert rows_of(writes.pending_versions(versions, incoming, "seq")) == [(2, 2, "a", "pending"), (3, 5, "c", "pending"), (4, 1, "d", "pending")]


def test_a_root_has_one_repository(spark):
    old = spark.createDataFrame([("a", "/a", 1, 0), ("b", "/b", 2, 0), ("c", "/c", 3, 0)], "slug string, root string, project_id int, seq int")
    new = spark.createDataFrame([("a", "/b", 0, 1), ("d", "/c", 0, 2), ("c", "/x", 0, 3), ("e", "/n", 0, 5), ("f", "/n", 0, 4), ("b", "/b", 0, 6)], "slug string, root string, project_id int, seq int")
    kept, refused = writes.registered(old, new, "seq")
    assert {r.slug: (r.root, r.project_id) for r in kept.collect()} == {"a": ("/a", 1), "b": ("/b", 2), "c": ("/x", 3), "d": ("/c", 0), "f": ("/n", 0)}
    assert {r.slug for r in refused.collect()} == {"a", "e"}


def plain_scenario(mode, need, targets, forbidden, results):
    """The evaluation of one scenario, result by result."""
    match = lambda r, p: r["path"] == p or r["path"].endswith("/" + p)

    def lines(r, t):
        if t["first"] is None:
            return True
        if r["first"] is None:
            return False
        return (r["first"], r["last"]) == (t["first"], t["last"]) if t["strict"] else r["first"] <= t["last"] and r["last"] >= t["first"]

    def full(r, t):
        return match(r, t["path"]) and (t["symbol"] is None or r["symbol"] == t["symbol"]) and lines(r, t)

    def score(r):
        best = 0
        for t in targets:
            if match(r, t["path"]):
                s = 0.55 + (0.2 if t["symbol"] is None else 0.25 * (r["symbol"] == t["symbol"])) + (0.05 if t["first"] is None else 0.2 * lines(r, t))
                best = max(best, 1 if full(r, t) else min(1, s))
        return best

    scores = [score(r) for r in results]
    first = next((k + 1 for k, s in enumerate(scores) if s > 0), 0)
    hits = sum(s > 0 for s in scores)
    path = any(match(r, t["path"]) for t in targets for r in results) if targets else None
    symbol = any(any(match(r, t["path"]) and r["symbol"] == t["symbol"] for r in results) if t["symbol"] else path for t in targets) if targets else None
    line = any(any(full(r, t) for r in results) if t["first"] is not None else symbol for t in targets) if targets else None
    avoid = mode == "must_avoid"
    path, symbol, line = (None, None, None) if avoid else (path, symbol, line)
    bad = any(match(r, f["path"]) and (f["symbol"] is None or r["symbol"] == f["symbol"]) for f in forbidden for r in results)
    gain = lambda x: sum(s / math.log2(k + 2) for k, s in enumerate(x))
    ndcg = gain(scores[:10]) / gain(sorted(scores[:10], reverse=True)) if any(scores[:10]) else 0
    mrr = 1 / first if first else 0
    success = not bad and (avoid or hits >= (need or 1))
    quality = 0.7 * success + 0.3 * (not bad) if avoid else 0.3 * success + 0.2 * bool(path) + 0.15 * bool(symbol) + 0.1 * bool(line) + 0.15 * mrr + 0.15 * ndcg - 0.3 * bad
    return success, path, symbol, line, bad, hits, first, round(mrr, 6), round(ndcg, 6), round(min(1, max(0, quality)), 6)


def test_scenarios_equal_plain_evaluation(spark):
    rnd = random.Random(2)
    span = lambda: rnd.choice([None, (5, 9), (8, 20)])
    scenarios, targets, forbidden, results, responses, wanted = [], [], [], [], [], {}
    for k in range(60):
        mode, need = rnd.choice([None, "must_find", "must_avoid", "mixed"]), rnd.choice([None, None, 2])
        t, f, r = [], [], []
        for _ in range(rnd.randint(0, 3)):
            a = span()
            t.append({"path": f"f{rnd.randint(0, 5)}.ts", "symbol": rnd.choice([None, "s", "t"]), "first": a and a[0], "last": a and a[1], "strict": rnd.random() < 0.3})
        for _ in range(rnd.randint(0, 2)):
            f.append({"path": f"f{rnd.randint(4, 8)}.ts", "symbol": rnd.choice([None, "s"])})
        for _ in range(rnd.randint(0, 13)):
            a = span()
            r.append({"path": rnd.choice(["", "./", "src/"]) + f"f{rnd.randint(0, 8)}.ts", "symbol": rnd.choice([None, "s", "t"]), "first": a and a[0], "last": a and a[1]})
        scenarios.append((k, mode, need))
        targets += [(k, x["path"], x["symbol"], None, x["first"], x["last"], x["strict"]) for x in t]
        forbidden += [(k, x["path"], x["symbol"]) for x in f]
        results += [(k, n + 1, x["path"], x["symbol"], None, x["first"], x["last"]) for n, x in enumerate(r)]
        if k % 7:
            responses.append((k, float(k)))
        plain = [x | {"path": x["path"].removeprefix("./")} for x in r]
        wanted[k] = plain_scenario(mode, need, t, f, plain)
    found = evaluation.evaluate_scenarios(
        spark.createDataFrame(scenarios, "scenario int, mode string, min_hits int"), spark.createDataFrame(targets, "scenario int, path string, symbol string, kind string, first int, last int, strict boolean"), spark.createDataFrame(forbidden, "scenario int, path string, symbol string"),
        spark.createDataFrame(results, "scenario int, rank int, path string, symbol string, kind string, first int, last int"), spark.createDataFrame(responses, "scenario int, latency_ms double"),
    ).cache()
    got = {r.scenario: (r.success, r.path_hit, r.symbol_hit, r.line_hit, r.contamination, r.hits, r.first_rank, round(r.mrr, 6), round(r.ndcg, 6), round(r.quality, 6)) for r in found.collect()}
    assert got == wanted
    assert {r.scenario for r in found.filter("not answered").collect()} == {k for k in range(60) if k % 7 == 0}
    total = evaluation.variant_metrics(found).first()
    known = [w[1] for w in wanted.values() if w[1] is not None]
    latencies = sorted(float(k) if k % 7 else 0.0 for k in range(60))
    assert total.scenarios == 60 and abs(total.exact_path_rate - sum(known) / len(known)) < 1e-9 and (total.latency_p50, total.latency_p95) == (latencies[29], latencies[56])
    assert evaluation.variant_metrics(found.limit(0)).first().scenarios == 0


def test_reports_of_nothing_and_of_everything(spark):
    expected = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)], "path string, ignored boolean")
    tracked = spark.createDataFrame([("a", "indexed"), ("b", "blocked"), ("c", "indexed"), ("x", "indexed"), ("y", "deleted")], "path string, status string")
    row = project.scope_coverage(expected, tracked, 1).first()
    assert (row.expected_files, row.missing_expected_files, row.blocked_expected_files, row.extra_indexed_files, row.ignored_expected_files, row.ignored_indexed_files) == (3, 1, 1, 1, 1, 1)
    assert row.missing_expected_files_sample == ["d"] and row.extra_indexed_files_sample == ["x"] and row.scope_status == "drift"
    none = project.scope_coverage(expected.limit(0), tracked.limit(0)).first()
    assert none.scope_status == "covered" and none.expected_files == 0 and none.missing_expected_files_sample == []
    files = "path string, hash string, mtime int, size int"
    indexed = spark.createDataFrame([(p, "h", 1, 1) for p in "abcde"], files)
    disk = spark.createDataFrame([("a", "h", 1, 1), ("b", "h", 2, 1), ("c", "other", 1, 1), ("d", None, None, None)], files)
    row = project.disk_freshness(indexed, disk).first()
    assert (row.fresh_files, row.metadata_drift_files, row.stale_files, row.unverified_files, row.missing_files, row.freshness_status) == (1, 1, 1, 1, 1, "unverified")
    assert project.disk_freshness(indexed.limit(1), disk).first().freshness_status == "fresh"


def test_embeddings_of_owners_are_dealt_by_rows(spark, monkeypatch):
    """A task joins a bounded number of rows, however small they are when they are shuffled; the result is the same."""
    from lodestone.operators import writes

    new = spark.range(2000).selectExpr("1 as project_id", "'chunk' as owner_type", "id % 500 as owner_ref", "'p' as profile_hash", "cast(id % 3 as int) as version", "cast(id as int) as vector")
    old = new.filter("vector < 300").withColumn("vector", -new.vector)
    owners = spark.range(400).selectExpr("id as owner_ref", "cast(id % 3 as int) as candidate_version")
    found = []
    for rows in (1 << 18, 100):
        monkeypatch.setattr(writes, "SPREAD_ROWS", rows)
        kept, refused = writes.owned_embeddings(old, new, owners, "version")
        found.append((sorted(map(tuple, kept.collect())), sorted(map(tuple, refused.collect()))))
        assert rows > 100 or ", 23)" in kept._jdf.queryExecution().executedPlan().toString()
    assert found[0] == found[1] and found[0][0] and found[0][1]
