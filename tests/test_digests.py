"""Hash trees and bounded samples against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

from lodestone.operators import corpus, digests

SHA = lambda x: hashlib.sha256(x.encode()).hexdigest()


def plain_tree(rows):
    """The digest of (key, value) rows, level by level."""
    text = lambda v: "-" if v is None else "=" + v
    level = defaultdict(list)
    for (k, v), n in Counter(rows).items():
        level[SHA(text(k))[:6]].append(SHA(SHA(text(k) + "\x1f" + text(v)) + "\x1f" + str(n)))
    level = {node: SHA("".join(sorted(parts))) for node, parts in level.items()}
    for digits in (4, 2, 0):
        above = defaultdict(list)
        for node, d in level.items():
            above[node[:digits]].append(node + d)
        level = {node: SHA("".join(sorted(parts))) for node, parts in above.items()}
    return level.get("", SHA(""))


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "path string, hash string").repartition(parts)


def test_trees_equal_plain_ones_however_rows_are_dealt(spark):
    rnd = random.Random(1)
    rows = [(f"a/{rnd.randint(0, 300)}", rnd.choice(["x", "y", None])) for _ in range(500)] + [(None, "x"), ("", ""), ("", None)] + [("same", "row")] * 50
    digest = lambda r, parts=3: digests.tree_digest(frame(spark, r, parts), "path", "hash").first()[0]
    assert digest(rows) == digest(rows, 11) == digest(rows[::-1], 1) == plain_tree(rows)
    assert digest([]) == SHA("")
    seen = {plain_tree(rows)}
    for k in (0, 250, len(rows) - 1):  # any change of one row changes it
        for changed in (rows[:k] + rows[k + 1 :], rows[:k] + [(rows[k][0], "z")] + rows[k + 1 :], rows + [rows[k]]):
            seen.add(plain_tree(changed))
    assert digest(rows[1:]) in seen and len(seen) == 10


def test_plans_are_bound_by_everything(spark):
    tracked, now = frame(spark, [("a", "1"), ("b", "2")]), frame(spark, [("a", "1"), ("c", "3")])
    none = spark.createDataFrame([], "path string, reason string")
    issues = spark.createDataFrame([], "code string, path string, fatal boolean")
    scope, rules, allow = spark.createDataFrame([("src",)], "path string"), spark.createDataFrame([("*.log",)], "rule string"), spark.createDataFrame([("src/x", "tmp")], "path string, category string")
    plan = lambda *a, **k: corpus.preflight(spark, *a, **k).first()
    first = plan(now, tracked, none, issues, root="r", scope=scope, rules=rules, allow=allow)
    others = [
        plan(now, tracked, none, issues, root="s", scope=scope, rules=rules, allow=allow), plan(now, tracked, none, issues, root="r", rules=rules, allow=allow), plan(now, tracked, none, issues, root="r", scope=scope, allow=allow),
        plan(now, tracked, none, issues, root="r", scope=scope, rules=rules), plan(frame(spark, [("a", "1"), ("c", "4")]), tracked, none, issues, root="r", scope=scope, rules=rules, allow=allow), plan(now, frame(spark, [("a", "1"), ("b", "5")]), none, issues, root="r", scope=scope, rules=rules, allow=allow),
    ]
    assert len({r.plan_hash for r in (first, *others)}) == 7 and first.plan_hash == plan(now, tracked, none, issues, root="r", scope=scope, rules=rules, allow=allow).plan_hash
    names = ["root_hash", "scope_hash", "policy_hash", "policy_hash", "inventory_hash", "baseline_hash"]
    assert all(other[n] != first[n] for other, n in zip(others, names, strict=True))


def test_samples_are_the_least_and_bounded(spark):
    rnd = random.Random(4)
    rows = [(f"p{rnd.randint(0, 99):02d}", rnd.choice(["a", "b", None])) for _ in range(900)] + [("only", "c"), (None, "c")]
    found = {r.hash: (r["count"], r.sample) for r in digests.bounded_samples(frame(spark, rows, 9), "hash", "path", 5).collect()}
    for category in ("a", "b", None, "c"):
        own = [p for p, c in rows if c == category]
        assert found[category] == (len(own), sorted({p for p in own if p is not None})[:5])
    allow = spark.createDataFrame([("p01", "a"), ("nowhere", "a")], "path string, category string")
    findings = frame(spark, [(p, c) for p, c in rows if c]).withColumnRenamed("hash", "category")
    states = {(r.category, r.state): (r["count"], r.sample) for r in digests.blocked_findings(findings, allow, 3, most=100).collect()}
    assert states["a", "suppressed"][1] == ["p01"] and states["a", "not encountered"] == (1, ["nowhere"]) and "p01" not in states["a", "blocked"][1] and states["b", "blocked"][0] == 100


def test_folder_ends(spark):
    assert corpus.manifest_path_problems("a/b.egg-info/c") == ["blocked name"] and corpus.manifest_path_problems("a/egg-info") == []
