"""Corpus building and project operators where SQL does not reach."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import api
from lodestone.operators import chunking, corpus, lifecycle, project, retrieval
from lodestone.operators.publication import Conflict
from lodestone.operators.retrieval import cover_density, pick_diverse


def files(spark):
    rows = [("a/one.md", "---\ntitle: One\n---\n# Head\n\nalpha beta gamma. " * 3), ("a/two.md", "# Two\n\nbeta only here"), ("b.md", "")]
    return spark.createDataFrame(rows, "path string, content string")


def test_ingest_publishes_once_and_completion_follows(spark, tmp_path):
    store = lifecycle.GenerationStore(spark, str(tmp_path / "store"))
    assert corpus.ingest(store, files(spark), "src", "g1", "2024-01-01") == 3
    assert corpus.ingest(store, files(spark), "src", "g1", "2024-01-01") == 3
    assert store.serving().count() == 3 and store.pointers().count() == 1
    store.stage(corpus.build_documents(files(spark).limit(2)), "src", "g2")
    seen = store.catalogue.version()
    with pytest.raises(ValueError):
        store.publish("src", "g2", "2024-01-03", 3)
    assert store.serving().count() == 3
    assert store.publish("src", "g2", "2024-01-03", 2, seen) == seen + 1 and store.serving().count() == 2
    store.stage(corpus.build_documents(files(spark).limit(1)), "other", "g1")
    with pytest.raises(Conflict):
        store.publish("other", "g1", "2024-01-03", 1, seen)
    store.publish("other", "g1", "2024-01-03", 1)
    assert store.serving().count() == 3 and store.pointers(seen).count() == 1


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 1), (None, 2), ("c\nd", 3)], "name string, n int")
    corpus.write_report(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    text = corpus.markdown_report("Run", rows, ["n"])
    assert text.split("\n") == ["# Run", "", "| name | n |", "| --- | --- |", r"| a\|b | 1 |", "|  | 2 |", "| c d | 3 |", ""]
    assert "More than 2 rows." in corpus.markdown_report("Run", rows, ["n"], 2)


def test_results_and_manifests_are_bounded():
    assert corpus.result_problem(json.dumps({"a": [1, None, "x", True]})) is None
    assert corpus.result_problem("[" * 9 + "]" * 9) is None and corpus.result_problem("[" * 10 + "]" * 10) == "depth"
    assert corpus.result_problem(json.dumps(["x" * 65600])) == "bytes" and corpus.result_problem("[NaN]") == "not-finite" and corpus.result_problem("[1e999]") == "not-finite"
    assert corpus.result_problem(json.dumps([0] * 511)) is None and corpus.result_problem(json.dumps([0] * 512)) == "items" and corpus.result_problem(None) == "not-json"
    assert corpus.manifest_errors('{"manifestVersion":1,"includeRoots":["src","lib/a"],"ignoreRules":["**/x"]}') == []
    for bad in ('{"manifestVersion":2}', "[]", '{"manifestVersion":1,"includeRoots":["../a"]}', '{"manifestVersion":1,"includeRoots":["con.txt/a"]}', '{"manifestVersion":1,"includeRoots":["a./b"]}', '{"manifestVersion":1,"includeRoots":["c:/x"]}', '{"manifestVersion":1,"includeRoots":[1]}', "x" * 70000):
        assert corpus.manifest_errors(bad), bad


def plain_diverse(keys, limit, share):
    """One place after another over all that are left."""
    left, chosen, repeats = list(range(len(keys))), [], 0
    while left and len(chosen) < max(1, limit):
        taken = {keys[p] for p in chosen}
        free = left if repeats < int(share * (len(chosen) + 1)) else [p for p in left if keys[p] not in taken]
        if not free:
            break
        p = free[0]
        repeats += keys[p] in taken
        chosen.append(p)
        left.remove(p)
    return chosen


def test_diverse_selection_equals_the_plain_one():
    rnd = np.random.default_rng(3)
    for _ in range(400):
        keys = rnd.integers(0, int(rnd.integers(1, 9)), int(rnd.integers(0, 30))).tolist()
        limit, share = int(rnd.integers(0, 20)), float(rnd.choice([0, 0.1, 0.3, 0.5, 1.0]))
        assert pick_diverse(keys, limit, share) == plain_diverse(keys, limit, share)


def test_cover_density_of_several_words():
    """Against every stretch: those that hold all words and no shorter stretch that does."""
    rnd = np.random.default_rng(4)
    for _ in range(200):
        words = [str(w) for w in rnd.choice(list("abcxyz"), int(rnd.integers(0, 14)))]
        wanted = ["a", "b"] if rnd.random() < 0.7 else ["a", "b", "c"]
        at = {w: [i + 1 for i, x in enumerate(words) if x == w] for w in wanted}
        holds = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if set(wanted) <= set(words[i : j + 1])]
        least = [s for s in holds if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in holds)]
        total = sum(0.1 / (1 + sum(w not in wanted for w in words[i : j + 1])) for i, j in least)
        assert cover_density(at, [wanted]) == pytest.approx(total)


def test_text_match_equals_lexeme_match(spark):
    texts = ["The cat_sat on the mat.", "the-cat sat", "cat", "concat sat", "THE  CAT\nsat down", "dog", "", None, "the cat, sat; dog", "sat the cat"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("t", F.lower("t"))
    for query in ("cat", '"the cat"', '"the cat sat" -dog', "cat or dog", "-cat sat", '"cat sat" or "sat the"', ""):
        wanted = {r.i for r in rows.filter(retrieval.matches_websearch(retrieval.lexemes("t"), query)).collect()}
        assert {r.i for r in rows.filter(retrieval.matches_text("t", query)).collect()} == wanted, query


def test_chunk_text_and_lines():
    text = "".join(f"line {i}\n" for i in range(300))
    assert chunking.chunk_text(text, 200, 20) and all(len(c) <= 200 for c in chunking.chunk_text(text, 200, 20))
    assert chunking.chunk_text(text, chunking.PROFILES["semantic"]) == chunking.chunk(text, chunking.PROFILES["semantic"])
    parts = ["line 0\nline 1", "line 5", "absent", "", "line 3"]
    assert chunking.line_ranges(text, parts) == [(1, 2), (6, 6), (None, None), (None, None), (31, 31)]


def test_project_search_falls_back(spark):
    rows = [(i, i, 1, 0, 1, 9, f"needle {i} hay" if i < 3 else "hay", "", f"f{i}", "function", None) for i in range(6)]
    chunks = spark.createDataFrame(rows, "chunk_id int, file_id int, version_id int, chunk_index int, start_line int, end_line int, content string, searchable_text string, symbol_name string, symbol_kind string, symbol_signature string")
    build = spark.createDataFrame([(i, 1, f"src/{i}.ts") for i in range(6) if i != 1] + [(1, 2, "src/1.ts")], "file_id int, version_id int, source_path string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)], "m") for i in range(6)], "chunk_id int, embedding array<double>, model string")
    p = api.Project(files(spark), chunks, build, vectors)
    found = p.search("needle", query_vector=[0.0, 1.0])
    assert found.fallback is None and [r.source_path for r in found.results.collect()][:1] and found.results.count() == 5
    lexical = p.search("needle", 1, mode="keyword", active="src/2.ts")
    assert lexical.fallback == "embedding_unavailable" and len(lexical.warnings) == 2 and lexical.lanes == [("hybrid", "skipped"), ("lexical", "executed")]
    empty = project.search_with_fallback(chunks, build, "needle", 5, vectors, [0.0, 1.0], {"model": "other"})
    assert {r.source_path for r in empty.results.collect()} == {"src/0.ts", "src/2.ts"}
    nothing = project.search_with_fallback(chunks, build, "absent", 5, vectors, [0.0, 1.0], {"model": "other"})
    assert nothing.fallback == "hybrid_empty" and nothing.results.count() == 0
    assert sum(len(r.content) for r in p.search("needle", most_characters=9).results.collect()) <= 9
    with pytest.raises(ValueError):
        api.Project(files(spark)).search("x")


def test_docs_search_filters_and_provenance(spark):
    rows = [(i, "s", f"d/{i % 3}.md", f"T{i % 3}", i, "alpha beta" if i % 2 else "beta", True, "Head", "Sec") for i in range(9)]
    chunks = spark.createDataFrame(rows, "chunk_id int, source_id string, source_path string, title string, chunk_index int, content string, enabled boolean, heading string, section string")
    documents = spark.createDataFrame([("d/0.md", "s", "T0", "cat", "md", "en", "official", "", "alpha alpha", ["x"], "http://a", "r1", "2024"), ("d/1.md", "s", "T1", "cat", "md", "de", None, "", "x", ["y"], None, "r1", None)], "source_path string, source_id string, title string, category string, kind string, language string, authority string, searchable_text string, content string, tags array<string>, canonical_url string, source_revision string, synced_at string")
    docs = api.Docs(chunks, documents=documents)
    found = docs.search("alpha", 5).collect()
    assert found[0].source_path == "d/0.md" and found[0].provenance_status == "complete" and {r.provenance_status for r in found} == {"complete", "degraded"}
    assert {r.source_path for r in docs.search("beta", 5, language="de").collect()} == {"d/1.md"}
    assert docs.search("head sec", 5).count() > 0
    with pytest.raises(ValueError):
        docs.search("x", nothing=1)


def test_clusters_by_cosine(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, (np.eye(4)[i % 3] * 5 + rnd.standard_normal(4) * 0.1).tolist()) for i in range(90)] + [(90, [0.0] * 4)]
    found = {r.id: r.cluster for r in project.clusters(spark.createDataFrame(rows, "id int, embedding array<double>"), 3, key="id").collect()}
    assert len(found) == 90 and all(found[i] == found[i % 3] for i in range(90)) and len(set(found.values())) == 3


def test_reviews_that_may_not_count(spark):
    wrong = spark.sql("select 'a' as r, 'a' as o, 5 as e union all select 'a', 'b', 1 union all select 'a', 'b', 9")
    assert sorted(str(r[0]) for r in wrong.select(corpus.review_allowed("r", "o", "e", F.lit(3))).collect()) == ["None", "expired", "self-approval"]


def test_plans_without_evidence_delete_nothing(spark):
    tracked = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    now, none = tracked.limit(1), spark.createDataFrame([], "path string, reason string")
    issues = spark.createDataFrame([], "code string, path string, fatal boolean")
    blind, seen = (corpus.preflight(spark, now, tracked, none, x).first() for x in (None, issues))
    assert not blind.deletion_allowed and seen.deletion_allowed and seen.deletes == 1 and blind.plan_hash != seen.plan_hash
    assert corpus.preflight(spark, now, tracked, none, issues, force=True).first().updates == 1


def test_own_patterns_replace_the_fixed_ones(spark):
    from lodestone.operators import quality

    assert quality.sensitive_names(" , (") == quality.sensitive_names()
    rows = spark.createDataFrame([("a/.env",), ("a/x.abc",), ("a/ok.ts",)], "p string")
    assert [r[0] for r in rows.select(quality.path_security("p", F.lit(""), r"\.abc$")).collect()] == [None, "own-0", None]
    assert [r[0] for r in rows.select(quality.path_security("p", F.lit(""))).collect()] == ["dot-env", None, None]


def test_hashed_embeddings_equal_the_plain_ones():
    def fnv(word):
        h = 2166136261
        for b in word.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    texts = ["Alpha beta, alpha_gamma 12", None, "", "é é É ß", "one", "x" * 300 + " y"]
    found = retrieval.embedded(texts, 16)
    for text, row in zip(texts, found, strict=True):
        words = __import__("re").findall(r"[^\W_]+", (text or "").lower())
        plain = np.zeros(16)
        for feature in (*words, *map(" ".join, zip(words, words[1:], strict=False))):
            plain[fnv(feature) % 16] += 1 if fnv(feature) >> 31 else -1
        norm = np.linalg.norm(plain)
        assert np.allclose(row, plain / norm if norm else plain, atol=1e-6)
    assert retrieval.embedded([None, ""], 4).tolist() == [[0.0] * 4] * 2
