"""Operators that SQL can't express, on small fixtures."""

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import api, io
from lodestone.functions import patterns as P
from lodestone.functions import text as T
from lodestone.operators import chunking, code, lifecycle, quality, relational, retrieval
from lodestone.sources import files
from lodestone.streaming import limits

SF = "/root/testdata/sf0.001"


def test_recursive_split_keeps_text_and_size():
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(40)) for i in range(9))
    parts = chunking.recursive_split(text, 200, 20, chunking.PLAIN)
    assert all(len(p) <= 200 for p in parts)
    assert set(" ".join(parts).split()) == set(text.split())
    assert chunking.recursive_split("a" * 25, 10, 2, chunking.PLAIN) == ["a" * 10, "a" * 10, "a" * 9]
    assert chunking.recursive_split("", 10, 2, chunking.PLAIN) == []


def test_profiles():
    code_text = "class A {}\nfunction f() {}\nconst x = 1\nlet y = 2\n"
    assert chunking.detect_profile(code_text) == "structure"
    assert chunking.detect_profile("# A\ntext\n## B\ntext") == "semantic"
    assert chunking.detect_profile("only prose") == "fixed"
    found = chunking.chunk("intro\n# One\nbody\n## Two\nmore", chunking.PROFILES["canonical"])
    assert found == ["intro", "# One\nbody", "## Two\nmore"]
    fenced = "a\n```\n" + "x = 1\n" * 20 + "```\nb"
    assert any(c.count("```") == 2 for c in chunking.chunk(fenced, chunking.PROFILES["structure"]))
    assert chunking.line_ranges("a\nb\nc\nb", ["b", "c", "b", "zz"]) == [(2, 2), (3, 3), (4, 4), (None, None)]
    assert chunking.header("t", "p", "s") == "[t] > [p] > [s]"


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "# H\nfirst\n## K\nsecond", "T"), (2, None, "U")], "id int, text string, title string")
    rows = chunking.chunks(docs, "id", "text", "canonical", title="title").orderBy("chunk_index").collect()
    assert [(r.id, r.section, r.start_line, r.end_line) for r in rows] == [(1, "H", 1, 2), (1, "K", 3, 4)]
    assert rows[0].searchable_text.startswith("[T] > [H] # H") and rows[1].searchable_text.startswith("[T] ## K")


def test_validators():
    assert quality.valid_cpf("529.982.247-25") and not quality.valid_cpf("529.982.247-26") and not quality.valid_cpf("111.111.111-11")
    assert quality.valid_cnpj("11.222.333/0001-81") and not quality.valid_cnpj("11.222.333/0001-80")
    assert quality.valid_ssn("123-45-6789") and not any(map(quality.valid_ssn, ("000-45-6789", "666-45-6789", "900-45-6789", "123-00-6789", "123-45-0000")))
    assert quality.valid_card("4111 1111 1111 1111") and not quality.valid_card("4111 1111 1111 1112")


def test_personal_data():
    text = "mail a@b.org, card 4111 1111 1111 1111, ssn 123-45-6789"
    assert [m[0] for m in quality.personal_matches(text)] == ["email", "credit_card", "ssn"]
    assert quality.redact_personal(text) == "mail [EMAIL], card [CREDIT_CARD], ssn [SSN]"
    first_fails = "000-45-6789 and 123-45-6789"
    assert not quality.has_personal(first_fails) and quality.has_personal(first_fails, compatible=False)
    assert not quality.has_personal("nothing here")


def test_redaction_keeps_what_stands_around(spark):
    rows = [
        ("t ghp_" + "a" * 36 + " e", "t [REDACTED:github-pat] e", 1),
        ('password = "hunter2hunter2"', 'password = "[REDACTED:password-in-code]"', 1),
        ("postgresql://u:s3cret@h/db", "postgresql://u:[REDACTED:database-url-password]@h/db", 1),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\ndef\n-----END RSA PRIVATE KEY-----!", "[REDACTED:private-key]\n\n\n!", 1),
        ("plain", "plain", 0),
    ]
    text, count, ids = quality.redacted("a")
    found = spark.createDataFrame([(r[0],) for r in rows], "a string").select("a", text.alias("t"), count.alias("n"), ids.alias("i")).collect()
    assert [(r.a, r.t, r.n) for r in found] == rows
    assert found[0].i == ["github-pat"] and found[4].i == []


def test_quality_reasons(spark):
    rows = {"": ["empty"], " \n": ["empty"], "short": ["non-semantic"], "long enough text with many letters\x07": ["control-character"], '--8<-- "x.md"': ["include-only", "non-semantic"], ".. include:: a_long_file_name_here.rst\n": ["include-only"], '{"Redirect": "https://example.org/elsewhere"}': ["redirect-only", "non-semantic"], "a text of more than sixteen letters": []}
    found = spark.createDataFrame([(k,) for k in rows], "a string").select("a", quality.quality_reasons("a").alias("r")).collect()
    assert {r.a: r.r for r in found} == rows


def test_cleaning():
    text = "import X from 'y'\r\n# T\nThis section explains things.\n```\nimport kept\n```\n<Card />\n\n\n\n- This page is about lists\nend"
    assert quality.clean_lines(text) == "# T\n```\nimport kept\n```\n\n- This page is about lists\nend"


def test_cover_density():
    assert retrieval.cover_density({"a": [1], "b": [2]}, [["a", "b"]]) == pytest.approx(0.1)
    assert retrieval.cover_density({"a": [1], "b": [4]}, [["a", "b"]]) == pytest.approx(0.1 / 3)
    assert retrieval.cover_density({"a": [1, 10], "b": [2, 11]}, [["a", "b"]]) == pytest.approx(0.1 + 0.1 / 8 + 0.1)
    assert retrieval.cover_density({"a": [1, 5]}, [["a"]]) == pytest.approx(0.2)
    assert retrieval.cover_density({"a": [1]}, [["a", "b"]]) == 0
    assert retrieval.parse_websearch('the "red fox" -dog or cat') == [[(False, ["the"]), (False, ["red", "fox"]), (True, ["dog"])], [(False, ["cat"])]]


def test_diversity():
    keys = ["a", "a", "a", "b", "c", "a"]
    assert retrieval.pick_diverse(keys, 4, 0.3) == [0, 3, 4, 1]
    assert retrieval.pick_diverse(["a", "a"], 5, 0.0) == [0]
    assert retrieval.pick_diverse(keys, 3, 1.0) == [0, 1, 2]


def test_hyperplane_buckets_find_neighbours(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(200)
    found = retrieval.hyperplane_buckets(e, 4, 6, key="vec_id")
    assert found.count() == 200 * 6
    pairs = found.join(found.withColumnRenamed("vec_id", "other"), ["table", "bucket"]).filter("vec_id = other").count()
    assert pairs == 1200


def test_limits_and_plans():
    assert retrieval.limits(5, True) == {"k": 5, "candidates": 50, "global_vector": 20, "results": 20}
    assert retrieval.limits(99, False)["candidates"] == 2500
    assert retrieval.plan_for(None, False) == (False, True) and retrieval.plan_for("vector", True) == (True, False)
    with pytest.raises(ValueError):
        retrieval.plan_for("vector", False)
    assert retrieval.query_identifiers("open fooBar in src/a_b.ts now") == ["foobar", "srcabts"]


def test_symbols_and_edges():
    text = "import { a, b as c } from './x'\nexport async function run(q) {\n  if (q) { helper(q) }\n}\ninterface I {\n}\nconst v = 1\n"
    assert code.symbols_of(text, "ts") == [("run", "function", 2, 4, True), ("I", "interface", 5, 6, False), ("v", "function", 7, 7, False)]
    assert {(r, n) for r, n, _ in code.edges_of(text)} >= {("IMPORTS", "./x"), ("IMPORTS", "a"), ("IMPORTS", "b"), ("CALLS", "helper")}
    assert code.symbols_of("def f():\n  pass\nclass K:\n", "py") == [("f", "function", 1, 1, True), ("K", "class", 3, 3, True)]


def test_large_code_joins_are_not_broadcast(spark):
    """Sides that grow with the files are shuffled, whatever Catalyst takes them for; narrow rows are dealt to many tasks before they become files."""
    from lodestone.plans import content

    for name in ("code_navigation", "code_test_coverage", "code_parse_quality", "code_skeleton"):
        plan = content.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert io.dealt(spark.range(100), "id", 10).rdd.getNumPartitions() == 10


def test_texts_are_prepared_in_bounded_slices(spark):
    """Neither personal data nor cleaning holds a whole Arrow batch as Python values, and the slices change no result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("a.md").alias("path")).unionByName(spark.sql("select cast(-1 as bigint) as doc_id, cast(null as string) as text, cast(null as string) as path"))
    for made in (quality.with_personal(docs), quality.with_prepared(docs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    found = quality.with_prepared(docs).withColumn("whole", quality.prepared("text", F.coalesce("path", F.lit("a.md"))))
    assert found.filter(~F.col("clean").eqNullSafe(F.col("whole"))).count() == 0 and found.count() == docs.count()
    one = {r.doc_id: r for r in quality.with_personal(docs).collect()}
    assert one[-1].redacted == "" and one[-1].personal == [] and not one[-1].flagged
    assert all(r.redacted == quality.redact_personal(r.text or "") for r in one.values())


def test_generated_files_are_dealt_before_they_are_read(spark):
    """A few megabytes of parts are many files: they are scanned in as many tasks as their rows ask for, not in the one that reads them."""
    from lodestone.plans import code as files_plans
    from lodestone.plans import content

    for query in (files_plans.QUERIES["code_definitions"], files_plans.QUERIES["code_chunks"], content.QUERIES["code_parse_quality"]):
        assert "REPARTITION_BY_NUM" in query(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_parse_quality_deals_files_and_symbols_by_path(spark):
    """Lines of symbols are counted where a bounded number of files was dealt to; overlaps count once, and symbols of no file or without lines change nothing else."""
    files = spark.range(20_000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit("a\nb\nc\nd").alias("content"))
    names = spark.createDataFrame([("f1", 1, 3), ("f1", 2, 3), ("f1", 2, 2), ("f2", None, None), ("gone", 1, 4), (None, 1, 1)], "path string, start_line int, end_line int")
    found = code.parse_quality(names, files)
    shuffles = re.findall(r"Exchange hashpartitioning\([^)]*\)", found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1])
    assert len(shuffles) == 2 and all(re.fullmatch(r"Exchange hashpartitioning\(path#\d+, 3\)", x) for x in shuffles)
    rows = {r.path: tuple(r)[1:] for r in found.filter("path in ('f1', 'f2', 'f3')").collect()}
    assert rows == {"f1": (3, 0.75, 0.875, True), "f2": (1, 0.0, 1 / 6, False), "f3": (0, 0.0, 0.0, False)}


def test_windows_are_hashed_in_bounded_memory():
    """What the sums of a batch of texts take does not follow the batch's size."""
    import tracemalloc

    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(1200)), pa.array([[f"line {k} of {n} " + "x" * 200 for k in range(24)] for n in range(1200)])], ["id", "_p"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in quality._hashed_windows("id", 4, 20)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1200 * sum(24 - size + 1 for size in range(4, 21)) and peak < 160e6, peak


def test_import_targets(spark):
    fs = spark.createDataFrame([("a/b/m.ts", "import './n'\nimport '../lib'\nimport './k.js'\nimport 'react'"), ("a/b/n.ts", ""), ("a/lib/index.ts", ""), ("a/b/k.ts", "")], "path string, content string")
    found = {(r.ref, r.target) for r in code.import_targets(code.edges(fs), fs).collect()}
    assert found == {("./n", "a/b/n.ts"), ("../lib", "a/lib/index.ts"), ("./k.js", "a/b/k.ts")}


def test_generations(spark, tmp_path):
    store = lifecycle.GenerationStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("s", "g1", 1), ("s", "g1", 2)], "source_id string, generation_id string, v int")
    store.stage(rows, "s", "g1")
    store.stage(rows.limit(1), "s", "g2")
    with pytest.raises(ValueError):
        store.publish("s", "g1", "2024-01-01", 3)
    store.publish("s", "g1", "2024-01-01", 2)
    store.publish("s", "g1", "2024-01-01", 2)
    assert store.serving().count() == 2
    store.publish("s", "g2", "2024-01-02", 1)
    assert [(r.generation_id, r.v) for r in store.serving().collect()] == [("g2", rows.first().v)]
    assert store.collect_garbage(0) == ["s/g1"]
    assert store.serving().count() == 1


def test_publish_problems(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "def")], "document_id int, content string").withColumn("hash", F.sha2("content", 256))
    chunks = spark.createDataFrame([(10, 1, 0, "abc", True), (11, 2, 0, "d", True), (12, 2, 2, "f", False)], "chunk_id int, document_id int, chunk_index int, content string, enabled boolean")
    vectors = chunks.filter("chunk_id < 12").select("chunk_id", F.sha2("content", 256).alias("input_hash"))
    found = {r.problem: r.n for r in lifecycle.publish_problems(docs, chunks, vectors, 2).collect()}
    assert {k for k, v in found.items() if v} == {"disabled-chunk", "chunk-gap", "embedding-count"}


def test_upserts_and_gates(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 2, "d")], "k int, v int, x string")
    assert {(r.k, r.x) for r in lifecycle.upsert(old, new, ["k"], "v").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert [r.k for r in lifecycle.insert_missing(old, new, ["k"]).collect()] == [3]
    rows = spark.createDataFrame([("s", True), ("s", False), ("t", False)], "source string, failed boolean")
    assert [r.source for r in lifecycle.source_gate(rows, "source", "failed").collect()] == ["t"]
    assert lifecycle.deletions(old.withColumnRenamed("k", "path"), new.withColumnRenamed("k", "path"), False).count() == 0
    assert lifecycle.deletions(old.withColumnRenamed("k", "path"), new.withColumnRenamed("k", "path"), True).count() == 1
    issues = spark.createDataFrame([("io", "p", False)], "code string, path string, fatal boolean")
    assert lifecycle.scan_completeness(issues).first().status == "incomplete"
    assert lifecycle.scan_completeness(issues.limit(0)).first().status == "complete"


def test_rate_limits():
    assert limits.fixed_window([0, 1, 2, 10, 11.5], 2, 10)[0] == [(True, 1), (True, 0), (False, 0), (False, 0), (True, 1)]
    assert limits.sliding_window([0, 1, 2, 10, 10.5], 2, 10)[0] == [(True, 1), (True, 0), (False, 0), (True, 0), (False, 0)]


def test_streamed_limits_equal_batch_limits(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"k{i % 2}", i, start + datetime.timedelta(seconds=7 * i)) for i in range(30)]
    table = spark.createDataFrame(rows, "key string, event_id bigint, ts timestamp")
    source = str(tmp_path / "in")
    table.coalesce(1).write.parquet(source)
    for kind in ("fixed", "sliding"):
        stream = limits.limit_stream(spark.readStream.schema(table.schema).parquet(source), kind, 2, 60.0)
        query = stream.writeStream.format("memory").queryName(f"out_{kind}").outputMode("append").option("checkpointLocation", str(tmp_path / kind)).trigger(availableNow=True).start()
        query.awaitTermination()
        out = {(r.event_id, r.allowed, r.remaining) for r in spark.table(f"out_{kind}").collect()}
        assert out == {(r.event_id, r.allowed, r.remaining) for r in limits.limit_batch(table, kind, 2, 60.0).collect()}
        assert len(out) == 30 and any(not a for _, a, _ in out)


def test_job_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, 1, "enqueue", t), (1, 2, "claim", t), (1, 3, "finish", t), (2, 1, "enqueue", t), (2, 2, "claim", t)]
    table = spark.createDataFrame(rows, "job_id bigint, seq bigint, kind string, ts timestamp")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = limits.job_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), 60.0).writeStream.format("memory").queryName("jobs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.job_id, r.status, r.attempts) for r in spark.table("jobs").collect()} >= {(1, "done", 1), (2, "running", 1)}


def test_files(spark, tmp_path):
    (tmp_path / "d/.x").mkdir(parents=True)
    for name, text in {"d/a.md": "# A", "d/a.mdx": "old", "d/.x/h.md": "hidden", "d/b.exe": "no"}.items():
        (tmp_path / name).write_text(text)
    found = files.scan(spark, str(tmp_path))
    assert {r.path for r in found.collect()} >= {"d/a.md", "d/b.exe"}
    assert [r.path for r in files.doc_files(found).collect()] == ["d/a.md"]
    one = spark.createDataFrame([('---\ntitle: "X"\nowner: me\n---\nbody\n',)], "c string")
    meta = one.select(files.frontmatter("c").alias("f")).select("f.*").first()
    assert meta.metadata == {"title": "X", "owner": "me"} and meta.body == "body\n"
    merged = one.select(files.merged_metadata(F.create_map(F.lit("kind"), F.lit("guide")), files.frontmatter("c")["metadata"]).alias("m")).first().m
    assert merged == {"kind": "guide", "title": "X"}
    assert files.manifest([{"id": "b", "kind": "git"}, {"id": "a", "kind": "crawl"}])[0][0]["id"] == "a"
    with pytest.raises(ValueError):
        files.manifest([{"id": "a", "kind": "ftp"}])


def test_vault_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "One", "/one", "see [two](/two) and [x](/x)", ["First  Page"]), (2, "Two", "/two", "", [])], "page_id bigint, title string, url string, content string, aliases array<string>")
    files.write_vault(pages, str(tmp_path / "v"))
    rows = files.json_lines(spark, str(tmp_path / "v/pages"), "page_id bigint, title string, url string, related array<bigint>").orderBy("page_id").collect()
    assert [r.related for r in rows] == [[2], []]
    assert files.json_lines(spark, str(tmp_path / "v/aliases"), "page_id bigint, alias string, normalized string").first().normalized == "first page"


def test_glob_rules(spark):
    rows = spark.createDataFrame([("node_modules/a.js",), ("src/x.test.ts",), ("src/x.ts",), ("a/dist/b/c.js",)], "p string")
    hit = {r.p for r in rows.filter(files.ignored("p", ["node_modules", "*.test.ts", "**/dist/**"])).collect()}
    assert hit == {"node_modules/a.js", "src/x.test.ts", "a/dist/b/c.js"}


def test_api(spark):
    chunks = spark.createDataFrame([(1, "s", "s/a.md", "Alpha", 0, "the red fox jumps", True), (2, "s", "s/a.md", "Alpha", 1, "red red fox", True), (3, "t", "t/b.md", "Beta", 0, "a blue whale", True)], "chunk_id bigint, source_id string, source_path string, title string, chunk_index int, content string, enabled boolean")
    docs = api.Docs(chunks, retrieval.hashed_embeddings(chunks, "chunk_id", "content"))
    assert docs.search("red fox", 2).orderBy("rank").first().source_path == "s/a.md"
    assert [r.chunk_id for r in docs.search("blue whale", 1, "keyword").collect()] == [3]
    assert docs.search("red fox", 3, "vector", ["s"]).count() >= 1
    assert docs.health().first().without_embedding == 0
    assert [r.chunk_index for r in docs.document("s/a.md").collect()] == [0, 1]
    assert docs.adapt("s/a.md").first().adapted.startswith("## Quick reference")
    for bad in ("", "x" * 3000, "a\x00b"):
        with pytest.raises(ValueError):
            docs.search(bad)
    with pytest.raises(ValueError):
        docs.search("x", 51)
    project = api.Project(spark.createDataFrame([("src/a.ts", "export function go() {\n}\n"), ("src/b.ts", "import { go } from './a'\ngo()\n"), ("x/.ssh/k", "z")], "path string, content string"))
    assert [r.path for r in project.symbols("GO").collect()] == ["src/a.ts"]
    assert {r.relation for r in project.references("go").collect()} == {"IMPORTS", "CALLS"}
    assert {(r.path, r.target) for r in project.navigation().collect()} == {("src/b.ts", "src/a.ts")}
    assert "x/.ssh/k" not in {r.path for r in project.ingest()[0].collect()}
    assert project.hubs().first().directory == "src" and project.file("src/a.ts").first().total == 1


def test_text_functions(spark):
    one = spark.createDataFrame([("Éa_b/fooBar.ts naïve", "a\nb")], "a string, b string")
    row = one.select(T.identifiers("a").alias("i"), T.unaccent("a").alias("u"), T.terms("a").alias("t"), T.paths_match(F.lit("x/y.md"), F.lit("y.md")).alias("m"), T.complexity(F.lit("``` ```")).alias("c")).first()
    assert row.i == ["eabfoobarts"] and row.u == "Ea_b/fooBar.ts naive" and row.t == ["ea_b/foo", "bar.ts", "naive"] and row.m and row.c == "intermediate"


def test_fallback_join_and_budget(spark):
    f = spark.createDataFrame([(1, 7), (2, 8)], "file_id int, version_id int")
    r = spark.createDataFrame([(1, 7, "a"), (1, None, "b"), (2, None, "c"), (2, 5, "d")], "file_id int, version_id int, name string")
    assert {(x.file_id, x.name) for x in relational.fallback_join(f, r).collect()} == {(1, "a"), (2, "c")}
    rows = spark.createDataFrame([(i, "x" * 10) for i in range(5)], "n int, t string")
    assert [len(x.t) for x in relational.capped(rows, "t", 25, 8, F.asc("n")).orderBy("n").collect()] == [8, 8, 8, 1]


def test_patterns_are_whole():
    assert len(P.SECRETS) == 18 and len(P.PERSONAL) == 6 and len(P.DEBT) == 7


def test_nearest_over_many_blocks_equals_plain_search(spark):
    from lodestone.plans.search import knn_blocks

    rnd = np.random.default_rng(4)
    vectors = rnd.standard_normal((90, 6))
    vectors[40:44] = vectors[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    found = knn_blocks(rows, rows.filter("vec_id % 10 = 0"), 5, asked_rows=3, part_rows=11, least_parts=2).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(0, 90, 10):
        score = np.round(unit @ unit[q], 9)
        wanted = [i for i in np.lexsort((np.arange(90), -score)) if i != q][:5]
        assert {r.vec_id for r in found if r.query_id == q} == set(wanted)
