"""The full-text index against the scan it stands for."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import fulltext, retrieval
from lodestone.operators.fulltext import TextIndex
from lodestone.operators.publication import Catalogue
from lodestone.plans import project, search

SF = "/root/testdata/sf0.001"
ASKED = ["the", '"of the" on', "the of -on", "que or den", '"de la"', "-the -de", '"the the"', "the the of", "nosuchword", '-"of the" the', 'on of or "et le" -que', "", "Über"]


@pytest.fixture(scope="module")
def chunks(spark):
    found = search.chunks_of(spark, SF).select("chunk_id", "source_path", "content")
    extra = spark.createDataFrame([(-5, "x/Über.md", "Über the of the the on Étude über"), (-4, "x/empty", ""), (-3, "x/null", None), (-2, "x/long", "the of " * 5000)], "chunk_id long, source_path string, content string")
    return found.unionByName(extra).cache()


def index_of(spark, path, chunks, **more):
    index = TextIndex(Catalogue(spark, str(path)), **more)
    index.add(chunks, T.search_text("content"), F.lower("source_path"))
    return index


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    return index_of(spark, tmp_path_factory.mktemp("index"), chunks, buckets=8, shelves=3)


def scanned(chunks, query):
    rows = chunks.withColumn("t", T.search_text("content")).filter(retrieval.matches_text("t", query))
    return sorted((r.chunk_id, round(r["rank"], 9)) for r in rows.select("chunk_id", retrieval.rank_cover_density(retrieval.lexemes("t"), query).alias("rank")).collect())


@pytest.mark.parametrize("query", ASKED)
def test_postings_equal_the_scan(chunks, index, query):
    assert sorted((r.chunk_id, round(r["rank"], 9)) for r in index.match(query).collect()) == scanned(chunks, query)


def test_random_queries(chunks, index):
    rnd = random.Random(1)
    words = [r.term for r in index.vocabulary().filter("field = 0").orderBy(F.desc("chunks"), "term").limit(60).collect()]
    for _ in range(4):
        query = " ".join(rnd.choice(["", "", "-"]) + (f'"{rnd.choice(words)} {rnd.choice(words)}"' if rnd.random() < 0.3 else rnd.choice(words)) + rnd.choice(["", "", " or"]) for _ in range(rnd.randint(2, 6)))
        assert sorted((r.chunk_id, round(r["rank"], 9)) for r in index.match(query).collect()) == scanned(chunks, query), query


def test_lane_breaks_ties_by_id(chunks, index):
    best = sorted(scanned(chunks, "que"), key=lambda x: (-x[1], x[0]))[:7]
    assert sorted(r.chunk_id for r in index.lane("que", 7).collect()) == sorted(i for i, _ in best)


def test_substrings_in_terms_and_across_them(chunks, index):
    words = ["tion", "src1", "uber", "the", "the", "ab", "src1/4.md", "f th"]
    rows = chunks.withColumn("t", T.search_text("content")).withColumn("p", F.lower("source_path"))
    wanted = {r.chunk_id: r.hits for r in rows.select("chunk_id", retrieval.term_hits(words, "t", "p").alias("hits")).filter("hits > 0").collect()}
    assert {r.chunk_id: r.hits for r in index.substring_hits(words).collect()} == wanted
    assert index.substring_hits(["ab"]).count() == 0 and index.substring_hits(["zzzzqq"]).count() == 0


def test_only_new_postings_are_made_and_old_ones_go(spark, chunks, tmp_path):
    index = index_of(spark, tmp_path / "i", chunks, buckets=4)
    before = set(index.segments()[0]["postings"])
    new = spark.createDataFrame([(-2, "x/long", "quick quick brown"), (-99, "x/new", "brown the quick")], "chunk_id long, source_path string, content string")
    assert index.add(new, T.search_text("content"), F.lower("source_path")) == 2
    old, added = index.segments()
    assert set(old["postings"]) == before and added["rows"] == 2
    paths = [f"{p}/bucket={b}" for p in added["postings"] for b in added["buckets"]]
    assert spark.read.parquet(*paths).filter("field = 0").groupBy().sum("n").first()[0] == 5
    now = chunks.filter("chunk_id <> -2").unionByName(new)
    for query in ("brown quick", '"quick brown"', "the of"):
        assert sorted((r.chunk_id, round(r["rank"], 9)) for r in index.match(query).collect()) == scanned(now, query)
    index.remove(new.filter("chunk_id = -99"))
    now = now.filter("chunk_id <> -99")
    assert [r.chunk_id for r in index.match("brown").collect()] == [-2] and index.chunks().count() == now.count()
    # A reader that has the first version still sees it whole.
    assert index.chunks(index.segments(1)).filter("chunk_id = -2").first().content.startswith("the of")
    assert index.merge() == 4 and len(index.segments()) == 1
    for query in ("brown", "the of", "-the"):
        assert sorted((r.chunk_id, round(r["rank"], 9)) for r in index.match(query).collect()) == scanned(now, query)
    assert sorted(r.chunk_id for r in index.fetch([-2, -5, 12345678901]).collect()) == [-5, -2]


def test_an_index_of_nothing(spark, tmp_path):
    index = TextIndex(Catalogue(spark, str(tmp_path / "i")))
    assert index.match("a").count() == 0 and index.substring_hits(["abc"]).count() == 0 and index.fetch([1]).count() == 0
    index.add(spark.createDataFrame([], "chunk_id long, content string"), F.col("content"))
    assert index.match("a -b").count() == 0 and index.chunks().count() == 0
    index.add(spark.createDataFrame([(1, "a b a")], "chunk_id long, content string"), F.col("content"))
    assert [tuple(r) for r in index.match("a").collect()] == [(1, pytest.approx(0.2))]


def test_frequent_words_have_bounded_rows(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("chunk_id"), F.lit("all the same").alias("content")).coalesce(1)
    index = TextIndex(Catalogue(spark, str(tmp_path / "i")), shelves=1)
    index.add(rows, F.col("content"))
    sizes = [r.n for r in index.postings(["same"], index.segments()).collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 1 << fulltext.BLOCK_BITS and len(sizes) >= 3
    assert index.match('"all the"').count() == 5000


def test_hybrid_search_with_and_without_the_index(spark):
    chunks = search.chunks_of(spark, SF)
    vectors = search.kept_vectors(spark, SF)
    ask = list(retrieval.hashed_embeddings(spark.createDataFrame([(0, "the src1/4.md of then")], "chunk_id bigint, content string"), "chunk_id", "content").first()["embedding"])
    for query in ("the src1/4.md of then", "que de"):
        a, b = (retrieval.hybrid_search(rows, query, 10, vectors, ask, index=index).withColumn("score", F.round("score", 6)).orderBy("rank").collect() for rows, index in ((chunks, None), (search.search_index(spark, SF).chunks(), search.search_index(spark, SF))))
        assert [tuple(r) for r in a] == [tuple(r) for r in b] and a


def test_a_shelf_and_a_bucket_are_shared_by_tasks(spark, tmp_path):
    """What one task writes is bounded by bytes, not by the number of shelves and buckets."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "16k")
    try:
        rows = spark.range(0, 4000, 1, 8).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", *(F.md5((F.col("id") * 9 + k).cast("string")) for k in range(9))).alias("content"))
        index = TextIndex(Catalogue(spark, str(tmp_path / "i")), buckets=1, shelves=1)
        index.add(rows, F.col("content"))
    finally:
        spark.conf.unset(key)
    (made,) = index.segments()
    for folder in (f"{made['chunks'][0]}/shelf=0", f"{made['postings'][0]}/bucket=0"):
        assert len(list(Path(folder.removeprefix("file:")).glob("*.parquet"))) > 2
    assert index.chunks().count() == 4000 and index.match(hashlib.md5(b"9").hexdigest()).count() == 1


def test_postings_are_bytes(spark, index):
    """What is shuffled and sorted of a word's places is a few bytes for each, not arrays of whole numbers; all values come back."""
    values = np.array([0, 1, -1, 63, 64, -64, -65, 300, 1 << 40, -(1 << 40), (1 << 63) - 1, -(1 << 63)])
    for bounds in ([0, 12], [0, 0, 5, 5, 12], [0] + list(range(13))):
        row, found = fulltext.unpacked(fulltext.packed(values, np.array(bounds)))
        assert found.tolist() == values.tolist() and np.bincount(row, minlength=len(bounds) - 1).tolist() == np.diff(bounds).tolist()
    column = pa.array([None, b"", *fulltext.packed(values, np.array([0, 3, 12])).to_pylist()])
    assert fulltext.unpacked(column.slice(1))[0].tolist() == [1] * 3 + [2] * 9 and len(fulltext.unpacked(column[:2])[1]) == 0
    kept = index.postings(["the", "of"], index.segments())
    size = kept.agg(F.sum("occurrences"), F.sum("n"), F.sum(F.octet_length("ids") + F.octet_length("sizes") + F.octet_length("positions"))).first()
    assert size[0] > 10000 and size[2] <= 2 * size[0] + 6 * size[1]


@pytest.mark.parametrize("make", [search.search_index, project.project_index])
def test_no_task_of_a_registered_index_has_a_whole_shelf(spark, tmp_path, monkeypatch, make):
    """the indexes of tool_categories and project_search are made in tasks of the advisory size, however much lies in a shelf or bucket."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(search, "_INDEXES", {})
    spark.conf.set(key, "16k")
    try:
        index = make(spark, str(tmp_path))
    finally:
        spark.conf.unset(key)
    (made,) = index.segments()
    for folder, parts in ((made["chunks"][0], made["shelves"]), (made["postings"][0], made["buckets"])):
        assert len(list(Path(folder.removeprefix("file:")).glob("*/*.parquet"))) >= 2 * len(parts)
    assert index.chunks().count() == index.chunks().select("chunk_id").distinct().count() == made["rows"] > 0
