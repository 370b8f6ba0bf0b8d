"""The vector index against comparing everything with everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval, vector_index
from lodestone.operators.publication import Catalogue
from lodestone.operators.vector_index import VectorIndex

ROWS = "id long, embedding array<float>"


def clustered(n, width, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((12, width)) * 3
    return [(i, (centres[i % 12] + rnd.standard_normal(width)).astype(np.float32).tolist()) for i in range(n)]


def plain(rows, query, k, skip=None):
    found = []
    q = np.asarray(query, float) / np.linalg.norm(query)
    for i, v in rows:
        if v is None or i == skip or not np.any(v) or not np.all(np.isfinite(np.array(v, float))):
            continue
        found.append((-float(np.dot(q, np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)))), i))
    return [(i, round(-s, 6)) for s, i in sorted(found)[:k]]


@pytest.fixture(scope="module")
def rows():
    return clustered(900, 16, 5)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    made = VectorIndex(Catalogue(spark, str(tmp_path_factory.mktemp("ann"))))
    df = spark.createDataFrame(rows + [(-1, None), (-2, [0.0] * 16), (-3, [float("nan")] + [1.0] * 15)], ROWS)
    made.fit(df)
    made.add(df)
    return made


def asked(spark, rows, skip=True):
    return spark.createDataFrame([(f"q{i}", v, i if skip else None) for i, v in rows], "query_id string, embedding array<float>, skip long")


def test_exact_path_equals_plain_comparison(spark, rows, index):
    some = rows[::90]
    found = index.search(asked(spark, some), 7, exact=True).orderBy("query_id", "rank").collect()
    for i, v in some:
        assert [(r.id, round(r.cosine, 6)) for r in found if r.query_id == f"q{i}"] == plain(rows, v, 7, i)


def test_recall_with_few_cells(spark, rows, index):
    queries = asked(spark, rows[::30])
    few = index.recall(queries, 10, probes=0.4).first()
    all_ = index.recall(queries, 10, probes=1.0).first()
    assert few.queries == 30 and few.wanted == 300 and few.recall >= 0.9 and all_.recall >= 0.99
    one = index.search(queries, 10, probes=0.2).collect()
    assert all(r.cosine <= 1 + 1e-9 for r in one) and len({(r.query_id, r.id) for r in one}) == len(one)


def test_replaced_and_removed_vectors(spark, rows, tmp_path):
    index = VectorIndex(Catalogue(spark, str(tmp_path / "v")))
    df = spark.createDataFrame(rows[:200], ROWS)
    index.fit(df, cells=5)
    index.add(df)
    seen = index.catalogue.version()
    new = [(3, [-x for x in rows[3][1]]), (777, [-x for x in rows[3][1]])]
    index.add(spark.createDataFrame(new, ROWS))
    index.remove(spark.createDataFrame([(0,), (12,)], "id long"))
    now = [r for r in rows[:200] if r[0] not in (0, 3, 12)] + new
    found = index.search(asked(spark, [rows[3], rows[12], new[0]], skip=False).withColumn("query_id", F.monotonically_increasing_id()), 5, exact=True).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.id, round(r.cosine, 6)))
    assert sorted(by.values()) == sorted(plain(now, v, 5) for v in (rows[3][1], rows[12][1], new[0][1]))
    assert index.catalogue.entry(seen)["note"]["segments"] != index.catalogue.entry()["note"]["segments"]
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([(1, [1.0] * 3)], ROWS))
    with pytest.raises(ValueError):
        VectorIndex(Catalogue(spark, str(tmp_path / "w"))).fit(df.limit(0))


def test_a_hot_cell_is_dealt_into_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ROWS", 50)
    monkeypatch.setattr(vector_index, "ASKED_ROWS", 10)
    same = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(400)] + [(1000 + i, [float(i % 5), 1.0, 0.5, -1.0]) for i in range(30)]
    df = spark.createDataFrame(same, ROWS)
    index = VectorIndex(Catalogue(spark, str(tmp_path / "v")))
    index.fit(df)
    index.add(df)
    found = index.search(asked(spark, same[:25]), 3).collect()
    assert len(found) == 75 and all(r.cosine == pytest.approx(1) and r.id == [i for i in range(5) if f"q{i}" != r.query_id][r["rank"] - 1] for r in found)


def test_a_lane_of_a_search(spark, rows, index):
    found = index.nearest_to(rows[0][1], 5, probes=1.0).collect()
    exact = retrieval.vector_lane(spark.createDataFrame(rows, ROWS).withColumnRenamed("id", "chunk_id"), rows[0][1], 1).limit(5).collect()
    assert {r.chunk_id for r in found} == {r.chunk_id for r in sorted(exact, key=lambda r: (-r.vector_score, r.chunk_id))[:5]}
    assert index.search(asked(spark, rows[:1]).limit(0), 3).count() == 0


def test_small_cells_share_a_group(spark, rows, index):
    """Queries meet parts of many rows, not cells: what is made for each pair of a query and a part does not grow with the number of cells."""
    assert vector_index.grouped([3, 4, 0, 5, 50, 1, 1], 10) == ([0, 0, 0, 1, 2, 3, 3], [1, 1, 5, 1])
    assert vector_index.grouped([0, 0], 10) == ([0, 0], [1])
    for exact in (True, False):
        plan = index.search(asked(spark, rows[:40]), 3, exact=exact)._jdf.queryExecution().analyzed().toString()
        assert "group#" in plan
    same = np.array([[1.0, 2.0, 3.0]] * 700 + [[1.0, 0.0, 0.0]] * 5)
    q, none = vector_index.units(same[:3]), np.zeros(3, int)
    (row, column), score = vector_index.best_of(q, vector_index.units(same), np.zeros(705, int), np.array([[0]] * 3), none, np.array([0, 2, 0]), 0, 4, True, 1)
    assert column.reshape(3, 4).tolist() == [[0, 1, 2, 3], [2, 3, 4, 5], [0, 1, 2, 3]] and len(set(score)) == 1
