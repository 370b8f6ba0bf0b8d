"""An index of vectors by cosine that is kept and searched: coarse cells, codes of residuals, exact scores of the best.

The cells' centres are fitted on a bounded sample; every vector is indexed. A vector is scaled to length 1 and lies in the folder
of the cell with the nearest centre, as a code of eight bits for each component of its difference from the centre, beside the
vector itself. A search asks the cells nearest to each query (``probes``), scores the codes there block by block as matrix
products, and scores the best few again by their vectors. Codes and vectors are different columns, and only the cells asked are read.

Cells may be of any size: small ones share a group, so that a query meets as many parts as the rows ask for and not as many as there are cells; one that holds a third of all rows is dealt into
parts, as many as its count asks for, and each part meets the queries of its cell, so no task holds a cell. The exact path knows no cells: it deals all rows into parts. Null vectors and such of length zero are kept in no cell: they are near nothing. Added
vectors make a segment of their own, in place of those with the same ids, by a commit of the catalogue.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.io import small, written
from lodestone.operators.publication import Catalogue

#: Rows that the centres are fitted on at most, rounds of fitting, and most cells.
SAMPLE, ROUNDS, MOST_CELLS = 65536, 8, 4096
#: The share of cells that a query asks. It is chosen for vectors with little structure, where neighbours lie in many cells: recall at 10 was 0.94 to 0.97 on the test tables
#: (22 and 45 cells). Vectors that form clusters need far less; ``recall`` measures it.
PROBES = 0.75
#: How many codes are scored again for each result that is wanted.
AGAIN = 4
#: Rows of a cell that one task scores, about, and queries that meet them there.
PART_ROWS, ASKED_ROWS = 16384, 4096
ROWS = "segment string, id bigint, code binary, scale float, embedding array<float>"


def units(vectors: list | np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    x = np.asarray(vectors, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Centres of length 1. A cell that runs empty takes a row that is far from its centre."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        near = nearest(sample, centres, 1)
        own, score = near[0][:, 0], near[1][:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(score, kind="stable")[: len(empty)]]
        centres = units(sums)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the ``n`` centres with the highest products, best first, and the products."""
    cells, scores = np.empty((len(rows), n), np.int64), np.empty((len(rows), n))
    for at in range(0, len(rows), 1024):
        product = rows[at : at + 1024] @ centres.T
        order = np.argsort(-product, axis=1, kind="stable")[:, :n] if n > 1 else product.argmax(1)[:, None]
        cells[at : at + 1024], scores[at : at + 1024] = order, np.take_along_axis(product, order, 1)
    return cells, scores


def grouped(sizes: list[int], rows: int) -> tuple[list[int], list[int]]:
    """The group of each cell, and the parts of each group: neighbouring numbers share a group of at most ``rows`` rows, and a larger cell has one of its own, in parts."""
    group, parts, held = [], [], 0
    for n in sizes:
        if not parts or held + n > rows:
            parts.append(max(1, -(-n // rows)))
            held = 0
        held += n
        group.append(len(parts) - 1)
    return group, parts


def best_of(q: np.ndarray, x: np.ndarray, own: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray, at: int, most: int, exact: bool, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The best rows of a part for 128 queries from ``at`` on: (query, row) and the scores. Rows are in order of their ids, of equal scores the lesser id counts; a query meets rows of its ``cells``
    alone (all if ``exact``), and none from ``low`` to ``high``. Exact scores are summed row by row, so that equal vectors score alike wherever they lie."""
    product = np.round(q[at : at + 128] @ x.T, 12)
    if not exact:
        allowed = np.zeros((len(product), count), bool)
        for j, some in enumerate(cells[at : at + 128]):
            allowed[j, some] = True
        product[~allowed[:, own]] = -np.inf
    for j in np.flatnonzero(low[at : at + 128] < high[at : at + 128]):
        product[j, low[at + j] : high[at + j]] = -np.inf
    least = np.partition(product, -most, axis=1)[:, -most] if product.shape[1] > most else np.full(len(product), -np.inf)
    row, column = np.nonzero((product >= least[:, None] - 1e-9) & (product > -np.inf))
    score = product[row, column]
    if exact:
        for k in range(0, len(row), 1 << 16):
            score[k : k + (1 << 16)] = (q[at + row[k : k + (1 << 16)]] * x[column[k : k + (1 << 16)]]).sum(axis=1)
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    kept = place < most
    return np.stack([row[kept] + at, column[kept]]), score[kept]


class VectorIndex:
    """Segments of coded vectors (id, embedding) in a catalogue."""

    def __init__(self, catalogue: Catalogue):
        self.catalogue, self.spark = catalogue, catalogue.spark

    def _note(self, version: int | None = None) -> dict:
        return self.catalogue.entry(version)["note"]

    def _centres(self, note: dict) -> np.ndarray:
        row = self.spark.read.parquet(note["centres"]).first()
        return np.frombuffer(bytes(row.centres), np.float64).reshape(row.cells, -1)

    def fit(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> int:
        """Fits the centres on at most ``sample`` vectors, those with the least hashes of their ids. ``cells``: the root of the number of vectors if None."""
        usable = vectors.filter(_whole())
        n = usable.count()
        if not n:
            raise ValueError("there is nothing to fit on")
        chosen = usable if n <= sample else usable.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
        rows = [r.embedding for r in chosen.select("id", "embedding").orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(sample).collect()]
        if not rows:
            rows = [usable.first().embedding]
        width = max(map(len, rows))
        rows = units([r for r in rows if len(r) == width])
        cells = min(cells or max(1, round(n**0.5)), MOST_CELLS, len(rows))
        centres = fitted(rows, cells)
        table = self.spark.createDataFrame([(cells, bytearray(centres.tobytes()))], "cells int, centres binary")
        path = self.catalogue.stage("centres", table)
        return self.catalogue.commit(self.catalogue.version(), {"centres": [path]}, {"centres": path, "cells": cells, "width": width, "segments": []})

    def add(self, vectors: DataFrame) -> int:
        """Indexes every vector (id, embedding) in place of those with the same ids; gives the version."""
        note = self._note()
        centres, name, width = self._centres(note), uuid.uuid4().hex, note["width"]

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
                    x = matrix(part.column("embedding"))
                    unit = units(x)
                    own = nearest(unit, centres, 1)[0][:, 0]
                    rest = unit - centres[own]
                    scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
                    codes = np.rint(rest / scale[:, None]).astype(np.int8)
                    yield pa.record_batch([part.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale.astype(np.float32)), part.column("embedding"), pa.array(own.astype(np.int32))], ["id", "code", "scale", "embedding", "cell"])

        kept = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).filter(_whole())
        wrong = kept.filter(F.size("embedding") != width).limit(1).count()
        if wrong:
            raise ValueError(f"all vectors must have {width} components")
        rows = kept.mapInArrow(code, "id bigint, code binary, scale float, embedding array<float>, cell int").withColumn("segment", F.lit(name))
        # Rows of a cell lie together; a large one is dealt to several files.
        path = self.catalogue.stage("vectors", rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell", "id"), ["cell"])
        cells = self.catalogue.folders(path)

        def step(seen: int) -> int:
            now = self._note(seen)
            gone = list(now.get("gone", []))
            if now["segments"]:
                old = self._rows(now, range(now["cells"])).select("segment", "id").join(kept.select("id").distinct(), "id", "left_semi")
                gone.append(self.catalogue.stage("gone", old.select("segment", "id")))
            return self._commit(seen, now | {"segments": [*now["segments"], {"name": name, "path": path, "cells": cells}], "gone": gone})

        return self.catalogue.retried(step)

    def remove(self, ids: DataFrame) -> int:
        """Removes vectors by their ids."""

        def step(seen: int) -> int:
            now = self._note(seen)
            old = self._rows(now, range(now["cells"])).select("segment", "id").join(ids.select("id").distinct(), "id", "left_semi")
            return self._commit(seen, now | {"gone": [*now.get("gone", []), self.catalogue.stage("gone", old.select("segment", "id"))]})

        return self.catalogue.retried(step)

    def _commit(self, seen: int, note: dict) -> int:
        tables = {"centres": [note["centres"]], "vectors": [s["path"] for s in note["segments"]], "gone": note.get("gone", [])}
        return self.catalogue.commit(seen, tables, json.loads(json.dumps(note)))

    def _rows(self, note: dict, cells) -> DataFrame:
        """The rows of some cells that count, with their cell."""
        folders = {c: [f"{s['path']}/cell={c}" for s in note["segments"] if c in s["cells"]] for c in sorted(set(cells))}
        paths = [p for found in folders.values() for p in found]
        if not paths:
            return self.spark.createDataFrame([], ROWS + ", cell int")
        rows = self.spark.read.schema(ROWS).parquet(*paths).withColumn("cell", F.regexp_extract(F.col("_metadata.file_path"), "/cell=([0-9]+)/", 1).cast("int"))
        if note.get("gone"):
            rows = rows.join(small(self.spark.read.schema("segment string, id bigint").parquet(*note["gone"])), ["segment", "id"], "left_anti")
        return rows

    def search(self, queries: DataFrame, k: int, probes: float = PROBES, exact: bool = False, again: int = AGAIN) -> DataFrame:
        """(query_id, id, cosine, rank): the ``k`` nearest vectors of each query (query_id, embedding), a vector under the query's own id aside if ``queries`` has ``skip``, the id to leave
        out. ``probes``: the share of cells that is asked; with ``exact`` all are, and every vector is scored by itself."""
        note = self._note()
        centres, count = self._centres(note), note["cells"]
        queries = queries if "skip" in queries.columns else queries.withColumn("skip", F.lit(None).cast("bigint"))
        whole = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("skip").cast("bigint").alias("skip")).filter(_whole())
        kind = queries.schema["query_id"].dataType.simpleString()
        held = {r.cell: r.n for r in self._rows(note, range(count)).groupBy("cell").agg(F.count("*").alias("n")).collect()}
        group, parts = grouped([0 if exact else held.get(c, 0) for c in range(count)], PART_ROWS)
        if exact:
            parts = [max(1, -(-sum(held.values()) // PART_ROWS))]
        asked = 1 if exact else max(1, min(count, round(count * probes)))
        of_cell = np.array(group)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                    cells = np.zeros((rows.num_rows, 1), np.int64) if exact else nearest(units(matrix(rows.column("embedding"))), centres, asked)[0]
                    order = np.argsort(of_cell[cells], axis=1, kind="stable")
                    cells = np.take_along_axis(cells, order, 1)
                    own = of_cell[cells]
                    first = np.c_[np.ones(len(own), bool), own[:, 1:] != own[:, :-1]]
                    inner = pa.ListArray.from_arrays(pa.array(np.r_[np.flatnonzero(first.ravel()), cells.size].astype(np.int32)), pa.array(cells.ravel().astype(np.int32)))
                    met = pa.StructArray.from_arrays([pa.array(own[first].astype(np.int32)), inner], ["group", "cells"])
                    yield pa.record_batch([*(rows.column(c) for c in ("query_id", "embedding", "skip")), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(first.sum(axis=1))].astype(np.int32)), met)], ["query_id", "embedding", "skip", "met"])

        routes = written(whole.mapInArrow(route, f"query_id {kind}, embedding array<double>, skip bigint, met array<struct<group: int, cells: array<int>>>"), "routes")
        blocks = max(1, -(-routes.count() // ASKED_ROWS))
        wanted = range(count) if exact else [r.cell for r in routes.select(F.explode("met.cells").alias("c")).select(F.explode("c").alias("cell")).distinct().collect()]
        rows = self._rows(note, wanted)
        # As many parts of a group and blocks of queries as their counts ask for; a part meets each block once, whatever cells it holds.
        deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        n_parts = lambda c: F.element_at(F.lit(parts), c + 1)
        left = routes.select("query_id", "skip", "embedding", F.explode("met").alias("m")).select("query_id", F.coalesce("skip", F.lit(0)).alias("skip"), F.col("skip").isNotNull().alias("skips"), "embedding", "m.group", "m.cells", deal("query_id", F.lit(blocks)).alias("block"))
        left = left.withColumn("part", each(n_parts(F.col("group"))))
        right = rows.withColumn("group", F.element_at(F.lit(group), F.col("cell") + 1))
        right = right.select("id", "cell", *(["embedding"] if exact else ["code", "scale"]), "group", deal("id", n_parts(F.col("group"))).alias("part"), each(F.lit(blocks)).alias("block"))
        most = k if exact else k * again

        def score(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame()
            b = b.sort_values("id", kind="stable")
            q, ids, own = units(a.embedding.tolist()), b.id.to_numpy(), b.cell.to_numpy()
            if exact:
                x = units(b.embedding.tolist())
            else:
                x = centres[own] + np.frombuffer(b"".join(b.code), np.int8).reshape(len(b), -1) * b.scale.to_numpy(np.float64)[:, None]
            left_out, skips, cells = a["skip"].to_numpy(), a["skips"].to_numpy(), a["cells"].to_numpy()
            low, high = np.searchsorted(ids, left_out, "left"), np.searchsorted(ids, left_out, "right")
            found = [best_of(q, x, own, cells, np.where(skips, low, 0), np.where(skips, high, 0), at, most, exact, count) for at in range(0, len(q), 128)]
            query, row = np.concatenate([near for near, _ in found], axis=1)
            if not len(query):
                return pd.DataFrame()
            return pd.DataFrame({"query_id": a.query_id.to_numpy()[query], "id": ids[row], "cell": own[row], "cosine": np.concatenate([score for _, score in found])})

        by = ("group", "part", "block")
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(score, f"query_id {kind}, id bigint, cell int, cosine double")
        best = lambda n: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")) <= n
        top = found.withColumn("_in", best(most)).filter("_in").drop("_in")
        if not exact:
            vectors = rows.select("id", "cell", F.col("embedding").cast("array<double>").alias("vector"))
            both = top.select("query_id", "id", "cell").join(vectors, ["cell", "id"]).join(whole.select("query_id", "embedding"), "query_id")
            top = both.select("query_id", "id", _cosine("embedding", "vector").alias("cosine")).withColumn("_in", best(k)).filter("_in").drop("_in")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
        return top.select("query_id", "id", "cosine", rank.alias("rank"))

    @property
    def width(self) -> int:
        """Components of a vector."""
        return self._note()["width"]

    def ids(self) -> DataFrame:
        """(chunk_id) of all vectors that count."""
        note = self._note()
        return self._rows(note, range(note["cells"])).select(F.col("id").alias("chunk_id"))

    def nearest_to(self, query: list[float], k: int, probes: float = PROBES) -> DataFrame:
        """(chunk_id, vector_score) of the ``k`` nearest to one vector, scores not below 0: a lane of a search."""
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id int, embedding array<double>")
        return self.search(one, k, probes).select(F.col("id").alias("chunk_id"), F.greatest("cosine", F.lit(0.0)).alias("vector_score"))

    def recall(self, queries: DataFrame, k: int, probes: float = PROBES) -> DataFrame:
        """(queries, wanted, found, recall): how many of the exact ``k`` nearest a search finds. Vectors as near as the k-th count as found."""
        exact, some = self.search(queries, k, exact=True), self.search(queries, k, probes)
        # A row for each query; written, as it is read twice and the exact search is the dear part.
        least = written(exact.groupBy("query_id").agg(F.min("cosine").alias("least"), F.count("*").alias("n")), "least")
        good = some.join(least, "query_id").filter(F.col("cosine") >= F.col("least") - 1e-9).groupBy("query_id").agg(F.count("*").alias("hit"))
        both = least.join(good, "query_id", "left").agg(F.count("*").alias("queries"), F.sum("n").alias("wanted"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))
        return both.withColumn("recall", F.col("found") / F.col("wanted"))


def _whole():
    """Vectors that are near something: neither null nor zero, without null or non-finite components."""
    x = F.col("embedding")
    return x.isNotNull() & F.exists(x, lambda v: v != 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def _cosine(a: str, b: str):
    """Cosine of two vectors, in the order of their components."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
