"""Operator 11: product codes of vectors.

Every vector is cut into parts, and each part is replaced by the number of the nearest entry of its position's codebook. The
codebooks come from a few rounds of k-means in whole numbers: components are floors of ``scale * x``, sums and counts are 64-bit
integers and means are floors, so results depend neither on how rows are dealt out nor on the order of additions.

The rows are first written as columnar blocks (part, dimension, row) of a bounded number of rows. Each round is one
``treeAggregate`` over the blocks: a task adds up the distances to all entries dimension by dimension, takes the nearest, and
adds the parts to sums and counts of a fixed size with ``np.add.at``; the tensors are merged pairwise on the executors, and what
reaches the driver is as large for any input. A lost executor costs a re-read of blocks.

Results for odd input: null vectors and vectors with null or non-finite components are left out; the length of vectors is that of
the smallest kept id whose vector can be cut into equal parts, and a vector of another length keeps its row, with null for code
and error, and takes no part in training; a null id counts as
larger than any other; of rows that share an id the one with the smaller components comes first, repeated rows count as often as
they stand there; with fewer rows than entries the codebooks are as short; ties go to the lower entry; an empty table gives no
rows; further columns are ignored. Components of 2**20 or more in size are an error, as squared distances might leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.io import small, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block: distances to all entries of all parts take 8 MiB.
BLOCK = 1024
#: Components must be smaller than this.
LARGEST = 1 << 20


def usable(vectors: DataFrame, vector: str, vec_id: str, label: str) -> DataFrame:
    """vec_id, label, vector (doubles) of the rows whose vector is whole."""
    x = F.col(vector).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(F.col(vector).isNotNull() & ~odd).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), x.alias("vector"))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    if values.size and np.abs(values).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more in size")
    return np.floor(values * scale).astype(np.int64)


def cut(batch: pa.RecordBatch, dimensions: int, scale: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have ``dimensions`` components, and these rows' components as (part, dimension, row)."""
    column = batch.column("vector")
    fits = np.flatnonzero(column.value_lengths().to_numpy(zero_copy_only=False) == dimensions)
    flat = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(len(fits), dimensions)
    return fits, np.ascontiguousarray(whole(flat, scale).T).reshape(parts, dimensions // parts, len(fits))


def to_blocks(dimensions: int, scale: int, parts: int):
    """Vectors as blocks of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                _, block = cut(batch.slice(at, BLOCK), dimensions, scale, parts)
                if block.size:
                    yield pa.record_batch([pa.array([block.tobytes()], pa.binary())], ["block"])

    return run


def distances(block: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """(part, entry, row): squared distances, one dimension after another."""
    out = np.zeros((block.shape[0], codebooks.shape[1], block.shape[2]), np.int64)
    for k in range(block.shape[1]):
        step = block[:, k, None, :] - codebooks[:, :, k, None]
        out += step * step
    return out


def added(total: tuple[np.ndarray, np.ndarray], block: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (part, entry, dimension) and counts (part, entry) with a block's parts added at their nearest entries."""
    sums, counts = total
    nearest = distances(block, codebooks).argmin(axis=1)
    part = np.arange(len(block))[:, None]
    np.add.at(sums, (part, nearest), block.transpose(0, 2, 1))
    np.add.at(counts, (part, nearest), 1)
    return sums, counts


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both tensors added up."""
    return a[0] + b[0], a[1] + b[1]


def updated(codebooks: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Floors of the means; entries that nothing is near stay."""
    means = np.floor_divide(sums, np.maximum(counts, 1)[:, :, None])
    return np.where(counts[:, :, None] > 0, means, codebooks)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, depth: int = 2) -> np.ndarray | None:
    """Codebooks (part, entry, dimension) of ``usable`` rows; None without rows. The start is ``entries`` rows, whatever the input."""
    fit = vectors.filter((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    first = fit.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    if not first:
        return None
    dimensions = len(first[0].vector)
    if any(len(r.vector) != dimensions for r in first):  # rows of another length take no part
        first = fit.filter(F.size("vector") == dimensions).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    codebooks = whole(np.array([r.vector for r in first]), scale).reshape(len(first), parts, -1).transpose(1, 0, 2)
    blocks = written(vectors.select("vector").mapInArrow(to_blocks(dimensions, scale, parts), "block binary"), "vector-blocks")
    shape = (parts, dimensions // parts, -1)
    arrays = blocks.rdd.map(lambda r: np.frombuffer(r[0], np.int64).reshape(shape))
    for _ in range(rounds):
        zero = (np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64))
        codebooks = updated(codebooks, *arrays.treeAggregate(zero, lambda total, block, c=codebooks: added(total, block, c), merged, depth))
    return codebooks


def encode(vectors: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code and error of ``usable`` rows: two hex digits for each part (four beyond 256 entries), and the squared distance of the whole vector."""
    parts, entries, size = codebooks.shape
    digits = 2 if entries <= 256 else 4
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole_batch.slice(at, BLOCK) for whole_batch in batches for at in range(0, whole_batch.num_rows, BLOCK)):
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            fits, block = cut(batch, parts * size, scale, parts)
            if len(fits):
                found = distances(block, codebooks)
                nearest, least = found.argmin(axis=1), found.min(axis=1).sum(axis=0)
                hexed = np.ascontiguousarray(nearest.T.astype(">u1" if digits == 2 else ">u2"))
                for i, row, e in zip(fits.tolist(), hexed, least.tolist(), strict=True):
                    code[i], error[i] = row.tobytes().hex(), e
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def fingerprint(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error (the errors of a label added up; nulls are one label), codebooks_sha256."""
    rows = usable(vectors, vector, vec_id, label)
    codebooks = train(rows, parts, entries, rounds, scale)
    if codebooks is None:  # nothing can be cut
        none = {"code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
        return rows.select("vec_id", "label", *(F.lit(None).cast(k).alias(c) for c, k in none.items()))
    coded = written(encode(rows, codebooks, scale), "vector-codes")
    errors = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    found = coded.join(small(errors), F.col("label").eqNullSafe(F.col("of")), "left")
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(fingerprint(codebooks)).alias("codebooks_sha256"))
