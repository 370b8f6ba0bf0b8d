"""What the operators share on the Spark side."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.kernels import groups_of, spans

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None

#: ASCII white space as the contracts define it; ``bytes.split()`` splits on the same six characters.
SPACES = " \t\n\x0b\f\r"


def utf8(column: str | Column) -> Column:
    """The text as bytes; null counts as empty."""
    return F.encode(F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit("")), "UTF-8")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def int64(column: pa.Array) -> np.ndarray:
    """An integer column without nulls."""
    return column.to_numpy(zero_copy_only=False)


def binary(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of slices of a byte buffer."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    data = values[spans(starts, lengths)]
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


#: How a row looks for another of its key: by itself, for those of its batch too, or not at all.
ALONE, FIRST, SURE = 0, 1, 2


def kinds_in_batch(key: np.ndarray) -> np.ndarray:
    """ALONE for keys that occur once in the batch; of the others, FIRST for one row and SURE for the rest. Only the first two
    go where the key's rows meet, so a key that is frequent everywhere sends a row of each batch there."""
    order = np.argsort(key, kind="stable")
    starts, ends = groups_of(key[order])
    kind = np.full(len(key), SURE, np.int8)
    kind[order[starts]] = np.where(ends - starts > 1, FIRST, ALONE)
    return kind


def repeated(found: DataFrame) -> DataFrame:
    """The rows (key, doc_id, twin, place) whose key another row has; ``found`` has their kind in the batch too."""
    route = F.when(F.col("kind") == SURE, F.xxhash64("doc_id", "place")).otherwise(F.col("key"))
    kept = found.repartition(route).sortWithinPartitions("key").mapInArrow(lambda b: flags_of_repeats(b, "key"), found.schema)
    return kept.drop("kind")


def flags_of_repeats(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """From batches sorted by ``key``, the rows whose key stands next to an equal one, and those of a kind that says so. Holds one
    row between batches."""
    held, held_flag = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch])
        keys = int64(table.column(key).combine_chunks())
        same = keys[1:] == keys[:-1]
        flag = int64(table.column("kind").combine_chunks()) != ALONE if "kind" in table.schema.names else np.zeros(len(keys), bool)
        flag[1:] |= same
        flag[:-1] |= same
        flag[0] |= held_flag
        last = len(keys) - 1
        yield from table.slice(0, last).filter(pa.array(flag[:last])).combine_chunks().to_batches()
        held, held_flag = table.slice(last).combine_chunks().to_batches()[0], bool(flag[last])
    if held is not None and held_flag:
        yield held


def with_twins(docs: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) with ``twin``, which tells different texts under one id apart: a hash of the text if there are any,
    else 0; and ``digests`` (doc_id, digest, twin, and so on), written before, with the same ``twin``."""
    several = digests.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b")
    if several.isEmpty():
        none = F.lit(0).cast("bigint")
        return docs.withColumn("twin", none), digests.withColumn("twin", none)
    return docs.withColumn("twin", F.xxhash64("text")), digests


def slices(batch: pa.RecordBatch, column: str, rows: int = 512, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and, but for single longer values, ``size`` bytes of a string column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < batch.num_rows:
        reach = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        stop = min(max(reach, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop
    released()


def released() -> None:
    """Gives memory that is free back to the system, as a worker serves many tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
