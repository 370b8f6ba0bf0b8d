"""Digests of sets of rows as hash trees.

A row's entry is the SHA-256 of its key and values; entries lie in leaves by the first digits of the SHA-256 of the key, so a leaf holds the same rows
however the table is dealt out. A leaf's digest is that of its entries in order, a node's that of its children's in order, and so on to the root. Equal
rows are counted before they are hashed. Leaves grow with the number of rows over 16 million, nodes have 256 children at most, and no task holds a list of
all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a key's digest that name a leaf, and the nodes above it.
LEVELS = (6, 4, 2, 0)
SEPARATOR = "\x1f"


def tree_digest(rows: DataFrame, key: str, *values: str, name: str = "digest") -> DataFrame:
    """One row with the digest of a set of rows; that of nothing for an empty one. Null differs from every text."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    entry = F.sha2(F.concat_ws(SEPARATOR, *map(text, (key, *values))), 256)
    counted = rows.select(F.sha2(text(key), 256).alias("place"), entry.alias("entry")).groupBy("place", "entry").agg(F.count("*").alias("n"))
    level = counted.select(F.substring("place", 1, LEVELS[0]).alias("node"), F.sha2(F.concat_ws(SEPARATOR, "entry", F.col("n").cast("string")), 256).alias("part"))
    level = level.groupBy("node").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), ""), 256).alias("digest"))
    for digits in LEVELS[1:]:
        children = F.array_join(F.array_sort(F.collect_list(F.concat("node", "digest"))), "")
        above = level.groupBy(F.substring("node", 1, digits).alias("above")) if digits else level.groupBy()
        found = above.agg(F.sha2(children, 256).alias("digest"), F.count("*").alias("n"))
        level = found.select(F.col("above").alias("node"), "digest") if digits else found.select(F.when(F.col("n") > 0, F.col("digest")).otherwise(F.sha2(F.lit(""), 256)).alias(name))
    return level


#: Paths that are shown of a category, and the count from which a category's findings are not told apart. Fixed values.
SAMPLE, COUNTED = 32, 50_000


def bounded_samples(findings: DataFrame, by: str, path: str, n: int = SAMPLE) -> DataFrame:
    """(by, count, sample): the findings of each category and its ``n`` least distinct paths. Each task keeps a heap of ``n`` for a category and gives that; the heaps are
    merged in two steps, so nothing is sorted but what they hold."""

    def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[str]] = {}
        counts: dict[str, int] = {}
        for batch in batches:
            groups: dict[str, list[str]] = {}
            for category, value in zip(batch.column("by").to_pylist(), batch.column("path").to_pylist(), strict=True):
                groups.setdefault(category, []).append(value)
            for category, values in groups.items():
                counts[category] = counts.get(category, 0) + len(values)
                kept[category] = heapq.nsmallest(n, {*kept.get(category, []), *(v for v in values if v is not None)})
        if counts:
            task = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array([task % 64] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64()), pa.array([kept[c] for c in counts], pa.list_(pa.string()))], ["by", "turn", "count", "sample"])

    parts = findings.select(F.col(by).cast("string").alias("by"), F.col(path).cast("string").alias("path")).mapInArrow(heaps, "by string, turn int, count bigint, sample array<string>")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sample")))), 1, n).alias("sample")
    once = parts.groupBy("by", "turn").agg(F.sum("count").alias("count"), least)
    return once.groupBy("by").agg(F.sum("count").alias("count"), least).withColumnRenamed("by", by)


def blocked_findings(findings: DataFrame, allow: DataFrame, n: int = SAMPLE, most: int = COUNTED) -> DataFrame:
    """(category, state, count, sample) of findings (path, category): those of a category that block, those that an entry of the allow list (path, category) suppresses,
    and entries that nothing was found for (``not encountered``), with which an ingest must not go on. Counts stop at ``most``."""
    entries = allow.select("path", "category").distinct()
    suppressed = findings.join(entries, ["path", "category"], "left_semi")
    missing = entries.join(findings.select("path", "category").distinct(), ["path", "category"], "left_anti")
    sides = {"blocked": findings.join(entries, ["path", "category"], "left_anti"), "suppressed": suppressed, "not encountered": missing}
    out = None
    for state, rows in sides.items():
        told = bounded_samples(rows, "category", "path", n).select("category", F.lit(state).alias("state"), F.least("count", F.lit(most).cast("bigint")).alias("count"), "sample")
        out = told if out is None else out.unionByName(told)
    return out
