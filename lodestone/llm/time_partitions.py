"""Operator 12: files of adaptive time ranges.

Rows lie in files that each cover as much time as holds at most ``limit`` rows: years next to one another share a leaf while they
fit, a year with more rows is split into its months, a month into its days, a day into its hours, and an hour with more
rows is a leaf of several parts. Rows without a moment form a leaf of their own.

The counts of hours are aggregated once and written; the tree is then walked level by level, and of each level only the
children of nodes above ``limit`` come to the driver, of which there are fewer than rows / limit. Leaves start at file numbers
that the counts fix exactly. A row of a leaf of one part has its file number by a search among the leaves' first moments; for leaves of
several parts the rows are sorted by range first, numbered within the sorted tasks and offset by the counts of the tasks before, so
parts are exact even among equal rows. The file number is the partition and (moment, order columns, hash of the row) the
key of ``repartitionAndSortWithinPartitions``; a task streams its sorted rows into one Parquet file, batch by batch, in a
folder of its attempt. The driver moves the finished files in place, so an attempt that was lost or came twice leaves
nothing behind. Beside the files' folder a small JSON file tells which file holds which part, with a digest of its rows.

A second ``write`` into the folder reads that file. Rows that no file holds yet are marked by the caller; a leaf without any that
was a leaf before keeps its files unread, other leaves are written anew, and a part whose rows are those of the file it had keeps
that file.

Results for odd input: rows with a null moment go to the leaf ``null``; nulls in order columns come first; equal rows are all
kept; rows equal in all order columns are ordered by a hash of all their columns; an empty table has no files; columns of any
names and types are kept as they are; years are written with four digits at least.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.io import small, written

#: Parts of a moment, from siblings to their children.
LEVELS = ("year", "month", "day", "hour")
#: Rows of a batch that is written at once.
BATCH = 8192
#: The least 64-bit integer stands for null in keys, so nulls come first.
LEAST = -(1 << 63)


@dataclass(frozen=True)
class Leaf:
    """A run of siblings: its name, year, month, day and hour of its start (nulls for null moments), its rows and those not held yet."""

    name: str
    start: tuple[int | None, ...]
    rows: int
    fresh: int


def days(year: int, month: int) -> np.datetime64:
    """The first day of a month; any year, and month 13 for that of the next one."""
    return (np.datetime64(year - 1970, "Y").astype("M8[M]") + (month - 1)).astype("M8[D]")


def micros(start: tuple[int, ...]) -> int:
    """Microseconds since 1970."""
    year, month, day, hour = start
    return int(((days(year, month) + (day - 1)).astype("M8[h]") + hour).astype("M8[us]").astype(np.int64))


def members(parents: tuple[int, ...]) -> range:
    """All children of a node: months, days or hours."""
    if len(parents) == 1:
        return range(1, 13)
    if len(parents) == 2:
        year, month = parents
        return range(1, int((days(year, month + 1) - days(year, month)).astype(int)) + 1)
    return range(24)


def leaf_of(parents: tuple[int, ...], first: int, last: int, rows: int, fresh: int) -> Leaf:
    """The leaf of a run of siblings."""
    width = lambda depth: 2 if depth else 4
    path = [f"{v:0{width(k)}d}" for k, v in enumerate(parents)]
    span = f"{first:0{width(len(parents))}d}-{last:0{width(len(parents))}d}"
    return Leaf("/".join([*path, span]), (*parents, first, *(1, 1, 0)[len(parents) :]), rows, fresh)


def runs(parents: tuple[int, ...], siblings: range, counts: dict[int, tuple[int, int]], limit: int) -> tuple[list[Leaf], list[tuple[int, ...]]]:
    """The leaves among siblings, and the nodes that split. ``counts``: rows and rows not held yet of a child."""
    leaves, split, run = [], [], None

    def closed() -> None:
        if run and run[2]:
            leaves.append(leaf_of(parents, *run))

    for child in siblings:
        rows, fresh = counts.get(child, (0, 0))
        if rows > limit:
            closed()
            run = None
            if len(parents) == 3:
                leaves.append(leaf_of(parents, child, child, rows, fresh))
            else:
                split.append((*parents, child))
        elif run and run[2] + rows <= limit:
            run = (run[0], child, run[2] + rows, run[3] + fresh)
        else:
            closed()
            run = (child, child, rows, fresh)
    closed()
    return leaves, split


def plan(hours: DataFrame, limit: int) -> list[Leaf]:
    """The leaves in time order, the one of null moments last. ``hours``: year, month, day, hour (null without a moment), rows, fresh."""
    sums = (F.sum("rows").alias("rows"), F.sum("fresh").alias("fresh"))
    years = {r.year: (r.rows, r.fresh) for r in hours.groupBy("year").agg(*sums).collect()}
    none = years.pop(None, (0, 0))
    leaves, split = [], []
    if years:
        leaves, split = runs((), range(min(years), max(years) + 1), years, limit)
    for depth in range(1, len(LEVELS)):
        if not split:
            break
        by = LEVELS[: depth + 1]
        kept = small(hours.sparkSession.createDataFrame(split, ", ".join(f"{c} int" for c in by[:-1])))
        below: dict[tuple[int, ...], dict[int, tuple[int, int]]] = {}
        for r in hours.join(kept, list(by[:-1]), "left_semi").groupBy(*by).agg(*sums).collect():
            below.setdefault(tuple(r[: depth]), {})[r[depth]] = (r.rows, r.fresh)
        parts = [runs(node, members(node), below[node], limit) for node in split]
        leaves += [leaf for found, _ in parts for leaf in found]
        split = [node for _, more in parts for node in more]
    leaves.sort(key=lambda leaf: leaf.start)
    return leaves + ([Leaf("null", (None,) * len(LEVELS), *none)] if none[0] else [])


def files_of(folder: str) -> tuple[pf.FileSystem, str]:
    """The file system of a folder and its path there."""
    return pf.FileSystem.from_uri(folder)


def integers(column: pa.Array) -> np.ndarray:
    """An order column as 64-bit integers, the least one for null."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64())
    elif pa.types.is_date(column.type):
        column = column.cast(pa.int32())
    return pc.fill_null(column.cast(pa.int64()), LEAST).to_numpy(zero_copy_only=False)


def stored(column: pa.Array) -> pa.Array:
    """Timestamps as integers, which are quicker to move as Python values."""
    return column.cast(pa.int64()) if pa.types.is_timestamp(column.type) else column


class Dealer:
    """Which file each row goes to: leaves by their first moments, parts by the row's place in its leaf. Files that stay get -1."""

    def __init__(self, leaves: list[Leaf], keep: set[str], limit: int):
        self.limit, self.files = limit, []
        self.starts = np.array([micros(leaf.start) for leaf in leaves if leaf.start[0] is not None], np.int64)
        self.first = np.full(len(leaves), -1, np.int64)
        self.several = np.array([leaf.rows > limit for leaf in leaves], bool)
        for k, leaf in enumerate(leaves):
            if leaf.name not in keep:
                self.first[k] = len(self.files)
                self.files += [(leaf.name, part + 1) for part in range(-(-leaf.rows // limit))]

    def leaf(self, moments: np.ndarray) -> np.ndarray:
        """The number of each row's leaf; the last one for null moments."""
        found = np.searchsorted(self.starts, moments, "right") - 1
        return np.where(moments == LEAST, len(self.first) - 1, found)

    def deal(self, moments: np.ndarray, places: np.ndarray | None) -> np.ndarray:
        """File numbers; without places, -1 for rows of leaves of several parts."""
        leaf = self.leaf(moments)
        if places is None:
            return np.where(self.several[leaf], -1, self.first[leaf])
        return np.where(self.first[leaf] < 0, -1, self.first[leaf] + places // self.limit)


def to_records(dealer: Dealer, columns: list[str], keys: list[str]):
    """Rows as pickled lists of ((file, key...), (fresh, columns...)), one list for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = integers(batch.column("_place")) if "_place" in batch.schema.names else None
            file = dealer.deal(integers(batch.column("_moment")), places)
            rows = np.flatnonzero(file >= 0)
            for at in range(0, len(rows), BATCH):
                some = rows[at : at + BATCH]
                part = batch.take(pa.array(some))
                key = zip(file[some].tolist(), *(integers(part.column(c)).tolist() for c in keys), strict=True)
                value = zip(*(stored(part.column(c)).to_pylist() for c in ["_fresh", *columns]), strict=True)
                yield pa.record_batch([pa.array([pickle.dumps(list(zip(key, value, strict=True)), 5)], pa.binary())], ["records"])

    return run


def streamed(schema: pa.Schema, staging: str, id_column: str):
    """Writes a task's sorted rows to one file; gives (file number, name in the staging folder, rows, fresh rows, digest of ids, digest of rows)."""
    at = schema.get_field_index(id_column)
    kinds = [pa.int64() if pa.types.is_timestamp(f.type) else f.type for f in schema]

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        files, root = files_of(staging)
        writer, number, total, fresh, ids, content, held = None, -1, 0, 0, hashlib.sha256(), hashlib.sha256(), []
        name = f"{uuid.uuid4().hex}.parquet"

        def flush() -> None:
            nonlocal total, fresh
            new, *values = zip(*held, strict=True)
            batch = pa.record_batch([pa.array(v, k).cast(f.type) for v, k, f in zip(values, kinds, schema, strict=True)], schema=schema)
            writer.write_batch(batch)
            content.update(batch.serialize())
            ids.update(("," * bool(total) + ",".join("" if v is None else str(v) for v in values[at])).encode())
            total, fresh = total + len(held), fresh + sum(new)
            held.clear()

        try:
            for key, value in rows:
                if writer is None:
                    number, writer = key[0], pq.ParquetWriter(posixpath.join(root, name), schema, filesystem=files)
                held.append(value)
                if len(held) == BATCH:
                    flush()
            if held:
                flush()
        finally:
            if writer is not None:
                writer.close()
        if writer is not None:
            yield number, name, total, fresh, ids.hexdigest(), content.hexdigest()

    return run


def placed(rows: DataFrame, leaves: list[Leaf], dealer: Dealer, order: list[str]) -> DataFrame:
    """The rows of leaves of several parts that are written, with ``_place``, their place in the leaf from 0. Such leaves are hours, or that of
    null moments. Rows are sorted by range down to a number that no two rows share, so equal rows spread too; what one task sees
    are counts by task and leaf."""
    chosen = [(k, *leaf.start) for k, leaf in enumerate(leaves) if dealer.several[k] and dealer.first[k] >= 0]
    hours = small(rows.sparkSession.createDataFrame(chosen, "_leaf int, " + ", ".join(f"_{c} int" for c in LEVELS)))
    same = [F.expr(f"{level}(_moment)").eqNullSafe(F.col(f"_{level}")) for level in LEVELS]
    by, task = ["_leaf", *order, "_row"], F.shiftright("_at", 33)
    found = rows.withColumn("_row", F.monotonically_increasing_id()).join(hours, reduce(Column.__and__, same)).select("_leaf", "_row", *rows.columns)
    found = written(found.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "sorted-rows")
    counts = found.groupBy(task.alias("_task"), "_leaf").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_leaf").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = small(written(counts.select("_task", F.col("_leaf").alias("_of"), (before - F.col("_from")).alias("_shift")), "starts"))
    found = found.join(starts, (task == F.col("_task")) & (F.col("_leaf") == F.col("_of")))
    return found.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("_place"))


def held_files(folder: str) -> list[dict]:
    """What the last ``write`` left: leaf, part, n_rows, ids_sha256, rows_sha256 and name of each file."""
    files, path = files_of(f"{folder}.json")
    if files.get_file_info(path).type == pf.FileType.NotFound:
        return []
    with files.open_input_stream(path) as stream:
        return json.loads(stream.read())


def committed(folder: str, staging: str, moves: dict[str, str], final: list[dict]) -> None:
    """Moves new files into place, then names the files that count, then deletes the others and the staging folder."""
    files, root = files_of(folder)
    _, temporary = files_of(staging)
    files.create_dir(root)
    for source, name in moves.items():
        files.move(posixpath.join(temporary, source), posixpath.join(root, name))
    with files.open_output_stream(f"{root}.json.new") as stream:
        stream.write(json.dumps(final).encode())
    files.move(f"{root}.json.new", f"{root}.json")
    names = {x["name"] for x in final}
    for info in files.get_file_info(pf.FileSelector(root)):
        if info.base_name not in names:
            files.delete_file(info.path)
    if files.get_file_info(temporary).type == pf.FileType.Directory:
        files.delete_dir(temporary)


def write(rows: DataFrame, folder: str, limit: int, moment: Column, fresh: Column, order: tuple[str, ...], id_column: str) -> list[dict]:
    """Brings ``folder`` to hold ``rows``; columns of ``order`` are integers, dates or timestamps. Gives leaf, part, name, columns, n_rows, n_new, ids_sha256 and rewritten of each file; there are at most
    about four times rows / ``limit`` and one for each level. ``fresh`` marks the rows that no file of the folder holds; all others must be those it holds."""
    spark, columns = rows.sparkSession, rows.columns
    schema = to_arrow_schema(rows.schema, timestamp_utc=True)
    full = rows.select("*", moment.cast("timestamp_ntz").alias("_moment"), fresh.alias("_fresh"), F.xxhash64(*columns).alias("_hash"))
    parts = [F.expr(f"{level}(_moment)").alias(level) for level in LEVELS]
    hours = full.select(*parts, "_fresh").groupBy(*LEVELS).agg(F.count("*").alias("rows"), F.sum(F.col("_fresh").cast("bigint")).alias("fresh"))
    before = held_files(folder)
    leaves = plan(written(hours, "hours"), limit)
    held: dict[str, list[int]] = {}
    for x in before:
        held.setdefault(x["leaf"], []).append(x["n_rows"])
    filled = lambda n: [*[limit] * ((n - 1) // limit), (n - 1) % limit + 1]
    keep = {leaf.name for leaf in leaves if not leaf.fresh and held.get(leaf.name) == filled(leaf.rows)}
    final = [x | {"n_new": 0, "rewritten": False} for x in before if x["leaf"] in keep]
    dealer, staging, moves = Dealer(leaves, keep, limit), f"{folder}.{uuid.uuid4().hex}", {}
    if dealer.files:
        files, root = files_of(staging)
        files.create_dir(root)
        keys = ["_moment", *order, "_hash"]
        records = full.mapInArrow(to_records(dealer, columns, keys), "records binary").rdd
        if any(dealer.several & (dealer.first >= 0)):
            # The first scan leaves out what the second one places.
            records = records.union(placed(full, leaves, dealer, keys).mapInArrow(to_records(dealer, columns, keys), "records binary").rdd)
        pairs = records.flatMap(lambda r: pickle.loads(r[0]))
        ordered = pairs.repartitionAndSortWithinPartitions(len(dealer.files), lambda key: key[0])
        old = {(x["leaf"], x["part"]): x for x in before}
        for number, source, n_rows, n_new, ids, content in ordered.mapPartitions(streamed(schema, staging, id_column)).collect():
            leaf, part = dealer.files[number]
            same = old.get((leaf, part))
            if same and (same["n_rows"], same["rows_sha256"]) == (n_rows, content):
                final.append(same | {"n_new": 0, "rewritten": False})
                continue
            moves[source] = f"{leaf.replace('/', '.')}-{part:05d}-{content[:16]}.parquet"
            final.append({"leaf": leaf, "part": part, "name": moves[source], "columns": ",".join(schema.names), "n_rows": n_rows, "n_new": n_new, "ids_sha256": ids, "rows_sha256": content, "rewritten": True})
    final.sort(key=lambda x: (x["leaf"], x["part"]))
    committed(folder, staging, moves, final)
    return final


def report(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """One row for each file."""
    names = "leaf string, part int, columns string, n_rows bigint, n_new bigint, ids_sha256 string, rewritten boolean, path string"
    rows = [(x["leaf"], x["part"], x["columns"], x["n_rows"], x["n_new"], x["ids_sha256"], x["rewritten"], f"{folder}/{x['name']}") for x in files]
    return spark.createDataFrame(rows, names)
