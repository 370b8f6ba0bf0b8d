"""Operator 5: best-fit packing of token sequences.

Best-fit decreasing puts each piece, longest first, into the open bin that it leaves the least room in. Only a piece's length
matters, so the whole packing is decided on the histogram of lengths, which has at most ``capacity`` rows whatever the
corpus: a segment tree over remaining capacities finds the tightest class of open bins in logarithmic time, and pieces of
one length go to bins of one class together. The plan it gives is a list of intervals: pieces number ``lo`` to ``hi`` of a
length go to consecutive bins at one offset. That is what best-fit decreasing does piece by piece, equal pieces and equal
bins being interchangeable.

The pieces are numbered within their length without bringing a length to one task: each scan task numbers its own, and
counts by (task, length) give each task's first number.

Results for odd input: null and empty text are the end token alone; ties are broken by task and order of reading, which
only changes ``sequence_id``; rows with a null id or a repeated id are packed like any other; an empty table gives no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.io import written
from lodestone.llm.common import slices

CAPACITY = 1024
END = 2


class Capacities:
    """A segment tree over remaining capacities 0 to ``capacity`` that says which classes of bins are open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, value: bool) -> None:
        """Marks the class as open or not."""
        at = room + self.size
        self.open[at] = value
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, need: int) -> int:
        """The least open capacity of at least ``need``, or -1."""
        at = need + self.size
        while not self.open[at]:
            while at & 1:  # a right child: go up to where there is a right neighbour
                at >>= 1
            if at <= 1:
                return -1
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan (length, lo, hi, first bin, offset) of best-fit decreasing, and the number of bins."""
    tree, classes, plan, bins = Capacities(capacity), defaultdict(list), [], 0
    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left, number = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room = capacity
                count = max(1, left // (room // length))
                taken = [(bins, count)]
                bins += count
            else:
                want, taken = max(1, left // (room // length)), []
                while want and classes[room]:
                    first, count = classes[room].pop()
                    use = min(want, count)
                    taken.append((first, use))
                    want -= use
                    if count > use:
                        classes[room].append((first + use, count - use))
                if not classes[room]:
                    tree.set(room, False)
            each = min(room // length, left)
            for first, count in taken:
                for k in range(each):
                    plan.append((length, number, number + count, first, capacity - room + k * length))
                    number += count
                    left -= count
                classes[room - each * length].append((first, count))
            tree.set(room - each * length, True)
    return plan, bins


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


_ENCODERS: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a tokenizers file whose ids follow its merges; its added tokens are special ones, with ids of their own.
    With all of them allowed, equal to the tokenizers library's ids, at four times its speed."""
    if (path, pattern) not in _ENCODERS:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        alphabet, special = byte_alphabet(), {x["content"]: x["id"] for x in found["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in special}
        _ENCODERS[path, pattern] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path, pattern]


def pieces(path: str, pattern: str, capacity: int, end: int):
    """The pieces of each document with their number among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = encoding(path, pattern), TaskContext.get().partitionId(), defaultdict(int)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            row, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encoder.encode(text or "", allowed_special="all"), end], "<u4")
                first = len(ids) % capacity or capacity
                at = 0
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    part = ids[at:stop]
                    row.append(i)
                    out.append((piece, at, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                    seen[len(part)] += 1
                    at = stop
            if out:
                yield pa.record_batch([batch.column("doc_id").take(pa.array(row)), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())))], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"])

    return run


def placed(plan: list[tuple[int, int, int, int, int]]):
    """The sequence and offset of each piece, from the number it has among all of its length."""
    table = np.array(sorted(plan), np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {int(x): i for i, x in reversed(list(enumerate(table[:, 0])))}
        count = np.bincount(table[:, 0]) if len(table) else np.zeros(1, int)
        for batch in batches:
            lengths, numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                mine, a = lengths == length, first[int(length)]
                at[mine] = a + np.searchsorted(table[a : a + count[length], 1], numbers[mine], "right") - 1
            hit = table[at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(hit[:, 3] + numbers - hit[:, 1]), pa.array(hit[:, 4])], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Documents longer than ``capacity`` are
    cut into pieces of that length, of which the first may be shorter."""
    kind = docs.schema[doc_id].dataType.simpleString()
    row = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    cut = written(read.mapInArrow(pieces(path, pattern, capacity, end), f"{row}, task int, number bigint"), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit(histogram, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    numbered = cut.join(counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before")), ["task", "length"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("before")).select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return numbered.mapInArrow(placed(plan), f"{row}, sequence_id bigint, offset bigint")
