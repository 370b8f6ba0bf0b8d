"""Operator 9: removal of byte strings that occur more than once, by a distributed sparse suffix array.

Every string of ``length`` bytes holds one *anchor*: the 64 bytes in it with the least hash (leftmost of equals). Equal
strings have equal anchors at the same place, so it is enough to sort the suffixes that start at anchors:

1. A scan finds the anchors (about one for each 69 bytes) and keeps, sorted by hash, those that occur twice.
2. Their documents give each such suffix with the bytes left of it that its strings can reach.
3. Sampled splitters range-partition the suffixes by their leading bytes (ties by document and place, so one repeated
   suffix may fill several partitions), and a partition is read in order as buckets of ``BUCKET`` suffixes. Each bucket is
   sorted by multikey quicksort; strings are equal where both the suffix prefix and the left context fall in one class.
   Strings whose prefix class touches a bucket's edge are compared across boundaries, one of each kind from each bucket.

Hashes only choose anchors and drop those that occur once; within a bucket equality is decided on the bytes, across
boundaries on their 256-bit digests. An anchor that is frequent everywhere sends one row of each batch to the task that
counts it, and a worker holds one bucket, whatever the corpus.

Results for odd input: null text counts as empty; texts shorter than ``length`` lose nothing and remove nothing; repeated
rows are separate occurrences, and different texts under one id are told apart; rows with a null id pass unchanged and
are no occurrence; ids must be numbers; ``length`` must lie between 64 and 32,767; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.io import written
from lodestone.llm.common import binary, int64, kinds_in_batch, repeated, utf8, with_twins
from lodestone.llm.kernels import byte_grams, covered, groups_of, leftmost_min, pieces, runs

LENGTH = 200
GRAM_DOUBLINGS = 6
GRAM = 1 << GRAM_DOUBLINGS
#: Suffixes in a bucket, which a Python worker holds whole.
BUCKET = 1 << 15


def anchors(part: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """For the runs of windows that share an anchor: number of the text, first and last window start, place of the anchor
    (in the text) and hash of the anchor."""
    width = length - GRAM + 1
    sizes = np.array([len(x[2]) for x in part], np.int64)
    starts = np.cumsum(sizes) - sizes
    buffer = np.frombuffer(b"".join(x[2] for x in part), np.uint8)
    h = byte_grams(buffer, GRAM_DOUBLINGS)
    at = leftmost_min(h, width)
    room = np.maximum(sizes - length + 1, 0)
    inside = np.zeros(len(at) + 1, np.int8)
    np.add.at(inside, starts[room > 0], 1)
    np.add.at(inside, (starts + room)[room > 0], -1)
    window = np.flatnonzero(np.cumsum(inside[: len(at)]) > 0)
    if not len(window):
        return (np.zeros(0, np.int64),) * 5
    first, last = groups_of(at[window])
    lo, hi, anchor = window[first], window[last - 1], at[window[first]]
    piece = np.searchsorted(starts, lo, "right") - 1
    back = np.array([x[1] for x in part], np.int64)[piece] - starts[piece]
    return np.array([x[0] for x in part], np.int64)[piece], lo + back, hi + back, anchor + back, h[anchor].view(np.int64)


def scan(length: int):
    """Anchors of each text; of equal texts in a batch only the first is scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, parts = set(), []

            def fresh(batch=batch, seen=seen):
                for i, text in enumerate(batch.column("text")):
                    text = text.as_py()
                    if len(text) >= length and (key := hashlib.blake2b(text, digest_size=16).digest()) not in seen:
                        seen.add(key)
                        yield i, text

            for part in pieces(fresh(), length - 1):
                number, lo, hi, anchor, key = anchors(part, length)
                parts.append((number, lo << 32 | (anchor - lo) << 16 | (hi - lo), key))
            if parts:
                number, place, key = (np.concatenate(x) for x in zip(*parts, strict=True))
                row = pa.array(number)
                yield pa.record_batch([pa.array(key), batch.column("doc_id").take(row), batch.column("twin").take(row), pa.array(place), pa.array(kinds_in_batch(key))], ["key", "doc_id", "twin", "place", "kind"])

    return run


def contexts(length: int):
    """For each kept anchor the suffix from it and the bytes left of it, as far as its windows reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, twin, text, places in zip(int64(batch.column("doc_id")), int64(batch.column("twin")), batch.column("text"), batch.column("places"), strict=True):
                place = np.unique(int64(places.values))
                for k in range(0, len(place), 20_000):
                    p = place[k : k + 20_000]
                    lo, left, more = p >> 32, p >> 16 & 0xFFFF, p & 0xFFFF
                    buffer = np.frombuffer(text.as_py(), np.uint8)
                    ok = lo + more + length <= len(buffer)
                    lo, left, more = lo[ok], left[ok], more[ok]
                    if len(lo):
                        yield pa.record_batch([pa.array(np.full(len(lo), doc)), pa.array(np.full(len(lo), twin)), pa.array(lo), pa.array(more.astype(np.int16)), binary(buffer, lo, left), binary(buffer, lo + left, more + length - left)], ["doc_id", "twin", "lo", "more", "left", "right"])

    return run


def matrix(column: pa.Array, width: int, reverse: bool = False) -> np.ndarray:
    """The strings as rows of ``width`` bytes, filled up with zeros; each reversed if asked for."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    out = np.zeros((len(column), width), np.uint8)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, np.repeat(sizes, sizes) - 1 - at if reverse else at] = data[offsets[0] : offsets[-1]]
    return out


def multikey_quicksort(rows: np.ndarray, small: int = 4096) -> np.ndarray:
    """The order of fixed-width byte rows. Each step splits a range by one pivot character (eight bytes) into less, equal
    and greater; only the equal part moves on to the next character. Small ranges are finished by a stable sort."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort(words[part, depth:].T[::-1])]
            continue
        column = words[part, depth]
        pivot = np.sort(column[np.linspace(0, hi - lo - 1, 9).astype(int)])[4]
        less, equal = column < pivot, column == pivot
        a, b = lo + int(less.sum()), lo + int(less.sum()) + int(equal.sum())
        order[lo:hi] = np.concatenate((part[less], part[equal], part[~(less | equal)]))
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for k in range(0, len(rows) - 1, 8192):
        a, b = rows[k : k + 8192], rows[k + 1 : k + 8193]
        differs = a[: len(b)] != b
        out[k + 1 : k + 1 + len(b)] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return out


OUT = "kind tinyint, digest binary, doc_id bigint, twin bigint, lo bigint, hi bigint"


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of BUCKET rows."""
    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, min(BUCKET - size, batch.num_rows - at))
            held.append(part)
            size, at = size + part.num_rows, at + part.num_rows
            if size == BUCKET:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bucket(length: int):
    """Repeated windows of each bucket (kind 0, runs of window starts) and the windows to compare across boundaries (kind 1)."""
    reach = length - GRAM

    def one(table: pa.Table) -> Iterator[pa.RecordBatch]:
        twin = int64(table.column("twin").combine_chunks())
        doc, lo, more = (int64(table.column(c).combine_chunks()) for c in ("doc_id", "lo", "more"))
        more = more.astype(np.int64)
        width = -(-(length + 8) // 8) * 8
        rights = matrix(table.column("right").combine_chunks(), width)
        lefts = matrix(table.column("left").combine_chunks(), -(-(reach + 8) // 8) * 8, reverse=True)
        size = pc.binary_length(table.column("left").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        order = multikey_quicksort(rights)
        prefix = common_prefix(rights[order])
        left_order = multikey_quicksort(lefts)
        left_prefix = common_prefix(lefts[left_order])
        n = len(doc)
        hit_row, hit_at, edge_row, edge_at, edge_hit = [], [], [], [], []
        right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
        for k in range(reach + 1):  # windows that start k bytes left of the anchor
            active = np.flatnonzero((size - more <= k) & (k <= size))
            if not len(active):
                continue
            right_class[order] = np.cumsum(prefix < length - k)
            left_class[left_order] = np.cumsum(left_prefix < k)
            r, code = right_class[active], right_class[active] * (n + 1) + left_class[active]
            by = np.argsort(code, kind="stable")
            first, last = groups_of(code[by])
            repeated = np.repeat(last - first > 1, last - first)
            hits = active[by[repeated]]
            hit_row.append(hits)
            hit_at.append(lo[hits] + size[hits] - k)
            edge = by[first]
            at_edge = (r[edge] == right_class[order[0]]) | (r[edge] == right_class[order[-1]])
            edges = active[edge[at_edge]]
            edge_row.append(edges)
            edge_at.append(size[edges] - k)
        yield from intervals(doc, twin, np.concatenate(hit_row), np.concatenate(hit_at))
        rows, at = np.concatenate(edge_row), np.concatenate(edge_at)
        left, right = table.column("left").combine_chunks(), table.column("right").combine_chunks()
        for k in range(0, len(rows), 50_000):
            r, a = rows[k : k + 50_000], at[k : k + 50_000]
            digest = [hashlib.blake2b((left[i].as_py() + right[i].as_py())[s : s + length], digest_size=32).digest() for i, s in zip(r.tolist(), a.tolist(), strict=True)]
            yield pa.record_batch([pa.array(np.ones(len(r), np.int8)), pa.array(digest, pa.binary()), pa.array(doc[r]), pa.array(twin[r]), pa.array(lo[r] + a), pa.array(lo[r] + a)], ["kind", "digest", "doc_id", "twin", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in buckets(batches):
            yield from one(table)

    return run


def intervals(doc: np.ndarray, twin: np.ndarray, row: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Window starts joined to runs within each document."""
    d, t = doc[row], twin[row]
    order = np.lexsort((at, t, d))
    d, t, at = d[order], t[order], at[order]
    if not len(d):
        return
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (at[1:] > at[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    n = len(first)
    for k in range(0, n, 100_000):
        f, e = first[k : k + 100_000], last[k : k + 100_000]
        yield pa.record_batch([pa.array(np.zeros(len(f), np.int8)), pa.nulls(len(f), pa.binary()), pa.array(d[f]), pa.array(t[f]), pa.array(at[f]), pa.array(at[e])], ["kind", "digest", "doc_id", "twin", "lo", "hi"])


def removal(length: int):
    """The digest columns of each document and its removed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lo, hi, copied in zip(*(batch.column(c) for c in ("text", "los", "his", "copied")), strict=True):
                text = text.as_py()
                mask = np.zeros(len(text), bool)
                if copied.as_py() and len(text) >= length:
                    mask[:] = True
                elif lo.is_valid:
                    mask = covered(len(text), int64(lo.values), int64(hi.values) + length)
                starts, ends = runs(mask)
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if len(starts) else text
                out.append((len(text), int(mask.sum()), starts, ends, kept))
            columns = [batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([len(x[2]) for x in out], pa.int64()), pa.array([hashlib.sha256(x[4]).hexdigest() for x in out], pa.string()), pa.array([x[2] for x in out], pa.list_(pa.int64())), pa.array([x[3] for x in out], pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends"])

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, twin, lo, hi): runs of starts of ``length``-byte strings that also start elsewhere. Of equal texts only some
    are covered; ``copies`` tells the others. ``docs`` has doc_id (bigint, not null), text (binary) and twin."""
    if not GRAM <= length < 1 << 15:
        raise ValueError(f"length must lie between {GRAM} and {(1 << 15) - 1}")
    kept = repeated(docs.mapInArrow(scan(length), "key bigint, doc_id bigint, twin bigint, place bigint, kind tinyint"))
    places = kept.groupBy("doc_id", "twin").agg(F.collect_list("place").alias("places"))
    suffixes = docs.join(places, ["doc_id", "twin"]).select("doc_id", "twin", "text", "places").mapInArrow(contexts(length), "doc_id bigint, twin bigint, lo bigint, more smallint, left binary, right binary")
    order = ["right", "doc_id", "lo"]
    marked = written(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(bucket(length), OUT), "marked-windows")
    # Windows compared across boundaries meet by their digest, at most one from each bucket.
    edge = marked.filter("kind = 1").drop("kind")
    several = edge.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    return marked.filter("kind = 0").select("doc_id", "twin", "lo", "hi").unionByName(edge.join(several, "digest", "left_semi").select("doc_id", "twin", "lo", "hi"))


def copies(digests: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, twin): documents of at least ``length`` bytes whose whole text occurs in another row."""
    long = digests.filter(F.col("size") >= length)
    many = long.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    return long.join(many, "digest").select("doc_id", "twin").distinct()


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_ends (byte spans removed)."""
    # Not renamed or cast without need: an alias on one side only would keep Spark from seeing that two exchanges are one.
    same = doc_id == "doc_id" and docs.schema[doc_id].dataType.simpleString() == "bigint"
    docs = docs.select("doc_id" if same else F.col(doc_id).cast("bigint").alias("doc_id"), utf8(text).alias("text"))
    named = docs.filter(F.col("doc_id").isNotNull())
    digests = written(named.select("doc_id", F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("twin"), F.octet_length("text").alias("size")), "digests")
    named, digests = with_twins(named, digests)
    copied = written(copies(digests, length), "copies").withColumn("copied", F.lit(True))
    key = ["doc_id", "twin"]
    found = repeated_windows(named, length).groupBy(*key).agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))
    # Named rows alone are joined, so that this exchange of the texts is the one that gave the suffixes, reused.
    marked = named.join(found.join(copied, key, "full"), key, "left").select("doc_id", "text", "los", "his", "copied")
    rest = docs.filter(F.col("doc_id").isNull()).withColumns({"los": F.lit(None).cast("array<bigint>"), "his": F.lit(None).cast("array<bigint>"), "copied": F.lit(False)})
    return marked.unionByName(rest).mapInArrow(
        removal(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, span_starts array<bigint>, span_ends array<bigint>"
    )
