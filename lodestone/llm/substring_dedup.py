"""Operator 8: removal of passages that an earlier document holds, by relative Lempel-Ziv parsing.

A passage counts from ``window`` words on. The reference is the corpus itself: a document is parsed against everything
that stands in documents with a smaller id. The reference is kept in blocks, and a stretch of a document is sent to each
block that can hold one of its windows and to no other:

1. A scan finds in every window its *anchor*, the ``gram`` words in it with the least hash (leftmost of equals). Equal
   windows have equal anchors, so a block is named by the anchor's hash. Anchors that occur once are dropped.
2. The stretches around the other anchors go to their blocks, in the order of the documents. A block indexes the phrases
   of the stretches it has seen by content, each with its first source. An anchor with more than ``HOT`` stretches has
   several blocks, each with a share of the documents.
3. Each stretch is factored greedily: at a phrase of the index the factor runs on along its source as far as the words
   agree. Factors of at least ``window`` words become duplicate spans. At a factor's end, and where there is none, the
   next starts are looked up one by one, so a window across a factor boundary is found as well.
4. Blocks of one anchor are reconciled: each gives the first place of its phrases, and where another block has a phrase in an
   earlier document, that place becomes a span too.

Hashes only route; phrases are compared as bytes. A block holds the phrases of at most about ``HOT`` stretches, and an anchor
that is frequent everywhere sends one row of each batch to the task that counts it.

Results for odd input: null text has no words; texts of fewer than ``window`` words lose nothing; repeated rows have the
same id, so neither is earlier, and different texts under one id are told apart; rows with a null id pass unchanged and
are no source; ids must be numbers; ``window`` must lie between ``gram`` and 32,767 words; an empty table gives no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.io import small, written
from lodestone.llm.common import binary, int64, kinds_in_batch, repeated, utf8, with_twins
from lodestone.llm.kernels import covered, groups_of, leftmost_min, runs, tokens, word_grams

WINDOW = 13
GRAM = 5
#: Words handled at once.
PART = 1 << 18
#: Stretches in a block; an anchor with more has several blocks.
HOT = 1 << 14


def parts(texts: Iterator[tuple[int, bytes]], overlap: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """(number, first word, words) in lists of about PART words; a longer text comes in parts that overlap."""
    held, size = [], 0
    for number, text in texts:
        words = text.split()
        for at in range(0, max(1, len(words) - overlap), PART):
            part = words[at : at + PART + overlap]
            held.append((number, at, part))
            size += len(part)
            if size >= PART:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchors(part: list[tuple[int, int, list[bytes]]], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """For the runs of windows that share an anchor: number of the text, first and last window start (in words of the text),
    place and hash of the anchor."""
    sizes = np.array([len(x[2]) for x in part], np.int64)
    starts = np.cumsum(sizes) - sizes
    buffer = np.frombuffer(b"\n".join(b" ".join(x[2]) for x in part if x[2]), np.uint8)
    h = word_grams(tokens(buffer)[2], gram)
    at = leftmost_min(h, window - gram + 1)
    room = np.maximum(sizes - window + 1, 0)
    inside = np.zeros(len(at) + 1, np.int64)
    np.add.at(inside, starts[room > 0], 1)
    np.add.at(inside, (starts + room)[room > 0], -1)
    start = np.flatnonzero(np.cumsum(inside[: len(at)]) > 0)
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    first, last = groups_of(at[start])
    lo, hi, anchor = start[first], start[last - 1], at[start[first]]
    piece = np.searchsorted(starts, lo, "right") - 1
    back = np.array([x[1] for x in part], np.int64)[piece] - starts[piece]
    return np.array([x[0] for x in part], np.int64)[piece], lo + back, hi + back, anchor + back, h[anchor].view(np.int64)


def scan(window: int, gram: int):
    """Anchors of each text; of equal texts in a batch only the one with the smallest id is scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = int64(batch.column("doc_id"))
            texts = batch.column("text")
            first: dict[bytes, int] = {}
            for i in np.argsort(ids, kind="stable").tolist():
                first.setdefault(hashlib.blake2b(texts[i].as_py(), digest_size=16).digest(), i)
            found = []
            for part in parts(((i, texts[i].as_py()) for i in sorted(first.values())), window - 1):
                number, lo, hi, anchor, key = anchors(part, window, gram)
                found.append((number, lo << 32 | (anchor - lo) << 16 | (hi - lo), key))
            if found:
                number, place, key = (np.concatenate(x) for x in zip(*found, strict=True))
                row = pa.array(number)
                yield pa.record_batch([pa.array(key), batch.column("doc_id").take(row), batch.column("twin").take(row), pa.array(place), pa.array(kinds_in_batch(key))], ["key", "doc_id", "twin", "place", "kind"])

    return run


def stretches(window: int, gram: int):
    """The words that the windows of each kept anchor cover, under the anchor's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, twin, text, places in zip(int64(batch.column("doc_id")), int64(batch.column("twin")), batch.column("text"), batch.column("places"), strict=True):
                words = text.as_py().split()
                place = np.sort(int64(places.values))
                # Part by part, as a text may be long: the anchors whose stretches begin in it.
                for at in range(0, len(words), PART):
                    mine = place[(place >> 32 >= at) & (place >> 32 < at + PART)]
                    lo = (mine >> 32) - at
                    hi = lo + (mine & 0xFFFF) + window
                    buffer = np.frombuffer(b" ".join(words[at : at + PART + 3 * window]), np.uint8)
                    starts, ends, hashes = tokens(buffer)
                    ok = hi <= len(starts)
                    lo, hi, anchor = lo[ok], hi[ok], lo[ok] + (mine[ok] >> 16 & 0xFFFF)
                    key = word_grams(hashes, gram)[anchor].view(np.int64)
                    for k in range(0, len(lo), 20_000):
                        a, b = starts[lo[k : k + 20_000]], ends[hi[k : k + 20_000] - 1]
                        yield pa.record_batch([pa.array(key[k : k + 20_000]), pa.array(np.full(len(a), doc)), pa.array(np.full(len(a), twin)), pa.array(lo[k : k + 20_000] + at), binary(buffer, a, b - a)], ["key", "doc_id", "twin", "lo", "words"])

    return run


def factors(stretch: bytes, doc: int, index: dict, window: int) -> tuple[list[tuple[int, int]], list[tuple[int, bytes]]]:
    """Greedy parse of one stretch against a block's index, which then learns the stretch's phrases. Spans in words, and the
    phrases, with their places, that no earlier document has in this block."""
    words = stretch.split(b" ")
    offsets = [0]
    for word in words:
        offsets.append(offsets[-1] + len(word) + 1)
    found, i, last = [], 0, len(words) - window
    while i <= last:
        source = index.get(stretch[offsets[i] : offsets[i + window] - 1])
        if source is None or source[0] >= doc:
            i += 1
            continue
        _, other, at = source
        size = window
        while i + size < len(words) and at + size < len(other) and words[i + size] == other[at + size]:
            size += 1
        found.append((i, i + size))
        i += size - window + 1
    first = []
    for i in range(last + 1):
        phrase = stretch[offsets[i] : offsets[i + window] - 1]
        if index.setdefault(phrase, (doc, words, i))[0] == doc:
            first.append((i, phrase))
    return found, first


def parse(window: int):
    """Duplicate spans (kind 0: doc_id, twin, lo, hi) in words, from stretches sorted by block and document; of blocks that share
    their anchor also the first places of their phrases (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = (int64(batch.column(c)).tolist() for c in ("key", "blocks", "block", "doc_id", "twin", "lo"))
            spans, places, phrases = [], [], []
            for key, blocks, salt, doc, twin, lo, words in zip(*columns, batch.column("words").to_pylist(), strict=True):
                if (key, salt) != block:
                    block, index = (key, salt), {}
                found, first = factors(words, doc, index, window)
                spans += [(doc, twin, lo + a, lo + b) for a, b in found]
                if blocks > 1:
                    places += [(doc, twin, lo + i, lo + i + window) for i, _ in first]
                    phrases += [p for _, p in first]
            if spans or places:
                kind = pa.array(np.repeat(np.array([0, 1], np.int8), [len(spans), len(places)]))
                yield pa.record_batch([kind, pa.array([None] * len(spans) + phrases, pa.binary()), *(pa.array([x[k] for x in spans + places], pa.int64()) for k in range(4))], ["kind", "phrase", "doc_id", "twin", "lo", "hi"])

    return run


def removal(window: int):
    """The digest columns of each document and its removed spans (in words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lo, hi, copied in zip(*(batch.column(c) for c in ("text", "los", "his", "copied")), strict=True):
                words = text.as_py().split()
                mask = np.zeros(len(words), bool)
                if copied.as_py() and len(words) >= window:
                    mask[:] = True
                elif lo.is_valid:
                    mask = covered(len(words), int64(lo.values), int64(hi.values))
                starts, ends = runs(mask)
                kept = [w for w, m in zip(words, mask.tolist(), strict=True) if not m] if len(starts) else words
                out.append((len(words), int(mask.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), starts, ends))
            columns = [batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.list_(pa.int64())), pa.array([x[4] for x in out], pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "span_starts", "span_ends"])

    return run


def duplicate_spans(docs: DataFrame, copied: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, twin, lo, hi): word spans made of windows that also start in a document with a smaller id. ``docs`` has doc_id
    (not null), text (binary) and twin; documents in ``copied`` are left out, since their texts stand in an earlier one."""
    if not gram <= window < 1 << 15:
        raise ValueError(f"window must lie between {gram} and {(1 << 15) - 1}")
    key = ["doc_id", "twin"]
    kept = repeated(docs.mapInArrow(scan(window, gram), "key bigint, doc_id bigint, twin bigint, place bigint, kind tinyint"))
    kept = written(kept.join(small(copied), key, "left_anti"), "anchors")
    hot = written(kept.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).cast("int").alias("blocks")), "hot-anchors")
    places = kept.groupBy(*key).agg(F.collect_list("place").alias("places"))
    sent = docs.join(places, key).select("doc_id", "twin", "text", "places")
    sent = sent.mapInArrow(stretches(window, gram), "key bigint, doc_id bigint, twin bigint, lo bigint, words binary")
    sent = sent.join(small(hot), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sent = sent.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("bigint")))
    by = ["key", "block"]
    parsed = sent.repartition(*by).sortWithinPartitions(*by, "doc_id", "twin", "lo").select("key", "blocks", "block", "doc_id", "twin", "lo", "words")
    parsed = written(parsed.mapInArrow(parse(window), "kind tinyint, phrase binary, doc_id bigint, twin bigint, lo bigint, hi bigint"), "spans")
    places = parsed.filter("kind = 1").drop("kind")
    first = places.groupBy("phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    late = places.join(first, "phrase").filter("doc_id > first")
    return parsed.filter("kind = 0").select(*key, "lo", "hi").unionByName(late.select(*key, "lo", "hi"))


def copies(digests: DataFrame) -> DataFrame:
    """(doc_id, twin): documents whose whole text also stands in a row with a smaller id."""
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    return digests.join(first, "digest").filter("doc_id > first").select("doc_id", "twin").distinct()


def remove_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, span_starts, span_ends (word spans removed)."""
    # Not renamed or cast without need: an alias on one side only would keep Spark from seeing that two exchanges are one.
    same = doc_id == "doc_id" and docs.schema[doc_id].dataType.simpleString() == "bigint"
    docs = docs.select("doc_id" if same else F.col(doc_id).cast("bigint").alias("doc_id"), utf8(text).alias("text"))
    named = docs.filter(F.col("doc_id").isNotNull())
    digests = written(named.select("doc_id", F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("twin")), "digests")
    named, digests = with_twins(named, digests)
    copied = written(copies(digests), "copies")
    key = ["doc_id", "twin"]
    found = duplicate_spans(named, copied, window, gram).groupBy(*key).agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))
    marks = found.join(copied.withColumn("copied", F.lit(True)), key, "full")
    # Named rows alone are joined, so that this exchange of the texts is the one that found the stretches, reused.
    marked = named.join(marks, key, "left").select("doc_id", "text", "los", "his", "copied")
    rest = docs.filter(F.col("doc_id").isNull()).withColumns({"los": F.lit(None).cast("array<bigint>"), "his": F.lit(None).cast("array<bigint>"), "copied": F.lit(False)})
    return marked.unionByName(rest).mapInArrow(
        removal(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, span_starts array<bigint>, span_ends array<bigint>"
    )
