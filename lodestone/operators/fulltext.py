"""A full-text index that is kept: positional postings in Parquet, by bucket of the term, in segments.

Adding chunks makes a segment of their own: the chunks with their normalised text, the postings (term, block, ids of chunks,
positions in each), the vocabulary and the list of chunks. Ids and positions are stored as differences, in postings as bytes (``packed``), since as arrays they are twenty times as large
when they are shuffled and sorted. A row of postings covers one block of at most ``BLOCK`` chunks, so a word that stands everywhere has many rows of a bounded size and no task holds
all of them. A version of the catalogue names the segments that count; a chunk that is replaced or removed is listed as gone for
the segments it was in, and ``merge`` makes one segment of all that is left.

A query reads the folders of its words' buckets and nothing else, brings the rows of a block together and decides there which
chunks match and how they rank. Substrings of words are looked up in the vocabulary first. Chunks themselves lie in folders by a
hash of their id (shelves), so that the texts of a few candidates are fetched without reading the rest.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.io import small
from lodestone.operators import retrieval as R
from lodestone.operators.publication import Catalogue

BUCKETS, SHELVES = 64, 16
#: Bits of the number of chunks in a block.
BLOCK_BITS = 11
#: Words that are grouped at once.
WORDS = 1 << 20
TEXT, PATH = 0, 1
POSTINGS = "segment string, field int, term string, block bigint, n int, occurrences int, ids binary, sizes binary, positions binary"
TERMS = "segment string, field int, term string, bucket int, chunks bigint, occurrences bigint"
BLOCKS = "segment string, block bigint, ids array<bigint>"
GONE = "segment string, chunk_id bigint"


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    """The bucket of a term, on the driver."""
    return zlib.crc32(term.encode()) % buckets


def shelf_of(chunk: int, shelves: int = SHELVES) -> int:
    """The shelf of a chunk, on the driver."""
    return zlib.crc32(str(chunk).encode()) % shelves


def postings_of(chunks: DataFrame) -> DataFrame:
    """Postings of stored chunks (segment, block, chunk_id, search_text, path_text): a row for each term of a block. The words are found by Spark and grouped where they are read,
    a batch at a time, so only finished rows move; a block that two batches share has two rows for a term."""
    fields = ((TEXT, "search_text"), (PATH, "path_text"))
    words = [chunks.select("segment", "block", "chunk_id", F.lit(k).alias("field"), R.lexemes(F.coalesce(c, F.lit(""))).alias("words")) for k, c in fields]
    return reduce(DataFrame.unionByName, words).mapInArrow(_grouped, POSTINGS)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of words as postings, in slices of at most ``WORDS`` words but for single longer rows."""
    for batch in batches:
        ends, at = np.cumsum(batch.column("words").value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")), at + 1)
            if (part := _postings(batch.slice(at, stop - at))) is not None:
                yield part
            at = stop


def _postings(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    words = batch.column("words")
    lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    found = words.flatten().dictionary_encode()
    if not len(found):
        return None
    code = found.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ids, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk_id", "block"))
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ids, block))] = np.arange(len(ids))
    order = np.lexsort((place, rank[row], code))
    code, row, place = code[order], row[order], place[order]
    new_code = np.r_[True, code[1:] != code[:-1]]
    entry = np.flatnonzero(new_code | np.r_[True, row[1:] != row[:-1]])  # where a chunk of a term starts
    own_block, own_code = block[row[entry]], code[entry]
    posting = np.flatnonzero(np.r_[True, (own_code[1:] != own_code[:-1]) | (own_block[1:] != own_block[:-1])])
    steps = np.diff(place, prepend=0)
    steps[entry] = place[entry]
    gaps = np.diff(ids[row[entry]], prepend=0)
    gaps[posting] = ids[row[entry]][posting]
    bounds, within = np.r_[posting, len(entry)], np.r_[entry, len(code)]
    columns = [
        batch.column("segment").take(pa.array(row[entry][posting])), pa.array(np.full(len(posting), batch.column("field")[0].as_py(), np.int32)), found.dictionary.take(pa.array(own_code[posting])), pa.array(own_block[posting]),
        pa.array(np.diff(bounds).astype(np.int32)), pa.array(np.diff(within[bounds]).astype(np.int32)), packed(gaps, bounds), packed(np.diff(within), bounds), packed(steps, within[bounds]),
    ]
    return pa.record_batch(columns, ["segment", "field", "term", "block", "n", "occurrences", "ids", "sizes", "positions"])


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Whole numbers as bytes of seven bits, the sign last and the lowest first; a value of the column for each two bounds."""
    values = values.astype(np.int64)
    left = ((values << 1) ^ (values >> 63)).view(np.uint64)
    sizes = np.ones(len(left), np.int64)
    for bits in range(7, 64, 7):
        sizes += left >= np.uint64(1 << bits)
    starts = np.r_[0, np.cumsum(sizes)]
    out = np.empty(starts[-1], np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > k)
        out[starts[some] + k] = (left[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | np.where(sizes[some] > k + 1, 128, 0).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(starts[bounds].astype(np.int32)), pa.py_buffer(out)])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of each number of a column of ``packed``; nulls hold none."""
    column = column.fill_null(b"").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if bounds[0] == bounds[-1]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    ends = np.flatnonzero(data < 128)
    starts = np.r_[0, ends[:-1] + 1]
    shift = (np.arange(len(data)) - np.repeat(starts, ends - starts + 1)) * 7
    left = np.bitwise_or.reduceat((data & 127).astype(np.uint64) << shift.astype(np.uint64), starts)
    row = np.searchsorted(bounds - bounds[0], starts, "right") - 1
    return row, (left >> np.uint64(1)).view(np.int64) ^ -(left & np.uint64(1)).view(np.int64)


def differences(values: Column) -> Column:
    """The first value and each value's distance from the one before."""
    return F.transform(values, lambda v, i: F.when(i == 0, v).otherwise(v - F.get(values, i - 1)))


def decoded(row_ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and id of each entry of a column of packed differences."""
    row, steps = unpacked(row_ids)
    flat, sizes = np.cumsum(steps), np.bincount(row, minlength=len(row_ids))
    ends = np.cumsum(sizes)
    before = np.where(ends > sizes, flat[np.maximum(ends - sizes - 1, 0)], 0) if len(flat) else np.zeros(len(sizes), np.int64)
    return row, flat - np.repeat(before, sizes)


class Block:
    """The postings of a query's words in one block, decoded."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        self.all = {int(i) for steps in column("every").to_pylist() if steps for i in np.cumsum(steps)}
        self.places: dict[str, dict[int, np.ndarray]] = {}
        (row, ids), sizes, steps = decoded(column("ids")), unpacked(column("sizes"))[1], unpacked(column("positions"))[1]
        starts = np.cumsum(sizes) - sizes
        terms = table.column("term").to_pylist()
        for k, i, start, size in zip(row.tolist(), ids.tolist(), starts.tolist(), sizes.tolist(), strict=True):
            self.places.setdefault(terms[k], {})[i] = steps[start : start + size]

    def positions(self, term: str, chunk: int) -> list[int]:
        """Where a term stands in a chunk."""
        return np.cumsum(self.places[term][chunk]).tolist() if chunk in self.places.get(term, ()) else []

    def holding(self, phrase: list[str]) -> set[int]:
        """The chunks in which the words follow one another."""
        found = set.intersection(*(set(self.places.get(w, ())) for w in phrase))
        if len(phrase) == 1:
            return found
        follows = lambda c: set.intersection(*({p - k for p in self.positions(w, c)} for k, w in enumerate(phrase)))
        return {c for c in found if follows(c)}

    def matching(self, parts: list[list[tuple[bool, list[str]]]]) -> set[int]:
        """The chunks that satisfy a query."""
        out: set[int] = set()
        for part in parts:
            wanted = [self.holding(p) for negated, p in part if not negated]
            out |= (set.intersection(*wanted) if wanted else self.all) - set().union(*(self.holding(p) for negated, p in part if negated))
        return out


class TextIndex:
    """Segments of postings in a catalogue. ``buckets`` and ``shelves`` must stay what they were when the first segment was made; a query reads as many buckets as it has
    words and at most as many shelves as it has results, so there may be many of both."""

    def __init__(self, catalogue: Catalogue, buckets: int = BUCKETS, shelves: int = SHELVES):
        self.catalogue, self.spark, self.buckets, self.shelves = catalogue, catalogue.spark, buckets, shelves

    def segments(self, version: int | None = None) -> list[dict]:
        """The segments of a version."""
        return self.catalogue.entry(version)["note"].get("segments", [])

    def _tables(self, segments: list[dict]) -> dict[str, list[str]]:
        return {name: [p for s in segments for p in s[name]] for name in ("chunks", "postings", "terms", "blocks", "gone")}

    def _read(self, name: str, schema: str, segments: list[dict]) -> DataFrame:
        paths = [p for s in segments for p in s[name]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _segment(self, chunks: DataFrame, text: Column, path: Column | None) -> dict:
        """Stages a segment of chunks."""
        stage, name, nothing = self.catalogue.stage, uuid.uuid4().hex, F.lit(None).cast("string")
        shelf = (F.crc32(F.col("chunk_id").cast("string").cast("binary")) % self.shelves).cast("int")
        # The normalised text is made behind the exchange, so texts move once.
        # A shelf is written by as many tasks as its bytes ask for: one task a shelf would hold and sort ever more.
        rows = chunks.withColumn("shelf", shelf).hint("rebalance", "shelf").select("*", text.alias("search_text"), (nothing if path is None else path).alias("path_text"), F.lit(name).alias("segment")).drop("_text", "_path")
        rows = rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
        stored = stage("chunks", rows, ["shelf"])
        schema = rows.drop("shelf").schema
        shelves = self.catalogue.folders(stored)
        kept = self.spark.read.schema(schema).parquet(*(f"{stored}/shelf={k}" for k in shelves)) if shelves else self.spark.createDataFrame([], schema)
        bucket = (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int")
        dealt = postings_of(kept).drop("segment").withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "field", "term", "block").withColumn("segment", F.lit(name))
        postings = stage("postings", dealt, ["bucket"])
        found = self.spark.read.schema(POSTINGS + ", bucket int").parquet(postings)
        counts = found.groupBy("segment", "field", "term", "bucket").agg(F.sum("n").alias("chunks"), F.sum("occurrences").alias("occurrences"))
        terms = stage("terms", counts)
        listed = kept.groupBy("segment", "block").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
        blocks = stage("blocks", listed.select("segment", "block", differences(F.col("ids")).alias("ids")))
        return {"name": name, "chunks": [stored], "postings": [postings], "terms": [terms], "blocks": [blocks], "gone": [], "buckets": self.catalogue.folders(postings), "shelves": shelves, "schema": schema.json(), "rows": kept.count()}

    def _commit(self, seen: int, segments: list[dict]) -> int:
        return self.catalogue.commit(seen, self._tables(segments), {"segments": segments, "rows": {s["name"]: s["rows"] for s in segments}})

    def _marked(self, segments: list[dict], ids: DataFrame) -> list[dict]:
        """The segments with the given chunks listed as gone; rows that were listed before are not listed again."""
        hit = self.chunks(segments).select("segment", "chunk_id").join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("segment", "chunk_id")
        path = self.catalogue.stage("gone", hit)
        touched = {r.segment for r in self.spark.read.schema(GONE).parquet(path).select("segment").distinct().collect()}
        return [s | {"gone": [*s["gone"], path]} if s["name"] in touched else s for s in segments]

    def add(self, chunks: DataFrame, text: Column, path: Column | None = None) -> int:
        """Adds chunks (chunk_id, a number that no other row has, and any columns) as a segment, in place of those with the same ids; gives the version. Only their own
        postings are made. ``text``: their normalised text; ``path``: what else substrings are looked for in. After a conflict it is tried again."""
        made = self._segment(chunks, text, path)
        new = self._shelved([made], range(self.shelves))

        def step(seen: int) -> int:
            old = self.segments(seen)
            return self._commit(seen, [*(self._marked(old, new) if old and made["rows"] else old), made])

        return self.catalogue.retried(step)

    def remove(self, ids: DataFrame) -> int:
        """Removes chunks by their ids."""
        return self.catalogue.retried(lambda seen: self._commit(seen, self._marked(self.segments(seen), ids)))

    def merge(self) -> int:
        """One segment of all chunks that are left."""

        def step(seen: int) -> int:
            segments = self.segments(seen)
            rows = self.chunks(segments).withColumnsRenamed({"search_text": "_text", "path_text": "_path"}).drop("segment", "block")
            return self._commit(seen, [self._segment(rows, F.col("_text"), F.col("_path"))] if segments else [])

        return self.catalogue.retried(step)

    def _alive(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """Rows (segment, chunk_id) without those that are gone."""
        if not any(s["gone"] for s in segments):
            return rows
        paths = sorted({p for s in segments for p in s["gone"]})
        return rows.join(small(self.spark.read.schema(GONE).parquet(*paths)), ["segment", "chunk_id"], "left_anti")

    def chunks(self, segments: list[dict] | None = None) -> DataFrame:
        """The chunks that count, with segment, block, search_text and path_text."""
        segments = self.segments() if segments is None else segments
        return self._shelved(segments, range(self.shelves))

    def fetch(self, ids: list[int]) -> DataFrame:
        """The chunks with the given ids, from their shelves."""
        return self._shelved(self.segments(), {shelf_of(i, self.shelves) for i in ids}).filter(F.col("chunk_id").isin(*ids))

    def _shelved(self, segments: list[dict], shelves: Iterable[int]) -> DataFrame:
        """The chunks of some shelves that count, with the columns of the newest segment; what older ones lack is null."""
        schema = StructType.fromJson(json.loads(segments[-1]["schema"])) if segments else "chunk_id bigint, segment string"
        paths = [f"{p}/shelf={k}" for s in segments for p in s["chunks"] for k in sorted({*shelves} & {*s["shelves"]})]
        return self._alive(self.spark.read.schema(schema).parquet(*paths), segments) if paths else self.spark.createDataFrame([], schema)

    def vocabulary(self) -> DataFrame:
        """Terms by segment; counts include chunks that are gone."""
        return self._read("terms", TERMS, self.segments())

    def postings(self, terms: list[str], segments: list[dict], field: int = TEXT) -> DataFrame:
        """The rows of the given terms, read from the folders of their buckets."""
        wanted = {bucket_of(t, self.buckets) for t in terms}
        paths = [f"{p}/bucket={b}" for s in segments for p in s["postings"] for b in sorted(wanted & set(s["buckets"]))]
        if not paths:
            return self.spark.createDataFrame([], POSTINGS)
        return self.spark.read.schema(POSTINGS).parquet(*paths).filter((F.col("field") == field) & F.col("term").isin(*terms))

    def match(self, query: str) -> DataFrame:
        """(chunk_id, rank): the chunks whose text satisfies a web-style query, with their cover density."""
        segments, parts = self.segments(), R.parse_websearch(query)
        terms = sorted({w for part in parts for _, phrase in part for w in phrase})
        if not terms or not segments:
            return self.spark.createDataFrame([], "chunk_id bigint, rank double")
        rows = self.postings(terms, segments).select("segment", "block", "term", "ids", "sizes", "positions", F.lit(None).cast("array<bigint>").alias("every"))
        if any(all(negated for negated, _ in part) for part in parts):
            everything = self._read("blocks", BLOCKS, segments)
            rows = rows.unionByName(everything.select("segment", "block", F.lit(None).cast("string").alias("term"), *(F.lit(None).cast("binary").alias(c) for c in ("ids", "sizes", "positions")), F.col("ids").alias("every")))
        alternatives = [[w for negated, phrase in part if not negated for w in phrase] for part in parts]
        counted = sorted({w for a in alternatives for w in a})

        def decide(table: pa.Table) -> pa.Table:
            block = Block(table)
            found = sorted(block.matching(parts))
            ranks = [R.cover_density({w: block.positions(w, c) for w in counted}, alternatives) for c in found]
            segment = table.column("segment")[0].as_py()
            return pa.table({"segment": pa.array([segment] * len(found), pa.string()), "chunk_id": pa.array(found, pa.int64()), "rank": pa.array(ranks, pa.float64())})

        found = rows.groupBy("segment", "block").applyInArrow(decide, "segment string, chunk_id bigint, rank double")
        return self._alive(found, segments).select("chunk_id", "rank")

    def lane(self, query: str, k: int) -> DataFrame:
        """The best ``k`` chunks of ``match``."""
        return self.match(query).orderBy(F.desc("rank"), "chunk_id").limit(k)

    def substring_hits(self, words: list[str]) -> DataFrame:
        """(chunk_id, hits) of chunks that hold one of the words in text or path, as ``term_hits`` counts: words of three characters or more, repeats count. Words of
        letters and digits alone lie within terms, so the vocabulary knows all terms that hold them; others are looked for in the stored texts."""
        segments, times = self.segments(), Counter(w for w in words if len(w) >= 3)
        if not times or not segments:
            return self.spark.createDataFrame([], "chunk_id bigint, hits bigint")
        inner, across = [w for w in times if re.fullmatch(r"[^\W_]+", w)], [w for w in times if not re.fullmatch(r"[^\W_]+", w)]
        sides = []
        if inner:
            held = F.filter(F.array(*map(F.lit, inner)), lambda w: F.contains(F.col("term"), w))
            terms = self._read("terms", TERMS, segments).select("segment", "field", "term", "bucket", held.alias("words")).filter(F.size("words") > 0)
            buckets = [r.bucket for r in terms.select("bucket").distinct().collect()]
            paths = [f"{p}/bucket={b}" for s in segments for p in s["postings"] for b in sorted(buckets) if b in s["buckets"]]
            if paths:
                rows = self.spark.read.schema(POSTINGS).parquet(*paths).select("segment", "field", "term", "block", "ids").join(small(terms.drop("bucket")), ["segment", "field", "term"])
                sides.append(rows.select("segment", "block", "words", "ids").groupBy("segment", "block").applyInArrow(_hits(times), "segment string, chunk_id bigint, hits bigint"))
        if across:
            like = lambda w: F.col("search_text").like(f"%{w}%") | F.coalesce(F.col("path_text").like(f"%{w}%"), F.lit(False))
            hits = sum((F.when(like(w), times[w]).otherwise(0) for w in across), F.lit(0)).cast("bigint")
            sides.append(self.chunks(segments).select("segment", "chunk_id", hits.alias("hits")).filter("hits > 0"))
        if not sides:
            return self.spark.createDataFrame([], "chunk_id bigint, hits bigint")
        found = self._alive(reduce(DataFrame.unionByName, sides), segments)
        return (found.groupBy("segment", "chunk_id").agg(F.sum("hits").alias("hits")) if len(sides) > 1 else found).select("chunk_id", "hits")


def _hits(times: Counter):
    """The rows of a block (words that their term holds, ids) as the hits of each chunk; a word counts once for a chunk, with its weight."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        row, ids = decoded(table.column("ids").combine_chunks())
        chunks, at = np.unique(ids, return_inverse=True)
        total = np.zeros(len(chunks), np.int64)
        held = table.column("words").to_pylist()
        for word, weight in times.items():
            rows = np.array([word in x for x in held], bool)
            total[np.unique(at[rows[row]])] += weight
        return pa.table({"segment": pa.array([table.column("segment")[0].as_py()] * len(chunks), pa.string()), "chunk_id": pa.array(chunks), "hits": pa.array(total)})

    return run
