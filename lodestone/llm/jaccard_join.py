"""Operator 6: documents whose sets of word shingles have a Jaccard similarity of at least ``percent`` / 100, as components.

Each set becomes a point: its shingles are hashed into groups and the groups are counted. The sum over the groups of the
smaller count bounds the overlap of two sets from above; an R-tree over the points carries, in each node, the largest
count of every group and the range of sizes, so whole subtrees are left out. Pairs that survive are verified on the sets.

So that no task sees all points, a pair meets only where it must: two sets this similar share at least k of their first
n - ceil(n * percent / 100) + k shingles in any order common to all. k grows with the size (one more for every ``MORE``
shingles), so a text goes on only if it shares that many, which a common passage alone doesn't give. The order is the
hash, with the most frequent shingles (``HEAVY`` at most, counted over all documents) last, so that common lines don't
bring strangers together; which shingles are last changes the work, never the result.

1. A scan gives each document's size and digest, and frequent shingles. Equal word sequences stand for one *text* from here.
2. A scan gives the first shingles of each text; those of one text only are dropped, then texts that share too few, and
   shingles shared by the same texts become one route.
3. In each route an R-tree leaves pairs that may be similar, of which a spanning forest goes on; so do, for each text that
   has a route, its words, once. Of a route of more than ``BLOCK`` texts all go on, as any two of them may be similar.
4. The components of those forests hold all links. Each is verified by R-tree and union-find, where texts that are already
   connected are not compared. A component of more than ``BLOCK`` texts is verified in blocks: two rounds of random blocks
   connect most of it, then every text outside its largest class meets every other one, block by block.

A pair is accepted on the shingles themselves; hashes find it. No task holds more than two blocks, which are bounded by texts and by bytes, however large a group is;
the number of block pairs grows with the texts that the largest class of a component leaves out.

Rows are told apart by their number in the scan of the files, so nothing depends on ids but what is reported; that two scans
number them alike is checked by the texts' digests.

Results for odd input: null or empty text has no shingles, size 0 and its own id as component; one to four words are one
shingle; repeated rows share their component, and different texts under one id are told apart; a row without an id links like any
other, and its component is null only if no row that it reaches has an id; ids must be numbers; an empty table gives no rows;
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
from lodestone.llm.common import flags_of_repeats, int64, slices, unused, utf8
from lodestone.llm.components import components
from lodestone.llm.kernels import U64, groups_of, mixed, tokens, word_grams

WORDS = 5
PERCENT = 80
#: Frequent shingles that the order puts last, and the count within a batch from which a shingle may be one. Both only
#: change the work.
HEAVY = 1 << 16
HEAVY_IN_BATCH = 16
#: Rows of a route that are held to name it by its texts; a longer one is named by its shingle.
ROUTE = 1 << 16
FANOUT = 16
#: Texts in a block of a route or of a component; a task holds two blocks at most.
BLOCK = 1 << 12
#: Bytes of text in a block of a component, about, and shingles that a task keeps as words to compare them.
BYTES = 1 << 24
EXACT = 1 << 18
#: Rounds of random blocks before those of a large component meet one another.
MIXED = 2
#: A size's shingles for each further shingle that must be shared.
MORE = 25


def lowered(text: bytes) -> bytes:
    """The words in lower case (A-Z), joined by one space."""
    return b" ".join(text.lower().split())


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of ``lowered`` words."""
    out: list[np.ndarray] = []
    for k in range(0, len(texts), 64):
        part = texts[k : k + 64]
        sizes = np.array([x.count(b" ") + 1 if x else 0 for x in part], np.int64)
        h = tokens(np.frombuffer(b"\n".join(x for x in part if x), np.uint8))[2]
        grams = word_grams(h, words)
        at = 0
        for size in sizes.tolist():
            if size >= words:
                out.append(np.unique(grams[at : at + size - words + 1]))
            elif size:
                whole = np.array([size], U64)
                for x in h[at : at + size]:
                    whole = mixed(whole * U64(31) + x)
                out.append(whole)
            else:
                out.append(np.zeros(0, U64))
            at += size
    return out


def shapes(words: int):
    """For each row its id, size and digest (kind 0), and in the place of the row shingles that are frequent in a batch (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 2048, 1 << 23)):
            texts = [lowered(x) for x in batch.column("text").to_pylist()]
            digest = [hashlib.blake2b(x, digest_size=16).digest() for x in texts]
            first: dict[bytes, int] = {}
            for i, d in enumerate(digest):
                first.setdefault(d, i)
            sizes, frequent = np.zeros(len(texts), np.int64), []
            sets = shingles([texts[i] for i in first.values()], words)
            by = {d: len(s) for d, s in zip(first, sets, strict=True)}
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            frequent.append((values[counts >= HEAVY_IN_BATCH], counts[counts >= HEAVY_IN_BATCH]))
            sizes[:] = [by[d] for d in digest]
            n = len(texts)
            yield pa.record_batch([pa.array(np.zeros(n, np.int8)), batch.column("row"), batch.column("id"), pa.array(digest, pa.binary()), pa.array(sizes)], ["kind", "row", "id", "digest", "n"])
            for values, counts in frequent:
                if len(values):
                    m = len(values)
                    yield pa.record_batch([pa.array(np.ones(m, np.int8)), pa.array(values.view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(counts.astype(np.int64))], ["kind", "row", "id", "digest", "n"])

    return run


def first_shingles(words: int, percent: int, heavy: np.ndarray):
    """The shingles of each text that a similar text must share some of. ``heavy``: sorted shingles that come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = int64(batch.column("row"))
            texts = batch.column("text")
            seen: dict[bytes, int] = {}
            for i in np.argsort(ids, kind="stable").tolist():
                low = lowered(texts[i].as_py())
                if low.count(b" ") >= words - 1:
                    seen.setdefault(hashlib.blake2b(low, digest_size=8).digest(), i)
            own = list(seen.items())
            for k in range(0, len(own), 512):
                part = own[k : k + 512]
                chosen = []
                for s in shingles([lowered(texts[i].as_py()) for _, i in part], words):
                    if len(heavy):
                        last = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
                        s = np.concatenate((s[~last], s[last]))
                    chosen.append(s[: len(s) - (len(s) * percent + 99) // 100 + 1 + len(s) // MORE])
                sizes = [len(s) for s in chosen]
                text = np.frombuffer(b"".join(d for d, _ in part), np.int64)
                yield pa.record_batch([pa.array(np.concatenate(chosen).view(np.int64)), pa.array(np.repeat(text, sizes)), pa.array(np.repeat(ids[[i for _, i in part]], sizes))], ["token", "text", "row"])

    return run


def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, row) from rows sorted by token, text and row: tokens of two texts at least; tokens of the same texts give
    the same route."""
    held: tuple[np.ndarray, ...] | None = None
    long = None  # a token whose rows have begun to go out already
    previous = None  # its last text

    def emit(token: int, docs: np.ndarray, named: bool) -> pa.RecordBatch:
        ordered = np.sort(docs)
        name = token if named else int.from_bytes(hashlib.blake2b(ordered.tobytes(), digest_size=8).digest(), "little", signed=True)
        return pa.record_batch([pa.array(np.full(len(docs), name)), pa.array(docs)], ["route", "row"])

    out: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = tuple(int64(batch.column(c)) for c in ("token", "text", "row"))
        if held is not None:
            columns = tuple(np.concatenate(x) for x in zip(held, columns, strict=True))
        token, text, doc = columns
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (text[1:] != text[:-1])))
        if long == token[0] and previous == text[0]:
            fresh[0] = False
        starts, ends = groups_of(token)
        for a, b in zip(starts[:-1].tolist(), ends[:-1].tolist(), strict=True):
            docs = doc[a:b][fresh[a:b]]
            if long == token[a] or len(docs) > 1:
                out.append(emit(int(token[a]), docs, long == token[a]))
        a = int(starts[-1])
        held = tuple(x[a:] for x in columns)
        if len(held[0]) > ROUTE:
            docs = doc[a:][fresh[a:]]
            out.append(emit(int(token[a]), docs, True))
            long, previous = token[a], text[-1]
            held = None
        yield from joined(out)
        out = []
    if held is not None and len(held[0]):
        token, text, doc = held
        fresh = np.concatenate(([True], text[1:] != text[:-1]))
        if long == token[0] and previous == text[0]:
            fresh[0] = False
        docs = doc[fresh]
        if long == token[0] or len(docs) > 1:
            yield emit(int(token[0]), docs, long == token[0])


def joined(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many small batches as one."""
    if batches:
        yield from pa.Table.from_batches(batches).combine_chunks().to_batches()


def groups_for(size: int) -> int:
    """Groups of the count vector: a power of two that leaves about four shingles in a group, 64 to 4096."""
    return min(4096, max(64, 1 << max(0, (size // 4 - 1)).bit_length()))


def point(s: np.ndarray) -> np.ndarray:
    """The count vector of a set; the counts of very large ones need four bytes."""
    groups = groups_for(len(s))
    return np.bincount((s & U64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint16 if len(s) < 1 << 16 else np.uint32)


def point_of(data: bytes, size: int) -> np.ndarray:
    """The count vector from its bytes."""
    return np.frombuffer(data, np.uint16 if size < 1 << 16 else np.uint32)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A count vector over fewer groups."""
    return p.reshape(-1, groups).sum(0, dtype=np.uint32) if len(p) > groups else p.astype(np.uint32)


class Tree:
    """An R-tree over count vectors, packed by size: each node keeps the largest count of every group and its sizes' range."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        self.order = np.argsort(sizes, kind="stable")
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def near(self, p: np.ndarray, size: int) -> np.ndarray:
        """The points that may be similar, the highest bound first."""
        alive = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            alive = alive[(high[alive] * 100 >= size * self.percent) & (low[alive] * self.percent <= size * 100)]
            bound = np.minimum(top[alive], p).sum(1, dtype=np.int64)
            ok = bound * (100 + self.percent) >= (low[alive] + size) * self.percent
            alive, bound = alive[ok], bound[ok]
            if depth:
                alive = (alive[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                alive = alive[alive < len(self.levels[depth - 1][0])]
        return self.order[alive[np.argsort(-bound, kind="stable")]]


class Classes:
    """Classes of connected points. ``root`` is kept exact, the smaller class being renamed at each union."""

    def __init__(self, labels: np.ndarray):
        _, self.root = np.unique(labels, return_inverse=True)
        order = np.argsort(self.root, kind="stable")
        self.members = {int(self.root[order[a]]): order[a:b].tolist() for a, b in zip(*groups_of(self.root[order]), strict=True)}

    def join(self, i: int, j: int) -> None:
        """Connects the classes of two points."""
        a, b = int(self.root[i]), int(self.root[j])
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.root[moved] = a
        self.members[a] += moved


def forest(points: list[np.ndarray], sizes: np.ndarray, percent: int, similar=None, labels: np.ndarray | None = None, asked: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Class of each point and the pairs that join them: pairs that the bound leaves and, if given, ``similar`` accepts. Points of
    equal ``labels`` are connected from the start; with ``asked``, one point of a pair at least must be."""
    classes = Classes(np.arange(len(points)) if labels is None else labels)
    edges: list[tuple[int, int]] = []
    by = np.argsort(sizes, kind="stable")
    lo = 0
    # Points are compared within windows of similar size, so vectors there have like numbers of groups.
    limits = []
    while lo < len(by):
        hi = int(np.searchsorted(sizes[by], 2 * int(sizes[by[lo]]) + 1, "right"))
        limits.append((lo, hi, int(np.searchsorted(sizes[by], -(-(2 * int(sizes[by[lo]]) + 1) * 100 // percent), "right"))))
        lo = hi
    for lo, hi, reach in limits:
        window = by[lo:reach]
        if len(window) < 2:
            continue
        groups = min(len(points[i]) for i in window)
        matrix = np.stack([folded(points[i], groups) for i in window])
        tree = Tree(matrix, sizes[window], percent)
        for q in range(min(hi - lo, len(window))):
            i = int(window[q])
            if (classes.root[window] == classes.root[i]).all():
                continue
            near = tree.near(matrix[q], int(sizes[i]))
            near = window[near[near > q]]  # the other pairs have been asked from their other end
            if asked is not None and not asked[i]:
                near = near[asked[near]]
            while len(near := near[classes.root[near] != classes.root[i]]):
                j, near = int(near[0]), near[1:]
                if similar is None or similar(i, j):
                    edges.append((i, j))
                    classes.join(i, j)
    return classes.root, edges


def members(words: int):
    """Each text that has a route: size, count vector, digest and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 512, 1 << 22):
                texts = [lowered(x) for x in part.column("text").to_pylist()]
                sets = shingles(texts, words)
                digests = [hashlib.blake2b(x, digest_size=16).digest() for x in texts]
                yield pa.record_batch([part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([point(s).tobytes() for s in sets], pa.binary()), pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], ["row", "n", "counts", "digest", "words"])

    return run


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, from batches sorted by the key columns."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [int64(batch.column(key)) for key in keys]
        new = np.zeros(batch.num_rows, bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        starts = np.concatenate(([0], np.flatnonzero(new)))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield whole()
                held.clear()
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield whole()


def stars(doc: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text of a class of two at least with the least id of its class."""
    least = np.full(len(doc), np.iinfo(np.int64).max)
    np.minimum.at(least, root, doc)
    other = doc != least[root]
    return doc[other], least[root][other]


def candidates(percent: int):
    """Pairs (a, b) that join the texts which the bound leaves together in each route. A route that is too large for one tree comes in blocks, whose texts are
    all tied to the route's first one: any two of them may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows in grouped(batches, ["route", "block"]):
            row, n, hub = (int64(rows.column(c)) for c in ("row", "n", "hub"))
            if (row == hub).all():  # of a route in one block each text is its own hub
                points = [point_of(x, size) for x, size in zip(rows.column("counts").to_pylist(), n.tolist(), strict=True)]
                row, hub = stars(row, forest(points, n, percent)[0])
            a.append(row)
            b.append(hub)
            if len(a) > 10_000:
                yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def links(words: int, percent: int, pairs: bool):
    """Links (a, b) that connect the texts of each block, by the shingles; texts of one label are connected already. With
    ``pairs``, a block holds two sides, and one text of a pair at least must be of the first, ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["component", "block", "other"] if pairs else ["component", "block"]):
            doc, label = int64(rows.column("row")), int64(rows.column("label"))
            texts = rows.column("words").to_pylist()
            sets = shingles(texts, words)
            exact: dict[int, set] = {}

            def content(i: int, texts=texts, exact=exact) -> set:
                if i not in exact:
                    w = texts[i].split(b" ")
                    exact[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
                    while len(exact) > 2 and sum(map(len, exact.values())) > EXACT:
                        exact.pop(next(iter(exact)))
                return exact[i]

            def enough(both: int, either: int) -> bool:
                return 100 * both >= percent * (either - both)

            def similar(i: int, j: int, sets=sets, content=content) -> bool:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if not enough(both, len(sets[i]) + len(sets[j])):
                    return False
                x, y = content(i), content(j)
                return enough(len(x & y), len(x) + len(y))

            asked = rows.column("asked").to_numpy(zero_copy_only=False).astype(bool) if pairs else None
            root, edges = forest([point(s) for s in sets], np.array([len(s) for s in sets], np.int64), percent, similar, label, asked)
            if edges:
                a, b = stars(doc, root)
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def verified(taking: DataFrame, linked: DataFrame, words: int, percent: int) -> DataFrame:
    """(row, component): the texts of the candidate components ``linked`` with the smallest row that true links reach."""
    blocks = lambda size, bytes_: F.ceil(F.greatest(size / BLOCK, bytes_ / BYTES)).cast("bigint")
    linked = linked.withColumnRenamed("node", "row")
    sizes = taking.select("row", F.length("words").alias("bytes")).join(linked, "row").groupBy("component").agg(blocks(F.count("*"), F.sum("bytes")).alias("blocks"))
    sets = taking.select("row", "words").join(linked, "row").join(sizes, "component")
    by = ["component", "block"]
    pair = "a bigint, b bigint"

    def in_blocks(rows: DataFrame, turn: int) -> DataFrame:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(turn)), F.col("blocks")))
        return rows.repartition(*by).sortWithinPartitions(*by, "row").select(*by, "row", "label", "words").mapInArrow(links(words, percent, False), pair)

    found = written(in_blocks(sets.withColumn("label", F.col("row")), 0), "links")
    large = written(sets.filter("blocks > 1"), "large-components")
    if not large.isEmpty():
        # Only components of several blocks go on. What is connected is not compared again.
        def labelled(links: DataFrame) -> DataFrame:
            known = components(links, "labels").withColumnRenamed("node", "row").withColumnRenamed("component", "label")
            return large.join(known, "row", "left").withColumn("label", F.coalesce("label", "row"))

        for turn in range(1, MIXED):
            found = found.unionByName(written(in_blocks(labelled(found), turn), "links"))
        rows = written(labelled(found), "large-components")
        classes = rows.groupBy("component", "label").agg(F.count("*").alias("n"), F.sum(F.length("words")).alias("bytes"))
        largest = classes.groupBy("component").agg(F.max(F.struct("n", "label", "bytes")).alias("most"), F.sum("n").alias("all"), F.sum("bytes").alias("bytes"))
        largest = largest.select("component", F.col("most.label").alias("main"), blocks(F.col("all") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("asking"))
        rows = rows.join(largest, "component").filter("asking > 0").withColumn("out", F.col("label") != F.col("main"))
        # Each block of outsiders meets each block of all texts.
        block, other = F.pmod(F.xxhash64("row", F.lit("o")), F.col("asking")), F.pmod(F.xxhash64("row"), F.col("blocks"))
        asked = rows.filter("out").select("component", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"), "row", "label", "words", F.lit(1).alias("asked"))
        others = rows.select("component", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("asking") - 1)).alias("block"), other.alias("other"), "row", "label", "words", F.lit(0).alias("asked"))
        three = [*by, "other"]
        met = asked.unionByName(others).repartition(*three).sortWithinPartitions(*three, F.desc("asked"), "row")
        found = found.unionByName(written(met.select(*three, "row", "label", "words", "asked").mapInArrow(links(words, percent, True), pair), "links"))
    return components(found, "components").withColumnRenamed("node", "row")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: row (its number), id, n_shingles, component (the smallest id reachable by links) and kept (whether it stays of its class: the one with the
    smallest id, the first of these; rows without an id only where no other is left)."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), utf8(text).alias("text"))
    shape = written(docs.mapInArrow(shapes(words), "kind tinyint, row bigint, id bigint, digest binary, n bigint"), "shapes")
    frequent = shape.filter("kind = 1").groupBy("row").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "row").limit(HEAVY)
    heavy = np.sort(np.array([r.row for r in frequent.collect()], np.int64).view(U64))
    rows = shape.filter("kind = 0").drop("kind")
    tokens_of = docs.select("row", "text").mapInArrow(first_shingles(words, percent, heavy), "token bigint, text bigint, row bigint")
    shared = tokens_of.repartition("token").sortWithinPartitions("token", "text", "row").mapInArrow(lambda b: routes(flags_of_repeats(b, "token")), "route bigint, row bigint")
    # A similar text has percent / 100 of the size at least, so this many shared shingles follow from its own k.
    least = 1 + F.floor(F.col("n") * percent / (100 * MORE))
    shared = shared.groupBy("row").agg(F.collect_set("route").alias("routes"), F.count("*").alias("met"))
    shared = written(shared.join(rows.select("row", "n", "digest"), "row").filter(F.col("met") >= least).select("row", "routes", F.col("digest").alias("expected")), "routes")
    taking = docs.select("row", "text").join(small(shared.select("row")), "row", "left_semi").mapInArrow(members(words), "row bigint, n bigint, counts binary, digest binary, words binary")
    taking = written(taking, "members")
    shared = shared.join(taking.select("row", "digest"), "row").filter(F.when(F.col("digest") == F.col("expected"), True).otherwise(F.raise_error(F.lit("the files were split otherwise in a second scan")).cast("boolean"))).select("row", "routes")
    each = shared.select(F.explode("routes").alias("route"), "row")
    hot = written(each.groupBy("route").agg(F.count("*").alias("rows"), F.min("row").alias("hub")).filter(F.col("rows") > BLOCK).select("route", "hub", F.ceil(F.col("rows") / BLOCK).cast("bigint").alias("blocks")), "hot-routes")
    met = taking.select("row", "n", "counts").join(shared, "row").select(F.explode("routes").alias("route"), "row", "n", "counts").join(small(hot), "route", "left")
    met = met.withColumn("block", F.coalesce(F.pmod(F.xxhash64("row"), F.col("blocks")), F.lit(0))).withColumn("hub", F.coalesce("hub", "row"))
    met = met.repartition("route", "block").sortWithinPartitions("route", "block", "row").select("route", "block", "row", "n", "counts", "hub")
    linked = components(met.mapInArrow(candidates(percent), "a bigint, b bigint"), "candidates")
    found = verified(taking, linked, words, percent).withColumnRenamed("row", "first")
    # One row for each text: its first row, and the row that would stay; then the same for each class.
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    texts = rows.groupBy("digest").agg(F.min("row").alias("first"), best, F.max("n").alias("n"))
    texts = written(texts.join(found.distinct(), "first", "left").select("digest", "best", F.coalesce("component", "first").alias("class")), "text-classes")
    whole = texts.groupBy("class").agg(F.min("best").alias("best"))
    texts = texts.select("digest", "class").join(whole, "class").select("digest", "best")
    empty = F.col("n") == 0
    out = rows.join(texts, "digest").select("row", "id", F.col("n").alias("n_shingles"), F.when(empty, F.col("id")).otherwise(F.col("best.id")).alias("component"), (empty | (F.col("row") == F.col("best.row"))).alias("kept"))
    return out


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    found = classes(docs, text, doc_id, words, percent)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with the columns of ``docs``. Rows go by their number, not by their id: another text under the id of one that goes stays.
    ``docs`` must be read from files, which two scans number alike; a number that meets another id is an error."""
    gone = written(classes(docs, text, doc_id, words, percent).filter(~F.col("kept")).select("row", "id"), "near-copies")
    row, gone_row, gone_id = (unused(docs, c) for c in ("_row", "_gone_row", "_gone_id"))
    gone = small(gone.select(F.col("row").alias(gone_row), F.col("id").alias(gone_id)))
    same = F.when(F.col(doc_id).cast("bigint").eqNullSafe(F.col(gone_id)), True).otherwise(F.raise_error(F.lit("the files were split otherwise in a second scan")).cast("boolean"))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(gone, (F.col(row) == F.col(gone_row)) & same, "left_anti").select(*docs.columns)
