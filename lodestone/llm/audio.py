"""Operator 4: media columns. Chroma fingerprints of audio, and alignment of recordings by them.

Samples become pitch-class frames: the power of each short-time spectrum is summed by semitone class, smoothed over time and
scaled to unit length. On the frames' integral image a fixed set of box filters (differences of sums over time and pitch
classes) is evaluated; each filter's response falls into one of four levels, written as a Gray code of two bits, and
sixteen filters make one packed 32-bit integer for each place. Two recordings align at the offset with the least rate of
differing bits over the overlap, and that rate decides.

Recordings with equal fingerprints form a class, so copies are compared once; a recording's class and the class's
matches are what is returned. Every class with a query is compared with every other class at every offset, without
candidates that could be missed: bits are +1 and -1, and the sums of their products at all offsets come from Fourier transforms of
blocks of recordings. Where many short fingerprints have one length, the transforms there and back are matrix products, and two
recordings share a number; the pairs whose sums reach the bound, less what rounding may take, are then counted bit by bit.
Places that are silent in both recordings say nothing, so silence matches only itself.

Results for odd input: null or unreadable media, and audio too short for one integer, have an empty fingerprint and no class
or match; ties of offsets go to the longer overlap, then the smallest offset; repeated rows share their class; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.io import written

RATE = 8000
FRAME = 2048
HOP = 512
SMOOTH = 3
#: Box filters: kind, first pitch class, pitch classes, frames; thresholds are quartiles of responses to noise. Drawn once from a
#: fixed seed, so fingerprints of different runs compare.
_DRAW = np.random.Generator(np.random.PCG64(404))
WIDTH = 16
FILTERS = [(int(_DRAW.integers(0, 5)), int(_DRAW.integers(0, 9)), int(_DRAW.integers(2, 5)) & ~1, int(_DRAW.choice([4, 8, 12, 16]))) for _ in range(16)]
LEVELS = (-0.06, 0.0, 0.06)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Share of bits that may differ for a match; integers, not silent in both, that must overlap.
MAX_ERROR = 0.25
MIN_OVERLAP = 16
#: Integers in a block of queries and in one of others, about; a task compares two blocks.
QUERY_PLACES = 1 << 17
OTHER_PLACES = 1 << 17
#: Longest fingerprints that are compared in groups of one length, and the recordings that make a group.
SHORT = 126
GROUP = 16
#: Longest fingerprints of which two share a number: sums of agreeing less half of all bits, less their bound, lie within 1024 then.
PAIRED = 42
SHARE = 2048
#: What rounding may take from such a sum; 1 is the most that was seen with PAIRED places, bits all alike included.
SLACK = 8
#: Pairs of recordings whose sums are in memory at once, by queries and others.
TILE = (128, 128)
#: Added to a sum below 2**22, it leaves the sum's whole part in the low bits of a 32-bit float; this bit is set if the sum isn't negative.
WHOLE, NOT_NEGATIVE = float(3 << 22), 1 << 22
_FREQUENCY = np.fft.rfftfreq(FRAME, 1 / RATE)
_USED = np.flatnonzero((_FREQUENCY >= 55) & (_FREQUENCY <= 3520))
_TO_CLASS = np.eye(12)[np.round(12 * np.log2(_FREQUENCY[_USED] / 440)).astype(int) % 12]
_WINDOW = np.hanning(FRAME)
#: Frames whose fingerprints are made at once, about.
FRAMES = 1 << 15


def samples(media: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a 16-bit WAV file."""
    with wave.open(io.BytesIO(media)) as file:
        if file.getsampwidth() != 2:
            raise ValueError("16-bit samples are expected")
        data = np.frombuffer(file.readframes(file.getnframes()), "<i2").astype(float)
        channels, rate = file.getnchannels(), file.getframerate()
        if not 1000 <= rate <= 400_000:
            raise ValueError("a rate of 1 to 400 kHz is expected")
        return data[: len(data) // channels * channels].reshape(-1, channels).mean(1), rate


def chroma(sound: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames of twelve pitch classes, of unit length where there is sound."""
    if rate != RATE and len(sound):
        sound = np.interp(np.arange(0, len(sound), rate / RATE), np.arange(len(sound)), sound)
    n = (len(sound) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(sound, FRAME)[::HOP]
    out = np.empty((n, 12))
    for k in range(0, n, 256):
        found = np.fft.rfft(frames[k : k + 256] * _WINDOW)[:, _USED[0] : _USED[-1] + 1]
        out[k : k + 256] = (found.real**2 + found.imag**2) @ _TO_CLASS
    sums = np.cumsum(np.vstack((np.zeros(12), out)), 0)
    out = sums[SMOOTH:] - sums[:-SMOOTH] if n >= SMOOTH else out
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """A packed integer for each place at which all filters fit."""
    return fingerprints_of(frames[None])[0]


def fingerprints_of(frames: np.ndarray) -> np.ndarray:
    """The same for recordings of one length: (recording, place) of (recording, frame, pitch class)."""
    n = frames.shape[1] - WIDTH + 1
    if n < 1:
        return np.zeros((len(frames), 0), np.uint32)
    image = np.zeros((13, len(frames), frames.shape[1] + 1))
    image[1:, :, 1:] = frames.transpose(2, 0, 1).cumsum(2).cumsum(0)

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return (image[p1, :, t1 : t1 + n] - image[p1, :, t0 : t0 + n] - image[p0, :, t1 : t1 + n] + image[p0, :, t0 : t0 + n]) / ((t1 - t0) * (p1 - p0))

    out = np.zeros((len(frames), n), np.uint32)
    for kind, low, high, time in FILTERS:
        p, q, half = low, min(12, low + high), time // 2
        mid = (p + q) // 2
        if kind == 0:
            value = box(0, time, p, q) - box(0, time, 0, 12)
        elif kind == 1:
            value = box(0, time, p, mid) - box(0, time, mid, q)
        elif kind == 2:
            value = box(0, half, p, q) - box(half, time, p, q)
        elif kind == 3:
            value = (box(0, half, p, mid) + box(half, time, mid, q) - box(0, half, mid, q) - box(half, time, p, mid)) / 2
        else:
            value = box(time // 4, 3 * time // 4, p, q) - (box(0, time // 4, p, q) + box(3 * time // 4, time, p, q)) / 2
        out = out << np.uint32(2) | GRAY[np.digitize(value, LEVELS)]
    return out


#: The integer of a place without sound.
SILENT = fingerprint(np.zeros((WIDTH, 12)))[0]


def fingerprints(media: DataFrame, key: str, column: str, decode: Callable[[object], tuple[np.ndarray, int]] = samples) -> DataFrame:
    """(key, prints, class): packed integers (array<bigint>) and a digest of them, null without any. ``decode`` turns a value of
    the media column into samples and their rate."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, prints, heard, n = batch.slice(k, 256), [np.zeros(0, np.int64)] * min(256, batch.num_rows - k), {}, 0
                for i, value in enumerate(part.column("media")):
                    try:
                        frames = chroma(*decode(value.as_py())) if value.is_valid else np.zeros((0, 12))
                    except (ValueError, EOFError, ArithmeticError, wave.Error, struct.error):
                        continue
                    heard.setdefault(len(frames), []).append((i, frames))
                    n += len(frames)
                    if n >= FRAMES:
                        put(prints, heard)
                        heard, n = {}, 0
                put(prints, heard)
                names = [hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() if len(x) else None for x in prints]
                ends = np.cumsum([0, *map(len, prints)], dtype=np.int32)
                yield pa.record_batch([part.column(key), pa.ListArray.from_arrays(ends, np.concatenate(prints)), pa.array(names, pa.string())], [key, "prints", "class"])

    def put(prints: list[np.ndarray], heard: dict[int, list[tuple[int, np.ndarray]]]) -> None:
        for same in heard.values():
            for (i, _), found in zip(same, fingerprints_of(np.stack([x for _, x in same])), strict=True):
                prints[i] = found.astype(np.int64)

    return media.select(key, F.col(column).alias("media")).mapInArrow(run, f"{key} {kind}, prints array<bigint>, class string")


def classes(prints: DataFrame, key: str) -> DataFrame:
    """(class, rep, n, is_query, prints): one row for each fingerprint; ``is_query`` if a recording of it has an id divisible by 20."""
    found = prints.filter(F.col("class").isNotNull())
    return found.groupBy("class").agg(F.min(key).alias("rep"), F.count("*").alias("n"), F.bool_or(F.coalesce(F.col(key) % 20 == 0, F.lit(False))).alias("is_query"), F.first("prints").alias("prints"))


def batches(prints: list[np.ndarray], most: int) -> Iterator[np.ndarray]:
    """Places of fingerprints of like length, fewer of them where they are long."""
    powers = np.array([max(64, 1 << (len(x) - 1).bit_length()) for x in prints], np.int64)
    for power in np.unique(powers):
        at, size = np.flatnonzero(powers == power), max(1, int(most * 64 // power))
        for k in range(0, len(at), size):
            yield at[k : k + size]


def spectra(prints: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(frequency, recording, bit) of the bits as +1 and -1, the lengths, and the spectra of the silent places, if any."""
    signs, quiet = np.zeros((len(prints), 32, size), np.float32), np.zeros((len(prints), size), np.float32)
    for i, x in enumerate(prints):
        signs[i, :, : len(x)] = (x[None, :] >> np.arange(32, dtype=np.uint32)[:, None] & np.uint32(1)).astype(np.float32) * 2 - 1
        quiet[i, : len(x)] = x == SILENT
    moved = np.ascontiguousarray(np.fft.rfft(signs).transpose(2, 0, 1))
    return moved, np.array([len(x) for x in prints], np.int32), np.fft.rfft(quiet) if quiet.any() else None


def waves(prints: np.ndarray, size: int, paired: bool) -> np.ndarray:
    """(frequency, recording, real parts of the bits and imaginary parts) for fingerprints of one length; if ``paired``, each second recording is added
    SHARE times to the one before."""
    signs = (prints[:, None, :] >> np.arange(32, dtype=np.uint32)[:, None] & np.uint32(1)).astype(np.float32) * 2 - 1
    if paired:
        both = signs[::2].copy()
        both[: len(signs) // 2] += SHARE * signs[1::2]
        signs = both
    turn = 2 * np.pi * np.outer(np.arange(prints.shape[1]), np.arange(size // 2 + 1)) / size
    found = signs.reshape(-1, prints.shape[1]) @ np.hstack((np.cos(turn), -np.sin(turn))).astype(np.float32)
    return np.ascontiguousarray(found.reshape(len(signs), 32, 2, -1).transpose(3, 0, 2, 1)).reshape(size // 2 + 1, len(signs), 64)


def candidates(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that match at some offset, and of few others, of fingerprints of one length on each side."""
    x, y = left.shape[1], right.shape[1]
    paired, most = max(x, y) <= PAIRED, max(x, y)
    # An odd number of places at which the offsets that count, and as many to the other side, don't meet others.
    size = (2 * most - MIN_OVERLAP) | 1
    d, f = np.arange(most - MIN_OVERLAP + 1)[:, None], np.arange(size // 2 + 1)
    # Half the sums of products: the even and the odd part, which add up at offset d, and whose difference belongs to -d.
    scale = np.where(f == 0, 0.5, 1.0) / size
    even, odd = ((g(2 * np.pi * d * f / size) * scale).astype(np.float32) for g in (np.cos, lambda v: -np.sin(v)))
    overlap = np.maximum(np.minimum(x, y - d), 0), np.maximum(np.minimum(x - d, y), 0)
    after, before = (np.where(n >= MIN_OVERLAP, 16 * n * (1 - 2 * MAX_ERROR) - SLACK, 16 * n + SLACK) for n in overlap)
    times = 1 + SHARE if paired else 1
    shift = (WHOLE + (SHARE // 2 if paired else 0) - times * (after + before) / 2).astype(np.float32)
    tilt = (times * (after - before) / 2).astype(np.float32)
    b = waves(right, size, paired)
    b = [(np.ascontiguousarray(t.transpose(0, 2, 1)), np.ascontiguousarray(np.concatenate((t[:, :, 32:], -t[:, :, :32]), 2).transpose(0, 2, 1))) for k in range(0, b.shape[1], TILE[1]) if (t := b[:, k : k + TILE[1]]) is not None]
    # The same memory for all tiles.
    products = np.empty(len(f) * TILE[0] * TILE[1], np.float32)
    sums, other, both = (np.empty(len(d) * TILE[0] * TILE[1], np.float32) for _ in range(3))
    for k in range(0, len(left), TILE[0]):
        a = waves(left[k : k + TILE[0]], size, False)
        for at, (same, turned) in enumerate(b):
            n = a.shape[1] * same.shape[2]
            out = products[: len(f) * n].reshape(len(f), a.shape[1], -1)
            e, o, found = (v[: len(d) * n].reshape(len(d), n) for v in (sums, other, both))
            np.matmul(even, np.matmul(a, same, out=out).reshape(len(f), n), out=e)
            np.matmul(odd, np.matmul(a, turned, out=out).reshape(len(f), n), out=o)
            e += shift
            if x != y:
                o -= tilt
            np.add(e, o, out=found)
            e -= o
            bits = np.bitwise_or.reduce(found.view(np.int32), 0) | np.bitwise_or.reduce(e.view(np.int32), 0)
            for bit, step in ((SHARE // 2, 0), (NOT_NEGATIVE, 1)) if paired else ((NOT_NEGATIVE, 0),):
                if len(hit := np.flatnonzero(bits & bit)):
                    i, j = np.divmod(hit, same.shape[2])
                    j = (j + at * TILE[1]) * (1 + paired) + step
                    yield k + i[j < len(right)], j[j < len(right)]


def settled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs of fingerprints, one length on each side: which match, and for these offset, votes, overlap and bit error."""
    x, y = a.shape[1], b.shape[1]
    best, offset, overlap = np.full(len(a), np.inf), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    silent = (a == SILENT).any() and (b == SILENT).any()
    lengths = {d: min(x, x + d, y, y - d) for d in range(MIN_OVERLAP - x, y - MIN_OVERLAP + 1)}
    for d, n in sorted(lengths.items(), key=lambda v: (-v[1], v[0])):
        if n < MIN_OVERLAP:
            continue
        p, q = a[:, max(0, -d) :][:, :n], b[:, max(0, d) :][:, :n]
        differ = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
        sounding = n - ((p == SILENT) & (q == SILENT)).sum(1) if silent else np.full(len(a), n)
        rate = differ / (32 * n)
        good = np.flatnonzero((sounding >= MIN_OVERLAP) & (differ <= 32 * MAX_ERROR * sounding) & (rate < best))
        best[good], offset[good], overlap[good] = rate[good], d, n
    which = np.flatnonzero(overlap)
    place = np.arange(x) + offset[which, None]
    votes = ((place >= 0) & (place < y) & (a[which] == np.take_along_axis(b[which], np.clip(place, 0, y - 1), 1))).sum(1)
    return which, offset[which], votes, overlap[which], best[which]


def compare_even(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, int, int, int, float]]:
    """``compare`` for fingerprints of one length on each side."""
    for i, j in gathered(candidates(left, right), 4096):
        which, *rest = settled(left[i], right[j])
        yield from zip(i[which].tolist(), j[which].tolist(), *(v.tolist() for v in rest), strict=True)


def gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], rows: int) -> Iterator[np.ndarray]:
    """(2, rows): what arrives in small pieces, or in large ones, by so many rows."""
    held, n = [], 0
    for piece in pairs:
        held.append(piece)
        n += len(piece[0])
        if n >= rows:
            whole = np.hstack(held)
            for k in range(0, n - rows + 1, rows):
                yield whole[:, k : k + rows]
            held = [whole[:, n // rows * rows :]]
            n %= rows
    if n:
        yield np.hstack(held)


def compare(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int, float]]:
    """(i, j, offset, votes, overlap, bit error) of the pairs that match, at their best offset; votes are the equal integers."""
    sides = [np.array([len(v) for v in side], np.int64) for side in (left, right)]
    groups = [{int(n): np.flatnonzero(side == n) for n, count in zip(*np.unique(side, return_counts=True), strict=True) if MIN_OVERLAP <= n <= SHORT and count >= GROUP} for side in sides]
    for these in groups[0].values():
        for those in groups[1].values():
            for i, j, *rest in compare_even(np.stack([left[i] for i in these]), np.stack([right[j] for j in those])):
                yield int(these[i]), int(those[j]), *rest
    # The rest: what is in no group with all, and the groups of the other side with what is in none here.
    single = [np.setdiff1d(np.arange(len(side)), np.concatenate([np.zeros(0, np.int64), *found.values()])) for side, found in zip(sides, groups, strict=True)]
    for these, those in ((np.arange(len(left)), single[1]), (single[0], np.setdiff1d(np.arange(len(right)), single[1]))):
        for i, j, *rest in compare_any([left[i] for i in these], [right[j] for j in those]):
            yield int(these[i]), int(those[j]), *rest


def compare_any(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int, float]]:
    """``compare`` for fingerprints of any lengths."""
    lefts, rights = list(batches(left, 32)), list(batches(right, 256))
    for those in rights:
        known: dict[int, tuple] = {}
        for these in lefts:
            size = 1 << (max(len(left[i]) for i in these) + max(len(right[j]) for j in those) - 1).bit_length()
            if size not in known:
                known[size] = spectra([right[j] for j in those], size)
            b, n_b, quiet_b = known[size]
            a, n_a, quiet_a = spectra([left[i] for i in these], size)
            # Entry d is the sum over t of a[t] * b[t + d]; negative offsets stand at the end.
            sums = np.fft.irfft(np.ascontiguousarray((a.conj() @ b.transpose(0, 2, 1)).transpose(1, 2, 0)), size)
            offset = np.arange(size, dtype=np.int32)
            offset[size - int(n_a.max()) + 1 :] -= size
            overlaps = {}  # by the two lengths
            for x in np.unique(n_a):
                for y in np.unique(n_b):
                    overlaps[int(x), int(y)] = np.maximum(np.minimum(x - np.maximum(0, -offset), y - np.maximum(0, offset)), 0)
            needed = {k: np.where(n >= MIN_OVERLAP, 32 * n * (1 - 2 * MAX_ERROR) - 0.5, np.inf).astype(np.float32) for k, n in overlaps.items()}
            for x in np.unique(n_a):
                for y in np.unique(n_b):
                    rows, columns = np.flatnonzero(n_a == x), np.flatnonzero(n_b == y)
                    part = sums if len(rows) == len(n_a) and len(columns) == len(n_b) else sums[np.ix_(rows, columns)]
                    overlap = overlaps[int(x), int(y)]
                    for r, c in np.argwhere((part >= needed[int(x), int(y)]).any(2)):
                        i, j = int(rows[r]), int(columns[c])
                        differ = np.rint((32 * overlap - part[r, c]) / 2)
                        sounding = overlap.astype(float)
                        if quiet_a is not None and quiet_b is not None:
                            sounding -= np.rint(np.fft.irfft(quiet_a[i].conj() * quiet_b[j], size))
                        good = np.flatnonzero((sounding >= MIN_OVERLAP) & (differ <= 32 * MAX_ERROR * sounding))
                        if len(good):
                            rate = differ[good] / (32 * overlap[good])
                            best = good[np.lexsort((offset[good], -overlap[good], rate))[0]]
                            d, n = int(offset[best]), int(overlap[best])
                            p, q = left[these[i]][max(0, -d) :][:n], right[those[j]][max(0, d) :][:n]
                            yield int(these[i]), int(those[j]), d, int((p == q).sum()), n, float(differ[best] / (32 * n))


def unpacked(prints: pa.ListArray) -> list[np.ndarray]:
    """The integers of ``align``, which shuffles them as signed ones of 32 bits."""
    ends = prints.offsets.to_numpy()
    return np.split(prints.flatten().to_numpy().view(np.uint32) ^ np.uint32(1 << 31), ends[1:-1] - ends[0]) if len(prints) else []


def compare_blocks(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches of each row's two blocks."""
    names, kinds = ["query", "other", "offset", "votes", "overlap", "bit_error"], [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
    for batch in blocks:
        for k in range(batch.num_rows):
            asked, others = (batch.column(c)[k].values for c in ("asked", "others"))
            sides = [(x.field("class").to_pylist(), unpacked(x.field("prints"))) for x in (asked, others)]
            (left, a), (right, b) = sides
            out = [(left[i], right[j], *rest) for i, j, *rest in compare(a, b) if left[i] != right[j]]
            if out:
                yield pa.record_batch([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], names)


def align(found: DataFrame) -> DataFrame:
    """(query, other, offset, votes, overlap, bit_error): pairs of classes, the first with a query, that match at their best
    offset. Each block of queries meets each block of others in a row of its own."""
    enough = found.filter(F.size("prints") >= MIN_OVERLAP)
    count = enough.agg(F.sum(F.size("prints")).alias("n"), F.sum(F.when(F.col("is_query"), F.size("prints"))).alias("asked")).first()
    parts, asked_parts = max(1, -(-(count.n or 0) // OTHER_PLACES)), max(1, -(-(count.asked or 0) // QUERY_PLACES))
    enough = enough.withColumn("prints", F.transform("prints", lambda x: (x - F.lit(1 << 31)).cast("int")))
    block = lambda n: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
    listed = F.collect_list(F.struct("class", "prints"))
    asked = enough.filter("is_query").groupBy(block(asked_parts).alias("qb")).agg(listed.alias("asked"))
    others = enough.groupBy(block(parts).alias("ob")).agg(listed.alias("others"))
    asked = asked.withColumn("ob", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    others = others.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(asked_parts - 1))))
    tasks = min(parts * asked_parts * 2, 20000)
    both = asked.repartition(tasks, "qb", "ob").join(others.repartition(tasks, "qb", "ob"), ["qb", "ob"])
    return both.select("asked", "others").mapInArrow(compare_blocks, "query string, other string, offset int, votes bigint, overlap int, bit_error double")


def search(media: DataFrame, key: str, column: str, decode: Callable[[object], tuple[np.ndarray, int]] = samples) -> DataFrame:
    """One row per recording: key, n_prints, class_id (smallest id with this fingerprint), class_size, and, if a recording of the
    class is a query, matches: array of (class_id, offset, bit_error) sorted by class_id."""
    prints = written(fingerprints(media, key, column, decode), "prints")
    found = written(classes(prints, key), "print-classes")
    named = found.select(F.col("class").alias("other"), F.col("rep"))
    hits = align(found).join(named, "other").groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.col("rep").alias("class_id"), "offset", F.round("bit_error", 6).alias("bit_error")))).alias("matches"))
    described = found.select("class", "rep", "n", "is_query").join(hits.withColumnRenamed("query", "class"), "class", "left")
    empty = F.array().cast(f"array<struct<class_id:{media.schema[key].dataType.simpleString()},offset:int,bit_error:double>>")
    joined = prints.join(described, "class", "left")
    return joined.select(key, F.size("prints").alias("n_prints"), F.col("rep").alias("class_id"), F.col("n").alias("class_size"), F.coalesce("is_query", F.lit(False)).alias("is_query"), F.coalesce("matches", empty).alias("matches"))


#: A sixteenth of a second of each semitone.
_TONES = np.sin(2 * np.pi * (220.0 * 2 ** (np.arange(12.0) / 12))[:, None] * (np.arange(RATE // 16) / RATE))


def melody(values: list[float] | None) -> tuple[np.ndarray, int]:
    """Test audio of a vector: a tone of a sixteenth of a second for each number, one of twelve semitones that rise with the number over the
    vector's root mean square. Near vectors share most tones, so they sound alike; unrelated ones do not."""
    if not values:
        raise ValueError("no notes")
    v = np.nan_to_num(np.array(values, float), posinf=0.0, neginf=0.0)
    scale = np.abs(v).max()
    v = v / scale if scale else v
    level = np.tanh(v / (1.2 * np.sqrt((v * v).mean()) or 1.0))
    return _TONES[np.clip(np.floor((level + 1) * 6), 0, 11).astype(int)].ravel(), RATE
