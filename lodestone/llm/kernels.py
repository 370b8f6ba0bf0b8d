"""NumPy kernels shared by the text operators: rolling hashes, window minima and run arithmetic.

Hashes only route rows; wherever a result depends on equality the operators compare the content itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_DRAW = np.random.Generator(np.random.PCG64(0x10DE))
#: A random odd word for each byte value.
BYTE = _DRAW.integers(0, 2**64, 256, dtype=U64) | U64(1)
#: Odd multipliers, one for each doubling of a gram's length.
STEP = _DRAW.integers(0, 2**64, 8, dtype=U64) | U64(1)
#: The multiplier of byte polynomials and its inverse modulo 2**64.
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(int(BASE), -1, 2**64))
#: Low bits of a packed word that hold a position; buffers are shorter than this.
POSITION_BITS = 24
POSITION = U64((1 << POSITION_BITS) - 1)
#: Bytes (or words) handled at once.
PIECE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """``h`` with its bits spread (the splitmix finaliser), so that its order is as good as random."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def byte_grams(buffer: np.ndarray, doublings: int) -> np.ndarray:
    """A hash of the 2**doublings bytes that start at each place."""
    h = BYTE[buffer]
    for k in range(doublings):
        size = 1 << k
        h = h[:-size] * STEP[k] + h[size:] if len(h) > size else h[:0]
    return mixed(h)


def window_min(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    if len(v) < width:
        return v[:0]
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = width - size
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def leftmost_min(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least hash in each window of ``width`` hashes; the leftmost of equals."""
    packed = (h & ~POSITION) | np.arange(len(h), dtype=U64)
    return (window_min(packed, width) & POSITION).astype(np.int64)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the given runs, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths - starts, lengths)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def covered(length: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of ``length`` places lie in one of the half-open intervals."""
    lo, hi = np.clip(lo, 0, length), np.clip(hi, 0, length)
    steps = np.bincount(lo, minlength=length + 1) - np.bincount(hi, minlength=length + 1)
    return np.cumsum(steps)[:length] > 0


def groups_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values in a sorted array."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
    return starts, np.append(starts[1:], len(values))


def tokens(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of a buffer whose words are separated by single spaces or newlines."""
    gap = (buffer == 32) | (buffer == 10)
    starts, ends = runs(~gap)
    if not len(starts):
        return starts, ends, np.zeros(0, U64)
    up, down = powers(len(buffer) + 1)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(BYTE[buffer] * up[: len(buffer)], dtype=U64)))
    return starts, ends, mixed((total[ends] - total[starts]) * down[starts])


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse; kept for the next call."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, U64), np.full(size, BASE_INV, U64)
        up[0] = down[0] = 1
        _POWERS[:] = [(np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))]
    return _POWERS[0]


def word_grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` word hashes that start at each place."""
    n = len(words) - size + 1
    if n <= 0:
        return words[:0]
    h = words[:n].copy()
    for j in range(1, size):
        h = h * STEP[j % 8] + words[j : j + n]
    return mixed(h)


def pieces(texts: Iterator[tuple[int, bytes]], overlap: int, limit: int = PIECE) -> Iterator[list[tuple[int, int, bytes]]]:
    """(number, offset, bytes) in lists of about ``limit`` bytes; a longer text comes in parts that overlap by ``overlap``
    bytes, so every window of ``overlap + 1`` bytes lies in one part."""
    held, size = [], 0
    for number, text in texts:
        for at in range(0, max(1, len(text) - overlap), limit):
            part = text[at : at + limit + overlap]
            held.append((number, at, part))
            size += len(part)
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held
