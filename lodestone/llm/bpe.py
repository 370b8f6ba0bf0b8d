"""Operator 2: byte-level BPE encoding and decoding in linear time.

The ranks of a vocabulary fix how each token splits into two earlier ones. Two neighbouring tokens stand in an encoding only
if no merge across their border comes before the merges that made them; that test is memoised by pair. An encoding is then
found by taking the longest token at each place and stepping back to a shorter one (or a token back) where the test fails;
a bit for each place keeps any place from being tried twice. Bytes are mapped to Latin-1 characters, so that
pyahocorasick's trie finds the longest token at a place in one step.

Texts are split by the vocabulary's pattern and each match is encoded by itself; encodings of short matches are kept.

Results for odd input: null and empty text have no ids; special tokens are ordinary text; rows are independent, so ties,
repeated rows and null ids need no care; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices

#: Matches of at most this many characters are kept: this many new ones, and as many from before.
KEPT_LENGTH = 40
KEPT = 1 << 18
#: Results of the pair test that are kept; beyond, they are forgotten and found again.
FITS = 1 << 20
#: Ids decoded at once.
DECODED = 1 << 22
#: Texts below this code point are split with the classes of the pattern written out, which the ``re`` module does faster.
PLAIN = 0x250


class Vocabulary:
    """Ranks of a byte-level BPE, and the tables the encoder needs."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.matcher = ahocorasick.Automaton()
        self.by_latin = {t.decode("latin-1"): i for i, t in enumerate(tokens)}
        for latin, i in self.by_latin.items():
            self.matcher.add_word(latin, i)
        self.matcher.make_automaton()
        self.lengths = [len(t) for t in tokens]
        self.reach = max(self.lengths, default=0)
        self.table = pa.array(tokens, pa.binary())
        self.shorter: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = []
        self.fits: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(tokens):
            self.halves.append((i, i))
            a = self.prefix(i)
            while a >= 0:
                b = self.ids.get(t[len(tokens[a]) :], i)
                if a < i and b < i and self.adjacent(a, b):
                    self.merged[a, b] = i
                    self.halves[i] = (a, b)
                    break
                a = self.prefix(a)
        for i in range(len(tokens)):
            self.prefix(i)
        self.fits.clear()  # tests made before all merges were known

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a file of base64 tokens and ranks."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tokens = sorted(ranks, key=ranks.__getitem__)
        if [ranks[t] for t in tokens] != list(range(len(tokens))):
            raise ValueError("ranks must be 0, 1, 2 and so on")
        return cls(tokens)

    def prefix(self, token: int) -> int:
        """The longest other token that begins this one, or -1."""
        if token not in self.shorter:
            t = self.tokens[token]
            self.shorter[token] = next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1)
        return self.shorter[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether BPE can leave the two tokens side by side: their border is undone from the outside in, the later token
        first, and no merge across it may come before the one undone last."""
        found = self.fits.get((left, right))
        if found is None:
            a, b, bound, found = left, right, len(self.tokens) + 1, None
            while found is None:
                if self.merged.get((a, b), bound) < bound:
                    found = False
                    break
                for later_is_left in (True, False) if a > b else (False, True):
                    whole = a if later_is_left else b
                    half = self.halves[whole][1 if later_is_left else 0]
                    if half != whole:
                        bound = whole if later_is_left else whole + 1
                        a, b = (half, b) if later_is_left else (a, half)
                        break
                else:
                    found = True
            if len(self.fits) >= FITS:
                self.fits.clear()
            self.fits[left, right] = found
        return found

    def longest(self, latin: str, at: int) -> int:
        """The longest token that starts at a place of a match written in Latin-1."""
        size, find = self.matcher.longest_prefix(latin[at : at + self.reach]), self.by_latin.get
        while (token := find(latin[at : at + size])) is None:
            size -= 1
        return token

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (whole := self.ids.get(piece)) is not None:
            return [whole]
        latin, size = piece.decode("latin-1"), len(piece)
        open_, out, at, token = bytearray(b"\1" * (size + 1)), [], 0, self.longest(latin, 0)
        lengths, fits, shorter = self.lengths, self.fits, self.shorter
        while at < size:
            end = at + lengths[token]
            if open_[end] and (not out or (fits.get((out[-1], token)) if (out[-1], token) in fits else self.adjacent(out[-1], token))):
                out.append(token)
                at = end
                if at < size:
                    token = self.longest(latin, at)
            elif (token := shorter[token]) < 0:  # nothing fits here; the token before must be a shorter one
                open_[at] = 0
                token = out.pop()
                at -= lengths[token]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids."""
        return b"".join(map(self.tokens.__getitem__, ids))


class Packed(dict):
    """Matches of the pattern with their ids as little-endian 32-bit words. When it is full, what it holds becomes the older
    half, from which matches that come again are taken over."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, match: str) -> bytes:
        if (ids := self.older.get(match)) is None:
            ids = array("I", self.vocabulary.encode(match.encode())).tobytes()
        if len(match) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[match] = ids
        return ids


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts below PLAIN, with letters, numbers and white space as explicit classes; None if it holds others."""

    def ranges(kind: str) -> str:
        found = [i for i in range(PLAIN) if regex.match(kind, chr(i))]
        starts = [i for i in found if i - 1 not in found]
        ends = [i for i in found if i + 1 not in found]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))

    kinds = {k: ranges(k) for k in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, at = "", False, 0
    while at < len(pattern):
        if (kind := next((k for k in kinds if pattern.startswith(k, at)), None)) is not None:
            out += kinds[kind] if inside else f"[{kinds[kind]}]"
            at += len(kind)
        elif pattern.startswith(r"\S", at) and not inside:
            out += f"[^{kinds[r'\s']}]"
            at += 2
        elif pattern[at] == "\\":
            return None
        else:
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
            out += pattern[at]
            at += 1
    return re.compile(out)


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary.load(path)
        self.find = regex.compile(pattern).findall
        plain = plain_pattern(pattern)
        self.find_plain = plain.findall if plain else self.find
        self.beyond = re.compile(f"[^\\x00-\\u{PLAIN - 1:04x}]").search
        self.kept = Packed(self.vocabulary)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit words."""
        find = self.find if self.beyond(text) else self.find_plain
        return b"".join(map(self.kept.__getitem__, find(text)))

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a vocabulary; a Python worker builds it once."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids (array<int>) of each document."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).packed
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [encode(x or "") for x in part.column("text").to_pylist()]
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``encoded`` (doc_id, ids) and decoded (binary)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, pattern).vocabulary.table
        for batch in batches:
            lengths, k = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False), 0
            ends_of = np.cumsum(lengths, dtype=np.int64)
            while k < batch.num_rows:
                stop = min(k + 512, max(k + 1, int(np.searchsorted(ends_of, (ends_of[k - 1] if k else 0) + DECODED, "right"))), batch.num_rows)
                part = batch.slice(k, stop - k)
                k = stop
                ids = part.column("ids")
                joined = tokens.take(ids.flatten())
                # The bytes of neighbouring tokens lie side by side, so a text is one slice from its first token to its last.
                ends = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1]
                bounds = np.cumsum([0, *(0 if n is None else n for n in pc.list_value_length(ids).to_pylist())])
                texts = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends[bounds].copy()), joined.buffers()[2]])
                yield pa.record_batch([*part.columns, texts], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")
