"""Operator 3: language identification by mixture inference.

A text is taken as a mixture of languages. Each language has a distribution of letter trigrams, and expectation-maximisation
finds the proportions under which the text's trigrams are likeliest. Which languages take part is chosen by penalised
likelihood: starting from the best single one, a language is added while it raises the log-likelihood by more than its
share of a BIC penalty. The prediction is the language with the largest proportion, the score its proportion.

The model is learnt from a bounded sample of labelled rows: about ``PER_LANGUAGE`` documents of each language, chosen by a
hash of id and text (rows without an id are sampled like others). Every label is learnt. Trigrams are counted in ``BINS`` hashed bins, so the model takes 128 KiB for each
label: its size goes with the number of languages, not with the corpus.

Results for odd input: null text and text without a letter are ``und`` with score 0; without labelled rows all are ``und``;
text with a letter but no two side by side gives the label first by name, with score 1 / labels;
rows are independent, so ties, repeated rows and null ids need no care (equal proportions: the language first by name); an
empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.io import small, written
from lodestone.llm.common import slices

PER_LANGUAGE = 2000
BINS = 1 << 15
ROUNDS = 25
#: BIC counts observations as independent; overlapping trigrams are not, so a language's penalty is this many times log(n) / 2.
PENALTY = 8.0
UNKNOWN = "und"

#: Bytes as trigrams see them: ASCII that is no letter is a space.
_SEEN = np.array([b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256)], np.int64)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins and counts of the letter trigrams (of UTF-8 bytes, lower case); none without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return np.zeros(0, np.int64), np.zeros(0)
    b = _SEEN[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    codes = (b[:-2] * 0x9E3B + b[1:-1] * 0x1F35 * 0x101 + b[2:] * 0x2545F) % 1000003 % BINS
    codes = codes[((b[:-2] != 32).astype(np.int8) + (b[1:-1] != 32) + (b[2:] != 32)) > 1]
    counts = np.bincount(codes, minlength=0)
    bins = np.flatnonzero(counts)
    return bins, counts[bins].astype(float)


def mixture(chance: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``chance`` and the log-likelihood, by expectation-maximisation."""
    share = np.full(len(chance), 1 / len(chance))
    total = counts.sum()
    for _ in range(rounds if len(chance) > 1 else 0):
        joint = share[:, None] * chance
        new = (joint / joint.sum(0)) @ counts / total
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, float(np.log(share @ chance) @ counts)


def languages_of(chance: np.ndarray, counts: np.ndarray) -> dict[int, float]:
    """The chosen languages and their proportions."""
    if not len(counts):
        return {}
    alone = np.log(chance) @ counts
    chosen = [int(np.argmax(alone))]
    share, best = np.ones(1), float(alone[chosen[0]])
    price = PENALTY * np.log(max(counts.sum(), 2.0)) / 2
    if len(chance) > 1:
        everyone, bound = mixture(chance, counts)
        # No subset is likelier than all languages together: if even they gain too little, one language stands.
        candidates = [int(i) for i in np.argsort(-everyone, kind="stable") if i != chosen[0] and everyone[i] > 1e-3] if bound - best > price else []
        for i in candidates:
            trial, likely = mixture(chance[[*chosen, i]], counts)
            if likely - best > price:
                chosen, share, best = [*chosen, i], trial, likely
    return dict(zip(chosen, share.tolist(), strict=True))


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, counts of all bins as 32-bit floats) summed over a task's rows."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            bins, counts = trigrams(text)
            sums.setdefault(lang, np.zeros(BINS, np.float32))[bins] += counts
    for lang, counts in sums.items():
        yield pa.record_batch([pa.array([lang], pa.string()), pa.array([counts.tobytes()], pa.binary())], ["lang", "counts"])


def summed(table: pa.Table) -> pa.Table:
    """One row of summed counts."""
    total = sum(np.frombuffer(x, np.float32) for x in table.column("counts").to_pylist())
    return pa.table([table.column("lang").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["lang", "counts"])


def held_out(doc_id: str | Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram distributions, from a bounded sample of ``labelled``."""
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    # Thresholds on the hash take about per_language rows of each language, wherever they lie.
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"))
    wanted = written(rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (share * (1 << 30)).cast("bigint").alias("below")), "labels")
    chosen = rows.join(small(wanted), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("below"))
    counts = chosen.select("lang", "text").mapInArrow(count_trigrams, "lang string, counts binary").groupBy("lang").applyInArrow(summed, "lang string, counts binary").collect()
    names = sorted(r.lang for r in counts)
    if not names:
        return [], np.zeros((0, BINS), np.float32)
    by = {r.lang: np.frombuffer(r.counts, np.float32) for r in counts}
    model = np.stack([by[name] for name in names]) + np.float32(0.02)
    return names, model / model.sum(1, keepdims=True, dtype=np.float64).astype(np.float32)


def predict(names: list[str], model: np.ndarray):
    """lang_pred, score and the chosen mixture of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            out = []
            for text in batch.column("text").to_pylist():
                bins, counts = trigrams(text)
                mix = languages_of(model[:, bins].astype(float), counts) if len(bins) and names else {}
                if mix:
                    best = max(mix, key=lambda i: (mix[i], -i))
                    out.append((names[best], min(1.0, mix[best]), [names[i] for i in mix], list(mix.values())))
                else:
                    known = bool(names) and bool(text) and any(map(str.isalpha, text))  # letters, but no two together
                    out.append((names[0] if known else UNKNOWN, 1 / len(names) if known else 0.0, [], []))
            rest = [c for c in batch.schema.names if c != "text"]
            columns = [*(batch.column(c) for c in rest), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))))]
            yield pa.record_batch(columns, [*rest, "lang_pred", "score", "languages", "proportions"])

    return run


def identify(docs: DataFrame, names: list[str], model: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, languages, proportions of each document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(predict(names, model), f"doc_id {kind}, lang_pred string, score double, languages array<string>, proportions array<double>")


def keep_known(docs: DataFrame, names: list[str], model: np.ndarray, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language can be told: those without a letter go (and only those, if no language is known).
    Columns as they were."""
    if not names:
        return docs.filter(F.col(text).cast("string").rlike(r"\p{L}"))
    schema = docs.schema
    decide = predict(names, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = next(decide(iter([pa.record_batch([part.column(text).cast(pa.string())], ["text"])])))
                yield part.filter(pa.array([x != UNKNOWN for x in found.column("lang_pred").to_pylist()]))

    return docs.mapInArrow(run, schema)
