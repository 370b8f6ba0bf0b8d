"""Small corpora with the odd cases, and plain Python versions of the operators."""

from __future__ import annotations

import hashlib
import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed: int = 5, n: int = 40) -> list[tuple[int | None, str | None]]:
    """Texts with copies, near copies, shared passages, empty, null and very long ones."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["th", "on", "ré", "ing", "ö", "al", "x"]) for _ in range(rnd.randint(1, 3))) for _ in range(80)]
    make = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage = make(60)
    texts: list[str | None] = [None, "", "   \n\t", "one", "a b c d e", "  A b\tC d E\n"]
    for i in range(n):
        text = make(rnd.choice([3, 12, 14, 40, 120, 200]))
        if i % 4 == 0:
            text = f"{text}\n{passage} {make(5)}"
        texts.append(text)
        if i % 5 == 0:
            texts.append(text)
        if i % 6 == 0 and len(text) > 100:
            parts = text.split(" ")
            parts[len(parts) // 2] = "changed"
            texts.append(" ".join(parts))
    texts.append(make(9000))
    texts.append("ab" * 300)
    texts.append("z" * 700)
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return [(order[i] * 3, t) for i, t in enumerate(texts)]


def frame(spark, rows, path, parts: int = 3, repeat: bool = True):
    """The rows as documents read from files, with clashing extra columns, a repeated row and a row without id."""
    full = [(i, t, None if k % 7 == 0 else "en", f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    if repeat:
        full += [full[10], (None, "a row without an id " * 20, None, None, None)]
    extra = "key bigint, place bigint, copied boolean, component bigint, _row bigint, name string, digest string"
    data = [(*r, 1, 2, True, 3, 4, "n", "d") for r in full]
    target = str(path / "documents")
    spark.createDataFrame(data, f"{SCHEMA}, {extra}").repartition(parts).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target), full


def empty(spark, path):
    """An empty table read from files."""
    target = str(path / "empty")
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
