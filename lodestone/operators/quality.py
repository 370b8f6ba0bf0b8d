"""Cleaning, quality flags, redaction, code metrics and duplicate blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.batches import sliced
from lodestone.functions import patterns as P

#: Bytes of text that a task holds as Python values at once, single longer texts aside.
SLICE = 1 << 22
#: Bytes of text whose windows are hashed at once.
WINDOWED = 1 << 20


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flags(*checks: tuple[Column, str]) -> Column:
    """The names of the checks that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in checks)))


def semantic_characters(c: Column | str) -> Column:
    """Letters and digits that remain without markup."""
    plain = reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), P.PRESENTATION, _col(c))
    return F.regexp_count(plain, F.lit(r"[\p{L}\p{N}]")).cast("bigint")


def quality_reasons(c: Column | str, semantic: Column | str | None = None) -> Column:
    """Why a document is not worth keeping; empty for a good one. ``semantic``: its ``semantic_characters``, where they are known already."""
    c, semantic = _col(c), semantic_characters(c) if semantic is None else _col(semantic)
    blank = F.regexp_replace(c, r"\s+", "") == ""
    control = c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
    lines = F.filter(F.split(c, r"\r?\n"), lambda x: F.trim(x) != "")
    rst = (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"(?i)^\s*\.\.\s+(?:include|literalinclude)::\s+\S+\s*$") | x.rlike(r"^[ \t]+:[A-Za-z][\w-]*:\s*.*$") | x.rlike(r"^[ \t]*\.\.(?!\s+[A-Za-z][\w-]*::)(?:\s+.*)?$"))
    rst = rst & F.exists(lines, lambda x: x.rlike(r"(?i)^\s*\.\.\s+(?:include|literalinclude)::"))
    return flags((blank, "empty"), (~blank & control, "control-character"), (~blank & (c.rlike(P.INCLUDE_ONLY) | rst), "include-only"), (~blank & c.rlike(P.REDIRECT_ONLY), "redirect-only"), (~blank & (semantic < 16), "non-semantic"))


def noise_audit(docs: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Counts of noisy and unfit documents by group and over all, in one pass."""
    rows = docs.withColumn("_why", quality_reasons(text))
    counts = [F.count_if(F.col(text).rlike(p)).alias(n) for n, p in P.NOISE.items()]
    reasons = ["empty", "control-character", "include-only", "redirect-only", "non-semantic"]
    counts += [F.count_if(F.size("_why") > 0).alias("invalid")] + [F.count_if(F.array_contains("_why", r)).alias(r.replace("-", "_")) for r in reasons]
    return rows.rollup(group).agg(F.count("*").alias("files"), *counts).withColumn(group, F.coalesce(group, F.lit("total")))


def clean_lines(content: str) -> str:
    """A document without a leading YAML fence's ticks, noise lines and narration outside code fences, blank lines collapsed."""
    out, fenced = [], False
    for line in content.replace("\r\n", "\n").split("\n"):
        bare = line.strip()
        if bare.startswith("```") and (not fenced or re.fullmatch(r"```\s*", bare)):
            fenced = not fenced
        elif not fenced:
            if any(re.search(p, line) for p in P.NOISE_LINES):
                continue
            prose = bare and not bare.startswith(("#", "- ", "* ")) and not re.match(r"\d+\.\s+", bare)
            if prose and any(re.search(p, bare) for p in P.NARRATION):
                continue
        out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def prepared(c: Column | str, path: Column | str) -> Column:
    """The deterministic preparation of a document: cleaned (reStructuredText only collapsed), secrets redacted, control
    characters as blanks."""

    @F.pandas_udf("string")
    def clean(text: pd.Series, name: pd.Series) -> pd.Series:
        rst = name.str.lower().str.endswith(".rst")
        plain = text.fillna("")
        return pd.Series([re.sub(r"\n{3,}", "\n\n", t.replace("\r\n", "\n")).strip() if r else clean_lines(t) for t, r in zip(plain, rst, strict=True)])

    from lodestone.functions.text import without_control

    return without_control(redacted(clean(_col(c), _col(path)))[0])


def with_prepared(docs: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """``docs`` with ``clean``, what ``prepared`` makes of each text, in slices that bound what a task holds as Python values."""
    from lodestone.functions.text import without_control

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, size=SLICE):
            rst = [(n or "").lower().endswith(".rst") for n in batch.column(path).to_pylist()]
            texts = (t or "" for t in batch.column(text).to_pylist())
            clean = [re.sub(r"\n{3,}", "\n\n", t.replace("\r\n", "\n")).strip() if r else clean_lines(t) for t, r in zip(texts, rst, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clean, pa.string())], names=[*batch.schema.names, "clean"])

    found = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("clean", T.StringType())]))
    return found.withColumn("clean", without_control(redacted("clean")[0]))


def size_guarded(raw: Column | str, refined: Column | str, ratio: float = 1.5) -> Column:
    """The refined text, or the raw one where it grew beyond the ratio."""
    raw, refined = _col(raw), _col(refined)
    return F.when(F.length(refined) > F.length(raw) * ratio, raw).otherwise(refined)


def redacted(c: Column | str) -> tuple[Column, Column, Column]:
    """(text, count, ids): secrets replaced by ``[REDACTED:id]`` one pattern after the other, so later patterns see the redacted text.
    Line breaks of a secret stay behind its mark."""
    text, count, ids = _col(c), F.lit(0), []
    for name, _, pattern in P.SECRETS:
        n = F.regexp_count(text, F.lit(pattern))
        count, ids = count + n, [*ids, F.when(n > 0, F.lit(name))]
        # The secret is group 1; what stands around it in the match is kept.
        around = re.sub(r"^\(\?i\)", "", pattern)
        cut = next(i for i in range(len(around)) if around[i] == "(" and around[i + 1] != "?" and around[i - 1 : i] != "\\")
        depth, end = 0, cut
        for end in range(cut, len(around)):
            depth += (around[end] == "(" and around[end - 1] != "\\") - (around[end] == ")" and around[end - 1] != "\\")
            if depth == 0:
                break
        before, secret, after = around[:cut], around[cut : end + 1], around[end + 1 :]
        flag = "(?i)" if pattern.startswith("(?i)") else ""
        if before or after:
            secret_pattern, mark = f"{flag}({before}){secret}({after})", f"$1[REDACTED:{name}]$3"
            text = F.regexp_replace(text, secret_pattern, mark) if after else F.regexp_replace(text, f"{flag}({before}){secret}", f"$1[REDACTED:{name}]")
        elif name == "private-key":
            # One line break is kept for each in the key.
            parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
            marks = F.transform(parts, lambda s: F.concat(F.lit("[REDACTED:private-key]"), F.regexp_replace(s, r"[^\r\n]+", "")))
            gaps = F.split(text, pattern, -1)
            text = F.when(F.size(parts) == 0, text).otherwise(F.array_join(F.zip_with(gaps, F.concat(marks, F.array(F.lit(""))), lambda g, m: F.concat(g, m)), ""))
        else:
            text = F.regexp_replace(text, pattern, f"[REDACTED:{name}]")
    return text, count, F.array_compact(F.array(*ids))


def secret_findings(c: Column | str) -> Column:
    """(id, severity) of the secret patterns a text matches."""
    return F.array_compact(F.array(*(F.when(_col(c).rlike(p), F.struct(F.lit(n).alias("id"), F.lit(s).alias("severity"))) for n, s, p in P.SECRETS)))


def sensitive_names(own: str | None = None) -> list[tuple[str, str]]:
    """(id, pattern) of file names of credentials: a comma-separated list of patterns in place of the fixed ones, if it holds any
    that can be read."""
    given = []
    for p in filter(None, map(str.strip, (own or "").split(","))):
        try:
            re.compile(p)
        except re.error:
            continue
        given.append((f"own-{len(given)}", f"(?i){p}"))
    return given or P.SENSITIVE_NAMES


def path_security(path: Column | str, content: Column | str, own: str | None = None) -> Column:
    """The first reason to block a file: a sensitive directory, then name, then content; null for a safe one. ``own``: see ``sensitive_names``."""
    path, content = _col(path), _col(content)
    rules = [(path.rlike(p), n) for n, p in P.SENSITIVE_DIRECTORIES] + [(F.substring_index(path, "/", -1).rlike(p) | path.rlike(p) & F.lit("/" in p), n) for n, p in sensitive_names(own)] + [(content.rlike(p), n) for n, _, p in P.SECRETS]
    return F.coalesce(*(F.when(c, F.lit(n)) for c, n in rules))


def risk_lines(docs: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Lines with secrets, absolute paths and traversal by group."""
    secret = reduce(lambda a, b: a | b, (F.col("_line").rlike(p) for _, _, p in P.SECRETS))
    lines = docs.select(group, F.explode(F.split(text, r"\r?\n")).alias("_line"))
    return lines.groupBy(group).agg(F.count("*").alias("lines"), F.count_if(secret).alias("secret_lines"), F.count_if(F.col("_line").rlike(r"(?:^|\s)/(?:home|Users|etc|var)/")).alias("absolute_lines"), F.count_if(F.col("_line").contains("../")).alias("traversal_lines"))


def _digits(value: str) -> list[int]:
    return [int(c) for c in value if c.isascii() and c.isdigit()]


def valid_cpf(value: str) -> bool:
    """Brazilian taxpayer number: eleven digits, not all alike, two check digits."""
    d = _digits(value)
    if len(d) != 11 or len(set(d)) == 1:
        return False
    return all(sum(x * (n + 1 - i) for i, x in enumerate(d[:n])) * 10 % 11 % 10 == d[n] for n in (9, 10))


def valid_cnpj(value: str) -> bool:
    """Brazilian company number: fourteen digits, not all alike, two check digits."""
    d = _digits(value)
    if len(d) != 14 or len(set(d)) == 1:
        return False

    def check(n: int) -> int:
        weights = [(n - 1 - i) % 8 + 2 for i in range(n)]
        rest = sum(x * w for x, w in zip(d, weights, strict=False)) % 11
        return 0 if rest < 2 else 11 - rest

    return check(12) == d[12] and check(13) == d[13]


def valid_ssn(value: str) -> bool:
    """US social security number: area, group and serial within their ranges."""
    m = re.fullmatch(r"(\d{3})-(\d{2})-(\d{4})", value)
    return bool(m) and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"


def valid_card(value: str) -> bool:
    """13 to 19 digits that pass the Luhn test."""
    d = _digits(value)[::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


VALID = {"cpf": valid_cpf, "cnpj": valid_cnpj, "ssn": valid_ssn, "credit_card": valid_card}


def personal_matches(text: str, kinds: list[str] | None = None) -> list[tuple[str, str, int, int]]:
    """(type, value, start, end): matches that pass their check, in order; of overlapping ones the longer stays."""
    found = [(k, m[0], m.start(), m.end()) for k in (kinds or P.PERSONAL) for m in re.finditer(P.PERSONAL[k][0], text, re.ASCII) if k not in VALID or VALID[k](m[0])]
    out: list[tuple[str, str, int, int]] = []
    for m in sorted(found, key=lambda m: (m[2], -m[3])):
        if not out or m[2] >= out[-1][3]:
            out.append(m)
        elif m[3] - m[2] > out[-1][3] - out[-1][2]:
            out[-1] = m
    return out


def redact_personal(text: str, kinds: list[str] | None = None) -> str:
    """The text with placeholders, from right to left."""
    for kind, _, a, b in reversed(personal_matches(text, kinds)):
        text = text[:a] + P.PERSONAL[kind][1] + text[b:]
    return text


def has_personal(text: str, compatible: bool = True) -> bool:
    """Whether a text holds personal data; the compatible form looks at each type's first match only."""
    if not compatible:
        return bool(personal_matches(text))
    firsts = ((k, re.search(p, text, re.ASCII)) for k, (p, _) in P.PERSONAL.items())
    return any(m and (k not in VALID or VALID[k](m[0])) for k, m in firsts)


def with_personal(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal (array of type, value, start, end) and the redacted text, found in slices that bound what a task holds as Python values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, size=SLICE):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found = [[dict(zip(("type", "value", "start", "end"), m, strict=True)) for m in personal_matches(t)] for t in texts]
            made = [pa.array(found, kind), pa.array([redact_personal(t) for t in texts], pa.string()), pa.array([has_personal(t) for t in texts], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "personal", "redacted", "flagged"])

    kind = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    new = T.StructType.fromDDL("personal array<struct<type:string,value:string,start:int,end:int>>, redacted string, flagged boolean")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new.fields]))


def cyclomatic(c: Column | str) -> Column:
    """One more than the decision points."""
    return sum((F.regexp_count(_col(c), F.lit(p)) for p in P.DECISIONS), F.lit(1)).cast("bigint")


def cognitive(c: Column | str) -> Column:
    """Nesting openers cost one and their depth, conditions with && or || one, recursive functions two."""
    c = _col(c)

    def step(a: Column, raw: Column) -> Column:
        line = F.trim(raw)
        opens = line.rlike(r"^\s*(if|for|while|switch|catch)\s*[({]")
        closes = line.isin("}", "};")
        logic, function = line.rlike(r"&&|\|\|"), line.rlike(r"function\s+\w+.*\{")
        name = F.regexp_extract(line, r"function\s+(\w+)", 1)
        calls = function & (name != "") & F.regexp_like(c, F.concat(F.lit(r"\b"), name, F.lit(r"\s*\(")))
        add = F.when(opens, a["depth"] + 1).when(closes, 0).when(logic, 1).when(calls, 2).otherwise(0)
        depth = F.when(opens, a["depth"] + 1).when(closes, F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        return F.struct((a["total"] + add).alias("total"), depth.alias("depth"))

    return F.aggregate(F.split(c, "\n"), F.struct(F.lit(0).alias("total"), F.lit(0).alias("depth")), step)["total"].cast("bigint")


def max_nesting(c: Column | str) -> Column:
    """The deepest level of braces, line by line."""

    def step(a: Column, line: Column) -> Column:
        up = F.when(F.contains(line, F.lit("{")), a["now"] + 1).otherwise(a["now"])
        down = F.when(F.contains(line, F.lit("}")), F.greatest(up - 1, F.lit(0))).otherwise(up)
        return F.struct(F.greatest(a["top"], up).alias("top"), down.alias("now"))

    return F.aggregate(F.split(_col(c), "\n"), F.struct(F.lit(0).alias("top"), F.lit(0).alias("now")), step)["top"].cast("bigint")


def returns(c: Column | str) -> Column:
    """Return statements."""
    return F.regexp_count(_col(c), F.lit(r"\breturn\b")).cast("bigint")


def maintainability(lines: Column, cyclomatic_: Column, cognitive_: Column) -> Column:
    """100 less costs of size and complexity, rounded half up, within 0 and 100."""
    index = 100 - 2.0 * F.log(F.greatest(lines, F.lit(1))) - 0.5 * F.greatest(cyclomatic_, F.lit(1)) - 0.1 * F.greatest(cognitive_, F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(index + 0.5))).cast("bigint")


def debt_items(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, type, weight, line, comment, context): lines with a debt marker and two lines on each side."""
    lines = docs.select(key, F.split(text, "\n").alias("_all")).select(key, "_all", F.posexplode("_all").alias("_at", "_line"))
    marks = F.array_compact(F.array(*(F.when(F.col("_line").rlike(p), F.struct(F.lit(t).alias("type"), F.lit(w).alias("weight"))) for t, w, p in P.DEBT)))
    start = F.greatest(F.col("_at") - 2, F.lit(0))
    context = F.array_join(F.slice("_all", start + 1, F.col("_at") + 3 - start), "\n")
    return lines.select(key, F.explode(marks).alias("_m"), (F.col("_at") + 1).alias("line"), F.trim("_line").alias("comment"), F.trim(context).alias("context")).select(key, "_m.type", "_m.weight", "line", "comment", "context")


def _comparable(c: Column) -> Column:
    steps = [(r"/\*[\s\S]*?\*/", ""), (r"(?m)//.*$", ""), (r"(?m)^\s+|\s+$", ""), (r"\s+", " ")]
    return F.trim(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c))


def _pieces(docs: DataFrame, key: str, text: str, smallest: int) -> DataFrame:
    """key, _l (lines of texts with block comments, which cross lines; null for others) and _p: lines normalised once, so that a window's text is that of its pieces, one after
    another, without blanks at its ends: neighbours are joined by a blank, lines with empty ones between them by nothing."""
    lines = F.split(text, "\n")
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"//.*$", ""), r"\s+", " ")))
    split = docs.select(key, lines.alias("_l"), F.contains(F.col(text), F.lit("/*")).alias("_c"), bare.alias("_b")).filter(F.size("_l") >= smallest)
    glued = F.transform("_b", lambda x, i: F.when((i > 0) & (x != "") & (F.get("_b", i - 1) != ""), F.concat(F.lit(" "), x)).otherwise(x))
    return split.select(key, F.when(F.col("_c"), F.col("_l")).alias("_l"), glued.alias("_p"))


def _window_text(size: Column | str) -> Column:
    """The normalised text of a window that begins with the first entry of ``_l`` and ``_p``."""
    size = F.col(size) if isinstance(size, str) else size
    return F.when(F.col("_l").isNull(), F.trim(F.array_join(F.slice("_p", F.lit(1), size), ""))).otherwise(_comparable(F.array_join(F.slice("_l", F.lit(1), size), "\n")))


def _windows(split: DataFrame, key: str, smallest: int, largest: int) -> DataFrame:
    """key, start, size and _t of all windows of pieces with at least twenty characters."""
    starts = split.select(key, "_l", "_p", F.explode(F.sequence(F.lit(1), F.size("_p") - smallest + 1)).alias("start"))
    starts = starts.select(key, "start", F.slice("_l", F.col("start"), F.lit(largest)).alias("_l"), F.slice("_p", F.col("start"), F.lit(largest)).alias("_p"))
    sized = starts.select(key, "start", "_l", "_p", F.explode(F.sequence(F.lit(smallest), F.size("_p"))).alias("size"))
    return sized.select(key, "start", "size", _window_text("size").alias("_t")).filter(F.length("_t") >= 20)


def blocks(docs: DataFrame, key: str, text: str = "text", smallest: int = 4, largest: int = 20) -> DataFrame:
    """(key, hash, start, size): every window of 4 to 20 lines with at least twenty characters beside comments and blanks."""
    found = _windows(_pieces(docs, key, text, smallest), key, smallest, largest)
    return found.select(key, F.substring(F.sha2("_t", 256), 1, 16).alias("hash"), "start", "size")


#: Random words for bytes and odd multipliers of two polynomial hashes, drawn once from a fixed seed.
_DRAW = np.random.Generator(np.random.PCG64(2024))
_BYTES = _DRAW.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = [int(x) | 1 for x in _DRAW.integers(2**62, 2**63, 2, dtype=np.uint64)]


def _prefixes(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both hashes the sums of a buffer's bytes times powers of the base, and the inverse powers."""
    out = []
    for table, base in zip(_BYTES, _BASES, strict=True):
        up, down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(data), x, np.uint64))), dtype=np.uint64) for x in (base, pow(base, -1, 2**64)))
        out.append((np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[data] * up[:-1], dtype=np.uint64))), down))
    return out


def _hashed_windows(key: str, smallest: int, largest: int):
    """(key, a, b, n, start, size): two hashes and the number of characters of every window of pieces, from sums over the buffer of all pieces: no window's text is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("_p").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            pieces, at = batch.column("_p").flatten(), 0
            while at < len(sizes):
                # About WINDOWED bytes of text at once, or one document: the sums take many times as much.
                stop, bytes_ = at + 1, 0
                first = int(sizes[:at].sum())
                lengths = pc.binary_length(pieces.slice(first)).to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes[at:])
                text = np.concatenate(([0], np.cumsum(lengths)))[ends]
                stop = at + max(1, int(np.searchsorted(text, WINDOWED, "right")))
                part = pieces.slice(first, int(sizes[at:stop].sum()))
                lengths = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
                offsets = np.concatenate(([0], np.cumsum(lengths)))
                data = np.frombuffer("".join(part.to_pylist()).encode(), np.uint8)
                plain = np.concatenate((data, [0]))
                signs = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                sums = _prefixes(data)
                row = np.repeat(np.arange(at, stop), sizes[at:stop])
                last = np.repeat(np.cumsum(sizes[at:stop]), sizes[at:stop])  # the piece behind each document
                number = np.arange(len(lengths)) - np.repeat(np.cumsum(sizes[at:stop]) - sizes[at:stop], sizes[at:stop])
                for size in range(smallest, largest + 1):
                    i = np.flatnonzero(np.arange(len(lengths)) + size <= last)
                    begin, end = offsets[i], offsets[i + size]
                    begin = begin + ((plain[begin] == 32) & (end > begin))
                    n = signs[end] - signs[begin]
                    good = np.flatnonzero(n >= 20)
                    i, begin, end = i[good], begin[good], end[good]
                    if len(i):
                        hashes = [((total[end] - total[begin]) * down[begin]).view(np.int64) for total, down in sums]
                        yield pa.record_batch([batch.column(key).take(pa.array(row[i])), *map(pa.array, hashes), pa.array(n[good].astype(np.int32)), pa.array((number[i] + 1).astype(np.int32)), pa.array(np.full(len(i), size, np.int32))], [key, "a", "b", "n", "start", "size"])
                at = stop

    return run


def duplicated_blocks(docs: DataFrame, key: str, text: str = "text", smallest: int = 4, largest: int = 20) -> DataFrame:
    """(hash, files, places): blocks of two files or more, as ``cross_file_duplicates`` of ``blocks`` gives them. Windows are grouped by two 64-bit hashes and their length, which come from
    sums over the text; only one window of each group that several files hold is written out as text."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, a bigint, b bigint, n int, start int, size int"
    split = _pieces(docs, key, text, smallest)
    quick = split.filter("_l is null").select(key, "_p").mapInArrow(_hashed_windows(key, smallest, largest), schema)
    # Texts with block comments go window by window; their windows' texts are pieces by themselves.
    slow = _windows(split.filter("_l is not null"), key, smallest, largest).select(F.struct(key, "start", "size").alias("_w"), F.array("_t").alias("_p"))
    slow = slow.mapInArrow(_hashed_windows("_w", 1, 1), f"_w struct<{key}:{kind},start:int,size:int>, a bigint, b bigint, n int, start int, size int").select(f"_w.{key}", "a", "b", "n", "_w.start", "_w.size")
    # Counts of a file's own places first, so that a block that one file repeats is one row.
    own = quick.unionByName(slow).groupBy("a", "b", "n", key).agg(F.count("*").alias("places"), F.min(F.struct("start", "size")).alias("w"))
    shared = own.groupBy("a", "b", "n").agg(F.count("*").alias("files"), F.sum("places").alias("places"), F.min(F.struct(key, "w")).alias("first")).filter("files > 1")
    shown = shared.select(F.col(f"first.{key}").alias(key), F.col("first.w.start").alias("start"), F.col("first.w.size").alias("size"), "files", "places")
    window = split.join(shown, key).select("files", "places", "size", F.slice("_l", F.col("start"), F.col("size")).alias("_l"), F.slice("_p", F.col("start"), F.col("size")).alias("_p"))
    texts = window.select("files", "places", F.substring(F.sha2(_window_text("size"), 256), 1, 16).alias("hash"))
    return texts.groupBy("hash").agg(F.max("files").alias("files"), F.sum("places").alias("places"))


def internal_duplicates(found: DataFrame, key: str) -> DataFrame:
    """(key, hash, places): blocks that come again in a file, more than five lines behind the one before."""
    order = Window.partitionBy(key, "hash").orderBy("start", "size")
    kept = found.withColumn("_b", F.lag("start").over(order)).filter(F.col("_b").isNull() | (F.col("start") > F.col("_b") + 5))
    return kept.groupBy(key, "hash").agg(F.count("*").alias("places")).filter("places > 1")


def cross_file_duplicates(found: DataFrame, key: str) -> DataFrame:
    """(hash, files, places): blocks of two files or more."""
    return found.groupBy("hash").agg(F.countDistinct(key).alias("files"), F.count("*").alias("places")).filter("files > 1")
