"""String functions of the retrieval engine as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def _accent_tables() -> tuple[str, str]:
    """Characters that decompose to one base character and marks, and those bases (by Unicode's own rule, up to U+1FFF)."""
    source, target = [], []
    for code in range(0xA0, 0x2000):
        parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(code):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def unaccent(c: Column | str) -> Column:
    """Letters without their diacritics: a table lookup for composed ones, marks removed. Plain ASCII is left as it is."""
    return F.when(_col(c).rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(_col(c), *_accent_tables()), r"\p{M}", "")).otherwise(_col(c))


def blank_as(c: Column | str, other: Column | str) -> Column:
    """``other`` where the first is null or empty."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), _col(other))


def search_text(*parts: Column | str) -> Column:
    """The normalised text that search matches: parts joined by blanks, without diacritics, lower case."""
    return F.lower(unaccent(F.concat_ws(" ", *map(_col, parts))))


def document_search_text(title: Column | str, category: Column | str, kind: Column | str, language: Column | str, authority: Column | str, searchable: Column | str, content: Column | str) -> Column:
    """What search sees of a document: its searchable text, or else its content, behind the fields that describe it."""
    return search_text(title, category, kind, language, authority, blank_as(searchable, content))


def chunk_search_text(heading: Column | str, section: Column | str, searchable: Column | str, content: Column | str) -> Column:
    """What search sees of a chunk of a document."""
    return search_text(heading, section, blank_as(searchable, content))


def file_search_text(path: Column | str, language: Column | str, skeleton: Column | str) -> Column:
    """What search sees of a source file."""
    return search_text(path, language, skeleton)


def code_search_text(name: Column | str, kind: Column | str, signature: Column | str, searchable: Column | str, content: Column | str) -> Column:
    """What search sees of a chunk of code."""
    return search_text(name, kind, signature, blank_as(searchable, content))


def split_camel(c: Column | str) -> Column:
    """A blank at each hump of camel case."""
    return F.regexp_replace(_col(c), "([a-z0-9])([A-Z])", "$1 $2")


def terms(c: Column | str, camel: bool = True) -> Column:
    """Query terms: camel case split (for prose; not for code), lower case, split at anything but ``[a-z0-9_./-]``."""
    text = unaccent(c)
    return F.split(F.lower(split_camel(text) if camel else text), "[^a-z0-9_./-]+")


def identifiers(c: Column | str) -> Column:
    """Identifier-like words (camel hump, underscore, dot or slash) reduced to ``[a-z0-9]``, three characters or more, distinct."""
    words = F.transform(F.split(_col(c), r"[^\p{L}\p{N}_./-]+"), unaccent)
    shaped = F.filter(words, lambda w: w.rlike("[a-z][A-Z]|[_./]"))
    plain = F.transform(shaped, lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]+", ""))
    return F.array_distinct(F.filter(plain, lambda w: F.length(w) >= 3))


def directory(path: Column | str) -> Column:
    """The part before the last slash; ``root`` without one."""
    found = F.regexp_extract(_col(path), "^(.*)/[^/]*$", 1)
    return F.when(found == "", F.lit("root")).otherwise(found)


def basename(path: Column | str) -> Column:
    """The part after the last slash."""
    return F.substring_index(_col(path), "/", -1)


def extension(path: Column | str) -> Column:
    """What follows the last dot, lower case; ``unknown`` without one."""
    return F.when(_col(path).contains("."), F.lower(F.substring_index(_col(path), ".", -1))).otherwise(F.lit("unknown"))


def title_case(c: Column | str) -> Column:
    """The first character in upper case."""
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def topic_terms(c: Column | str) -> Column:
    """Words of a path or name for topics: camel case split, lower case, three characters or more."""
    split = F.split(F.lower(F.regexp_replace(_col(c), "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9_./-]+|[/._-]+")
    return F.filter(split, lambda t: F.length(t) >= 3)


def identifier_words(c: Column | str) -> Column:
    """The words of an identifier: split at camel humps and anything but letters and digits."""
    return F.filter(F.split(F.trim(F.regexp_replace(split_camel(c), "[^a-zA-Z0-9]+", " ")), r"\s+"), lambda w: w != "")


def kebab(c: Column | str) -> Column:
    """Words of an identifier in lower case, joined by hyphens."""
    return F.array_join(F.transform(identifier_words(c), F.lower), "-")


def canonical_topic(c: Column | str) -> Column:
    """A topic in the singular: ``ies`` becomes ``y``, a last ``s`` goes (but not of ``ss``)."""
    c = _col(c)
    cut = lambda n: F.substring(c, F.lit(1), F.length(c) - n)
    return F.when(c.endswith("ies") & (F.length(c) > 4), F.concat(cut(3), F.lit("y"))).when(c.endswith("s") & (F.length(c) > 3) & ~c.endswith("ss"), cut(1)).otherwise(c)


def normalised_topic(c: Column | str, stop: list[str]) -> Column:
    """The kebab form, or null where it is shorter than two characters or a stop word."""
    k = kebab(c)
    return F.when((F.length(k) < 2) | k.isin(stop), F.lit(None).cast("string")).otherwise(k)


def slug(c: Column | str) -> Column:
    """A heading's anchor."""
    plain = F.regexp_replace(F.lower(unaccent(c)), r"[`*_#\[\]()<>{}]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def stored_path(path: Column | str) -> Column:
    """A path with forward slashes, without ``./`` at its start and doubled slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(path), r"\\", "/"), "/{2,}", "/"), r"^(?:\./)+", "")


def paths_match(a: Column | str, b: Column | str) -> Column:
    """Equal, or the first ends in a slash and the second."""
    return (_col(a) == _col(b)) | F.endswith(_col(a), F.concat(F.lit("/"), _col(b)))


def one_line(c: Column | str) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def snippet(content: Column | str, query: str, before: int = 48, after: int = 72) -> Column:
    """The text around the first match, case ignored; null without one."""
    content = _col(content)
    at = F.instr(F.lower(content), query.lower())
    start = F.greatest(F.lit(1), at - before)
    cut = F.substring(content, start, F.least(at + len(query) + after, F.length(content) + 1) - start)
    return F.when(at > 0, one_line(cut))


def term_snippet(content: Column | str, words: list[str]) -> Column:
    """The first paragraph with all the words; null for fewer than two words."""
    if len(words) < 2:
        return F.lit(None).cast("string")
    parts = F.filter(F.transform(F.split(_col(content), r"\n\s*\n"), one_line), lambda p: p != "")
    hits = F.filter(parts, lambda p: reduce(lambda a, b: a & b, (F.lower(p).contains(w) for w in words)))
    return F.get(hits, 0)


def truncate(content: Column | str, limit: int) -> Column:
    """Cut to ``limit`` with an ellipsis, at the last line or sentence end behind character 80 if there is one."""
    content = _col(content)
    cut = F.substring(content, 1, max(0, limit - 3))
    # Place (from 0) of the last occurrence: -1 without one.
    last = lambda mark: F.when(F.instr(cut, mark) > 0, F.length(cut) - F.length(F.substring_index(cut, mark, -1)) - len(mark)).otherwise(-1)
    boundary = F.greatest(last("\n"), last(". "), last("; "))
    kept = F.when(boundary > 80, F.substring(cut, F.lit(1), boundary)).otherwise(cut)
    return F.when(F.length(content) <= limit, content).otherwise(F.concat(F.rtrim(F.regexp_replace(kept, r"\s+$", "")), F.lit("...")))


def key_lines(content: Column | str, limit: int) -> Column:
    """Headings, then bullets, then sentences of the text outside code fences; distinct, at most ``limit``."""
    prose = F.regexp_replace(_col(content), "(?s)```.*?```", "")
    lines = F.filter(F.transform(F.split(prose, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^[-=*`#\s]+$"))
    sentences = F.filter(F.transform(F.split(F.regexp_replace(prose, r"\s+", " "), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    found = F.concat(F.filter(lines, lambda x: x.rlike(r"^#{1,4}\s+")), F.filter(lines, lambda x: x.rlike(r"^[-*]\s+")), sentences)
    bare = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"^#{1,4}\s+", ""), r"^[-*]\s+", ""))
    return F.slice(F.array_distinct(bare), 1, limit)


#: Words that say a text is for the advanced reader. Fixed values.
ADVANCED = ["concurrency", "vector", "embedding", "distributed", "consistency", "transaction", "benchmark", "optimization"]
#: Frequent words that don't count as significant. Fixed values.
FREQUENT = ["that", "this", "with", "from", "have", "will", "your", "which", "their", "there", "would", "could", "should"]


def complexity(body: Column | str) -> Column:
    """beginner, intermediate or advanced, from signal words, code fences and length."""
    body = _col(body)
    fences = F.regexp_count(body, F.lit("```"))
    signal = reduce(lambda a, b: a | b, (F.lower(body).contains(w) for w in ADVANCED))
    return F.when(signal | (fences >= 6), "advanced").when((fences >= 2) | (F.length(body) >= 2500), "intermediate").otherwise("beginner")


def adaptation_issues(original: Column | str, adapted: Column | str) -> Column:
    """What is wrong with an adapted text: codes in a fixed order."""
    original, adapted = _col(original), _col(adapted)
    words = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(original, F.lit(r"(?<![A-Za-z0-9_])[a-zA-Z]{4,}(?![A-Za-z0-9_])"), F.lit(0)), F.lower), lambda w: ~w.isin(FREQUENT)))
    kept = F.size(F.filter(words, lambda w: F.contains(F.lower(adapted), w)))
    fence = lambda c: F.regexp_count(c, F.lit("(?s)```.*?```"))
    checks = [
        (F.length(F.trim(adapted)) < 50, "too-short"),
        (F.length(adapted) > 2 * F.length(original), "too-long"),
        ((fence(original) > 0) & (fence(adapted) == 0), "code-lost"),
        ((F.size(words) > 5) & (kept * 2 < F.size(words)), "terms-lost"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in checks)))


def token_estimate(c: Column | str) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(_col(c), F.lit(""))) / 4).cast("bigint")


def without_control(c: Column | str) -> Column:
    """Control characters other than tab, line feed and carriage return as blanks."""
    return F.regexp_replace(_col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")


def embedding_input(searchable: Column | str, content: Column | str, limit: int = 2000) -> Column:
    """What is embedded for a chunk."""
    return F.substring(blank_as(searchable, content), 1, limit)


def query_instruction(query: Column | str, task: str) -> Column:
    """The text that is embedded for a query."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), _col(query))


def project_name(root: Column | str) -> Column:
    """A title from a root path."""
    words = F.filter(F.split(F.regexp_replace(basename(F.regexp_replace(_col(root), "[/\\\\]+$", "")), "[-_.]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, title_case), " ")


def project_slug(name: Column | str) -> Column:
    """A name in lower case with hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(unaccent(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
