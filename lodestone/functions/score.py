"""Scores, vectors, hashes and percentiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the ranking formula over clamped scores. Fixed values.
FUSION = {"vector": 6.5, "text": 3.5, "recency": 0.12, "heat": 0.9, "graph": 1.2}
TEXT_DECAY = 5.0
RECENCY_LAMBDA = 0.01
THRESHOLD = 0.25
TAG_BOOST = 0.2


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """``c`` within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(c)))


def age_days(at: Column | str, now: str) -> Column:
    """Days from a moment to a literal one."""
    return (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(_col(at).cast("timestamp"))) / 86400.0


def age_hours(at: Column | str, now: str) -> Column:
    """Hours from a moment to a literal one."""
    return age_days(at, now) * 24


def recency(age: Column | str) -> Column:
    """1 for today, falling with age."""
    return 1 / (1 + RECENCY_LAMBDA * F.greatest(F.lit(0.0), _col(age)))


def rank_score(rank: Column | str) -> Column:
    """exp(-rank / 5) for a rank from 0."""
    return F.exp(-_col(rank) / TEXT_DECAY)


def fusion(vector: Column | str, text: Column | str, recent: Column | str, heat: Column | str, graph: Column | str) -> Column:
    """The weighted sum of the clamped scores."""
    parts = zip((vector, text, recent, heat, graph), FUSION.values(), strict=True)
    return sum((clamp(c) * w for c, w in parts), F.lit(0.0))


def tag_boost(score: Column | str, matches: Column | str) -> Column:
    """A score raised by a fifth for each matching tag."""
    return F.when(_col(matches) > 0, _col(score) * (1 + TAG_BOOST * _col(matches))).otherwise(_col(score))


def percent_change(before: Column | str, after: Column | str) -> Column:
    """Change in per cent; from 0 it is 0 or 100."""
    before, after = _col(before), _col(after)
    return F.when(before == 0, F.when(after == 0, 0.0).otherwise(100.0)).otherwise((after - before) / before * 100)


def sigmoid(c: Column | str) -> Column:
    """The logistic function."""
    return 1 / (1 + F.exp(-_col(c)))


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product of two arrays."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    """The Euclidean length of an array."""
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where a length is 0."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, 0.0).otherwise(dot(a, b) / lengths)


def valid_vector(a: Column | str, dimensions: int) -> Column:
    """Whether an array has the right length and only finite numbers."""
    return (F.size(_col(a)) == dimensions) & F.forall(_col(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def wave_vector(number: Column | str, dimensions: int) -> Column:
    """The test embedding sin(i + j) / 10."""
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda j: F.sin(_col(number) + j) * 0.1)


def sha256(c: Column | str) -> Column:
    """The digest of a text's UTF-8 bytes, as hexadecimal digits."""
    return F.sha2(_col(c), 256)


def list_hash(values: Column) -> Column:
    """The digest of an aggregated list: sorted by bytes, joined by line feeds."""
    return sha256(F.array_join(F.array_sort(F.collect_list(values)), "\n"))


def manifest_hash(path: Column | str, digest: Column | str) -> Column:
    """The digest of a set of files, from paths and content digests."""
    return sha256(F.array_join(F.array_sort(F.collect_list(F.concat(_col(path), F.lit("\0"), _col(digest), F.lit("\0")))), ""))


def cache_key(*parts: Column | str) -> Column:
    """The key under which an embedding is kept."""
    return F.concat_ws("|", F.lit("v1"), *map(_col, parts))


def fnv1a(c: Column | str) -> Column:
    """The 32-bit FNV-1a hash of the code points."""
    c = _col(c)
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.ascii(F.substring(c, i, F.lit(1))).cast("bigint"))
    # The prime is 2**24 + 403, so the product is taken in two halves that stay within 64 bits.
    step = lambda h, v: F.pmod((h.bitwiseXOR(v)) * 403 + F.pmod(h.bitwiseXOR(v), F.lit(256)) * (1 << 24), F.lit(1 << 32))
    return F.when(F.length(c) == 0, F.lit(2166136261)).otherwise(F.aggregate(chars, F.lit(2166136261), step))


def percentile_floor(values: Column, p: float) -> Column:
    """sorted[floor((n - 1) * p)] of an aggregated list."""
    found = F.array_sort(F.collect_list(values))
    return F.element_at(found, (F.floor((F.size(found) - 1) * p) + 1).cast("int"))


def percentile_nearest(column: str, p: float) -> Column:
    """sorted[ceil(p * n) - 1], the nearest rank."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def percentile_index(values: Column, p: float) -> Column:
    """sorted[floor(n * p)], the last for p = 1."""
    found = F.array_sort(F.collect_list(values))
    return F.element_at(found, F.least(F.floor(F.size(found) * p) + 1, F.size(found)).cast("int"))
