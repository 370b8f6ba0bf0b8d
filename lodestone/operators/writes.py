"""The write rules of a corpus as joins: what each conflict target keeps, replaces, appends or refuses.

Each rule takes what there is and what comes in, and gives what there is afterwards, or the rows to append; ``refused`` rows come with the reason. Of rows that
come in under one key the last one counts. A key with very many incoming rows is folded before any join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows that one task joins and sorts, about. Narrow rows with few values shrink twenty times when they are shuffled, so partitions of so many bytes would hold millions of them.
SPREAD_ROWS = 1 << 18


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the highest ``order``, by a partial aggregate; rows alike in that are ordered by all their columns."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(order, *(c for c in others if c != order))).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in others)).select(*rows.columns)


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """On conflict of ``keys`` the incoming row takes the place of the one that is there, but for the columns ``keep``, which stay. ``parts``: into how many partitions the joins are dealt."""
    new = last_of(incoming, keys, order)
    if parts:
        existing, new = existing.repartition(parts, *keys), new.repartition(parts, *keys)
    held = existing.select(*keys, *(F.col(c).alias(f"_{c}") for c in keep), F.lit(True).alias("_there"))
    new = new.join(held, keys, "left").select(*keys, *(F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in incoming.columns if c not in keys))
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*existing.columns))


def replaced(existing: DataFrame, incoming: DataFrame, owner: list[str], owners: DataFrame | None = None) -> DataFrame:
    """All rows of each owner that comes in take the place of all it had. ``owners``: those that come in, where some have no rows any more."""
    coming = (incoming if owners is None else owners).select(*owner).distinct()
    return existing.join(coming, owner, "left_anti").unionByName(incoming.join(coming, owner, "left_semi") if owners is not None else incoming)


def checked(incoming: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break none of the rules (reason -> what must hold), and the others with ``reason``, the first rule they break. A rule that is null is broken."""
    reason = reduce(lambda rest, r: F.when(~F.coalesce(r[1], F.lit(False)), r[0]).otherwise(rest), reversed(rules.items()), F.lit(None).cast("string"))
    rows = incoming.withColumn("reason", reason)
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")


def embeddings_merged(existing: DataFrame, incoming: DataFrame, order: str, keys: tuple[str, ...] = ("chunk_id", "model"), text: str = "input_text", digest: str = "input_hash") -> tuple[DataFrame, DataFrame]:
    """Embeddings by chunk and model; those made of an empty text, or without its hash, are refused. (what there is afterwards, refused)"""
    good, bad = checked(incoming, {"empty text": F.trim(text) != "", "no hash": F.col(digest).rlike("^[0-9a-f]{64}$")})
    return merged(existing, good.select(*existing.columns), list(keys), order), bad


def pending_versions(versions: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """The versions to append: one for each file (file_id, content_hash) that comes in with another content than its newest version (file_id, version, content_hash, status) has, one higher,
    pending until it is promoted. A newest version that failed is no reason to leave a content out."""
    newest = last_of(versions.select("file_id", "version", "content_hash", "status"), ["file_id"], "version").select("file_id", F.col("version").alias("_v"), F.col("content_hash").alias("_h"), (F.col("status") == "failed").alias("_failed"))
    new = last_of(incoming, ["file_id"], order).join(newest, "file_id", "left")
    changed = F.col("_v").isNull() | ~F.col("content_hash").eqNullSafe(F.col("_h")) | F.col("_failed")
    return new.filter(changed).select("file_id", (F.coalesce("_v", F.lit(0)) + 1).alias("version"), "content_hash", F.lit("pending").alias("status"))


def owned_embeddings(existing: DataFrame, incoming: DataFrame, owners: DataFrame, order: str, keys: tuple[str, ...] = ("project_id", "owner_type", "owner_ref", "profile_hash")) -> tuple[DataFrame, DataFrame]:
    """Embeddings of owners (owner_ref, candidate_version), one for each profile; one for another version than its owner's candidate, or for no owner, is refused. (afterwards, refused)"""
    parts = -(-(existing.count() + incoming.count()) // SPREAD_ROWS) or 1
    rows = incoming.repartition(parts, "owner_ref").join(owners.select("owner_ref", "candidate_version").repartition(parts, "owner_ref"), "owner_ref", "left")
    good, bad = checked(rows, {"no owner": F.col("candidate_version").isNotNull(), "another version": F.col("version") == F.col("candidate_version")})
    return merged(existing, good.select(*existing.columns), list(keys), order, parts=parts), bad.drop("candidate_version")


def registered(existing: DataFrame, incoming: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Repositories (slug, root, ...) by slug; one whose root is another slug's, there or coming in before it, is refused. Ids and times of registration stay. (afterwards, refused)"""
    new = last_of(incoming, ["slug"], order)
    # A root belongs to the slug that has it and doesn't leave it, or else to the first that asks for it.
    staying = existing.select("slug", "root").join(new.select("slug", F.col("root").alias("_to")), "slug", "left").filter(F.col("_to").isNull() | (F.col("_to") == F.col("root")))
    taken = staying.groupBy("root").agg(F.min("slug").alias("_held"))
    first = new.groupBy("root").agg(F.min(F.struct(order, "slug"))["slug"].alias("_first"))
    rows = new.join(taken, "root", "left").join(first, "root")
    good, bad = checked(rows, {"root of another": F.coalesce("_held", "_first") == F.col("slug")})
    keep = tuple(c for c in ("project_id", "registered_at") if c in existing.columns)
    return merged(existing, good.select(*existing.columns), ["slug"], order, keep), bad.select(*incoming.columns, "reason")
