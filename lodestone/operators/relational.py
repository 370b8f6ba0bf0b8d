"""Relational operators of the engine as DataFrame transformations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.io import small


def optional_filter(df: DataFrame, **values: object) -> DataFrame:
    """Keeps rows equal to the given values; a parameter that is None adds no predicate to the plan, a list means membership."""
    given = [(F.col(k).isin(v) if isinstance(v, list) else F.col(k) == v) for k, v in values.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def with_total(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows with the number of all rows beside them: an aggregate of one row, not a window over everything."""
    return df.orderBy(*order).limit(limit).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def fallback_join(files: DataFrame, rows: DataFrame, key: str = "file_id", version: str = "version_id") -> DataFrame:
    """Rows of each file's version, or, for files without any, rows that have no version."""
    exact = files.join(rows, [key, version], "left_semi").select(key, version)
    versioned = rows.join(files, [key, version])
    loose = rows.filter(F.col(version).isNull()).drop(version)
    rest = files.join(exact, [key, version], "left_anti")
    return versioned.unionByName(rest.join(loose, key).select(*versioned.columns))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str, name: str) -> DataFrame:
    """(relation, orphans): how many rows of ``child`` name no row of ``parent``. Null names are no orphans."""
    gone = child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return gone.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("relation"), "orphans")


def gaps(df: DataFrame, key: str, index: str) -> DataFrame:
    """(key, missing): indices from 0 to each key's largest that have no row."""
    wanted = df.groupBy(key).agg(F.max(index).alias("_top")).select(key, F.explode(F.sequence(F.lit(0), F.col("_top"))).alias(index))
    return wanted.join(df.select(key, index), [key, index], "left_anti").withColumnRenamed(index, "missing")


def delta(tracked: DataFrame, candidate: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(key, change): add, update, delete or unchanged, by a full outer join on the key."""
    old, new = tracked.select(key, F.col(digest).alias("_old")), candidate.select(key, F.col(digest).alias("_new"))
    change = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update").otherwise("unchanged")
    return old.join(new, key, "full").select(key, change.alias("change"))


def delta_summary(changes: DataFrame) -> DataFrame:
    """Counts by change, the total and the number of tracked rows, and whether the change needs a review."""
    n = lambda c: F.count_if(F.col("change") == c)
    out = changes.agg(n("add").alias("adds"), n("update").alias("updates"), n("delete").alias("deletes"), n("unchanged").alias("unchanged"))
    out = out.withColumn("total_delta", F.col("adds") + F.col("updates") + F.col("deletes")).withColumn("tracked", F.col("updates") + F.col("deletes") + F.col("unchanged"))
    review = (F.col("total_delta") >= 500) | ((F.col("tracked") > 0) & (F.col("total_delta") >= 0.25 * F.col("tracked")))
    return out.withColumn("needs_review", review)


def prefix_lookup(df: DataFrame, column: str, dimension: DataFrame, prefix: str) -> DataFrame:
    """Rows with the dimension row whose prefix begins the column; the dimension is small by its nature."""
    return df.join(small(dimension), F.startswith(F.lower(F.col(column)), F.col(prefix)), "left")


def capped(df: DataFrame, text: str, limit: int, each: int, *order: Column) -> DataFrame:
    """Rows in order while a budget of characters lasts; each text is cut to ``each`` and to what is left."""
    size = F.least(F.length(F.coalesce(text, F.lit(""))), F.lit(each))
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = df.withColumn("_left", F.lit(limit) - F.coalesce(F.sum(size).over(window), F.lit(0)))
    return spent.filter("_left > 0").withColumn(text, F.substring(F.col(text), F.lit(1), F.least(size, F.col("_left")).cast("int"))).drop("_left")


def invariant_counts(**checks: Column) -> list[Column]:
    """One count for each predicate, for a single pass."""
    return [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()]
