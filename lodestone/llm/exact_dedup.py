"""Operator 1: exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of code points. The distinct blocks are sorted and numbered, so a
block's integer *name* stands for its content and no other. Then names of adjacent blocks are paired, the distinct pairs
are sorted and numbered in turn, and so on until each document has one name. Documents with the same number of blocks
and the same final name are equal, and only they: nothing rests on a hash. The digests below only carry a block to its
name; that no two distinct blocks share one is checked, and if two did, the blocks themselves would be joined instead.

The text is shuffled once, after map-side removal of repeated blocks, so a group of copies of any size arrives as one row
for each map task. Everything after that moves rows of a few integers, and joins on them may be split by AQE.

Results for odd input: null text counts as empty, and empty texts equal one another; of equal rows (same text, same id)
exactly one is kept; a null id stays only if its group has no other row as long; an empty table gives no rows; columns
that clash with internal names are untouched, since only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.io import small, written
from lodestone.llm.common import SPACES, unused

#: Code points in a block.
BLOCK = 4096


def normalised(text: str) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{SPACES}]+", "")


def numbered_rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text and ``_row``, a number for each row that stays the same while the files stay the same."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_row"))


def numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """Distinct rows sorted within their partitions and numbered; the partition's number leads, so names are unique."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def blocks(docs: DataFrame, block: int) -> DataFrame:
    """One row for each block: _row, doc_id, n_chars, text_sha256, n_blocks, at, block and its digests."""
    plain = docs.select("_row", "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), normalised("text").alias("plain"))
    cut = F.when(F.length("plain") <= block, F.array("plain")).otherwise(F.regexp_extract_all("plain", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    plain = plain.select("_row", "doc_id", "n_chars", F.sha2("plain", 256).alias("text_sha256"), cut.alias("cut"))
    found = plain.select("_row", "doc_id", "n_chars", "text_sha256", F.size("cut").alias("n_blocks"), F.posexplode("cut").alias("at", "block"))
    return found.withColumns({"h1": F.xxhash64("block"), "h2": F.xxhash64(F.lit("second"), "block"), "size": F.length("block")})


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """_row, doc_id, n_chars, text_sha256, n_blocks, name: equal texts have equal (n_blocks, name). ``docs``: see ``numbered_rows``."""
    found = blocks(docs, block)
    key = ["h1", "h2", "size"]
    names = written(numbered(found.select(*key, "block").distinct(), *key, "block").drop("block"), "block-names")
    if names.groupBy(*key).count().filter("count > 1").isEmpty():
        named = found.drop("block").join(names, key)
    else:
        named = found.join(numbered(found.select("block").distinct(), "block"), "block")
    columns = ["_row", "doc_id", "n_chars", "text_sha256", "n_blocks", "at", "name"]
    named = written(named.select(*columns), "named-blocks")
    done = named.filter("n_blocks = 1").select(*columns[:5], "name")
    longest = named.filter("n_blocks > 1").agg(F.max("n_blocks")).first()[0] or 1
    level = named.filter("n_blocks > 1").select(*columns)
    while longest > 1:
        pair = level.groupBy(*columns[:5], F.floor(F.col("at") / 2).cast("int").alias("at")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        pair_names = numbered(pair.select("left", "right").distinct(), "left", "right")
        level = written(pair.join(pair_names, ["left", "right"]).select(*columns), "named-pairs")
        longest = (longest + 1) // 2
    return done.unionByName(level.select(*columns[:5], "name"))


def find_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, _row. Of equal texts the one with the most code
    points before normalisation stays, then the smallest id."""
    named = identities(numbered_rows(docs, text, doc_id), block)
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("id"), (-F.col("_row")).alias("row")))
    groups = named.groupBy("n_blocks", "name").agg(best.alias("best"), F.count("*").alias("group_size"))
    joined = named.join(groups, ["n_blocks", "name"])
    return joined.select("doc_id", (-F.col("best.id")).alias("keep_id"), "group_size", (F.col("_row") == -F.col("best.row")).alias("kept"), "text_sha256", "_row")


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``. ``docs`` must be read from files, which two scans number alike; a number
    that meets another id is an error."""
    gone = written(find_copies(docs, text, doc_id, block).filter(~F.col("kept")).select("_row", "doc_id"), "copies")
    row, gone_row, gone_id = (unused(docs, c) for c in ("_row", "_gone_row", "_gone_id"))
    gone = small(gone.select(F.col("_row").alias(gone_row), F.col("doc_id").alias(gone_id)))
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    same = F.when(F.col(doc_id).eqNullSafe(F.col(gone_id)), True).otherwise(F.raise_error(F.lit("the files were split otherwise in a second scan")).cast("boolean"))
    return rows.join(gone, (F.col(row) == F.col(gone_row)) & same, "left_anti").select(*docs.columns)
