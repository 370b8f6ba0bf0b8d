"""Operator 13: sources mixed to target weights.

A share of all words is divided among the sources by weight; no source gives more than a multiple of what it has, and what is
left over goes to the others by weight until none is above. The targets become whole numbers by Sainte-Lague apportionment:
blocks of a few words go one by one to the source with the highest quotient target / (2 i + 1), i being the blocks it has, and
a source's blocks go to its shards in the same way. Within a shard the documents stand in a seeded order, as one line of words
that is cut into equal blocks; whole passes and then a run of blocks from a seeded start are taken. What a document gives is the
overlap of two intervals, so no block is ever a row and a block may be as small as one likes.

The number of blocks grows with the corpus, so the highest quotients aren't listed. With n parties and k blocks, at most k quotients
exceed total / (2 k - n) and at least k exceed total / (2 k + n): the first bound gives all but a few blocks by a formula, and only
quotients between the two, a few for each party, are ranked. Sources are ranked by a distributed sort, shards of one source by
a window. A source has about as many shards as a shard has rows, so that a hot source is sorted in many small windows and neither
the rows of a shard nor the shards of a source are more than the root of its rows. Texts are read once and never move.

Results for odd input: null, empty and blank texts have no words and give none; a null source is a source, the last one; rows with
a null id, repeated ids and repeated rows are documents like any other (equal rows may be taken unequally, since they are
interchangeable); an empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.io import small, written

WEIGHTS, SHARE, REPEATS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Words of a block: how closely targets are met.
BLOCK = 4


def draw(*parts: Column) -> Column:
    """A seeded number from 0 to 2**48 - 1, as a double that holds it exactly."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double")


def ranked(rows: DataFrame, *by: Column | str) -> DataFrame:
    """``rows`` with ``rank`` from 1 on: sorted by range, numbered within the parts, each part starting where the last one ends. What one
    task sees is a row for each part."""
    parts = written(rows.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = small(written(sizes.select("_part", before.alias("_before")), "starts"))
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return parts.join(starts, part == F.col("_part")).withColumn("rank", rank).drop("_at", "_part", "_before")


def measured(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    """doc_id, source, size (words), u (the document's place in the seeded order)."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    return rows.withColumn("u", draw(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string")))


def sources_of(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> tuple[DataFrame, float]:
    """sid (from 1, by code point, null last), source, source_size, source_rows and target of every source; and the words of the mix.
    Each turn caps the sources that exceed their limit; one row goes to the driver for each turn."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1).cast("int") % len(weights) + 1)
    found = ranked(totals, F.asc_nulls_last("source")).select(F.col("rank").alias("sid"), "source", "source_size", "source_rows", weight.alias("w"))
    found = written(found, "sources")
    total, level = share * (found.agg(F.sum("source_size")).first()[0] or 0), -1.0
    limit = repeats * F.col("source_size")
    while True:
        above = limit < level * F.col("w")
        capped, rest = found.agg(F.coalesce(F.sum(F.when(above, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0))).first()
        new = (total - capped) / rest if rest else level
        if new <= level:  # nothing more was above
            break
        level = new
    target = F.when(limit < level * F.col("w"), limit.cast("double")).otherwise(level * F.col("w"))
    return found.withColumn("target", target).drop("w"), total


def bounds(votes: Column, total: Column, seats: Column, parties: Column) -> tuple[Column, Column]:
    """Of a party's quotients the first ones that are surely among the highest (how many), and how many may be."""
    sure = F.when(2 * seats > parties, F.floor(votes * (2 * seats - parties) / total / 2 + 0.5) - 1).otherwise(F.lit(0))
    may = F.ceil(votes * (2 * seats + parties) / total / 2 + 0.5) + 1
    return F.greatest(sure, F.lit(0)).cast("bigint"), may.cast("bigint")


def undecided(parties: DataFrame, key: str, votes: str, total: Column, seats: Column, n: Column) -> tuple[DataFrame, DataFrame]:
    """``parties`` with ``sure``, and their quotients (all columns, i, quotient) that must be ranked, a few for each."""
    sure, may = bounds(F.col(votes), total, seats, n)
    known = parties.withColumns({"sure": F.when(F.col(votes) > 0, sure).otherwise(F.lit(0).cast("bigint")), "may": may})
    open_ = known.filter(F.col(votes) > 0).withColumn("i", F.explode(F.sequence("sure", "may")))
    return known.drop("may"), open_.withColumn("quotient", F.col(votes) / (2 * F.col("i") + 1)).drop("may")


def source_quotas(sources: DataFrame, total: float, block: int) -> DataFrame:
    """``sources`` with ``quota``: how many blocks each gets of the whole mix."""
    seats, n = int(total / block + 0.5), F.lit(sources.count())
    known, open_ = undecided(sources, "sid", "target", F.lit(float(total) or 1.0), F.lit(seats), n)
    known = written(known, "sources-sure")
    left = seats - (known.agg(F.sum("sure")).first()[0] or 0)
    won = ranked(open_.select("sid", "i", "quotient"), F.desc("quotient"), "sid", "i").filter(F.col("rank") <= left).groupBy(F.col("sid").alias("_sid")).agg(F.count("*").alias("won"))
    quota = F.col("sure") + F.coalesce("won", F.lit(0))
    return known.join(won, F.col("sid") == F.col("_sid"), "left").withColumn("quota", quota).drop("sure", "won", "_sid")


def shard_quotas(shards: DataFrame, block: int, repeats: int) -> DataFrame:
    """``shards`` (sid, source, shard, shard_size, source_size, n_shards, quota of the source) with the passes over each shard, and the
    run of words taken beyond them: its start and its end, which may lie behind the shard's end by less than a turn."""
    known, open_ = undecided(shards, "shard", "shard_size", F.col("source_size"), F.col("quota"), F.col("n_shards"))
    left = F.col("quota") - F.sum("sure").over(Window.partitionBy("sid"))
    place = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("quotient"), "shard", "i"))
    won = open_.select("sid", "shard", "i", "quotient", place.alias("place"))
    known = written(known.withColumn("left", left), "shards-sure")
    limits = known.select(F.col("sid").alias("_sid"), F.col("shard").alias("_shard"), "left")
    won = won.join(limits, (F.col("sid") == F.col("_sid")) & (F.col("shard") == F.col("_shard"))).filter("place <= left").groupBy("_sid", "_shard").agg(F.count("*").alias("won"))
    found = known.join(won, (F.col("sid") == F.col("_sid")) & (F.col("shard") == F.col("_shard")), "left")
    blocks = F.ceil(F.col("shard_size") / block)
    mine = F.least(F.col("sure") + F.coalesce("won", F.lit(0)), repeats * blocks)
    passes = F.when(blocks > 0, F.floor(mine / blocks)).otherwise(F.lit(0))
    start = F.when(blocks > 0, draw(F.lit(SEED), F.lit("run"), F.coalesce("source", F.lit("-")), F.col("shard").cast("string")) % blocks).otherwise(F.lit(0))
    found = found.withColumns({"mine": mine, "passes": passes.cast("bigint"), "start": (F.floor(start) * block).cast("bigint"), "turn": (blocks * block).cast("bigint")})
    return found.withColumn("stop", F.col("start") + (F.col("mine") - F.col("passes") * blocks).cast("bigint") * block).select("sid", "shard", "passes", "start", "stop", "turn")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, shard_rows: int | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target and taken of every document. ``shard_rows``: rows of a shard, about; the root of a source's rows if None."""
    sizes = written(measured(docs, text, doc_id, source), "sizes")
    sources, total = sources_of(sizes, weights, share, repeats)
    sources = written(source_quotas(sources, total, block), "sources-quota")
    wanted = F.ceil(F.col("source_rows") / shard_rows if shard_rows else F.sqrt("source_rows"))
    about = small(sources.select("sid", F.col("source").alias("_source"), "source_size", "target", "quota", wanted.cast("bigint").alias("wanted")))
    shard = F.floor(F.col("u") * F.col("wanted") / float(1 << 48)).cast("int")
    rows = sizes.join(about, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", shard).drop("_source", "wanted")
    line = Window.partitionBy("sid", "shard").orderBy("u", F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = written(rows.withColumn("at", F.coalesce(F.sum("size").over(line), F.lit(0))), "lines")
    shards = rows.groupBy("sid", "source", "shard", "source_size", "quota").agg(F.sum("size").alias("shard_size"))
    shards = written(shards.withColumn("n_shards", F.count("*").over(Window.partitionBy("sid"))), "shards")
    runs = shard_quotas(shards, block, repeats)
    runs = small(written(runs.select(F.col("sid").alias("_sid"), F.col("shard").alias("_shard"), "passes", "start", "stop", "turn"), "runs"))
    rows = rows.join(runs, (F.col("sid") == F.col("_sid")) & (F.col("shard") == F.col("_shard")))
    end = F.col("at") + F.col("size")
    shared = lambda lo, hi: F.greatest(F.least(end, hi) - F.greatest(F.col("at"), lo), F.lit(0))
    over = shared(F.col("start"), F.least("stop", "turn")) + shared(F.lit(0), F.col("stop") - F.col("turn"))
    return rows.select("doc_id", "size", "source", "source_size", "target", (F.col("passes") * F.col("size") + over).cast("bigint").alias("taken"))
