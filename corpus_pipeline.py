"""The corpus pipeline: documents in, packed token sequences out.

Each stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept. Between stages the rows are
written as Parquet in the shared folder and read again, so a lost executor costs a stage at most. All but the last
return the columns of ``documents``.

Results for odd input: null, empty and letterless texts go in the first stage; of repeated rows the second keeps one; rows
without an id are kept by every stage unless their text goes, and are packed without one; different texts under one id
are told apart, but go together as near copies; ties are broken as the operators say; columns beyond those of
``documents`` are carried to the last stage, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.io import table, written
from lodestone.llm import exact_dedup, jaccard_join, language_id, packing, pii


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts that are null or have no letter go."""
    names, model = language_id.train(docs.filter(~language_id.held_out("doc_id")))
    return language_id.keep_known(docs, names, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal but for white space."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates."""
    return jaccard_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by surrogates; ``n_chars`` follows the text."""
    return pii.replace_in(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens, one row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("sequences", sequences),
]

#: SQL can express neither the language model nor the token ids; the stages are tested against plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
