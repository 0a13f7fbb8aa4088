"""A corpus from documents to packed sequences: quality, near and exact duplicates, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. run() writes the rows
of a stage as Parquet below the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.llm import mixing, near_copies, packing, quality, suffix_dedup
from newsweave.llm.columns import table
from newsweave.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return near_copies.first_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings that stand earlier; n_chars follows the text."""
    rows = suffix_dedup.deduplicated(docs, keep_text=True)
    values = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return rows.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("mixture", mixture),
    ("packing", packed),
]

#: Tokenizing and XXH64 have no SQL; tests hold run() against its stages and brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
