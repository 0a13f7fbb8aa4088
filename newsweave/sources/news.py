"""Reading news documents from several sources: newest rows, claimed batches, fallback lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.fixed_values import CLAIM_PER_SOURCE, COMMENTS_PER_POST, DOCS_PER_SOURCE, ROWS_PER_KEYWORD
from newsweave.functions.text import strip_html
from newsweave.operators.ranking import top_n_per_key


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """All sources in one table; columns a source lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def newest_per_source(news: DataFrame, order: Sequence[Column], limit: int = DOCS_PER_SOURCE) -> DataFrame:
    return top_n_per_key(news, ["source"], order, limit)


def claim_batch(
    news: DataFrame, claimed: DataFrame | None, key: str = "doc_id", limit: int = CLAIM_PER_SOURCE
) -> DataFrame:
    """Up to ``limit`` waiting rows per source that nobody claimed yet, marked as taken."""
    waiting = news.where(F.col("status") == "0")
    if claimed is not None:
        waiting = waiting.join(claimed.select(key), key, "left_anti")
    return top_n_per_key(waiting, ["source"], [F.col(key)], limit).withColumn("status", F.lit("1"))


def backlog(news: DataFrame) -> DataFrame:
    """Waiting rows per source and, under the label ``*``, in total."""
    counts = news.where(F.col("status") == "0").groupBy("source").agg(F.count("*").alias("waiting"))
    total = counts.agg(F.lit("*").alias("source"), F.coalesce(F.sum("waiting"), F.lit(0)).alias("waiting"))
    return counts.unionByName(total)


def cap_per_keyword(news: DataFrame, order: Sequence[Column], limit: int = ROWS_PER_KEYWORD) -> DataFrame:
    return top_n_per_key(news, ["keyword"], order, limit)


def first_comments(comments: DataFrame, post: str, turn: str, text: str, limit: int = COMMENTS_PER_POST) -> DataFrame:
    """The first comments of each post in order, tags stripped, empty ones dropped."""
    kept = top_n_per_key(comments, [post], [F.col(turn)], limit).where(F.coalesce(F.col(text), F.lit("")) != "")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), strip_html(F.col(text)).alias("text"))))
    return kept.groupBy(post).agg(F.transform(ordered, lambda c: c["text"]).alias("comments"))


def first_source_with(ids: DataFrame, key: str, sources: Sequence[DataFrame]) -> DataFrame:
    """Look every id up in the sources, in their order; the first source that has it answers."""
    ranked = [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    found = union_sources(ranked).join(ids.select(key).distinct(), key, "left_semi")
    rest = [c for c in found.columns if c not in (key, "_priority")]
    best = found.groupBy(key).agg(F.min_by(F.struct(*rest), "_priority").alias("_best"))
    return best.select(key, "_best.*")


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """New rows whose key is not stored, one per key."""
    from newsweave.operators.ranking import first_per_key

    fresh = incoming.join(stored.select(key).distinct(), key, "left_anti")
    return first_per_key(fresh, [key], order)
