"""Tables written by micro-batches: every batch owns one partition, so a replay overwrites itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """The rows of one micro-batch below ``batch=<id>``; running the batch again replaces them."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """All batches, or those before one, with their number in ``batch``."""
    rows = spark.read.schema(f"{schema}, {BATCH} BIGINT").option("basePath", path)
    found = rows.parquet(path)
    return found if before is None else found.where(F.col(BATCH) < before)


def latest_rows(batches: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """Whole-row replace: the newest row of each key."""
    rest = [c for c in batches.columns if c not in (key, BATCH)]
    newest = F.max_by(F.struct(*rest), F.struct(BATCH, *order)).alias("_r")
    return batches.groupBy(key).agg(newest).select(key, "_r.*")


def latest_fields(batches: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """Field-level set: for each key and field the newest value that is not null."""
    rest = [c for c in batches.columns if c not in (key, BATCH)]
    fields = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(BATCH, *order))).alias(c) for c in rest]
    return batches.groupBy(key).agg(*fields)


def compact(batches: DataFrame, path: str, batch_id: int) -> None:
    """Write the merged rows as one batch of a new table."""
    write_batch(batches, path, batch_id)
