"""Keyed upserts, partitioned table writes and scratch tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert_replace(stored: DataFrame, incoming: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """Whole-row replace: the latest incoming row of a key wins, stored rows without a newer one stay."""
    incoming = latest_per_key(incoming, key, order)
    kept = stored.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def upsert_set(stored: DataFrame, incoming: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """Field-level set: a non-null value of the latest incoming row of a key wins, other stored fields stay.

    ``change`` says insert, update or keep.
    """
    incoming = latest_per_key(incoming, key, order)
    old, new = stored.alias("old"), incoming.alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    columns = list(dict.fromkeys([*stored.columns, *incoming.columns]))

    def value(name: str) -> Column:
        sides = [F.col(f"{side}.{name}") for side, df in (("new", incoming), ("old", stored)) if name in df.columns]
        return F.coalesce(*sides).alias(name)

    change = (
        F.when(F.col(f"old.{key}").isNull(), "insert").when(F.col(f"new.{key}").isNull(), "keep").otherwise("update")
    )
    return joined.select(*[value(c) for c in columns], change.alias("change"))


def latest_per_key(rows: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """The last row of each key, as an aggregate that combines before the shuffle.

    Ties, and rows without an order, are settled by the greatest values.
    """
    rest = [c for c in rows.columns if c != key]
    if not rest:
        return rows.distinct()
    last = F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("_last")
    return rows.groupBy(key).agg(last).select(key, "_last.*")


def write_tables(df: DataFrame, path: str, partition: str) -> None:
    """One folder per tag or kind, replaced as a whole."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def reset_table(spark: SparkSession, df_like: DataFrame, path: str) -> None:
    """Leave an empty table of the same shape, as before and after a run."""
    df_like.limit(0).write.mode("overwrite").parquet(path)
