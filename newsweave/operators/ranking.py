"""Top-n, first-row and numbering helpers that hold up when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.session import cut

SALTS = 64
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None, spread: bool = True
) -> DataFrame:
    """Keep the first ``n`` rows of every key in ``order``; ``rank`` keeps the position.

    Spark trims each partition to n rows per key before it shuffles (up to a threshold, raised here
    where needed). With ``spread`` the survivors are first ranked per key and salt, so that a key that
    occurs in every partition is not gathered in one task: at most SALTS * n rows of it are.
    ``spread=False`` saves that step where the rows per key are known to be few.
    """
    name = rank or "_rank"
    session = df.sparkSession
    if n > int(session.conf.get(GROUP_LIMIT, "1000")):
        session.conf.set(GROUP_LIMIT, str(n))
    if spread:
        salted = df.withColumn("_salt", F.spark_partition_id() % SALTS)
        split = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_pre", F.row_number().over(split)).where(F.col("_pre") <= n).drop("_pre", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(whole)).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key as an aggregate: combined before the shuffle, no sort per key."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """A 1-based running number per key over the whole table, without a single-task window.

    Rows are range-partitioned by (key, order) and written out, so partition borders stay fixed;
    numbers inside a partition are shifted by the rows of the same key in earlier partitions.
    """
    columns = [*keys, *order]
    placed = cut(df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part", *keys).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    numbered = placed.withColumn("_at", F.row_number().over(inside))
    return (
        numbered.join(shifts, ["_part", *keys])
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_part", "_at", "_shift")
    )
