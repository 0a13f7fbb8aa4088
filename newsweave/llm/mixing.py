"""Mixing sources to target weights by Pareto order sampling.

A source's target fixes the expected copies of its documents: proportional to an inclusion weight, at
most MOST_COPIES, and together worth the target in words. The whole part of that number is taken for
certain. The rest f is an inclusion probability: documents are ranked by (u / (1 - u)) / (f / (1 - f))
with u hashed from the id, and the sample is the head of that ranking, as many words as the target
leaves. The document that would overshoot is passed over, and the gap it leaves is closed by the one
unselected document whose size comes nearest to it.

The ranking is never sorted as a whole: rank / (1 + rank) lies in (0, 1) and is cut into BUCKETS; sums
per bucket find the one bucket per source in which the head ends, and only that one is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.llm.columns import hint_small, uniform, word_count
from newsweave.session import cut

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
BUCKETS = 1 << 13
SEED = "mix"


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes. A
    target stops at MOST_COPIES times the size of its source; the excess goes to the others by weight
    until no target is above its stop. One row per source goes through a single window: sources are the
    entries of a mixture, not data.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sizes.withColumn("w", weight.cast("long")).withColumn("stop", MOST_COPIES * F.col("source_size"))
    # Those with the smallest stop per weight stop first; the share per weight is the first that none exceeds.
    fill = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("stop").over(before), F.lit(0))
    rows = rows.withColumn("share", left / F.sum("w").over(rest))
    rows = rows.withColumn("stops", F.col("share") * F.col("w") > F.col("stop"))
    free = F.max(F.when(~F.col("stops"), F.col("share"))).over(Window.partitionBy())
    target = F.when(F.col("stops"), F.col("stop").cast("double")).otherwise(free * F.col("w"))
    return rows.select("source", "source_size", target.alias("target"))


def class_copies(classes: DataFrame) -> DataFrame:
    """Expected copies per (source, inclusion weight): min(MOST_COPIES, a * weight), worth the target.

    Larger weights stop first; ``a`` is the first multiplier that the rest does not exceed.
    """
    order = Window.partitionBy("source").orderBy(F.col("weight").desc())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - MOST_COPIES * F.coalesce(F.sum("words").over(before), F.lit(0))
    worth = F.sum(F.col("weight") * F.col("words")).over(rest)
    rows = classes.withColumn("a", F.when(worth > 0, left / worth))
    rows = rows.withColumn("stops", F.coalesce(F.col("a") * F.col("weight") >= MOST_COPIES, F.lit(False)) | (F.col("target") >= MOST_COPIES * F.col("source_size")))
    free = F.max(F.when(~F.col("stops"), F.struct("weight", "a"))).over(Window.partitionBy("source"))["a"]
    copies = F.when(F.col("stops"), F.lit(float(MOST_COPIES))).otherwise(F.least(F.coalesce(free * F.col("weight"), F.lit(0.0)), F.lit(float(MOST_COPIES))))
    return rows.select("source", "weight", "source_size", "target", copies.alias("copies"))


def mixture(docs: DataFrame, weight: Column | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, and the columns to carry (named carry_...), one row per input row.

    ``weight`` is a small whole number per row (rows of one source are summed by it); by default the
    number of binary digits of the size, so longer documents are somewhat likelier. Null text has size 0,
    a null source is a source of its own, equal rows are rows of their own (ties go by row), and equal
    ids share their u. An empty table gives an empty table; with all sizes 0 every target is 0.
    """
    size = word_count(F.col(text))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), size.alias("_size"), (F.length(F.bin(size)) if weight is None else weight).cast("long").alias("_weight"), *[F.col(f"`{c}`").alias(f"_carry_{c}") for c in carry])
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    classes = cut(rows.groupBy(F.col("_source").alias("source"), F.col("_weight").alias("weight")).agg(F.sum("_size").alias("words")))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    both = classes.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    copies = cut(class_copies(both))
    same = F.col("_source").eqNullSafe(F.col("source"))
    ranked = rows.join(hint_small(copies), same & (F.col("_weight") == F.col("weight"))).drop("weight", "_weight")
    u, certain = uniform(F.col("_id"), SEED), F.floor("copies")
    rest = F.col("copies") - certain
    rank = F.when(rest > 0, (u / (1 - u)) / (rest / (1 - rest)))
    ranked = ranked.withColumns({"_certain": certain, "_rank": rank})
    ranked = ranked.withColumn("_bucket", F.floor(F.col("_rank") / (1 + F.col("_rank")) * BUCKETS))

    # Words left to the sample, and the bucket of every source in which they end.
    wanted = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("_certain") * F.col("_size"))).alias("_wanted"))
    per_bucket = ranked.where(F.col("_rank").isNotNull()).groupBy("source", "_bucket").agg(F.sum("_size").alias("_words"))
    along = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = per_bucket.withColumn("_before", F.coalesce(F.sum("_words").over(along), F.lit(0)))
    ends = ends.withColumnRenamed("source", "s").join(wanted, F.col("s").eqNullSafe(F.col("source")))
    last = cut(ends.where(F.col("_before") <= F.col("_wanted")).groupBy("source").agg(F.max(F.struct("_bucket", "_before")).alias("_end"), F.first("_wanted").alias("_wanted")))
    last = hint_small(last.select(F.col("source").alias("s"), F.col("_end._bucket").alias("_last"), F.col("_end._before").alias("_before"), "_wanted"))

    placed = ranked.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = placed.where(F.col("_bucket") == F.col("_last"))
    order = Window.partitionBy("source").orderBy("_rank", "_id", "_size", "_row")
    so_far = F.col("_before") + F.sum("_size").over(order)
    head = inside.select("_row", "_size", (so_far <= F.col("_wanted")).alias("_in"), F.col("source"), F.col("_wanted"), F.col("_before"))
    head = cut(head)
    full = head.groupBy("source").agg((F.first("_wanted") - F.first("_before") - F.sum(F.when(F.col("_in"), F.col("_size")).otherwise(0))).alias("_gap"))
    open_ = placed.where(F.col("_bucket") >= F.col("_last")).join(head.where("_in").select("_row"), "_row", "left_anti")
    gaps = hint_small(cut(full.select(F.col("source").alias("s"), "_gap")))
    near = F.abs(F.col("_size") - F.col("_gap"))
    closing = open_.join(gaps, F.col("source").eqNullSafe(F.col("s"))).where((F.col("_size") > 0) & (near < F.col("_gap")))
    closing = closing.groupBy("source").agg(F.min_by("_row", F.struct(near, "_rank", "_id", "_row")).alias("_row"))
    extra = head.where("_in").select("_row").unionByName(closing.select("_row")).withColumn("_extra", F.lit(1))
    done = placed.join(extra, "_row", "left")
    taken = F.col("_certain") + F.when(F.col("_bucket") < F.col("_last"), 1).otherwise(F.coalesce("_extra", F.lit(0)))
    return done.select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (taken * F.col("_size")).alias("taken"),
        taken.alias("copies"),
        *[F.col(f"`_carry_{c}`").alias(f"carry_{c}") for c in carry],
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each as often as it is taken, with its own columns."""
    rows = mixture(docs, carry=tuple(docs.columns)).where(F.col("copies") * F.col("size") > 0)
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*[F.col(f"`carry_{c}`").alias(c) for c in docs.columns])
