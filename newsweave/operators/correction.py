"""Finding and correcting edges whose relation is not in the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.fixed_values import (
    CORRECTED,
    CORRECTION_CONTEXT,
    CORRECTION_EVENT_RELATIONS,
    CORRECTION_TARGET_RELATIONS,
    CORRECTION_THRESHOLD,
    HEAD_EVENT_WORDS,
    HEAD_ORGANIZATION_WORDS,
    HEAD_PERSON_WORDS,
    NOT_CORRECTED,
)
from newsweave.functions.text import contains_any
from newsweave.operators.ranking import top_n_per_key


def head_kind(head: Column) -> Column:
    """EVENT, ORG, PER or UNK from the look of the text."""
    text = F.trim(head)
    return (
        F.when((F.length(text) > 8) | contains_any(text, HEAD_EVENT_WORDS), "EVENT")
        .when(contains_any(text, HEAD_ORGANIZATION_WORDS), "ORG")
        .when(contains_any(text, HEAD_PERSON_WORDS), "PER")
        .otherwise("UNK")
    )


def _nearby(edges: DataFrame, centre: str, other: str, k: int) -> DataFrame:
    """For every centre enough of its first edges (by relation, then other end) to answer any request
    for the first k that leave one other end out: k edges of each of the first k + 1 other ends.

    The k edges of two ends travel as one row, so the choice of ends needs no join back."""
    few = top_n_per_key(edges.select(centre, "r", other), [centre, other], [F.col("r")], k, spread=False)
    ends = few.groupBy(centre, other).agg(F.collect_list(F.struct("r")).alias("_rs"))
    first = F.array_min(F.transform("_rs", lambda e: e["r"]))
    kept = top_n_per_key(ends.withColumn("_first", first), [centre], [F.col("_first"), F.col(other)], k + 1)
    pairs = F.transform("_rs", lambda e: F.struct(e["r"].alias("r"), F.col(other).alias("end")))
    listed = F.array_sort(F.flatten(F.collect_list(pairs)))
    return kept.groupBy(centre).agg(listed.alias(f"_near_{centre}"))


def edge_context(asked: DataFrame, edges: DataFrame, k: int = CORRECTION_CONTEXT) -> DataFrame:
    """Up to k neighbouring edges of every asked edge: first those out of its head, then those into its tail.

    Edges with the same two ends are left out. ``context`` is an array of (h, r, t).
    """
    out = _nearby(edges, "h", "t", k)
    into = _nearby(edges, "t", "h", k)
    joined = asked.join(out, "h", "left").join(into, "t", "left")
    shape = "array<struct<h: string, r: string, t: string>>"

    def triples(listed: str, build) -> Column:
        return F.coalesce(F.transform(listed, build), F.array().cast(shape))

    from_head = triples("_near_h", lambda e: F.struct(F.col("h").alias("h"), e["r"].alias("r"), e["end"].alias("t")))
    to_tail = triples("_near_t", lambda e: F.struct(e["end"].alias("h"), e["r"].alias("r"), F.col("t").alias("t")))
    heads = F.filter(from_head, lambda e: e["t"] != F.col("t"))
    tails = F.filter(to_tail, lambda e: e["h"] != F.col("h"))
    return joined.withColumn("context", F.slice(F.concat(heads, tails), 1, k)).drop("_near_h", "_near_t")


def correct_relations(
    edges: DataFrame, threshold: float = CORRECTION_THRESHOLD, k: int = CORRECTION_CONTEXT
) -> DataFrame:
    """One result row per edge with an unknown relation: the best allowed relation, or the old one.

    A candidate scores the log share of its relation among the good edges of the same head kind
    (with one added to every count) plus the log of one plus its occurrences in the context.
    """
    vocabulary = sorted({*CORRECTION_EVENT_RELATIONS, *CORRECTION_TARGET_RELATIONS})
    graph = edges.select("h", "r", "t").distinct().withColumn("kind", head_kind(F.col("h")))
    good, bad = graph.where(F.col("r").isin(vocabulary)), graph.where(~F.col("r").isin(vocabulary))
    counts = good.groupBy("kind", "r").agg(F.count("*").alias("n"))
    # four head kinds with at most as many entries as there are relations
    shares = counts.groupBy("kind").agg(
        F.map_from_entries(F.collect_list(F.struct("r", "n"))).alias("_counts"), F.sum("n").alias("_total")
    )
    asked = edge_context(bad, edges.select("h", "r", "t").distinct(), k).join(shares, "kind", "left")
    candidates = F.when(F.col("kind") == "EVENT", F.lit(CORRECTION_EVENT_RELATIONS)).otherwise(F.lit(CORRECTION_TARGET_RELATIONS))

    def score(c: Column) -> Column:
        seen = F.coalesce(F.try_element_at("_counts", c), F.lit(0))
        share = F.log((1 + seen) / (F.coalesce("_total", F.lit(0)) + F.size(candidates)))
        support = F.size(F.filter("context", lambda e: e["r"] == c))
        return F.round(share + F.log(1.0 + support), 4)

    ranked = F.array_sort(F.transform(candidates, lambda c: F.struct((-score(c)).alias("minus"), c.alias("r"))))
    best = asked.withColumn("_best", ranked[0])
    kept = -F.col("_best.minus") > threshold
    return best.select(
        "h",
        F.when(kept, F.col("_best.r")).otherwise(F.col("r")).alias("r"),
        "t",
        F.lit("REL_INVALID").alias("error_type"),
        F.col("r").alias("pre"),
        (-F.col("_best.minus")).alias("score"),
        F.when(kept, CORRECTED).otherwise(NOT_CORRECTED).alias("insert_status"),
    )
