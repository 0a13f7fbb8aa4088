"""Triples with descriptions, entity resolution, samples and vocabularies of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def triples_with_descriptions(
    edges: DataFrame, nodes: DataFrame, order: list[str], limit: int | None = None
) -> DataFrame:
    """Edges joined with the description of both ends; the relation falls back to the edge type.

    ``nodes`` has ``id`` and ``description``; an end without a node is described by its id.
    """
    heads = nodes.select(F.col("id").alias("h"), F.col("description").alias("h_desc"))
    tails = nodes.select(F.col("id").alias("t"), F.col("description").alias("t_desc"))
    named = edges.withColumn("r", F.coalesce(F.nullif("relation", F.lit("")), "type"))
    joined = named.join(heads, "h", "left").join(tails, "t", "left")
    rows = joined.select(
        "h",
        "r",
        "t",
        F.coalesce("h_desc", "h").alias("h_desc"),
        F.coalesce("t_desc", "t").alias("t_desc"),
        *[c for c in order if c not in ("h", "r", "t")],
    )
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def completion_samples(triples: DataFrame) -> DataFrame:
    """Instruction, input and expected output per triple."""
    return triples.select(
        F.lit("知识图谱补全任务：根据头实体和关系类型，预测尾实体。").alias("instruction"),
        F.concat(F.lit("头实体信息: "), "h_desc", F.lit("\n关系类型: "), "r").alias("input"),
        F.col("t_desc").alias("output"),
    )


def edge_type_per_relation(edges: DataFrame, pos: str) -> DataFrame:
    return edges.groupBy("relation").agg(F.min_by("type", pos).alias("type"))


def entity_index(nodes: DataFrame, id_column: str, names: list[str]) -> DataFrame:
    """token -> id over the id itself and every name column; the smallest id wins a shared name."""
    tokens = F.array(F.col(id_column), *[F.nullif(F.col(c), F.lit("")) for c in names])
    rows = nodes.select(F.col(id_column).alias("id"), F.explode(tokens).alias("token"))
    own = (F.col("token") != F.col("id")).cast("int")
    rows = rows.where(F.col("token").isNotNull())
    return rows.groupBy("token").agg(F.min_by("id", F.struct(own, "id")).alias("id"))


def display_names(nodes: DataFrame, id_column: str, names: list[str]) -> DataFrame:
    """The longest name of each node; its id where it has none."""
    rows = nodes.select(F.col(id_column).alias("id"), F.explode(F.array(*names)).alias("name"))
    longest = F.max_by("name", F.struct(F.length("name"), "name")).alias("name")
    best = rows.groupBy("id").agg(longest)
    return best.select("id", F.coalesce(F.nullif("name", F.lit("")), "id").alias("name"))


def resolve(mentions: DataFrame, column: str, index: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Ids for the mentioned names: first index, then the node table, else the text itself."""
    first = index.select(F.col("token").alias(column), F.col("id").alias("_first"))
    found = mentions.join(first, column, "left")
    sides = ["_first"]
    if fallback is not None:
        second = fallback.select(F.col("token").alias(column), F.col("id").alias("_second"))
        found = found.join(second, column, "left")
        sides.append("_second")
    return found.withColumn("id", F.coalesce(*sides, column)).drop(*sides)


def labelled_sample(edges: DataFrame, labels: DataFrame, order: list[str], n: int = 15) -> DataFrame:
    """A few triples with readable ends; labels are looked up for the sampled rows only."""
    sample = edges.orderBy(*order).limit(n)
    heads = labels.select(F.col("id").alias("h"), F.col("name").alias("_h"))
    tails = labels.select(F.col("id").alias("t"), F.col("name").alias("_t"))
    named = sample.join(heads, "h", "left").join(tails, "t", "left")
    return named.select(F.coalesce("_h", "h").alias("h"), "r", F.coalesce("_t", "t").alias("t"))
