"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh, 2016).

A fingerprint has bit b set when more than half of the hashes of the text's three-word shingles have it.
For radius r every bit gets a vector m of r + 1 binary coordinates. Table v, for each of the 2^(r+1) - 1
vectors v other than zero, keeps the bits whose m has an odd product with v. Any r bits leave a v that is
even with all of them, so two fingerprints within the radius are equal in some table: no link is missed.
Tables hold different fingerprints only; copies of a text are one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from newsweave.operators.components import connected_components
from newsweave.session import cut

RADIUS = 2
SHINGLE = 3
SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCK = 1 << 16


def simhash(text: str | None) -> int:
    """Unsigned 64-bit fingerprint; zero without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    line = memoryview(b" ".join(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    width = min(SHINGLE, len(tokens))
    starts = [0, *(ends[: len(tokens) - width] + 1).tolist()]
    stops = ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(t) for t in texts], dtype=np.uint64).view(np.int64))


def table_masks(radius: int = RADIUS) -> list[int]:
    """One mask of kept bits per table, as signed numbers."""
    top = 1 << (radius + 1)
    vectors = [1 + b % (top - 1) for b in range(64)]
    masks = []
    for v in range(1, top):
        mask = sum(1 << b for b, m in enumerate(vectors) if bin(m & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def close_pairs(prints: DataFrame, column: str = "fp", radius: int = RADIUS) -> DataFrame:
    """(a, b): different fingerprints with at most ``radius`` differing bits; prints holds each once."""
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col(column).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(table_masks(radius))])
    rows = prints.select(F.col(column).alias("fp"), F.explode(keys).alias("k")).select("fp", "k.*")
    left, right = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    met = left.join(right, ["table", "key"]).where((F.col("a") < F.col("b")) & near)
    return met.select("a", "b").distinct()


def components(marked: DataFrame, doc_id: str = "doc_id", column: str = "fp", radius: int = RADIUS) -> DataFrame:
    """(fp, component_id): for each fingerprint the smallest id of a document that links lead to."""
    prints = cut(marked.groupBy(F.col(column).alias("fp")).agg(F.min(doc_id).alias("first")))
    groups = connected_components(close_pairs(prints, "fp", radius)).withColumnRenamed("id", "fp")
    rows = prints.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = rows.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.select("fp", "component").join(smallest, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id, one row per input row.

    Null and empty texts share fingerprint zero and link like any other. Rows with equal ids are rows of
    their own; a component of null ids only has a null id. An empty table gives an empty table.
    """
    marked = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")))
    return marked.join(components(marked, radius=radius), "fp")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document per component with its own columns: the one with the smallest id.

    Of rows that share that id, and of components without any id, the row with the smallest hash stays.
    """
    names = docs.columns
    marked = docs.withColumn("_fp", fingerprints(F.col("text"))).withColumn("_hash", F.xxhash64(*names))
    rows = cut(marked.select(F.col("doc_id"), F.col("_fp").alias("fp"), "_hash"))
    grouped = rows.join(components(rows), "fp")
    best = grouped.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
    chosen = best.agg(F.min_by(F.struct("fp", "_hash", "doc_id"), F.struct(F.col("doc_id").isNull(), "doc_id", "_hash")).alias("r")).select("r.*")
    keys = chosen.select(F.col("fp").alias("k_fp"), F.col("_hash").alias("k_hash"), F.col("doc_id").alias("k_id"))
    same = (F.col("_hash") == F.col("k_hash")) & (F.col("_fp") == F.col("k_fp")) & F.col("doc_id").eqNullSafe(F.col("k_id"))
    kept = marked.join(keys, same, "left_semi")
    return kept.dropDuplicates(["_hash", "_fp", "doc_id"]).select(*names)
