"""Near copies at a given Jaccard similarity of word shingles, found by SimHash tables and checked exactly.

Two fingerprints of 64 bits at a similarity of 0.8 differ in about ten bits, and the masks that cover such a radius
number in the thousands. So a text has the covering tables of its whole fingerprint (radius two, as in
``simhash``), and besides one fingerprint for each of SAMPLES samples: the SAMPLE shingles that are smallest under the
sample's own order. Two texts of similarity s have a sample in common with a chance of about s**SAMPLE a table, which
makes 0.99 over all tables at 0.8 and more above. Every pair that is met is checked on all its shingles.

Groups are the connected components of the pairs found. A round compares each bucket with one anchor, so its work
is linear in the bucket; linked texts go on as one representative. When a round takes less than FEWEST of the rows,
the members of a bucket that are still in different groups, absorbed ones included, are compared with each other in
parts of bounded size. So every pair that meets in a table is in one group or has been checked. In that pass a join
compares bitmaps of the shingles first: a bit that one text has and the other lacks is a shingle it does not share, so
the bitmaps bound the similarity from above, and only pairs within the bound are sent on with their shingles.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from newsweave.llm.simhash import BLOCK, LOWER, SEED, table_masks
from newsweave.operators.components import connected_components
from newsweave.session import bounded_batches, cut, give_back

SHINGLE = 5
SIMILARITY = 0.8
SAMPLES = 16
SAMPLE = 6
#: Texts of few shingles seldom share six: they have more tables, of two shingles each.
FEW = 16
SMALL_SAMPLES = 8
SMALL_SAMPLE = 2
PRINTS = StructType().add("digest", StringType()).add("size", LongType()).add("keys", ArrayType(LongType()))
PART = 1_000
FEWEST = 0.01
#: Bits of a text's bitmap of shingles: enough to tell 0.7 from 0.8 in texts of some hundred words.
MARKS = 2_048
#: Odd multipliers; each gives the hashes another order.
ORDERS = [xxhash.xxh64_intdigest(str(i).encode(), SEED) | 1 for i in range(SAMPLES + SMALL_SAMPLES)]
MASKS = np.array(table_masks(), dtype=np.int64).view(np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_hashes(tokens: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles in order; fewer words than a shingle are one shingle."""
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    line = memoryview(b" ".join(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    width = min(width, len(tokens))
    starts = np.concatenate([[0], ends[: len(tokens) - width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64))


def majority(hashes: np.ndarray) -> np.uint64:
    """SimHash of hashes: the bits set in more than half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK].astype(">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.uint64(int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big"))


def table_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a table: masked whole fingerprint, then fingerprints of samples."""
    keys = list(majority(hashes) & MASKS)
    for i, order in enumerate(ORDERS if len(hashes) <= FEW else ORDERS[:SAMPLES]):
        size = SAMPLE if i < SAMPLES else SMALL_SAMPLE
        ranks = hashes * np.uint64(order)
        keys.append(majority(hashes[np.argpartition(ranks, size)[:size]] if len(hashes) > size else hashes))
    return np.array(keys, dtype=np.uint64).view(np.int64)


@F.pandas_udf(PRINTS)
def prints(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        tokens = words_of(text)
        hashes = shingle_hashes(tokens)
        rows.append((xxhash.xxh3_128_hexdigest(b" ".join(tokens)), len(hashes), table_keys(hashes)))
    give_back()
    return pd.DataFrame(rows, columns=["digest", "size", "keys"])


@F.pandas_udf(ArrayType(LongType()))
def shingle_sets(texts: pd.Series) -> pd.Series:
    sets = pd.Series([shingle_hashes(words_of(t)).view(np.int64) for t in texts], dtype=object)
    give_back()
    return sets


@F.pandas_udf(ArrayType(LongType()))
def marks(sets: pd.Series) -> pd.Series:
    """Bitmap of the shingles, 64 bits a number."""
    rows = []
    for shingles in sets:
        bits = np.zeros(MARKS, dtype=np.uint8)
        bits[np.asarray(shingles, dtype=np.int64).view(np.uint64) % np.uint64(MARKS)] = 1
        rows.append(np.packbits(bits).view(np.int64))
    return pd.Series(rows, dtype=object)


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def marked(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """row (all columns), id, text, and two hashes of the whole row; columns of any type and name."""
    plain = [named(c) for c in docs.columns if c != text]
    values = [F.to_json(F.struct(*plain)) if plain else F.lit(""), named(text)]
    row = F.struct(*[named(c) for c in docs.columns]).alias("row")
    return docs.select(row, named(doc_id).alias("id"), named(text).alias("text"), F.xxhash64(F.lit(1), *values).alias("h1"), F.xxhash64(F.lit(2), *values).alias("h2"))


def first_row() -> Column:
    """Of a group the row with the smallest id, null last, then by its hashes."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2"))


def links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    rows = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), common.alias("common"))
    return rows.where(F.col("common") / (F.col("total") - F.col("common")) >= similarity).select("a", "b")


def alike_in_size(similarity: float) -> Column:
    return F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b")


def within_bound(similarity: float) -> Column:
    """Whether two texts may have the similarity by their bitmaps: as many shingles at least are not shared as bits are."""

    def shared(x: str, y: str) -> Column:
        alone = F.zip_with(f"marks_{x}", f"marks_{y}", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.col(f"size_{x}") - F.aggregate(alone, F.lit(0), lambda total, n: total + n)

    most = F.least(shared("a", "b"), shared("b", "a"))
    return most / (F.col("size_a") + F.col("size_b") - most) >= similarity


def anchor_pairs(rows: DataFrame, turn: int, similarity: float) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's anchor of this turn."""
    order = F.struct(F.xxhash64(F.lit(turn), "node"), F.col("node").alias("node"), F.col("size").alias("size"))
    anchors = rows.groupBy("table", "key").agg(F.min(order).alias("m"), F.count("*").alias("n")).where(F.col("n") > 1)
    anchors = anchors.select("table", "key", F.col("m.node").alias("a"), F.col("m.size").alias("size_a"))
    met = rows.select("table", "key", F.col("node").alias("b"), F.col("size").alias("size_b")).join(anchors, ["table", "key"])
    return met.where((F.col("a") != F.col("b")) & alike_in_size(similarity)).select("a", "b").distinct()


def rest_pairs(rows: DataFrame, similarity: float, part: int = PART, bitmaps: DataFrame | None = None) -> DataFrame:
    """(a, b): the pairs of a bucket from different groups, with ``bitmaps`` (node, marks) those within their bound.

    Only members outside the largest group of a bucket are held against all its members. Both sides are
    dealt into parts, each two parts are one join key.
    """
    sizes = rows.groupBy("table", "key", "group").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("table", "key").agg(F.max(F.struct("n", "group")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("kinds"))
    mixed = mixed.where(F.col("kinds") > 1).select("table", "key", F.col("m.group").alias("main"), F.ceil(F.col("n") / part).cast("int").alias("parts"))
    parts = rows.join(mixed, ["table", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    columns, near = ["node", "size", "group"], alike_in_size(similarity)
    if bitmaps is not None:
        parts = cut(parts.join(bitmaps, "node"))
        columns, near = [*columns, "marks"], near & within_bound(similarity)
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    place = {"i": F.col("own"), "j": F.col("other")}, {"i": F.col("other"), "j": F.col("own")}
    left, right = [
        side.withColumns(at).select("table", "key", "i", "j", "main", *[F.col(c).alias(f"{c}_{x}") for c in columns])
        for side, at, x in ((parts.where(F.col("group") != F.col("main")), place[0], "a"), (parts, place[1], "b"))
    ]
    once = (F.col("group_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))
    met = left.join(right, ["table", "key", "i", "j", "main"]).where((F.col("group_a") != F.col("group_b")) & once & near)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def texts_and_buckets(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Different texts (node: digest of the words, first row) and their keys in buckets of two and more (table, key, node, size)."""
    rows = marked(docs, text, doc_id).select("id", "h1", "h2", prints(F.col("text")).alias("p")).select("id", "h1", "h2", "p.*")
    node = F.unhex("digest").alias("node")
    texts = cut(rows.groupBy(node).agg(first_row().alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    keys = texts.where(F.col("size") > 0).select("node", "size", F.posexplode("keys").alias("table", "key"))
    shared = keys.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("table", "key")
    return texts, cut(keys.join(shared, ["table", "key"]))


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """node, group, first: for each different text its group (smallest node) and its first row."""
    bounded_batches(docs.sparkSession)
    texts, rows = texts_and_buckets(docs, text, doc_id)
    met = rows.select("node").distinct().join(texts, "node").select("node", "first.h1", "first.h2")
    sets = marked(docs, text, doc_id).select("text", "h1", "h2").join(met, ["h1", "h2"])
    sets = cut(sets.select("node", shingle_sets(F.col("text")).alias("shingles")).dropDuplicates(["node"]))
    member = texts.select("node", "first", F.col("node").alias("group"))
    every, left = rows, rows
    for turn in itertools.count():
        found = cut(links(anchor_pairs(left, turn, similarity), sets, similarity))
        member, joined = regrouped(member, found)
        gone = joined.where(F.col("id") != F.col("component")).select(F.col("id").alias("node"))
        before, left = left, cut(left.join(gone, "node", "left_anti"))
        if left.count() >= (1 - FEWEST) * before.count():
            break
    group = member.select("node", "group")
    bitmaps = sets.select("node", marks("shingles").alias("marks"))
    met = cut(rest_pairs(every.join(group, "node"), similarity, bitmaps=bitmaps))
    found = cut(links(met, sets, similarity))
    for side in ("a", "b"):
        found = found.join(group.withColumnRenamed("node", side), side).drop(side).withColumnRenamed("group", side)
    return regrouped(member, found)[0]


def regrouped(member: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups after links (a, b) between them, and the groups that were linked (id, component)."""
    joined = cut(connected_components(found))
    roots = joined.select(F.col("id").alias("group"), F.col("component").alias("root"))
    member = member.join(roots, "group", "left").select("node", "first", F.coalesce("root", "group").alias("group"))
    return cut(member), joined


def first_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group with its own columns: the one with the smallest id.

    Null and empty texts are one group. Rows without an id come after all ids. Of rows that share the
    smallest id, the one with the smallest hash stays; of equal rows, one. An empty table gives an empty
    table. Columns may be of any type and name (maps, dots, names used here).
    """
    chosen = groups(docs, text, doc_id, similarity).groupBy("group").agg(F.min("first").alias("r")).select("r.h1", "r.h2")
    kept = marked(docs, text, doc_id).join(cut(chosen), ["h1", "h2"], "left_semi")
    return kept.dropDuplicates(["h1", "h2"]).select("row.*")
