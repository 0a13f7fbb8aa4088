"""Near copies of the pipeline against brute force over all pairs, and on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from newsweave.llm import near_copies

SCHEMA = "doc_id long, text string, `a.b` string, fp map<string,int>, row int"


def similarity(a, b):
    x, y = (set(near_copies.shingle_hashes(near_copies.words_of(t)).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.fixture(scope="module")
def texts():
    """Families of texts with changed words, unrelated texts that share a passage, and short ones."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(40)]
    made = []
    for family in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([9, 14, 40, 120, 600]))]
        made.append(" ".join(words))
        for changes in (0, 1, 2, 3, 8):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            made.append(" ".join(copy) if changes else "  " + "\n".join(copy).upper())
        made.append(" ".join([f"u{family}-{i}" for i in range(60)] + passage))
    return made


def test_against_all_pairs(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in near_copies.first_of_each(rows).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= near_copies.SIMILARITY]
    root = list(range(len(texts)))
    for i, j in pairs * 5:
        root[i] = root[j] = min(root[i], root[j])
    assert {i for i in root if root[i] == i} <= kept
    both = [p for p in pairs if p[0] in kept and p[1] in kept]
    assert len(both) <= 0.05 * len(pairs)
    assert near_copies.first_of_each(rows).exceptAll(rows).count() == 0


def test_parts_of_a_bucket(spark):
    """All pairs of a bucket, whatever the size of its parts."""
    rows = spark.range(30).select(F.lit(0).alias("table"), F.lit(5).cast("long").alias("key"), F.col("id").alias("node"), F.lit(10).cast("long").alias("size"), F.col("id").alias("group"))
    for part in (3, 7, 100):
        assert near_copies.rest_pairs(rows, 0.8, part).count() == 30 * 29 // 2
        two = rows.withColumn("group", F.when(F.col("node") < 20, 0).otherwise(F.col("node")))
        assert near_copies.rest_pairs(two, 0.8, part).count() == 20 * 10 + 10 * 9 // 2


def test_bitmaps_leave_out_unlike_pairs_only(spark):
    """Edited copies of one text in one bucket: no pair at the similarity is lost, few others are sent on."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(5000)}" for _ in range(150)]
    made = []
    for i in range(80):
        copy = list(words)
        for _ in range(rng.choice([1, 6, 7, 8, 9])):
            copy[rng.randrange(len(copy))] = f"e{i}-{rng.randrange(10**6)}"
        made.append(" ".join(copy))
    texts = spark.createDataFrame(list(enumerate(made)), "node long, text string")
    sets = texts.select("node", near_copies.shingle_sets("text").alias("shingles"))
    rows = sets.select(F.lit(0).alias("table"), F.lit(5).cast("long").alias("key"), "node", F.size("shingles").cast("long").alias("size"), F.col("node").alias("group"))
    bitmaps = sets.select("node", near_copies.marks("shingles").alias("marks"))
    alike = {(i, j) for j in range(80) for i in range(j) if similarity(made[i], made[j]) >= near_copies.SIMILARITY}
    got = {(r.a, r.b) for r in near_copies.rest_pairs(rows, near_copies.SIMILARITY, 30, bitmaps).collect()}
    assert alike and alike <= got and len(got) <= 1.5 * len(alike) + 100
    assert len(got) < near_copies.rest_pairs(rows, near_copies.SIMILARITY, 30).count() / 4


def test_awkward_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [
        (1, None, "n", {"k": 1}, 1),
        (2, "", "n", None, None),
        (3, long, "l", {"k": 2}, 3),
        (4, long + " end", "l", {"k": 2}, 3),
        (None, long, None, None, None),
        (5, "one two", "s", {}, 5),
        (5, "one two", "s", {}, 5),
        (5, "One\ttwo", "t", {}, 6),
        (None, "alone without an id", "z", None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_copies.first_of_each(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (False, 5), (True, 0)]
    assert all(tuple(r) in [tuple(x) for x in rows] for r in kept)
    assert near_copies.first_of_each(df.limit(0)).count() == 0
