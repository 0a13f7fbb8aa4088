"""Target-distribution importance resampling: draw the documents that look most like a target corpus.

Features are runs of consecutive words, hashed into buckets. Bucket counts of the corpus and of the target
give a gain per bucket, the rounded log ratio of its smoothed shares; the gains are one array, and a
document's weight is the sum of the array's entries at its features. Weight plus Gumbel noise, hashed from
the id, is the score: the highest scores are a sample without replacement in proportion to exp(weight).

The cutoff is found by weighted median of medians. Keys (score, id, row) lie in a written table. Every
partition tells the median of its remaining keys and how many remain; the median of those, weighted by
the number of keys, has at least a quarter of all remaining keys on either side, so a round discards a
quarter at least. The same pass counts both sides of the last pivot and takes the medians of both, so a
round is one job, and the table is written anew when an eighth of it is left. Only winners are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions.text import let
from newsweave.llm.columns import table_of
from newsweave.operators.ranking import number_rows
from newsweave.session import cut

#: Anything but digits, lower-case letters and characters beyond ASCII separates words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
RUN_WORDS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: The keys are written anew when this share of them is left; most partitions that tell medians.
SHRINK = 8
PIECES = 1024
KEY = ["order", "key", "row"]
LAST = (1 << 63) - 1
MEDIANS = "side int, n long, " + ", ".join(f"`{k}` long" for k in KEY)


def plain_words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, SEPARATOR), lambda w: w != "")


def features(words: Column, longest: int = RUN_WORDS, buckets: int = BUCKETS) -> Column:
    """Buckets of all runs of 1 to ``longest`` words, repeats included: CRC-32 of the words joined by a space."""
    bucket = lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int")

    def runs(w: Column, k: int) -> Column:
        at = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: bucket(F.array_join(F.slice(w, i, k), " ")))

    if longest == 1:
        return F.transform(words, bucket)
    return let(words, lambda w: F.concat(F.transform(w, bucket), *[runs(w, k) for k in range(2, longest + 1)]))


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int, name: str) -> DataFrame:
    """bucket and how many features of all texts fall into it, combined before the shuffle."""
    return texts.select(F.explode(features(plain_words(F.col(f"`{text}`")), longest, buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for each of the B buckets; at most B rows reach the driver."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = cut(every.join(corpus, "bucket", "left").join(target, "bucket", "left").na.fill(0, ["s", "t"]))
    sums = both.agg(F.sum("s").cast("double").alias("S"), F.sum("t").cast("double").alias("T")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    gain = F.floor(1000 * F.ln((t + 1) * (sums["S"] + buckets) / ((s + 1) * (sums["T"] + buckets))))
    found = {r.bucket: r.gain for r in both.select("bucket", gain.cast("long").alias("gain")).collect()}
    return [found[b] for b in range(buckets)]


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of SHA-256 of ``seed:id``; a null id reads as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


@dataclass(frozen=True)
class Side:
    """Remaining keys of one side of a pivot: their number and the median of every partition."""

    n: int
    medians: list[tuple[int, tuple[int, ...]]]

    def pivot(self) -> tuple[int, ...]:
        """The median of the medians, weighted by the keys each stands for."""
        seen = 0
        for n, key in sorted(self.medians, key=lambda m: m[1]):
            seen += n
            if 2 * seen >= self.n:
                return key
        raise ValueError("no keys remain")


def sides(keys: DataFrame, low: tuple[int, ...] | None, high: tuple[int, ...] | None, pivot: tuple[int, ...] | None) -> tuple[Side, Side]:
    """The keys strictly between ``low`` and ``high``, before and after the pivot (without one, all are before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([c.to_numpy() for c in b.columns], axis=1) for b in batches if b.num_rows]
        rows = np.concatenate(parts) if parts else np.empty((0, len(KEY)), dtype=np.int64)
        if low is not None:
            rows = rows[~_before(rows, low) & ~(rows == low).all(axis=1)]
        if high is not None:
            rows = rows[_before(rows, high)]
        first = np.ones(len(rows), dtype=bool) if pivot is None else _before(rows, pivot)
        second = ~first if pivot is None else ~first & ~(rows == pivot).all(axis=1)
        out = []
        for side, mask in enumerate((first, second)):
            mine = rows[mask]
            if len(mine):
                middle = np.lexsort(mine.T[::-1])[(len(mine) - 1) // 2]
                out.append((side, len(mine), *mine[middle].tolist()))
        columns = list(zip(*out, strict=True)) if out else [()] * (2 + len(KEY))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=["side", "n", *KEY])

    told = keys.coalesce(PIECES).mapInArrow(run, MEDIANS).collect()
    mine = [[(r["n"], tuple(r[k] for k in KEY)) for r in told if r["side"] == side] for side in (0, 1)]
    before, after = (Side(sum(n for n, _ in m), m) for m in mine)
    return before, after


def _before(rows: np.ndarray, key: tuple[int, ...]) -> np.ndarray:
    """Which rows come before the key, compared column by column."""
    less, same = np.zeros(len(rows), dtype=bool), np.ones(len(rows), dtype=bool)
    for i, k in enumerate(key):
        less |= same & (rows[:, i] < k)
        same &= rows[:, i] == k
    return less


def between(low: tuple[int, ...] | None, high: tuple[int, ...] | None) -> Column:
    """Keys strictly between two others."""
    key = F.struct(*[F.col(f"`{k}`") for k in KEY])
    at = lambda k: F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(KEY, k, strict=True)])
    above = F.lit(True) if low is None else (F.col("`order`") >= low[0]) & (key > at(low))
    return above if high is None else above & (F.col("`order`") <= high[0]) & (key < at(high))


def cutoff(keys: DataFrame, n: int, write: Callable[[DataFrame, str], DataFrame] = table_of) -> tuple[int, ...] | None:
    """The n-th smallest of the keys (all different), or None for n = 0; n is at most the number of keys."""
    if n <= 0:
        return None
    low, high, wanted = None, None, n
    here, _ = sides(keys, None, None, None)
    held = here.n
    while True:
        pivot = here.pivot()
        before, after = sides(keys, low, high, pivot)
        if wanted == before.n + 1:
            return pivot
        if wanted <= before.n:
            high, here = pivot, before
        else:
            low, here, wanted = pivot, after, wanted - before.n - 1
        if here.n * SHRINK <= held:
            keys, held = write(keys.where(between(low, high)), "resampling-keys"), here.n


def sampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    text: str = "text",
    doc_id: str = "doc_id",
    target_text: str = "text",
    longest: int = RUN_WORDS,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank, and the columns to carry (named carry_...), one row per input row.

    Of the N documents with at least ``min_words`` words the floor(percent * N / 100) with the highest
    scores have a rank from 1 on; the others have none. Ties go to the smaller id, null ids last, then by
    row. Null and empty texts have no features and weight 0; equal ids share their noise; repeated rows
    are rows of their own. An empty table gives an empty table, an empty target still has smoothed shares.
    Other columns, also of the result's names, do no harm: only named ones are read.
    """
    spark = docs.sparkSession
    corpus = bucket_counts(docs, text, longest, buckets, "s")
    wanted = bucket_counts(target, target_text, longest, buckets, "t")
    scores = F.split(F.lit(",".join(map(str, gains(corpus, wanted, buckets)))), ",").cast("array<bigint>")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), plain_words(F.col(f"`{text}`")).alias("w"), *[F.col(f"`{c}`").alias(f"carry_{c}") for c in carry])
    rows = rows.withColumns({"n_words": F.size("w").cast("long"), "f": features(F.col("w"), longest, buckets)})
    weight = F.aggregate("f", F.lit(0).cast("long"), lambda total, b: total + F.get(scores, b))
    rows = rows.select(
        "doc_id", "n_words", F.size("f").cast("long").alias("n_features"), weight.alias("weight"), *[f"`carry_{c}`" for c in carry]
    ).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = table_of(rows.withColumn("row", F.monotonically_increasing_id()), "resampling-scores")

    order = {"order": -F.col("score"), "key": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))}
    rows = rows.withColumns(order)
    able = F.col("n_words") >= min_words
    n = percent * rows.where(able).count() // 100
    last = cutoff(rows.where(able).select(*[f"`{k}`" for k in KEY]), n)
    key = F.struct(*[F.col(f"`{k}`") for k in KEY])
    drawn = F.lit(False) if last is None else able & (key <= F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(KEY, last, strict=True)]))
    winners = number_rows(rows.where(drawn), [], KEY, "rank") if n else rows.limit(0).withColumn("rank", F.lit(0))
    names = ["doc_id", "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"), *[f"`carry_{c}`" for c in carry]]
    others = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return winners.select(*names).unionByName(others.select(*names)) if n else others.select(*names)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The drawn documents with their own columns."""
    rows = sampled(docs, target, percent, carry=tuple(docs.columns)).where(F.col("rank").isNotNull())
    return rows.select(*[F.col(f"`carry_{c}`").alias(c) for c in docs.columns])
