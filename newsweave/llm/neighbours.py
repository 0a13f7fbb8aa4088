"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Every tree cuts the vectors by hyperplanes through the median of their projections on a random direction,
until LEAF_ROWS are left. Trees are fitted on at most SAMPLE_ROWS vectors (the smallest hashes of their
ids), so a forest has a bounded size and goes to the workers whole; then every row is sent down every
tree. A question walks all trees through one priority queue: the branch not taken waits with the distance
to the hyperplane that it would have to cross, the nearest branch over all trees is opened next, and the
walk ends when the leaves hold SEARCH_SHARE of all rows. The rows of these leaves are ranked by their
exact inner product: parts of about PART_ROWS rows, each with its leaves, meet blocks of about BLOCK_ROWS
questions, each with a bit per opened leaf, so neither vectors nor questions repeat per leaf and a common
vector is no hot key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweave.session import cut

K = 20
TREES = 8
LEAF_ROWS = 128
SAMPLE_ROWS = 50_000
SEARCH_SHARE = 1.0
LEAST_ROWS = 4_000
PART_ROWS = 8_192
BLOCK_ROWS = 4_096
SEED = 7


def grow(sample: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Directions and cuts of a complete binary tree in heap order; leaf i is node len(cuts) + i."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / LEAF_ROWS))))
    inner = (1 << depth) - 1
    directions = rng.standard_normal((inner, sample.shape[1])).astype(np.float32)
    cuts = np.zeros(inner, dtype=np.float32)
    members = {0: np.arange(len(sample))}
    for node in range(inner):
        rows = members.pop(node)
        side = sample[rows] @ directions[node]
        cuts[node] = np.median(side) if len(rows) else 0.0
        members[2 * node + 1], members[2 * node + 2] = rows[side < cuts[node]], rows[side >= cuts[node]]
    return directions, cuts


def leaf_of(tree: tuple[np.ndarray, np.ndarray], vectors: np.ndarray) -> np.ndarray:
    directions, cuts = tree
    node = np.zeros(len(vectors), dtype=np.int64)
    while len(cuts) and (live := np.flatnonzero(node < len(cuts))).size:
        at = node[live]
        side = np.einsum("ij,ij->i", vectors[live], directions[at])
        node[live] = 2 * at + 1 + (side >= cuts[at])
    return node - len(cuts)


def walk(forest: list, sizes: list[np.ndarray], vector: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue until the leaves hold ``wanted`` rows."""
    sides = [directions @ vector - cuts for directions, cuts in forest]
    queue = [(0.0, t, 0) for t in range(len(forest))]
    opened, held = [], 0
    while queue and held < wanted:
        cost, t, node = heapq.heappop(queue)
        side = sides[t]
        while node < len(side):
            away = float(abs(side[node]))
            near, far = (2 * node + 2, 2 * node + 1) if side[node] >= 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (max(cost, away), t, far))
            node = near
        leaf = node - len(side)
        opened.append((t, leaf))
        held += int(sizes[t][leaf])
    return opened


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): vectors of the commonest length without null, zero or non-finite components only."""
    v = F.col(embedding).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def nearest(vectors: DataFrame, is_question: str, k: int = K, share: float = SEARCH_SHARE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for every row that ``is_question`` (SQL on vec_id) selects.

    ``share`` is the number of rows in opened leaves, over all trees, against the table (a row counts once
    per tree), LEAST_ROWS at least. Null, zero and non-finite vectors and those of another length take no
    part. Equal rows with equal ids count once; a row is no candidate for questions of its own id. Ties go
    to the smaller id. To the driver come at most SAMPLE_ROWS vectors for fitting and one count per leaf.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors, vec_id, embedding).dropDuplicates(["vec_id", "v"]))
    total = rows.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], empty)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    sample = np.stack(chosen.tolist()).astype(np.float32)
    rng = np.random.default_rng(SEED)
    forest = [grow(sample, rng) for _ in range(TREES)]
    shared = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                points = np.stack(batch["v"].tolist()).astype(np.float32)
                yield batch.assign(leaves=list(np.stack([leaf_of(tree, points) for tree in shared.value], axis=1).astype(np.int32)))

    placed = cut(rows.mapInPandas(route, "vec_id long, v array<double>, leaves array<int>"))
    sizes = [np.zeros(len(cuts) + 1, dtype=np.int64) for _, cuts in forest]
    for r in placed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():
        sizes[r["tree"]][r["leaf"]] = r["count"]
    counted = spark.sparkContext.broadcast(sizes)
    wanted = max(LEAST_ROWS, (k + 1) * TREES, share * total)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            opened = []
            for v in batch["v"]:
                marks = [np.zeros(len(s), dtype=bool) for s in counted.value]
                for t, leaf in walk(shared.value, counted.value, np.asarray(v, dtype=np.float32), wanted):
                    marks[t][leaf] = True
                opened.append(np.packbits(np.concatenate(marks)).tobytes())
            yield pd.DataFrame({"query_id": batch["vec_id"], "q": batch["v"], "opened": opened})

    asked = cut(rows.where(is_question).mapInPandas(ask, "query_id long, q array<double>, opened binary"))
    n_parts, n_blocks = -(-total // PART_ROWS), max(1, -(-asked.count() // BLOCK_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = F.monotonically_increasing_id()
    dealt = placed.withColumn("part", F.pmod(number, F.lit(n_parts)).cast("int")).withColumn("block", every(n_blocks))
    asking = asked.withColumn("block", F.pmod(number, F.lit(n_blocks)).cast("int")).withColumn("part", every(n_parts))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            points, ids = np.stack(left["v"].tolist()), left["vec_id"].to_numpy()
            first = np.cumsum([0] + [len(s) for s in counted.value])
            places = (np.stack(left["leaves"].tolist()) + first[:-1]).T
            for q, vector, bits in zip(right["query_id"], right["q"], right["opened"], strict=True):
                opened = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).view(bool)
                held = np.flatnonzero(np.logical_or.reduce([opened[p] for p in places]) & (ids != q))
                if len(held) > k:
                    # Near the k-th score all stay, so rounding decides nothing here.
                    rough = points[held] @ vector
                    edge = np.partition(rough, -k)[-k]
                    held = held[rough >= edge - 1e-9 * (1 + abs(edge))]
                score = np.zeros(len(held))
                for d in range(points.shape[1]):  # one order of addition for all, so equal vectors have equal scores
                    score += points[held, d] * vector[d]
                best = np.lexsort((ids[held], -score))
                out.append((np.full(len(best), q), ids[held][best], score[best]))
        return pd.DataFrame({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("query_id", "vec_id", "score"))})

    met = dealt.groupBy("part", "block").cogroup(asking.groupBy("part", "block")).applyInPandas(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = met.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["query_id", "rank"])
    return best.select("query_id", "rank", "vec_id", "score")
