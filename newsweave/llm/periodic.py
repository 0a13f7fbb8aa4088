"""Periodic runs: maximal stretches of words that repeat with a period, found by suffix-tree LCE.

Every run has a Lyndon root: a period of it that is the longest Lyndon word from its first word on, under
the order of the words or the reversed order (Bannai et al., 2017). So the longest Lyndon word at every
position, which ends at the next smaller suffix, is a candidate. A candidate is extended to the right by
the longest common extension of its two ends, and to the left by that of the reversed words. Extensions
are depths of lowest common ancestors: least depths of an Euler tour of the suffix tree, by a sparse table.
Trees are built by Ukkonen's algorithm.

Only stretches that can hold a run go into a tree. A run of at least MIN_WORDS words and MIN_PERIODS = 3
periods is covered by windows of WINDOW = MIN_WORDS / 3 words that stand at least three times in the text:
a window at any start but those in the last two periods is there again one and two periods later. Windows
are compared by hash, which can only add stretches. Stretches of a few documents share one tree, with a
separator of its own behind each, so no run leaves its document.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 24
MIN_PERIODS = 3
WINDOW = MIN_WORDS // MIN_PERIODS
#: Bytes of text looked at together, and words from which a tree is closed.
CHUNK_BYTES = 1 << 20
TREE_WORDS = 1 << 15
#: Odd multipliers of the window hash.
_draw = random.Random(13)
FACTORS = np.array([_draw.getrandbits(64) | 1 for _ in range(WINDOW)], dtype=np.uint64)

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
ADDED = [("n_words", "bigint"), ("runs", RUNS), ("kept_text", "string")]


def places(values: np.ndarray) -> np.ndarray:
    """The place of every value in their order."""
    out = np.empty(len(values), dtype=np.int64)
    out[np.argsort(values)] = np.arange(len(values))
    return out


def euler_tour(parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps of the tour and the place of every step, from edges in sibling order grouped by parent.

    Step v goes down into node v, step m + v goes back up from it (m nodes, the root is 0). Every step
    knows the next one; places are found by ranking that list in rounds of doubling.
    """
    m = len(child) + 1
    begins = np.flatnonzero(np.diff(parent, prepend=-1))
    first = np.full(m, -1, dtype=np.int32)
    first[parent[begins]] = child[begins]
    after = np.empty(2 * m, dtype=np.int32)
    after[:m] = np.where(first >= 0, first, m + np.arange(m))
    after[m + child] = m + parent
    siblings = np.flatnonzero(parent[1:] == parent[:-1])
    after[m + child[siblings]] = child[siblings + 1]
    after[m] = m
    left = np.ones(2 * m, dtype=np.int32)
    left[m] = 0
    for _ in range((2 * m).bit_length()):
        left += left[after]
        after = after[after]
    place = left[0] - left
    tour = np.empty(2 * m, dtype=np.int64)
    tour[place] = np.arange(2 * m)
    return tour, place


class SuffixTree:
    """Suffix tree of a list of symbols (positive numbers); symbol 0 is put behind them.

    ``rank`` and ``rank_reversed`` are the places of the suffixes in the order of the symbols and in the
    reversed order; a suffix comes before those it is a prefix of in both. ``orders=False`` leaves them out.
    """

    def __init__(self, symbols: list[int], orders: bool = True):
        text = [*symbols, 0]
        self.size, self.width = len(text), max(text) + 1
        start, end, edge = self._build(text)
        keys = np.fromiter(edge.keys(), dtype=np.int64, count=len(edge))
        child = np.fromiter(edge.values(), dtype=np.int64, count=len(edge))
        parent, symbol = keys // self.width, keys % self.width
        length = np.array(end) - np.array(start)
        # Leaves are made in the order of their suffixes.
        leaves = np.flatnonzero(np.array(end) == self.size)
        up = np.argsort(keys)
        tour, place = euler_tour(parent[up], child[up])
        steps = np.where(tour < len(start), 1, -1) * length[tour % len(start)]
        back = tour >= len(start)
        self.at = (np.cumsum(back) - 1)[place[len(start) + leaves]]
        self.table = [np.cumsum(steps)[back].astype(np.int32)]
        while 2 * (half := 1 << (len(self.table) - 1)) <= len(self.table[0]):
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))
        if orders:
            down = np.argsort(parent * self.width + np.where(symbol == 0, 0, self.width - symbol))
            _, other = euler_tour(parent[down], child[down])
            self.rank, self.rank_reversed = places(self.at), places(other[leaves])

    def _build(self, text: list[int]) -> tuple[list[int], list[int], dict[int, int]]:
        """Ukkonen: first and last symbol of the edge into each node, and the node by (parent, first symbol)."""
        size, width = self.size, self.width
        start, end, link, edge = [0], [0], [0], {}
        node = length = first = open_ = 0
        for i, c in enumerate(text):
            fresh = 0
            open_ += 1
            while open_:
                if not length:
                    first = i
                key = node * width + text[first]
                below = edge.get(key)
                if below is None:
                    edge[key] = len(start)
                    start.append(i)
                    end.append(size)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    a = start[below]
                    span = end[below] - a
                    if length >= span:
                        first += span
                        length -= span
                        node = below
                        continue
                    if text[a + length] == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    middle = len(start)
                    edge[key] = middle
                    edge[middle * width + text[a + length]] = below
                    edge[middle * width + c] = middle + 1
                    start[below] = a + length
                    start += (a, i)
                    end += (a + length, size)
                    link += (0, 0)
                    if fresh:
                        link[fresh] = middle
                    fresh = middle
                open_ -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    first = i - open_ + 1
        return start, end, edge

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes ``i`` and ``j`` (different ones), in constant time each."""
        a, b = self.at[i], self.at[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level).tolist():
            have = level == k
            row = self.table[k]
            out[have] = np.minimum(row[a[have]], row[b[have] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For every suffix the next one that is smaller (the last, empty one is smaller than all)."""
    ranks, stack = rank.tolist(), [len(rank) - 1]
    out = [0] * (len(rank) - 1)
    for i in range(len(rank) - 2, -1, -1):
        r = ranks[i]
        while ranks[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out, dtype=np.int64)


def runs_of(symbols: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs of positive numbers, by start, then period."""
    if not symbols:
        return np.empty((0, 3), dtype=np.int64)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1], orders=False)
    n, every = len(symbols), np.arange(len(symbols))
    found = []
    for rank in (ahead.rank, ahead.rank_reversed):
        after = next_smaller(rank)
        take = min_periods * (after - every) <= n
        i, j = every[take], after[take]
        right, left = ahead.common(i, j), np.zeros(len(i), dtype=np.int64)
        inner = i > 0
        left[inner] = back.common(n - i[inner], n - j[inner])
        rows = np.stack([i - left, j - i, j + right - (i - left)], axis=1)
        found.append(rows[rows[:, 2] >= np.maximum(min_words, min_periods * rows[:, 1])])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[:, [0, 2, 1]]


def stretches(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of stretches covered by windows that stand at least MIN_PERIODS times in their text.

    ``ids`` numbers the words of several texts, ``text`` tells the text of each word.
    """
    none = np.empty(0, dtype=np.int64)
    if len(ids) < MIN_WORDS:
        return none, none
    one = (text << 32) | ids
    order = np.argsort(one, kind="stable")
    change = np.flatnonzero(np.diff(one[order], prepend=-1))
    times = np.diff(np.append(change, len(one)))
    common = np.empty(len(ids), dtype=bool)
    common[order] = np.repeat(times >= MIN_PERIODS, times)
    inside = np.cumsum(np.concatenate([[0], common]))
    begin = np.flatnonzero((inside[WINDOW:] - inside[:-WINDOW] == WINDOW) & (text[WINDOW - 1 :] == text[: len(text) - WINDOW + 1]))
    if len(begin) < MIN_PERIODS:
        return none, none
    values = one.astype(np.uint64)
    sums = np.zeros(len(begin), dtype=np.uint64)
    for k in range(WINDOW):
        sums = (sums ^ (sums >> np.uint64(29))) + (values[begin + k] + np.uint64(1)) * FACTORS[k]
    order = np.argsort(sums, kind="stable")
    ordered = sums[order]
    change = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    times = np.diff(np.append(change, len(ordered)))
    often = np.sort(begin[order[np.repeat(times >= MIN_PERIODS, times)]])
    if not len(often):
        return none, none
    apart = np.flatnonzero((np.diff(often) > WINDOW) | (np.diff(text[often]) != 0))
    a, b = often[np.concatenate([[0], apart + 1])], often[np.append(apart, len(often) - 1)] + WINDOW
    long = b - a >= MIN_WORDS
    return a[long], b[long]


def number_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in a row: the number of each word, the text of each word, and the words before each text."""
    parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    ids = parts.values.dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    # Space at the ends of a text yields empty parts.
    real = pc.not_equal(pc.binary_length(parts.values), 0).to_numpy(zero_copy_only=False)
    text = text[real]
    return ids.indices.to_numpy()[real].astype(np.int64), text, np.searchsorted(text, np.arange(len(texts) + 1))


def text_runs(texts: list[str]) -> tuple[list[int], list[list[tuple[int, int, int]]]]:
    """Number of words and runs of every text; texts share suffix trees of about TREE_WORDS words."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ids, text, before = number_words(texts)
    begins, ends = stretches(ids, text)
    symbols: list[int] = []
    places: list[tuple[int, int]] = []
    top = 1

    def close() -> None:
        starts = np.array([at for at, _ in places], dtype=np.int64)
        rows = runs_of(symbols)
        for (start, length, period), k in zip(rows.tolist(), (np.searchsorted(starts, rows[:, 0], "right") - 1).tolist(), strict=True):
            at, begin = places[k]
            own = text[begin]
            runs[own].append((int(start - at + begin - before[own]), length, period))

    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if symbols and len(symbols) + b - a > TREE_WORDS:
            close()
            symbols, places, top = [], [], 1
        own, small = np.unique(ids[a:b], return_inverse=True)
        places.append((len(symbols), a))
        symbols += (small + top).tolist()
        top += len(own) + 1
        symbols.append(top - 1)
    if symbols:
        close()
    return np.diff(before).tolist(), runs


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    return list(compress(words, keep.tolist()))


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, about CHUNK_BYTES of characters at a time; null is empty."""
    chunk: list[str] = []
    held = 0
    for text in texts:
        chunk.append(text or "")
        held += len(chunk[-1])
        if held >= CHUNK_BYTES:
            yield chunk
            chunk, held = [], 0
    yield chunk


def collapsed_texts(texts: list[str | None]) -> Iterator[tuple[int, list[dict[str, int]], str]]:
    """(n_words, runs, kept text) of every text, a chunk at a time."""
    for chunk in chunks(texts):
        for text, n_words, runs in zip(chunk, *text_runs(chunk), strict=True):
            words = text.encode().split()
            kept = kept_words(words, runs) if runs else words
            yield n_words, [{"start": s, "length": n, "period": p} for s, n, p in runs], b" ".join(kept).decode()


def collapsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns with n_words, runs (start, length, period; by start, then period) and kept_text.

    A run is a stretch of words with smallest period p, at least MIN_WORDS words and MIN_PERIODS * p long,
    that no neighbouring word extends. kept_text holds the words, joined by one space, that no run contains
    after its first p. Null and empty texts have no words, no runs and an empty kept text. Every row is
    judged by itself: null or equal ids, repeated rows and ties change nothing, an empty table gives an
    empty table. Input columns named like an added one are replaced. A row is one unit of work; a stretch
    that may be periodic takes about 1 kB of memory a word while its trees stand.
    """
    added = [n for n, _ in ADDED]
    own = [f for f in docs.schema if f.name not in added]
    carried = [*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(own)], F.col(f"`{text}`").alias("t")]
    sent = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(own)]
    schema = T.StructType([*sent, *T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in ADDED)).fields])
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(collapsed_texts(batch.column(batch.num_columns - 1).to_pylist()))
            extra = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], runs_type), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=[*batch.schema.names[:-1], *added])

    done = docs.select(*carried).mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(own)], *added)
