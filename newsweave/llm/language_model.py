"""Bigram scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Counts of training words and word pairs are quantised to 1 + floor(log2 count); an n-gram with level q is
put into the filter as (n-gram, 1) ... (n-gram, q), and reading probes levels until one is missing. Words and
pairs seen once are in it like all others. Buckets of hashes each fill their own segment of the
filter, LEVEL_BITS for every level put in, so the filter grows with the n-grams and probes err equally
often on any corpus. A bucket probes its segment for the words and pairs it was asked for and sends their
levels back, with the exact word counts for the base score; no segment leaves its bucket.

Score of a token after the token before it (the end mark before the first):
    p = (c(v, w) + PRIOR * p1(w)) / (c(v) + PRIOR),   p1(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))
with counts read from the filter, N and V exact, and c(v, w) at most c(v).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm import exchange as ex
from newsweave.session import cut

BUCKET_BYTES = 16 << 20
LEVEL_BITS = 32
LEAST_BITS = 1 << 10
PROBES = 3
LEVELS = 40
PRIOR = 50.0
ADDED = 0.1
FOLDS = 10
END = np.uint64(0x5851F42D4C957F2D)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
PAIR_BITS = np.uint64((1 << 40) - 1)


def held_out(doc_id: int) -> bool:
    """Null ids (kept as the smallest number) count as the empty text."""
    name = "" if doc_id == ex.NO_ID else str(doc_id)
    return zlib.crc32(name.encode()) % FOLDS == 0


class Tokens:
    """Word hashes of a group, every text closed by the end mark."""

    def __init__(self, group: ex.Group):
        group.bytes = LOWER[group.bytes]
        words = ex.Words(group)
        n = words.last - words.first
        self.stop = np.cumsum(n + 1)
        self.start = self.stop - n - 1
        self.hash = np.full(int(self.stop[-1]) if len(n) else 0, END, dtype=np.uint64)
        real = np.ones(len(self.hash), dtype=bool)
        real[self.stop - 1] = False
        self.hash[real] = words.hash
        self.held = np.array([held_out(i) for i in group.ids.tolist()], dtype=bool)
        self.trains = np.repeat(~self.held, n + 1)
        before = np.empty_like(self.hash)
        before[1:] = self.hash[:-1]
        before[self.start] = END
        self.before = before
        self.pair = pairs(before, self.hash)


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ex.mixed(first * np.uint64(ex.BASE) + second)


def sliced(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of sorted keys by bucket; the bucket comes from bits that the order does not follow."""
    bucket, _ = ex.dealt(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


def ask_counts(group: ex.Group, buckets: int) -> Iterator[tuple[int, bytes]]:
    tokens = Tokens(group)
    press = zstandard.ZstdCompressor(level=1)
    words, inverse = np.unique(tokens.hash, return_inverse=True)
    counts = np.bincount(inverse[tokens.trains], minlength=len(words)).astype("<u4")
    both, which = np.unique(tokens.pair, return_inverse=True)
    pair_counts = np.bincount(which[tokens.trains], minlength=len(both)).astype("<u4")
    pair_at = dict(sliced(both, buckets))
    word_at = dict(sliced(words, buckets))
    for b in sorted(set(word_at) | set(pair_at)):
        w, p = word_at.get(b, np.zeros(0, dtype=np.int64)), pair_at.get(b, np.zeros(0, dtype=np.int64))
        rest = both[p] & PAIR_BITS
        order = np.argsort(rest)
        steps = np.diff(rest[order], prepend=np.uint64(0))
        planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()
        head = np.array([len(w), len(p)], dtype="<u4").tobytes()
        yield b, press.compress(head + words[w].astype("<u8").tobytes() + counts[w].tobytes() + planes + pair_counts[p][order].tobytes())


def read_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, dtype="<u4", count=2).tolist()
    words, counts = np.frombuffer(raw, dtype="<u8", offset=8, count=n), np.frombuffer(raw, dtype="<u4", offset=8 + 8 * n, count=n)
    wide = np.zeros((m, 8), dtype=np.uint8)
    wide[:, :5] = np.frombuffer(raw, dtype=np.uint8, offset=8 + 12 * n, count=5 * m).reshape(5, m).T
    return words, counts, np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64), np.frombuffer(raw, dtype="<u4", offset=8 + 12 * n + 5 * m, count=m)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    every = np.concatenate(keys)
    one, inverse = np.unique(every, return_inverse=True)
    return one, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(one)).astype(np.int64), inverse


def spots(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    for probe in range(PROBES):
        yield (ex.mixed(keys + np.uint64((level * PROBES + probe + 1) * ex.MIX % (1 << 64))) >> np.uint64(20)) % np.uint64(bits)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def fill(segment: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
    """Put the keys with their levels into a segment (one byte per eight bits)."""
    bits, top = len(segment) * 8, levels(counts)
    for level in range(1, int(top.max(initial=0)) + 1):
        for spot in spots(keys[top >= level], level, bits):
            np.bitwise_or.at(segment, (spot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8))


def segment_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A segment with LEVEL_BITS for every level of the keys."""
    bits = max(LEAST_BITS, LEVEL_BITS * int(levels(counts).sum()))
    segment = np.zeros(-(-bits // 8), dtype=np.uint8)
    fill(segment, keys, counts)
    return segment


def middle(top: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level."""
    return np.where(top > 0, 1.5 * np.exp2(top.astype(np.int64) - 1) - 0.5, 0.0)


class Filter:
    def __init__(self, segments: dict[int, bytes], bits: int | None = None):
        self.segments = {b: np.frombuffer(s, dtype=np.uint8) for b, s in segments.items()}
        self.bits = bits

    def counts(self, keys: np.ndarray, named: np.ndarray, buckets: int) -> np.ndarray:
        """Middle of the quantised count of every key, 0 where level 1 is missing."""
        return middle(self.levels(keys, named, buckets))

    def levels(self, keys: np.ndarray, named: np.ndarray, buckets: int) -> np.ndarray:
        out = np.zeros(len(named), dtype=np.uint8)
        for b, at in sliced(keys, buckets):
            segment = self.segments.get(b)
            live, top = at, np.zeros(len(at), dtype=np.int64)
            left = np.arange(len(at))
            for level in range(1, LEVELS + 1):
                if segment is None or not live.size:
                    break
                hit = np.ones(len(live), dtype=bool)
                for spot in spots(named[live], level, self.bits or len(segment) * 8):
                    hit &= (segment[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                live, left = live[hit], left[hit]
                top[left] = level
            out[at] = top
        return out


MODEL = "g int, bucket int, kind int, blob binary, n long, v long"


def trained(groups: DataFrame, buckets: int) -> DataFrame:
    """Answers to the groups (kind 1: exact word counts, levels of words and of pairs), and N and V per bucket (kind 9)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("g")
        words, counts, two, two_counts, sizes = [], [], [], [], []
        for blob in rows["blob"]:
            w, c, p, k = read_counts(blob)
            for held, part in ((words, w), (counts, c), (two, p), (two_counts, k), (sizes, (len(w), len(p)))):
                held.append(part)
        one, total, inverse = summed(words, counts)
        pair, pair_total, pair_inverse = summed(two, two_counts)
        named = np.concatenate([one, ~pair])
        every = np.concatenate([total, pair_total])
        bloom = Filter({0: segment_of(named[every > 0], every[every > 0]).tobytes()})
        top = bloom.levels(named, named, 1)
        press = zstandard.ZstdCompressor(level=1)
        edges = np.cumsum(sizes, axis=0)[:-1].T
        exact, single, double = np.split(total[inverse], edges[0]), np.split(top[: len(one)][inverse], edges[0]), np.split(top[len(one) :][pair_inverse], edges[1])
        replies = [press.compress(e.astype("<i8").tobytes() + s.tobytes() + d.tobytes()) for e, s, d in zip(exact, single, double, strict=True)]
        out = [(g, key[0], 1, r, 0, 0) for g, r in zip(rows["g"], replies, strict=True)]
        out.append((-1, key[0], 9, b"", int(total.sum()), int((total > 0).sum())))
        frame = pd.DataFrame(out, columns=["g", "bucket", "kind", "blob", "n", "v"])
        return frame.astype({"g": "int32", "bucket": "int32", "kind": "int32"})

    return ex.ask(groups, lambda g: ask_counts(g, buckets)).groupBy("bucket").applyInPandas(run, MODEL)


def scored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per input row: its other columns, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty: one token, the end mark. Rows with equal ids fall into one fold. With no training
    text all counts are 0. An empty table gives an empty table. To the driver come two sums.
    """
    groups, buckets = ex.deal(docs, text, doc_id, BUCKET_BYTES)
    model = cut(trained(groups, buckets))
    sums = model.where("kind = 9").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    total, distinct = int(sums[0]), int(sums[1])
    kinds = {f"c{i}": kind for i, (_, kind, _) in enumerate(ex.transport(docs, text))}
    extra = {"held_out": "boolean", "n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}

    def finish(rows: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*kinds, *extra])
        group = ex.Group(rows)
        tokens = Tokens(group)
        replies = ex.by_bucket(heard)
        expand = zstandard.ZstdDecompressor()
        words, inverse = np.unique(tokens.hash, return_inverse=True)
        both, which = np.unique(tokens.pair, return_inverse=True)
        word_at, pair_at = dict(sliced(words, buckets)), dict(sliced(both, buckets))
        exact, top, pair_top = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.uint8), np.zeros(len(both), dtype=np.uint8)
        for b in set(word_at) | set(pair_at):
            w, p = word_at.get(b, np.zeros(0, dtype=np.int64)), pair_at.get(b, np.zeros(0, dtype=np.int64))
            raw = expand.decompress(replies[1, b])
            exact[w] = np.frombuffer(raw, dtype="<i8", count=len(w))
            top[w] = np.frombuffer(raw, dtype=np.uint8, offset=8 * len(w), count=len(w))
            pair_top[p[np.argsort(both[p] & PAIR_BITS)]] = np.frombuffer(raw, dtype=np.uint8, offset=9 * len(w), count=len(p))
        count = exact[inverse]
        per_text = lambda x: np.add.reduceat(x, tokens.start)
        size = total + ADDED * (distinct + 1)
        base = per_text(np.log10((count + ADDED) / size))
        single, pair = middle(top), middle(pair_top)[which]
        place = np.searchsorted(words, tokens.before)
        place = np.minimum(place, len(words) - 1)
        context = single[place]
        smooth = (single[inverse] + ADDED) / size
        chance = (np.minimum(pair, context) + PRIOR * smooth) / (context + PRIOR)
        out = group.rows[list(kinds)].copy()
        out["held_out"], out["n_tokens"] = tokens.held, tokens.stop - tokens.start
        out["n_known"], out["train_tokens"] = per_text((count > 0).astype(np.int64)), total
        out["base_score"], out["score"] = base, per_text(np.log10(np.minimum(chance, 1.0)))
        return out

    schema = ", ".join(f"`{n}` {k}" for n, k in {**kinds, **extra}.items())
    answers = model.where("kind = 1").select("g", "bucket", "kind", "blob")
    done = groups.groupBy("g").cogroup(answers.groupBy("g")).applyInPandas(finish, schema)
    return ex.returned(done, docs, text, [e.split()[0] for e in extra])
