"""Substring dedup by fixed-block anchors: remove words covered by a WINDOW-word run that stands elsewhere too.

Every text is cut into non-overlapping blocks of BLOCK words, the index; the probes are all rolling
windows of BLOCK words. A WINDOW-word run holds CHAIN whole blocks in a row, whatever its place, and of
these the one with the smallest hash is enough: chains of CHAIN blocks one BLOCK apart are thinned to
their smallest member on both sides, the index in its own alignment, the probes in every alignment. Two
equal runs thus have an indexed block of one and a probe of the other in common. Blocks that are met are
extended: every WINDOW-word run with such an anchor inside is compared with all others by 128 bits of
hash (64 in the question, 32 beside them, the bucket from the rest), and runs that occur twice join to
maximal exact repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from newsweave.llm import exchange as ex

WINDOW = 35
BLOCK = 6
CHAIN = (WINDOW - BLOCK + 1) // BLOCK
SPAN = BLOCK * CHAIN
SECOND_BASE = 0xD6E8FEB86659FD93


class Anchors:
    """Chosen rolling windows of a group, and which of them are blocks of the index."""

    def __init__(self, group: ex.Group, words: ex.Words, buckets: int):
        hashes = ex.run_hashes(words.hash, BLOCK)
        n = len(words.hash) - SPAN + 1
        self.at, self.index = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        if n > 0:
            usable = inside(words, len(words.hash), SPAN)[:n]
            best, arg = hashes[:n].copy(), np.zeros(n, dtype=np.int64)
            for i in range(1, CHAIN):
                other = hashes[i * BLOCK : i * BLOCK + n]
                less = other < best
                best[less], arg[less] = other[less], i
            from_first = np.arange(len(words.hash)) - np.repeat(words.first, words.last - words.first)
            chain = np.flatnonzero(usable)
            chosen = chain + arg[chain] * BLOCK
            index = np.zeros(len(words.hash), dtype=bool)
            index[chosen[from_first[chain] % BLOCK == 0]] = True
            self.at = np.unique(chosen)
            self.index = index[self.at]
        self.bucket, self.rest = ex.dealt(hashes[self.at] if self.at.size else np.zeros(0, dtype=np.uint64), buckets)
        order = np.lexsort((self.rest, self.bucket))
        self.at, self.index, self.bucket, self.rest = self.at[order], self.index[order], self.bucket[order], self.rest[order]

    def slices(self) -> Iterator[tuple[int, slice]]:
        for b in np.unique(self.bucket):
            yield int(b), slice(*np.searchsorted(self.bucket, [b, b + 1]))


def inside(words: ex.Words, n: int, width: int) -> np.ndarray:
    """At which words a run of ``width`` words of one text begins."""
    usable = np.ones(n, dtype=bool)
    for a, b in zip(words.first.tolist(), words.last.tolist(), strict=True):
        usable[max(a, b - width + 1) : b] = False
    return usable


def ask_anchors(group: ex.Group, buckets: int) -> Iterator[tuple[int, bytes]]:
    anchors = Anchors(group, ex.Words(group), buckets)
    for b, at in anchors.slices():
        rests, inverse, counts = np.unique(anchors.rest[at], return_inverse=True, return_counts=True)
        indexed = np.zeros(len(rests), dtype=bool)
        indexed[inverse[anchors.index[at]]] = True
        yield b, np.uint32(len(rests)).tobytes() + rests.astype("<u4").tobytes() + np.packbits(np.concatenate([counts > 1, indexed])).tobytes()


def answer_anchors(blobs: list[bytes]) -> list[bytes]:
    lists, flags = [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, dtype="<u4", count=1)[0])
        lists.append(np.frombuffer(blob, dtype="<u4", offset=4, count=n))
        flags.append(np.unpackbits(np.frombuffer(blob, dtype=np.uint8, offset=4 + 4 * n))[: 2 * n].astype(bool).reshape(2, n))
    every, both = np.concatenate(lists), np.concatenate(flags, axis=1)
    _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    many, indexed = counts > 1, np.zeros(len(counts), dtype=bool)
    many[inverse[both[0]]] = True
    indexed[inverse[both[1]]] = True
    hit = (many & indexed)[inverse]
    return [np.packbits(h).tobytes() for h in np.split(hit, np.cumsum([len(a) for a in lists])[:-1])]


class Runs:
    """WINDOW-word runs around the anchors that were met, by hash."""

    def __init__(self, group: ex.Group, words: ex.Words, heard: dict[tuple[int, int], bytes], buckets: int):
        anchors = Anchors(group, words, buckets)
        met = np.zeros(len(anchors.at), dtype=bool)
        for b, at in anchors.slices():
            _, inverse = np.unique(anchors.rest[at], return_inverse=True)
            met[at] = np.unpackbits(np.frombuffer(heard[1, b], dtype=np.uint8)).astype(bool)[inverse]
        spots = anchors.at[met]
        depth = np.zeros(len(words.hash) + 1, dtype=np.int32)
        np.add.at(depth, np.maximum(spots - (WINDOW - BLOCK), 0), 1)
        np.add.at(depth, spots + 1, -1)
        self.at = np.flatnonzero((np.cumsum(depth[:-1]) > 0) & inside(words, len(words.hash), WINDOW))
        self.key = ex.run_hashes(words.hash, WINDOW)[self.at] if self.at.size else np.zeros(0, dtype=np.uint64)
        other = ex.run_hashes(words.hash, WINDOW, SECOND_BASE)[self.at] if self.at.size else np.zeros(0, dtype=np.uint64)
        self.bucket, self.check = ex.dealt(other, buckets)
        order = np.lexsort((self.check, self.key, self.bucket))
        for name in ("at", "key", "bucket", "check"):
            setattr(self, name, getattr(self, name)[order])
        fresh = np.append(True, (self.key[1:] != self.key[:-1]) | (self.check[1:] != self.check[:-1]) | (self.bucket[1:] != self.bucket[:-1]))
        self.one = np.flatnonzero(fresh) if self.at.size else np.zeros(0, dtype=np.int64)
        self.which = np.cumsum(fresh) - 1 if self.at.size else np.zeros(0, dtype=np.int64)

    def slices(self) -> Iterator[tuple[int, slice]]:
        buckets = self.bucket[self.one]
        for b in np.unique(buckets):
            yield int(b), slice(*np.searchsorted(buckets, [b, b + 1]))


def ask_runs(group: ex.Group, heard: dict[tuple[int, int], bytes], buckets: int) -> Iterator[tuple[int, bytes]]:
    runs = Runs(group, ex.Words(group), heard, buckets)
    several = np.bincount(runs.which, minlength=len(runs.one)) > 1
    for b, at in runs.slices():
        one = runs.one[at]
        yield b, np.uint32(len(one)).tobytes() + runs.key[one].astype("<u8").tobytes() + runs.check[one].astype("<u4").tobytes() + np.packbits(several[at]).tobytes()


def answer_runs(blobs: list[bytes]) -> list[bytes]:
    keys, checks, flags = [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, dtype="<u4", count=1)[0])
        keys.append(np.frombuffer(blob, dtype="<u8", offset=4, count=n))
        checks.append(np.frombuffer(blob, dtype="<u4", offset=4 + 8 * n, count=n))
        flags.append(np.unpackbits(np.frombuffer(blob, dtype=np.uint8, offset=4 + 12 * n))[:n].astype(bool))
    key, check, flag = np.concatenate(keys), np.concatenate(checks), np.concatenate(flags)
    order = np.lexsort((check, key))
    fresh = np.append(True, (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1]))
    which = np.empty(len(key), dtype=np.int64)
    which[order] = np.cumsum(fresh) - 1
    many = np.bincount(which) > 1
    many[which[flag]] = True
    return [np.packbits(h).tobytes() for h in np.split(many[which], np.cumsum([len(k) for k in keys])[:-1])]


def kept_words(group: ex.Group, words: ex.Words, heard: dict[tuple[int, int], bytes], buckets: int) -> np.ndarray:
    """Which words of the group stay."""
    runs = Runs(group, words, heard, buckets)
    many = np.zeros(len(runs.one), dtype=bool)
    for b, at in runs.slices():
        many[at] = np.unpackbits(np.frombuffer(heard[2, b], dtype=np.uint8))[: at.stop - at.start].astype(bool)
    spots = runs.at[many[runs.which]]
    depth = np.zeros(len(words.hash) + 1, dtype=np.int32)
    np.add.at(depth, spots, 1)
    np.add.at(depth, spots + WINDOW, -1)
    return np.cumsum(depth[:-1]) == 0


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per input row: its other columns, n_words, n_removed, kept_sha256 and kept_text.

    All occurrences of a repeated run go, the first included. Null text has no words. Rows with equal ids
    are texts of their own, so equal rows of WINDOW words or more remove each other. Texts of fewer words
    lose nothing. An empty table gives an empty table.
    """
    groups, buckets = ex.deal(docs, text, doc_id)
    anchors = ex.answer(ex.ask(groups, lambda g: ask_anchors(g, buckets)), 1, answer_anchors)
    runs = ex.answer(ex.ask_again(groups, anchors, lambda g, heard: ask_runs(g, heard, buckets)), 2, answer_runs)
    kinds = {f"c{i}": kind for i, (_, kind, _) in enumerate(ex.transport(docs, text))}
    extra = {"n_words": "long", "n_removed": "long", "kept_sha256": "string", "kept_text": "string"}

    def finish(rows: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*kinds, *extra])
        group = ex.Group(rows)
        words = ex.Words(group)
        keep = kept_words(group, words, ex.by_bucket(heard), buckets)
        facts = []
        for a, b, raw in zip(words.first.tolist(), words.last.tolist(), group.texts, strict=True):
            kept = b" ".join(compress(raw.split(), keep[a:b].tolist()))
            facts.append((b - a, b - a - int(keep[a:b].sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        out = group.rows[list(kinds)].copy()
        for i, name in enumerate(extra):
            out[name] = [f[i] for f in facts]
        return out

    schema = ", ".join(f"`{n}` {k}" for n, k in {**kinds, **extra}.items())
    done = groups.groupBy("g").cogroup(anchors.unionByName(runs).groupBy("g")).applyInPandas(finish, schema)
    return ex.returned(done, docs, text, [e.split()[0] for e in extra])
