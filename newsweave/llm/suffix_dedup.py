"""Suffix-array dedup: remove bytes covered by a WINDOW-byte string that also starts earlier.

Which strings can repeat is found by minimizers: every WINDOW-byte string is represented by the seed (a
string of SEED bytes) with the smallest hash in it, so equal strings have equal seeds at equal offsets.
Groups ask which seeds occur twice. For those, a group sends the bytes around the seed that its strings
cover; the bucket of the seed sorts the suffixes that start at the seed, and the reversed prefixes that
end there, by hash comparison. A string with ``o`` bytes before its seed repeats where entries lie in one
run of at least WINDOW - o common bytes to the right and in one of at least ``o`` to the left, and all
but the earliest of such entries are removed.

A seed with more than HOT entries over all groups has no bucket of its own: its strings are dealt by their
own 128-bit hashes. So where many texts share a passage after differing text, the differing strings spread
over all buckets, an equal one is asked for once per group, and at most HOT entries of a seed meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame

from newsweave.llm import exchange as ex
from newsweave.llm.suffixes import Suffixes
from newsweave.session import give_back

WINDOW = 100
SEED = 32
REACH = WINDOW - SEED + 1
PIECE_BITS = 20
#: Entries sorted at a time, and bytes of text per bucket of seeds.
SLICE = 12_000
BUCKET_BYTES = 24 << 20
#: Entries of a seed up to which they meet in one bucket: what is sorted at a time.
HOT = SLICE

HEAD = np.dtype([("id", "<i8"), ("at", "<i8"), ("rest", "<u4"), ("n", "u1"), ("off", "u1")])
STRING = np.dtype([("high", "<u8"), ("low", "<u8"), ("id", "<i8"), ("at", "<i8")])
RUN = np.dtype([("entry", "<u4"), ("first", "u1"), ("last", "u1")])


class Entries:
    """Seeds of a group with the strings each stands for: string starts are [first, first + n)."""

    def __init__(self, group: ex.Group, buckets: int):
        spots, firsts, counts, hashes = [], [], [], []
        buffer, usable = group.bytes, np.ones(len(group.bytes), dtype=bool)
        for a, b in zip(group.starts, group.ends, strict=True):
            usable[max(a, b - WINDOW + 1) : b] = False
        piece = (1 << PIECE_BITS) - WINDOW
        values, pw = ex.byte_values(), ex.powers(1 << PIECE_BITS)
        inverse = ex.powers(1 << PIECE_BITS, ex.inverse_base())
        for x in range(0, len(buffer) - WINDOW + 1, piece):
            part = buffer[x : x + piece + WINDOW - 1]
            sums = ex.prefix_sums(values[part], pw)
            n = len(part) - SEED + 1
            low = ex.mixed((sums[SEED:] - sums[:-SEED]) * inverse[:n])
            low = (low & ~np.uint64((1 << PIECE_BITS) - 1)) | np.arange(n, dtype=np.uint64)
            span = 1
            while span * 2 <= REACH:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            low = np.minimum(low[: len(low) - (REACH - span)], low[REACH - span :])
            starts = np.flatnonzero(usable[x : x + len(low)])
            if not starts.size:
                continue
            best = low[starts]
            fresh = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (np.diff(starts) != 1)))
            spots.append((best[fresh] & np.uint64((1 << PIECE_BITS) - 1)).astype(np.int64) + x)
            firsts.append(starts[fresh] + x)
            counts.append(np.diff(np.append(fresh, len(starts))))
            hashes.append(ex.mixed(best[fresh] >> np.uint64(PIECE_BITS)))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        self.group = group
        self.spot, self.first, self.n = join(spots, np.int64), join(firsts, np.int64), join(counts, np.int64)
        self.bucket, self.rest = ex.dealt(join(hashes, np.uint64), buckets)
        self.hot = np.zeros(len(self.rest), dtype=bool)
        self.keep(np.lexsort((self.first, self.rest, self.bucket)))

    def slices(self) -> Iterator[tuple[int, slice]]:
        for b in np.unique(self.bucket):
            yield int(b), slice(*np.searchsorted(self.bucket, [b, b + 1]))

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("spot", "first", "n", "bucket", "rest", "hot"):
            setattr(self, name, getattr(self, name)[chosen])

    def keep_repeated(self, heard: dict[tuple[int, int], bytes]) -> None:
        chosen = np.zeros(len(self.rest), dtype=bool)
        for b, at in self.slices():
            _, inverse = np.unique(self.rest[at], return_inverse=True)
            bits = np.unpackbits(np.frombuffer(heard[1, b], dtype=np.uint8).reshape(2, -1), axis=1).astype(bool)
            chosen[at], self.hot[at] = bits[0][inverse], bits[1][inverse]
        self.keep(chosen)

    def collapse(self) -> np.ndarray:
        """Drop entries whose bytes stand earlier in the group; returns the [first, first + n) dropped.

        Texts of a group are in order, so the first of equal entries is the earliest.
        """
        buffer = memoryview(self.group.bytes.tobytes())
        seen: set[tuple[int, bytes]] = set()
        new = np.ones(len(self.rest), dtype=bool)
        off = self.spot - self.first
        for i, (a, n, o) in enumerate(zip(self.first.tolist(), self.n.tolist(), off.tolist(), strict=True)):
            key = (o, bytes(buffer[a : a + n - 1 + WINDOW]))
            if key in seen:
                new[i] = False
            else:
                seen.add(key)
        gone = np.stack([self.first[~new], self.n[~new]], axis=1)
        self.keep(new)
        return gone


class Strings:
    """The WINDOW-byte strings of hot entries: the first of each in the group by bucket, and starts of the others."""

    STEP = 1 << 16

    def __init__(self, entries: Entries, buckets: int):
        first, n = entries.first[entries.hot], entries.n[entries.hot]
        start = np.sort(np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
        buffer, digest = memoryview(entries.group.bytes.tobytes()), xxhash.xxh3_128_digest
        hashes = np.empty((len(start), 2), dtype="<u8")
        for x in range(0, len(start), self.STEP):
            raw = b"".join([digest(buffer[s : s + WINDOW]) for s in start[x : x + self.STEP].tolist()])
            hashes[x : x + self.STEP] = np.frombuffer(raw, dtype="<u8").reshape(-1, 2)
        bucket, _ = ex.dealt(hashes[:, 0], buckets)
        order = np.lexsort((hashes[:, 1], hashes[:, 0], bucket))
        hashes, start = hashes[order], start[order]
        fresh = np.append(True, (hashes[1:] != hashes[:-1]).any(axis=1))[: len(start)]
        self.start, self.hash, self.bucket, self.again = start[fresh], hashes[fresh], bucket[order][fresh], start[~fresh]

    def slices(self) -> Iterator[tuple[int, slice]]:
        for b in np.unique(self.bucket):
            yield int(b), slice(*np.searchsorted(self.bucket, [b, b + 1]))


def ask_strings(entries: Entries, buckets: int) -> Iterator[tuple[int, bytes]]:
    group, strings = entries.group, Strings(entries, buckets)
    text, press = np.searchsorted(group.ends, strings.start, side="right"), zstandard.ZstdCompressor(level=1)
    for b, at in strings.slices():
        asked = np.zeros(at.stop - at.start, dtype=STRING)
        asked["high"], asked["low"] = strings.hash[at].T
        asked["id"], asked["at"] = group.ids[text[at]], strings.start[at] - group.starts[text[at]]
        yield b, press.compress(asked.view(np.uint8).reshape(-1, STRING.itemsize).T.tobytes())


def answer_strings(blobs: list[bytes]) -> list[bytes]:
    """Bits of the strings that stand earlier in another group."""
    expand = zstandard.ZstdDecompressor()
    planes = [np.frombuffer(expand.decompress(blob), dtype=np.uint8).reshape(STRING.itemsize, -1) for blob in blobs]
    lists = [p.T.copy().view(STRING).ravel() for p in planes]
    every = np.concatenate(lists)
    order = np.lexsort((every["at"], every["id"], every["low"], every["high"]))
    high, low = every["high"][order], every["low"][order]
    later = np.zeros(len(every), dtype=bool)
    later[order[1:]] = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
    return [np.packbits(part).tobytes() for part in np.split(later, np.cumsum([len(x) for x in lists])[:-1])]


def ask_seeds(group: ex.Group, buckets: int) -> Iterator[tuple[int, bytes]]:
    entries, press = Entries(group, buckets), zstandard.ZstdCompressor(level=1)
    for b, at in entries.slices():
        rests, counts = np.unique(entries.rest[at], return_counts=True)
        yield b, np.uint32(len(rests)).tobytes() + rests.astype("<u4").tobytes() + press.compress(counts.astype("<u4").tobytes())


def answer_seeds(blobs: list[bytes], most: int | None = None) -> list[bytes]:
    """Bits of the seeds that occur twice, then bits of the hot ones."""
    expand = zstandard.ZstdDecompressor()
    rests, counts = [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, dtype="<u4", count=1)[0])
        rests.append(np.frombuffer(blob, dtype="<u4", offset=4, count=n))
        counts.append(np.frombuffer(expand.decompress(blob[4 + 4 * n :]), dtype="<u4"))
    _, inverse = np.unique(np.concatenate(rests), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts))[inverse]
    parts = np.split(total, np.cumsum([len(r) for r in rests])[:-1])
    return [np.packbits(x > 1).tobytes() + np.packbits(x > (HOT if most is None else most)).tobytes() for x in parts]


def ask_contexts(group: ex.Group, heard: dict[tuple[int, int], bytes], buckets: int) -> Iterator[tuple[int, bytes]]:
    entries = Entries(group, buckets)
    entries.keep_repeated(heard)
    entries.collapse()
    for b, blob in ask_strings(entries, buckets):
        yield buckets + b, b"S" + blob
    entries.keep(~entries.hot)
    text = np.searchsorted(group.ends, entries.first, side="right")
    buffer, press = memoryview(group.bytes.tobytes()), zstandard.ZstdCompressor(level=3)
    for b, at in entries.slices():
        head = np.zeros(at.stop - at.start, dtype=HEAD)
        head["id"], head["at"] = group.ids[text[at]], entries.first[at] - group.starts[text[at]]
        head["rest"], head["n"], head["off"] = entries.rest[at], entries.n[at], (entries.spot - entries.first)[at]
        body = b"".join(bytes(buffer[a : a + n - 1 + WINDOW]) for a, n in zip(entries.first[at].tolist(), entries.n[at].tolist(), strict=True))
        yield b, b"C" + press.compress(np.uint32(len(head)).tobytes() + head.tobytes() + body)


def answer_repeats(blobs: list[bytes]) -> list[bytes]:
    """A bucket is asked either for strings or for contexts of seeds."""
    reply = answer_strings if blobs[0][:1] == b"S" else answer_contexts
    return reply([blob[1:] for blob in blobs])


def answer_contexts(blobs: list[bytes]) -> list[bytes]:
    expand = zstandard.ZstdDecompressor()
    heads, bodies = [], []
    for blob in blobs:
        raw = expand.decompress(blob)
        n = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
        heads.append(np.frombuffer(raw, dtype=HEAD, offset=4, count=n))
        bodies.append(raw[4 + n * HEAD.itemsize :])
    head = np.concatenate(heads)
    body = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    del bodies
    size = head["n"].astype(np.int64) - 1 + WINDOW
    at = np.cumsum(size) - size
    order = np.lexsort((head["at"], head["id"], head["rest"]))
    rest = head["rest"][order]
    border = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
    count = np.diff(np.append(border, len(rest)))
    several = np.flatnonzero(count > 1)
    found = [np.zeros(0, dtype=RUN)]
    lot: list[np.ndarray] = []
    held = 0
    for g in several:
        lot.append(order[border[g] : border[g] + count[g]])
        held += count[g]
        if held >= SLICE:
            found.append(repeats(lot, head, at, size, body))
            lot, held = [], 0
    if lot:
        found.append(repeats(lot, head, at, size, body))
    runs = np.sort(np.concatenate(found), order=["entry", "first"])
    edges = np.searchsorted(runs["entry"], np.cumsum([0] + [len(h) for h in heads]))
    replies = []
    base = 0
    for h, a, b in zip(heads, edges[:-1], edges[1:], strict=True):
        part = runs[a:b].copy()
        part["entry"] -= np.uint32(base)
        base += len(h)
        replies.append(part.tobytes())
    return replies


def repeats(lot: list[np.ndarray], head: np.ndarray, at: np.ndarray, size: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Runs of repeated strings of the entries in ``lot`` (one array per seed, earliest first)."""
    entry = np.concatenate(lot)
    count = np.array([len(g) for g in lot])
    first = np.cumsum(count) - count
    n, off, long = head["n"][entry].astype(np.int64), head["off"][entry].astype(np.int64), size[entry]
    start = np.cumsum(long) - long
    buffer = np.empty(int(long.sum()), dtype=np.uint8)
    for e, s, m in zip(entry.tolist(), start.tolist(), long.tolist(), strict=True):
        buffer[s : s + m] = body[at[e] : at[e] + m]
    right, after = Suffixes(buffer, start + off, long - off).sort(first, count)
    left, ahead = Suffixes(buffer[::-1], len(buffer) - (start + off), off).sort(first, count)
    border = np.zeros(len(entry), dtype=bool)
    border[first] = True
    right_run, left_run = np.empty(len(entry), dtype=np.int64), np.empty(len(entry), dtype=np.int64)
    again = np.zeros((len(entry), REACH), dtype=bool)
    earlier = np.empty(len(entry), dtype=np.int64)
    earlier[np.lexsort((head["at"][entry] + off, head["id"][entry]))] = np.arange(len(entry))
    for o in range(REACH):
        have = np.flatnonzero((o <= off) & (off - o < n))
        if have.size < 2:
            continue
        right_run[right] = np.cumsum(border | (after < WINDOW - o))
        left_run[left] = np.cumsum(border | (ahead < o))
        have = have[np.argsort(earlier[have])]
        key = (right_run[have] << 32) | left_run[have]
        _, one = np.unique(key, return_index=True)
        later = np.ones(have.size, dtype=bool)
        later[one] = False
        again[have[later], off[have[later]] - o] = True
    edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, begins = np.nonzero(edge == 1)
    _, ends = np.nonzero(edge == -1)
    runs = np.zeros(len(rows), dtype=RUN)
    runs["entry"], runs["first"], runs["last"] = entry[rows], begins, ends - 1
    return runs


def removed(group: ex.Group, heard: dict[tuple[int, int], bytes], buckets: int) -> np.ndarray:
    """Which bytes of the group go."""
    entries = Entries(group, buckets)
    entries.keep_repeated(heard)
    gone = entries.collapse()
    spans = [np.stack([gone[:, 0], gone[:, 0] + gone[:, 1] - 1 + WINDOW], axis=1)]
    strings = Strings(entries, buckets)
    starts = [strings.again]
    for b, at in strings.slices():
        bits = np.unpackbits(np.frombuffer(heard[2, buckets + b], dtype=np.uint8)).astype(bool)
        starts.append(strings.start[at][bits[: at.stop - at.start]])
    hit = np.sort(np.concatenate(starts))
    edge = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
    spans.append(np.stack([hit[edge], hit[np.append(edge[1:], len(hit))[: len(edge)] - 1] + WINDOW], axis=1))
    entries.keep(~entries.hot)
    for b, at in entries.slices():
        runs = np.frombuffer(heard[2, b], dtype=RUN)
        first = entries.first[at][runs["entry"]]
        spans.append(np.stack([first + runs["first"], first + runs["last"] + WINDOW], axis=1))
    spans_ = np.concatenate(spans)
    depth = np.zeros(len(group.bytes) + 1, dtype=np.int32)
    np.add.at(depth, spans_[:, 0], 1)
    np.add.at(depth, spans_[:, 1], -1)
    return np.cumsum(depth[:-1]) > 0


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Per input row: its other columns, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept text.

    Null text is empty. Null ids come before all others; rows with equal ids are texts of their own, in
    the order of their text. Texts under WINDOW bytes lose nothing. Kept bytes that no longer form a
    character are left out of the text (not of the digest). An empty table gives an empty table.
    """
    groups, buckets = ex.deal(docs, text, doc_id, BUCKET_BYTES)
    hot = HOT
    seeds = ex.answer(ex.ask(groups, lambda g: ask_seeds(g, buckets)), 1, lambda blobs: answer_seeds(blobs, hot))
    contexts = ex.answer(ex.ask_again(groups, seeds, lambda g, heard: ask_contexts(g, heard, buckets)), 2, answer_repeats)
    kinds = {f"c{i}": kind for i, (_, kind, _) in enumerate(ex.transport(docs, text))}
    extra = ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"] + (["kept_text string"] if keep_text else [])

    def finish(rows: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*kinds, *[e.split()[0] for e in extra]])
        group = ex.Group(rows)
        out = group.rows[list(kinds)].copy()
        gone = removed(group, ex.by_bucket(heard), buckets)
        facts = []
        for a, b, raw in zip(group.starts, group.ends, group.texts, strict=True):
            mask = gone[a:b]
            total = int(mask.sum())
            kept = group.bytes[a:b][~mask].tobytes() if total else raw
            spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if total else 0
            row = (b - a, total, spans, hashlib.sha256(kept).hexdigest())
            facts.append((*row, kept.decode("utf-8", "ignore")) if keep_text else row)
        for i, name in enumerate(e.split()[0] for e in extra):
            out[name] = [f[i] for f in facts]
        del group, gone, facts
        give_back()
        return out

    schema = ", ".join([f"`{n}` {k}" for n, k in kinds.items()] + extra)
    done = groups.groupBy("g").cogroup(seeds.unionByName(contexts).groupBy("g")).applyInPandas(finish, schema)
    return ex.returned(done, docs, text, [e.split()[0] for e in extra])
