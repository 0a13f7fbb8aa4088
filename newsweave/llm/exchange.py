"""Questions and answers between groups of texts and buckets of hashes.

Texts are dealt into groups of about GROUP_BYTES by a hash of id and text, compressed, and shuffled once
(every later step on the groups reuses that exchange). A group asks each bucket of hashes one question, a
packed array without repeats; a bucket sees the questions of all groups and answers each. So a text or
passage with very many copies is one entry per group, no row is made per word or byte, and no task holds
more than a group or a bucket. Numbers of groups and buckets grow with the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsweave.session import bounded_batches, give_back

GROUP_BYTES = 4 << 20
BUCKET_BYTES = 64 << 20
NO_ID = -(1 << 63)

#: An odd multiplier for polynomial hashes modulo 2^64, and a mixing constant.
BASE = 0x9E3779B97F4A7C15
MIX = 0xBF58476D1CE4E5B9

ANSWER = "g int, bucket int, kind int, blob binary"


def deal(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int | None = None, total: int | None = None) -> tuple[DataFrame, int]:
    """Grouped texts and the number of buckets.

    Rows keep all their columns but the text, under the names ``c0`` and so on, plus ``g``, ``id`` (null
    becomes the smallest number) and ``data`` (compressed UTF-8; null is empty). ``total`` is the bytes of all texts, where known.
    """
    bounded_batches(docs.sparkSession)
    if total is None:
        total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    groups, buckets = max(1, math.ceil(total / GROUP_BYTES)), max(1, math.ceil(total / (bucket_bytes or BUCKET_BYTES)))
    rows = docs.select(
        F.pmod(F.xxhash64(doc_id, text), F.lit(groups)).cast("int").alias("g"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
        *[F.col(f"`{name}`").cast(kind).alias(f"c{i}") for i, (name, kind, _) in enumerate(transport(docs, text))],
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch["t"] = [press.compress(t.encode("utf-8", "surrogatepass")) for t in batch["t"]]
            yield batch.rename(columns={"t": "data"})

    fields = ", ".join(f"`{f.name if f.name != 't' else 'data'}` {'binary' if f.name == 't' else f.dataType.simpleString()}" for f in rows.schema)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.mapInPandas(pack, fields).repartition(parts, "g"), buckets


def transport(docs: DataFrame, text: str) -> list[tuple[str, str, T.DataType]]:
    """Name, type on the way and own type of every column but the text.

    Numbers, dates and the like travel as strings, so that nulls and large numbers come back as they were.
    """
    whole = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    return [(f.name, f.dataType.simpleString() if isinstance(f.dataType, whole) else "string", f.dataType) for f in docs.schema if f.name != text]


def returned(done: DataFrame, docs: DataFrame, text: str, extra: list[str]) -> DataFrame:
    """The input's columns with their own types, then ``extra``, which replace input columns of the same name."""
    sent = transport(docs, text)
    own = [done[f"c{i}"].cast(kind).alias(name) for i, (name, _, kind) in enumerate(sent) if name not in extra]
    return done.select(*own, *extra)


class Group:
    """The texts of one group in the order of (id, text), as one byte array."""

    def __init__(self, rows: pd.DataFrame):
        expand = zstandard.ZstdDecompressor()
        texts = [expand.decompress(d) for d in rows["data"]]
        ids = rows["id"].tolist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.rows = rows.iloc[order]
        self.texts = [texts[i] for i in order]
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in self.texts], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(self.texts), dtype=np.uint8)


def ask(groups: DataFrame, question: Callable[[Group], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(g, bucket, kind, blob): what every group asks."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asked = list(question(Group(rows)))
        give_back()
        return packed([(key[0], b, 0, blob) for b, blob in asked])

    return groups.groupBy("g").applyInPandas(run, ANSWER)


def ask_again(groups: DataFrame, answers: DataFrame, question: Callable[[Group, dict[tuple[int, int], bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Like ``ask``, with the answers to earlier questions by (kind, bucket)."""

    def run(key: tuple, rows: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return packed([])
        asked = list(question(Group(rows), by_bucket(heard)))
        give_back()
        return packed([(key[0], b, 0, blob) for b, blob in asked])

    return groups.groupBy("g").cogroup(answers.groupBy("g")).applyInPandas(run, ANSWER)


def answer(asked: DataFrame, kind: int, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(g, bucket, kind, blob): a bucket's answer to each of its questions."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("g")
        replies = reply(rows["blob"].tolist())
        give_back()
        return packed([(g, key[0], kind, blob) for g, blob in zip(rows["g"], replies, strict=True)])

    return asked.groupBy("bucket").applyInPandas(run, ANSWER)


def packed(rows: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["g", "bucket", "kind", "blob"]).astype({"g": "int32", "bucket": "int32", "kind": "int32"})


def by_bucket(heard: pd.DataFrame) -> dict[tuple[int, int], bytes]:
    return {(k, b): blob for k, b, blob in zip(heard["kind"], heard["bucket"], heard["blob"], strict=True)}


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base^0 ... base^n modulo 2^64."""
    steps = np.full(n + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def byte_values() -> np.ndarray:
    """A 64-bit number per byte value, so that runs of small values do not cancel."""
    return mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE))


def prefix_sums(values: np.ndarray, pw: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of values[j] * base^j for j < i."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * pw[: len(values)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, stop), equal for equal content wherever it stands."""
    return (sums[stops] - sums[starts]) * inverse[starts]


def inverse_base(base: int = BASE) -> int:
    return pow(base, -1, 1 << 64)


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit rest of well mixed hashes."""
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Words:
    """Hash, place and text of every word of a group, in order; words do not cross texts.

    Polynomial hashes modulo 2^64 are equal for certain words of some hundred bytes, whatever the base, so
    words beyond LONG bytes are hashed by XXH3 instead.
    """

    SLICE = 1 << 20
    LONG = 128

    def __init__(self, group: Group):
        gap = np.zeros(256, dtype=bool)
        gap[[9, 10, 11, 12, 13, 32]] = True
        values, pw = byte_values(), powers(1 << 10)
        starts, stops, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        at = 0
        while at < len(group.ends):  # whole texts, about SLICE bytes at a time
            to = max(at + 1, int(np.searchsorted(group.ends, group.starts[at] + self.SLICE, side="right")))
            a, b = int(group.starts[at]), int(group.ends[to - 1])
            part = group.bytes[a:b]
            inside = ~gap[part]
            edge = np.zeros(b - a + 1, dtype=bool)
            edge[group.starts[at:to] - a] = True
            begin = inside & (edge[:-1] | np.append(True, ~inside[:-1]))
            end = inside & (edge[1:] | np.append(~inside[1:], True))
            first, last = np.flatnonzero(begin), np.flatnonzero(end)
            if first.size:
                weighted = np.where(inside, values[part], np.uint64(0))
                from_word = np.repeat(first, np.diff(np.append(first, b - a)))
                place = np.arange(b - a) - np.concatenate([np.arange(first[0]), from_word])
                longest = int((last - first).max())
                if longest >= len(pw):
                    pw = powers(2 * longest)
                place = np.minimum(place, longest)
                hashes.append(mixed(np.add.reduceat(weighted * pw[place], first)))
                starts.append(first + a)
                stops.append(last + 1 + a)
            at = to
        self.start, self.stop, self.hash = np.concatenate(starts), np.concatenate(stops), np.concatenate(hashes)
        for i in np.flatnonzero(self.stop - self.start > self.LONG).tolist():
            self.hash[i] = xxhash.xxh3_64_intdigest(group.bytes[self.start[i] : self.stop[i]])
        #: The first word of each text, and one past its last.
        self.first = np.searchsorted(self.start, group.starts)
        self.last = np.searchsorted(self.start, group.ends)


def run_hashes(values: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Mixed hashes of all runs of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = prefix_sums(values, powers(len(values), base))
    return mixed((sums[width:] - sums[:-width]) * powers(n - 1, inverse_base(base)))
