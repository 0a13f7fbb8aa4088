"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of documents (in the order of a hash of the id), each cut into packets of at most
PACKET tokens. A window of SEQUENCE tokens gives each queue credit for its target share of the window; a
packet is served once the credit covers it, and what is left over or owed goes on to the next window. The
credit of a queue covers the packet that ends at its token x at time x / share, so the order of service is
the order of these times and needs no walk over windows: places in a queue and in the whole are sums over
buckets of time, and the deficits carry over partitions as the sums do. Windows are filled without gaps,
so packets are cut at their borders and only the last window is short.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import PandasUDFType

from newsweave.llm.columns import hint_small
from newsweave.session import bounded_batches, cut, give_back

SEQUENCE = 2048
PACKET = 256
CLOSING = 1
CACHED_WORDS = 500_000
WORDS_AT_ONCE = 16
#: Characters of texts that are encoded together, and words whose ids are gathered at a time.
CHUNK_CHARS = 2 << 20
WORDS_GATHERED = 1 << 18
QUEUE_BUCKETS = 4096
BUCKET_TOKENS = 1 << 19
FAN = 4096
PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "sequence_id", "offset")])
#: Stands between words that are encoded together; words that hold it are encoded alone.
MARK = "\x7f"
#: Small Latin letters, which normalizing leaves alone.
LETTERS = rb"(?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++"
#: Words, one a line: letters and marks, or the whole word.
WORD_LINES = re.compile(b"(?m)^(?:(" + LETTERS + rb")([!-/:-@\[-`{-~]*)|(.*))$")
LATIN = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()]


class WordIds:
    """Token ids per word, as 16-bit bytes; the tokenizer never joins across white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.one(MARK)
        assert len(self.mark) == 1
        self.by_letters = self.tokenizer.model.tokenize
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelled = str.maketrans({c: split(c)[0][0] for c in LATIN})
        self.known: dict[bytes, bytes] = {b"": b""}

    def one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known = {w: self.known[w] for w in words if w in self.known} | {b"": b""}
        special = {w for w in new if b"<|" in w} if b"<|" in b"".join(new) else set()  # told by case
        self.learn_parts(special)
        plain = list(new.difference(special))
        if not plain:
            return
        # The tokenizer lowers case and splits marks from letters, so parts stand for many words.
        known = self.known
        simple = [w for w in plain if w.isalpha()]
        mixed = [w for w in plain if not w.isalpha()]
        lower = [w.lower() for w in simple]
        split = WORD_LINES.findall(b"\n".join(mixed).lower()) if mixed else []
        self.learn_letters({*lower, *[a for a, _, _ in split]}.difference(known))
        self.learn_parts({p for _, b, c in split for p in (b, c)}.difference(known))
        known.update(zip(simple, map(known.__getitem__, lower)))
        known.update(zip(mixed, [known[a] + known[b] + known[c] for a, b, c in split], strict=True))

    def learn_letters(self, runs: set[bytes]) -> None:
        """Runs of letters are one piece to the tokenizer: straight to its model."""
        tokenize, known = self.by_letters, self.known
        for run in runs:
            text = run.decode()
            known[run] = array("H", [t.id for t in tokenize(text if run.isascii() else text.translate(self.spelled))]).tobytes()

    def learn_parts(self, parts: set[bytes]) -> None:
        together, texts = [], []
        for part in parts:
            text = part.decode("utf-8", "replace")
            if MARK in text:
                self.known[part] = array("H", self.one(text)).tobytes()
            else:
                together.append(part)
                texts.append(text)
        mark = int(self.mark[0])
        for at in range(0, len(together), WORDS_AT_ONCE):
            batch = together[at : at + WORDS_AT_ONCE]
            ids = self.one(f" {MARK} ".join(texts[at : at + WORDS_AT_ONCE]))
            begin = 0
            for part in batch:
                end = ids.index(mark, begin) if part != batch[-1] else len(ids)
                self.known[part] = array("H", ids[begin:end]).tobytes()
                begin = end + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text the ids of its words, then CLOSING.

        Texts are split and their words numbered by Arrow; only different words are looked up.
        """
        parts = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        coded = parts.values.dictionary_encode()
        _, edges, raw = coded.dictionary.buffers()
        edge, raw = np.frombuffer(edges, dtype=np.int64)[: len(coded.dictionary) + 1].tolist(), raw.to_pybytes() if raw else b""
        words = [raw[a:b] for a, b in zip(edge, edge[1:])]
        self.learn(set(words))
        data = [self.known[w] for w in words]
        size = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) // 2
        flat, begin, which = np.frombuffer(b"".join(data), dtype="<u2"), np.cumsum(size) - size, coded.indices.to_numpy()
        ids = []
        for at in range(0, len(which), WORDS_GATHERED):
            some = which[at : at + WORDS_GATHERED]
            n = size[some]
            stop = np.cumsum(n)
            ids.append(flat[np.arange(stop[-1]) + np.repeat(begin[some] - stop + n, n)].tobytes())
        whole, closing = b"".join(ids), np.array([CLOSING], dtype="<u2").tobytes()
        ends = 2 * np.concatenate([[0], np.cumsum(size[which])])[parts.offsets.to_numpy()]
        return [whole[a:b] + closing for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, about CHUNK_CHARS characters at a time."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= CHUNK_CHARS:
            yield texts[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per Python worker, kept from task to task; it knows at most CACHED_WORDS words."""
    return WordIds(path)


def tokenized(docs: DataFrame, tokenizer_path: str, text: str, source: str, doc_id: str) -> DataFrame:
    """_row, doc_id, source, n, data (compressed 16-bit ids)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, press = word_ids(tokenizer_path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            sizes, data = [], []
            for texts in chunks(batch.tolist()):
                for ids in words.encode(texts):
                    sizes.append(len(ids) // 2)
                    data.append(press.compress(ids))
            give_back()
            yield pd.DataFrame({"n": sizes, "data": data})

    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.pandas_udf(run, kind, PandasUDFType.SCALAR_ITER)(F.col(text)).alias("t"))
    return rows.select("doc_id", "source", "t.n", "t.data", F.monotonically_increasing_id().alias("_row"))


def running(totals: DataFrame, bucket: str, value: str) -> DataFrame:
    """(bucket, _before): sums of the buckets before, over two levels so that no task sees all buckets."""
    rows = totals.withColumn("_block", F.floor(F.col(bucket) / FAN))
    blocks = rows.groupBy("_block").agg(F.sum(value).alias("_sum"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_block"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(blocks, "_block").select(bucket, (F.col("_base") + F.col("_within")).alias("_before"))


def layout(rows: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """_row and its pieces (start, length, sequence_id, offset) from (_row, doc_id, source, n)."""
    queues = rows.groupBy("source").agg(F.sum("n").alias("_total"))
    share = F.col("_total").cast("double")
    for name, value in (shares or {}).items():
        share = F.when(F.col("source") == name, F.lit(float(value))).otherwise(share)
    queues = cut(queues.withColumn("_share", share))
    facts = queues.agg(F.coalesce(F.sum("_total"), F.lit(0)), F.max(F.col("_total") / F.col("_share"))).first()
    total, latest = int(facts[0]), float(facts[1] or 1.0)
    buckets = max(1, total // BUCKET_TOKENS)

    mark = F.xxhash64("doc_id")
    placed = rows.withColumn("_mark", mark).withColumn("_slot", F.pmod(F.shiftright("_mark", 20), F.lit(QUEUE_BUCKETS)))
    slots = placed.groupBy("source", "_slot").agg(F.sum("n").alias("_sum"))
    along = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(F.col("source").alias("_s"), F.col("_slot").alias("_k"), F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("source", "_slot").orderBy("_mark", "doc_id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    begun = placed.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slot") == F.col("_k")))
    begun = begun.select("_row", "source", "n", (F.col("_base") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("_at"))
    timed = begun.join(hint_small(queues.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
    packets = timed.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PACKET).cast("long"))))
    packets = packets.withColumn("length", F.least(F.lit(PACKET).cast("long"), F.col("n") - F.col("start")))
    when = (F.col("_at") + F.col("start") + F.col("length")) / F.col("_share") / latest
    packets = packets.select("_row", "source", "start", "length", when.alias("_when"), (F.col("_at") + F.col("start")).alias("_place"))
    packets = packets.withColumn("_bucket", F.least(F.floor(F.col("_when") * buckets), F.lit(buckets - 1)))
    sums = running(packets.groupBy("_bucket").agg(F.sum("length").alias("_sum")), "_bucket", "_sum")
    order = Window.partitionBy("_bucket").orderBy("_when", "source", "_place", "_row").rowsBetween(Window.unboundedPreceding, -1)
    spots = packets.join(sums, "_bucket").withColumn("_spot", F.col("_before") + F.coalesce(F.sum("length").over(order), F.lit(0)))
    offset = F.pmod("_spot", F.lit(SEQUENCE))
    fits = F.least(F.col("length"), SEQUENCE - offset)
    window = F.floor(F.col("_spot") / SEQUENCE)
    piece = lambda s, n, w, o: F.struct(s.cast("long").alias("start"), n.cast("long").alias("length"), w.cast("long").alias("sequence_id"), o.cast("long").alias("offset"))
    head = piece(F.col("start"), fits, window, offset)
    tail = piece(F.col("start") + fits, F.col("length") - fits, window + 1, F.lit(0))
    parts = F.when(fits < F.col("length"), F.array(head, tail)).otherwise(F.array(head))
    return spots.groupBy("_row").agg(F.sort_array(F.flatten(F.collect_list(parts))).alias("pieces"))


def packed(docs: DataFrame, tokenizer_path: str, shares: dict[str, float] | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, source, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32 bits), a row per piece.

    ``shares`` sets target shares by source; by default a source's share is that of its tokens, so all
    queues end together. Null and empty texts are the closing id alone. Null sources are one queue. Rows
    with equal ids are documents of their own. Neighbouring packets of a document in one window are one
    piece. An empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    tokens = cut(tokenized(docs, tokenizer_path, text, source, doc_id))
    pieces = layout(tokens.select("_row", "doc_id", "source", "n"), shares)
    both = tokens.join(pieces, "_row").select("doc_id", "source", "n", "data", "pieces")

    kind = T.ArrayType(T.StructType([*PIECE.fields, T.StructField("ids", T.BinaryType())]))

    def spread(data: pd.Series, pieces: pd.Series) -> pd.Series:
        expand, out = zstandard.ZstdDecompressor(), []
        for blob, parts in zip(data, pieces, strict=True):
            ids = np.frombuffer(expand.decompress(blob), dtype="<u2").astype("<u4")
            rows: list[dict] = []
            for p in parts:
                last = rows[-1] if rows else None
                if last and last["sequence_id"] == p["sequence_id"] and last["offset"] + last["length"] == p["offset"]:
                    last["length"] += p["length"]
                else:
                    rows.append({k: p[k] for k in ("start", "length", "sequence_id", "offset")})
            for r in rows:
                r["ids"] = ids[r["start"] : r["start"] + r["length"]].tobytes()
            out.append(rows)
        give_back()
        return pd.Series(out)

    pieces_of = F.pandas_udf(spread, kind, PandasUDFType.SCALAR)
    rows = both.select("doc_id", "source", F.col("n").alias("doc_tokens"), F.explode(pieces_of("data", "pieces")).alias("p"))
    return rows.select("doc_id", "source", "doc_tokens", "p.*")
