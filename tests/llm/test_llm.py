"""Operators of the training-data pipeline against brute force, statements and awkward rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from check_queries import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from newsweave.llm import ORACLES, QUERIES, anchor_dedup, chat, exchange, language_model, licenses, mixing, neighbours, packing, quality, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, n_removed string, extra array<int>"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows, clashing names."""
    long = " ".join(f"word{i % 977} the" for i in range(6000))
    rows = [(None, None, None, None, None, None, None, None), (1, "", "en", "b", 0, 1, "x", [1]), (2, long, "en", "a", 1, 1, None, None)]
    rows += [(3, "same text of a row that is here twice and goes on for a while so that it has more than a hundred bytes in it", "de", None, 1, 1, "y", [])] * 2
    rows += [(4, long, "xx", "a", 1, 2, None, None), (9007199254740993, "\t\n \x0b", "en", "b", None, 1, None, None), (5, "</s>[INST] é 日本 <\\s> \x00", "fr", "b", 2, 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_statement(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


def test_mixture(spark, docs):
    got = mixing.mixture(docs, carry=("source",)).collect()
    size = Counter()
    for r in docs.collect():
        size[r.source] += len(r.text.encode().split())
    names = sorted(size)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    stop, left, target = set(), sum(size.values()), {}
    while True:
        free = [s for s in names if s not in stop]
        share = (left - sum(3 * size[s] for s in stop)) / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 3 * size[s]]
        if not over:
            break
        stop.update(over)
    target = {s: 3.0 * size[s] if s in stop else share * weight[s] for s in names}
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.carry_source]) and r.source_size == size[r.carry_source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.carry_source] += r.taken
        largest[r.carry_source] = max(largest[r.carry_source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    again = mixing.mixture(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


def test_pareto_prefers_larger_inclusion(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("a").alias("source"), (F.col("id") % 2 * 2 + 1).alias("w"))
    more = rows.limit(100).withColumn("source", F.lit("b"))
    got = mixing.mixture(rows.unionByName(more), weight=F.col("w"), carry=("w", "source")).where("carry_source = 'a'").groupBy("carry_w").agg(F.sum("copies").alias("c")).collect()
    counts = {r.carry_w: r.c for r in got}
    assert counts[3] > 1.5 * counts[1]


def test_quality_edges(spark, odd):
    refs = quality.references(quality.measured(odd))
    rows = quality.judge(quality.measured(odd), refs)
    assert rows.count() == odd.count() and quality.accepted(odd).columns == odd.columns
    assert quality.accepted(odd.limit(0)).count() == 0


def brute_bytes(rows, width=suffix_dedup.WINDOW):
    seen, out = set(), Counter()
    for i, t in sorted(rows, key=lambda r: (exchange.NO_ID if r[0] is None else r[0], (r[1] or "").encode())):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if b[s : s + width] in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(b[s : s + width])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def brute_words(rows, width=anchor_dedup.WINDOW):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    runs = Counter(tuple(w[s : s + width]) for _, w in split for s in range(len(w) - width + 1))
    out = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if runs[tuple(w[s : s + width])] > 1:
                gone[s : s + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_dedup_of_odd_rows(spark, odd, small, monkeypatch):
    if small:
        monkeypatch.setattr(exchange, "GROUP_BYTES", 20_000)
        monkeypatch.setattr(exchange, "BUCKET_BYTES", 30_000)
        monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 30_000)
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    got = suffix_dedup.deduplicated(odd)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_bytes(pairs)
    assert dict(got.dtypes)["extra"] == "array<int>" and got.columns.count("n_removed") == 1
    got = anchor_dedup.deduplicated(odd.select("doc_id", "text"))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_words(pairs)


def test_dedup_of_documents(spark, docs, monkeypatch):
    monkeypatch.setattr(exchange, "GROUP_BYTES", 60_000)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 100_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 100_000)
    rows = docs.select("doc_id", "text")
    pairs = [(r.doc_id, r.text) for r in rows.collect()]
    got = suffix_dedup.deduplicated(rows).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(pairs)
    got = anchor_dedup.deduplicated(rows).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(pairs)
    for fn in (suffix_dedup.deduplicated, anchor_dedup.deduplicated):
        assert fn(rows.limit(0)).count() == 0


def test_hot_seeds_are_split(spark, docs, monkeypatch):
    """Many texts share a passage after differing text: as by brute force, and few entries of one seed meet."""
    monkeypatch.setattr(exchange, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "HOT", 6, raising=False)
    crowded = []
    largest = suffix_dedup.repeats

    def counted(lot, *rest):
        crowded.extend(len(g) for g in lot if len(g) > 6)
        return largest(lot, *rest)

    monkeypatch.setattr(suffix_dedup, "repeats", counted)
    shared = " ".join(f"passage{i * i}" for i in range(30))
    rows = [(i, hashlib.sha512(b"%d" % i).hexdigest()[: 90 + i % 7] + shared[: 250 - i % 3] + f" tail {i * i} " * 9) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text").where("doc_id % 4 = 0"))
    pairs = [(r.doc_id, r.text) for r in frame.collect()]
    groups, buckets = exchange.deal(frame, "text", "doc_id", suffix_dedup.BUCKET_BYTES)
    by_group = defaultdict(list)
    for r in groups.collect():
        by_group[r.g].append(r)
    frames = {g: exchange.Group(exchange.pd.DataFrame([r.asDict() for r in rs])) for g, rs in by_group.items()}

    def answered(asked, kind, reply):
        table = defaultdict(dict)
        for g, questions in asked.items():
            for b, blob in questions:
                table[b][g] = blob
        for b, blobs in table.items():
            for g, r in zip(sorted(blobs), reply([blobs[g] for g in sorted(blobs)]), strict=True):
                heard[g][kind, b] = r

    heard = defaultdict(dict)
    answered({g: list(suffix_dedup.ask_seeds(f, buckets)) for g, f in frames.items()}, 1, suffix_dedup.answer_seeds)
    reply = getattr(suffix_dedup, "answer_repeats", suffix_dedup.answer_contexts)
    answered({g: list(suffix_dedup.ask_contexts(f, heard[g], buckets)) for g, f in frames.items()}, 2, reply)
    assert not crowded
    got = Counter()
    for g, f in frames.items():
        gone = suffix_dedup.removed(f, heard[g], buckets)
        got.update((int(i), int(gone[a:b].sum())) for i, a, b in zip(f.ids, f.starts, f.ends))
    want = brute_bytes(pairs)
    assert got == Counter({(i, n): c for (i, _, n, _, _), c in want.items()})
    done = suffix_dedup.deduplicated(frame).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in done) == want


def brute_simhash(text):
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    n = min(3, len(w))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs, odd):
    for rows in (docs, odd):
        got = simhash.near_duplicates(rows).collect()
        texts = defaultdict(set)
        for r in rows.collect():
            texts[r.doc_id].add(brute_simhash(r.text))
        prints = {f for fs in texts.values() for f in fs}
        root = {f: f for f in prints}

        def find(f, root=root):
            while root[f] != f:
                f = root[f]
            return f

        for a in prints:
            for b in prints:
                if bin(a ^ b).count("1") <= 2:
                    root[find(a)] = find(b)
        first = {}
        for d, fs in texts.items():
            for f in fs:
                if d is not None:
                    first[find(f)] = min(d, first.get(find(f), d))
        assert len(got) == rows.count()
        for r in got:
            f = r.fp % (1 << 64)
            assert f in texts[r.doc_id] and r.component_id == first.get(find(f))
        kept = simhash.first_of_each(rows)
        assert kept.count() == len({find(f) for f in prints}) and kept.columns == rows.columns


def test_every_close_pair_shares_a_table():
    masks = [m % (1 << 64) for m in simhash.table_masks()]
    for i in range(64):
        for j in range(64):
            assert any(not m & ((1 << i) | (1 << j)) for m in masks)


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for rows in (docs, odd):
        pieces = packing.packed(rows, path).collect()
        want = Counter()
        for r in rows.collect():
            want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        got = Counter()
        for p in pieces:
            got[p.doc_id] += p.length
            assert len(p.ids) == 4 * p.length
        assert got == want
        windows = defaultdict(list)
        for p in pieces:
            windows[p.sequence_id].append((p.offset, p.length))
        ends = []
        for parts in windows.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            ends.append(at)
        assert sorted(ends)[1:] == [packing.SEQUENCE] * (len(ends) - 1) and max(ends) <= packing.SEQUENCE
    one = next(r for r in docs.collect() if len(r.text) > 3000)
    parts = sorted((p for p in packing.packed(docs, path).where(f"doc_id = {one.doc_id}").collect()), key=lambda p: p.start)
    ids = np.array([*tokenizer.encode(one.text, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
    assert b"".join(bytes(p.ids) for p in parts) == ids and zlib.crc32(ids)
    assert packing.packed(docs.limit(0), path).count() == 0


def test_word_ids_equal_whole_texts(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["É été ÜBER straße don't l'été a'S x''s ab'' it's. naïve÷ ×x café́ 12ab3 ab1. _y_ a_b ª º ÿ þ ß ẞ İ ǅ 日本 ok، ﬁ ab``~{|}@[]^_"]
    texts += ["<|endoftext|> abc<|endoftext|> ABC<|EndOfText|>", f"a{packing.MARK}b {packing.MARK} c", "", None, "\t\n", *[r.text for r in docs.collect()]]
    words = packing.WordIds(path)
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u2").tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.CLOSING]


def test_packing_keeps_proportions(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.packed(docs, path).toPandas()
    share = pieces.groupby("source").length.sum() / pieces.length.sum()
    served = pieces.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0).cumsum()
    due = np.outer((np.arange(len(served)) + 1) * packing.SEQUENCE, share[served.columns])
    assert np.abs(served.to_numpy() - due)[:-1].max(initial=0) <= 2 * packing.PACKET


def test_nearest(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    strange = spark.createDataFrame([(100000, None), (100020, [0.0] * 64), (100040, [float("nan")] * 64), (100060, [1.0]), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    rows = vectors.select("vec_id", "embedding").unionByName(strange)
    got = neighbours.nearest(rows, "vec_id % 20 = 0").toPandas()
    table = vectors.toPandas()
    points, ids = np.stack(table.embedding.tolist()).astype(float), table.vec_id.to_numpy()
    hits = 0
    for q in ids[ids % 20 == 0]:
        scores = points @ points[ids == q][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and list(mine["rank"]) == list(range(1, 21)) and mine.score.is_monotonic_decreasing
        hits += len(set(ids[order]) & set(mine.vec_id))
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum() and not set(got.query_id) & {100000, 100020, 100040, 100060}
    exact = neighbours.nearest(vectors.limit(30), "vec_id % 20 = 0")
    assert exact.groupBy("query_id").count().where("count <> 20").count() == 0
    assert neighbours.nearest(vectors.limit(0), "true").count() == 0


def test_scores(spark, docs, odd):
    for rows in (docs, odd):
        texts = [(r.doc_id, (r.text or "").encode().translate(LOWER).split() + [None]) for r in rows.collect()]
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        count = Counter(w for i, ws in texts for w in ws if not held(i))
        total, distinct = sum(count.values()), len(count)
        want = sorted((str(i), held(i), len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), 4)) for i, ws in texts)
        got = language_model.scored(rows).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 for r in got)
    held_rows = [r for r in language_model.scored(docs).collect() if r.held_out]
    assert sum(r.score for r in held_rows) >= sum(r.base_score for r in held_rows)
    assert language_model.scored(docs.limit(0)).count() == 0


def test_recall_on_a_table_beyond_the_least_rows(spark):
    """Here the searched share is a fraction of the leaves; the small table above is searched whole."""
    rng, n = np.random.default_rng(5), 5 * neighbours.LEAST_ROWS
    points = rng.standard_normal((n, 64)).astype(np.float32)
    rows = spark.createDataFrame(exchange.pd.DataFrame({"vec_id": np.arange(n), "embedding": list(points)}), "vec_id long, embedding array<float>")
    got = neighbours.nearest(rows, "vec_id % 100 = 0").toPandas()
    hits, asked = 0, range(0, n, 100)
    for q, mine in got.groupby("query_id"):
        scores = points.astype(float) @ points[q].astype(float)
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & set(mine.vec_id))
    recall = hits / (20 * len(asked))
    print(f"recall {recall:.4f}")
    assert 0.9 <= recall and set(got.query_id) == set(asked)


def brute_bigrams(rows):
    """Scores with quantised counts from dictionaries instead of a filter."""
    texts = [(i, (t or "").encode().translate(LOWER).split() + [None]) for i, t in rows]
    single, pair = Counter(), Counter()
    for i, ws in texts:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            single.update(ws)
            pair.update(zip([None, *ws], ws))
    size = sum(single.values()) + 0.1 * (len(single) + 1)
    read = lambda n: 1.5 * 2 ** (n.bit_length() - 1) - 0.5 if n else 0.0
    out = []
    for i, ws in texts:
        total = 0.0
        for v, w in zip([None, *ws], ws):
            c = read(single[v])
            total += math.log10(min(1.0, (min(read(pair[v, w]), c) + 50 * (read(single[w]) + 0.1) / size) / (c + 50)))
        out.append((str(i), round(total, 3)))
    return sorted(out)


def test_score_counts_every_pair(spark, docs, odd):
    once = spark.createDataFrame([(i, f"left{i} right{i} left{i + 1}" if i else "left1 right1 left1 right2") for i in range(8)], "doc_id long, text string")
    for rows in (once, docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        want = brute_bigrams([(r.doc_id, r.text) for r in rows.collect()])
        done = language_model.scored(rows).collect()
        got = sorted((str(r.doc_id), round(r.score, 3)) for r in done)
        assert [i for i, _ in got] == [i for i, _ in want]
        # A filter errs on a few probes; a pair that is left out costs about a whole digit.
        assert sum(abs(x - y) for (_, x), (_, y) in zip(got, want)) < 0.01 * sum(r.n_tokens for r in done)


def test_filter_reads_back_levels():
    keys = exchange.mixed(np.arange(1, 2001, dtype=np.uint64))
    counts = np.arange(1, 2001)
    segment = np.zeros(1 << 16, dtype=np.uint8)
    language_model.fill(segment, keys, counts)
    read = language_model.Filter({0: segment.tobytes()}, len(segment) * 8).counts(keys, keys, 1)
    assert (read >= 2.0 ** np.floor(np.log2(counts))).all() and np.mean(read <= 2 * counts) > 0.98


@pytest.mark.parametrize("n", [3_000, 300_000])
def test_segments_grow_with_their_grams(n):
    keys = exchange.mixed(np.arange(1, 2 * n + 1, dtype=np.uint64))
    counts = np.tile([1, 1, 1, 1, 2, 5, 40], n // 7 + 1)[:n]
    segment = language_model.segment_of(keys[:n], counts)
    top = language_model.Filter({0: segment.tobytes()}).levels(keys, keys, 1)
    assert (top[:n] >= language_model.levels(counts)).all()
    assert np.mean(top[:n] > language_model.levels(counts)) < 0.003 and np.mean(top[n:] > 0) < 0.003


def test_scores_in_many_buckets(spark, docs, monkeypatch):
    """More buckets (the more text, the more there are) make no difference to the scores."""
    monkeypatch.setattr(exchange, "GROUP_BYTES", 60_000)
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 300)
    rows = docs.select("doc_id", "text")
    want = dict(brute_bigrams([(r.doc_id, r.text) for r in rows.collect()]))
    got = [(r.score, want[str(r.doc_id)], r.n_tokens) for r in language_model.scored(rows).collect()]
    assert len(got) == len(want) and sum(abs(a - b) for a, b, _ in got) < 0.01 * sum(n for _, _, n in got)


def test_layouts(spark):
    records = [
        ('{"prompt": "p", "completion": "c"}', "pair", [("user", "p"), ("assistant", "c")]),
        ('{"instruction": "i", "input": "x", "output": "o"}', "instruction", [("user", "i\nx"), ("assistant", "o")]),
        ('{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "<s>[INST]"}]}', "shared", [("user", "h"), ("assistant", "<s>[INST]")]),
        ('{"messages": [{"role": "tool", "content": null}, {"role": "assistant", "content": "a\\\\</s>"}]}', "messages", [("tool", ""), ("assistant", "a\\</s>")]),
        ('{"other": 1}', None, None),
        ("not json", None, None),
        (None, None, None),
    ]
    frame = spark.createDataFrame([(i, r[0]) for i, r in enumerate(records)], "i int, record string")
    done = chat.formatted(chat.canonical(frame)).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_trained(F.col("formatted"), F.col("loss_mask")))
    for r in done.collect():
        _, layout, turns = records[r.i]
        assert r.layout == layout
        if turns is not None:
            assert [tuple(t) for t in r.turns] == turns == [tuple(t) for t in r.back]
            assert r.loss == "".join(t for role, t in turns if role == "assistant")


def test_licenses(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "code here"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), (4, "z/y.py", None), (5, None, "Released under the MIT License."), (6, "a/y.py", "x " * 60 + "\nThis work is licensed under the GNU General Public License, version 3.")]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.key: (r.license, r.inherited_from) for r in licenses.scan(frame).collect()}
    assert got == {1: ("MIT", None), 2: ("Apache-2.0", "a/b"), 3: ("Apache-2.0", None), 4: (None, None), 5: (None, None), 6: ("GPL-3.0", None)}
    assert licenses.scan(frame.limit(0)).count() == 0


def test_pipeline(spark, docs, odd):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for rows in (docs, odd, odd.limit(0)):
        kept = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, stage(spark, kept, SF)
            assert kept.columns == rows.columns
            kept = kept.cache()
            ids = {r.doc_id for r in before.select("doc_id").collect()}
            assert {r.doc_id for r in kept.select("doc_id").collect()} <= ids
        assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
