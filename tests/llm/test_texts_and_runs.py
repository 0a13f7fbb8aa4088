"""Periodic runs, main text of pages and resampling against plain versions and awkward rows."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.llm import QUERIES, main_text, periodic, resampling
from newsweave.llm.queries import with_planted_periods

SF = "/root/testdata/sf0.001"


def brute_runs(symbols, min_words, min_periods):
    """All stretches with a period by comparing every pair of places; the smallest period of each stays."""
    s, found = np.array(symbols), []
    for p in range(1, len(s) // min_periods + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (s[p:] == s[:-p]).astype(int), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            inside = any(q < p and x <= a and b + p <= x + n for x, n, q in found)
            if b - a + p >= max(min_words, min_periods * p) and not inside:
                found.append((a, b - a + p, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    pick = random.Random(5)
    for _ in range(1500):
        n, kinds = pick.randint(0, 70), pick.randint(1, 5)
        s = [pick.randint(1, kinds) for _ in range(n)]
        if n > 5 and pick.random() < 0.6:
            a, p = pick.randrange(n), pick.randint(1, 9)
            s = [s[i] if i < a else s[min(a + (i - a) % p, n - 1)] for i in range(n)]
        least, periods = pick.choice([(2, 2), (3, 3), (6, 3), (24, 3)])
        assert [tuple(r) for r in periodic.runs_of(s, least, periods).tolist()] == brute_runs(s, least, periods)


def test_runs_of_square_rich_words():
    a, b = [1], [1, 2]
    while len(b) < 300:
        a, b = b, b + a
    assert [tuple(r) for r in periodic.runs_of(b, 2, 2).tolist()] == brute_runs(b, 2, 2)


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    number = {}
    runs = brute_runs([number.setdefault(w, len(number)) for w in words], 24, 3)
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_of_runs_equals_plain_rows(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect())
    assert got == sorted(plain_row(r.doc_id, r.text) for r in rows)
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \t\n", "one", "a " * 23, "a " * 24, f"{line}\n" * 3, f"{line} " * 2, "\xa0 \x1c " * 30, "é ü " * 5000 + line, "x " + "b c d " * 8]
    rows = [(i, t, "own", [1]) for i, t in enumerate(texts)] + [(None, "a " * 30, None, None)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string, `a.b` array<int>")
    done = periodic.collapsed(frame)
    assert done.columns == ["doc_id", "text", "a.b", "n_words", "runs", "kept_text"]
    got = done.collect()
    assert len(got) == len(rows)
    for r in got:
        words = (r.text or "").encode().split()
        runs = brute_runs([words.index(w) for w in words], 24, 3)
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(words), runs)
        gone = {i for a, n, p in runs for i in range(a + p, a + n)}
        assert r.kept_text.encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert periodic.collapsed(frame.limit(0)).collect() == []


def test_planted_periods_leave_null_ids_alone(spark):
    frame = spark.createDataFrame([(None, "a b c"), (3, None), (4, "")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in with_planted_periods(frame).collect()} == {(None, "a b c"), (3, None), (4, "")}


def test_many_texts_share_trees(monkeypatch):
    pick = random.Random(2)
    texts = [" ".join(f"w{pick.randint(0, 3)}" for _ in range(pick.randint(0, 200))) for _ in range(60)]
    want = [r[1] for r in periodic.collapsed_texts(texts)]
    monkeypatch.setattr(periodic, "TREE_WORDS", 64)
    monkeypatch.setattr(periodic, "CHUNK_BYTES", 500)
    assert [r[1] for r in periodic.collapsed_texts(texts)] == want
    for text, runs in zip(texts, want, strict=True):
        words = text.split()
        assert [(r["start"], r["length"], r["period"]) for r in runs] == brute_runs([words.index(w) for w in words], 24, 3)


def plain_article(source):
    """The article of a page of the given layout by plain cuts."""
    inside = re.search(r"<article>(.*)</article>", source, re.DOTALL).group(1)
    blocks = re.split(r"</?(?:p|h1)>", inside)
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_pages_equal_plain_cuts(spark):
    want = {r.page_id: (r.url, plain_article(r.html)) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op12_line_blocks"](spark, SF).collect()
    assert len(got) == len(want) and all(want[r.page_id] == (r.url, r.text) and r.n_chars == len(r.text) for r in got)


LONG = "This is a paragraph of an article that is long enough to stand for the text of a page, with a clause or two"
PAGES = {
    # Menus, notices, adverts, comments and footers known by class only.
    f'<div id="top"><a href=1>Home</a> <a href=2>News</a></div><div class="content"><h1>A title</h1><p>{LONG}.</p><p>Short.</p><div class="ad">Buy now</div>'
    f'<p>{LONG} &amp; more&nbsp;of <a href=x>it</a>.</p><p>The end.</p></div><div class="side-bar sidebar"><h3>Popular</h3></div><div id="comments"><p>{LONG}, says a reader.</p></div>'
    '<div id="footer">Copyright</div>': f"A title\n\n{LONG}.\n\nShort.\n\n{LONG} & more of it.\n\nThe end.",
    # A short article in main, a longer notice before it and a longer comment after it.
    f'<div class="cookie-notice"><p>{LONG}.</p></div><header><h1>Site</h1></header><main><h1>Title</h1><p>Only a short text.</p></main>'
    f'<section class="comments"><article class="comment"><p>{LONG}.</p></article></section>': "Title\n\nOnly a short text.",
    # Start tags without an end, in a menu and in the text; references without a semicolon.
    "<nav><ul><li><a>Home</a><article><h1>T</h1><p>One<p>Two &lt;b&gt; &#233; &eacute; &copy<p>Three<br>four<footer>foot": "T\n\nOne\n\nTwo <b> é é ©\n\nThree four",
    # Markup in scripts, styles, comments and attributes is no text.
    f"<article><script>var a='</p><article>';</script><style>p{{}}</style><!-- <p>not</p> --><p title='a>b'>{LONG}</p><form><p>Sign up</p></form></article>": LONG,
    f"<form action=x><div><p>{LONG}.</p></div></form>": f"{LONG}.",
    f"<table><tr><td><a href=1>menu</a></td><td><p>{LONG}.</p><p>More.</p></td></tr></table>": f"{LONG}.\n\nMore.",
    f'<body class="has-sidebar"><article class="post with-comments"><header><h1>T</h1></header><p>{LONG}</p><aside>Also read</aside><ul><li>a</li><li>b</li></ul></article></body>': f"T\n\n{LONG}\n\na\n\nb",
    "Plain text & no tags": "Plain text & no tags",
    "<article><p> \n </p></article>": "",
    "<!-- never closed <p>text</p>": "",
    "<p>text<script>never closed": "text",
    "": "",
}


@pytest.mark.parametrize("source", PAGES)
def test_main_text(source):
    assert main_text.main_text(source) == PAGES[source]


def test_pages_of_any_kind(spark):
    deep = "<div>" * 20_000 + LONG + "</div>" * 20_000
    rows = [(1, None, "x"), (2, "", "x"), (None, "<p>a</p>", None), (3, deep, "y"), (4, "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>", "y"), (4, "<p>a</p>", "z"), (4, "<p>a</p>", "z")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    done = main_text.extracted(frame)
    assert done.columns == ["page_id", "html", "text"]
    want = ["", "", "a", LONG, "\n\n".join([LONG] * 5000), "a", "a"]
    assert sorted(r.text for r in done.collect()) == sorted(want)
    assert main_text.extracted(frame.limit(0)).collect() == []


def words_of(text):
    lower = (text or "").translate(str.maketrans(resampling.UPPER, resampling.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_sample(docs, target, longest=1, buckets=resampling.BUCKETS, percent=10):
    def feats(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in feats(x)), Counter(b for x in target for b in feats(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for doc_id, text in docs:
        f = feats(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((doc_id, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    return rows, [r[0] for r in able[: percent * len(able) // 100]]


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 35)])
def test_sample_equals_plain_version(spark, longest, percent):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows, drawn = plain_sample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], longest, percent=percent)
    got = resampling.sampled(docs, target, percent, longest=longest).collect()
    assert sorted((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == sorted(rows)
    assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_sample_of_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text, 7)] * 50 + [(None, text, 8)] * 50 + [(2, None, 9), (3, "", 9), (None, None, None), (4, "É日 " * 40000, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    target = spark.createDataFrame([(None,), ("",), ("word1 word2",)], "text string")
    got = resampling.sampled(frame, target, carry=("rank",)).collect()
    plain, drawn = plain_sample([(r[0], r[1]) for r in rows], [None, "", "word1 word2"])
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(plain, key=key)
    # Equal keys are drawn row by row: exactly as many as the share asks for.
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r.doc_id for r in ranked] == drawn and [r["rank"] for r in ranked] == list(range(1, 11))
    assert resampling.resampled(frame, target).columns == frame.columns and resampling.resampled(frame, target).count() == 10
    assert resampling.sampled(frame.limit(0), target).collect() == []
    assert len(resampling.sampled(frame, target.limit(0)).collect()) == len(rows)


def test_cutoff_is_the_nth_key(spark):
    keys = spark.range(3000, numPartitions=7).select(
        (F.xxhash64("id") % 40).alias("order"), (F.col("id") % 11).alias("key"), F.col("id").alias("row")
    ).cache()
    ordered = sorted(tuple(r) for r in keys.collect())
    for n in (1, 2, 777, 2999, 3000):
        assert resampling.cutoff(keys, n) == ordered[n - 1]
    assert resampling.cutoff(keys, 0) is None


def test_a_round_discards_a_quarter():
    pick = random.Random(3)
    for _ in range(200):
        parts = [sorted(pick.random() for _ in range(pick.randint(1, 40))) for _ in range(pick.randint(1, 12))]
        side = resampling.Side(sum(map(len, parts)), [(len(p), (p[(len(p) - 1) // 2],)) for p in parts])
        every, pivot = sorted(x for p in parts for x in p), side.pivot()[0]
        assert 4 * sum(x <= pivot for x in every) >= len(every) and 4 * sum(x >= pivot for x in every) >= len(every)
