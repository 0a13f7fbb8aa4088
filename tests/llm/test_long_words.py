"""Words that a polynomial hash modulo 2^64 cannot tell apart."""

import hashlib
import math

from newsweave.llm import anchor_dedup, language_model


def thue_morse(n, zero, one):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def test_look_alike_words_are_different_words(spark):
    a, b = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rest = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} x {rest} y"), (4, f"{a} x {rest} y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in anchor_dedup.deduplicated(frame).collect()}
    whole = {i: (0, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows[:2]}
    gone = (37, hashlib.sha256(b"").hexdigest())
    assert got == {**whole, 3: gone, 4: gone}


def test_look_alike_words_are_counted_apart(spark):
    a, b = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rows = [(1, f"{a} {a} {a}"), (2, f"{b} x"), (3, "x x")]
    scored = {r.doc_id: r for r in language_model.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [t for i, t in rows if not scored[i].held_out]
    tokens = [w for t in train for w in [*t.split(), None]]
    n, v = len(tokens), len(set(tokens))
    for i, t in rows:
        want = sum(math.log10((tokens.count(w) + 0.1) / (n + 0.1 * (v + 1))) for w in [*t.split(), None])
        assert abs(scored[i].base_score - want) < 1e-9
