"""Quality rules: counts of a text, and its distance from the usual text of its language.

Every document gets a histogram of character classes and one of common words. The reference of a
language is the sum of the histograms of all its documents with at least MIN_WORDS words. A document
fails when one of the two Jensen-Shannon distances (base 2, so 0 to 1) is above its bound. Documents
under MIN_WORDS words (MIN_WORDS_FOR_WORDS for common words: short texts stray by chance), or of a
language without a list of common words, are not held against a reference. All of it is column expressions; the references are one row per listed language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions.text import let
from newsweave.llm.columns import words
from newsweave.session import cut

#: Frequent function words per language.
COMMON_WORDS = {
    "de": ["der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "nicht", "sich", "dem", "des", "ein", "eine", "auf", "für", "im", "als"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "with", "as", "was", "are", "by", "be", "at", "this", "from"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es", "al", "lo"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "au", "sur", "ce", "avec"],
}
PUNCTUATION = ".,;:!?'\"()\\-"
SYMBOLS = "#*$%&|<>"
LONGEST_COMMON = max(len(w.encode()) for common in COMMON_WORDS.values() for w in common)
WINDOW = 8
BASE_WORDS = 20
BASE_REPEATED_PERCENT = 30
MIN_WORDS = 50
MIN_WORDS_FOR_WORDS = 80
MAX_CLASS_DISTANCE = 0.26
MAX_WORD_DISTANCE = 0.31

CLASSES = 6
BINS = 21


def repeated_words(tokens: Column) -> Column:
    """Words inside windows of eight words found twice or more in the text, the first one included."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
        return F.aggregate(let(ordered, starts), begin, step, lambda acc: acc["n"])

    def joined(ids: Column, step: int) -> Column:
        return F.transform(F.slice(ids, F.lit(1), F.size(ids) - step), lambda h, i: F.xxhash64(h, F.get(ids, i + step)))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    # Hashes of one, two, four and eight words: each from two of the length before.
    of_two = lambda ids: let(joined(ids, 1), of_four)
    of_four = lambda ids: let(joined(ids, 2), of_eight)
    of_eight = lambda ids: let(joined(ids, 4), count)
    some = let(F.transform(tokens, lambda w: F.xxhash64(w)), of_two)
    return F.when(F.size(tokens) <= WINDOW, F.lit(0)).otherwise(some).cast("long")


def only(text: Column, chars: str) -> Column:
    """How many characters of the set a text has."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", ""))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def class_counts(text: Column, word_chars: Column) -> list[Column]:
    """Characters per class: space, upper case, digits, sentence marks, symbols, all others."""
    n = F.char_length(text)
    parts = [n - word_chars, *[only(text, chars) for chars in (r"\p{Lu}", "0-9", PUNCTUATION, SYMBOLS)]]
    rest = n
    for part in parts:
        rest = rest - part
    return [*parts, rest]


def common_counts(tokens: Column, lang: Column) -> Column:
    """Words per common word of the language, all other words in the last bin; null without a list."""
    lists = F.lit(None).cast("array<string>")
    for code, common in COMMON_WORDS.items():
        lists = F.when(lang == code, F.array(*map(F.lit, common))).otherwise(lists)

    def counts(found: Column) -> Column:
        bins = [F.size(found) - F.size(F.array_remove(found, k)) for k in range(1, BINS)]
        known = F.size(F.array_remove(found, 0))
        return F.array(*[b.cast("long") for b in [*bins, F.size(tokens) - known]])

    short = F.filter(tokens, lambda w: F.octet_length(w) <= LONGEST_COMMON)
    place = let(lists, lambda known: F.transform(short, lambda w: F.array_position(known, F.lower(w))))
    return F.when(lists.isNotNull(), let(place, counts))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null when one of them is empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda acc, x: acc + x)
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def divergence(p: Column, q: Column) -> Column:
        pairs = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
        return F.sqrt(F.greatest(total(pairs), F.lit(0.0)))

    share = lambda h: let(total(h), lambda t: F.transform(h, lambda x: x / t))
    ok = (total(counts) > 0) & (total(reference) > 0)
    return F.when(ok, let(share(counts), lambda p: let(share(reference), lambda q: divergence(p, q))))


def histograms(tokens: Column, text: Column, lang: Column) -> list[Column]:
    word_chars = F.char_length(F.array_join(tokens, ""))
    return [
        F.size(tokens).cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        F.array(*[c.cast("long") for c in class_counts(text, word_chars)]).alias("classes"),
        common_counts(tokens, lang).alias("common"),
    ]


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", repeats: bool = True) -> DataFrame:
    """``docs`` with a column ``_quality``: word and character counts, histograms, repeats if asked for."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_quality_w", words(body))
    parts = histograms(F.col("_quality_w"), body, F.col(lang))
    if repeats:
        parts += [repeated_lines(body).alias("n_dup_lines"), repeated_words(F.col("_quality_w")).alias("n_repeat_words")]
    return rows.withColumn("_quality", F.struct(*parts)).drop("_quality_w")


def references(rows: DataFrame, lang: str = "lang") -> DataFrame:
    """One row per listed language: summed histograms of its measured rows of MIN_WORDS words or more."""
    known = rows.where(F.col(lang).isin(list(COMMON_WORDS))).select(F.col(lang).alias("lang"), "_quality.*")
    known = known.where(F.col("n_words") >= MIN_WORDS)
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(CLASSES)]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"m{i}") for i in range(BINS)]
    per_lang = known.groupBy("lang").agg(*sums)
    return per_lang.select(
        F.col("lang").alias("_ref_lang"),
        F.array(*[f"c{i}" for i in range(CLASSES)]).alias("_ref_classes"),
        F.array(*[f"m{i}" for i in range(BINS)]).alias("_ref_words"),
    )


def judge(rows: DataFrame, refs: DataFrame, lang: str = "lang") -> DataFrame:
    """Measured rows with ``base_failed``, both distances and ``kept`` added to ``_quality``.

    Every row is judged by itself, so repeated rows, null ids and further columns do no harm (names that
    begin with ``_quality`` or ``_ref_`` are reserved). Null text counts as empty and fails the base rule.
    An empty table gives an empty table. ``refs`` has at most one row per list in COMMON_WORDS.
    """
    rows = rows.join(F.broadcast(refs), F.col(lang) == F.col("_ref_lang"), "left")
    q = F.col("_quality")
    n = q["n_words"]
    failed = (n < BASE_WORDS) | (100 * q["n_repeat_words"] > BASE_REPEATED_PERCENT * n)
    far = (n >= MIN_WORDS) & (distance(q["classes"], F.col("_ref_classes")) > MAX_CLASS_DISTANCE)
    odd = (n >= MIN_WORDS_FOR_WORDS) & (distance(q["common"], F.col("_ref_words")) > MAX_WORD_DISTANCE)
    kept = ~(failed | F.coalesce(far, F.lit(False)) | F.coalesce(odd, F.lit(False)))
    n_symbols = F.get(q["classes"], F.lit(4))
    whole = q.withField("n_symbols", n_symbols).withField("base_failed", failed).withField("kept", kept)
    return rows.withColumn("_quality", whole).drop("_ref_lang", "_ref_classes", "_ref_words")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns: one pass for the references, one for the verdicts."""
    refs = cut(references(measured(docs, repeats=False)))
    judged = judge(measured(docs), refs)
    return judged.where(judged["_quality"]["kept"]).select(*docs.columns)
