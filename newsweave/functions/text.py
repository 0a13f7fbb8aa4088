"""Column expressions over text: cleaning, splitting, counting hits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


ALIAS_SEPARATORS = r"[、,，;；|\s]+"
SENTENCE_END = r"[。！？；;\n]+"
TERM_NOISE = r"[^\x{4e00}-\x{9fa5}A-Za-z0-9]+"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``fn``.

    Long rule chains would otherwise repeat their input at every step, both in work and in the
    size of the generated code.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def blank_to_null(text: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def content_or_title(content: Column, title: Column) -> Column:
    return F.coalesce(blank_to_null(content), blank_to_null(title))


def contains_any_keyword(keywords: str, columns: Sequence[Column]) -> Column:
    """Comma-separated keywords, literal and case-insensitive, in any of the columns."""
    words = [w.strip().lower() for w in keywords.split(",") if w.strip()]
    hit = F.lit(not words)
    for column in columns:
        for word in words:
            hit = hit | F.coalesce(F.contains(F.lower(column), F.lit(word)), F.lit(False))
    return hit


def strip_html(html: Column) -> Column:
    """Line breaks for <br>, tags dropped, trimmed."""
    broken = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    return trim_space(F.regexp_replace(broken, r"(?s)<.*?>", ""))


def trim_space(text: Column) -> Column:
    """Trim blanks, tabs and line breaks (``trim`` alone only drops blanks)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def title_or_first_line(title: Column, text: Column) -> Column:
    first_line = F.substring(F.split_part(text, F.lit("\n"), F.lit(1)), 1, 50)
    return F.coalesce(F.nullif(strip_html(title), F.lit("")), first_line)


def squeeze(text: Column) -> Column:
    """Tags and links out, white space squeezed."""
    untagged = F.regexp_replace(text, r"<[^>]+>", " ")
    unlinked = F.regexp_replace(untagged, r"https?://\S+", " ")
    return F.trim(F.regexp_replace(unlinked, r"\s+", " "))


def embedding_text(title: Column, content: Column, max_chars: int | None = None) -> Column:
    """Title and body in one text; ``max_chars`` keeps only the start of the body."""
    body = squeeze(F.coalesce(content, F.lit("")))
    if max_chars is not None:
        body = F.substring(body, 1, max_chars)
    return F.trim(F.concat(squeeze(F.coalesce(title, F.lit(""))), F.lit("。"), body))


def split_names(text: Column) -> Column:
    """The non-empty parts of a name list."""
    return F.filter(F.split(text, ALIAS_SEPARATORS), lambda part: part != "")


def hits(text: Column, terms: Column) -> Column:
    """How many of the (distinct, non-empty) terms occur in the text."""
    found = F.filter(F.array_distinct(terms), lambda term: (term != "") & F.contains(text, term))
    return F.size(found).cast("long")


def clean_term(term: Column) -> Column:
    return F.regexp_replace(term, TERM_NOISE, "")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """One regular expression for a fixed word list."""
    return text.rlike("|".join(rf"\Q{w}\E" for w in words))


def ends_with_any(text: Column, endings: Sequence[str]) -> Column:
    return text.rlike("(" + "|".join(rf"\Q{w}\E" for w in endings) + ")$")


def map_lookup(key: Column, table: dict[str, str]) -> Column:
    """A fixed dictionary as a map literal, evaluated inside the stage without a join."""
    pairs = [F.lit(text) for pair in table.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), key)
