"""Parsing raw model answers that sit in a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions.names import THINK_BLOCK
from newsweave.functions.text import trim_space
from newsweave.schemas import ANNOTATION

# Column -> long key and short key of each item kind.
EVENT_KEYS = {"subject": ("sub", "s"), "type": ("type", "t"), "result": ("res", "r"), "place": ("loc", "l"), "time": ("time", "tm")}
RELATION_KEYS = {"subject": ("sub", "s"), "type": ("type", "t"), "object": ("obj", "o")}
ENTITY_KEYS = {"text": ("text", "txt"), "type": ("type", "ty")}


def json_part(raw: Column) -> Column:
    """The outermost braces of an answer, without its thinking, with common slips repaired."""
    text = trim_space(F.regexp_replace(F.coalesce(raw, F.lit("")), THINK_BLOCK, ""))
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    body = F.translate(F.coalesce(F.nullif(braces, F.lit("")), text), "，：", ",:")
    return F.regexp_replace(F.regexp_replace(body, r",\s*\}", "}"), r",\s*\]", "]")


def parse_answers(answers: DataFrame, raw: str, retries: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Parsed answers with events, relations and entities; and rejected rows with their retry count."""
    body = answers.withColumn("_json", json_part(F.col(raw)))
    good = F.try_parse_json("_json").isNotNull() & F.col("_json").startswith("{")
    keep = [c for c in answers.columns if c != raw]
    parsed = body.where(good).withColumn("_a", F.from_json("_json", ANNOTATION))
    items = parsed.select(
        *keep,
        _items("events", "E", EVENT_KEYS).alias("events"),
        _items("relations", "R", RELATION_KEYS).alias("relations"),
        _items("entities", "K", ENTITY_KEYS).alias("entities"),
    )
    tried = F.coalesce(F.col(retries), F.lit(0)) if retries else F.lit(0)
    rejected = body.where(~good).drop("_json").withColumn("retries", tried + 1)
    return items, rejected


def _items(long: str, short: str, keys: dict[str, tuple[str, str]]) -> Column:
    listed = F.when(F.size(f"_a.{long}") > 0, F.col(f"_a.{long}")).otherwise(F.col(f"_a.{short}"))

    def value(item: Column, key: str) -> Column:
        return F.nullif(F.try_element_at(item, F.lit(key)), F.lit(""))

    def filled(item: Column) -> Column:
        return F.exists(F.map_values(item), lambda v: F.coalesce(v, F.lit("")) != "")

    def renamed(item: Column) -> Column:
        return F.struct(*[F.coalesce(value(item, a), value(item, b), F.lit("")).alias(n) for n, (a, b) in keys.items()])

    return F.coalesce(F.transform(F.filter(listed, filled), renamed), F.array().cast(_item_type(keys)))


def _item_type(keys: dict[str, tuple[str, str]]) -> str:
    return "ARRAY<STRUCT<" + ", ".join(f"{n}: STRING" for n in keys) + ">>"


def clean_summary(raw: Column, max_chars: int) -> Column:
    """A model's summary without thinking and openings, on one line, cut."""
    text = F.regexp_replace(trim_space(F.coalesce(raw, F.lit(""))), THINK_BLOCK, "")
    opening = r"(?i)^(摘要[:：]|我是.*?助手[:：]?|以下是.*?摘要[:：]?|总结如下[:：]?|请看摘要[:：]?|一两句话总结如下[:：]?)"
    return F.substring(trim_space(F.regexp_replace(F.regexp_replace(text, opening, ""), r"\n+", " ")), 1, max_chars)


def enrich(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Hook for a user's own model: ``fn`` sees one Arrow batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)
