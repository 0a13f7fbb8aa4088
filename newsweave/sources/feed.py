"""Posts out of captured feed answers, and record files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsweave.functions.text import strip_html
from newsweave.schemas import FEED

POST_CARD = 9


def feed_posts(captured: DataFrame, payload: str) -> DataFrame:
    """Posts on the cards and in their groups; id is ``id`` or else ``mid``, rows without are dropped."""
    cards = captured.withColumn("_feed", F.from_json(payload, FEED)).withColumn(
        "_card", F.explode("_feed.data.cards")
    )
    direct = cards.withColumn("_post", F.col("_card"))
    nested = cards.withColumn("_post", F.explode("_card.card_group"))
    keep = [c for c in captured.columns if c != payload]
    posts = [
        part.where((F.col("_post.card_type") == POST_CARD) & F.col("_post.mblog").isNotNull()).select(
            *keep, F.col("_post.mblog").alias("_blog")
        )
        for part in (direct, nested)
    ]
    blog = F.col("_blog")
    images = F.transform(
        F.coalesce(blog["pics"], F.array().cast(T.ArrayType(_picture()))),
        lambda p: F.coalesce(F.nullif(p["large"]["url"], F.lit("")), F.nullif(p["url"], F.lit(""))),
    )
    return (
        posts[0]
        .unionByName(posts[1])
        .select(
            *keep,
            F.coalesce(F.nullif(blog["id"], F.lit("")), F.nullif(blog["mid"], F.lit(""))).alias("note_id"),
            strip_html(F.coalesce(blog["text"], F.lit(""))).alias("content"),
            blog["created_at"].alias("created_at"),
            F.filter(images, lambda u: u.isNotNull()).alias("images"),
        )
        .where(F.col("note_id").isNotNull())
    )


def _picture() -> T.StructType:
    return T.StructType(
        [
            T.StructField("url", T.StringType()),
            T.StructField("large", T.StructType([T.StructField("url", T.StringType())])),
        ]
    )


def parse_records(text: Column, record: str) -> Column:
    """Records of a JSON text that is either a list or an object with a RECORDS list."""
    wrapped = F.from_json(text, f"STRUCT<RECORDS: ARRAY<{record}>>")["RECORDS"]
    listed = F.from_json(text, f"ARRAY<{record}>")
    return F.when(F.ltrim(text).startswith("["), listed).otherwise(wrapped)


def read_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Record files of either shape; ``record`` is the struct type of one record."""
    fields = T.StructType.fromDDL(f"r {record}")["r"].dataType
    both = T.StructType([*fields.fields, T.StructField("RECORDS", T.ArrayType(fields))])
    raw = spark.read.schema(both).option("multiLine", True).json(path)
    listed = raw.where(F.col("RECORDS").isNull()).drop("RECORDS")
    return raw.select(F.inline("RECORDS")).unionByName(listed)
