"""Texts reach Python in batches of bounded size, however many rows that are."""

import pandas as pd
from pyspark.sql import functions as F

from newsweave.llm import exchange


def test_batches_are_bounded(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 20_000).alias("text"))
    exchange.deal(docs)

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [int(batch["text"].str.len().sum())]})

    largest = docs.coalesce(1).mapInPandas(sizes, "n long").agg(F.max("n")).first()[0]
    assert largest < 8 << 20
