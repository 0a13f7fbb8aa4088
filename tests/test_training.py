"""Embedding training: what it writes, and joins against vectors sent to all tasks."""

from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from newsweave.operators import completion
from newsweave.session import cut, shared_dir


def written(spark):
    folder = Path(urlparse(shared_dir(spark)).path)
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_training_writes_vectors_not_triples(spark):
    triples = spark.range(20_000).select((F.col("id") % 400).alias("h"), (F.col("id") % 3).alias("r"), (400 + F.col("id") % 100).alias("t"))
    triples = cut(triples)
    before = written(spark)
    completion.train_translations(triples, spark.range(500), spark.range(3), dim=16, epochs=2)
    assert written(spark) - before < 2_000_000


def test_few_and_many_tails_give_the_same(spark, monkeypatch):
    triples = cut(spark.range(900).select((F.col("id") % 90).alias("h"), (F.col("id") % 4).alias("r"), (F.col("id") % 37).alias("t")))
    results = []
    for few in (completion.FEW, 0):
        monkeypatch.setattr(completion, "FEW", few)
        ent, rel, losses = completion.train_translations(triples, spark.range(90), spark.range(4), dim=8, epochs=3, rate=0.1)
        results.append((sorted(ent.collect()), sorted(rel.collect()), losses))
    assert results[0][:2] == results[1][:2]
    assert results[0][2] == pytest.approx(results[1][2])
    assert results[0][2][2] < results[0][2][0]
