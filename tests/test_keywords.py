"""Keywords counted in groups of texts against the same terms counted as rows."""

import random

from pyspark.sql import functions as F

from newsweave.operators import hot


def test_groups_and_rows_agree(spark, monkeypatch):
    rng = random.Random(5)
    words = ["Über", "straße", "新闻", "报道", "a", "bb", "ccc", "dddddddd", "eeeeeeeee", "x1", "9", "ÉÉ", "ff"]
    rows = [(i % 3, i, " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(120)] + [(1, 500, None), (2, 501, "")]
    texts = spark.createDataFrame(rows, "label INT, text_id LONG, text STRING")
    monkeypatch.setattr("newsweave.llm.exchange.GROUP_BYTES", 1500)
    grouped = hot.cluster_keywords(texts, topk=30)
    plain = hot.cluster_keywords(texts, topk=30, max_features=10_000)
    order = lambda df: sorted(tuple(r) for r in df.select("label", "rank", "keyword", F.round("score", 5)).collect())
    assert order(grouped) == order(plain)


def test_terms_are_not_rows(spark):
    texts = spark.range(4).select((F.col("id") % 2).alias("label"), F.col("id").alias("text_id"), F.lit("some words here").alias("text"))
    plan = hot.cluster_keywords(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_sizes_of_clusters_hold_bodies_and_titles(spark):
    """Both texts of a member count for its label once, also where members come partitioned by label."""
    from newsweave.plans.hot_queries import member_texts

    rows = [(i % 3, i, f"title {i}", "some words " * 50) for i in range(60)]
    docs = spark.createDataFrame(rows, "label INT, doc_id LONG, title STRING, content STRING")
    members = hot.cluster_members(docs)
    texts = member_texts(members)
    assert "Union" not in texts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in texts.groupBy("label").agg(F.count("*"), F.countDistinct("text_id")).collect()) == [(i, 40, 40) for i in range(3)]
