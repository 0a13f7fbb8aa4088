"""Physical plans: no cross or nested-loop joins, and scans that read what they need."""

import pytest

from newsweave.operators import correction, learning
from newsweave.plans import QUERIES
from newsweave.plans.views import view

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Minutes of work before there is a plan, which then only reads stored tables.
STORED = {"streamed_run"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STORED))
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(QUERIES["word_cloud"](spark, SF))
    assert "ReadSchema: struct<text:string>" in text
    text = plan(QUERIES["best_detections"](spark, SF))
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in text
    text = plan(view(spark, SF, "v_ev").where("event_type = 'error'").select("eid"))
    assert "EqualTo(event_type,error)" in text


def test_top_n_is_trimmed_before_the_shuffle(spark):
    text = plan(QUERIES["newest_news_per_source"](spark, SF))
    assert "WindowGroupLimit" in text and "5000, Partial" in text


def test_classification_counts_words_once(spark):
    """The texts are not opened again by the branches of the two levels."""
    rows = [(i, "good kind words" if i % 2 else "bad rude words", "ab"[i % 2], "xy"[i // 2 % 2]) for i in range(40)]
    train = spark.createDataFrame(rows, "id long, text string, one string, two string").coalesce(1)
    made = learning.classify_two_levels(train, train.select("id", "text"), "text", "one", "two", ["a", "b"], features=64)
    assert made.count() == 40 and made.where("predicted_category IS NULL").count() == 0
    assert "ExistingRDD" in plan(made) and "UDF(text" not in plan(made)


def test_keywords_open_texts_once(spark):
    """Terms of a text are made in one place; three exchanges carry them: by term, by text, and to the sums."""
    text = plan(QUERIES["cluster_keywords"](spark, SF)).split("+- == Initial Plan ==")[-1]
    assert len([line for line in text.splitlines() if "Generate explode" in line]) == 1
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len([line for line in moved if "(label" in line and "term#" in line.split("ENSURE")[0]]) == 2


def test_neighbours_are_chosen_without_a_join_back(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "s", "b"), ("a", None, "c"), ("d", "r", "b")], "h string, r string, t string")
    assert "Join" not in plan(correction._nearby(edges, "h", "t", 2))
    near = {row.h: [tuple(e) for e in row._near_h] for row in correction._nearby(edges, "h", "t", 2).collect()}
    assert near == {"a": [(None, "c"), ("r", "b"), ("s", "b")], "d": [("r", "b")]}
