from pyspark.sql import functions as F

from newsweave.functions import names
from newsweave.functions.text import contains_any_keyword


def one_to_one(spark, rows, fn):
    df = spark.createDataFrame([(k,) for k in rows], "t STRING")
    return {r[0]: r[1] for r in df.select("t", fn(F.col("t"))).collect()}


def test_entity_names(spark):
    expected = {
        "法国总统马某": "马某", "中方": "中国", "抗议者": "", "工人们": "", "部分网友": "", "大使": "", "特使": "", "天使": "",
        "法国驻华使馆": "法国驻华使馆", "某某大使": "某某大使", "台北": "台北市", "5中国外交部": "中国外交部",
        "<think>嗯</think>拜登": "乔·拜登", "ABC": "", "美国国务卿布林肯": "安东尼·布林肯",
    }
    assert one_to_one(spark, expected, names.standard_name) == expected


def test_places(spark):
    rows = [
        ("东京, 日本", "", "东京, 日本"), ("日本国会", "", "日本国会"), ("台北", "", "台北市"), ("台北", "亚洲", "台北"), ("USA", "", "美国"),
        ("巴黎", "", "巴黎"), ("", "", None), ("法国 里昂", "", "法国 里昂"),
    ]
    df = spark.createDataFrame(rows, "place STRING, region STRING, want STRING")
    got = df.select("place", "want", names.standard_place(F.col("place"), F.col("region")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_leader(spark):
    assert one_to_one(spark, {"孙某（主任）": "孙某", "李某(局长)": "李某", "王某": "王某"}, names.leader_name) == {
        "孙某（主任）": "孙某", "李某(局长)": "李某", "王某": "王某",
    }


def test_keywords_are_literal_and_all_count(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), ("NINE",)], "t STRING")
    assert [r[0] for r in df.where(contains_any_keyword("A.B", [F.col("t")])).collect()] == ["a.b"]
    nine = ",".join(f"k{i}" for i in range(8)) + ",nine"
    assert df.where(contains_any_keyword(nine, [F.col("t")])).count() == 1
    assert df.where(contains_any_keyword(" , ", [F.col("t")])).count() == 3
