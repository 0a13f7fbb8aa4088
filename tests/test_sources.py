import glob
import json
import os

from pyspark.sql import functions as F

from newsweave.operators import annotations, completion, hot, structured
from newsweave.session import scratch_path
from newsweave.sources import feed, files, news, pages, sinks


def test_csv_starts_with_a_mark_and_reads_back(spark):
    path = scratch_path(spark, "csv")
    rows = spark.createDataFrame([("a", "甲"), ("b", None)], "src STRING, dst STRING")
    files.write_edges_csv(rows.coalesce(1), path)
    local = path.removeprefix("file:")
    with open(glob.glob(f"{local}/part-*.csv")[0], "rb") as handle:
        assert handle.read(3) == b"\xef\xbb\xbf"
    assert sorted(tuple(r) for r in files.read_edges_csv(spark, path).collect()) == [("a", "甲"), ("b", None)]


def test_record_files_of_both_shapes(spark):
    path = scratch_path(spark, "json").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/list.json", "w") as handle:
        json.dump([{"_id": "1", "title": "a"}, {"_id": "2", "title": "b"}], handle, indent=1)
    with open(f"{path}/wrapped.json", "w") as handle:
        json.dump({"RECORDS": [{"_id": "3", "title": "c"}]}, handle, indent=1)
    got = feed.read_records(spark, path, "STRUCT<_id: STRING, title: STRING>")
    assert sorted(tuple(r) for r in got.select("_id", "title").collect()) == [("1", "a"), ("2", "b"), ("3", "c")]


def test_image_files(spark):
    path = scratch_path(spark, "img").removeprefix("file:")
    os.makedirs(path)
    heads = {
        "a.jpg": (b"\xff\xd8\xff\xe0", "image/jpeg"), "b.PNG": (b"\x89PNG\r\n\x1a\n", "image/png"), "c": (b"GIF87a", "image/gif"),
        "d.gif": (b"GIF89a", "image/gif"), "e.webp": (b"RIFF\x00\x00\x00\x00WEBP", "image/webp"), "f.x": (b"BM", "image/bmp"), "g": (b"??", None),
    }
    for name, (head, _) in heads.items():
        with open(f"{path}/{name}", "wb") as handle:
            handle.write(head + b"\0" * 32)
    rows = {r["filename"]: r for r in files.image_inventory(files.read_images(spark, path)).collect()}
    assert {n: r["sniffed"] for n, r in rows.items()} == {n: t for n, (_, t) in heads.items() if t}
    assert rows["c"]["new_name"] == "c.gif" and rows["f.x"]["new_name"] == "f.x.bmp" and rows["b.PNG"]["new_name"] == "b.PNG"
    assert files.image_inventory(files.read_images(spark, path), r"^[ad]\.", 1).count() == 1


def test_files_are_written_one_a_row(spark):
    path = scratch_path(spark, "written")
    rows = [(f"kind=a/{i % 3}/n{i}.txt", b"\x00GIF" * (i + 1)) for i in range(40)] + [("kind=b/x.txt", None)]
    for _ in range(2):  # a task may run again
        assert files.write_files(spark.createDataFrame(rows, "name string, value binary").repartition(5), path) == 41
    local = path.removeprefix("file:")
    assert {p.removeprefix(f"{local}/"): open(p, "rb").read() for p in glob.glob(f"{local}/**/*.txt", recursive=True)} == {n: v or b"" for n, v in rows}
    assert files.read_images(spark, f"{path}/kind=a", "*.txt").count() == 40


def test_feed_posts_skip_other_cards(spark):
    payload = json.dumps(
        {"data": {"cards": [
            {"card_type": 9, "mblog": {"id": "1", "text": "a<br/>b", "pics": [{"url": "s", "large": {"url": "l"}}, {"url": "s2"}, {}]}},
            {"card_type": 9}, {"card_type": 4, "mblog": {"id": "9"}},
            {"card_type": 11, "card_group": [{"card_type": 9, "mblog": {"mid": "2", "text": ""}}, {"card_type": 9, "mblog": {"text": "none"}}]},
        ]}}
    )
    rows = spark.createDataFrame([("kw", payload), ("kw", "{broken"), ("kw", "{}")], "keyword STRING, payload STRING")
    got = {r["note_id"]: r for r in feed.feed_posts(rows, "payload").collect()}
    assert set(got) == {"1", "2"}
    assert got["1"]["content"] == "a\nb" and got["1"]["images"] == ["l", "s2"] and got["2"]["images"] == []


def test_links(spark):
    rows = spark.createDataFrame(
        [("http://www.toutiao.com/a", "long enough"), ("http://www.toutiao.com/a", "long enough"), ("http://www.toutiao.com/video/1", "long enough"),
         ("http://x.com/a", "long enough"), ("http://www.toutiao.com/b", "abc")], "url STRING, text STRING",
    )
    assert [r["url"] for r in pages.followable_links(rows, "url", "text").collect()] == ["http://www.toutiao.com/a"]


def test_comments_and_claims(spark):
    rows = spark.createDataFrame([(1, i, "" if i == 3 else f"<b>c{i}</b>") for i in range(40)], "post INT, turn INT, text STRING")
    got = news.first_comments(rows, "post", "turn", "text").first()["comments"]
    assert len(got) == 19 and got[0] == "c0"
    docs = spark.createDataFrame([(i, "s", "0" if i % 2 else "1") for i in range(30)], "doc_id INT, source STRING, status STRING")
    claimed = spark.createDataFrame([(1,), (3,)], "doc_id INT")
    assert sorted(r["doc_id"] for r in news.claim_batch(docs, claimed, limit=3).collect()) == [5, 7, 9]


def test_answers(spark):
    answers = [
        '<think>{"events": []}</think>{"events"：[{"sub"："甲"，"type":"t",},],"relations":[{"s":"a","o":"b"}],}',
        "no json", '{"K": [{"txt": "x"}, {"txt": "", "ty": ""}]}', '{"events": [}', "[1, 2]",
    ]
    rows = spark.createDataFrame(list(enumerate(answers)), "n INT, raw STRING")
    parsed, rejected = annotations.parse_answers(rows, "raw")
    got = {r["n"]: r for r in parsed.collect()}
    assert set(got) == {0, 2} and {r["n"] for r in rejected.collect()} == {1, 3, 4}
    assert got[0]["events"][0]["subject"] == "甲" and got[0]["relations"][0]["object"] == "b"
    assert [e["text"] for e in got[2]["entities"]] == ["x"] and got[2]["events"] == []
    summary = annotations.clean_summary(F.col("raw"), 5)
    one = spark.createDataFrame([("<think>x</think>摘要：一二三\n四五六",)], "raw STRING")
    assert one.select(summary).first()[0] == "一二三 四"


def test_enrich_hook(spark):
    df = annotations.enrich(spark.range(5), lambda pdf: pdf.assign(double=pdf["id"] * 2), "id LONG, double LONG")
    assert sorted(r["double"] for r in df.collect()) == [0, 2, 4, 6, 8]


def test_flatten_lists_once(spark):
    rows = spark.createDataFrame([(1, json.dumps({"a": {"b": 1}, "l": [1, {"c": "x"}, [2]], "e": {}, "n": []}))], "k INT, j STRING")
    got = {(r["path"], r["value"]) for r in structured.flatten_json(rows, "k", "j").collect()}
    assert got == {("a.b", "1"), ("l.0", "1"), ("l.1.c", "x"), ("l.2", "[2]")}


def test_flatten_has_no_depth_limit(spark):
    deep = "1"
    for _ in range(12):
        deep = json.dumps({"a": json.loads(deep)})
    rows = spark.createDataFrame([(1, deep), (2, "[1, 2]"), (3, None), (4, "{}")], "k INT, j STRING")
    flat = structured.flatten_json(rows, "k", "j")
    assert [tuple(r) for r in flat.collect()] == [(1, ".".join("a" * 12), "1")]
    assert structured.flatten_json(rows.where("k > 9"), "k", "j").count() == 0


def test_upserts_take_the_latest_row(spark):
    stored = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k INT, v STRING, at INT")
    incoming = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "z", 1), (3, "z", 1)], "k INT, v STRING, at INT")
    want = [(1, "x", 2), (2, "b", 0), (3, "z", 1)]
    assert sorted(tuple(r) for r in sinks.upsert_replace(stored, incoming, "k", [F.col("at")]).collect()) == want
    assert sorted(tuple(r) for r in sinks.upsert_set(stored, incoming, "k", [F.col("at")]).drop("change").collect()) == want


def test_titles(spark):
    rows = spark.createDataFrame([("重磅！甲乙",), ("甲乙 签署合作协议。",), ("普通标题",)], "title STRING")
    rows = rows.select(F.lit(1).alias("k"), "title", F.array(F.lit("甲")).alias("terms"), F.array().cast("array<string>").alias("entities"))
    best = hot.best_titles(rows, "k").first()
    assert best["title"] == "甲乙 签署合作协议" and abs(best["score"] - 2.8) < 1e-9
    df = spark.createDataFrame([(None, "某地举行会谈一", "某地举行会谈一", "某地举行会谈二号"), (["k"], "x", "x", "x")], "k ARRAY<STRING>, f STRING, s STRING, l STRING")
    got = [r[0] for r in df.select(hot.fallback_title(F.coalesce("k", F.array().cast("array<string>")), F.col("f"), F.col("s"), F.col("l"))).collect()]
    assert got == ["某地举行会谈", "k"]


def test_training_loss_falls(spark):
    triples = spark.createDataFrame([(i, i % 3, (i * 5 + 1) % 40) for i in range(40)], "h LONG, r LONG, t LONG")
    entities, relations = spark.range(40), spark.range(3)
    ent, rel, losses = completion.train_translations(triples, entities, relations, dim=8, epochs=6, rate=0.1)
    assert losses[-1] < losses[0] and ent.count() == 40 and rel.count() == 3
