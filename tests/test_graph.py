import random

from pyspark.sql import functions as F

from newsweave.operators import edges, numbering, targets
from newsweave.operators.ranking import first_per_key, number_rows, top_n_per_key


def serial_assignment(rows, index):
    used, mapped = set(), {}
    for pos, src, kind, dst in sorted(rows):
        for token in dst.split("、"):
            target = index.get((kind, token))
            if target and (kind, src, target) not in used:
                used.add((kind, src, target))
                mapped[pos] = target
                break
    return mapped


def test_assignment_equals_the_serial_rule(spark):
    rng = random.Random(5)
    index = {("organization", f"n{i}"): f"ORG-{i % 7}" for i in range(20)}
    rows = [
        (pos, f"Th_POL-{rng.choice([0, 0, 0, 1, 2])}", "organization", "、".join(f"n{rng.randrange(24)}" for _ in range(rng.randint(1, 5))))
        for pos in range(120)
    ]
    frame = spark.createDataFrame([(p, s, "r", d, k) for p, s, k, d in rows], "pos INT, src STRING, relation STRING, dst STRING, type STRING")
    idx = spark.createDataFrame([(k, t, v) for (k, t), v in index.items()], "type STRING, token STRING, target_id STRING")
    mapped, failed = targets.assign_targets(frame, idx)
    got = {r["pos"]: r["target_id"] for r in mapped.collect()}
    assert got == serial_assignment(rows, index)
    assert {r["pos"] for r in failed.collect()} == {r[0] for r in rows} - set(got)


def test_second_name_for_a_taken_target_fails(spark):
    frame = spark.createDataFrame(
        [(1, "e", "r", "a", "character"), (2, "e", "r", "b", "character"), (3, "e", "r", "b、c", "character")],
        "pos INT, src STRING, relation STRING, dst STRING, type STRING",
    )
    idx = spark.createDataFrame(
        [("character", "a", "PER-1"), ("character", "b", "PER-1"), ("character", "c", "PER-2")], "type STRING, token STRING, target_id STRING"
    )
    mapped, failed = targets.assign_targets(frame, idx)
    assert {r["pos"]: r["target_id"] for r in mapped.collect()} == {1: "PER-1", 3: "PER-2"}
    assert [r["pos"] for r in failed.collect()] == [2]


def test_index_first_writer_and_types(spark):
    kb = spark.createDataFrame(
        [("ORG-2", "组织目标", "甲", "乙、丙"), ("ORG-1", "组织目标", "乙", None), ("AIR-1", "机场目标", "甲", ""), ("PER-1", "人物目标", "", "丁;戊|己 庚")],
        "target_id STRING, kind STRING, name STRING, alias STRING",
    )
    got = {(r["type"], r["token"]): r["target_id"] for r in targets.name_index(kb).collect()}
    assert got[("organization", "乙")] == "ORG-1" and got[("organization", "丙")] == "ORG-2"
    assert got[("facility", "甲")] == "AIR-1" and got[("unknow", "甲")] == "ORG-2"
    assert all(("character", t) in got for t in "丁戊己庚")


def test_target_links_with_leader_and_failures(spark):
    kb = spark.createDataFrame(
        [
            ("ORG-1", "组织目标", "部门", None, "总部，不明", "孙某（主任）", None),
            ("ORG-2", "组织目标", "总部", None, None, None, None),
            ("PER-1", "人物目标", "孙某", None, None, None, "无名处"),
        ],
        "target_id STRING, kind STRING, name STRING, alias STRING, superior_organization STRING, leader STRING, affiliated_organization STRING",
    )
    found, failed = targets.target_links(kb, targets.index_by_kind(kb))
    assert {tuple(r) for r in found.collect()} == {
        ("ORG-1", "organization-organization-superior", "ORG-2"), ("ORG-1", "target-target-position-leader", "PER-1"),
    }
    assert [tuple(r) for r in failed.collect()] == [("PER-1", "person-personOrganization-affiliated", "无名处")]


def test_relations_to_edges(spark):
    rows = [
        "Th_POL-1  Th_POL-2  event-causal-result", "Th_POL-1 Th_POL-2 event-causal-result", "Th_POL-1  Th_POL-2  event-causal",
        "Th_POL-1  孙某  event-target-person-subjectPerson", "Th_POL-1  孙某  event-target-person-relatedPerson", "a b", "x x event-link-link",
        "孙某  Th_POL-1  event-target-person-subjectPerson",
    ]
    frame = spark.createDataFrame(list(enumerate(rows)), "pos INT, rel STRING")
    classified = edges.classify_edges(frame, "rel")
    assert classified.where(F.col("kind") == "removed").count() == 4
    assert edges.event_event_edges(classified, "pos").count() == 1
    assert [r["relation"] for r in edges.event_target_edges(classified, "pos").collect()] == ["event-target-person-subjectPerson"]


def test_target_names_in_edges_are_cleaned(spark):
    frame = spark.createDataFrame([("Th_POL-1", "法国总统马某"), ("Th_POL-1", "网友"), ("Th_POL-1", "Th_POL-2")], "src STRING, dst STRING")
    assert sorted(r["dst"] for r in edges.clean_target_names(frame).collect()) == ["Th_POL-2", "马某"]


def test_numbers_are_gap_free_with_a_hot_key(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v")
    )
    numbered = number_rows(rows, ["k"], ["v"], "n").groupBy("k").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.countDistinct("n").alias("d"))
    assert numbered.where((F.col("c") != F.col("m")) | (F.col("c") != F.col("d"))).count() == 0
    ordered = number_rows(rows, [], ["v"], "n")
    assert ordered.where(F.col("n") != F.col("v") + 1).count() == 0


def test_top_n_beyond_the_pushdown_limit(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7 + 2).alias("k"), "id")
    got = top_n_per_key(rows, ["k"], [F.desc("id")], 2000)
    want = rows.selectExpr("k", "id", "row_number() over (partition by k order by id desc) rn").where("rn <= 2000").drop("rn")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_first_per_key(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 3, "z")], "k STRING, pos INT, v STRING")
    assert {tuple(r) for r in first_per_key(rows, ["k"], [F.col("pos")]).collect()} == {("a", 1, None), ("b", 3, "z")}


def test_renumbering_keeps_one_id_per_old_id(spark):
    rows = spark.createDataFrame(
        [("Th_POL-00009", 1, 0), ("Th_POL-00003", 0, 0), ("Th_POL-00009", 0, 1), ("Th_MIL-00001", 0, 2), ("bad", 0, 3)], "id STRING, doc INT, at INT"
    )
    used = spark.createDataFrame([("Th_POL", 99998)], "prefix STRING, max_n LONG")
    got = {r["old_id"]: r["new_id"] for r in numbering.renumber_events(rows, used, "id", ["doc", "at"]).collect()}
    assert got == {"Th_POL-00003": "Th_POL-99999", "Th_POL-00009": "Th_POL-100000", "Th_MIL-00001": "Th_MIL-00001"}
