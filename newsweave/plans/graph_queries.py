"""Queries over the graph build: edges, targets, ids, merging, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.fixed_values import EVENT_TAG_FIELDS, EVENT_TARGET_RELATIONS
from newsweave.functions import ids
from newsweave.operators import edges, graph_export, merging, numbering, structured, targets
from newsweave.plans.nested import FLAT, nested_docs
from newsweave.plans.registry import query
from newsweave.plans.text_queries import _KIND
from newsweave.plans.views import table, view
from newsweave.session import cut, scratch_path
from newsweave.sources import sinks

_TOKENS = r"""
    idx AS (SELECT kind, token, target_id FROM (
      SELECT kind, token, target_id, row_number() OVER (PARTITION BY kind, token ORDER BY target_id, seat) AS rn FROM (
        SELECT kind, target_id, 0 AS seat, name AS token FROM v_kb
        UNION ALL SELECT kind, target_id, 1, unnest(regexp_split_to_array(alias, '[、,，;；|\s]+')) FROM v_kb)
      WHERE token <> '') WHERE rn = 1)"""


@query(
    "name_index",
    covers="J1",
    views=("v_kb",),
    oracle=f"""
    WITH {_TOKENS}
    SELECT CASE kind WHEN '人物目标' THEN 'character' ELSE 'organization' END AS type, token, target_id FROM idx
    UNION ALL SELECT 'unknow', token, min(target_id) FROM idx GROUP BY token""",
)
def name_index(spark, sf_dir):
    return targets.name_index(view(spark, sf_dir, "v_kb"))


# Four mentions per source event: a supplier's short name, its full name (the same target again),
# a customer, and a name nobody knows.
_MENTIONS = """
    SELECT e.n AS pos, e.prefix || '-' || CAST(e.n - e.n % 4 AS STRING) AS src,
           CASE e.n % 4 WHEN 0 THEN 'S' || CAST(s_suppkey AS STRING) WHEN 1 THEN s_name
                        WHEN 2 THEN 'C' || CAST(1 + e.n % 149 AS STRING) ELSE 'nobody' || CAST(e.n AS STRING) END AS dst,
           CASE WHEN e.n % 4 = 2 THEN 'event-target-person-subjectPerson'
                ELSE 'event-target-organization-subjectOrganization' END AS relation,
           CASE WHEN e.n % 4 = 2 THEN 'character' ELSE 'organization' END AS type
    FROM (SELECT 'Th_POL' AS prefix, n FROM {v_ev}) e
    JOIN {supplier} ON s_suppkey = CAST(floor(e.n / 4) AS BIGINT) % 10"""
_MENTIONS_SQL = _MENTIONS.format(v_ev="v_ev", supplier="supplier")
_MAPPED_SQL = f"""
    {_TOKENS}, ment AS ({_MENTIONS_SQL}),
    hit AS (SELECT m.*, i.target_id, row_number() OVER (PARTITION BY m.type, m.src, i.target_id ORDER BY m.pos) AS rn
            FROM ment m JOIN idx i ON m.dst = i.token AND i.kind = CASE m.type WHEN 'character' THEN '人物目标' ELSE '组织目标' END)"""


def mentions(spark, sf_dir):
    return spark.sql(_MENTIONS, v_ev=view(spark, sf_dir, "v_ev"), supplier=table(spark, sf_dir, "supplier"))


def assigned(spark, sf_dir):
    return targets.assign_targets(mentions(spark, sf_dir), targets.name_index(view(spark, sf_dir, "v_kb")))


@query(
    "mapped_targets",
    covers="J2",
    views=("v_ev", "v_kb"),
    oracle=f"""
    WITH {_MAPPED_SQL}
    SELECT m.pos, m.src, m.relation, coalesce(h.target_id, m.dst) AS dst, h.target_id IS NOT NULL AS mapped
    FROM ment m LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h ON m.pos = h.pos""",
)
def mapped_targets(spark, sf_dir):
    """Names mapped to target ids; a target taken by an earlier edge of the same event is not taken twice."""
    mapped, failed = assigned(spark, sf_dir)
    good = mapped.select("pos", "src", "relation", F.col("target_id").alias("dst"), F.lit(True).alias("mapped"))
    return good.unionByName(failed.select("pos", "src", "relation", "dst", F.lit(False).alias("mapped")))


@query(
    "matched_target_names",
    covers="J2",
    views=("v_ev", "v_kb"),
    oracle=f"WITH {_MAPPED_SQL} SELECT target_id, arg_min(dst, pos) AS name FROM hit WHERE rn = 1 GROUP BY target_id",
)
def matched_target_names(spark, sf_dir):
    return targets.matched_targets(assigned(spark, sf_dir)[0])


_LINKS = """
    SELECT target_id AS src, 'organization-organization-superior' AS relation, superior_organization AS raw FROM v_kb
    WHERE kind = '组织目标' AND coalesce(superior_organization, '') <> ''
    UNION ALL
    SELECT target_id, 'person-personOrganization-affiliated', affiliated_organization FROM v_kb
    WHERE kind = '人物目标' AND coalesce(affiliated_organization, '') <> ''"""


@query(
    "target_links",
    covers="J3",
    views=("v_kb",),
    oracle=f"""
    WITH {_TOKENS}, links AS ({_LINKS})
    SELECT DISTINCT l.src, l.relation, i.target_id AS dst, CAST(NULL AS VARCHAR) AS dst_raw FROM links l
    JOIN idx i ON i.kind = '组织目标' AND l.raw = i.token
    UNION ALL SELECT src, relation, NULL, raw FROM links WHERE raw NOT IN (SELECT token FROM idx WHERE kind = '组织目标')
      AND raw <> 'MIDDLE EAST' OR raw = 'MIDDLE EAST'""",
)
def target_links(spark, sf_dir):
    kb = view(spark, sf_dir, "v_kb")
    found, failed = targets.target_links(kb, targets.index_by_kind(kb))
    return found.unionByName(failed, allowMissingColumns=True)


@query(
    "scoped_target_links",
    covers="J4 J3",
    views=("v_ev", "v_kb"),
    oracle=f"""
    WITH {_MAPPED_SQL}, links AS ({_LINKS})
    SELECT DISTINCT l.src, l.relation, i.target_id AS dst FROM links l JOIN idx i ON i.kind = '组织目标' AND l.raw = i.token
    WHERE l.src IN (SELECT target_id FROM hit WHERE rn = 1)""",
)
def scoped_target_links(spark, sf_dir):
    """Links of matched targets only."""
    kb = view(spark, sf_dir, "v_kb")
    scope = targets.matched_targets(assigned(spark, sf_dir)[0])
    return targets.target_links(kb, targets.index_by_kind(kb), scope)[0]


_CLEAN = f"""
    kinds AS (SELECT *, {_KIND} AS kind FROM v_edges),
    ee AS (SELECT src, relation, dst, min(pos) AS pos FROM kinds WHERE kind = 'event-event' GROUP BY ALL),
    et AS (SELECT src, arg_min(relation, pos) AS relation, dst, min(pos) AS pos FROM kinds WHERE kind = 'event-target' GROUP BY src, dst)"""


@query(
    "clean_edges",
    covers="A12 P5",
    views=("v_edges",),
    oracle=f"""
    WITH {_CLEAN}
    SELECT 'event-event' AS kind, src, relation, dst, pos, CAST(NULL AS VARCHAR) AS type FROM ee
    UNION ALL SELECT 'event-target', src, relation, dst, pos,
      CASE WHEN relation LIKE '%person%' THEN 'character' ELSE 'organization' END FROM et""",
)
def clean_edges(spark, sf_dir):
    classified = cut(edges.classify_edges(view(spark, sf_dir, "v_rel"), "rel"))
    events = edges.event_event_edges(classified, "pos").withColumn("kind", F.lit("event-event"))
    to_targets = edges.event_target_edges(classified, "pos").withColumn("kind", F.lit("event-target"))
    return events.unionByName(to_targets, allowMissingColumns=True)


def whole_edge_table(spark, sf_dir):
    kb = view(spark, sf_dir, "v_kb")
    classified = cut(edges.classify_edges(view(spark, sf_dir, "v_rel"), "rel"))
    mapped, _ = assigned(spark, sf_dir)
    to_targets = mapped.select("src", "relation", F.col("target_id").alias("dst"))
    links, _ = targets.target_links(kb, targets.index_by_kind(kb))
    return edges.edge_table(to_targets, edges.event_event_edges(classified, "pos"), links)


_EDGE_TABLE = f"""
    {_MAPPED_SQL}, {_CLEAN}, links AS ({_LINKS}),
    edge AS (SELECT src, relation, target_id AS dst FROM hit WHERE rn = 1
      UNION ALL SELECT src, relation, dst FROM ee
      UNION ALL SELECT DISTINCT l.src, l.relation, i.target_id FROM links l JOIN idx i ON i.kind = '组织目标' AND l.raw = i.token)"""


@query(
    "edge_table",
    covers="S11 U2",
    views=("v_ev", "v_kb", "v_edges"),
    oracle=f"WITH {_EDGE_TABLE} SELECT src, relation, dst FROM edge",
)
def edge_table(spark, sf_dir):
    """The edge table rebuilt from its three parts, written as a whole and read back."""
    path = scratch_path(spark, "edges")
    whole_edge_table(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query(
    "edge_end_ids",
    covers="U3",
    views=("v_edges",),
    oracle="SELECT src AS id FROM v_edges UNION SELECT dst FROM v_edges",
)
def edge_end_ids(spark, sf_dir):
    return edges.edge_ends(view(spark, sf_dir, "v_edges"))


@query(
    "event_nodes_of_edges",
    covers="J5",
    views=("v_edges", "v_struct"),
    oracle=f"""
    SELECT eid AS event_id, doc, event_name, moment AS time_position_moment FROM ({FLAT.format('v_struct')})
    WHERE eid IN (SELECT src FROM v_edges UNION SELECT dst FROM v_edges)""",
)
def event_nodes_of_edges(spark, sf_dir):
    """Nodes for all event ids in edges; a second, later copy of each document must not win."""
    docs = nested_docs(spark, sf_dir)
    copies = docs.unionByName(docs.withColumn("doc", F.col("doc") + 1000000000))
    nodes = structured.event_nodes(copies, ["event_type"])
    found = edges.nodes_of_edges(view(spark, sf_dir, "v_edges"), nodes, [F.col("doc")])
    return found.select("event_id", "doc", "event_name", "time_position_moment")


@query(
    "vertex_table_rows",
    covers="S12",
    views=("v_struct",),
    oracle=f"""
    SELECT CASE WHEN eid LIKE 'Th_ECON%' THEN 'economic_event' WHEN eid LIKE 'Th_MIL%' THEN 'military_event' ELSE 'political_event' END AS tag,
           eid AS vid, event_name, moment AS time_position_moment, attr_event_type AS attribute_event_type,
           CASE WHEN eid LIKE 'Th_ECON%' THEN region ELSE place_name END AS place, '' AS attribute_port
    FROM ({FLAT.format('v_struct')})""",
)
def vertex_table_rows(spark, sf_dir):
    """Vertex tables of the three event tags, each with its own column list, written by tag."""
    nodes = structured.event_nodes(nested_docs(spark, sf_dir))
    tables = edges.vertex_tables(nodes, "event_id")
    path = scratch_path(spark, "vertices")
    for tag in EVENT_TAG_FIELDS:
        tables[tag].write.mode("overwrite").parquet(f"{path}/tag={tag}")
    rows = []
    for tag, fields in EVENT_TAG_FIELDS.items():
        place = next(f for f in fields if f.startswith("space_position"))
        rows.append(
            spark.read.parquet(f"{path}/tag={tag}").select(
                F.lit(tag).alias("tag"), "vid", "event_name", "time_position_moment", "attribute_event_type",
                F.col(place).alias("place"), "attribute_port",
            )
        )
    return rows[0].union(rows[1]).union(rows[2])


@query(
    "target_vertex_rows",
    covers="S12 P15",
    views=("v_kb",),
    oracle="""
    SELECT CASE kind WHEN '人物目标' THEN 'person_target' ELSE 'organization_target' END AS tag, target_id AS vid, name, alias,
           CASE kind WHEN '人物目标' THEN coalesce(affiliated_organization, '') ELSE coalesce(superior_organization, '') END AS linked
    FROM v_kb""",
)
def target_vertex_rows(spark, sf_dir):
    tables = edges.vertex_tables(view(spark, sf_dir, "v_kb"), "target_id")
    people = tables["person_target"].select(
        F.lit("person_target").alias("tag"), "vid", "name", "alias", F.col("affiliated_organization").alias("linked")
    )
    groups = tables["organization_target"].select(
        F.lit("organization_target").alias("tag"), "vid", "name", "alias", F.col("superior_organization").alias("linked")
    )
    return people.unionByName(groups)


@query(
    "edge_tables_by_kind",
    covers="S13",
    views=("v_ev", "v_kb", "v_edges"),
    oracle=f"""
    WITH {_EDGE_TABLE}, flipped AS (
      SELECT CASE WHEN src LIKE 'Th%' AND dst NOT LIKE 'Th%' THEN dst ELSE src END AS src,
             CASE WHEN src LIKE 'Th%' AND dst NOT LIKE 'Th%' THEN src ELSE dst END AS dst, relation FROM edge)
    SELECT CASE WHEN src LIKE 'Th%' THEN 'event_event_rel' WHEN dst LIKE 'Th%' THEN 'event_target_rel' ELSE 'target_target_rel' END AS kind,
           CASE WHEN dst LIKE 'Th%' AND src NOT LIKE 'Th%' THEN dst ELSE src END AS src,
           CASE WHEN dst LIKE 'Th%' AND src NOT LIKE 'Th%' THEN src ELSE dst END AS dst, relation FROM flipped""",
)
def edge_tables_by_kind(spark, sf_dir):
    """The stored edge table by kind, event first; event-target edges arrive reversed and are turned round."""
    whole = edge_table(spark, sf_dir)
    reverse = F.col("src").startswith("Th") & ~F.col("dst").startswith("Th")
    arrived = whole.select(
        F.when(reverse, F.col("dst")).otherwise(F.col("src")).alias("src"),
        F.when(reverse, F.col("src")).otherwise(F.col("dst")).alias("dst"),
        "relation",
    )
    path = scratch_path(spark, "edges")
    sinks.write_tables(edges.oriented_edges(arrived), path, "kind")
    return spark.read.parquet(path).select("kind", "src", "dst", "relation")


@query(
    "relation_sets",
    covers="U4",
    views=("v_edges",),
    oracle=f"""
    SELECT relation, CAST(count(*) AS BIGINT) AS n_edges,
           CAST(34 - CASE WHEN relation IN {_KIND.split("relation IN ")[1].split(" THEN")[0]}
                    OR relation LIKE 'event-target-%' THEN 1 ELSE 0 END AS BIGINT) AS candidates FROM v_edges GROUP BY relation""",
)
def relation_sets(spark, sf_dir):
    """Per relation: how many of all allowed relations remain as candidates without it."""
    from newsweave.fixed_values import EVENT_EVENT_RELATIONS

    allowed = F.array_union(F.lit(EVENT_EVENT_RELATIONS), F.lit(EVENT_TARGET_RELATIONS))
    used = view(spark, sf_dir, "v_edges").groupBy("relation").agg(F.count("*").alias("n_edges"))
    left = F.array_except(allowed, F.array("relation"))
    return used.select("relation", "n_edges", F.size(left).cast("long").alias("candidates"))


@query(
    "max_event_ids",
    covers="A1",
    views=("v_edges",),
    oracle="""
    SELECT regexp_extract(src, '^(Th_(ECON|MIL|POL))-', 1) AS prefix, max(CAST(regexp_extract(src, '-(\\d+)$', 1) AS BIGINT)) AS max_n
    FROM v_edges GROUP BY 1""",
)
def max_event_ids(spark, sf_dir):
    return numbering.max_ids(view(spark, sf_dir, "v_edges"), "src")


@query(
    "renumbered_events",
    covers="W1",
    views=("v_ev",),
    oracle="""
    SELECT eid AS old_id, prefix || '-' || CASE WHEN n2 >= 10000 THEN CAST(n2 AS VARCHAR) ELSE lpad(CAST(n2 AS VARCHAR), 5, '0') END AS new_id
    FROM (SELECT eid, prefix, row_number() OVER (PARTITION BY prefix ORDER BY doc_id, n) + coalesce(u.max_n, 0) AS n2
          FROM v_ev LEFT JOIN (SELECT prefix AS p, max(n) AS max_n FROM v_ev WHERE value > 300 GROUP BY prefix) u ON prefix = p)""",
)
def renumbered_events(spark, sf_dir):
    """New ids continue after those of the stored events (the big ones); repeated ids get one number."""
    events = view(spark, sf_dir, "v_ev")
    used = numbering.max_ids(events.where(F.col("value") > 300), "eid")
    repeated = events.unionByName(events.withColumn("n", F.col("n") + 1000000000))
    return numbering.renumber_events(repeated, used, "eid", ["doc_id", "n"])


@query(
    "merged_relations",
    covers="J8",
    views=("v_ev", "v_edges"),
    oracle="""
    WITH m AS (SELECT a.eid AS old_id, b.eid AS new_id FROM v_ev a JOIN v_ev b ON b.n = a.n - 1 WHERE a.n % 10 = 3),
    s AS (SELECT doc_id, pos, coalesce(a.new_id, src) AS src, coalesce(b.new_id, dst) AS dst, relation FROM v_edges
          LEFT JOIN m a ON src = a.old_id LEFT JOIN m b ON dst = b.old_id)
    SELECT doc_id, src, dst, arg_min(src || '  ' || dst || '  ' || relation, pos) AS rel FROM s WHERE src <> dst GROUP BY doc_id, src, dst""",
)
def merged_relations(spark, sf_dir):
    events = view(spark, sf_dir, "v_ev").select("n", "eid")
    before = events.select((F.col("n") + 1).alias("n"), F.col("eid").alias("new_id"))
    mapping = events.where(F.col("n") % 10 == 3).join(before, "n").select(F.col("eid").alias("old_id"), "new_id")
    merged = merging.substitute_ids(view(spark, sf_dir, "v_rel"), mapping, "doc_id", "pos", "rel")
    return merged.select("doc_id", "src", "dst", "rel")


def described_nodes(spark, sf_dir):
    properties = F.create_map(F.lit("name"), "name", F.lit("abstract"), F.coalesce("abstract", F.lit("")))
    return view(spark, sf_dir, "v_nodes").select(
        "id", structured.describe_node(F.col("id"), properties).alias("description"), "name"
    )


_DESCRIBED = """
    d AS (SELECT id, id || ' (name: ' || name || CASE WHEN coalesce(abstract, '') <> '' THEN ', abstract: ' || abstract ELSE '' END || ')' AS description
          FROM v_nodes),
    t AS (SELECT src AS h, CASE WHEN pos % 7 = 0 THEN 'event_rel' ELSE relation END AS r, dst AS t,
                 coalesce(a.description, src) AS h_desc, coalesce(b.description, dst) AS t_desc
          FROM v_edges LEFT JOIN d a ON a.id = src LEFT JOIN d b ON b.id = dst)"""


def exported(spark, sf_dir):
    raw = view(spark, sf_dir, "v_edges").select(
        F.col("src").alias("h"),
        F.col("dst").alias("t"),
        F.when(F.col("pos") % 7 == 0, F.lit("")).otherwise(F.col("relation")).alias("relation"),
        F.lit("event_rel").alias("type"),
        "pos",
    )
    return graph_export.triples_with_descriptions(raw, described_nodes(spark, sf_dir), ["pos"])


@query(
    "triples_with_descriptions",
    covers="S14",
    views=("v_edges", "v_nodes"),
    oracle=f"WITH {_DESCRIBED} SELECT h, r, t, h_desc, t_desc FROM t",
)
def triples_with_descriptions(spark, sf_dir):
    return exported(spark, sf_dir).select("h", "r", "t", "h_desc", "t_desc")


@query(
    "completion_samples",
    covers="S15",
    views=("v_edges", "v_nodes"),
    oracle=f"""
    WITH {_DESCRIBED}
    SELECT '知识图谱补全任务：根据头实体和关系类型，预测尾实体。' AS instruction,
           '头实体信息: ' || h_desc || chr(10) || '关系类型: ' || r AS input, t_desc AS output FROM t""",
)
def completion_samples(spark, sf_dir):
    return graph_export.completion_samples(exported(spark, sf_dir))


@query(
    "relation_edge_types",
    covers="A18",
    views=("v_edges",),
    oracle="""
    SELECT relation, arg_min(CASE WHEN pos % 3 = 0 THEN 'a' ELSE 'b' END, pos) AS type FROM v_edges GROUP BY relation""",
)
def relation_edge_types(spark, sf_dir):
    typed = view(spark, sf_dir, "v_edges").withColumn("type", F.when(F.col("pos") % 3 == 0, "a").otherwise("b"))
    return graph_export.edge_type_per_relation(typed, "pos")


@query(
    "entity_vocabulary",
    covers="A17",
    views=("v_triples",),
    oracle="""
    SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT h AS value FROM v_triples UNION SELECT t FROM v_triples)""",
)
def entity_vocabulary(spark, sf_dir):
    return numbering.dense_ids(_ends(view(spark, sf_dir, "v_triples")), "value")


def _ends(triples):
    return triples.select(F.explode(F.array("h", "t")).alias("value"))


@query(
    "encoded_triples",
    covers="A17",
    views=("v_triples",),
    oracle="""
    WITH e AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT h AS value FROM v_triples UNION SELECT t FROM v_triples)),
    k AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS id FROM (SELECT DISTINCT r FROM v_triples))
    SELECT a.id AS h_id, k.id AS r_id, b.id AS t_id FROM v_triples v JOIN e a ON v.h = a.value JOIN e b ON v.t = b.value JOIN k ON v.r = k.r""",
)
def encoded_triples(spark, sf_dir):
    triples = view(spark, sf_dir, "v_triples")
    entities = numbering.dense_ids(_ends(triples), "value")
    relations = numbering.dense_ids(triples.select(F.col("r").alias("value")), "value")
    return numbering.encode_triples(triples, entities, relations)


@query(
    "resolved_entities",
    covers="J13",
    views=("v_nodes",),
    oracle="""
    WITH idx AS (SELECT token, arg_min(id, (own, id)) AS id FROM (
        SELECT id AS token, id, 0 AS own FROM v_nodes UNION ALL SELECT name, id, CASE WHEN name = id THEN 0 ELSE 1 END FROM v_nodes) GROUP BY token),
      m AS (SELECT DISTINCT mention FROM (SELECT c_name AS mention FROM customer UNION ALL SELECT s_name FROM supplier
        UNION ALL SELECT event_type || ' by ' || CAST(user_id AS VARCHAR) FROM events
        UNION ALL SELECT 'PER-' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') FROM customer UNION ALL SELECT r_name FROM region))
    SELECT mention, coalesce(i.id, mention) AS id FROM m LEFT JOIN idx i ON i.token = mention""",
)
def resolved_entities(spark, sf_dir):
    """Names and ids resolved in the event index, then in the full node table, else left as they are."""
    nodes = view(spark, sf_dir, "v_nodes")
    mentions_df = spark.sql(
        """SELECT DISTINCT mention FROM (SELECT c_name AS mention FROM {customer} UNION ALL SELECT s_name FROM {supplier}
           UNION ALL SELECT event_name FROM {ev}
           UNION ALL SELECT 'PER-' || lpad(CAST(c_custkey AS STRING), 5, '0') FROM {customer} UNION ALL SELECT r_name FROM {region})""",
        customer=table(spark, sf_dir, "customer"), supplier=table(spark, sf_dir, "supplier"),
        ev=view(spark, sf_dir, "v_ev"), region=table(spark, sf_dir, "region"),
    )
    index = graph_export.entity_index(nodes.where(F.col("source_doc_id").isNotNull()), "id", ["name"])
    full = graph_export.entity_index(nodes, "id", ["name"])
    return graph_export.resolve(mentions_df, "mention", index, full).select("mention", "id")


@query(
    "display_names",
    covers="J13",
    views=("v_nodes",),
    oracle="""
    SELECT id, CASE WHEN length(coalesce(abstract, '')) > length(name) THEN abstract ELSE name END AS name FROM v_nodes""",
)
def display_names(spark, sf_dir):
    return graph_export.display_names(view(spark, sf_dir, "v_nodes"), "id", ["name", "abstract"])


@query(
    "triple_sample",
    covers="W10",
    views=("v_triples",),
    oracle="""
    SELECT coalesce(n.name, h) AS h, r, coalesce(k.name, t) AS t FROM (SELECT * FROM v_triples ORDER BY h, r, t LIMIT 15)
    LEFT JOIN (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer) n ON n.id = h
    LEFT JOIN (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation) k ON k.id = t""",
)
def triple_sample(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    lands = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return graph_export.labelled_sample(view(spark, sf_dir, "v_triples"), people.unionByName(lands), ["h", "r", "t"])
