"""Views that give the provided tables the shapes the jobs read.

One statement per view serves both engines: Spark runs it over DataFrames, the comparison
statement uses it as a CTE. Placeholders name the inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def _pad(number: str) -> str:
    return (
        f"CASE WHEN length(CAST({number} AS STRING)) >= 5 THEN CAST({number} AS STRING) "
        f"ELSE lpad(CAST({number} AS STRING), 5, '0') END"
    )


VIEWS = {
    "v_news": """
        SELECT doc_id, source, lang AS keyword, text AS content,
               substring(split_part(text, chr(10), 1), 1, 50) AS title,
               DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS pub_date,
               CASE WHEN doc_id % 10 < 3 THEN '1' ELSE '0' END AS status
        FROM {documents}""",
    "v_ev": f"""
        SELECT n, doc_id, ts, event_type, prefix, prefix || '-' || {_pad('n')} AS eid,
               event_type || ' by ' || CAST(doc_id AS STRING) AS event_name, value, props
        FROM (SELECT event_id AS n, user_id AS doc_id, ts, event_type, value, props,
                     CASE WHEN event_type IN ('purchase', 'signup') THEN 'Th_ECON'
                          WHEN event_type = 'error' THEN 'Th_MIL' ELSE 'Th_POL' END AS prefix
              FROM {{events}}) e""",
    "v_dates": """
        SELECT n, eid, CAST(ts AS DATE) AS d,
               CASE n % 8 WHEN 0 THEN y || '年' || m || '月' || dd || '日'
                          WHEN 1 THEN y || '年' || m || '月'
                          WHEN 2 THEN y || '年'
                          WHEN 3 THEN y || '-' || m || '-' || dd
                          WHEN 4 THEN y || '年' || m || '月1日至' || m || '月' || dd || '日'
                          WHEN 5 THEN y || '年' || m || '月中旬'
                          WHEN 6 THEN m || '月' || dd || '日'
                          ELSE dd || '号' END AS raw
        FROM (SELECT n, eid, ts, CAST(year(ts) AS STRING) AS y, CAST(month(ts) AS STRING) AS m,
                     CAST(day(ts) AS STRING) AS dd FROM {v_ev}) q""",
    "v_kb": f"""
        SELECT 'ORG-' || {_pad('s_suppkey')} AS target_id, '组织目标' AS kind, s_name AS name,
               'S' || CAST(s_suppkey AS STRING) || '、' || n_name AS alias,
               n_name AS superior_organization, CAST(NULL AS STRING) AS affiliated_organization
        FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
        UNION ALL
        SELECT 'ORG-9' || lpad(CAST(n_nationkey AS STRING), 4, '0'), '组织目标', n_name, '', r_name, NULL
        FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT 'PER-' || {_pad('c_custkey')}, '人物目标', c_name, 'C' || CAST(c_custkey AS STRING), NULL, n_name
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey""",
    # Relation strings: every event points at the next one, every third also at a target. The next
    # event comes from an equi join on a unique number, so no window over a hot document is needed.
    "v_rel": """
        SELECT a.doc_id, a.n AS pos, a.eid || '  ' || coalesce(b.eid, a.eid) || '  ' ||
               CASE a.n % 5 WHEN 0 THEN 'event-causal-result' WHEN 1 THEN 'event-link-parallel'
                            WHEN 2 THEN 'event-link' WHEN 3 THEN 'event-combination-stage'
                            ELSE 'event-evolution-leadsTo' END AS rel
        FROM {v_ev} a LEFT JOIN {v_ev} b ON b.n = a.n + 1
        UNION ALL
        SELECT doc_id, n + 1000000000, eid || '  ' ||
               CASE WHEN n % 2 = 0 THEN 'C' || CAST(1 + n % 200 AS STRING)
                    ELSE 'S' || CAST(1 + n % 15 AS STRING) END || '  ' ||
               CASE WHEN n % 2 = 0 THEN 'event-target-person-subjectPerson'
                    ELSE 'event-target-organization-subjectOrganization' END
        FROM {v_ev} WHERE n % 3 = 0""",
    "v_edges": """
        SELECT doc_id, pos, split_part(rel, '  ', 1) AS src, split_part(rel, '  ', 3) AS relation,
               split_part(rel, '  ', 2) AS dst
        FROM {v_rel}""",
    "v_nodes": """
        SELECT eid AS id, event_name AS name, CAST(doc_id AS STRING) AS source_doc_id,
               CASE WHEN n % 4 = 0 THEN ' ' ELSE event_type END AS abstract
        FROM {v_ev}
        UNION ALL
        SELECT target_id, name, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {v_kb}""",
    "v_triples": """
        SELECT 'C' || CAST(c_custkey AS STRING) AS h, 'locatedIn' AS r, 'N' || CAST(c_nationkey AS STRING) AS t
        FROM {customer}
        UNION ALL
        SELECT 'S' || CAST(s_suppkey AS STRING), 'locatedIn', 'N' || CAST(s_nationkey AS STRING) FROM {supplier}
        UNION ALL
        SELECT 'N' || CAST(n_nationkey AS STRING), 'partOf', 'R' || CAST(n_regionkey AS STRING) FROM {nation}
        UNION ALL
        SELECT DISTINCT 'C' || CAST(o_custkey AS STRING),
               CASE o_orderstatus WHEN 'O' THEN 'event-link-link' ELSE 'badRelation' END,
               'O' || CAST(o_orderkey % 97 AS STRING)
        FROM {orders}""",
    "v_hot": """
        SELECT label, doc_id, source, title, content, pub_date
        FROM {embeddings} JOIN {v_news} ON vec_id = doc_id""",
    "v_titles": """
        SELECT source AS event_key, doc_id, title FROM {v_news} WHERE length(title) BETWEEN 6 AND 80""",
    "v_place": """
        SELECT n_nationkey AS id,
               CASE n_nationkey % 6 WHEN 0 THEN '日本国会' WHEN 1 THEN '台北' WHEN 2 THEN '日本 东京'
                                    WHEN 3 THEN n_name || ', 法国' WHEN 4 THEN 'USA' ELSE n_name END AS place_raw,
               CASE WHEN n_nationkey % 5 = 0 THEN r_name ELSE '' END AS region
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "v_struct": """
        SELECT e.doc_id, e.n AS pos, e.eid, e.event_name, x.raw AS moment, e.event_type,
               CASE WHEN e.n % 6 = 0 THEN '' ELSE e.event_type END AS place_name,
               'C' || CAST(1 + e.doc_id AS STRING) AS subject_person,
               CASE WHEN e.n % 7 = 0 THEN '' ELSE e.event_type END AS attr_event_type,
               CASE WHEN e.value > 100 THEN 'positive' ELSE 'neutral' END AS emotion
        FROM {v_ev} e JOIN (SELECT n AS dn, raw FROM {v_dates}) x ON e.n = x.dn""",
}


def _inputs(name: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", VIEWS[name])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    inputs = {i: view(spark, sf_dir, i) for i in _inputs(name)}
    return spark.sql(VIEWS[name], **inputs)


def cte(names: tuple[str, ...], body: str) -> str:
    """``WITH`` clause for the views a statement needs, inputs first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for needed in _inputs(name):
            visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body.strip()
    parts = [f"{n} AS ({VIEWS[n].format(**{i: i for i in _inputs(n)}).strip()})" for n in ordered]
    text = body.strip()
    if text[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + text[5:]
    return "WITH " + ",\n".join(parts) + "\n" + text
