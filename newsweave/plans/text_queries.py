"""Queries over filters, projections, nested data, dates and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.functions import dates, ids, names
from newsweave.functions import text as tx
from newsweave.operators import annotations, edges, structured, targets
from newsweave.plans.nested import FLAT, nested_docs
from newsweave.plans.registry import query
from newsweave.plans.views import table, view

AS_OF = "2024-02-10"


def as_of():
    return F.lit(AS_OF).cast("date")


@query(
    "content_or_title",
    covers="P1",
    views=("v_news",),
    oracle="""
    SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND trim(content) <> '' THEN trim(content)
                        WHEN doc_id % 5 <> 0 AND trim(title) <> '' THEN trim(title) END AS text,
           CASE WHEN (doc_id % 3 = 0 OR trim(content) = '') AND (doc_id % 5 = 0 OR trim(title) = '') THEN '内容为空' END AS reason
    FROM v_news""",
)
def content_or_title(spark, sf_dir):
    rows = spark.sql(
        """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE content END AS content,
                  CASE WHEN doc_id % 5 = 0 THEN CAST(NULL AS STRING) ELSE title END AS title FROM {news}""",
        news=view(spark, sf_dir, "v_news"),
    )
    accepted, rejected = structured.split_by_text(rows, "content", "title")
    both = accepted.unionByName(rejected, allowMissingColumns=True)
    return both.select("doc_id", "text", "reason")


@query(
    "keyword_search",
    covers="P2",
    views=("v_news",),
    oracle="""
    SELECT doc_id FROM v_news
    WHERE contains(lower(content), 'tion') AND contains(lower(content), 'tion')
       OR contains(lower(title), 'tion') OR contains(lower(keyword), 'tion') OR contains(lower(source), 'tion')
       OR contains(lower(content), 'src1') OR contains(lower(title), 'src1') OR contains(lower(keyword), 'src1')
       OR contains(lower(source), 'src1')""",
)
def keyword_search(spark, sf_dir):
    columns = [F.col(c) for c in ("content", "title", "keyword", "source")]
    hit = tx.contains_any_keyword("TION, src1", columns)
    return view(spark, sf_dir, "v_news").where(hit).select("doc_id")


@query(
    "timed_events",
    covers="P3",
    views=("v_struct",),
    oracle=f"""
    SELECT doc, eid FROM ({FLAT.format('v_struct')}) WHERE moment <> ''""",
)
def timed_events(spark, sf_dir):
    docs = structured.keep_timed_events(nested_docs(spark, sf_dir))
    return docs.select("doc", F.explode("events.event_id").alias("eid"))


@query(
    "pruned_events",
    covers="P4",
    views=("v_struct",),
    oracle=f"""
    SELECT eid, event_name, nullif(moment, '') AS moment, nullif(place_name, '') AS place, nullif(region, '') AS region,
           nullif(person, '') AS person, nullif(attr_event_type, '') AS attr, emotion,
           moment <> '' AS has_time, place_name <> '' OR region <> '' AS has_place,
           CAST((attr_event_type <> '')::INT + (region <> '')::INT AS BIGINT) AS attributes
    FROM ({FLAT.format('v_struct')})""",
)
def pruned_events(spark, sf_dir):
    pruned = nested_docs(spark, sf_dir).select(F.explode(F.transform("events", structured.prune_event)).alias("e"))
    return pruned.select(
        F.col("e.event_id").alias("eid"),
        F.col("e.event_name").alias("event_name"),
        F.col("e.time_position.moment").alias("moment"),
        F.col("e.space_position.place_name").alias("place"),
        F.col("e.space_position.region").alias("region"),
        F.col("e.relationship_characteristics.subject_person.name").alias("person"),
        F.try_element_at("e.attribute_characteristics", F.lit("event_type")).alias("attr"),
        F.map_keys("e.emotion_characteristics")[0].alias("emotion"),
        F.col("e.time_position").isNotNull().alias("has_time"),
        F.col("e.space_position").isNotNull().alias("has_place"),
        F.coalesce(F.size("e.attribute_characteristics"), F.lit(0)).cast("long").alias("attributes"),
    )


_ALLOWED = "('event-link-parallel', 'event-causal-result', 'event-combination-stage', 'event-evolution-leadsTo')"
_TARGETS = "('event-target-person-subjectPerson', 'event-target-organization-subjectOrganization')"
_KIND = f"""
    CASE WHEN src = dst THEN 'removed'
         WHEN dst LIKE 'Th%' AND relation IN {_ALLOWED} THEN 'event-event'
         WHEN dst NOT LIKE 'Th%' AND relation IN {_TARGETS} THEN 'event-target' ELSE 'removed' END"""


@query(
    "relation_whitelist",
    covers="P5 A23",
    views=("v_edges",),
    oracle=f"SELECT kind, relation, count(*) AS n_edges FROM (SELECT relation, {_KIND} AS kind FROM v_edges) GROUP BY ALL",
)
def relation_whitelist(spark, sf_dir):
    classified = edges.classify_edges(view(spark, sf_dir, "v_rel"), "rel")
    return classified.groupBy("kind", "relation").agg(F.count("*").alias("n_edges"))


@query(
    "relation_validity",
    covers="P6",
    views=("v_edges",),
    oracle="""
    SELECT pos, CASE WHEN pos % 50 = 1 THEN NULL ELSE src END AS src, CASE WHEN pos % 50 = 1 THEN NULL ELSE dst END AS dst,
           CASE WHEN pos % 50 = 1 THEN 'parts' WHEN src = dst THEN 'self' END AS reason FROM v_edges""",
)
def relation_validity(spark, sf_dir):
    rows = spark.sql(
        "SELECT pos, CASE WHEN pos % 50 = 1 THEN rel || ' extra' ELSE '  ' || rel || ' ' END AS rel FROM {r}",
        r=view(spark, sf_dir, "v_rel"),
    )
    return edges.parse_relations(rows, "rel").select("pos", "src", "dst", "reason")


@query(
    "nodes_without_summary",
    covers="P7",
    views=("v_nodes",),
    oracle="SELECT id, source_doc_id FROM v_nodes WHERE trim(coalesce(abstract, '')) = '' AND source_doc_id IS NOT NULL",
)
def nodes_without_summary(spark, sf_dir):
    missing = F.trim(F.coalesce("abstract", F.lit(""))) == ""
    nodes = view(spark, sf_dir, "v_nodes").where(missing & F.col("source_doc_id").isNotNull())
    return nodes.select("id", "source_doc_id")


@query(
    "id_kinds",
    covers="P8",
    views=("v_edges",),
    oracle="""
    SELECT id, upper(id) LIKE 'TH\\_%' ESCAPE '\\' OR upper(id) LIKE 'TH-%' AS loose_event,
           regexp_matches(id, '^Th_(POL|ECON|MIL)') AS strict_event, regexp_matches(id, '^(PORT|ORG|PER|AIR|WAR)-') AS target
    FROM (SELECT src AS id FROM v_edges UNION SELECT dst FROM v_edges UNION
          SELECT lower(src) FROM v_edges UNION SELECT replace(src, 'Th_', 'PER-') FROM v_edges)""",
)
def id_kinds(spark, sf_dir):
    ends = edges.edge_ends(view(spark, sf_dir, "v_edges"))
    src = view(spark, sf_dir, "v_edges").select("src")
    low = src.select(F.lower("src").alias("id"))
    renamed = src.select(F.replace("src", F.lit("Th_"), F.lit("PER-")).alias("id"))
    every = ends.union(low).union(renamed).distinct()
    node = F.col("id")
    return every.select(
        "id",
        ids.looks_like_event(node).alias("loose_event"),
        ids.is_event(node).alias("strict_event"),
        ids.is_target(node).alias("target"),
    )


@query(
    "relation_target_types",
    covers="P9",
    views=("v_edges",),
    oracle="""
    SELECT relation, CASE WHEN relation LIKE '%rganization%' THEN 'organization' WHEN relation LIKE '%erson%' THEN 'character'
      WHEN relation LIKE '%acility%' THEN 'facility' ELSE 'unknow' END AS type, count(*) AS n_edges FROM v_edges GROUP BY ALL""",
)
def relation_target_types(spark, sf_dir):
    typed = view(spark, sf_dir, "v_edges").withColumn("type", ids.target_type(F.col("relation")))
    return typed.groupBy("relation", "type").agg(F.count("*").alias("n_edges"))


@query(
    "reference_times",
    covers="P11 P12",
    views=("v_news",),
    oracle="""
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN strftime(pub_date, '%Y-%m-%d') || ' 06:07:08'
      WHEN 1 THEN strftime(pub_date, '%Y-%m-%d') || ' 01:02:03' WHEN 2 THEN '2023-12-31 00:00:00' ELSE '2024-02-10 00:00:00' END AS ref
    FROM v_news""",
)
def reference_times(spark, sf_dir):
    """Stored time, else a date in the text, else the crawl time, else as_of."""
    rows = spark.sql(
        """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN pub_date || ' 06:07:08' WHEN doc_id % 4 = 3 THEN 'unknown' END AS published,
                  CASE WHEN doc_id % 4 = 1 THEN date_format(pub_date, "'时间：'yyyy年M月d日") || ' 1:02:03 ' || content
                       WHEN doc_id % 4 = 2 THEN '2023年13月41日' ELSE title END AS content,
                  CASE WHEN doc_id % 4 = 2 THEN '2023-12-31' END AS crawled FROM {news}""",
        news=view(spark, sf_dir, "v_news"),
    )
    in_text = F.when(F.col("doc_id") % 4 < 3, dates.date_in_text(F.col("content")))
    ref = dates.first_time([F.col("published"), in_text, F.col("crawled")], as_of())
    return rows.select("doc_id", F.date_format(ref, "yyyy-MM-dd HH:mm:ss").alias("ref"))


@query(
    "dates_in_text",
    covers="P12",
    views=("v_dates",),
    oracle="""
    SELECT n, CASE WHEN n % 8 IN (0, 3, 4) THEN strftime(CASE WHEN n % 8 = 4 THEN date_trunc('month', d) ELSE d END, '%Y-%m-%d') END AS found
    FROM v_dates""",
)
def dates_in_text(spark, sf_dir):
    found = dates.date_in_text(F.concat(F.lit("见报 "), "raw", F.lit(" 记者")))
    return view(spark, sf_dir, "v_dates").select("n", F.date_format(found, "yyyy-MM-dd").alias("found"))


@query(
    "flattened_json",
    covers="P13",
    oracle="""
    SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events
    UNION ALL SELECT event_id, 'meta.type', event_type FROM events
    UNION ALL SELECT event_id, 'meta.user.id', CAST(user_id AS VARCHAR) FROM events
    UNION ALL SELECT event_id, 'tags.0', event_type FROM events
    UNION ALL SELECT event_id, 'tags.1', 'v' FROM events
    UNION ALL SELECT event_id, 'parts.0.n', CAST(event_id AS VARCHAR) FROM events
    UNION ALL SELECT event_id, 'deep' || repeat('.a', event_id % 10), CAST(event_id AS VARCHAR) FROM events""",
)
def flattened_json(spark, sf_dir):
    """Nested objects and lists in long form, up to ten levels deep; empty objects and lists leave no row."""
    rows = spark.sql(
        """SELECT event_id, concat(chr(123), '"deep":', repeat(chr(123) || '"a":', CAST(event_id % 10 AS INT)), event_id,
                  repeat(chr(125), CAST(event_id % 10 AS INT)), ',', substr(to_json(named_struct('k', get_json_object(props, '$.k'), 'meta', named_struct('type', event_type,
                  'user', named_struct('id', user_id)), 'tags', array(event_type, 'v'),
                  'parts', array(named_struct('n', event_id)), 'none', array(), 'empty', named_struct())), 2)) AS doc FROM {e}""",
        e=table(spark, sf_dir, "events"),
    )
    return structured.flatten_json(rows, "event_id", "doc")


@query(
    "event_nodes_flat",
    covers="P14",
    views=("v_struct",),
    oracle=f"""
    SELECT doc, eid AS event_id, event_name, moment AS time_position_moment, place_name AS space_position_place_name,
           nullif(person, '') AS relationship_characteristics_subject_person,
           'ORG ' || event_type AS relationship_characteristics_related_party_organization,
           attr_event_type AS attribute_event_type, CAST(NULL AS VARCHAR) AS attribute_casualty, emotion AS emotion_characteristics, '0' AS status
    FROM ({FLAT.format('v_struct')})""",
)
def event_nodes_flat(spark, sf_dir):
    flat = structured.event_nodes(nested_docs(spark, sf_dir))
    return flat.select(
        "doc", "event_id", "event_name", "time_position_moment", "space_position_place_name",
        "relationship_characteristics_subject_person", "relationship_characteristics_related_party_organization",
        "attribute_event_type", "attribute_casualty", "emotion_characteristics", "status",
    )


@query(
    "unlisted_attributes",
    covers="P14",
    views=("v_struct",),
    oracle=f"""
    SELECT eid AS event_id, attr_event_type AS attribute_event_type, CASE WHEN event_type <> '' THEN 'unit_kind=' || event_type END
             AS others FROM ({FLAT.format('v_struct')})""",
)
def unlisted_attributes(spark, sf_dir):
    """An attribute that no tag lists is kept, an empty one is not."""
    more = F.map_from_entries(F.array(*[F.struct(F.lit(k), v) for k, v in (("unit_kind", F.element_at("e.trigger_word", 1)), ("unit_empty", F.lit("")))]))
    docs = nested_docs(spark, sf_dir).select("doc", F.explode("events").alias("e"))
    docs = docs.withColumn("e", F.col("e").withField("attribute_characteristics", F.map_concat("e.attribute_characteristics", more)))
    flat = structured.event_nodes(docs.select("doc", F.array("e").alias("events")))
    pairs = F.transform(F.map_entries("attribute_other"), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return flat.select("event_id", "attribute_event_type", F.array_join(pairs, ",").alias("others"))


@query(
    "target_nodes_flat",
    covers="P15",
    views=("v_kb",),
    oracle="""
    SELECT target_id, CASE WHEN target_id LIKE 'PER-%' THEN name ELSE 'row ' || target_id END AS name, alias, kind AS event_second_level,
           CASE kind WHEN '人物目标' THEN '人物' WHEN '组织目标' THEN '组织' ELSE '其他' END AS type
    FROM v_kb""",
)
def target_nodes_flat(spark, sf_dir):
    """Knowledge rows whose data is an object or a list of objects, with name fallback and kind label."""
    rows = spark.sql(
        """SELECT target_id, kind, 'row ' || target_id AS row_name, parse_json(CASE WHEN target_id LIKE 'PER-%'
               THEN to_json(array(named_struct('target_id', target_id, 'name', name, 'alias', alias)))
               ELSE to_json(named_struct('alias', alias)) END) AS data FROM {kb}""",
        kb=view(spark, sf_dir, "v_kb"),
    )
    flat = targets.unnest_records(rows)
    return flat.select(
        "target_id",
        F.coalesce("name", "row_name").alias("name"),
        "alias",
        F.col("kind").alias("event_second_level"),
        targets.kind_label(F.col("kind")).alias("type"),
    )


_D1 = """
    CASE n % 8 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m') || '-00' WHEN 2 THEN strftime(d, '%Y') || '-00-00'
      WHEN 3 THEN strftime(d, '%Y-%m-%d') WHEN 4 THEN strftime(d, '%Y-%m-%d') WHEN 5 THEN strftime(d, '%Y-%m') || '-15'
      WHEN 6 THEN '2024' || strftime(d, '-%m-%d')
      ELSE '2024-02-' || lpad(CAST(least(day(d), 29) AS VARCHAR), 2, '0') END"""


@query(
    "evolution_events",
    covers="P16",
    views=("v_struct", "v_dates"),
    oracle=f"""
    SELECT doc, CASE WHEN moment = '' THEN event_name ELSE day || '-' || event_name END AS id, eid, attr_event_type AS type,
           CASE WHEN moment = '' THEN '' ELSE day END AS date, place_name AS place,
           CASE WHEN person = '' THEN '' ELSE person || '/lead/' || emotion || ';' END || 'ORG ' || event_type || '//' AS roles
    FROM ({FLAT.format('v_struct')}) s JOIN (SELECT n, {_D1} AS day FROM v_dates) x ON s.pos = x.n""",
)
def evolution_events(spark, sf_dir):
    short = nested_docs(spark, sf_dir).select(
        "doc", F.explode(F.transform("events", lambda e: structured.evolution_event(e, as_of()))).alias("e")
    )
    roles = F.transform("e.roles", lambda r: F.concat_ws("/", r["entity"], r["role"], r["emotion"]))
    return short.select(
        "doc", "e.id", F.col("e.event_id").alias("eid"), "e.type", "e.date", "e.place", F.array_join(roles, ";").alias("roles")
    )


@query(
    "node_descriptions",
    covers="P17",
    views=("v_nodes",),
    oracle="""
    SELECT id, id || ' (name: ' || name || CASE WHEN coalesce(abstract, '') <> '' THEN ', abstract: ' || abstract ELSE '' END || ')' AS description
    FROM v_nodes""",
)
def node_descriptions(spark, sf_dir):
    properties = F.create_map(
        F.lit("vid"), "id", F.lit("name"), "name", F.lit("abstract"), F.coalesce("abstract", F.lit(""))
    )
    described = structured.describe_node(F.col("id"), properties)
    return view(spark, sf_dir, "v_nodes").select("id", described.alias("description"))


@query(
    "events_with_attributes",
    covers="P19",
    views=("v_struct",),
    oracle=f"""
    SELECT eid FROM ({FLAT.format('v_struct')}) WHERE attr_event_type <> '' OR region <> ''""",
)
def events_with_attributes(spark, sf_dir):
    pruned = nested_docs(spark, sf_dir).withColumn("events", F.transform("events", structured.prune_event))
    return structured.drop_bare_events(pruned).select(F.explode("events.event_id").alias("eid"))


@query(
    "parsed_answers",
    covers="P20",
    oracle="""
    SELECT conv_id, turn, 'parsed' AS outcome, role AS subject, text AS result, CAST(1 AS BIGINT) AS events,
           CASE WHEN turn % 2 = 0 THEN 'e' || CAST(turn AS VARCHAR) END AS entity, CAST(NULL AS BIGINT) AS retries
    FROM conversations WHERE role <> 'system'
    UNION ALL SELECT conv_id, turn, 'rejected', NULL, NULL, NULL, NULL, 2 FROM conversations WHERE role = 'system'""",
)
def parsed_answers(spark, sf_dir):
    """Raw model answers around every conversation turn, with the usual slips; broken ones are kept as rejects."""
    raw = spark.sql(
        """SELECT conv_id, turn, 1 AS tried, CASE WHEN role = 'system' THEN 'no json here: ' || text || ' ' || chr(123)
             WHEN turn % 2 = 0 THEN '<think>' || chr(123) || ' maybe ' || chr(125) || '</think> Answer: ' || chr(123) || '"E"：[' || to_json(named_struct('s', role, 'r', text)) ||
                  '，' || chr(123) || '"s":"","r":""' || chr(125) || ',], "entities": [' || chr(123) || '"txt": "e' || turn || '", "ty": ""' || chr(125) || '],' || chr(125) || '  done'
             ELSE chr(123) || '"events": [' || to_json(named_struct('sub', role, 'res', text)) || '], "relations": []' || chr(125) END AS answer
           FROM {c}""",
        c=table(spark, sf_dir, "conversations"),
    )
    parsed, rejected = annotations.parse_answers(raw, "answer", "tried")
    good = parsed.select(
        "conv_id",
        "turn",
        F.lit("parsed").alias("outcome"),
        F.get("events", F.lit(0))["subject"].alias("subject"),
        F.get("events", F.lit(0))["result"].alias("result"),
        F.size("events").cast("long").alias("events"),
        F.get("entities", F.lit(0))["text"].alias("entity"),
    )
    bad = rejected.select("conv_id", "turn", F.lit("rejected").alias("outcome"), F.col("retries").cast("long").alias("retries"))
    return good.unionByName(bad, allowMissingColumns=True)


@query(
    "embedding_texts",
    covers="P23",
    views=("v_news",),
    oracle=r"""
    SELECT doc_id, trim(trim(regexp_replace(title, '\s+', ' ', 'g')) || '。' ||
           trim(regexp_replace(regexp_replace(content, 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g'))) AS text FROM v_news""",
)
def embedding_texts(spark, sf_dir):
    tagged = F.concat(F.lit("<p class='x'>"), "content", F.lit("</p>"))
    return view(spark, sf_dir, "v_news").select("doc_id", tx.embedding_text(F.col("title"), tagged).alias("text"))


@query(
    "standard_dates",
    covers="D1",
    views=("v_dates",),
    oracle=f"""
    SELECT n, {_D1} AS day, CASE WHEN n % 8 = 2 THEN 'year' WHEN n % 8 = 1 THEN 'month' ELSE 'day' END AS precision FROM v_dates""",
)
def standard_dates(spark, sf_dir):
    return view(spark, sf_dir, "v_dates").select("n", dates.read_date(F.col("raw"), as_of()).alias("d")).select("n", "d.*")


@query(
    "fallback_dates",
    covers="D1",
    views=("v_dates",),
    oracle="SELECT n, strftime(d, '%Y') || '-01-01' AS day, 'year' AS precision FROM v_dates",
)
def fallback_dates(spark, sf_dir):
    """Quarters, half-years and ranges of days only: the year is known, and the precision says so."""
    rows = spark.sql(
        """SELECT n, year(d) || CASE n % 3 WHEN 0 THEN '年第三季度' WHEN 1 THEN '年上半年' ELSE '年5月3日至5日' END AS raw FROM {d}""",
        d=view(spark, sf_dir, "v_dates"),
    )
    return rows.select("n", dates.read_date(F.col("raw"), as_of()).alias("d")).select("n", "d.*")


@query(
    "event_time_update",
    covers="D2 A23",
    views=("v_dates",),
    oracle=f"""
    SELECT n, raw AS time_position_moment_raw,
           CASE WHEN n % 40 = 0 THEN '2024-02-10' WHEN n % 8 = 1 THEN strftime(d, '%Y-%m') || '-01'
                WHEN n % 8 = 2 THEN strftime(d, '%Y') || '-01-01' ELSE {_D1} END AS time_position_moment,
           CASE WHEN n % 40 = 0 THEN 'bad' ELSE 'ok' END AS outcome
    FROM (SELECT n, d, CASE WHEN n % 40 = 0 THEN '第' || CAST(n AS VARCHAR) || '次' ELSE raw END AS raw FROM v_dates)""",
)
def event_time_update(spark, sf_dir):
    """Period moved into the moment, both readings of the rules tried, unreadable times set to as_of."""
    from newsweave.operators.event_times import update_event_times

    rows = spark.sql(
        """SELECT n, CASE WHEN n % 3 = 0 THEN CAST(NULL AS STRING) ELSE t END AS time_position_moment,
                  CASE WHEN n % 3 = 0 THEN t END AS time_position_period
           FROM (SELECT n, CASE WHEN n % 40 = 0 THEN '第' || n || '次' ELSE raw END AS t FROM {d})""",
        d=view(spark, sf_dir, "v_dates"),
    )
    done = update_event_times(rows, as_of())
    return done.select(
        "n", "time_position_moment_raw", F.col("time_position_moment").cast("string").alias("time_position_moment"), "outcome"
    )


@query(
    "event_time_counts",
    covers="A23 D2",
    views=("v_dates",),
    oracle="""
    SELECT CAST(sum(CASE WHEN n % 40 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN n % 40 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad
    FROM v_dates""",
)
def event_time_counts(spark, sf_dir):
    done = event_time_update(spark, sf_dir)
    return done.agg(
        F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "bad").alias("bad")
    )


@query(
    "moments_with_year",
    covers="D3",
    views=("v_dates",),
    oracle="""
    SELECT n, CASE WHEN n % 8 = 6 THEN '2024年' || raw WHEN n % 24 = 7 THEN '2023年' WHEN n % 24 = 15 THEN '2024年1月' ELSE raw END AS moment
    FROM v_dates""",
)
def moments_with_year(spark, sf_dir):
    text = F.when(F.col("n") % 24 == 7, "去年").when(F.col("n") % 24 == 15, "上月").otherwise(F.col("raw"))
    return view(spark, sf_dir, "v_dates").select("n", dates.fill_moment_year(text, as_of()).alias("moment"))


@query(
    "periods_with_years",
    covers="D4",
    views=("v_dates",),
    oracle="""
    SELECT n, CASE n % 3 WHEN 0 THEN '2024年1月 至 2024年' || m || '月'
                         WHEN 1 THEN '2024年1月1日 到 2024年' || m || '月' || dd || '日' ELSE y || '年' END AS period
    FROM (SELECT n, strftime(d, '%Y') AS y, CAST(month(d) AS VARCHAR) AS m, CAST(day(d) AS VARCHAR) AS dd FROM v_dates)""",
)
def periods_with_years(spark, sf_dir):
    month, day = F.month("d").cast("string"), F.day("d").cast("string")
    text = (
        F.when(F.col("n") % 3 == 0, F.concat(F.lit("2024年1月 至 "), month, F.lit("月")))
        .when(F.col("n") % 3 == 1, F.concat(F.lit("1月1日到"), month, F.lit("月"), day, F.lit("日")))
        .otherwise(F.concat(F.year("d").cast("string"), F.lit("年")))
    )
    return view(spark, sf_dir, "v_dates").select("n", dates.fill_period_year(text, as_of()).alias("period"))


@query(
    "padded_relations",
    covers="D5",
    views=("v_rel",),
    oracle="SELECT pos, rel FROM v_rel",
)
def padded_relations(spark, sf_dir):
    """Leading zeros taken off every event id are put back."""
    bare = F.regexp_replace("rel", r"(Th_[A-Z]+)-0+(\d)", "$1-$2")
    rows = view(spark, sf_dir, "v_rel").select("pos", F.concat(F.lit(" "), bare).alias("rel"))
    return edges.pad_relation_ids(rows, "rel")


@query(
    "event_descriptions",
    covers="D6",
    views=("v_struct",),
    oracle=f"""
    SELECT eid || ': ' || concat_ws('；', event_name, '触发词: ' || event_type, '时间: ' || nullif(moment, ''),
             '地点：' || coalesce(nullif(place_name, ''), nullif(region, '')),
             '涉及人物/组织: ' || concat_ws(', ', nullif(person, ''), 'ORG ' || event_type), '关键动作：' || nullif(region, ''),
             '类型: ' || nullif(attr_event_type, '')) AS description
    FROM ({FLAT.format('v_struct')})""",
)
def event_descriptions(spark, sf_dir):
    docs = nested_docs(spark, sf_dir)
    return docs.select(F.explode(F.transform("events", structured.event_description)).alias("description"))


@query(
    "event_similarity_texts",
    covers="D6 J12",
    views=("v_struct",),
    oracle=f"""
    SELECT eid, concat_ws(' ', event_name, 'subject_person:' || nullif(person, '') || '()',
           'related_party_organization:ORG ' || event_type || '()') AS text
    FROM ({FLAT.format('v_struct')})""",
)
def event_similarity_texts(spark, sf_dir):
    events = nested_docs(spark, sf_dir).select(F.explode("events").alias("e"))
    return events.select(F.col("e.event_id").alias("eid"), structured.similarity_text(F.col("e")).alias("text"))


@query(
    "feed_times",
    covers="D7",
    views=("v_dates",),
    oracle="""
    SELECT n, CASE n % 4 WHEN 0 THEN strftime(d - INTERVAL 1 DAY, '%Y-%m-%d') || ' 16:30:00' WHEN 1 THEN strftime(d, '%Y-%m-%d') || ' 10:20:00'
      WHEN 2 THEN strftime(d, '%Y-%m-%d') || ' 00:00:00' END AS posted FROM v_dates""",
)
def feed_times(spark, sf_dir):
    text = (
        F.when(F.col("n") % 4 == 0, F.date_format("d", "EEE MMM dd '00:30:00 +0800' yyyy"))
        .when(F.col("n") % 4 == 1, F.date_format("d", "yyyy-MM-dd '10:20'"))
        .when(F.col("n") % 4 == 2, F.date_format("d", "yyyy-MM-dd"))
        .otherwise("刚刚")
    )
    posted = F.date_format(dates.feed_time(text), "yyyy-MM-dd HH:mm:ss")
    return view(spark, sf_dir, "v_dates").select("n", posted.alias("posted"))


_RAW_NAME = """
    CASE c_custkey % 9 WHEN 0 THEN '中方' WHEN 1 THEN '抗议者' WHEN 2 THEN '美国总统拜登' WHEN 3 THEN '5中国外交部' WHEN 4 THEN '大使'
      WHEN 5 THEN '法国驻华使馆' WHEN 6 THEN '<think>x</think>台北' WHEN 7 THEN '部分网友' ELSE '张' || c_mktsegment END"""


@query(
    "standard_names",
    covers="J9",
    oracle="""
    SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN '中国' WHEN 1 THEN '' WHEN 2 THEN '乔·拜登' WHEN 3 THEN '中国外交部' WHEN 4 THEN ''
      WHEN 5 THEN '法国驻华使馆' WHEN 6 THEN '台北市' WHEN 7 THEN '' ELSE '张' || c_mktsegment END AS name FROM customer""",
)
def standard_names(spark, sf_dir):
    rows = spark.sql(f"SELECT c_custkey, {_RAW_NAME} AS raw FROM {{c}}", c=table(spark, sf_dir, "customer"))
    return rows.select("c_custkey", names.standard_name(F.col("raw")).alias("name"))


@query(
    "standard_places",
    covers="J10",
    views=("v_place",),
    oracle="""
    SELECT id, CASE WHEN region <> '' THEN place_raw ELSE CASE id % 6 WHEN 0 THEN place_raw WHEN 1 THEN '台北市' WHEN 2 THEN '日本 东京'
      WHEN 4 THEN '美国' ELSE place_raw END END AS place FROM v_place""",
)
def standard_places(spark, sf_dir):
    place = names.standard_place(F.col("place_raw"), F.col("region"))
    return view(spark, sf_dir, "v_place").select("id", place.alias("place"))


@query(
    "place_coordinates",
    covers="J11",
    views=("v_struct",),
    oracle="""
    SELECT s.eid, s.place_name, g.coordinate FROM v_struct s LEFT JOIN (
      SELECT event_type AS place_name, CAST(count(*) AS VARCHAR) || ',' || CAST(min(event_id) AS VARCHAR) AS coordinate FROM events
      GROUP BY event_type) g ON s.place_name = g.place_name""",
)
def place_coordinates(spark, sf_dir):
    """Each distinct place looked up once in a gazetteer, then joined back."""
    from newsweave.operators.event_times import add_coordinates

    gazetteer = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("place_name"))
        .agg(F.concat_ws(",", F.count("*"), F.min("event_id")).alias("coordinate"))
    )
    places = view(spark, sf_dir, "v_struct").select("eid", "place_name")
    return add_coordinates(places, "place_name", gazetteer)
