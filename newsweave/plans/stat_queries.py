"""Queries over group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.fixed_values import STOP_WORDS
from newsweave.operators import hot, merging, numbering, stats, structured  # noqa: F401
from newsweave.plans.nested import FLAT, nested_docs
from newsweave.plans.registry import query
from newsweave.plans.views import table, view

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    "word_cloud",
    covers="A8 P2",
    oracle=f"""
    WITH w AS (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS name FROM documents),
    c AS (SELECT name, count(*) AS raw FROM w WHERE length(name) > 1 AND NOT regexp_matches(name, '^[0-9]+$') AND name NOT IN ({_STOP})
          GROUP BY name ORDER BY raw DESC, name LIMIT 40)
    SELECT name, round(raw / max(raw) OVER (), 4) AS value, raw FROM c""",
)
def word_cloud(spark, sf_dir):
    return hot.word_cloud(table(spark, sf_dir, "documents"), "text")


@query(
    "word_cloud_for_keywords",
    covers="A8 P2",
    oracle=f"""
    WITH w AS (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS name FROM documents
               WHERE contains(lower(text), 'heit') OR contains(lower(lang), 'heit') OR contains(lower(text), 'tionon') OR contains(lower(lang), 'tionon')),
    c AS (SELECT name, count(*) AS raw FROM w WHERE length(name) > 1 AND NOT regexp_matches(name, '^[0-9]+$') AND name NOT IN ({_STOP})
          GROUP BY name ORDER BY raw DESC, name LIMIT 40)
    SELECT name, round(raw / max(raw) OVER (), 4) AS value, raw FROM c""",
)
def word_cloud_for_keywords(spark, sf_dir):
    from newsweave.functions.text import contains_any_keyword

    hit = contains_any_keyword("Heit, TIONON", [F.col("text"), F.col("lang")])
    return hot.word_cloud(table(spark, sf_dir, "documents").where(hit), "text")


def _event_days(spark, sf_dir, keys):
    return stats.daily_counts(table(spark, sf_dir, "events"), keys, F.to_date("ts"))


@query(
    "daily_counts",
    covers="A2",
    oracle="SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL",
)
def daily_counts(spark, sf_dir):
    return _event_days(spark, sf_dir, ["event_type"]).withColumn("day", F.col("day").cast("string"))


@query(
    "daily_summary",
    covers="A2",
    oracle="""
    SELECT user_id, CAST(sum(n) AS BIGINT) AS news_count, round(sum(n) / count(*), 6) AS daily_avg,
           CAST(arg_max(day, (n, -date_diff('day', DATE '1970-01-01', day))) AS VARCHAR) AS peak_date, max(n) AS peak_count,
           CAST(min(day) AS VARCHAR) AS first_date, CAST(max(day) AS VARCHAR) AS last_date
    FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""",
)
def daily_summary(spark, sf_dir):
    return stats.daily_summary(_event_days(spark, sf_dir, ["user_id"]), ["user_id"])


@query(
    "source_diversity",
    covers="A3",
    oracle="""
    SELECT lang, count(DISTINCT s) AS sources, round(count(DISTINCT s) / count(*), 6) AS diversity
    FROM (SELECT lang, CASE WHEN source = 'src3' THEN NULL ELSE source END AS s FROM documents) GROUP BY lang""",
)
def source_diversity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("source", F.when(F.col("source") == "src3", "").otherwise(F.col("source")))
    return stats.source_diversity(docs, ["lang"], "source")


@query(
    "duplicate_title_ratio",
    covers="A4",
    views=("v_news",),
    oracle=r"""
    SELECT keyword, round(1 - count(DISTINCT t) / count(t), 6) AS dup_title_ratio
    FROM (SELECT keyword, nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), '') AS t FROM v_news) GROUP BY keyword""",
)
def duplicate_title_ratio(spark, sf_dir):
    return stats.duplicate_title_ratio(view(spark, sf_dir, "v_news"), ["keyword"], "title")


_TIMES = """
    SELECT {key}, CASE WHEN last - first <= 3 THEN 'point' ELSE 'range' END AS time_type,
           CAST(CASE WHEN last - first <= 3 THEN busiest ELSE first END AS VARCHAR) AS time_start,
           CAST(CASE WHEN last - first <= 3 THEN busiest ELSE last END AS VARCHAR) AS time_end
    FROM (SELECT {key}, date_diff('day', DATE '2020-01-01', min(day)) AS f, min(day) AS first, max(day) AS last,
                 arg_max(day, (n, -date_diff('day', DATE '1970-01-01', day))) AS busiest
          FROM ({per_day}) GROUP BY {key})"""


@query(
    "event_time_choice",
    covers="A5",
    oracle=_TIMES.format(
        key="grp",
        per_day="SELECT event_type || CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 4 * CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS VARCHAR) || '-' || CAST(user_id AS VARCHAR) AS grp, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL",
    ),
)
def event_time_choice(spark, sf_dir):
    """Even users: groups of four days (a point); odd users: the whole month (mostly a range)."""
    rows = spark.sql(
        """SELECT event_type || CAST(CAST(floor(datediff(CAST(ts AS DATE), DATE '2024-01-01') / 4) AS INT) * CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS STRING)
                  || '-' || user_id AS grp, CAST(ts AS DATE) AS day FROM {e}""",
        e=table(spark, sf_dir, "events"),
    )
    return stats.event_times(stats.daily_counts(rows, ["grp"], F.col("day")), ["grp"])


@query(
    "category_counts",
    covers="A10",
    oracle="""
    SELECT CASE WHEN quality = 1 THEN 'good' WHEN toxic = 0 THEN 'plain' ELSE '处理失败' END AS category, count(*) AS n_rows FROM labels GROUP BY 1""",
)
def category_counts(spark, sf_dir):
    label = F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 0, "plain").otherwise("bad label")
    rows = table(spark, sf_dir, "labels").withColumn("category", label)
    return stats.category_counts(rows, "category", ["good", "plain"], "处理失败")


@query(
    "exact_duplicates",
    covers="A11",
    oracle="""
    SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS kept_id, doc_id <> min(doc_id) OVER (PARTITION BY text, lang) AS is_duplicate
    FROM documents""",
)
def exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    marked = merging.exact_duplicates(docs, "doc_id", merging.fingerprint(F.col("text"), F.col("lang")), ["doc_id"])
    return marked.select("doc_id", "kept_id", "is_duplicate")


@query(
    "group_digests",
    covers="A13",
    oracle="""
    SELECT o_custkey, md5(string_agg(CAST(o_orderkey AS VARCHAR), '' ORDER BY CAST(o_orderkey AS VARCHAR))) AS digest FROM orders GROUP BY o_custkey""",
)
def group_digests(spark, sf_dir):
    return stats.group_digest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"


@query(
    "reference_rows",
    covers="A14",
    oracle=f"""
    SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY url) AS position FROM (SELECT DISTINCT {_HOST} AS host, url FROM pages)""",
)
def reference_rows(spark, sf_dir):
    from newsweave.sources.pages import url_host

    rows = table(spark, sf_dir, "pages").select(url_host(F.col("url")).alias("host"), "url")
    return stats.reference_rows(rows.unionByName(rows), "host", "url")


@query(
    "allowed_dates",
    covers="A14 U5",
    oracle="""
    SELECT user_id, string_agg(day, ',' ORDER BY day) AS dates, CAST(sum(CASE WHEN day <= '2024-01-15' THEN 1 ELSE 0 END) AS BIGINT) AS early,
           min(day) >= '2024-01-02' AS within
    FROM (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY user_id""",
)
def allowed_dates(spark, sf_dir):
    """Dates per user, their intersection with the first half of the month, and a subset test."""
    dates = stats.allowed_dates(table(spark, sf_dir, "events"), "user_id", F.col("ts"))
    half = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda d: F.concat(F.lit("2024-01-"), F.lpad(d.cast("string"), 2, "0")))
    later = F.transform(F.sequence(F.lit(2), F.lit(31)), lambda d: F.concat(F.lit("2024-01-"), F.lpad(d.cast("string"), 2, "0")))
    return dates.select(
        "user_id",
        F.array_join("dates", ",").alias("dates"),
        F.size(F.array_intersect("dates", half)).cast("long").alias("early"),
        (F.size(F.array_except("dates", later)) == 0).alias("within"),
    )


@query(
    "best_detections",
    covers="A15",
    oracle="SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL",
)
def best_detections(spark, sf_dir):
    return stats.best_detections(table(spark, sf_dir, "events"), "user_id", "event_type", "value")


@query(
    "image_groups",
    covers="A16",
    oracle="""
    WITH e AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS element FROM events),
    s AS (SELECT user_id, arg_min(event_type, (-n, event_type)) AS category FROM (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL) GROUP BY user_id),
    k AS (SELECT user_id, string_agg(element, ',' ORDER BY element) AS elements FROM (
            SELECT user_id, element, row_number() OVER (PARTITION BY user_id ORDER BY element) AS rn FROM (SELECT DISTINCT user_id, element FROM e))
          WHERE rn <= 10 GROUP BY user_id)
    SELECT user_id, category, elements FROM s JOIN k USING (user_id)""",
)
def image_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("element", F.get_json_object("props", "$.k"))
    groups = stats.image_group(rows, "user_id", "event_type", "element")
    return groups.withColumn("elements", F.array_join("elements", ","))


@query(
    "task_rollup",
    covers="A19",
    oracle="""
    SELECT user_id, arg_max(event_type, ts) AS status, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended_at,
           round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 3) AS duration_sec, count(*) AS line_count FROM events GROUP BY user_id""",
)
def task_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    tasks = stats.task_rollup(lines, "user_id", "ts", "event_type")
    for name in ("started_at", "ended_at"):
        tasks = tasks.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))
    return tasks


@query(
    "task_log_lines",
    covers="A19 S17",
    oracle="""
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_type FROM events""",
)
def task_log_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return stats.task_lines(lines, "user_id", ["ts", "event_id"]).select("user_id", "line_no", "event_type")


@query(
    "detection_latency",
    covers="A21",
    views=("v_hot",),
    oracle="""
    SELECT label, greatest(0, date_diff('day', min(pub_date), DATE '2024-01-20')) AS latency_days FROM v_hot GROUP BY label""",
)
def detection_latency(spark, sf_dir):
    firsts = view(spark, sf_dir, "v_hot").groupBy("label").agg(F.min("pub_date").alias("first"))
    latency = hot.detection_latency(F.lit("2024-01-20").cast("date"), F.col("first"))
    return firsts.select("label", latency.alias("latency_days"))


@query(
    "event_info_counts",
    covers="A22",
    views=("v_struct",),
    oracle=f"""
    SELECT eid, CAST((moment <> '')::INT + (place_name <> '' OR region <> '')::INT + 1 + 1 AS BIGINT) AS info_count FROM ({FLAT.format('v_struct')})""",
)
def event_info_counts(spark, sf_dir):
    events = nested_docs(spark, sf_dir).select(F.explode("events").alias("e"))
    return events.select(F.col("e.event_id").alias("eid"), structured.info_count(F.col("e")).alias("info_count"))


@query(
    "filled_from_merged",
    covers="A22",
    views=("v_struct",),
    oracle="""
    WITH g AS (SELECT pos - pos % 3 AS g, pos, eid, nullif(place_name, '') AS place, nullif(attr_event_type, '') AS attr FROM v_struct)
    SELECT arg_min(eid, pos) AS id,
           coalesce(arg_min(place, (pos <> g, eid)) FILTER (WHERE place IS NOT NULL)) AS place_name,
           coalesce(arg_min(attr, (pos <> g, eid)) FILTER (WHERE attr IS NOT NULL)) AS attr_event_type
    FROM g GROUP BY g""",
)
def filled_from_merged(spark, sf_dir):
    """Three neighbouring events become one; its blanks are filled from the merged ones."""
    events = view(spark, sf_dir, "v_struct").select("pos", F.col("eid").alias("id"), "place_name", "attr_event_type")
    heads = events.select((F.col("pos")).alias("_g"), F.col("id").alias("new_id"))
    members = events.withColumn("_g", F.col("pos") - F.col("pos") % 3).where(F.col("_g") != F.col("pos"))
    mapping = members.join(heads, "_g").select(F.col("id").alias("old_id"), "new_id")
    return merging.fill_from_merged(events.drop("pos"), mapping, ["place_name", "attr_event_type"])
