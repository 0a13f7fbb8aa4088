"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.fixed_values import BODY_CLASSES
from newsweave.functions.text import strip_html
from newsweave.plans.registry import query
from newsweave.plans.views import table, view
from newsweave.session import scratch_path, spread_work
from newsweave.sources import feed, files, news, pages, sinks


@query(
    "newest_news_per_source",
    covers="S1 U1",
    views=("v_news",),
    oracle="""
    WITH whole AS (
      SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, source, title, CAST(pub_date AS VARCHAR) AS published, CAST(NULL AS VARCHAR) AS url FROM v_news
      UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), 'pages', NULL, '2024-01-15', url FROM pages
      UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), 'talks', text, NULL, NULL FROM conversations)
    SELECT id, source, title, published, url FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY published DESC NULLS LAST, id) AS rn FROM whole) WHERE rn <= 5000""",
)
def newest_news_per_source(spark, sf_dir):
    """Three kinds of source with different columns, tagged and united, then the newest rows of each source."""
    docs = view(spark, sf_dir, "v_news").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), "source", "title", F.col("pub_date").cast("string").alias("published")
    )
    stored = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("id"), F.lit("pages").alias("source"), F.lit("2024-01-15").alias("published"), "url"
    )
    talks = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), F.lit("talks").alias("source"), F.col("text").alias("title")
    )
    united = news.union_sources([docs, stored, talks])
    return news.newest_per_source(united, [F.desc_nulls_last("published"), F.col("id")])


@query(
    "claimed_batch",
    covers="S2",
    views=("v_news",),
    oracle="""
    SELECT doc_id, source, '1' AS status FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM v_news
      WHERE status = '0' AND doc_id NOT IN (SELECT doc_id FROM labels))
    WHERE rn <= 100""",
)
def claimed_batch(spark, sf_dir):
    batch = news.claim_batch(view(spark, sf_dir, "v_news"), table(spark, sf_dir, "labels"))
    return batch.select("doc_id", "source", "status")


@query(
    "feed_posts",
    covers="S3",
    oracle="""
    SELECT doc_id, 'n' || CAST(doc_id AS VARCHAR) AS note_id, trim(text, E' \\t\\n\\r') AS content,
           'http://img/' || lang || '.jpg' AS images FROM documents
    UNION ALL
    SELECT doc_id, 'm' || CAST(doc_id AS VARCHAR), source || chr(10) || lang, '' FROM documents""",
)
def feed_posts(spark, sf_dir):
    """Feed answers built from every document: a direct card, a grouped card, and cards to be ignored."""
    docs = table(spark, sf_dir, "documents")
    captured = spark.sql(
        """
        SELECT doc_id, to_json(named_struct('data', named_struct('cards', array(
          named_struct('card_type', 9, 'mblog', named_struct('id', 'n' || doc_id, 'mid', CAST(NULL AS STRING),
            'text', '<p>' || text || '</p>', 'created_at', '', 'pics',
            array(named_struct('url', 'http://small/x.jpg', 'large', named_struct('url', 'http://img/' || lang || '.jpg')))),
            'card_group', CAST(NULL AS ARRAY<STRUCT<card_type INT, mblog STRUCT<id STRING, mid STRING, text STRING>>>)),
          named_struct('card_type', 11, 'mblog', NULL, 'card_group', array(
            named_struct('card_type', 9, 'mblog', named_struct('id', '', 'mid', 'm' || doc_id,
              'text', source || '<br/>' || lang)),
            named_struct('card_type', 9, 'mblog', named_struct('id', '', 'mid', '', 'text', 'no id')),
            named_struct('card_type', 4, 'mblog', named_struct('id', 'x', 'mid', '', 'text', 'no post'))))
        )))) AS payload FROM {docs}""",
        docs=docs,
    )
    posts = feed.feed_posts(captured, "payload")
    return posts.select("doc_id", "note_id", "content", F.array_join("images", ",").alias("images"))


@query(
    "comments_of_posts",
    covers="S4",
    oracle="""
    SELECT conv_id, count(*) AS comments, string_agg(text, ' | ' ORDER BY turn) AS texts FROM (
      SELECT conv_id, turn, trim(text, E' \\t\\n\\r') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
      FROM conversations) WHERE rn <= 20 AND text <> '' GROUP BY conv_id""",
)
def comments_of_posts(spark, sf_dir):
    found = news.first_comments(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return found.select(
        "conv_id", F.size("comments").cast("long").alias("comments"), F.array_join("comments", " | ").alias("texts")
    )


_PAGE_TEXT = r"""trim(regexp_replace(regexp_replace({0}, '(?i)<br\s*/?>', chr(10), 'g'), '(?s)<.*?>', '', 'g'), E' \t\n\r')"""


@query(
    "page_news",
    covers="S5",
    oracle=rf"""
    SELECT page_id, title, content, '2024-02-01 00:00:00' AS time, '' AS images FROM (
      SELECT page_id, {_PAGE_TEXT.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
             {_PAGE_TEXT.format("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")} AS content FROM pages)
    WHERE content <> ''""",
)
def page_news(spark, sf_dir):
    rows = pages.page_news(table(spark, sf_dir, "pages"), F.to_timestamp(F.lit("2024-02-01")))
    return rows.select(
        "page_id",
        "title",
        "content",
        F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.array_join("images", ",").alias("images"),
    )


@query(
    "page_news_dated",
    covers="S5",
    oracle="""
    SELECT doc_id, '标题 ' || source AS title, '正文 ' || lang AS content,
           CASE doc_id % 3 WHEN 0 THEN '2024-03-05 08:09:10' WHEN 1 THEN '2024-03-06 00:00:00'
                           ELSE '2024-02-01 00:00:00' END AS time,
           'http://x/' || source || '.png' AS images FROM documents""",
)
def page_news_dated(spark, sf_dir):
    """The same job on pages with known bodies, stamps and pictures, one per document."""
    built = spark.sql(
        f"""
        SELECT doc_id, '<html><h1 class="t"> 标题 ' || source || '</h1><div class="info">' ||
          CASE doc_id % 3 WHEN 0 THEN '2024-03-05 08:09:10' WHEN 1 THEN '2024年3月6日' ELSE '' END || '</div>' ||
          '<div class="' || element_at(array({", ".join(repr(c) for c in BODY_CLASSES)}), CAST(1 + doc_id % 3 AS INT)) ||
          '"><b>正文</b> ' || lang || '<img src="data:image/png;base64,AA"><img alt="" src="http://x/' || source ||
          '.png"></div></html>' AS html FROM {{docs}}""",
        docs=table(spark, sf_dir, "documents"),
    )
    rows = pages.page_news(built, F.to_timestamp(F.lit("2024-02-01")))
    return rows.select(
        "doc_id",
        "title",
        "content",
        F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.array_join("images", ",").alias("images"),
    )


@query(
    "csv_edges",
    covers="S6",
    views=("v_edges",),
    oracle="""
    SELECT src, relation, dst, CAST(NULL AS VARCHAR) AS type FROM v_edges
    UNION ALL
    SELECT src, relation, dst, 'copy' FROM v_edges WHERE relation LIKE 'event-target%'""",
)
def csv_edges(spark, sf_dir):
    """Two edge files with different headers, written with a byte order mark and read back as one."""
    edges = view(spark, sf_dir, "v_edges").select("src", "relation", "dst")
    first, second = scratch_path(spark, "edges"), scratch_path(spark, "edges")
    files.write_edges_csv(edges, first)
    copies = edges.where(F.col("relation").startswith("event-target"))
    files.write_edges_csv(copies.withColumn("type", F.lit("copy")), second)
    return files.read_edges_csv(spark, first, second)


@query(
    "json_records",
    covers="S7",
    views=("v_news",),
    oracle="""
    SELECT CAST(doc_id AS VARCHAR) AS _id, title, content FROM v_news
    UNION ALL
    SELECT 'c' || CAST(doc_id AS VARCHAR), source, keyword FROM v_news""",
)
def json_records(spark, sf_dir):
    """Record texts of both shapes: a list, and an object around a RECORDS list."""
    payloads = spark.sql(
        """
        SELECT CASE WHEN status = '0' THEN to_json(r) ELSE to_json(named_struct('RECORDS', r)) END AS payload
        FROM (SELECT status, array(named_struct('_id', CAST(doc_id AS STRING), 'title', title, 'content', content),
                                   named_struct('_id', 'c' || doc_id, 'title', source, 'content', keyword)) AS r
              FROM {news})""",
        news=view(spark, sf_dir, "v_news"),
    )
    record = "STRUCT<_id: STRING, title: STRING, content: STRING>"
    return payloads.select(F.inline(feed.parse_records(F.col("payload"), record)))


@query(
    "json_export",
    covers="S8",
    oracle="""
    SELECT CAST(event_id AS VARCHAR) AS _id, event_type,
           strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS ts
    FROM events""",
)
def json_export(spark, sf_dir):
    """Rows written as JSON with ids and times as strings, and read back."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), "event_type", "ts")
    path = scratch_path(spark, "json")
    files.json_ready(rows).write.mode("overwrite").json(path)
    return spark.read.schema("_id STRING, event_type STRING, ts STRING").json(path)


#: Changed orders; every fifth key comes twice, and the row of the greater seq is the later one.
_INCOMING = """
    SELECT o_orderkey + 7 AS o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice + 1 END AS o_totalprice,
           o_orderpriority, 1 AS seq FROM {0} WHERE o_orderstatus <> 'F'
    UNION ALL SELECT o_orderkey + 7, o_totalprice - 5, 'changed again', 2 FROM {0} WHERE o_orderstatus <> 'F' AND o_orderkey % 5 = 0"""
_LATEST = f"""
    SELECT o_orderkey, o_totalprice, o_orderpriority FROM ({_INCOMING.format('orders')}) q
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1"""


@query(
    "upsert_fields",
    covers="S9",
    oracle=f"""
    SELECT coalesce(n.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(n.o_totalprice, s.o_totalprice) AS o_totalprice,
           coalesce(n.o_orderpriority, s.o_orderpriority) AS o_orderpriority, s.o_orderstatus AS o_orderstatus,
           CASE WHEN s.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'keep' ELSE 'update' END AS change
    FROM orders s FULL OUTER JOIN ({_LATEST}) n ON s.o_orderkey = n.o_orderkey""",
)
def upsert_fields(spark, sf_dir):
    """Field-level upsert of changed orders; null incoming fields leave the stored value."""
    orders = table(spark, sf_dir, "orders")
    stored = orders.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return sinks.upsert_set(stored, spark.sql(_INCOMING.format("{o}"), o=orders), "o_orderkey", [F.col("seq")]).drop("seq")


@query(
    "upsert_rows",
    covers="S9",
    oracle=f"""
    WITH n AS ({_LATEST})
    SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)
    UNION ALL SELECT o_orderkey, o_totalprice, o_orderpriority FROM n""",
)
def upsert_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    stored = orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    return sinks.upsert_replace(stored, spark.sql(_INCOMING.format("{o}"), o=orders), "o_orderkey", [F.col("seq")]).drop("seq")


@query(
    "upsert_counts",
    covers="S9 A23",
    oracle=f"""
    SELECT CASE WHEN s.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'keep' ELSE 'update' END AS change,
           count(*) AS n_rows
    FROM orders s FULL OUTER JOIN ({_LATEST}) n ON s.o_orderkey = n.o_orderkey GROUP BY 1""",
)
def upsert_counts(spark, sf_dir):
    return upsert_fields(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n_rows"))


@query(
    "new_pages_only",
    covers="S10",
    oracle="""
    SELECT url, min(page_id) AS page_id FROM pages
    WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE 'https://%') GROUP BY url""",
)
def new_pages_only(spark, sf_dir):
    """Pages whose url is not stored yet; the secure ones count as stored."""
    all_pages = table(spark, sf_dir, "pages").select("page_id", "url")
    stored = all_pages.where(F.col("url").startswith("https://"))
    return news.insert_if_absent(stored, all_pages, "url", [F.col("page_id")])


@query(
    "image_inventory",
    covers="S16",
    oracle="""
    SELECT doc_id, sniffed, fix_type, fix_name,
           CASE WHEN fix_name THEN filename || '.' || ext ELSE filename END AS new_name FROM (
      SELECT *, sniffed IS DISTINCT FROM content_type AS fix_type,
             NOT regexp_matches(lower(filename), '\\.(jpg|png|gif|bmp|webp|tiff|ico)$') AS fix_name FROM (
        SELECT doc_id, source || CASE WHEN doc_id % 4 = 0 THEN '.JPG' ELSE '' END AS filename,
               CASE WHEN doc_id % 3 = 0 THEN 'image/png' END AS content_type,
               CASE doc_id % 7 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif'
                 WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/webp' WHEN 5 THEN 'image/bmp'
                 ELSE CASE WHEN doc_id % 3 = 0 THEN 'image/png' END END AS sniffed,
               CASE doc_id % 7 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'gif' WHEN 4 THEN 'webp'
                 WHEN 5 THEN 'bmp' ELSE 'png' END AS ext
        FROM documents) WHERE sniffed IS NOT NULL)""",
)
def image_inventory(spark, sf_dir):
    """Image metadata from leading bytes; every document body follows one of the known headers."""
    images = spark.sql(
        """
        SELECT doc_id, source || CASE WHEN doc_id % 4 = 0 THEN '.JPG' ELSE '' END AS filename,
               CASE WHEN doc_id % 3 = 0 THEN 'image/png' END AS content_type, doc_id AS uploaded,
               concat(unhex(CASE doc_id % 7 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN '474946383761'
                 WHEN 3 THEN '474946383961' WHEN 4 THEN '524946460000000057454250' WHEN 5 THEN '424D' ELSE '00' END),
                 CAST(text AS BINARY)) AS content FROM {docs}""",
        docs=table(spark, sf_dir, "documents"),
    )
    return files.image_inventory(images).select("doc_id", "sniffed", "fix_type", "fix_name", "new_name")


@query(
    "image_files",
    covers="S16",
    oracle="""
    SELECT page_id, octet_length(encode('GIF89a' || replace(html, chr(10), ' ') || chr(10))) AS size, 'image/gif' AS sniffed,
           TRUE AS fix_name FROM pages WHERE page_id % 3 <> 0 AND octet_length(encode('GIF89a' || replace(html, chr(10), ' ') || chr(10))) >= 2000""",
)
def image_files(spark, sf_dir):
    """Files written from the pages, one each, and read again: by name and size, then by their first bytes."""
    path = scratch_path(spark, "images")
    kind = F.when(F.col("page_id") % 3 == 0, "note").otherwise("image")
    name = F.format_string("kind=%s/%d/page_id=%d.txt", kind, F.pmod("page_id", F.lit(100)), "page_id")
    value = F.concat(F.coalesce(F.concat(F.lit("GIF89a"), F.regexp_replace("html", "\n", " ")), F.lit("")), F.lit("\n"))
    pages = spread_work(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    files.write_files(pages.select(name.alias("name"), value.alias("value")), path)
    found = files.read_images(spark, f"{path}/kind=image", "*.txt", after="2000-01-01T00:00:00", min_bytes=2000)
    page = F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long")
    return files.image_inventory(found.withColumn("page_id", page)).select("page_id", "size", "sniffed", "fix_name")


@query(
    "news_backlog",
    covers="A20",
    views=("v_news",),
    oracle="""
    SELECT source, count(*) AS waiting FROM v_news WHERE status = '0' GROUP BY source
    UNION ALL SELECT '*', count(*) FROM v_news WHERE status = '0'""",
)
def news_backlog(spark, sf_dir):
    return news.backlog(view(spark, sf_dir, "v_news"))


@query(
    "rows_per_keyword_cap",
    covers="W6",
    views=("v_news",),
    oracle="""
    SELECT keyword, doc_id FROM (SELECT keyword, doc_id,
      row_number() OVER (PARTITION BY keyword ORDER BY pub_date DESC, doc_id) AS rn FROM v_news) WHERE rn <= 20""",
)
def rows_per_keyword_cap(spark, sf_dir):
    capped = news.cap_per_keyword(view(spark, sf_dir, "v_news"), [F.desc("pub_date"), F.col("doc_id")])
    return capped.select("keyword", "doc_id")


@query(
    "source_document_lookup",
    covers="J6",
    views=("v_news", "v_ev"),
    oracle="""
    SELECT i.doc_id AS doc_id, CASE WHEN n.status = '1' THEN 'done: ' || n.source ELSE n.source END AS found_in, n.title AS title
    FROM (SELECT DISTINCT doc_id FROM v_ev) i JOIN v_news n ON i.doc_id = n.doc_id""",
)
def source_document_lookup(spark, sf_dir):
    """Source document of every event: the processed collection is asked before the full one."""
    docs = view(spark, sf_dir, "v_news")
    done = docs.where(F.col("status") == "1").select(
        "doc_id", F.concat(F.lit("done: "), "source").alias("found_in"), "title"
    )
    full = docs.select("doc_id", F.col("source").alias("found_in"), "title")
    return news.first_source_with(view(spark, sf_dir, "v_ev"), "doc_id", [done, full])


@query(
    "source_labels",
    covers="P10",
    oracle="""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'given' WHEN 1 THEN 'CNN' WHEN 2 THEN '头条'
      ELSE regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') END AS source
    FROM pages""",
)
def source_labels(spark, sf_dir):
    """Stored source, else label by collection, else host of the url."""
    rows = spark.sql(
        """SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN 'given' ELSE '' END AS stored,
                  CASE page_id % 4 WHEN 1 THEN 'source_CNN' WHEN 2 THEN 'toutiao_news' ELSE 'other' END AS collection
           FROM {pages}""",
        pages=table(spark, sf_dir, "pages"),
    )
    label = pages.source_label(F.col("stored"), F.col("collection"), F.col("url"))
    return rows.select("page_id", label.alias("source"))


@query(
    "followable_links",
    covers="P18",
    oracle="""
    SELECT DISTINCT url FROM pages
    WHERE (contains(url, 'example.com') OR contains(url, 'example.org'))
      AND length(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) >= 5
      AND NOT contains(url, '/video/') AND NOT contains(url, 'search?') AND NOT contains(url, 'user/token')""",
)
def followable_links(spark, sf_dir):
    titled = table(spark, sf_dir, "pages").select(
        "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("text")
    )
    return pages.followable_links(titled, "url", "text", ["example.com", "example.org"]).select("url")


@query(
    "page_plain_text",
    covers="P22",
    oracle=rf"""
    SELECT page_id, text, CASE WHEN page_id % 2 = 0 THEN {_PAGE_TEXT.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}
           ELSE substring(split_part(text, chr(10), 1), 1, 50) END AS title
    FROM (SELECT page_id, html, {_PAGE_TEXT.format('html')} AS text FROM pages)""",
)
def page_plain_text(spark, sf_dir):
    """Whole pages as text; the title is the heading where given, else the first line's first 50 characters."""
    from newsweave.functions.text import title_or_first_line

    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        strip_html(F.col("html")).alias("text"),
        F.when(F.col("page_id") % 2 == 0, F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("given"),
    )
    return rows.select("page_id", "text", title_or_first_line(F.col("given"), F.col("text")).alias("title"))
