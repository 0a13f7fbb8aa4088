"""Queries over hot events: clusters given by the embedding labels, keywords, titles, facts, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.fixed_values import ACTION_WORDS, SENSATIONAL_WORDS
from newsweave.functions.text import embedding_text
from newsweave.operators import hot, learning, text_events
from newsweave.plans.registry import query
from newsweave.plans.stat_queries import _TIMES
from newsweave.plans.views import table, view
from newsweave.session import cut


def as_of():
    return F.lit("2024-02-10").cast("date")


_ROLLUP = f"""
    m AS (SELECT label, doc_id, source, title, pub_date FROM v_hot WHERE label >= 0 AND label IN (
            SELECT label FROM v_hot GROUP BY label HAVING count(*) >= 4)),
    times AS ({_TIMES.format(key="label", per_day="SELECT label, pub_date AS day, count(*) AS n FROM m GROUP BY ALL")}),
    roll AS (SELECT label, md5(string_agg(CAST(doc_id AS VARCHAR), '' ORDER BY CAST(doc_id AS VARCHAR))) AS event_id, count(*) AS news_count,
                    CAST(max(pub_date) AS VARCHAR) AS latest, count(DISTINCT source) AS sources,
                    round(CAST(0.6 AS DOUBLE) * ln(1 + count(*)) + CAST(0.3 AS DOUBLE) * exp(-greatest(0, date_diff('day', max(pub_date), DATE '2024-02-10')) / CAST(7.0 AS DOUBLE))
                          + CAST(0.1 AS DOUBLE) * (count(DISTINCT source) / count(*)), 4) AS score FROM m GROUP BY label)"""


def rollup(spark, sf_dir):
    members = hot.cluster_members(view(spark, sf_dir, "v_hot"))
    return members, hot.cluster_rollup(members, as_of())


@query(
    "cluster_rollup",
    covers="A6 A7 A13 A5",
    views=("v_hot",),
    oracle=f"WITH {_ROLLUP} SELECT roll.*, time_type, time_start, time_end FROM roll JOIN times USING (label)",
)
def cluster_rollup(spark, sf_dir):
    return rollup(spark, sf_dir)[1].withColumn("latest", F.col("latest").cast("string"))


def cluster_texts(spark, sf_dir):
    return member_texts(hot.cluster_members(view(spark, sf_dir, "v_hot")))


def member_texts(docs):
    """Body and title of each member, side by side in its row: sums by label over a union of frames with the same partitions go wrong (``united``)."""
    body = F.struct((F.col("doc_id") * 2).alias("text_id"), embedding_text(F.col("title"), F.col("content"), None).alias("text"))
    title = F.struct((F.col("doc_id") * 2 + 1).alias("text_id"), F.col("title").alias("text"))
    return docs.select("label", F.inline(F.array(body, title)))


_KEYWORDS = r"""
    txt AS (SELECT label, doc_id * 2 AS text_id, trim(trim(regexp_replace(title, '\s+', ' ', 'g')) || '。' ||
              trim(regexp_replace(regexp_replace(content, 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g'))) AS text FROM v_hot
            UNION ALL SELECT label, doc_id * 2 + 1, title FROM v_hot WHERE title <> ''),
    uni AS (SELECT label, text_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) BETWEEN 2 AND 8) AS w FROM txt),
    tf AS (SELECT label, text_id, term, count(*) AS tf FROM (
             SELECT label, text_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM uni)
           GROUP BY ALL),
    feat AS (SELECT label, term, count(*) AS df FROM tf GROUP BY ALL),
    sizes AS (SELECT label, count(*) AS n FROM txt GROUP BY label),
    wt AS (SELECT tf.label, text_id, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN feat ON tf.label = feat.label AND tf.term = feat.term
           JOIN sizes ON tf.label = sizes.label),
    norm AS (SELECT label, text_id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY ALL),
    sc AS (SELECT label, term, round(sum(w / norm), 6) AS score FROM wt JOIN norm USING (label, text_id) GROUP BY ALL),
    best AS (SELECT * FROM (SELECT label, regexp_replace(term, '[^\x{4e00}-\x{9fa5}A-Za-z0-9]+', '', 'g') AS keyword, score,
               row_number() OVER (PARTITION BY label ORDER BY score DESC, term) AS rank FROM sc
               WHERE length(regexp_replace(term, '[^\x{4e00}-\x{9fa5}A-Za-z0-9]+', '', 'g')) BETWEEN 2 AND 10) WHERE rank <= 5),
    kw AS (SELECT label, substring(keyword, 1, 8) AS keyword, min(rank) AS rank, arg_min(score, rank) AS score FROM best GROUP BY 1, 2)"""


@query(
    "cluster_keywords",
    covers="A9",
    views=("v_hot",),
    oracle=f"WITH {_KEYWORDS} SELECT label, keyword, rank, round(score, 4) AS score FROM kw",
)
def cluster_keywords(spark, sf_dir):
    return hot.cluster_keywords(cluster_texts(spark, sf_dir)).withColumn("score", F.round("score", 4))


@query(
    "cluster_char_keywords",
    covers="A9",
    views=("v_hot",),
    oracle=rf"""
    WITH txt AS (SELECT label, doc_id AS text_id, lower(regexp_replace(title, '\s\s+', ' ', 'g')) AS text FROM v_hot WHERE title <> ''),
    tf AS (SELECT label, text_id, term, count(*) AS tf FROM (
             SELECT label, text_id, unnest(list_transform(range(1, length(text)), lambda i: substring(text, i, 2))) AS term FROM txt
             UNION ALL SELECT label, text_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3))) FROM txt
             UNION ALL SELECT label, text_id, unnest(list_transform(range(1, length(text) - 2), lambda i: substring(text, i, 4))) FROM txt) GROUP BY ALL),
    {_KEYWORDS[_KEYWORDS.index("feat AS"):]}
    SELECT label, keyword, rank, round(score, 4) AS score FROM kw""",
)
def cluster_char_keywords(spark, sf_dir):
    titles = view(spark, sf_dir, "v_hot").select("label", F.col("doc_id").alias("text_id"), F.col("title").alias("text"))
    return hot.cluster_keywords(titles, characters=True).withColumn("score", F.round("score", 4))


@query(
    "top_hot_events",
    covers="W4 A6 A7 A9 W8",
    views=("v_hot",),
    oracle=f"""
    WITH {_ROLLUP}, {_KEYWORDS},
    lists AS (SELECT label, string_agg(keyword, ' ' ORDER BY rank) AS keywords, list(keyword ORDER BY rank) AS k FROM kw GROUP BY label)
    SELECT event_id, k[1] || '、' || k[2] || '与' || k[3] AS event_title, keywords, news_count, score, time_type, time_start, time_end
    FROM roll JOIN times USING (label) JOIN lists USING (label) ORDER BY score DESC, event_id LIMIT 10""",
)
def top_hot_events(spark, sf_dir):
    """The ranked hot events with keywords and a title; texts are read for the ranked clusters only."""
    members, events = rollup(spark, sf_dir)
    return titled(members, hot.top_events(events))


def titled(members, ranked):
    """Ranked events with the keywords and the title that their members give them."""
    best = cut(ranked)
    chosen = members.join(best.select("label"), "label", "left_semi")
    lists = hot.keyword_lists(hot.cluster_keywords(member_texts(chosen)))
    ends = hot.title_ends(chosen, "label", [F.col("doc_id")])
    named = best.join(lists, "label", "left").join(ends, "label")
    title = hot.fallback_title(F.col("keywords"), F.col("first_title"), F.col("shortest"), F.col("longest"))
    short = hot.short_title(title, F.col("keywords"), 40)
    return named.select(
        "event_id", short.alias("event_title"), F.array_join("keywords", " ").alias("keywords"),
        "news_count", "score", "time_type", "time_start", "time_end",
    )


def news_texts(spark, sf_dir):
    return view(spark, sf_dir, "v_news").select("doc_id", "title", "content", "source", "pub_date")


@query("hot_events_from_texts", covers="M1 M2 M3 A6 W4", views=("v_news",))
def hot_events_from_texts(spark, sf_dir):
    """Ranked events of clusters found in the texts themselves."""
    members, events = text_events.events_of_texts(news_texts(spark, sf_dir), as_of())
    return titled(members, events)


@query(
    "facts_of_text_events",
    covers="M1 M2 M3 A6 W4",
    views=("v_news",),
    oracle=r"""
    SELECT CAST(count_if(regexp_matches(content, '[\p{L}\p{N}]')) AS BIGINT) AS vectors, TRUE AS found_some, TRUE AS sizes_hold, TRUE AS copies_together,
           TRUE AS one_language FROM v_news""",
)
def facts_of_text_events(spark, sf_dir):
    """Clusters are large enough, hold copies of a text together and hardly ever mix languages."""
    news = news_texts(spark, sf_dir)
    labelled = cut(text_events.labelled_texts(news).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"))
    members = hot.cluster_members(labelled)
    sizes = members.groupBy("label").agg(F.count("*").alias("n"))
    speech = members.groupBy("label", "lang").agg(F.count("*").alias("n")).groupBy("label").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    copies = labelled.where(F.col("content").rlike(r"[\p{L}\p{N}]")).groupBy("content").agg(F.countDistinct("label").alias("labels"), F.count("*").alias("n"))
    vectors = learning.projected_vectors(news, "doc_id", "content").agg(F.count("*").alias("vectors"))
    parts = [
        sizes.agg((F.count("*") > 0).alias("found_some"), (F.min("n") >= hot.MIN_CLUSTER_SIZE).alias("sizes_hold")),
        copies.where("n > 1").agg((F.coalesce(F.max("labels"), F.lit(1)) == 1).alias("copies_together")),
        speech.agg((F.sum("most") >= 0.9 * F.sum("all")).alias("one_language")),
    ]
    facts = vectors
    for part in parts:
        facts = facts.unionByName(part, allowMissingColumns=True)
    return facts.agg(*[F.max(c).alias(c) for c in ("vectors", "found_some", "sizes_hold", "copies_together", "one_language")])


@query(
    "news_of_events",
    covers="J7",
    views=("v_hot",),
    oracle=f"""
    WITH {_ROLLUP}, top AS (SELECT label, event_id FROM roll ORDER BY score DESC, event_id LIMIT 10)
    SELECT event_id, h.doc_id, h.title, CAST(h.pub_date AS VARCHAR) AS published FROM v_hot h JOIN top USING (label)""",
)
def news_of_events(spark, sf_dir):
    members, events = rollup(spark, sf_dir)
    news = view(spark, sf_dir, "v_news").select("doc_id", "title", F.col("pub_date").cast("string").alias("published"))
    found = hot.news_of_events(members, hot.top_events(events), news)
    return found.select("event_id", "doc_id", "title", "published")


@query(
    "recent_titles",
    covers="W2",
    views=("v_news",),
    oracle="""
    WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY pub_date DESC, doc_id DESC) AS rn FROM v_news) WHERE rn <= 200),
    few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY pub_date DESC, doc_id DESC) AS rk FROM last WHERE length(title) BETWEEN 6 AND 80) WHERE rk <= 12)
    SELECT keyword, string_agg('- ' || CAST(pub_date AS VARCHAR) || '｜' || source || '｜' || title, chr(10) ORDER BY pub_date, doc_id) AS top_titles FROM few GROUP BY keyword""",
)
def recent_titles(spark, sf_dir):
    return hot.recent_titles(view(spark, sf_dir, "v_news"), "keyword", "pub_date", "doc_id")


_FACT_WORDS = "('tion', 'heit', 'ment', 'the')"
_SENTENCES = r"""
    parts AS (SELECT keyword, doc_id, title, list_transform(list_filter(regexp_split_to_array(content, '[。！？；;\n]+'), lambda x: length(x) BETWEEN 8 AND 120), lambda x: trim(x)) AS p FROM v_news),
    chunk AS (SELECT keyword, doc_id, 0 AS seat, trim(title) AS sentence FROM v_news WHERE trim(title) <> ''
              UNION ALL SELECT keyword, doc_id, generate_subscripts(p, 1), unnest(p) FROM parts),
    scored AS (SELECT *, 2 * (contains(sentence, 'tion')::INT + contains(sentence, 'heit')::INT + contains(sentence, 'ment')::INT + contains(sentence, 'the')::INT)
                      + regexp_matches(sentence, '[0-9]')::INT AS score FROM chunk)"""


def _fact_keywords():
    return F.array(*[F.lit(w) for w in ("tion", "heit", "ment", "the", "tion")])


@query(
    "fact_bank",
    covers="W3",
    views=("v_news",),
    oracle=rf"""
    WITH {_SENTENCES},
    uniq AS (SELECT *, row_number() OVER (PARTITION BY keyword, regexp_replace(sentence, '\s+', '', 'g') ORDER BY score DESC, length(sentence) DESC, doc_id, seat) AS rn FROM scored WHERE score > 0),
    ranked AS (SELECT keyword, score, sentence, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, length(sentence) DESC, doc_id, seat) AS rank FROM uniq WHERE rn = 1)
    SELECT keyword, rank, score, sentence FROM ranked WHERE rank <= 120""",
)
def fact_bank(spark, sf_dir):
    """The facts of every language's news; a sentence repeated in many documents counts once."""
    docs = view(spark, sf_dir, "v_news")
    words = docs.select("keyword").distinct().withColumn("keywords", _fact_keywords())
    return hot.fact_bank(docs, words, "keyword", "doc_id")


@query(
    "extractive_summaries",
    covers="D9 P7",
    views=("v_news",),
    oracle=rf"""
    WITH {_SENTENCES},
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(sentence) DESC, seat) AS rn FROM scored) WHERE rn <= 2)
    SELECT doc_id, substring(string_agg(sentence, '。' ORDER BY seat), 1, 200) AS abstract FROM best WHERE doc_id IN (SELECT doc_id FROM v_news WHERE status = '0') GROUP BY doc_id""",
)
def extractive_summaries(spark, sf_dir):
    """Two best sentences for the documents that have no summary yet."""
    missing = view(spark, sf_dir, "v_news").where(F.col("status") == "0")
    return hot.extractive_summaries(missing, "doc_id", _fact_keywords())


_ACTION = "|".join(ACTION_WORDS)
_LOUD = "|".join(SENSATIONAL_WORDS)
_TITLED = """
    SELECT event_key, doc_id, CASE doc_id % 7 WHEN 0 THEN title || ' 签署' WHEN 1 THEN '重磅' || title WHEN 2 THEN title || ', x' ELSE title END AS title FROM {0}"""


@query(
    "best_titles",
    covers="W7",
    views=("v_titles",),
    oracle=rf"""
    WITH n AS (SELECT event_key, trim(regexp_replace(trim(replace(trim(title), '  ', ' ')), '[，,]\s*', '，', 'g'), '。!！?？~、 ') AS t FROM ({_TITLED.format('v_titles')})),
    s AS (SELECT event_key, t, CASE WHEN regexp_matches(t, '{_LOUD}') THEN CAST(-1000000 AS DOUBLE) ELSE
            CAST(2.0 AS DOUBLE) * (contains(t, 'tion')::INT + contains(t, 'en')::INT) + CASE WHEN contains(t, 'er') THEN CAST(1.2 AS DOUBLE) ELSE 0 END
            + CASE WHEN regexp_matches(t, '{_ACTION}') THEN CAST(0.8 AS DOUBLE) ELSE 0 END - greatest(0, length(t) - 20) END AS score
          FROM n WHERE t <> '' AND length(t) <= 40)
    SELECT event_key, arg_max(t, (score, t)) AS title, round(max(score), 4) AS score FROM s GROUP BY event_key""",
)
def best_titles(spark, sf_dir):
    rows = spark.sql(_TITLED.format("{t}"), t=view(spark, sf_dir, "v_titles"))
    rows = rows.withColumn("terms", F.array(F.lit("tion"), F.lit("en"))).withColumn("entities", F.array(F.lit("er")))
    return hot.best_titles(rows, "event_key").withColumn("score", F.round("score", 4))


@query(
    "short_titles",
    covers="W8",
    views=("v_titles",),
    oracle=r"""
    WITH p AS (SELECT doc_id, trim(title) AS t, list_reverse_sort(list_transform(list_filter(regexp_split_to_array(trim(title), '[，,、:：;；\-—\s]+'), lambda x: x <> ''),
                 lambda x: {'c': contains(x, 'th')::INT + contains(x, 'en')::INT, 'l': -length(x), 'p': x})) AS parts FROM v_titles),
    j AS (SELECT doc_id, t, list_reduce(list_prepend('', list_transform(parts, lambda x: x.p)),
            lambda acc, x: CASE WHEN acc = '' AND length(x) <= 20 THEN x WHEN acc <> '' AND length(acc) + 1 + length(x) <= 20 THEN acc || '、' || x ELSE acc END) AS packed FROM p)
    SELECT doc_id, CASE WHEN length(t) <= 20 THEN t WHEN packed <> '' THEN packed
      ELSE regexp_replace(substring(t, 1, 20), '[，、:：;；\-— ]+$', '') END AS title FROM j""",
)
def short_titles(spark, sf_dir):
    terms = F.array(F.lit("th"), F.lit("en"))
    return view(spark, sf_dir, "v_titles").select("doc_id", hot.short_title(F.col("title"), terms).alias("title"))


@query(
    "title_ends",
    covers="W8",
    views=("v_titles",),
    oracle="""
    SELECT event_key, arg_min(title, doc_id) AS first_title, arg_min(title, (length(title), doc_id)) AS shortest,
           arg_min(title, (-length(title), doc_id)) AS longest FROM v_titles GROUP BY event_key""",
)
def title_ends(spark, sf_dir):
    return hot.title_ends(view(spark, sf_dir, "v_titles"), "event_key", [F.col("doc_id")])


@query(
    "progression_within_dates",
    covers="W9 U5",
    views=("v_ev",),
    oracle="""
    SELECT n, CASE WHEN d <= DATE '2024-01-20' THEN CAST(d AS VARCHAR) || ',' ELSE '' END || 'none' AS kept
    FROM (SELECT n, CAST(ts AS DATE) AS d FROM v_ev)""",
)
def progression_within_dates(spark, sf_dir):
    """Three items per event: dated by the event, without date, and dated outside."""
    rows = spark.sql(
        """SELECT n, array(named_struct('date', date_format(ts, 'yyyy-MM-dd'), 'what', 'x 2024-01-01'),
                           named_struct('date', 'none', 'what', 'no date'), named_struct('date', '2023-12-31', 'what', '')) AS items
           FROM {e}""",
        e=view(spark, sf_dir, "v_ev"),
    )
    allowed = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda d: F.concat(F.lit("2024-01-"), F.lpad(d.cast("string"), 2, "0")))
    kept = hot.progression_within(F.col("items"), allowed)
    return rows.select("n", F.array_join(F.transform(kept, lambda i: i["date"]), ",").alias("kept"))


@query(
    "report_numbers",
    covers="D8 A2 A3 A4 A21 W2",
    views=("v_hot",),
    oracle=r"""
    WITH d AS (SELECT label, pub_date AS day, count(*) AS n FROM v_hot GROUP BY ALL),
    s AS (SELECT label, CAST(sum(n) AS BIGINT) AS news_count, round(sum(n) / count(*), 6) AS daily_avg,
                 CAST(arg_max(day, (n, -date_diff('day', DATE '1970-01-01', day))) AS VARCHAR) AS peak_date, max(n) AS peak_count,
                 CAST(min(day) AS VARCHAR) AS first_date, CAST(max(day) AS VARCHAR) AS last_date,
                 greatest(0, date_diff('day', min(day), DATE '2024-02-10')) AS latency_days FROM d GROUP BY label),
    o AS (SELECT label, count(DISTINCT source) AS sources, round(count(DISTINCT source) / count(*), 6) AS diversity,
                 round(1 - count(DISTINCT t) / count(t), 6) AS dup_title_ratio
          FROM (SELECT label, source, nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), '') AS t FROM v_hot) GROUP BY label),
    r AS (SELECT label, count(*) AS titles FROM (SELECT label, row_number() OVER (PARTITION BY label) AS rn FROM v_hot WHERE length(title) BETWEEN 6 AND 80) WHERE rn <= 12 GROUP BY label)
    SELECT s.*, sources, diversity, dup_title_ratio, titles FROM s JOIN o USING (label) LEFT JOIN r USING (label)""",
)
def report_numbers(spark, sf_dir):
    numbers = hot.report_numbers(view(spark, sf_dir, "v_hot"), "label", as_of())
    lines = F.size(F.split("top_titles", "\n- ")).cast("long")
    return numbers.withColumn("titles", lines).drop("top_titles")


@query(
    "gated_report_sections",
    covers="P21",
    views=("v_hot",),
    oracle="""
    SELECT label, 0 AS key_targets, '' AS evolution, CASE WHEN label % 2 = 0 THEN 7 END AS horizon_days FROM v_hot GROUP BY label""",
)
def gated_report_sections(spark, sf_dir):
    """Key targets and evolution are switched off, the forecast stays."""
    rows = spark.sql(
        """SELECT label, collect_set(source) AS key_targets, named_struct('phases', array('a'), 'explanation', 'why') AS evolution,
                  CASE WHEN label % 2 = 0 THEN named_struct('horizon_days', 7, 'volume_forecast', array(CAST(count(*) AS DOUBLE)),
                    'scenarios', array('s'), 'caveats', '') END AS forecast FROM {h} GROUP BY label""",
        h=view(spark, sf_dir, "v_hot"),
    )
    gated = hot.gate_sections(rows, forecast=False)
    return gated.select(
        "label", F.size("key_targets").alias("key_targets"), F.col("evolution.explanation").alias("evolution"),
        F.col("forecast.horizon_days").alias("horizon_days"),
    )
