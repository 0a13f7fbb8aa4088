"""Hot events: roll-up of clusters, score, keywords, titles, facts and report numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.fixed_values import (
    ACTION_WORDS,
    FACTS_PER_EVENT,
    HOT_DIVERSITY_WEIGHT,
    HOT_EVENTS_KEPT,
    HOT_RECENCY_DAYS,
    HOT_RECENCY_WEIGHT,
    HOT_VOLUME_WEIGHT,
    MIN_CLUSTER_SIZE,
    SENSATIONAL_WORDS,
    STOP_WORDS,
    SUMMARY_CHARS,
    TITLE_LENGTH,
    WORD_CLOUD_TOP,
)
from newsweave.functions.text import SENTENCE_END, clean_term, contains_any, hits, let
from newsweave.llm.exchange import Group
from newsweave.operators import stats
from newsweave.operators.ranking import first_per_key, top_n_per_key
from newsweave.operators.term_weights import ClusterTerms, WeightedTexts
from newsweave.session import spread_work

WORD = r"[\p{L}\p{N}]+"
#: Characters of a keyword, and which bytes are ASCII letters or digits, which cleaning keeps.
LONGEST = 10
PLAIN = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


# -- word cloud ------------------------------------------------------------------------------


def word_cloud(docs: DataFrame, text: str, limit: int | None = None, top: int = WORD_CLOUD_TOP) -> DataFrame:
    """The most frequent words with their share of the top count.

    Stop words and numbers go before the shuffle, so only counted words travel.
    """
    rows = docs.limit(limit) if limit else docs
    words = rows.select(F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("name"))
    valid = (F.length("name") > 1) & ~F.col("name").isin(STOP_WORDS) & ~F.col("name").rlike(r"^\d+$")
    counted = words.where(valid).groupBy("name").agg(F.count("*").alias("raw"))
    best = counted.orderBy(F.desc("raw"), "name").limit(top)
    peak = F.max("raw").over(Window.partitionBy())  # over the few rows left
    return best.select("name", F.round(F.col("raw") / peak, 4).alias("value"), "raw")


# -- clusters --------------------------------------------------------------------------------


def cluster_members(labelled: DataFrame, min_size: int = MIN_CLUSTER_SIZE) -> DataFrame:
    """Rows of real clusters: noise and small clusters are left out."""
    real = labelled.where(F.col("label") >= 0)
    big = real.groupBy("label").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_size).select("label")
    return real.join(big, "label", "left_semi")


def hotness(n: Column, latest: Column, sources: Column, as_of: Column) -> Column:
    age = F.greatest(F.lit(0), F.datediff(as_of, latest))
    volume = F.lit(HOT_VOLUME_WEIGHT) * F.log1p(n)
    recency = F.lit(HOT_RECENCY_WEIGHT) * F.exp(-age / F.lit(float(HOT_RECENCY_DAYS)))
    return F.round(volume + recency + F.lit(HOT_DIVERSITY_WEIGHT) * (sources / n), 4)


def cluster_rollup(members: DataFrame, as_of: Column) -> DataFrame:
    """One row per cluster: stable id, size, latest day, sources, event time and score.

    The member ids themselves stay in ``members``; a cluster may be too big for one array.
    """
    digest = stats.group_digest(members, "label", "doc_id").withColumnRenamed("digest", "event_id")
    per_day = stats.daily_counts(members, ["label"], F.col("pub_date"))
    times = stats.event_times(per_day, ["label"])
    counts = per_day.groupBy("label").agg(F.sum("n").alias("news_count"), F.max("day").alias("latest"))
    sources = stats.source_diversity(members, ["label"], "source").select("label", "sources")
    whole = counts.join(sources, "label").join(times, "label").join(digest, "label")
    score = hotness(F.col("news_count"), F.col("latest"), F.col("sources"), as_of)
    return whole.withColumn("score", score)


def top_events(events: DataFrame, n: int = HOT_EVENTS_KEPT) -> DataFrame:
    return events.orderBy(F.desc("score"), "event_id").limit(n)


def news_of_events(members: DataFrame, events: DataFrame, news: DataFrame) -> DataFrame:
    """The news rows of the given events; readers order them by time."""
    chosen = members.select("label", "doc_id").join(events.select("label", "event_id"), "label")
    return chosen.join(news, "doc_id")


# -- keywords --------------------------------------------------------------------------------


def _words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.length(w).between(2, 8))


def _word_terms(text: Column) -> Column:
    def with_pairs(w: Column) -> Column:
        pairs = F.transform(
            F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)),
        )
        return F.concat(w, pairs)

    return let(_words(text), with_pairs)


def _char_terms(text: Column) -> Column:
    def of_size(t: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(t) - (n - 1))
        found = F.transform(starts, lambda i: F.substring(t, i, F.lit(n)))
        return F.when(F.length(t) >= n, found).otherwise(F.array().cast("array<string>"))

    def grams(t: Column) -> Column:
        return F.concat(*[of_size(t, n) for n in (2, 3, 4)])

    return let(F.lower(F.regexp_replace(text, r"\s\s+", " ")), grams)


def cluster_keywords(
    texts: DataFrame, topk: int = 5, characters: bool = False, max_features: int | None = None, max_len: int = 8
) -> DataFrame:
    """(label, rank, keyword): the terms with the largest summed tf-idf of each cluster.

    ``texts`` has label, text_id and text. ``max_features`` keeps the commonest terms of a cluster
    only. Weights are smoothed idf times count, unit length per
    text. Words and their pairs are counted and weighted in groups of texts; other terms are rows, which
    travel three times: to the texts' number with the term, back to the text for its length, and to the sum.
    The label sizes, one row per cluster, are sent to all tasks: a join by label would put a large cluster into one.
    """
    if not characters and max_features is None:
        return _best_terms(_summed_in_groups(texts), topk, max_len)
    terms = (_char_terms if characters else _word_terms)(F.col("text"))
    used = texts.where(F.coalesce("text", F.lit("")) != "")
    tf = spread_work(used.select("label", "text_id", "text"), "label", "text_id").select("label", "text_id", F.explode(terms).alias("term"))
    tf = tf.groupBy("label", "text_id", "term").agg(F.count("*").alias("tf"))
    if max_features is not None:
        features = tf.groupBy("label", "term").agg(F.sum("tf").alias("total"))
        features = top_n_per_key(features, ["label"], [F.desc("total"), F.col("term")], max_features)
        tf = tf.join(features.select("label", "term"), ["label", "term"], "left_semi")
    sizes = used.groupBy("label").agg(F.count("*").alias("n"))
    counted = tf.withColumn("df", F.count("*").over(Window.partitionBy("label", "term"))).join(F.broadcast(sizes), "label")
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weighted = counted.select("label", "text_id", "term", (F.col("tf") * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("label", "text_id")))
    summed = weighted.withColumn("norm", norm).groupBy("label", "term")
    return _best_terms(summed.agg(F.sum(F.col("w") / F.col("norm")).alias("score")), topk, max_len)


def _best_terms(summed: DataFrame, topk: int, max_len: int) -> DataFrame:
    scored = summed.withColumn("score", F.round("score", 6))
    cleaned = scored.withColumn("keyword", clean_term(F.col("term"))).where(F.length("keyword").between(2, LONGEST))
    best = top_n_per_key(cleaned, ["label"], [F.desc("score"), F.col("term")], topk, rank="rank")
    short = best.select("label", F.substring("keyword", 1, max_len).alias("keyword"), "rank", "score")
    return first_per_key(short, ["label", "keyword"], [F.col("rank")])


def _summed_in_groups(texts: DataFrame) -> DataFrame:
    """(label, term, score): summed weights of words and pairs; a row per group of texts and term leaves Python."""
    used = texts.where(F.coalesce("text", F.lit("")) != "")
    sizes = used.groupBy("label").agg(F.count("*").alias("n"))
    known = used.join(F.broadcast(sizes), "label").withColumnRenamed("text_id", "id")
    weighted = WeightedTexts(known, "text", _words(F.col("text")), ["label", "n"], ClusterTerms)

    def sums(group: Group, terms: ClusterTerms, df: np.ndarray) -> pd.DataFrame:
        n = group.rows["c2"].astype("float64").to_numpy()
        w = terms.tf * (np.log((1 + n[terms.text]) / (1 + df[terms.term])) + 1)
        norm = np.sqrt(np.bincount(terms.text, weights=w * w, minlength=len(n)))
        score = np.bincount(terms.term, weights=w / norm[terms.text], minlength=len(df))
        label = np.empty(len(df), dtype=object)
        label[terms.term] = group.rows["c1"].to_numpy()[terms.text]
        raw, plain = group.bytes.tobytes(), np.append(0, np.cumsum(PLAIN[group.bytes]))
        ends = np.array(terms.spelt, dtype=np.int64).reshape(-1, 2)
        fit = np.flatnonzero(plain[ends[:, 1]] - plain[ends[:, 0]] <= LONGEST)  # longer ones are no keywords
        spelt = [raw[a:b].decode() for a, b in ends[fit].tolist()]
        return pd.DataFrame({"label": label[fit], "term": spelt, "score": score[fit]})

    kind = used.schema["label"].dataType
    parts = weighted.rows(sums, "label string, term string, score double")
    return parts.groupBy(F.col("label").cast(kind).alias("label"), "term").agg(F.sum("score").alias("score"))


def keyword_lists(keywords: DataFrame) -> DataFrame:
    """The few keywords of each cluster as an array in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "keyword")))
    return keywords.groupBy("label").agg(F.transform(ordered, lambda k: k["keyword"]).alias("keywords"))


# -- titles ----------------------------------------------------------------------------------


def normal_title(title: Column) -> Column:
    text = F.replace(F.trim(F.coalesce(title, F.lit(""))), F.lit("  "), F.lit(" "))
    text = F.regexp_replace(text, r"[，,]\s*", "，")
    text = F.regexp_replace(text, "^[。!！?？~、 ]+|[。!！?？~、 ]+$", "")
    return F.translate(text, "“”", "「」")


def title_score(title: Column, terms: Column, entities: Column, max_len: int = TITLE_LENGTH) -> Column:
    """Coverage, entities and action words count for a title; length and sensation against it."""
    over = F.greatest(F.lit(0), F.length(title) - max_len)
    entity = F.when(hits(title, entities) > 0, 1.2).otherwise(0.0)
    action = F.when(contains_any(title, ACTION_WORDS), 0.8).otherwise(0.0)
    score = 2.0 * hits(title, terms) + entity + action - over
    return F.when(contains_any(title, SENSATIONAL_WORDS), F.lit(-1e6)).otherwise(score)


def best_titles(candidates: DataFrame, key: str, max_len: int = TITLE_LENGTH) -> DataFrame:
    """The best title per event. ``candidates`` has key, title, terms and entities."""
    named = candidates.withColumn("title", normal_title(F.col("title")))
    fit = named.where((F.col("title") != "") & (F.length("title") <= 2 * max_len))
    scored = fit.withColumn("score", title_score(F.col("title"), F.col("terms"), F.col("entities"), max_len))
    best = F.max_by(F.struct("title", "score"), F.struct("score", "title")).alias("_b")
    return scored.groupBy(key).agg(best).select(key, "_b.title", "_b.score")


def short_title(title: Column, terms: Column, max_len: int = TITLE_LENGTH) -> Column:
    """Parts of a long title, best covered and shortest first, as long as they fit."""
    text = F.trim(F.coalesce(title, F.lit("")))
    parts = F.filter(F.split(text, r"[，,、:：;；\-—\s]+"), lambda p: p != "")
    ranked = F.reverse(
        F.array_sort(F.transform(parts, lambda p: F.struct(hits(p, terms).alias("c"), (-F.length(p)).alias("l"), p.alias("p"))))
    )

    def add(acc: Column, part: Column) -> Column:
        longer = F.when(acc == "", part["p"]).otherwise(F.concat_ws("、", acc, part["p"]))
        return F.when(F.length(longer) <= max_len, longer).otherwise(acc)

    packed = F.aggregate(ranked, F.lit(""), add)
    cut = F.regexp_replace(F.substring(text, 1, max_len), "[，、:：;；\\-— ]+$", "")
    return F.when(F.length(text) <= max_len, text).otherwise(F.coalesce(F.nullif(packed, F.lit("")), cut))


def fallback_title(keywords: Column, first_title: Column, shortest: Column, longest: Column) -> Column:
    """Keywords joined, else the common start of the titles, else the first title's start."""
    k = [F.get(keywords, F.lit(i)) for i in range(3)]
    same = F.filter(
        F.sequence(F.lit(0), F.length(shortest)), lambda i: F.substring(shortest, F.lit(1), i) == F.substring(longest, F.lit(1), i)
    )
    common = F.substring(shortest, F.lit(1), F.array_max(same))
    common = F.regexp_replace(common, "^[ \\-，。、《》]+|[ \\-，。、《》]+$", "")
    by_titles = F.when(F.length(common) >= 4, common).otherwise(F.substring(first_title, 1, 16))
    return (
        F.when(F.size(keywords) >= 3, F.concat(k[0], F.lit("、"), k[1], F.lit("与"), k[2]))
        .when(F.size(keywords) == 2, F.concat(k[0], F.lit("与"), k[1]))
        .when(F.size(keywords) == 1, k[0])
        .otherwise(F.coalesce(by_titles, F.lit("热点事件")))
    )


def title_ends(members: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """First, shortest and longest title of each event."""
    size = F.length("title")
    return members.groupBy(key).agg(
        F.min_by("title", F.struct(*order)).alias("first_title"),
        F.min_by("title", F.struct(size, *order)).alias("shortest"),
        F.min_by("title", F.struct(-size, *order)).alias("longest"),
    )


def recent_titles(news: DataFrame, key: str, day: str, tie: str, window: int = 200, keep: int = 12) -> DataFrame:
    """The last titles of each event in time order, as ``date｜source｜title`` lines."""
    newest = [F.desc(day), F.desc(tie)]
    last = top_n_per_key(news, [key], newest, window)
    fit = last.where(F.length("title").between(6, 80))
    few = top_n_per_key(fit, [key], newest, keep)
    line = F.concat_ws("｜", F.date_format(day, "yyyy-MM-dd"), "source", "title")
    listed = F.array_sort(F.collect_list(F.struct(F.col(day), F.col(tie), line.alias("line"))))
    return few.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("top_titles"))


# -- facts, summaries, progression -----------------------------------------------------------


def sentences(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The title and the sentences of 8 to 120 characters of each document, numbered from 0."""
    title = F.nullif(F.trim("title"), F.lit(""))
    parts = F.filter(F.split("content", SENTENCE_END), lambda x: F.length(x).between(8, 120))
    chunks = F.concat(F.array(title), F.transform(parts, lambda x: F.trim(x)))
    rows = docs.select(*keys, F.posexplode(chunks).alias("at", "sentence"))
    return rows.where(F.col("sentence").isNotNull())


def sentence_score(sentence: Column, keywords: Column) -> Column:
    number = F.when(sentence.rlike(r"\d"), 1).otherwise(0)
    return 2 * hits(sentence, keywords) + number


def fact_bank(docs: DataFrame, keywords: DataFrame, key: str, tie: str, limit: int = FACTS_PER_EVENT) -> DataFrame:
    """The best distinct sentences of each event: most keyword hits, then longest.

    ``keywords`` has the key and an array; documents carry key, tie, title and content.
    """
    rows = sentences(docs, [key, tie]).join(keywords, key)
    scored = rows.withColumn("score", sentence_score(F.col("sentence"), F.col("keywords"))).where(F.col("score") > 0)
    scored = scored.withColumn("squeezed", F.regexp_replace("sentence", r"\s+", "")).drop("keywords")
    order = [-F.col("score"), -F.length("sentence"), F.col(tie), F.col("at")]
    distinct = first_per_key(scored, [key, "squeezed"], order)
    return top_n_per_key(distinct, [key], order, limit, rank="rank").select(key, "rank", "score", "sentence")


def extractive_summaries(docs: DataFrame, key: str, keywords: Column, max_chars: int = SUMMARY_CHARS) -> DataFrame:
    """The two best sentences of each document in text order, cut."""
    rows = sentences(docs, [key]).withColumn("score", sentence_score(F.col("sentence"), keywords))
    order = [F.desc("score"), F.desc(F.length("sentence")), F.col("at")]
    best = top_n_per_key(rows, [key], order, 2, spread=False)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence"))), lambda x: x["sentence"])
    joined = best.groupBy(key).agg(F.array_join(listed, "。").alias("abstract"))
    return joined.withColumn("abstract", F.substring("abstract", 1, max_chars))


def progression_within(items: Column, dates: Column, limit: int = 8) -> Column:
    """Items whose dates all occur in the news; the first eight."""

    def dated(item: Column) -> Column:
        text = F.concat_ws(" ", F.trim(F.coalesce(item["date"], F.lit(""))), item["what"])
        return F.regexp_extract_all(text, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0))

    return F.slice(F.filter(items, lambda i: F.size(F.array_except(dated(i), dates)) == 0), 1, limit)


def gate_sections(reports: DataFrame, key_targets: bool = True, evolution: bool = True, forecast: bool = True) -> DataFrame:
    """Blank the switched-off sections of report rows (by default all three are off)."""
    empty = {
        "key_targets": (key_targets, F.array().cast("array<string>")),
        "evolution": (evolution, F.struct(F.array().cast("array<string>").alias("phases"), F.lit("").alias("explanation"))),
        "forecast": (
            forecast,
            F.struct(
                F.lit(0).alias("horizon_days"),
                F.array().cast("array<double>").alias("volume_forecast"),
                F.array().cast("array<string>").alias("scenarios"),
                F.lit("").alias("caveats"),
            ),
        ),
    }
    for name, (off, blank) in empty.items():
        if off and name in reports.columns:
            reports = reports.withColumn(name, F.when(F.col(name).isNotNull(), blank))
    return reports


def detection_latency(created: Column, first: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(created, first)).cast("long")


def report_numbers(news: DataFrame, key: str, created: Column) -> DataFrame:
    """One row of report numbers per event: volume, peak, sources, repeats, latency, titles."""
    per_day = stats.daily_counts(news, [key], F.col("pub_date"))
    summary = stats.daily_summary(per_day, [key])
    latency = detection_latency(created, F.to_date("first_date")).alias("latency_days")
    return (
        summary.join(stats.source_diversity(news, [key], "source"), key)
        .join(stats.duplicate_title_ratio(news, [key], "title"), key)
        .join(recent_titles(news, key, "pub_date", "doc_id"), key, "left")
        .select("*", latency)
    )
