"""Aggregates per group: days, sources, titles, detections, tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.operators.ranking import number_rows, top_n_per_key


def _text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def daily_counts(rows: DataFrame, keys: Sequence[str], day: Column) -> DataFrame:
    """Rows per calendar day."""
    return rows.groupBy(*keys, day.alias("day")).agg(F.count("*").alias("n"))


def daily_summary(per_day: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average over days that have rows, and the peak day (the earliest on a tie)."""
    peak = F.max_by("day", F.struct("n", -F.unix_date("day")))
    return per_day.groupBy(*keys).agg(
        F.sum("n").alias("news_count"),
        F.round(F.sum("n") / F.count("*"), 6).alias("daily_avg"),
        _text(peak).alias("peak_date"),
        F.max("n").alias("peak_count"),
        _text(F.min("day")).alias("first_date"),
        _text(F.max("day")).alias("last_date"),
    )


def event_times(per_day: DataFrame, keys: Sequence[str], point_days: int = 3) -> DataFrame:
    """One day or a short span is a point (the most frequent day, the earliest on a tie), else a range."""
    busiest = F.max_by("day", F.struct("n", -F.unix_date("day"))).alias("busiest")
    spans = per_day.groupBy(*keys).agg(F.min("day").alias("first"), F.max("day").alias("last"), busiest)
    point = F.datediff("last", "first") <= point_days
    return spans.select(
        *keys,
        F.when(point, "point").otherwise("range").alias("time_type"),
        _text(F.when(point, F.col("busiest")).otherwise(F.col("first"))).alias("time_start"),
        _text(F.when(point, F.col("busiest")).otherwise(F.col("last"))).alias("time_end"),
    )


def source_diversity(rows: DataFrame, keys: Sequence[str], source: str, approximate: bool = False) -> DataFrame:
    """Distinct non-empty sources per row of the group."""
    named = F.nullif(F.col(source), F.lit(""))
    if approximate:
        distinct, total = F.approx_count_distinct(named), F.count("*")
        return rows.groupBy(*keys).agg(distinct.alias("sources"), F.round(distinct / total, 6).alias("diversity"))
    per_source = rows.groupBy(*keys, named.alias("_s")).agg(F.count("*").alias("_n"))
    return per_source.groupBy(*keys).agg(
        F.count("_s").alias("sources"), F.round(F.count("_s") / F.sum("_n"), 6).alias("diversity")
    )


def duplicate_title_ratio(rows: DataFrame, keys: Sequence[str], title: str) -> DataFrame:
    """Share of titles that repeat another one, white space squeezed, empty titles ignored."""
    squeezed = F.nullif(F.trim(F.regexp_replace(title, r"\s+", " ")), F.lit(""))
    per_title = rows.groupBy(*keys, squeezed.alias("_t")).agg(F.count("*").alias("_n"))
    used = F.sum(F.when(F.col("_t").isNotNull(), F.col("_n")))
    ratio = F.coalesce(1 - F.count("_t") / used, F.lit(0.0))
    return per_title.groupBy(*keys).agg(F.round(ratio, 6).alias("dup_title_ratio"))


def group_digest(rows: DataFrame, key: str, member: str) -> DataFrame:
    """md5 over the sorted members of each group, joined without a separator.

    The members stream through the hash in sorted order, one Arrow batch at a time: only ids are
    shuffled, sorting may spill, and a group is never held as one value however large it is.
    """
    ids = rows.select(F.col(key).alias("key"), F.col(member).cast("string").alias("member"))
    ordered = ids.repartition("key").sortWithinPartitions("key", "member")
    key_type = ids.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, digest = None, None
        for batch in batches:
            done_keys, done = [], []
            changes = batch["key"].ne(batch["key"].shift()).cumsum()
            for _, part in batch.groupby(changes, sort=False):
                value = part["key"].iloc[0]
                if digest is None or value != current:
                    if digest is not None:
                        done_keys.append(current)
                        done.append(digest.hexdigest())
                    current, digest = value, hashlib.md5()
                digest.update("".join(part["member"]).encode("utf-8"))
            yield pd.DataFrame({"key": pd.Series(done_keys, dtype=batch["key"].dtype), "digest": pd.Series(done, dtype=object)})
        if digest is not None:
            yield pd.DataFrame({"key": [current], "digest": [digest.hexdigest()]})

    return ordered.mapInPandas(run, f"key {key_type}, digest string").withColumnRenamed("key", key)


def reference_rows(rows: DataFrame, key: str, url: str) -> DataFrame:
    """Distinct non-empty urls per event, as numbered rows in order."""
    distinct = rows.where(F.trim(F.coalesce(url, F.lit(""))) != "").select(key, F.trim(url).alias("url")).distinct()
    return number_rows(distinct, [key], ["url"], "position")


def allowed_dates(rows: DataFrame, key: str, day: Column) -> DataFrame:
    """Sorted distinct days per event (there are only so many days)."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(_text(day))).alias("dates"))


def best_detections(detections: DataFrame, image: str, name: str, score: str) -> DataFrame:
    return detections.groupBy(image, name).agg(F.max(score).alias(score))


def image_group(detections: DataFrame, group: str, scene: str, element: str, limit: int = 10) -> DataFrame:
    """Most common scene and up to ten distinct elements of each image group."""
    scenes = detections.groupBy(group, scene).agg(F.count("*").alias("_n"))
    best = scenes.groupBy(group).agg(F.min_by(scene, F.struct(-F.col("_n"), scene)).alias("category"))
    distinct = detections.where(F.coalesce(element, F.lit("")) != "").select(group, element).distinct()
    few = top_n_per_key(distinct, [group], [F.col(element)], limit)
    listed = few.groupBy(group).agg(F.array_sort(F.collect_list(element)).alias("elements"))
    return best.join(listed, group, "left")


def task_rollup(lines: DataFrame, task: str, ts: str, status: str) -> DataFrame:
    """Start, end, duration, number of lines and last status of each task."""
    return lines.groupBy(task).agg(
        F.max_by(status, ts).alias("status"),
        F.min(ts).alias("started_at"),
        F.max(ts).alias("ended_at"),
        F.round((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1000000, 3).alias("duration_sec"),
        F.count("*").alias("line_count"),
    )


def task_lines(lines: DataFrame, task: str, order: Sequence[str]) -> DataFrame:
    """The log of each task as numbered rows; a chatty task spreads over many partitions."""
    return number_rows(lines, [task], order, "line_no")


def category_counts(rows: DataFrame, category: str, known: Sequence[str], failed: str) -> DataFrame:
    """Rows per category; labels outside ``known`` count as failures."""
    label = F.when(F.col(category).isin(list(known)), F.col(category)).otherwise(failed)
    return rows.groupBy(label.alias("category")).agg(F.count("*").alias("n_rows"))
