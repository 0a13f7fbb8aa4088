"""News rows out of stored web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.fixed_values import BODY_CLASSES, LINK_EXCLUDED, LINK_HOSTS, SOURCE_LABELS
from newsweave.functions.text import contains_any, strip_html

FIRST_HEADING = r"(?is)<h1[^>]*>(.*?)</h1>"
ARTICLE = r"(?is)<article[^>]*>(.*?)</article>"
STAMP = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})"
DAY = r"(\d{4}[年-]\d{1,2}[月-]\d{1,2})"
IMAGE_SOURCE = r"(?i)<img[^>]*?\ssrc=[\"']([^\"']*)[\"']"


def _found(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def _body(html: Column) -> Column:
    def by_class(name: str) -> Column:
        pattern = rf"(?is)<div[^>]*class=[\"'][^\"']*\b{name}\b[^\"']*[\"'][^>]*>(.*?)</div>"
        return F.when(html.contains(name), _found(html, pattern))

    return F.coalesce(*[by_class(c) for c in BODY_CLASSES], _found(html, ARTICLE), by_class("article__content"))


def publish_time(html: Column) -> Column:
    """A full time stamp in the page source, else a day in either notation."""
    stamp = F.try_to_timestamp(F.regexp_replace(_found(html, STAMP), r"\s+", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    day = F.try_to_timestamp(F.regexp_replace(_found(html, DAY), "[年月]", "-"), F.lit("yyyy-M-d"))
    return F.coalesce(stamp, day)


def image_links(html: Column) -> Column:
    links = F.regexp_extract_all(html, F.lit(IMAGE_SOURCE), F.lit(1))
    return F.filter(links, lambda u: (u != "") & ~u.startswith("data:"))


def page_news(pages: DataFrame, as_of: Column) -> DataFrame:
    """Title, body text, time and images of each page; pages without a body are dropped.

    A page is read once: the row is built and tested inside one array, because a plain filter on
    the body would be pushed below the projection and match every pattern again.
    """
    html = F.col("html")

    def row(body: Column) -> Column:
        return F.struct(
            strip_html(F.coalesce(_found(html, FIRST_HEADING), F.lit(""))).alias("title"),
            strip_html(body).alias("content"),
            F.coalesce(publish_time(html), as_of).alias("time"),
            image_links(body).alias("images"),
        )

    rows = F.transform(F.array(_body(html)), row)
    kept = F.filter(rows, lambda r: F.coalesce(r["content"], F.lit("")) != "")
    return pages.select(*[c for c in pages.columns if c != "html"], F.inline(kept))


def url_host(url: Column) -> Column:
    """Host in lower case without a leading ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def source_label(source: Column, collection: Column, url: Column) -> Column:
    """The stored source, else a label by collection name, else the host."""
    named = F.coalesce(*[F.when(F.lower(collection).contains(k), F.lit(v)) for k, v in SOURCE_LABELS])
    return F.coalesce(F.nullif(source, F.lit("")), named, url_host(url))


def followable_links(links: DataFrame, url: str, text: str, hosts: list[str] | None = None) -> DataFrame:
    """Links worth opening: long enough text, a known host, no excluded path, one row per url."""
    kept = links.where(
        (F.length(text) >= 5)
        & contains_any(F.col(url), hosts or LINK_HOSTS)
        & ~contains_any(F.col(url), LINK_EXCLUDED)
    )
    return kept.dropDuplicates([url])
