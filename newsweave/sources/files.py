"""CSV edges, JSON rows and image inventories."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsweave.fixed_values import IMAGE_TYPES

BOM = "﻿"


def write_edges_csv(edges: DataFrame, path: str) -> None:
    """CSV with a header that starts with the UTF-8 byte order mark, as spreadsheet tools expect."""
    first = edges.columns[0]
    edges.withColumnRenamed(first, BOM + first).write.mode("overwrite").csv(path, header=True)


def read_edges_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of edge files by column name in first-seen order, byte order marks stripped."""
    tables = []
    for path in paths:
        raw = spark.read.option("header", True).csv(path)
        tables.append(raw.toDF(*[c.lstrip(BOM) for c in raw.columns]))
    whole = tables[0]
    for more in tables[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    return whole


def json_ready(df: DataFrame, ids: tuple[str, ...] = ("_id",)) -> DataFrame:
    """Ids as strings and times in ISO form, ready for ``write.json``."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(column, "SSSSSS")
            column = F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
        elif isinstance(field.dataType, T.DateType) or field.name in ids:
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def sniff_type(content: Column) -> Column:
    """MIME type from the first bytes, null when unknown."""
    head = F.hex(F.substring(content, 1, 16))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("424D"), "image/bmp")
    )


def image_inventory(images: DataFrame, name_pattern: str | None = None, limit: int = 0) -> DataFrame:
    """Sniffed type, and the metadata fixes each file needs.

    Expects ``filename``, ``content``, ``content_type`` and ``uploaded``; the binary column is read
    for its first bytes only and does not leave the scan stage.
    """
    rows = images.where(F.col("filename").rlike(name_pattern)) if name_pattern else images
    sniffed = F.coalesce(sniff_type(F.col("content")), F.col("content_type"))
    rows = rows.withColumn("sniffed", sniffed).drop("content").where(F.col("sniffed").isNotNull())
    extension = F.coalesce(*[F.when(F.col("sniffed") == m, F.lit(e)) for m, e in IMAGE_TYPES.items()])
    known = F.lower("filename").rlike(r"\.(" + "|".join(IMAGE_TYPES.values()) + ")$")
    fixed = (
        rows.withColumn("fix_type", ~F.col("sniffed").eqNullSafe(F.col("content_type")))
        .withColumn("fix_name", ~known & extension.isNotNull())
        .withColumn(
            "new_name", F.when(F.col("fix_name"), F.concat_ws(".", "filename", extension)).otherwise(F.col("filename"))
        )
    )
    return fixed.orderBy("uploaded", "filename").limit(limit) if limit > 0 else fixed


def write_files(rows: DataFrame, path: str) -> int:
    """One file per row below a shared folder, named by ``name`` (may have folders) and holding the bytes of ``value``.

    Tasks write the files themselves: Spark's writer needs a folder per file, which its committer moves one by one
    in the driver. A task that runs again writes the same files again. Returns the number of files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(path)
        made = set()
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = f"{root}/{name}"
                if (folder := file.rpartition("/")[0]) not in made:
                    place.create_dir(folder, recursive=True)
                    made.add(folder)
                with place.open_output_stream(file) as out:
                    out.write(value or b"")
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    written = rows.select("name", F.col("value").cast("binary")).mapInArrow(run, "files long")
    return written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def read_images(
    spark: SparkSession, path: str, pattern: str | None = None, after: str | None = None, before: str | None = None, min_bytes: int = 0
) -> DataFrame:
    """Image files below a folder in the shape ``image_inventory`` expects, with ``size``.

    Names that do not match the glob ``pattern`` and files outside the times (modified after, before) are
    never opened; the size is a filter of the file listing, too. Content is read only where it is used.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    for name, value in (("pathGlobFilter", pattern), ("modifiedAfter", after), ("modifiedBefore", before)):
        if value is not None:
            reader = reader.option(name, value)
    files = reader.load(path).where(F.col("length") >= min_bytes)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        "path",
        F.col("length").alias("size"),
        "content",
        F.lit(None).cast("string").alias("content_type"),
        F.col("modificationTime").alias("uploaded"),
    )
