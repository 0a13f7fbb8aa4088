"""License scans: TF-IDF cosine of licence lines to templates, inherited from the nearest directory.

Lines of a file that name a licence are its header. Header and templates become sparse TF-IDF vectors
over the terms of the templates (document frequency over the templates, a bounded vocabulary); the best
cosine of MIN_SCORE or more is the file's licence. A file whose header makes up FILE_SHARE of its words is
a licence file and speaks for its directory. A file without a licence of its own takes that of the
nearest directory above it, found by joining its ancestor paths with the directories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.columns import word_count, words

#: Names and usual notice lines of licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0 Creative Commons Attribution.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "Copyright. All rights reserved.",
}
NOTICE = r"(?i)licen[sc]e|copyright|all rights reserved|redistribution|creative commons|\bCC BY"
MIN_SCORE = 0.6
FILE_SHARE = 0.25


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9\-.]+|\.(?![0-9])"), lambda t: t != "")


def templates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(license, term, weight) with unit norm, and (term, idf)."""
    spark = docs.sparkSession
    base = spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")
    tf = base.select("license", F.explode(terms(F.col("text"))).alias("term")).groupBy("license", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg((F.log((1 + len(TEMPLATES)) / (1 + F.count("*").cast("double"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "license").select("license", "term", (F.col("w") / F.col("norm")).alias("weight")), idf


def own_licenses(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, license, score, is_file for files with a licence of their own; repeated paths count as one file."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(NOTICE))
    headers = files.where(F.col(path).isNotNull() & body.rlike(NOTICE)).select(F.col(path).alias("path"), F.array_join(lines, "\n").alias("h"), word_count(body).alias("n"))
    headers = headers.withColumn("is_file", F.size(words(F.col("h"))) >= FILE_SHARE * F.col("n")).withColumn("row", F.xxhash64("path", "h"))
    weights, idf = templates(files)
    counts = headers.select("path", "row", "is_file", F.explode(terms(F.col("h"))).alias("term")).groupBy("path", "row", "is_file", "term").agg(F.count("*").alias("tf"))
    # The tables of templates hold one row per term of TEMPLATES.
    vectors = counts.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = vectors.groupBy("path", "row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = vectors.join(F.broadcast(weights), "term").groupBy("path", "row", "is_file", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, ["path", "row"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= MIN_SCORE)
    best = scores.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"), F.max("is_file").alias("is_file"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "is_file")


def ancestors(path: Column) -> Column:
    """(depth, directory) for every directory above a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))


def scan(files: DataFrame, path: str = "path", text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, path, own_license, score, license, inherited_from, one row per input row.

    Null paths have no licence and inherit none. Null text has no header. Of several licence files in a
    directory the commonest licence speaks for it, ties to the smaller name. Rows with equal paths share
    one result. An empty table gives an empty table.
    """
    own = own_licenses(files, path, text)
    rows = files.select(F.col(key).alias("key"), F.col(path).alias("path"))
    above = F.regexp_replace("path", "/[^/]*$", "")
    votes = own.where(F.col("is_file") & F.col("path").contains("/")).groupBy(above.alias("dir"), "license").agg(F.count("*").alias("n"))
    dirs = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("v")).select("dir", F.col("v.license").alias("dir_license"))
    parents = rows.select(above.alias("parent")).where(F.col("path").contains("/")).distinct()
    climbs = parents.select("parent", F.explode(ancestors(F.concat("parent", F.lit("/x")))).alias("a")).select("parent", "a.*")
    nearest = climbs.join(dirs, "dir").groupBy("parent").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("n")).select("parent", "n.*")
    told = rows.join(own.select("path", "license", "score").withColumnRenamed("license", "own_license"), "path", "left").withColumn("parent", F.when(F.col("path").contains("/"), above))
    # One row per directory; a directory with a third of all files is split by the adaptive skew join.
    done = told.join(nearest, "parent", "left")
    inherits = F.col("own_license").isNull() & F.col("dir_license").isNotNull()
    return done.select("key", "path", "own_license", "score", F.coalesce("own_license", "dir_license").alias("license"), F.when(inherits, F.col("dir")).alias("inherited_from"))
