"""Licence scan: sparse TF-IDF cosine of notice lines to templates, then inheritance along directories.

A line that names a licence is a segment. Equal segments are scored once. Terms are
weighed by their rarity among all segments and templates, a segment takes its closest
template, and a file without a notice of its own takes the licence of the nearest
directory above it that has a licence file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

#: Lines with one of these are scored.
MARKERS = r"licen[cs]e|copyright|spdx|all rights reserved|public domain|redistribution|without warranty|permission is hereby granted"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST = 0.6
#: Licence names and notice sentences that stand for them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
]


def _terms(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by..., term, tf) of each row's lower-cased terms."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return df.select(*by, F.explode(found).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("tf"))


def closest_templates(spark: SparkSession, segments: DataFrame, templates: list[tuple[str, str]], least: float = LEAST) -> DataFrame:
    """(segment, n) to (segment, license, cosine): the closest template of each at ``least`` or more; ties by name."""
    known = spark.createDataFrame(templates, "license string, notice string")
    tf = written(_terms(segments, ["segment", "n"], "segment"), "terms")
    notice_tf = _terms(known, ["license", "notice"], "notice")
    counted = tf.select("term", "n").unionByName(notice_tf.select("term", F.lit(1).cast("long").alias("n")))
    df = counted.groupBy("term").agg(F.sum("n").alias("df"))
    total = (segments.agg(F.sum("n")).first()[0] or 0) + len(templates)
    idf = df.select("term", (F.log(F.lit(float(total + 1)) / (F.col("df") + 1)) + 1).alias("idf"))
    weight = ((F.log(F.col("tf").cast("double")) + 1) * F.col("idf")).alias("w")
    mine = tf.join(idf, "term").select("segment", "term", weight)
    # the templates are a constant of a few hundred terms
    theirs = F.broadcast(idf.join(F.broadcast(notice_tf), "term").select("license", "notice", "term", weight.alias("v")))
    notice_norm = theirs.groupBy("license", "notice").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("notice_norm"))
    norm = mine.groupBy("segment").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = mine.join(theirs, "term").groupBy("segment", "license", "notice").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norm, "segment").join(F.broadcast(notice_norm), ["license", "notice"])
    scored = scored.select("segment", "license", F.round(F.col("dot") / F.col("norm") / F.col("notice_norm"), 6).alias("cosine")).where(F.col("cosine") >= least)
    best = scored.groupBy("segment").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("segment", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def license_scan(
    spark: SparkSession, files: DataFrame, key: str = "path", templates: list[tuple[str, str]] | None = None, least: float = LEAST,
    license_files: str = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$",
) -> DataFrame:
    """``files`` (key, path, text) to (key, path, own_license, own_cosine, inherited_license, from_dir, license).

    Every line of a text counts, wherever it stands. Several licences are joined by AND
    in order of name. A licence file's own licence holds for its directory and all below
    it until a nearer one; two licence files of a directory add up. Null texts and null
    paths have no notices and inherit nothing; rows that repeat a key are merged in their
    notices; extra columns are ignored; an empty table gives no rows.
    """
    rows = files.select(F.col(key).alias("id"), F.col("path").cast("string").alias("file"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(MARKERS))
    segment = written(rows.select("id", "file", F.explode(lines).alias("segment")), "segments")
    distinct = segment.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    best = closest_templates(spark, distinct, templates or TEMPLATES, least)
    per = segment.join(best, "segment").groupBy("id", "file", "license").agg(F.max("cosine").alias("cosine"))
    # a file has at most as many licences as there are templates
    own = written(per.groupBy("id", "file").agg(
        F.array_join(F.sort_array(F.collect_set("license")), " AND ").alias("own_license"), F.max("cosine").alias("own_cosine")
    ), "own")
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    base = F.regexp_extract("file", r"[^/]*$", 0)
    dirs = own.where(base.rlike(license_files)).groupBy(folder.alias("dir")).agg(F.array_join(F.sort_array(F.collect_set("own_license")), " AND ").alias("inherited"))
    parts = F.split("home", "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    climb = F.concat(F.array(F.lit("")), below)  # the root has no name
    # directories are far fewer than files: each is matched with its ancestors once
    homes = rows.where("file is not null").select(folder.alias("home")).distinct()
    climbed = homes.select("home", F.posexplode(climb).alias("depth", "dir"))
    nearest = climbed.join(dirs, "dir").groupBy("home").agg(F.max(F.struct("depth", "dir", "inherited")).alias("near"))
    out = rows.select("id", "file", folder.alias("home")).join(own, ["id", "file"], "left").join(nearest, "home", "left")
    return out.select(
        F.col("id").alias(key), *([] if key == "path" else [F.col("file").alias("path")]), "own_license", "own_cosine",
        F.col("near.inherited").alias("inherited_license"), F.col("near.dir").alias("from_dir"),
        F.coalesce("own_license", "near.inherited").alias("license"),
    )
