"""License scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance from the nearest ancestor directory.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stage, table, without
from tessera.llm.components import join_sized

#: (licence, notice).  A licence may have several notices; the best one counts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under the Creative Commons CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
)
#: Names of licence files.
FILES = r"(^|/)(licen[sc]e|copying|unlicense|notice)[^/]*$"
LEAST_COSINE = 0.75
#: A text is a licence file by content if all of it is this like a template and has so many terms; a shorter one is a header.
FILE_COSINE, FILE_TERMS = 0.9, 15
NEW = ("license", "cosine", "own_license", "inherited_from")
_TERMS = "regexp_extract_all(lower({0}), '[a-z0-9]+', 0)"


def templates(spark: SparkSession, pairs=TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(k, lic, text) for k, (lic, text) in enumerate(pairs)], "template int, license string, notice string")


def document_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``term, df`` of all documents' terms."""
    terms = docs.select(F.explode(F.array_distinct(F.expr(_TERMS.format(f"`{text_col}`")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def needed_terms(vectors: list[tuple[int, str, float]], least: float) -> list[str]:
    """Terms of which a text must hold one for a cosine of ``least`` to some template (template, term, weight; unit vectors).

    A text without a template's heaviest terms has with it a cosine of the root of the other weights' squares at most,
    so terms are taken from the heaviest on until that is less than asked for.
    """
    out: set[str] = set()
    by: dict[int, list[tuple[float, str]]] = {}
    for template, term, w in vectors:
        by.setdefault(template, []).append((w, term))
    for own in by.values():
        left = 1.0
        for w, term in sorted(own, key=lambda x: (-x[0], x[1])):
            if left < (least - 1e-5) ** 2:
                break
            out.add(term)
            left -= w * w
    return sorted(out)


def scan(
    docs: DataFrame, pairs=TEMPLATES, *, id_col="doc_id", text_col="text", path_col="path", least=LEAST_COSINE, file_cosine=FILE_COSINE, file_share: float | None = None,
) -> DataFrame:
    """The licence of each document by its own headers, or else by the nearest ancestor directory with a licence file.

    Adds ``own_license`` and ``cosine`` (the best header: a line, a paragraph or the whole text, if its cosine to a
    template is at least ``least``; ties go to the first template), ``inherited_from`` (a directory) and ``license``.
    A term weighs by its number in the header and by ln((n + 1) / (df + 1)) + 1, n and df counted over all documents.
    A licence file is one so named, or whose whole text is like a template, or, given ``file_share``, whose header
    makes up that part of its terms; where a directory has several, the best cosine and then the first path counts.
    Null and empty texts and null paths have no header and no ancestor.  Long texts are looked at whole.  Repeated
    rows get the same result; the new columns replace those of the same names.  The templates' vectors are a fixed
    table; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = without(docs, NEW)
    notices = templates(spark, pairs)
    df, n = stage(document_counts(docs, text_col)), docs.count()
    vocabulary = notices.select(F.explode(F.expr(_TERMS.format("notice"))).alias("term")).distinct()
    weight = lambda df_: F.log((F.lit(n) + 1.0) / (df_ + 1.0)) + 1.0
    # Templates: term, weight; their number is fixed by the parameter.
    idf = vocabulary.join(df, "term", "left").select("term", weight(F.coalesce("df", F.lit(0))).alias("idf"))
    local = {r.term: r.idf for r in idf.collect()}
    lookup = "map(" + ", ".join(f"'{t}', {v!r}D" for t, v in sorted(local.items())) + ")"
    tf = notices.select("template", "license", F.explode(F.expr(_TERMS.format("notice"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    tf = tf.withColumn("w", F.col("tf") * F.expr(f"try_element_at({lookup}, term)"))
    norm = tf.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = tf.join(norm, "template").select("template", "license", "term", (F.col("w") / F.col("norm")).alias("tw"))
    needed = needed_terms([(r.template, r.term, r.tw) for r in vectors.collect()], least)
    vectors = F.broadcast(vectors)

    key = F.xxhash64(F.col(id_col), F.col(text_col), *([F.col(path_col)] if path_col else []))
    # A text or header without any needed term is like no template.
    some = "(?<![a-z0-9])(" + "|".join(needed) + ")(?![a-z0-9])"
    held = docs.where(F.expr(f"lower(`{text_col}`) rlike '{some}'")).select(key.alias("doc"), F.col(text_col).alias("t")).distinct()
    # Lines, paragraphs and the whole, each once.
    units = held.select("doc", "t", F.expr(f"size({_TERMS.format('t')})").alias("total"), F.expr("explode(array_distinct(concat(array(t), split(t, '\\n'), split(t, '\\n[ \\t]*\\n'))))").alias("u"))
    units = units.where(f"lower(u) rlike '{some}'").select("doc", "total", F.expr("u = t").alias("all"), F.xxhash64("u").alias("unit"), F.expr(_TERMS.format("u")).alias("terms"))
    units = units.select("doc", "unit", F.expr(f"all and size(terms) >= {FILE_TERMS}").alias("all"), (F.size("terms") / F.col("total")).alias("share"), F.explode("terms").alias("term"))
    words = stage(units.groupBy("doc", "all", "unit", "share", "term").agg(F.count("*").alias("tf")))
    sized = words.groupBy("term").agg(F.count("*").alias("__n")).join(df, "term")
    words = join_sized(words, sized, "term", words.count()).withColumn("w", F.col("tf") * weight(F.col("df"))).drop("df", "tf")
    length = words.groupBy("doc", "all", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = words.join(vectors, "term").groupBy("doc", "all", "unit", "share", "template", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosines = dots.join(length, ["doc", "all", "unit"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6))
    best = cosines.groupBy("doc").agg(
        F.max(F.struct("cosine", (-F.col("template")).alias("t"), "share", "license")).alias("b"),
        F.max(F.when(F.col("all"), F.col("cosine"))).alias("whole"),
    )
    best = best.where(F.col("b.cosine") >= least).select("doc", F.col("b.license").alias("own_license"), F.col("b.cosine").alias("cosine"), F.col("b.share").alias("share"), "whole")
    best = stage(best)  # a row per document with a header: used thrice below
    out = docs.withColumn("__doc", key).join(best, F.col("__doc") == F.col("doc"), "left").drop("doc", "__doc")
    if path_col is None:
        return out.drop("whole", "share").withColumn("inherited_from", F.lit(None).cast("string")).withColumn("license", F.col("own_license"))
    # Directories with a licence file, and each directory's nearest such ancestor: rows by directory, not by document.
    out = out.withColumn("__dir", F.regexp_extract(F.col(path_col), "^(.*)/[^/]*$", 1))
    named = F.expr(f"lower(`{path_col}`) rlike '{FILES}'") | (F.col("whole") >= file_cosine)
    if file_share is not None:
        named = named | (F.col("share") >= file_share)
    files = out.where(F.col("own_license").isNotNull() & named)
    given = files.groupBy(F.col("__dir").alias("home")).agg(F.min_by("own_license", F.struct(-F.col("cosine"), F.col(path_col))).alias("given"))
    dirs = out.where(F.col(path_col).isNotNull()).groupBy("__dir").agg(F.count("*").alias("__n"))
    up = dirs.select("__dir", F.expr("explode(transform(sequence(0, size(split(__dir, '/'))), n -> array_join(slice(split(__dir, '/'), 1, n), '/')))").alias("home")).distinct()
    near = up.join(given, "home").groupBy("__dir").agg(F.max_by(F.struct("home", "given"), F.length("home")).alias("near"))
    near = stage(dirs.join(near, "__dir", "left").select("__dir", "__n", "near.home", "near.given"))
    # A directory may hold a third of all rows: the rows of the largest are joined where they lie.
    out = join_sized(out, near, "__dir", n, "left")
    return out.select(*docs.columns, "own_license", "cosine", F.when(F.col("own_license").isNull(), F.col("home")).alias("inherited_from"), F.coalesce("own_license", "given").alias("license"))


#: Documents have no paths: one lies under its source, and ids of more than two digits in a directory for each leading digit.
PATH = "concat(coalesce(source, ''), '/', if(doc_id >= 100, regexp_replace(cast(doc_id div 100 as string), '(.)', '$1/'), ''), doc_id, '.txt')"
#: Nor have they licence files: one whose header is so much of its text stands for its directory's.
SHARE = 0.2


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(PATH).alias("path"))
    return scan(docs, file_share=SHARE).select("doc_id", "path", "own_license", "cosine", "inherited_from", "license")


def _sql() -> str:
    quoted = ", ".join(f"({k}, '{lic}', '{text}')" for k, (lic, text) in enumerate(TEMPLATES))
    terms = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
    return f"""
WITH d AS (SELECT doc_id, text, coalesce(source, '') || '/' || CASE WHEN doc_id >= 100 THEN regexp_replace(CAST(doc_id // 100 AS VARCHAR), '(.)', '\\1/', 'g') ELSE '' END || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents),
tpl AS (SELECT * FROM (VALUES {quoted}) t(template, license, notice)),
tt AS (SELECT template, license, unnest({terms.format("notice")}) AS term FROM tpl),
dt AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({terms.format("text")}) AS term FROM documents) GROUP BY term),
nn AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM (SELECT DISTINCT term FROM (SELECT term FROM tt UNION ALL SELECT term FROM dt)) LEFT JOIN dt USING (term), nn),
tv AS (SELECT template, license, term, count(*) * any_value(idf) AS w FROM tt JOIN idf USING (term) GROUP BY ALL),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tv GROUP BY template),
held AS (SELECT doc_id, text FROM d WHERE text IS NOT NULL),
u0 AS (SELECT doc_id, text AS t, len({terms.format("text")}) AS total, unnest(list_distinct([text] || string_split(text, chr(10)) || regexp_split_to_array(text, '\\n[ \\t]*\\n'))) AS u FROM held),
u AS (SELECT row_number() OVER () AS unit, doc_id, u = t AND len(terms) >= {FILE_TERMS} AS whole, len(terms) / total AS share, terms FROM (SELECT *, {terms.format("u")} AS terms FROM u0) WHERE len(terms) > 0),
uw AS (SELECT unit, doc_id, whole, share, term, count(*) * any_value(idf) AS w FROM (SELECT unit, doc_id, whole, share, unnest(terms) AS term FROM u) JOIN idf USING (term) GROUP BY unit, doc_id, whole, share, term),
un AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM uw GROUP BY unit),
cs AS (SELECT uw.unit, uw.doc_id, uw.whole, uw.share, tv.template, tv.license, round(sum(uw.w * tv.w / tn.norm) / any_value(un.norm), 6) AS cosine FROM uw JOIN tv ON uw.term = tv.term JOIN tn ON tn.template = tv.template JOIN un ON un.unit = uw.unit GROUP BY uw.unit, uw.doc_id, uw.whole, uw.share, tv.template, tv.license),
best AS (SELECT doc_id, arg_max(license, (cosine, -template, share)) AS own_license, arg_max(share, (cosine, -template, share)) AS share, max(cosine) AS cosine, max(CASE WHEN whole THEN cosine END) AS whole FROM cs GROUP BY doc_id HAVING max(cosine) >= {LEAST_COSINE}),
o AS (SELECT d.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, own_license, cosine, whole, share FROM d LEFT JOIN best USING (doc_id)),
given AS (SELECT dir AS home, arg_min(own_license, (-cosine, path)) AS given FROM o WHERE own_license IS NOT NULL AND (regexp_matches(lower(path), '{FILES}') OR whole >= {FILE_COSINE} OR share >= {SHARE}) GROUP BY dir),
near AS (SELECT o.dir, arg_max(home, length(home)) AS home, arg_max(given, length(home)) AS given FROM (SELECT DISTINCT dir FROM o) o JOIN given ON o.dir = home OR home = '' OR starts_with(o.dir, home || '/') GROUP BY o.dir)
SELECT o.doc_id, path, own_license, cosine, CASE WHEN own_license IS NULL THEN near.home END AS inherited_from, coalesce(own_license, near.given) AS license FROM o LEFT JOIN near USING (dir)
"""


OP5_SQL = _sql()
