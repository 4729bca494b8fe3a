"""License scans: TF-IDF cosine of notices to templates, then inheritance by directory.

Lines that look like a notice are cut out of whole texts; each becomes a sparse TF-IDF
vector with document frequencies over all notices and templates, and takes the template of
highest cosine if that reaches the threshold. Besides, the spans of each whole text are
compared with standard headers, whole licences and the templates (license_match), so headers
of several lines, licence files, notices within a longer line and SPDX lines count too;
"all rights reserved" counts only where no licence is found. A file without a license of its own inherits
that of the nearest directory above it that holds a licence file, by joins on path prefixes.

Edge cases: null and empty texts have no notice; a null path has no directory and inherits
nothing; of several notices in a file the best match counts, ties by template name; of
several licence files in a directory the best match counts, ties by name; repeated rows are
answered alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.llm import license_match
from pathfold.llm.columns import column
from pathfold.scratch import Scratch

#: Short notices of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
}
#: What a notice line contains, and the words it is made of.
NOTICE = "licen[sc]e|all rights reserved|copyright"
TERM = "[a-z0-9]+"
LICENCE_FILE = "(?i)^(licen[cs]e|copying)([.].*)?$"
THRESHOLD = 0.6


def _spans(text):
    """license_match on the texts with a keyword: struct<name, cosine> or NULL."""
    matcher = license_match.Matcher(list(TEMPLATES.items()) + license_match.licence_texts())

    @F.pandas_udf("name string, cosine double")
    def best(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([matcher.best(t) or (None, None) for t in texts], columns=["name", "cosine"]).astype({"name": object, "cosine": float})

    return best(F.when(text.rlike(f"(?i){license_match.KEYWORD}"), text))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, path, own_license, similarity, license, inherited_from for every file."""
    spark = files.sparkSession
    lines = F.filter(F.split(column(text_col).cast("string"), "\n"), lambda x: x.rlike(f"(?i){NOTICE}"))
    base = files.select(column(id_col).alias("doc_id"), column(path_col).cast("string").alias("path"), lines.alias("lines"), _spans(column(text_col).cast("string")).alias("span"))
    base = Scratch(spark, "licenses").write(base, "lines")  # texts are read once
    terms = lambda c: F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))
    notices = base.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n")).withColumn("terms", terms(F.col("line")))
    templates = spark.createDataFrame(list(TEMPLATES.items()), "name string, line string").select("name", terms(F.col("line")).alias("terms"))
    each = notices.select("n", F.explode(F.array_distinct("terms")).alias("term")).unionAll(templates.select(F.lit(1).cast("long"), F.explode(F.array_distinct("terms"))))
    total = notices.agg((F.coalesce(F.sum("n"), F.lit(0)) + len(TEMPLATES)).alias("total"))
    idf = each.groupBy("term").agg(F.sum("n").alias("df")).join(F.broadcast(total)).select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))

    def vectors(rows: DataFrame, key: str) -> DataFrame:
        tf = rows.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
        w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
        norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))

    goal = F.broadcast(vectors(templates, "name").withColumnRenamed("w", "v"))  # a fixed list of templates
    near = vectors(notices, "line").join(goal, "term").groupBy("line", "name").agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("cosine"))
    best = near.filter(F.col("cosine") >= THRESHOLD).groupBy("line").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "name")).alias("m"))
    found = base.select("doc_id", "path", F.explode("lines").alias("line")).join(best, "line")
    whole = base.filter("span.name IS NOT NULL").select("doc_id", "path", (-F.col("span.cosine")).alias("c"), F.col("span.name").alias("name"))
    found = found.select("doc_id", "path", "m.c", "m.name").unionAll(whole)
    found = found.withColumn("m", F.struct((F.col("name") == license_match.LAST).alias("last"), "c", "name"))
    own = found.groupBy("doc_id", "path").agg(F.min("m").alias("m")).select("doc_id", "path", F.col("m.name").alias("own_license"), (-F.col("m.c")).alias("similarity"))
    named = own.filter(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE))
    held = named.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")).groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("c"), "own_license")).alias("m"))
    held = held.select(F.col("dir").alias("above"), F.col("m.own_license").alias("dir_license"))
    home = base.select("doc_id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = home.filter("dir IS NOT NULL").select("dir").distinct()
    above = dirs.select("dir", F.explode(ups).alias("above")).join(held, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("l"), "above", "dir_license")).alias("m"))
    above = above.select("dir", F.col("m.above").alias("above"), F.col("m.dir_license").alias("dir_license"))
    a, b = home.alias("a"), own.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.path").eqNullSafe(F.col("b.path")), "left").select("a.doc_id", "a.path", "dir", "own_license", "similarity")
    joined = joined.join(above, "dir", "left")
    return joined.select(
        "doc_id", "path", "own_license", "similarity",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("above")).alias("inherited_from"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Give documents paths: <source>/<lang>/<thousand>/<id>.txt.

    The table has no paths. Of the documents with a notice the one of least id in a
    source and language stands for that directory's licence file.
    """
    has = F.coalesce(F.col("text").rlike(f"(?i){NOTICE}"), F.lit(False))
    d = docs.select("doc_id", "text", F.coalesce("source", F.lit("-")).alias("s"), F.coalesce("lang", F.lit("-")).alias("l"), has.alias("has"))
    first = d.filter("has").groupBy("s", "l").agg(F.min("doc_id").alias("doc_id")).withColumn("is_file", F.lit(True))
    folder = F.concat_ws("/", "s", "l", F.expr("doc_id div 1000").cast("string"))
    path = F.when(F.col("is_file"), F.concat_ws("/", "s", "l", F.lit("LICENSE"))).otherwise(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.join(first, ["s", "l", "doc_id"], "left").select("doc_id", "text", path.alias("path"))


QUERY = "op1_license_scan"


def query(spark, sf_dir: str) -> DataFrame:
    return scan(as_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_TEMPLATE_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
SQL = f"""
WITH d AS (SELECT doc_id, text, coalesce(source, '-') AS s, coalesce(lang, '-') AS l FROM documents),
f AS (SELECT s, l, min(doc_id) AS doc_id FROM d WHERE regexp_matches(text, '(?i){NOTICE}') GROUP BY s, l),
files AS (SELECT d.doc_id, d.text, CASE WHEN f.doc_id IS NOT NULL THEN d.s || '/' || d.l || '/LICENSE'
    ELSE d.s || '/' || d.l || '/' || (d.doc_id // 1000) || '/' || d.doc_id || '.txt' END AS path
  FROM d LEFT JOIN f ON d.s = f.s AND d.l = f.l AND d.doc_id = f.doc_id),
lines AS (SELECT doc_id, path, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i){NOTICE}'))) AS line FROM files),
notices AS (SELECT line, count(*) AS n, regexp_extract_all(lower(line), '{TERM}') AS terms FROM lines GROUP BY line),
templates AS (SELECT name, regexp_extract_all(lower(line), '{TERM}') AS terms FROM (VALUES {_TEMPLATE_ROWS}) v(name, line)),
each_term AS (SELECT n, unnest(list_distinct(terms)) AS term FROM notices UNION ALL SELECT 1, unnest(list_distinct(terms)) FROM templates),
total AS (SELECT coalesce(sum(n), 0) + {len(TEMPLATES)} AS total FROM notices),
idf AS (SELECT term, ln((1 + any_value(total))::DOUBLE / (1 + sum(n))) + 1 AS idf FROM each_term, total GROUP BY term),
nt AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(terms) AS term FROM notices) GROUP BY line, term),
tt AS (SELECT name, term, count(*) AS tf FROM (SELECT name, unnest(terms) AS term FROM templates) GROUP BY name, term),
nw AS (SELECT line, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY line)) AS norm FROM nt JOIN idf USING (term)),
tw AS (SELECT name, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY name)) AS norm FROM tt JOIN idf USING (term)),
near AS (SELECT line, name, round(sum(nw.w / nw.norm * (tw.w / tw.norm)), 6) AS cosine FROM nw JOIN tw USING (term) GROUP BY line, name),
best AS (SELECT line, name, cosine FROM near WHERE cosine >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY line ORDER BY cosine DESC, name) = 1),
own AS (SELECT doc_id, path, name AS own_license, cosine AS similarity FROM lines JOIN best USING (line)
  QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY cosine DESC, name) = 1),
held AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS above, own_license AS dir_license FROM own WHERE path LIKE '%/LICENSE'
  QUALIFY row_number() OVER (PARTITION BY above ORDER BY similarity DESC, own_license) = 1),
home AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
above AS (SELECT dir, above, dir_license FROM (SELECT DISTINCT dir FROM home) h JOIN held ON above = dir OR above = '' OR starts_with(dir, above || '/')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1)
SELECT h.doc_id, h.path, own_license, similarity, coalesce(own_license, dir_license) AS license,
  CASE WHEN own_license IS NULL THEN above.above END AS inherited_from
FROM home h LEFT JOIN own ON own.doc_id = h.doc_id AND own.path = h.path LEFT JOIN above ON above.dir = h.dir
"""
