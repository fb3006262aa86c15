"""Licences of files: sparse TF-IDF cosine of their text, blocks and lines to templates, then inheritance from directories.

Terms are runs of a-z and 0-9 in lower case, joined by single dots. The inverse document frequency ln((1 + N) / (1 + df)) + 1
counts all files; a term outside all templates weighs as one that no file has. Templates are notices of one line, headers
and titles of several lines, and whole texts of licences. What is compared with them are a file's units: its lines, its
blocks (between blank lines) and its whole text. The licence of a file is that of the template with the largest cosine to a
unit, if that is at least `least_cosine` (ties: lines in their order, then blocks, then the text, then the licence's name).
Only units with an anchor are compared: the anchors are the rarest terms of the templates, as many as it takes that no
unit without one can reach the least cosine.

A file is a licence file of its directory if a unit with its licence holds at least `least_share` of its terms: a complete
licence does by its whole text, a short file by its notice, a long one with a header does not. A file without a
licence of its own takes that of the nearest directory above it (or its own) that has a licence file; of several, the
one with the largest cosine, then the first name.

Null and empty texts have no licence of their own; a null path inherits nothing. Repeated rows give repeated results.
Built-in functions only: no Python runs on executors.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.llm.base import ready
from sessionmeter.llm.graph import stored
from sessionmeter.llm.licence_texts import TEXTS

TERM = "[a-z0-9]+(?:\\.[a-z0-9]+)*"
BLANK = "\n[ \t\r]*\n"
LEAST_COSINE, LEAST_SHARE = 0.6, 0.1
SALTS = 8

# Names and usual notices of licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This program is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def template_terms(templates: list[tuple[str, str]]) -> list[tuple[int, str, int]]:
    """(template's number, term, times) of the templates."""
    import re

    out = []
    for k, (_, text) in enumerate(templates):
        found = re.findall(TERM, text.lower())
        out += [(k, t, found.count(t)) for t in dict.fromkeys(found)]
    return out


def idf(count: int, files: int) -> float:
    return log((1 + files) / (1 + count)) + 1


def anchors(rows: list[tuple[int, str, int]], weight: dict[str, float], least_cosine: float) -> list[str]:
    """Terms of which any unit that reaches the least cosine holds one: the cosine is at most the norm of what is shared."""
    chosen: set[str] = set()
    for template in sorted({r[0] for r in rows}):
        parts = sorted(((weight[t], t, (n * weight[t]) ** 2) for k, t, n in rows if k == template), reverse=True)
        most = least_cosine**2 * sum(w for _, _, w in parts) * (1 - 1e-9)
        left = sum(w for _, t, w in parts if t not in chosen)
        for _, t, w in parts:
            if left < most:
                break
            if t not in chosen:
                chosen.add(t)
                left -= w
    return sorted(chosen)


def units(text: Column) -> Column:
    """Lines, blocks and the whole text; what would only repeat another unit is left out."""
    lines, blocks = F.split(text, "\n"), F.split(text, BLANK)
    more = F.when(F.size(blocks) > 1, F.concat(blocks, F.array(text))).otherwise(F.array(text))
    return F.when(F.size(lines) > 1, F.concat(lines, more)).otherwise(lines)


def own_licences(
    files: DataFrame, keep: tuple[str, ...] = (), templates: list[tuple[str, str]] = TEMPLATES + TEXTS,
    least_cosine: float = LEAST_COSINE, least_share: float = LEAST_SHARE,
) -> DataFrame:
    """For each file (path, text) its own_licence, cosine, is_licence_file, all null without one; `keep`: further columns."""
    # rows equal in path and text share their result
    files = files.select(*keep, "path", "text", F.xxhash64("path", "text").alias("row"))
    rows = template_terms(templates)
    vocabulary = sorted({t for _, t, _ in rows})
    have = F.array(*map(F.lit, vocabulary))
    found = files.select(F.explode(F.array_intersect(F.array_distinct(terms(F.col("text"))), have)).alias("term")).groupBy("term").count()
    counts = {r["term"]: r["count"] for r in found.collect()}  # at most the templates' terms
    total = files.count()
    weight = {t: idf(counts.get(t, 0), total) for t in vocabulary}
    spark = files.sparkSession
    norm: dict[int, float] = {}
    for k, t, n in rows:
        norm[k] = norm.get(k, 0.0) + (n * weight[t]) ** 2
    weights = spark.createDataFrame([(t, w) for t, w in weight.items()], "term string, idf double")
    vectors = spark.createDataFrame([(k, templates[k][0], t, n * weight[t] / sqrt(norm[k])) for k, t, n in rows], "template int, licence string, term string, unit double")
    anchor = F.array(*map(F.lit, anchors(rows, weight, least_cosine)))
    own = (
        files.withColumn("terms", terms(F.col("text"))).where(F.arrays_overlap("terms", anchor))
        .select("row", F.size("terms").alias("size"), F.posexplode(units(F.col("text"))).alias("line", "text"))
        .select("row", "size", "line", terms(F.col("text")).alias("terms"))
        .where(F.arrays_overlap("terms", anchor))
        .dropDuplicates(["row", "line"])
    )
    counted = own.select("row", "size", "line", F.explode("terms").alias("term")).groupBy("row", "size", "line", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = counted.join(weights, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(idf(0, total))))
    norms = weighed.groupBy("row", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("held"), F.max("size").alias("size"))
    dots = weighed.join(vectors, "term").groupBy("row", "line", "template", "licence").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    best = (
        dots.join(norms, ["row", "line"]).select("row", "line", "licence", cosine.alias("cosine"), (F.col("held") >= least_share * F.col("size")).alias("large"))
        .where(F.col("cosine") >= least_cosine)
        .groupBy("row", "licence").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "line")).alias("b"), F.max("large").alias("large"))
        .groupBy("row").agg(F.min(F.struct("b", "licence", "large")).alias("b"))
        .select("row", F.col("b.licence").alias("own_licence"), (-F.col("b.b.c")).alias("cosine"), F.col("b.large").alias("is_licence_file"))
    )
    return files.drop("text").join(best, "row", "left")


def directories(path: Column) -> Column:
    """The directories above a path, from the topmost down, without a last slash; '' is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """path, own_licence, cosine, licence, licence_from (a directory; null where the licence is the file's own) and `keep`."""
    ready(files.sparkSession)
    own = stored(own_licences(files, keep, **options), "licences")
    given = (
        own.where("is_licence_file and path is not null")
        .select(F.element_at(directories(F.col("path")), -1).alias("directory"), "own_licence", "cosine")
        .groupBy("directory").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own_licence").alias("licence"))).alias("g"))
        # one directory may hold a third of all files
        .select("directory", F.col("g.licence").alias("given"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    wanting = own.where("own_licence is null and path is not null").select("row", "path").distinct().select(
        "row", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"), F.posexplode(directories(F.col("path"))).alias("depth", "directory")
    )
    nearest = (
        wanting.join(given, ["directory", "salt"]).groupBy("row")
        .agg(F.max(F.struct("depth", "directory", "given")).alias("n")).select("row", F.col("n.directory").alias("licence_from"), F.col("n.given").alias("given"))
    )
    return own.join(nearest, "row", "left").select(
        *keep, "path", "own_licence", "cosine", F.coalesce("own_licence", "given").alias("licence"), "licence_from"
    )


def document_licences(docs: DataFrame) -> DataFrame:
    """Licences of documents, each taken as the file source/hundred/doc_id.txt."""
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat(F.col("source"), F.lit("/"), hundred, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), F.col("text").cast("string").alias("text"))
    return scan(files, ("doc_id",))
