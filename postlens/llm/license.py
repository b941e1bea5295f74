"""License scans: sparse TF-IDF cosine to templates, then inheritance along paths.

Every notice of a file (a line, a sentence of one, its leading block, or the
whole text of a licence file) is a sparse vector of its terms, each weighted by
its count and its inverse document frequency over all files. A cosine of s needs
shared terms with s^2 of the template's squared norm or more, so a notice must hold one of the
template's heaviest terms, those without which the rest falls short (its
prefix), and as many terms as its heaviest need to come to that. What is left is
bounded exactly: every term that the template has not weighs its count at least, so the
cosine is at most what the shared terms give over that norm. Only notices
that pass leave the scan, and the document frequencies of all
their terms are counted over all files; their dot products come from an
equi-join with the templates' terms. A file without a notice of its own takes
the licence of the nearest ancestor directory that has a licence file, found by
joining each directory's ancestors with the directories' licences.
DataFrame functions only.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm.common import cut
from postlens.llm.linededup import _maybe

SIMILARITY, FILE_SHARE = 0.8, 0.5
BROADCAST_TERMS = 200_000  # template terms sent to every task, at most; more are joined by shuffling
NOTICE = r"\n|(?<=[.!?;]) "
COMMENT = r"^\s*(#|//|/\*|\*|--|;|%|<!--|$)"
PARAGRAPHS = 4  # a header has up to so many consecutive paragraphs, wherever it stands
LICENSE_FILE = r"(^|/)(licen[sc]e|copying|notice)(\.[^/]*)?$"
NOT_TERM = "[^a-z0-9]+"

# Short licence notices, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

# Headers of source files; the texts below ``licenses`` are whole licences.
HEADERS = [
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]


def templates(spark: SparkSession) -> DataFrame:
    """``license, text`` of notices, headers and whole licences."""
    whole = [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    return spark.createDataFrame(TEMPLATES + HEADERS + whole, "license string, text string")


def all_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, repeats included."""
    return F.array_remove(F.split(F.lower(text), NOT_TERM), "")


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(all_terms(text))


def _idf(n: Column, df: Column) -> Column:
    return F.log((n + 1.0) / (F.coalesce(df, F.lit(0)) + 1.0)) + 1.0


def document_frequency(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``term, df``: how many files hold each wanted term.

    Terms go by a 64-bit hash. A filter of fixed size keeps terms that nobody
    asked for in their task, the others are counted there before they are shuffled.
    """
    wanted = wanted.select("term", F.xxhash64("term").alias("h"))
    rows = files.select(F.explode_outer(F.transform(terms(F.col("text")), lambda t: F.xxhash64(t))).alias("h"))
    counted = _maybe(rows.where("h is not null"), wanted, F.col("h"), "hit").where("hit").groupBy("h").agg(F.count("*").alias("df"))
    return counted.join(wanted, "h").select("term", "df")


def prefixes(entries: DataFrame, similarity: float) -> DataFrame:
    """``term, tpl, need``: the terms of which a notice must hold one to reach ``similarity`` with a template.

    ``need`` is the least number of the template's terms that it must hold. ``entries``: ``term, license, body, v``.
    """
    w2 = F.col("v") * F.col("v")
    lighter = Window.partitionBy("license", "body").orderBy(F.col("v").desc(), "term").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy("license", "body")
    least = (similarity - 1e-6) ** 2 * F.sum(w2).over(whole)
    ranked = entries.select(
        "term", "license", "body", F.sum(w2).over(whole).alias("all"), F.sum(w2).over(lighter).alias("rest"), least.alias("least"))
    # the heaviest terms before this one fall short: it is needed too
    short = (F.col("all") - F.col("rest") < F.col("least") - 1e-9).cast("int")
    need = F.sum(short).over(whole)
    ranked = ranked.select("term", F.xxhash64("license", "body").alias("tpl"), need.alias("need"), "rest", "least")
    return ranked.where(F.col("rest") >= F.col("least") - 1e-9).select("term", "tpl", "need")


def may_reach(similarity: float) -> Column:
    """Whether a notice (``words``, ``t``) can have this cosine with a template (``of``: term to (v, w), ``norm``).

    With the shared terms' part of the notice's squared norm B and the count C of its other words, whose
    weights are 1 or more, the norm is at least sqrt(B + C).
    """
    count = lambda x: F.size(F.filter("words", lambda y: y == x)).cast("double")
    shared = F.transform(F.array_intersect("t", F.map_keys("of")), lambda x: F.struct(
        count(x).alias("n"), F.col("of")[x]["v"].alias("v"), F.col("of")[x]["w"].alias("w")))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("dot", "b", "n")])
    got = F.aggregate(shared, zero, lambda a, x: F.struct(
        (a["dot"] + x["v"] * x["n"] * x["w"]).alias("dot"), (a["b"] + x["n"] * x["n"] * x["w"] * x["w"]).alias("b"),
        (a["n"] + x["n"]).alias("n")))
    least = F.lit((similarity - 1e-6) ** 2) * F.col("norm") * F.col("norm")
    return F.exists(F.array(got), lambda g: g["dot"] * g["dot"] >= least * (g["b"] + F.size("words") - g["n"]) - 1e-9)


def notices(files: DataFrame, prefix: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """Rows ``file_id, path, notice, words`` of the notices that may reach ``similarity`` with a template.

    Besides each line and sentence, the leading comment block, every run of one to
    ``PARAGRAPHS`` paragraphs and the whole text of licence files are notices.
    """
    lines = F.split("text", "\n")
    other = F.array_position(F.transform(lines, lambda s: s.rlike(COMMENT)), False)
    comment = F.array_join(F.slice(lines, F.lit(1), F.when(other > 0, other - 1).otherwise(F.size(lines)).cast("int")), "\n")
    parts = F.split(F.trim("text"), r"\n[ \t\r]*\n")
    runs = F.flatten(F.transform(parts, lambda _, i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(PARAGRAPHS), F.size(parts) - i)), lambda k: F.array_join(F.slice(parts, i + 1, k), "\n"))))
    whole = F.when(F.lower("path").rlike(LICENSE_FILE), F.col("text"))
    blocks = F.array_compact(F.array_distinct(F.concat(F.array(comment, whole), F.coalesce(runs, F.array().cast("array<string>")))))
    units = files.select("file_id", "path", F.posexplode(F.concat(F.split("text", NOTICE), blocks)).alias("notice", "s"))
    units = units.select("file_id", "path", "notice", all_terms(F.col("s")).alias("words"))
    units = units.select("file_id", "path", "notice", "words", F.array_distinct("words").alias("t"))
    some = units.select("*", F.explode_outer("t").alias("term")).join(prefix, "term").where(F.size("t") >= F.col("need"))
    some = some.drop("term").join(bodies, "tpl")
    some = some.where(F.size(F.array_intersect("t", F.map_keys("of"))) >= F.col("need")).where(may_reach(similarity))
    return some.select("file_id", "path", "notice", "words").dropDuplicates(["file_id", "path", "notice", "words"])


def scan(files: DataFrame, known: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "text",
         similarity: float = SIMILARITY, file_share: float = FILE_SHARE) -> DataFrame:
    """``file_id, path, license, similarity, origin, licensed_by`` for every file.

    ``origin`` is ``notice`` (a notice of the file's own text, at a cosine of
    ``similarity`` or more), ``inherited`` (from the directory
    ``licensed_by``) or null. A file is its directory's licence file if its
    name says so (LICENSE, LICENCE, COPYING, NOTICE, with any ending) or its
    best notice makes up ``file_share`` or more of its text; of several the
    greatest cosine, then the smallest licence and path, holds. Ties between
    licences go to the smallest name. Null and empty texts have no notice but may
    inherit; a null path has no directory; rows that share id and path are one
    file with all their notices, listed as often as they occur; without templates nothing is licensed; an empty table gives no
    rows; other columns are ignored.
    """
    rows = files.select(F.col(id_col).alias("file_id"), F.col(path_col).cast("string").alias("path"),
                        F.col(text_col).cast("string").alias("text"))
    tpl = known.select("license", F.col("text").alias("body")).where("license is not null and body is not null").distinct()
    # a hash stands for the text, which may be long and is on every term's row
    tpl_terms = tpl.select("license", F.sha2("body", 256).alias("body"), F.explode(all_terms(F.col("body"))).alias("term"))
    counts = cut(tpl_terms.groupBy("license", "body", "term").agg(F.count("*").alias("tf")))
    wanted = cut(counts.select("term").distinct())
    n = F.lit(rows.count())
    df = document_frequency(rows, wanted)
    weight = cut(wanted.join(df, "term", "left").select("term", _idf(n, F.col("df")).alias("w")))
    entries = cut(counts.join(weight, "term").withColumn("v", F.col("tf") * F.col("w")))
    vector = entries.groupBy("license", "body").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    bodies = entries.groupBy("license", "body").agg(
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"),
        F.map_from_entries(F.collect_list(F.struct("term", F.struct("v", "w")))).alias("of"))
    bodies = bodies.select(F.xxhash64("license", "body").alias("tpl"), "norm", "of")
    few = entries.count() <= BROADCAST_TERMS  # all that is sent is a part of these
    send = F.broadcast if few else (lambda x: x)
    found = cut(notices(rows, send(cut(prefixes(entries, similarity))), send(bodies), similarity))
    hits = (found.select("file_id", "path", "notice", F.xxhash64("words").alias("u"), F.size(F.array_distinct("words")).alias("size"),
                         F.explode_outer("words").alias("term"))
            .groupBy("file_id", "path", "notice", "u", "size", "term").agg(F.count("*").alias("n")))
    hits = cut(hits)
    # the terms of these notices that no template has weigh by their own frequency
    other = cut(hits.select("term").distinct().join(wanted, "term", "left_anti"))
    seen = document_frequency(rows, other).select("term", _idf(n, F.col("df")).alias("w"))
    weighted = cut(hits.join(weight.unionByName(seen), "term").withColumn("x", F.col("n") * F.col("w")))
    key = ["file_id", "path", "notice", "u"]
    norms = weighted.groupBy(*key).agg(
        F.max("size").alias("size"), F.sum(F.col("x") * F.col("x")).alias("sq"))
    dots = (weighted.select(*key, "term", "x").join(entries.select("license", "body", "term", "v"), "term")
            .groupBy(*key, "license", "body").agg(F.sum(F.col("x") * F.col("v")).alias("dot")))
    left, right = dots.alias("l"), norms.alias("r")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    both = left.join(right, same).select("l.file_id", "l.path", "license", "body", "dot", F.col("r.size").alias("size"), "sq")
    scored = both.join(vector, ["license", "body"]).withColumn(
        "cos", F.round(F.col("dot") / (F.col("norm") * F.sqrt("sq")), 6))
    best = (scored.where(F.col("cos") >= similarity).groupBy("file_id", "path")
            .agg(F.min(F.struct((-F.col("cos")).alias("c"), "license", "size")).alias("m")))
    best = cut(best.select(F.col("file_id").alias("f"), F.col("path").alias("p"), (-F.col("m.c")).alias("similarity"),
                           F.col("m.license").alias("license"), F.col("m.size").alias("terms")))
    dir_of = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    slim = rows.select("file_id", "path", dir_of.alias("dir"), F.size(F.split(F.trim(F.col("text")), r"\s+")).alias("words"))
    own = slim.join(best, slim["file_id"].eqNullSafe(best["f"]) & slim["path"].eqNullSafe(best["p"]), "left").drop("f", "p")
    named = F.lower("path").rlike(LICENSE_FILE)
    whole = F.col("terms") >= F.col("words") * file_share
    of_dir = (own.where(F.col("license").isNotNull() & F.col("path").isNotNull() & (named | whole))
              .groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("c"), "license", "path")).alias("m"))
              .select(F.col("dir").alias("holder"), F.col("m.license").alias("dir_license"), (-F.col("m.c")).alias("dir_similarity")))
    # each directory with licence-less files looks at itself and its ancestors
    dirs = own.where("license is null and path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(
        F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    nearest = (dirs.select("dir", F.explode(ancestors).alias("holder")).join(of_dir, "holder")
               .groupBy("dir").agg(F.max(F.struct(F.length("holder").alias("n"), "holder", "dir_license", "dir_similarity")).alias("h"))
               .select(F.col("dir").alias("d"), F.col("h.holder").alias("holder"), F.col("h.dir_license").alias("dl"),
                       F.col("h.dir_similarity").alias("ds")))
    out = own.join(nearest, (own["dir"] == nearest["d"]) & own["license"].isNull() & own["path"].isNotNull(), "left")
    return out.select(
        "file_id", "path", F.coalesce("license", "dl").alias("license"), F.coalesce("similarity", "ds").alias("similarity"),
        F.when(F.col("license").isNotNull(), "notice").when(F.col("dl").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("license").isNull(), F.col("holder")).alias("licensed_by"))
