"""License scans: sparse TF-IDF cosine of headers and license files to templates, then nearest-ancestor inheritance.

Templates are short notices, SPDX lines, standard headers and full license
texts. A text's terms are words without punctuation, so line breaks and comment
signs don't matter. Each template has anchors: terms that it has once, all
that are not common words for a short template, the most telling ones for a
full text. Where a text has an anchor, the run of terms that would
be the template's place (as long as the template) is compared with it by the
cosine of TF-IDF vectors; what stands around it doesn't count. Terms are weighed
by their document frequency over all files; those that no template has weigh
like a term seen once. The best template at ``threshold`` is the file's own
license. Files named LICENSE, COPYING or NOTICE (any suffix) that declare one
give it to their directory, and a file without a license of its own inherits
from the nearest directory above it that has one.
An SPDX line that joins several licenses, or names one that no template has, is
taken as it stands (without -only, -or-later and +) and comes before any cosine.

One pass over the texts writes, for each file, the template terms it has and, if
it has an anchor, all its terms; every comparison is made inside a row.

Defined cases: a null text has no terms, a null path has no directory and
inherits nothing; equal cosines go to the smaller license name; several
licenses in one directory give it the smallest name of the best score; a
full text that has lost all of its anchors is not found; empty tables
give empty results; other columns are ignored. Rows are told apart by id and
path together.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import lower_ascii, materialize, table


@dataclass(frozen=True)
class Template:
    """A license by one of its texts; ``top``: only within the first TOP terms of a file (titles)."""

    license: str
    text: str
    top: bool = False


# Short license notices and headers as authors write them into files, and SPDX ids.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Artistic-2.0", "you can redistribute it and/or modify it under the terms of the Artistic License 2.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)
TITLES = (("MIT", "MIT License"), ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("MPL-2.0", "Mozilla Public License Version 2.0"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("EPL-2.0", "Eclipse Public License - v 2.0"), ("Artistic-2.0", "The Artistic License 2.0"))
SPDX = ("AGPL-3.0", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")
#: What stands after the label on an SPDX line: license ids, joined by AND, OR and WITH, in brackets or not.
EXPRESSION = r"(?im)SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][A-Za-z0-9.+-]*(?:\)*[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][A-Za-z0-9.+-]*)*\)*)"
#: Terms too common in prose to be anchors.
FREQUENT = frozenset("a all an and any are as at be by can file for found from if in is it may more no not of on one or such that the this to under use was with without work you your".split())
THRESHOLD, TOP = 0.8, 40
#: Anchors of a template of more than SHORT terms.
ANCHORS, SHORT = 16, 60
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
FULL_TEXTS = Path(__file__).parent / "licenses"
_TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"


@cache
def templates() -> tuple[Template, ...]:
    """The notices, titles, SPDX lines and the full texts beside this module."""
    full = [Template(p.stem, p.read_text()) for p in sorted(FULL_TEXTS.glob("*.txt"))]
    spdx = [Template(i, f"SPDX-License-Identifier: {i}{late}") for i in SPDX for late in (("", "-only", "-or-later") if "GPL" in i else ("",))]
    return tuple([*(Template(*n) for n in NOTICES), *(Template(*t, top=True) for t in TITLES), *spdx, *full])


def terms_of(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def terms(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(_TERM), F.lit(0))


def anchors(known: tuple[Template, ...]) -> dict[str, list[tuple[int, int]]]:
    """By term, the (template number, place) it anchors: terms that a template has once, those in few templates first, then longer ones; of a short template all of them."""
    bags = [Counter(terms_of(t.text)) for t in known]
    spread = Counter(term for b in bags for term in b)
    found: dict[str, list[tuple[int, int]]] = {}
    for k, (t, bag) in enumerate(zip(known, bags, strict=True)):
        places = {term: at for at, term in enumerate(terms_of(t.text))}
        fit = sorted((x for x in places if bag[x] == 1 and x not in FREQUENT), key=lambda x: (spread[x], -len(x), x)) or [max(places, key=len)]
        for term in fit if len(places) <= SHORT else fit[:ANCHORS]:
            found.setdefault(term, []).append((k, places[term]))
    return found


def spdx(text: Column) -> Column:
    """The license expression of a text's first SPDX line, if it joins several or names one that is not in SPDX; else null."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), EXPRESSION, 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(found, r"(?i)-(?:only|or-later)\b|\+", ""), r"[ \t]+", " "))
    for word in ("AND", "OR", "WITH"):
        plain = F.regexp_replace(plain, f"(?i) {word} ", f" {word} ")
    alone = F.lower(plain).isin(*[i.lower() for i in SPDX])
    return F.when((plain != "") & ~alone, plain)


def _read(files: DataFrame, known: tuple[Template, ...], file_id: str, path: str, text: str) -> DataFrame:
    """id, path, has (the template terms of a file), terms (all of them in order, null without an anchor), spdx."""
    vocabulary = sorted({t for x in known for t in terms_of(x.text)})
    words = files.select(F.col(file_id).alias("id"), F.col(path).alias("path"), terms(F.col(text)).alias("t"), F.when(F.contains(lower_ascii(F.col(text)), F.lit("spdx-license-identifier")), spdx(F.col(text))).alias("spdx"))
    marks = F.array(*map(F.lit, sorted(anchors(known))))
    out = words.select("id", "path", F.array_intersect("t", F.array(*map(F.lit, vocabulary))).alias("has"), F.when(F.arrays_overlap("t", marks), F.col("t")).alias("terms"), "spdx")
    return materialize(out, "terms")


def idf(read: DataFrame) -> dict[str, float]:
    """log((1 + files) / (1 + files with the term)) + 1 for the templates' terms, over all files; at "" that of any other term.

    The result has an entry for each template term, however many files there are.
    """
    n = read.count()
    counts = {r["t"]: r["c"] for r in read.select(F.explode("has").alias("t")).groupBy("t").agg(F.count("*").alias("c")).collect()}
    return {t: math.log((1 + n) / (1 + c)) + 1 for t, c in counts.items()} | {"": math.log(1 + n) + 1}


def unit(text: str, weight: dict[str, float]) -> dict[str, float]:
    """A template's TF-IDF vector, of length one."""
    v = {t: n * weight.get(t, weight[""]) for t, n in Counter(terms_of(text)).items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / norm for t, x in v.items()}


def scan(files: DataFrame, known: tuple[Template, ...] | None = None, threshold: float = THRESHOLD, file_id: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """id, path, license, cosine of the files' own declarations; files without one are not in it."""
    known = known or templates()
    read = _read(files, known, file_id, path, text)
    weight = idf(read)
    spark = read.sparkSession
    # both have as many rows as there are templates
    sizes = F.broadcast(spark.createDataFrame([(k, len(terms_of(t.text)), t.top, sorted(set(terms_of(t.text)))) for k, t in enumerate(known)], "k int, len int, top boolean, vocabulary array<string>"))
    rows = [(k, t.license, unit(t.text, weight), {x: weight.get(x, weight[""]) for x in weight if x}) for k, t in enumerate(known)]
    vectors = F.broadcast(spark.createDataFrame(rows, "k int, license string, w map<string,double>, idf map<string,double>"))
    places = F.create_map(*[x for term, at in sorted(anchors(known).items()) for x in (F.lit(term), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in at]))])
    marks = F.map_keys(places)
    hits = F.filter(F.transform("terms", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: F.array_contains(marks, x["t"]))
    # template and place in one number, so that equal places of several anchors are told apart fast
    spots = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(places, h["t"]), lambda a: a["k"].cast("bigint") * (1 << 40) + F.greatest(h["i"] - a["p"], F.lit(0))))))
    k_of, start_of = lambda s: F.shiftright(s, 40).cast("int"), lambda s: s.bitwiseAND(F.lit((1 << 40) - 1).cast("bigint")).cast("int")
    # a row for each template that an anchor speaks for; a file has to have half of its distinct terms, as every run that can reach the threshold has
    half = lambda have: 2 * F.size(F.array_intersect(have, F.col("vocabulary"))) >= F.size("vocabulary")
    asked = read.filter("terms IS NOT NULL").select("id", "path", "terms", "has", spots.alias("spots")).withColumn("k", F.explode(F.array_distinct(F.transform("spots", k_of)))).join(sizes, "k").filter(half(F.col("has")))
    # a template's places become short runs before they become rows, and equal runs one row
    here = F.filter("spots", lambda s: (k_of(s) == F.col("k")) & (~F.col("top") | (start_of(s) <= TOP)))
    runs = F.array_distinct(F.transform(here, lambda s: F.array_join(F.slice("terms", start_of(s) + 1, F.col("len")), " ")))
    met = asked.select("id", "path", "k", "vocabulary", F.explode(runs).alias("said")).withColumn("run", F.split("said", " ")).withColumn("kinds", F.array_distinct("run")).filter(half(F.col("kinds")))
    likely = met.select("id", "path", "k", "run", "kinds").join(vectors, "k")
    tf = lambda t: (F.size("run") - F.size(F.array_remove("run", t))).cast("double")
    x = F.transform("kinds", lambda t: F.struct((tf(t) * F.coalesce(F.try_element_at("idf", t), F.lit(weight[""]))).alias("x"), F.coalesce(F.try_element_at("w", t), F.lit(0.0)).alias("w")))
    sums = F.aggregate(x, F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("sq")), lambda a, e: F.struct((a["dot"] + e["x"] * e["w"]).alias("dot"), (a["sq"] + e["x"] * e["x"]).alias("sq")))
    scored = likely.withColumn("sums", sums).select("id", "path", "license", F.round(F.col("sums.dot") / F.sqrt("sums.sq"), 6).alias("cosine")).filter(F.col("cosine") >= threshold)
    told = scored.withColumn("rank", F.lit(1)).unionByName(read.filter("spdx IS NOT NULL").select("id", "path", F.col("spdx").alias("license"), F.lit(1.0).alias("cosine"), F.lit(0).alias("rank")))
    best = told.groupBy("id", "path").agg(F.min(F.struct("rank", (-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("id", "path", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def directory(path: Column) -> Column:
    """The path up to its last slash, without it; null where there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))


def inherit(files: DataFrame, own: DataFrame, file_id: str = "doc_id", path: str = "path") -> DataFrame:
    """doc_id, path, license, cosine, origin (own, inherited or none), license_dir."""
    givers = own.filter(F.col("path").rlike(LICENSE_FILE)).select(directory(F.col("path")).alias("dir"), "license", "cosine").filter("dir IS NOT NULL")
    by_dir = givers.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("g")).select("dir", F.col("g.license").alias("license"))
    rows = files.select(F.col(file_id).alias("id"), F.col(path).alias("path"))
    dirs = rows.select(directory(F.col("path")).alias("dir")).filter("dir IS NOT NULL").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("up"), k.alias("depth")))).alias("a")).select("dir", "a.up", "a.depth")
    nearest = above.join(by_dir, above["up"] == by_dir["dir"]).groupBy(above["dir"].alias("dir")).agg(F.max_by(F.struct("license", "up"), "depth").alias("n"))
    mine = own.select(F.col("id").alias("own_id"), F.col("path").alias("own_path"), F.struct("license", "cosine").alias("o"))
    joined = rows.join(mine, F.col("id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left").withColumn("dir", directory(F.col("path"))).join(nearest, "dir", "left")
    return joined.select(
        F.col("id").alias("doc_id"), "path", F.coalesce("o.license", "n.license").alias("license"), F.col("o.cosine").alias("cosine"),
        F.when(F.col("o").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("o").isNull(), F.col("n.up")).alias("license_dir"),
    )


def paths_of(docs: DataFrame) -> DataFrame:
    """doc_id, path, text: documents as files of a tree (documents have no path of their own).

    source/thousands/hundreds/name; a document whose last line is a notice is
    named LICENSE.<id>, and every third of these stands one directory further
    up, every ninth at the source's top, as repositories keep them.
    """
    last = F.lower(F.substring_index(F.coalesce("text", F.lit("")), "\n", -1))
    given = last.rlike("licen[cs]e")
    name = F.when(given, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    thousands = F.when(~given | (F.col("doc_id") % 9 != 0), F.expr("cast(doc_id div 1000 as string)"))
    hundreds = F.when(~given | (F.col("doc_id") % 3 != 0), F.expr("cast(doc_id div 100 as string)"))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), thousands, hundreds, name).alias("path"), "text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = paths_of(table(spark, sf_dir, "documents"))
    own = materialize(scan(files), "licenses")
    return inherit(files, own)
