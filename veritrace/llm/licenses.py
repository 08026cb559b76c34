"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then the nearest directory's licence."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import ascii_lower, cut, read

#: Licences: identifier and the names that texts call them by.
NAMES = (
    ("AGPL-3.0", ("GNU Affero General Public License version 3", "AGPLv3")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "BSD-style license")),
    ("CC-BY-4.0", ("Creative Commons Attribution 4.0 International License",)),
    ("CC-BY-SA-4.0", ("Creative Commons Attribution-ShareAlike 4.0 International License",)),
    ("CC0-1.0", ("Creative Commons CC0 1.0 Universal public domain dedication",)),
    ("GPL-2.0", ("GNU General Public License version 2", "GPLv2")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GPLv3")),
    ("ISC", ("ISC License",)),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1",)),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3",)),
    ("MIT", ("MIT License",)),
    ("MPL-2.0", ("Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0")),
    ("Unlicense", ("Unlicense",)),
)
#: Ways to declare a licence by its name.
PHRASES = (
    "{}", "Released under the {}.", "Licensed under the {}.", "This work is licensed under a {}.",
    "This project is licensed under the {} - see the LICENSE file for details.", "Use of this source code is governed by a {} that can be found in the LICENSE file.",
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation, either version {3} of the License, or (at your "
    "option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU {2} for more details. You should have received a copy of the GNU {2} along with this {0}."
)
#: Texts and headers of licences, whole and by the part that opens them.
TEXTS = (
    ("MIT", "MIT License Copyright (c) " + _MIT + " " + _AS_IS), ("MIT", _MIT),
    ("BSD-2-Clause", _BSD + " " + _BSD_AS_IS), ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " " + _BSD3 + " " + _BSD_AS_IS), ("BSD-3-Clause", _BSD + " " + _BSD3),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", _GNU.format("program", ";", "General Public License", "2")), ("GPL-3.0", _GNU.format("program", ":", "General Public License", "3")),
    ("LGPL-2.1", _GNU.format("library", ";", "Lesser General Public License", "2.1")), ("LGPL-3.0", _GNU.format("library", ":", "Lesser General Public License", "3")),
    ("AGPL-3.0", _GNU.format("program", ":", "Affero General Public License", "3")),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
TEMPLATES = (
    *[(i, phrase.format(name)) for i, names in NAMES for name in names for phrase in PHRASES],
    *[(i, f"SPDX-License-Identifier: {i}{more}") for i, _ in NAMES for more in ("", *(("-only", "-or-later") if "GPL" in i else ()))],
    *TEXTS,
)
#: Least cosine of a declared licence.
LEAST = 0.6
#: A declaring file of at most so many words stands for its directory, as one does whose name says so.
NOTICE_WORDS = 60
#: Lines that may open a declaration; with each are compared it and the next ones, so many lines in all.
_CUE = r"(?i)licen[sc]e|permission is hereby|permission to use|free software|creative commons|redistribution|unencumbered|[al]?gplv"
LINES = (1, 2, 3, 5, 8, 13, 21)
#: Lines together are a header if they have at most so many letters; one line is compared however long it is.
HEADER_LETTERS = 4000
_NAME = r"(?i)(^|/)(un)?(licen[sc]e|copying|notice)[^/]*$"
#: A directory's files are spread over so many tasks when they get its licence.
SALTS = 16


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


def weights(templates=TEMPLATES) -> tuple[dict[str, tuple[float, list[tuple[int, float]]]], float]:
    """(token -> (idf, its unit weight in each template that has it)), and the idf of tokens that no template has."""
    bags = [Counter(_tokens(t)) for _, t in templates]
    n = len(bags)
    names = sorted({t for b in bags for t in b})
    idf = {t: math.log((1 + n) / (1 + sum(t in b for b in bags))) + 1 for t in names}
    norms = [math.sqrt(sum((c * idf[t]) ** 2 for t, c in b.items())) for b in bags]
    return {t: (idf[t], [(i, b[t] * idf[t] / k) for i, (b, k) in enumerate(zip(bags, norms, strict=True)) if t in b]) for t in names}, math.log(1 + n) + 1


def directory(path: Column) -> Column:
    """All before the last slash; empty at the top."""
    return F.regexp_replace(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), "/+$", "")


def declared(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per row of files (doc_id, path, text): doc_id, path, n_words, license and score of what declares it best, null if nothing does.

    Compared are headers: each line with a cue word on its own and with the lines after it, LINES in all; and of
    files named as licences the whole and each paragraph. Words that no template has count in the length, so
    prose about licences stays below LEAST. Of what is above, that counts which has most in common with its template, less for
    the words that it has besides: a licence that is whole wins over the part that it shares with a shorter one. Of templates
    with the same score the last name counts.
    """
    table, unknown = weights(templates)
    spark = files.sparkSession
    known = spark.createDataFrame([(t, i, w) for t, (i, w) in table.items()], "tok string, idf double, w array<struct<template:int,w:double>>")  # as long as the templates
    names = F.array(*[F.lit(name) for name, _ in templates])
    text = F.coalesce(ascii_lower(F.col("text")), F.lit(""))

    def headers(lines: Column) -> Column:
        n = F.size(lines)

        def at(i: Column) -> Column:
            some = F.transform(F.filter(F.array(*map(F.lit, LINES)), lambda k: (k == 1) | (i + k <= n)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(lines, i + 1, k), " ").alias("t")))
            return F.transform(F.filter(some, lambda x: (x["k"] == 1) | (F.char_length(x["t"]) <= HEADER_LETTERS)), lambda x: x["t"])

        return F.flatten(F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(lines, i).rlike(_CUE)), at))

    units = F.when(F.col("path").rlike(_NAME), F.array_distinct(F.concat(F.array(text), F.split(text, r"\n\s*\n")))).when(text.rlike(_CUE), headers(F.split(text, "\n")))
    n_words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    rows = (
        files.select("doc_id", "path", F.monotonically_increasing_id().alias("_row"), n_words.alias("n_words"), units.alias("_l"))
        .select("doc_id", "path", "_row", "n_words", F.posexplode_outer("_l").alias("unit", "_t"))
        .select("doc_id", "path", "_row", "n_words", "unit", F.explode_outer(F.filter(F.split("_t", "[^a-z0-9]+"), lambda x: x != "")).alias("tok"))
        .repartition("_row")
    )
    who = ["_row", "doc_id", "path", "n_words"]
    counts = rows.groupBy(*who, "unit", "tok").agg(F.count("tok").alias("tf")).join(F.broadcast(known), "tok", "left")
    weight = F.col("tf") * F.coalesce("idf", F.lit(unknown))
    square = F.struct(F.lit(-1).alias("template"), (weight * weight).alias("v"))  # template -1 sums up the length
    dots = F.transform(F.coalesce("w", F.array().cast("array<struct<template:int,w:double>>")), lambda x: F.struct(x["template"].alias("template"), (weight * x["w"]).alias("v")))
    sums = counts.select(*who, "unit", F.inline(F.concat(F.array(square), dots))).groupBy(*who, "unit", "template").agg(F.sum("v").alias("v"))
    best = F.max(F.when(F.col("template") >= 0, F.struct(F.round("v", 9).alias("v"), F.get(names, F.col("template")).alias("license"))))
    by_unit = sums.groupBy(*who, "unit").agg(best.alias("b"), F.max(F.when(F.col("template") < 0, F.sqrt("v"))).alias("norm"))
    # what all words of a unit have in common with a template grows with the unit; by its cosine, for what it has besides
    score = F.round(F.try_divide(F.col("b.v"), F.col("norm")), 6)
    cover = F.round(F.try_divide(F.col("b.v") * F.col("b.v"), F.col("norm")), 6)
    top = by_unit.groupBy(*who).agg(F.max(F.when(score >= LEAST, F.struct(cover.alias("cover"), F.col("b.license").alias("license"), score.alias("score")))).alias("b"))
    own = F.col("b.score").isNotNull()
    return top.select("doc_id", "path", "n_words", F.when(own, F.col("b.license")).alias("license"), F.when(own, F.col("b.score")).alias("score"))


def inherit(found: DataFrame) -> DataFrame:
    """Rows of ``declared`` with ``decided`` (own, inherited or none) and ``origin``, the path that the licence is from.

    A directory's licence is that of its file named as a licence, or of at most NOTICE_WORDS words: the highest
    score, then the first path. A file without its own takes the nearest ancestor directory's. Ancestors are
    listed once for each directory, and files meet their directory's licence in SALTS parts.
    """
    found = cut(found.withColumn("_dir", directory(F.col("path"))))
    speaks = F.col("path").rlike(_NAME) | (F.col("n_words") <= NOTICE_WORDS)
    first = F.min(F.struct((-F.col("score")).alias("s"), "path", "license"))
    said = found.where(F.col("license").isNotNull() & speaks).groupBy("_dir").agg(first.alias("f")).select(F.col("_dir").alias("_up"), F.col("f.path").alias("_from"), F.col("f.license").alias("_license"))
    parts = F.split("_dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    asked = found.where("license IS NULL AND _dir IS NOT NULL").select("_dir").distinct()
    near = (
        asked.select("_dir", F.explode(F.array_distinct(ups)).alias("_up")).join(said, "_up")
        .groupBy("_dir").agg(F.max_by(F.struct("_from", "_license"), F.length("_up")).alias("n")).select("_dir", "n._from", "n._license")
    )
    spread = near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = found.withColumn("_salt", F.pmod(F.xxhash64("path", "doc_id"), F.lit(SALTS)).cast("int"))
    out = rows.join(spread, ["_dir", "_salt"], "left")
    own = F.col("license").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("license", "_license").alias("license"), "score",
        F.when(own, "own").when(F.col("_license").isNotNull(), "inherited").otherwise("none").alias("decided"),
        F.when(own, F.col("path")).otherwise(F.col("_from")).alias("origin"),
    )


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, as a file named doc_id in the directory source/lang.

    Null source, lang or doc_id stand as "_"; a null or empty text declares nothing and may inherit; repeated
    rows are files of their own; extra columns are not read; an empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in ("source", "lang", "doc_id")])
    return inherit(declared(docs.select("doc_id", path.alias("path"), "text")))


QUERIES = {"op3_license": op3_license}


def _oracle() -> str:
    table, unknown = weights()
    values = ", ".join(f"('{t}', CAST({i!r} AS DOUBLE))" for t, (i, _) in table.items())
    parts = ", ".join(f"('{t}', {k}, CAST({x!r} AS DOUBLE))" for t, (_, w) in table.items() for k, x in w)
    names = ", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(TEMPLATES))
    wt = f"tf * coalesce(idf, CAST({unknown!r} AS DOUBLE))"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH k(tok, idf) AS (VALUES {values}), kw(tok, template, w) AS (VALUES {parts}), kn(template, license) AS (VALUES {names}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(CAST(doc_id AS VARCHAR), '_') AS path, {low} AS t FROM documents),
n AS (SELECT r, len(list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n_words FROM d),
l AS (SELECT r, string_split(t, chr(10)) AS ls FROM d WHERE regexp_matches(t, '{_CUE}')),
i AS (SELECT r, ls, i FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM l) WHERE regexp_matches(ls[i], '{_CUE}')),
u AS (SELECT r, i, k, array_to_string(ls[i:i + k - 1], ' ') AS t FROM (SELECT *, unnest({list(LINES)!r}) AS k FROM i) WHERE k = 1 OR i + k - 1 <= len(ls)),
u2 AS (SELECT row_number() OVER () AS unit, r, t FROM u WHERE k = 1 OR length(t) <= {HEADER_LETTERS}),
tk AS (SELECT r, unit, tok, count(*) AS tf FROM (SELECT r, unit, unnest(list_filter(string_split_regex(t, '[^a-z0-9]+'), lambda x: x <> '')) AS tok FROM u2) GROUP BY ALL),
s AS (SELECT r, unit, sqrt(sum(power({wt}, 2))) AS norm FROM tk LEFT JOIN k USING (tok) GROUP BY r, unit),
dt AS (SELECT unit, template, sum({wt} * w) AS v FROM tk JOIN k USING (tok) JOIN kw USING (tok) GROUP BY unit, template),
bu AS (SELECT unit, max({{'v': round(v, 9), 'license': license}}) AS b FROM dt JOIN kn USING (template) GROUP BY unit),
b AS (SELECT r, max({{'cover': round(bu.b.v * bu.b.v / norm, 6), 'license': bu.b.license, 'score': round(bu.b.v / norm, 6)}}) AS b FROM s JOIN bu USING (unit) WHERE round(bu.b.v / norm, 6) >= {LEAST} GROUP BY r),
f AS (SELECT d.r, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, n_words,
    b.b.license AS license, b.b.score AS score
  FROM d JOIN n USING (r) LEFT JOIN b USING (r)),
up AS (SELECT dir, arg_min({{'p': path, 'l': license}}, {{'s': -score, 'p': path}}) AS f FROM f WHERE license IS NOT NULL AND n_words <= {NOTICE_WORDS} GROUP BY dir),
m AS (SELECT a.dir, arg_max(up.f, length(up.dir)) AS f FROM (SELECT DISTINCT dir FROM f) a JOIN up ON up.dir = '' OR a.dir = up.dir OR starts_with(a.dir, up.dir || '/') GROUP BY a.dir)
SELECT doc_id, path, coalesce(license, m.f.l) AS license, score,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN m.f.l IS NOT NULL THEN 'inherited' ELSE 'none' END AS decided,
  CASE WHEN license IS NOT NULL THEN path ELSE m.f.p END AS origin
FROM f LEFT JOIN m ON f.dir = m.dir"""


ORACLE_SQL = {"op3_license": _oracle()}
