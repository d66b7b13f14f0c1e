"""License scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance along paths; DataFrame operations only.

The passages of a text are its lines, its sentences (which run over line ends and comment marks, up to an empty line) and the
whole of it. Each passage is compared with the templates, which are notices and whole licence texts. A term weighs
``1 + ln(count)`` times its idf over all files read, so common words weigh little; a term in no template weighs the mean idf of the templates'
terms. A passage carries the license of the template with the highest cosine of at least ``THRESHOLD``, of equals the
alphabetically first; where templates differ in a version number alone, that number therefore decides. Only passages with an
anchor term are looked at: the terms of a template that are no anchors make a vector shorter than the threshold, so that no
passage without an anchor can reach it.

A file that as a whole carries a license, or has a passage with one and whose name says so (``LICENSE``, ``COPYING``,
``NOTICE`` with any ending), is a licence file: its license holds for its directory and all below. Other files with such a
passage have a header, which holds for the file alone. A file without a license of its own takes that of its nearest
ancestor directory that has one; ancestors are found by equi-joins of directory names. Of several licenses in a file or a
directory the one with the highest score counts, then the alphabetically first.

Null and empty texts have no license of their own. Null paths inherit nothing. Files are matched by path and a hash of the
text; repeated rows stay. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kbforge.functions.storage import materialize

THRESHOLD = 0.6
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions:"""
_MIT = f"""MIT License. Copyright (c). {_GRANT}
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_ALL = f"""ISC License. Copyright (c). {_ISC}
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_BSD_TWO = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version %s of the License, or (at your option) any later version."""
_LESSER = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version %s of the License, or (at your option) any later version."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License."""
_APACHE_ALL = f"""{_APACHE} You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""
_CC = "This work is licensed under a Creative Commons %s International License"
#: License identifier and a template, which is a notice or a licence's text.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE_ALL),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_TWO} {_BSD_END}"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", _BSD),
    ("BSD-3-Clause", f"{_BSD} {_BSD_TWO} {_BSD_THIRD} {_BSD_END}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", _CC % "Attribution 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", _CC % "Attribution-NonCommercial 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", _CC % "Attribution-ShareAlike 4.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0", _GNU % "2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", _GNU % "3"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", _ISC),
    ("ISC", _ISC_ALL),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("LGPL-2.1", _LESSER % "2.1"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("LGPL-3.0", _LESSER % "3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", _GRANT),
    ("MIT", _MIT),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("Unlicense", _UNLICENSE),
)
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
#: An empty line, a line's end with the comment marks of the next line, and the end of a sentence.
GAP, WRAP, STOP = "\n[ \t\r#/*;>%-]*\n", "\n[ \t\r#/*;>%-]*", "[.!?][ \t\r]+"
LINE, SENTENCE, WHOLE = 0, 1, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Directories that may be broadcast, a few hundred bytes each.
BROADCAST_DIRECTORIES = 200_000


class Weights:
    """Weights of the templates' terms, given in how many of ``n`` files each stands; as large as the list of templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...], n: int, files_with: dict[str, int], threshold: float = THRESHOLD):
        own = [(name, Counter(terms_of(text))) for name, text in templates]
        self.idf = {t: math.log((n + 1) / (files_with.get(t, 0) + 1)) + 1 for _, terms in own for t in terms}
        self.other = sum(self.idf.values()) / max(len(self.idf), 1)
        self.rows: list[tuple[str, int, str, float]] = []
        anchors = set()
        for k, (name, terms) in enumerate(own):
            weight = {t: (1 + math.log(count)) * self.idf[t] for t, count in terms.items()}
            norm = math.sqrt(sum(w * w for w in weight.values()))
            self.rows += [(name, k, t, w / norm) for t, w in weight.items()]
            # What may be left out: the lightest, while their part stays below the threshold.
            left = 0.0
            for t, w in sorted(weight.items(), key=lambda x: (x[1], x[0])):
                if left + (w / norm) ** 2 < (0.999 * threshold) ** 2:
                    left += (w / norm) ** 2
                else:
                    anchors.add(t)
        self.anchors = sorted(anchors)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "license string, template int, term string, weight double")


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.translate(str.maketrans(_UPPER, _LOWER)))


def _folded(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def weights(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> Weights:
    """In how many files each term of the templates stands: as many rows reach the driver as the templates have terms."""
    words = F.array(*map(F.lit, sorted({t for _, text in templates for t in terms_of(text)})))
    own = files.filter("text IS NOT NULL").select(F.explode(F.array_append(F.array_intersect(_terms(_folded(F.col("text"))), words), F.lit(""))).alias("term"))
    counts = dict(own.groupBy("term").count().collect())
    return Weights(templates, counts.pop("", 0), counts, threshold)


def _holds(text: Column, anchors: list[str]) -> Column:
    return F.arrays_overlap(_terms(text), F.array(*map(F.lit, anchors)))


def passages(folded: Column) -> Column:
    """``kind, words`` of the lines, the sentences and the whole of a lower-cased text."""
    sentences = F.split(F.regexp_replace(F.regexp_replace(folded, GAP, ". "), WRAP, " "), STOP)
    named = lambda kind, found: F.transform(found, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("words")))
    return F.concat(named(LINE, F.split(folded, "\n")), named(SENTENCE, sentences), named(WHOLE, F.array(folded)))


def found_passages(files: DataFrame, known: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """``_p, _h, at, kind, license, score`` of the passages that carry a license; ``files`` has ``_p, _h, text``."""
    spark = files.sparkSession
    folded = _folded(F.col("text"))
    some = files.filter(_holds(folded, known.anchors)).dropDuplicates(["_p", "_h"]).select("_p", "_h", F.posexplode(passages(folded)).alias("at", "own"))
    held = some.select("_p", "_h", "at", "own.kind", "own.words").filter(_holds(F.col("words"), known.anchors))
    terms = held.select("_p", "_h", "at", "kind", F.explode(_terms(F.col("words"))).alias("term"))
    idf = spark.createDataFrame(list(known.idf.items()), "term string, idf double")
    counts = terms.groupBy("_p", "_h", "at", "kind", "term").agg(F.count("*").alias("n")).join(F.broadcast(idf), "term", "left")
    # A passage's vector is one row, and the templates' terms are looked up where it is.
    w = (1 + F.log(F.col("n"))) * F.coalesce("idf", F.lit(known.other))
    vectors = counts.groupBy("_p", "_h", "at", "kind").agg(F.sqrt(F.sum(w * w)).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", w.alias("w")))).alias("vector"))
    each = vectors.select("_p", "_h", "at", "kind", "norm", F.explode("vector").alias("v")).select("_p", "_h", "at", "kind", "norm", "v.term", "v.w")
    dots = each.join(F.broadcast(known.table(spark)), "term").groupBy("_p", "_h", "at", "kind", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.first("norm").alias("norm"))
    near = dots.withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= threshold)
    best = near.groupBy("_p", "_h", "at", "kind").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("best"))
    return best.select("_p", "_h", "at", "kind", "best.license", (-F.col("best.less")).alias("score"))


def directories(path: Column) -> Column:
    """The directory of a path and its ancestors, nearest first; the empty name is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``path, own_license, score, n_license_lines, is_licence_file, inherited_license, license`` and the id of each file.

    ``files`` has ``doc_id, path, text``.
    """
    rows = files.select("doc_id", "path", "text", F.coalesce("path", F.lit("\x01")).alias("_p"), F.xxhash64("text").alias("_h"))
    found = found_passages(rows.select("_p", "_h", "text"), weights(files, templates, threshold), threshold)
    own = found.groupBy("_p", "_h").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("best"), F.count_if(F.col("kind") == LINE).alias("n_license_lines"), F.max(F.col("kind") == WHOLE).alias("whole"))
    joined = rows.select("doc_id", "path", "_p", "_h").join(own, ["_p", "_h"], "left")
    named = F.coalesce(F.col("path").rlike(NAME), F.lit(False)) & F.col("best").isNotNull()
    whole = joined.select(
        "doc_id", "path", F.col("best.license").alias("own_license"), (-F.col("best.less")).alias("score"), F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"),
        (named | F.coalesce("whole", F.lit(False))).alias("is_licence_file"), F.get(directories(F.col("path")), F.lit(0)).alias("_dir"),
    )
    each = materialize(whole, "licenses")

    holds = each.filter("is_licence_file AND path IS NOT NULL").groupBy("_dir").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("own_license").alias("license"))).alias("top"))
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("_dir") == "", 0).otherwise(F.size(F.split("_dir", "/")))), lambda n: F.array_join(F.slice(F.split("_dir", "/"), F.lit(1), n), "/"))
    asks = each.filter("_dir IS NOT NULL").select("_dir").distinct().select(F.col("_dir").alias("_at"), F.explode(above).alias("_dir"))
    nearest = asks.join(holds, "_dir").groupBy("_at").agg(F.max_by("top", F.length("_dir"))["license"].alias("inherited_license"))
    given = materialize(nearest.withColumnRenamed("_at", "_dir"), "directories")
    given = F.broadcast(given) if given.count() <= BROADCAST_DIRECTORIES else given
    license_ = F.coalesce("own_license", "inherited_license")
    return each.join(given, "_dir", "left").select("doc_id", "path", "own_license", "score", "n_license_lines", "is_licence_file", "inherited_license", license_.alias("license"))


def with_paths(docs: DataFrame) -> DataFrame:
    """The documents as files ``source/lang/hundreds of the id/id``; unknown parts are a hyphen."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    hundreds = F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("-"))
    return docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), hundreds, part("doc_id")).alias("path"), "text")


def sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same over all passages, without anchors, from the templates' texts."""
    quoted = lambda text: "'" + text.replace("'", "''").replace("\n", " ") + "'"
    values = ", ".join(f"('{name}', {k}, {quoted(text)})" for k, (name, text) in enumerate(templates))
    folded = lambda c: f"translate({c}, '{_UPPER}', '{_LOWER}')"
    return rf"""
WITH forms(license, template, body) AS (VALUES {values}),
formed AS (SELECT license, template, term, count(*) AS n FROM (SELECT license, template, unnest(regexp_extract_all({folded('body')}, '{TERM}')) AS term FROM forms) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rid, doc_id, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), coalesce((doc_id // 100)::VARCHAR, '-'), coalesce(doc_id::VARCHAR, '-')) AS path, {folded('text')} AS t FROM documents),
spread AS (SELECT term, count(DISTINCT rid) AS df FROM (SELECT rid, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d) GROUP BY term),
idfs AS (SELECT term, ln(((SELECT count(t) FROM d) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM formed) LEFT JOIN spread USING (term)),
weights AS (SELECT license, template, term, (1 + ln(n)) * idf / sqrt(sum(((1 + ln(n)) * idf) ** 2) OVER (PARTITION BY template)) AS weight FROM formed JOIN idfs USING (term)),
l AS (SELECT rid, 0 AS kind, unnest(range(len(x))) AS line, unnest(x) AS s FROM (SELECT rid, string_split(t, chr(10)) AS x FROM d)
      UNION ALL SELECT rid, 1, unnest(range(len(x))), unnest(x) FROM (SELECT rid, string_split_regex(regexp_replace(regexp_replace(t, '{GAP}', '. ', 'g'), '{WRAP}', ' ', 'g'), '{STOP}') AS x FROM d)
      UNION ALL SELECT rid, 2, 0, t FROM d),
w AS (SELECT rid, kind, line, term, (1 + ln(count(*))) * coalesce(any_value(idf), (SELECT avg(idf) FROM idfs)) AS w
      FROM (SELECT rid, kind, line, unnest(regexp_extract_all(s, '{TERM}')) AS term FROM l) LEFT JOIN idfs USING (term) GROUP BY rid, kind, line, term),
norm AS (SELECT rid, kind, line, sqrt(sum(w * w)) AS norm FROM w GROUP BY rid, kind, line),
near AS (SELECT rid, kind, line, license, round(sum(w * weight) / any_value(norm), 6) AS score FROM w JOIN weights USING (term) JOIN norm USING (rid, kind, line) GROUP BY rid, kind, line, template, license),
best AS (SELECT * FROM near WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY rid, kind, line ORDER BY score DESC, license) = 1),
own AS (SELECT rid, count(*) FILTER (kind = 0) AS n, bool_or(kind = 2) AS whole, max(score) AS score FROM best GROUP BY rid),
e AS (SELECT d.rid, doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, (SELECT min(license) FROM best WHERE best.rid = d.rid AND best.score = own.score) AS own_license,
             own.score, coalesce(n, 0) AS n_license_lines, coalesce(whole, false) AS is_licence_file
      FROM d LEFT JOIN own USING (rid)),
holds AS (SELECT dir AS loc, own_license AS inherited FROM e WHERE is_licence_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, own_license) = 1),
given AS (SELECT dir, inherited FROM (SELECT DISTINCT dir FROM e) JOIN holds ON loc = dir OR loc = '' OR starts_with(dir, loc || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(loc) DESC) = 1)
SELECT doc_id, path, own_license, score, n_license_lines, is_licence_file, inherited AS inherited_license, coalesce(own_license, inherited) AS license FROM e LEFT JOIN given USING (dir)
"""
