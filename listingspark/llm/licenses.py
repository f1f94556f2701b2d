"""Operator 9, licence scans of pages, with DataFrame functions only.

A page's HTML is cut into units: lines, paragraphs (between block tags or blank lines) and sentences, each distinct text once; of a
licence file the whole text is a unit too. Units and licence templates are TF-IDF vectors over words `[a-z0-9]+`: tf * idf,
idf = ln((1 + units) / (1 + units with the word)) + 1 for words of templates, counted over all units of all pages; any other word
weighs as one in no unit. A page declares the licence of its unit with the greatest cosine to a template, if that is at least LIKENESS
(ties: the smaller licence id). Templates, several for each id, are a parameter: notices, headers, licence bodies and paragraphs.

Other pages inherit. A licence file is a page whose file name is a licence or index name, or whose path ends with `/`. If it declares
a licence, this holds in its directory; where files of a directory differ, the greatest cosine decides, then the smaller id. A page
takes the licence of its own path as a directory, else of the nearest directory above it on the same host.

Pages are cleaned once, numbered and written to the shared folder; rows are told apart by these numbers, so repeated and null keys do
no harm. Only units with an anchor word are scored: without one, the rest of any template is too light to reach LIKENESS, so no match is
lost. The broadcast tables are templates (a parameter, some tens of kilobytes). Directories are resolved once each, before pages join them;
rows of a directory are dealt by a salt of the pages below it, so that one host's root isn't one task's.
A null URL has an empty host and directory `/`, and inherits nothing; null or empty HTML declares nothing.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.llm.arrays import staged
from listingspark.llm.url_filter import split_url

LIKENESS, SALTS = 0.75, 16
#: Licence notices, headers, bodies and paragraphs by SPDX id.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license. Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Creative Commons Attribution 4.0 International Public License",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "GPL-3.0-only": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-3.0-only": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "MIT": (
        "Released under the MIT License.",
        "MIT License",
        "This project is released under the MIT License.",
        "Licensed under the MIT License. See the LICENSE file in the project root for license information.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
SCRIPTS = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(p|br|div|li|h[1-6]|article|footer|nav|td|tr|table|ul)[^>]*>"
FILES = r"(?i)^(licen[cs]e|copying|notice|index|default)([.].*)?$"
#: Where a text is cut into lines, into paragraphs, and into sentences.
CUTS = (r"\n", r"\n[ \t]*\n", r"[.!?][ \t\n]+|\n[ \t]*\n")


def plain_text(html: Column) -> Column:
    """The text between tags in lower case, with blank lines where blocks part."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), SCRIPTS, " "), BREAKS, "\n\n")
    text = F.regexp_replace(F.lower(F.regexp_replace(text, r"<[^>]*>", " ")), r"&[a-z0-9#]+;", " ")
    return F.regexp_replace(text, r"\r\n?", "\n")


def units_of(text: Column, is_file: Column) -> Column:
    """The distinct lines, paragraphs and sentences, and a file's whole text, as words parted by one blank. The text is a column that is there: it is read four times."""
    parts = F.concat(*[F.split(text, cut) for cut in CUTS], F.when(is_file, F.array(text)).otherwise(F.array().cast("array<string>")))
    return F.filter(F.array_distinct(F.transform(F.array_distinct(parts), lambda t: F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " ")))), lambda t: t != "")


def _anchors(weights: list[dict[str, float]], idf: dict[str, float], likeness: float) -> list[str]:
    """Words without which no template keeps `likeness` of its length, the rarest first, so that few units have one."""
    chosen: set[str] = set()
    for vector in weights:
        rest = sum(w * w for w in vector.values())
        bound = likeness * likeness * rest * 0.999
        for word, w in sorted(vector.items(), key=lambda x: (-idf[x[0]], x[0])):
            if rest < bound:
                break
            chosen.add(word)
            rest -= w * w
    return sorted(chosen)


def declared(units: DataFrame, templates: dict[str, tuple[str, ...]], likeness: float = LIKENESS) -> DataFrame:
    """units: (row, units). (row, license_id, score) of the rows that declare a licence."""
    listed = [(k, Counter(re.findall("[a-z0-9]+", t.lower()))) for k, texts in sorted(templates.items()) for t in texts]
    vocabulary = sorted({w for _, counts in listed for w in counts})
    blocks = units.select("row", F.posexplode("units").alias("at", "unit")).select("row", "at", F.split("unit", " ").alias("words"))
    # the count of all units travels as the word ''
    seen = blocks.select(F.explode(F.concat(F.array(F.lit("")), F.filter(F.array_distinct("words"), lambda w: w.isin(vocabulary)))).alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()
    df = {r["word"]: r["df"] for r in seen}
    total = df.get("", 0)
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    other = math.log(1 + total) + 1
    weights = [{w: n * idf[w] for w, n in counts.items()} for _, counts in listed]
    length = [math.sqrt(sum(w * w for w in v.values())) for v in weights]
    table = [{"word": w, "idf": x, "units": [{"t": i, "unit": v[w] / length[i]} for i, v in enumerate(weights) if w in v]} for w, x in idf.items()]
    known = units.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table)), "array<struct<word:string,idf:double,units:array<struct<t:int,unit:double>>>>")))
    anchors = _anchors(weights, idf, likeness)
    scored = blocks.where(F.exists("words", lambda w: w.isin(anchors)))
    terms = scored.select("row", "at", F.explode("words").alias("word")).groupBy("row", "at", "word").agg(F.count("*").alias("tf"))
    joined = terms.join(F.broadcast(known), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    # a unit's product with itself travels as template -1
    own = F.array(F.struct(F.lit(-1).alias("t"), F.col("w").alias("unit")))
    products = joined.select("row", "at", "w", F.explode(F.when(F.col("units").isNull(), own).otherwise(F.concat(own, "units"))).alias("x"))
    products = products.groupBy("row", "at", F.col("x.t").alias("t")).agg(F.sum(F.col("w") * F.col("x.unit")).alias("s"))
    dots = products.groupBy("row", "at").agg(F.max(F.when(F.col("t") < 0, F.col("s"))).alias("square"), F.collect_list(F.when(F.col("t") >= 0, F.struct("t", "s"))).alias("dots"))
    names = F.array(*[F.lit(k) for k, _ in listed])
    best = dots.select("row", "square", F.explode("dots").alias("d")).select("row", F.struct(F.get(names, F.col("d.t")).alias("license_id"), F.round(F.col("d.s") / F.sqrt("square"), 6).alias("score")).alias("o"))
    return best.where(F.col("o.score") >= likeness).groupBy("row").agg(F.min_by("o", F.struct(-F.col("o.score"), F.col("o.license_id"))).alias("o")).select("row", "o.license_id", "o.score")


def license_scan(pages: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, key: str = "page_id", url: str = "url", html: str = "html", likeness: float = LIKENESS) -> DataFrame:
    """(key, directory, license_id, score, origin, license_directory) of every row; origin is header, inherited or none."""
    host, path = split_url(F.col(url))
    path = F.when(path == "", "/").otherwise(path)
    place = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    place = place.withColumn("file", F.regexp_extract("path", r"[^/]*$", 0)).withColumn("is_file", (F.col("file") == "") | F.col("file").rlike(FILES))
    place = place.select("row", "key", "host", "is_file", F.concat("host", F.regexp_extract("path", r"^.*/", 0)).alias("directory"), F.concat("host", F.rtrim(F.col("path"), F.lit("/")), F.lit("/")).alias("self"), plain_text(F.col("html")).alias("text"))
    place = staged(place.withColumn("units", units_of(F.col("text"), F.col("is_file"))).drop("text"), "units")
    own = declared(place.select("row", "units"), templates or TEMPLATES, likeness)
    all_pages = staged(place.drop("units").join(own, "row", "left"), "declared")
    holds = all_pages.where(F.col("license_id").isNotNull() & F.col("is_file") & (F.col("host") != "")).groupBy("directory").agg(F.min_by(F.struct("license_id", "score"), F.struct(-F.col("score"), F.col("license_id"))).alias("held"))
    holds = holds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    bare = all_pages.where(F.col("license_id").isNull() & (F.col("host") != "")).select("self").distinct()
    parts = F.split(F.col("self"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    above = bare.select("self", F.pmod(F.hash("self"), F.lit(SALTS)).alias("salt"), F.explode(above).alias("directory"))
    found = above.join(holds, ["directory", "salt"]).groupBy("self").agg(F.max_by(F.struct("directory", "held"), F.length("directory")).alias("nearest"))
    out = all_pages.join(found, "self", "left")
    inherits = F.col("license_id").isNull() & F.col("nearest").isNotNull()
    return out.select(
        F.col("key").alias(key), "directory",
        F.when(inherits, F.col("nearest.held.license_id")).otherwise(F.col("license_id")).alias("license_id"),
        F.when(inherits, F.col("nearest.held.score")).otherwise(F.col("score")).alias("score"),
        F.when(inherits, "inherited").when(F.col("license_id").isNotNull(), "header").otherwise("none").alias("origin"),
        F.when(inherits, F.col("nearest.directory")).alias("license_directory"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = (
    "WITH templates(n, license_id, t) AS (VALUES " + ", ".join(f"({i}, {_quoted(k)}, {_quoted(t)})" for i, (k, t) in enumerate((k, t) for k, texts in TEMPLATES.items() for t in texts)) + r"""
), tw AS (SELECT n AS template, license_id, word, count(*) AS tf FROM (SELECT n, license_id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS word FROM templates) GROUP BY ALL
), urls AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(nullif(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2), ''), '/') AS path FROM pages
), files AS (
  SELECT *, regexp_extract(path, '[^/]*$') AS file, file = '' OR regexp_matches(file, '(?i)^(licen[cs]e|copying|notice|index|default)([.].*)?$') AS is_file FROM urls
), cleaned AS (
  SELECT page_id, is_file, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'),
    '(?i)</?(p|br|div|li|h[1-6]|article|footer|nav|td|tr|table|ul)[^>]*>', chr(10) || chr(10), 'g'), '<[^>]*>', ' ', 'g')), '&[a-z0-9#]+;', ' ', 'g'), '\r\n?', chr(10), 'g') AS t FROM files
), blocks AS (
  SELECT page_id, generate_subscripts(u, 1) AS pos, string_split(unnest(u), ' ') AS words FROM (
    SELECT page_id, list_filter(list_distinct(list_transform(list_concat(regexp_split_to_array(t, '\n'), regexp_split_to_array(t, '\n[ \t]*\n'), regexp_split_to_array(t, '[.!?][ \t\n]+|\n[ \t]*\n'), CASE WHEN is_file THEN [t] ELSE [] END),
      lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')))), lambda x: x <> '') AS u FROM cleaned)
), bw AS (SELECT page_id, pos, word, count(*) AS tf FROM (SELECT page_id, pos, unnest(words) AS word FROM blocks) GROUP BY ALL
), n AS (SELECT count(*) AS n FROM blocks
), df AS (SELECT word, count(*) AS df FROM bw GROUP BY word
), idf AS (SELECT DISTINCT tw.word, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM tw CROSS JOIN n LEFT JOIN df ON df.word = tw.word
), tv AS (SELECT template, license_id, word, tf * idf AS w FROM tw JOIN idf USING (word)
), tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tv GROUP BY 1
), bv AS (SELECT page_id, pos, bw.word, tf * coalesce(idf, ln(1 + n) + 1) AS w FROM bw CROSS JOIN n LEFT JOIN idf ON idf.word = bw.word
), bn AS (SELECT page_id, pos, sqrt(sum(w * w)) AS norm FROM bv GROUP BY ALL
), dots AS (SELECT page_id, pos, template, license_id, sum(bv.w * tv.w) AS dot FROM bv JOIN tv ON bv.word = tv.word GROUP BY ALL
), scores AS (SELECT page_id, license_id, round(dot / bn.norm / tn.norm, 6) AS score FROM dots JOIN bn USING (page_id, pos) JOIN tn USING (template)
), own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, license_id) AS k FROM scores WHERE score >= 0.75) WHERE k = 1
), place AS (
  SELECT f.page_id, host, is_file, host || regexp_extract(path, '^.*/') AS directory, host || rtrim(path, '/') || '/' AS self, license_id, score
  FROM files f LEFT JOIN own o ON o.page_id = f.page_id
), holds AS (SELECT * FROM (
  SELECT directory, license_id, score, row_number() OVER (PARTITION BY directory ORDER BY score DESC, license_id) AS k FROM place WHERE license_id IS NOT NULL AND host <> '' AND is_file) WHERE k = 1
), near AS (SELECT * FROM (
  SELECT p.self, h.directory, h.license_id, h.score, row_number() OVER (PARTITION BY p.self ORDER BY length(h.directory) DESC) AS k
  FROM (SELECT DISTINCT self FROM place WHERE license_id IS NULL AND host <> '') p JOIN holds h ON starts_with(p.self, h.directory)) WHERE k = 1
)
SELECT p.page_id, p.directory, coalesce(p.license_id, n.license_id) AS license_id, coalesce(p.score, n.score) AS score,
       CASE WHEN p.license_id IS NOT NULL THEN 'header' WHEN n.self IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN p.license_id IS NULL THEN n.directory END AS license_directory
FROM place p LEFT JOIN near n ON n.self = p.self AND p.license_id IS NULL
"""
)
