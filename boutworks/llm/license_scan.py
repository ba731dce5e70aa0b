"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from directories.

All of it is DataFrame functions. Candidates of a text with a licence cue, and of
every licence file by name, are its lines with a cue, these lines joined, its
blocks with a cue (lines between empty or comment-only ones, so that a notice may
be wrapped anyhow), and the whole text. A candidate's terms are counted inside its
row, joined to the fixed template weights, and summed for all templates at once:
one scan, and one row per candidate is shuffled. A candidate's best template at
``THRESHOLD`` or more is the file's own licence. A file without one takes that of
the nearest ancestor directory that has a licence file: distinct directories are
expanded to their ancestors and joined by path, so a directory with a third of all
files is one row there.

A licence file is one with a licence file's name, or one of which a candidate that
reaches the threshold holds at least ``NOTICE_SHARE`` of the words.

Templates are the usual notices, and the whole text of short licences. A long
licence's file is known by the notice that its appendix gives; whole texts of more
licences can be passed as ``templates``.

Defined cases: null or empty text has no licence of its own; a null path is the
root directory's unnamed file; equal scores go to the alphabetically first
licence; repeated rows each get the same result; very long texts are compared
whole; an empty table has an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutworks.runtime import staged

THRESHOLD = 0.6
NOTICE_SHARE = 0.8
CUE = r"(?i)licen[cs]e|copyright|spdx|permission is hereby|redistribut|warrant|public domain|rights reserved|free software"
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
TERM = "[a-z0-9]+"
#: What separates blocks: lines that are empty or hold comment marks alone.
GAP = r"\n[ \t\r#/*;!%-]*\n"

# The usual notices of common licences, by SPDX identifier.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal public domain dedication."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
]

# The standard texts of short licences, put together from their usual paragraphs.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_BSD = "Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "ISC License. Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ZLIB = "Copyright (c). This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
TEMPLATES += [("MIT", _MIT + _AS_IS), ("BSD-2-Clause", _BSD + _BSD_AS_IS), ("BSD-3-Clause", _BSD + _BSD_NAME + _BSD_AS_IS), ("ISC", _ISC), ("Zlib", _ZLIB), ("Unlicense", _UNLICENSE + _AS_IS)]


def template_weights(templates: list[tuple[str, str]] | None = None) -> tuple[dict[str, tuple[float, list[float]]], float]:
    """By term its idf and its weight in each template, all templates of unit length; and the idf of unknown terms."""
    templates = TEMPLATES if templates is None else templates
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    spread = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in sorted(spread.items())}
    norms = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for c in counts]
    return {t: (v, [c[t] * v / norm if norm else 0.0 for c, norm in zip(counts, norms, strict=True)]) for t, v in idf.items()}, math.log(1 + len(templates)) + 1


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _candidates(files: DataFrame) -> DataFrame:
    """(row, at, key, named, all_terms, term, count): the terms of what is compared with the templates."""
    with_cue = lambda parts: F.filter(parts, lambda x: x.rlike(CUE))
    found = files.where(F.col("text").rlike(CUE) | F.col("named")).withColumns({"lines": with_cue(F.split("text", "\n")), "blocks": with_cue(F.split("text", GAP))})
    joined = F.when(F.size("lines") > 1, F.array(F.array_join("lines", " "))).otherwise(F.array())
    listed = F.array_distinct(F.concat(F.col("lines"), joined, F.col("blocks"), F.array("text")))
    # equal rows stay apart by their number
    each = found.select(F.monotonically_increasing_id().alias("row"), "key", "named", F.size(_terms(F.col("text"))).alias("all_terms"), F.posexplode(listed).alias("at", "candidate"))
    # exploded from an array of one, so that the terms are sorted once and not inside the function below
    sorted_ = each.select("row", "at", "key", "named", "all_terms", F.explode(F.array(F.sort_array(_terms(F.col("candidate"))))).alias("terms"))
    # where each term's run begins in the sorted terms
    heads = F.filter(F.sequence(F.lit(1), F.size("terms")), lambda i: (i == 1) | (F.get(F.col("terms"), i - 2) != F.get(F.col("terms"), i - 1)))
    runs = sorted_.where(F.size("terms") > 0).withColumn("heads", heads)
    counted = runs.select("row", "at", "key", "named", "all_terms", F.posexplode("heads").alias("k", "head"), "terms", "heads")
    after = F.coalesce(F.get("heads", F.col("k") + 1), F.size("terms") + 1)
    return counted.select("row", "at", "key", "named", "all_terms", F.get("terms", F.col("head") - 1).alias("term"), (after - F.col("head")).alias("count"))


def own_licenses(files: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(key, license, score, is_file) of the files whose best candidate reaches the threshold."""
    names = [name for name, _ in (TEMPLATES if templates is None else templates)]
    known, unknown = template_weights(templates)
    # a fixed and small table: a row per term of the templates
    table = files.sparkSession.createDataFrame([(t, v, w) for t, (v, w) in known.items()], "term string, idf double, weights array<double>")
    weighed = _candidates(files).join(F.broadcast(table), "term", "left").withColumn("w", F.col("count") * F.coalesce("idf", F.lit(unknown)))
    dots = [F.sum(F.col("w") * F.coalesce(F.get("weights", F.lit(i)), F.lit(0.0))).alias(f"d{i}") for i in range(len(names))]
    # all terms of a candidate are in one task, so partial sums leave a row per candidate to shuffle
    sums = weighed.groupBy("row", "at", "key", "named", "all_terms").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("count").alias("n"), *dots)
    scores = F.array_min(F.array(*[F.struct((-F.round(F.col(f"d{i}") / F.col("norm"), 6)).alias("s"), F.lit(name).alias("license")) for i, name in enumerate(names)]))
    scored = sums.select("key", scores.alias("b"), "named", (F.col("n") >= NOTICE_SHARE * F.col("all_terms")).alias("most")).where(F.col("b.s") <= -THRESHOLD)
    best = scored.groupBy("key").agg(F.min("b").alias("b"), F.max(F.col("named") | F.col("most")).alias("is_file"))
    return best.select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "is_file")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """The id, path, license, score, origin (own, inherited or none) and from_dir of every file."""
    rows = files.select(F.col(id_col).alias("file_id"), F.coalesce(path_col, F.lit("")).alias("path"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.select(
        "*",
        F.regexp_replace("path", "/?[^/]*$", "").alias("dir"),
        F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME).alias("named"),
        F.struct("file_id", "path", F.xxhash64("text").alias("h")).alias("key"),
    )
    # texts stay behind; from here on rows are narrow
    own = staged(own_licenses(rows.select("key", "text", "named"), templates), "own-licences")
    holders = own.where("is_file").select(F.regexp_replace("key.path", "/?[^/]*$", "").alias("holder"), "license", "score")
    of_dir = holders.groupBy("holder").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("holder", F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    near = (
        rows.select("dir").distinct().select("dir", F.posexplode(ancestors).alias("distance", "holder")).join(of_dir, "holder")
        .groupBy("dir").agg(F.min(F.struct("distance", "holder", "dir_license", "dir_score")).alias("b")).select("dir", "b.*")
    )
    # stored first, so that the join can split a directory with very many files
    out = _join_key(rows.select("file_id", "path", "dir", "key"), own).join(staged(near, "near-licences"), "dir", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        F.col("file_id").alias(id_col),
        "path",
        F.coalesce("license", "dir_license").alias("license"),
        F.coalesce("score", "dir_score", F.lit(0.0)).alias("score"),
        F.when(mine, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine & F.col("dir_license").isNotNull(), F.col("holder")).alias("from_dir"),
    )


def _join_key(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Left join on the key; ids may be null, so the key is compared as one value."""
    right = own.select(F.col("key").alias("own_key"), "license", "score", "is_file")
    return rows.join(right, F.col("key").eqNullSafe(F.col("own_key")), "left").drop("key", "own_key")


def document_files(documents: DataFrame) -> DataFrame:
    """Documents as files: source / language / id."""
    part = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), "/", "_"), F.lit("unknown"))
    return documents.select("doc_id", F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")


def report(documents: DataFrame) -> DataFrame:
    return scan(document_files(documents))


def _sql() -> str:
    known, unknown = template_weights()
    double = lambda v: f"CAST({v!r} AS DOUBLE)"
    idf = ", ".join(f"('{t}', {double(v)})" for t, (v, _) in known.items())
    weights = ", ".join(f"({k}, '{name}', '{t}', {double(w[k])})" for t, (_, w) in known.items() for k, (name, _) in enumerate(TEMPLATES) if w[k])
    return f"""
WITH idf(term, idf) AS (VALUES {idf}),
postings(template, license, term, weight) AS (VALUES {weights}),
files AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         coalesce(replace(source, '/', '_'), 'unknown') || '/' || coalesce(replace(lang, '/', '_'), 'unknown') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'unknown') AS path
  FROM documents
), dirs AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
cues AS (SELECT r, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{CUE}')) AS lines,
                list_filter(regexp_split_to_array(text, '{GAP}'), lambda x: regexp_matches(x, '{CUE}')) AS blocks FROM files WHERE regexp_matches(text, '{CUE}')),
cand AS (
  SELECT r, unnest(range(1, len(c) + 1)) AS pos, unnest(c) AS candidate, all_terms
  FROM (SELECT r, list_distinct(list_concat(CASE WHEN len(lines) > 1 THEN list_append(lines, array_to_string(lines, ' ')) ELSE lines END, blocks, [text])) AS c,
               len(regexp_extract_all(lower(text), '{TERM}')) AS all_terms
        FROM cues)
), terms AS (
  SELECT r, pos, all_terms, term, count(*) AS n FROM (SELECT r, pos, all_terms, unnest(regexp_extract_all(lower(candidate), '{TERM}')) AS term FROM cand) GROUP BY ALL
), weighed AS (SELECT terms.*, terms.n * coalesce(idf, {double(unknown)}) AS w FROM terms LEFT JOIN idf USING (term)),
norms AS (SELECT r, pos, sqrt(sum(w * w)) AS norm, sum(n) >= {NOTICE_SHARE} * any_value(all_terms) AS most FROM weighed GROUP BY r, pos),
dots AS (SELECT r, pos, template, license, sum(w * weight) AS v FROM weighed JOIN postings USING (term) GROUP BY ALL),
scored AS (SELECT r, most, license, round(v / norm, 6) AS score FROM dots JOIN norms USING (r, pos) WHERE round(v / norm, 6) >= {THRESHOLD}),
best AS (SELECT r, bool_or(most) AS is_file, first(license ORDER BY score DESC, license) AS license, max(score) AS score FROM scored GROUP BY r),
holders AS (SELECT dir AS holder, first(license ORDER BY score DESC, license) AS dir_license, max(score) AS dir_score FROM best JOIN dirs USING (r) WHERE is_file GROUP BY dir),
up AS (SELECT dir, string_split(dir, '/') AS p, unnest(range(0, len(string_split(dir, '/')) + 1)) AS n FROM (SELECT DISTINCT dir FROM dirs)),
near AS (SELECT dir, holder, dir_license, dir_score FROM (
  SELECT dir, holder, dir_license, dir_score, row_number() OVER (PARTITION BY dir ORDER BY n DESC) AS k FROM up JOIN holders ON holders.holder = array_to_string(p[1:n], '/')) WHERE k = 1)
SELECT doc_id, path, coalesce(license, dir_license) AS license, coalesce(score, dir_score, CAST(0 AS DOUBLE)) AS score,
       CASE WHEN license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN license IS NULL AND dir_license IS NOT NULL THEN holder END AS from_dir
FROM dirs LEFT JOIN best USING (r) LEFT JOIN near USING (dir)
"""


SQL = _sql()
