"""License scans: MinHash bands over overlapping windows retrieve license
templates, exact containment of word shingles verifies them.

Words are runs of ``a-z`` and digits of the lower-cased text, a shingle is five
of them. For a template of m shingles a text is cut into windows of 2m shingles
that start every m. A window retrieves the templates of its length with which
it shares a band: one of ``BANDS`` minima, each under a hash function of its
own. What it retrieves is verified over the window and its neighbours, m
shingles on either side: a window that holds at least ``PART`` of the
template's shingles, in a region that holds at least ``LEAST`` of them, is a
find. Words may be inserted until the copy is twice as long: it then lies in
the regions of two windows, and one of them has at least ``PART`` of it.

A window with a share c of the template's shingles has a Jaccard similarity of
at least c / (3 - c) and is passed over with a probability of at most
(1 - c / (3 - c)) ** BANDS: 7e-7 at 0.8, 1e-4 at 0.6, 5e-3 at 0.4.

A band can only agree in a window that holds the shingle with the template's
minimum, so texts, and then windows, without any such shingle are passed over
before their minima are computed; that leaves no band out.

Templates are a small table of reference texts: ``TEMPLATES``, or what the
caller gives; :func:`common_texts` has the common licenses, long ones cut into
passages, so that a part of a license is found without its opening. Only
DataFrame functions are used on the documents.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.llm.quality import let

SHINGLE = 5
LEAST = 0.8
#: Share of a template that the retrieving window itself must hold.
PART = LEAST / 2
BANDS = 32
TOKEN = "[a-z0-9]+"

#: Wordings of license notices: fixed values, as published with the licenses.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
           "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
               "option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
           "the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
             "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
             "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
             "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")


def _gnu(kind: str, version: str) -> str:
    """So short that another kind or version leaves less than ``LEAST`` of it."""
    return (f"under the terms of the GNU {kind} General Public License as published by the Free Software Foundation, either version "
            f"{version} of the License")


def _cc(name: str) -> str:
    return f"This work is licensed under a Creative Commons {name} 4.0 International License."


#: Notices beside ``TEMPLATES`` (``gpl-3.0`` in its place: its whole paragraph is
#: found in those of other versions), and the texts of short licenses by paragraph.
#: Three-clause BSD is the two-clause text with the clause of ``bsd-3-clause``.
NOTICES = {
    "mit-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
                      "of the Software.",
    "mit-warranty": _WARRANTY,
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                           "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                           "implied. See the License for the specific language governing permissions and limitations under the "
                           "License.",
    "bsd-2-clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                    "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                    "and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "nor the names of its contributors may be used to endorse or promote products derived from this software without "
                    "specific prior written permission.",
    "bsd-warranty": "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
                    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
                    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
                    "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
                    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
                    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
                    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
                    "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
                    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "gnu-warranty": "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-2.0-only": "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-2.0-only-2": "under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the "
                      "License",
    "gpl-2.0": _gnu("", "2"),
    "gpl-3.0": _gnu("", "3"),
    "lgpl-2.0": _gnu("Library", "2"),
    "lgpl-2.1": _gnu("Lesser", "2.1"),
    "lgpl-3.0": _gnu("Lesser", "3"),
    "agpl-3.0": _gnu("Affero", "3"),
    "cc-by-sa-4.0": _cc("Attribution-ShareAlike"),
    "cc-by-nd-4.0": _cc("Attribution-NoDerivatives"),
    "cc-by-nc-4.0": _cc("Attribution-NonCommercial"),
    "cc-by-nc-sa-4.0": _cc("Attribution-NonCommercial-ShareAlike"),
    "cc-by-nc-nd-4.0": _cc("Attribution-NonCommercial-NoDerivatives"),
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
}
#: Words of a passage of a long text.
PASSAGE = 200


def passages(name: str, text: str) -> dict[str, str]:
    """A text as ``name/000`` and so on, of ``PASSAGE`` words each; the last
    one reaches back into the one before, so that no word is left out."""
    words = re.findall(TOKEN, text.lower())
    starts = [min(i, max(0, len(words) - PASSAGE)) for i in range(0, len(words), PASSAGE)]
    return {f"{name}/{k:03}": " ".join(words[i:i + PASSAGE]) for k, i in enumerate(starts)}


def common_texts() -> dict[str, str]:
    """``TEMPLATES``, ``NOTICES`` and the passages of the files in ``license_texts``."""
    found = TEMPLATES | NOTICES
    for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        found = found | passages(f.stem, f.read_text(encoding="utf-8"))
    return found


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def hashes(words: Column) -> Column:
    """Hash of every shingle, in text order."""
    places = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    return F.when(F.size(words) < SHINGLE, F.array().cast("array<bigint>")).otherwise(
        F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])))


def texts(words: Column) -> Column:
    """Every shingle as text."""
    places = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    return F.when(F.size(words) < SHINGLE, F.array().cast("array<string>")).otherwise(
        F.transform(places, lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " ")))


def minimum(shingles: Column, band: Column) -> Column:
    """The smallest (hash under the band's function, shingle)."""
    return F.array_min(F.transform(shingles, lambda x: F.struct(F.xxhash64(x, band).alias("v"), x.alias("x"))))


def templates(spark, texts_by_name: dict[str, str] | DataFrame = TEMPLATES) -> list:
    """Per template: name, shingles m, their texts, and the minimum of each band."""
    df = texts_by_name if isinstance(texts_by_name, DataFrame) else \
        spark.createDataFrame(list(texts_by_name.items()), "license string, text string")
    x = df.select("license", let(tokens(F.col("text")), lambda w: F.struct(
        F.array_distinct(texts(w)).alias("texts"), hashes(w).alias("h"))).alias("t"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: minimum(F.col("t.h"), j))
    return x.select("license", F.size("t.h").alias("m"), "t.texts", bands.alias("bands")).collect()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         texts_by_name: dict[str, str] | DataFrame = TEMPLATES) -> DataFrame:
    """One row per document and license found: ``(<id>, license, containment,
    at_word)``: the largest share of the template's shingles in one region, and
    the first word of the first window whose region holds ``LEAST`` of them.
    ``texts_by_name`` has the templates, as a dict or a table ``(license, text)``.

    Null and empty texts, and those of fewer than five words, hold nothing.
    Rows with equal ids, or with null ids, are reported together. A template of
    fewer than five words is an error. An empty table gives no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    known = templates(spark, texts_by_name)
    if any(not t.m for t in known):
        raise ValueError("a template needs five words at least")
    # the template tables are as large as the list of templates, whatever the documents
    bands = F.broadcast(spark.createDataFrame([(t.m, j, b.v, t.license) for t in known for j, b in enumerate(t.bands)],
                                              "m int, band int, value long, license string"))
    full = F.broadcast(spark.createDataFrame([(t.license, t.texts) for t in known], "license string, texts array<string>"))
    starts = {}
    for t in known:
        starts.setdefault(t.m, set()).update(b.x for b in t.bands)
    marks = lambda values: F.split(F.lit(",".join(map(str, sorted(values)))), ",").cast("array<bigint>")
    every = marks(set().union(*starts.values()))
    x = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    x = x.withColumn("h", let(F.col("w"), hashes)).where(F.arrays_overlap("h", every))

    def cuts(m: int, own: Column) -> Column:
        """Windows for templates of ``m`` shingles that hold one of ``own``."""
        window = lambda at: F.struct(F.lit(m).alias("m"), at.alias("at"), F.slice(F.col("h"), at + 1, 2 * m).alias("h"))
        every_m = F.sequence(F.lit(0), F.size("h") - 1, F.lit(m))
        return F.filter(F.transform(every_m, window), lambda c: F.arrays_overlap(c["h"], own))

    found = F.concat(*[cuts(m, marks(v)) for m, v in sorted(starts.items())])
    windows = x.select("id", "w", F.explode(found).alias("c"))
    # the words of the window and of its neighbours, and how many of them come before the window
    before = F.least(F.col("c.m"), F.col("c.at"))
    windows = windows.select("id", "c.m", "c.at", "c.h", before.alias("before"), F.slice(
        F.col("w"), F.col("c.at") - before + 1, before + 3 * F.col("c.m") + SHINGLE - 1).alias("w"))
    sketch = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: minimum(F.col("h"), j)["v"])
    hits = windows.select("id", "m", "at", "before", "w", F.posexplode(sketch).alias("band", "value")) \
        .join(bands, ["m", "band", "value"]).select("id", "license", "at", "m", "before", "w").join(full, "license")
    held = lambda words: F.size(F.array_intersect(texts(words), F.col("texts"))) / F.size("texts")
    own = F.slice("w", F.col("before") + 1, 2 * F.col("m") + SHINGLE - 1)
    return hits.select("id", "license", "at", held(F.col("w")).alias("share"), held(own).alias("own")) \
        .where((F.col("share") >= LEAST) & (F.col("own") >= PART)) \
        .groupBy("id", "license").agg(F.max("share").alias("containment"), F.min("at").cast("long").alias("at_word")) \
        .withColumnRenamed("id", id_col)


def oracle(docs: str = "documents", texts_by_name: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL that compares every window and region with every template of its length."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in texts_by_name.items())
    words = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '{TOKEN}')"
    cut = f"array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s"
    return f"""
WITH t AS (SELECT license, len(w) - {SHINGLE - 1} AS m, w FROM (SELECT license, {words("text")} AS w
           FROM (VALUES {rows}) AS v(license, text))),
k AS (SELECT DISTINCT license, m, {cut} FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM t)),
n AS (SELECT license, count(*) AS n FROM k GROUP BY license),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM {docs}),
p AS (SELECT r, doc_id, i - 1 AS p, {cut} FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d)),
h AS (SELECT r, doc_id, license, m, s, p // m AS b FROM p JOIN k USING (s)),
a AS (SELECT r, doc_id, license, s, b, m, unnest([b - 2, b - 1, b, b + 1]) AS st FROM h),
c AS (SELECT r, doc_id, license, st, any_value(m) AS m, count(DISTINCT s) / any_value(n) AS share,
             count(DISTINCT CASE WHEN b IN (st, st + 1) THEN s END) / any_value(n) AS own
      FROM a JOIN n USING (license) WHERE st >= 0 GROUP BY r, doc_id, license, st)
SELECT doc_id, license, max(share) AS containment, CAST(min(st * m) AS BIGINT) AS at_word FROM c
WHERE share >= {LEAST} AND own >= {PART} GROUP BY doc_id, license"""
