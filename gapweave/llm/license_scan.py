"""License scan: whole texts looked up among known licence texts by a canonical digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query, table

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Known texts: whole licences, then the usual one-line notices. A fixed list, so it may be broadcast.
KNOWN = (
    ("MIT", "MIT License\n\n" + _MIT), ("MIT", _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_REST),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_REST),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_REST),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "\n" + _BSD_NAMES + "\n" + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + "\n" + _BSD_NAMES + "\n" + _BSD_TAIL),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

#: Canonical form, in order: (pattern, replacement) on lower-cased text. The same list runs in DuckDB.
STEPS = (
    (r"(^|\n)[ \t*/#;-]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©)[^\n]*", r"\1"),  # copyright lines name a year or a sign
    (r"(^|\n)[ \t*/#;-]*all rights reserved[. \t]*", r"\1"),
    (r"licence", "license"), (r"sub-licen[sc]e", "sublicense"), (r"non-?infringe?ment", "noninfringement"),
    (r"non-commercial", "noncommercial"), (r"copyright owner", "copyright holder"), (r"favour", "favor"),
    (r"merchantibility", "merchantability"), (r"https", "http"), (r"&", " and "),
    (r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "),  # punctuation and white space
)
_QUOTES = "[“”‘’«»–—•]"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, words separated by one space."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _QUOTES, " ")
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by.replace(r"\1", "$1"))
    return F.btrim(out)


def license_scan(docs: DataFrame, known: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = 10_000) -> DataFrame:
    """One row per document: ``doc_id, license_id, notices, canonical_sha256``.

    ``known`` holds ``license_id, license_text``; equal canonical texts count once (smallest id).
    ``license_id`` is the licence whose canonical text equals the document's whole canonical text, else null.
    ``notices`` are the sorted licences that a single line of the document equals in the same way.
    Null and empty texts have the digest of the empty text and match nothing, nor do empty lines. Repeated rows
    give repeated rows; an empty ``known`` matches nothing. The documents are not shuffled: the known
    digests are counted and broadcast up to ``broadcast_rows``; beyond, both lookups are shuffled joins.
    """
    listed = known.select("license_id", canonical(F.col("license_text")).alias("c")).filter("c != ''")
    listed = listed.groupBy(F.sha2("c", 256).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id"))
    small = listed.limit(broadcast_rows + 1).count() <= broadcast_rows
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.sha2(canonical(F.col(text)), 256).alias("canonical_sha256"))
    found = whole.join(F.broadcast(listed) if small else listed, "canonical_sha256", "left")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.sha2(canonical(x), 256))
    if small:
        rows = listed.collect()
        names = F.create_map(*[F.lit(v) for r in rows for v in (r.canonical_sha256, r.license_id)]) if rows else None
        hit = F.array_intersect(lines, F.array(*[F.lit(r.canonical_sha256) for r in rows])) if rows else None
        notices = F.sort_array(F.array_distinct(F.transform(hit, lambda h: names[h]))) if rows else F.array().cast("array<string>")
        return found.select("doc_id", "license_id", notices.alias("notices"), "canonical_sha256")
    found = found.withColumn("k", F.xxhash64("doc_id", "text"))
    line_rows = found.select("doc_id", "k", F.explode(F.array_distinct(lines)).alias("canonical_sha256"))
    hits = line_rows.join(listed.withColumnRenamed("license_id", "n"), "canonical_sha256").groupBy("doc_id", "k").agg(F.sort_array(F.collect_set("n")).alias("notices"))
    return found.alias("a").join(hits.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.k") == F.col("b.k")), "left").select(
        "a.doc_id", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"), "canonical_sha256")


def known_table(spark) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "license_id string, license_text string")


def _sql(column: str) -> str:
    out = f"regexp_replace(lower(coalesce({column}, '')), '{_QUOTES}', ' ', 'g')"
    for pattern, by in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out}, ' ')"


_VALUES = ", ".join("('%s', '%s')" % (i, t.replace("'", "''")) for i, t in KNOWN)
ORACLE = f"""
WITH k AS (SELECT sha256(c) AS s, min(i) AS i FROM (SELECT i, {_sql('t')} AS c FROM (VALUES {_VALUES}) v(i, t)) WHERE c != '' GROUP BY 1),
n AS (SELECT doc_id, list_sort(list(DISTINCT k.i)) AS notices
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) l JOIN k ON sha256({_sql('l.line')}) = k.s GROUP BY doc_id)
SELECT d.doc_id, k.i AS license_id, coalesce(n.notices, CAST([] AS VARCHAR[])) AS notices, d.s AS canonical_sha256
FROM (SELECT doc_id, sha256({_sql('text')}) AS s FROM documents) d LEFT JOIN k ON d.s = k.s LEFT JOIN n ON d.doc_id = n.doc_id
"""


@query("op9_license_scan", ORACLE)
def op9_license_scan(spark, sf_dir):
    """Whole texts of MIT, ISC, 0BSD and BSD-2/3 and the one-line notices of ``KNOWN``; other whole texts have a null ``license_id``."""
    return license_scan(table(spark, sf_dir, "documents"), known_table(spark))
