"""Line dedup: lines found in many documents go, the others stay in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cols, hash_pair, lower_ascii, query, table


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column, min_chars: int) -> Column:
    """128-bit digest of each normalised line, null where the line is too short to count."""

    def digest(line: Column) -> Column:
        key = lower_ascii(F.btrim(line, F.lit(BLANKS)))
        return F.when(F.length(key) >= min_chars, F.md5(key))

    return F.transform(_lines(text), digest)


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """All rows and columns of ``docs``, with common lines taken out of ``text``, plus ``n_lines, n_dropped``.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of
    at least ``min_chars`` code points found in at least ``min_docs`` rows (a line counts once per
    row) lose all their lines. Null or empty text is one empty line; a text that loses all lines
    becomes empty. Repeated rows count as documents of their own. Columns named ``n_lines`` or
    ``n_dropped`` are replaced. An empty table gives an empty table.

    Only digests are exploded. Frequent ones are counted map-side, and the text moves once, to
    meet the positions it loses.
    """
    k1, k2 = hash_pair(F.col(doc_id), F.col(text))
    digests = docs.select(_keys(F.col(text), min_chars).alias("keys"))
    common = (
        digests.select(F.explode(F.array_distinct("keys")).alias("key")).filter("key IS NOT NULL")
        .groupBy("key").count().filter(F.col("count") >= min_docs).select("key", F.lit(True).alias("common"))
    )
    places = docs.select(k1.alias("__k1"), k2.alias("__k2"), _keys(F.col(text), min_chars).alias("keys"))
    places = places.select("__k1", "__k2", F.posexplode("keys").alias("pos", "key")).filter("key IS NOT NULL")
    # The second column keeps the counted side from being joined in place, so both sides can be split.
    places = places.withColumn("__p", F.crc32("key"))
    hits = places.join(common.withColumn("__p", F.crc32("key")), ["key", "__p"])
    lost = hits.groupBy("__k1", "__k2").agg(F.sort_array(F.collect_set("pos")).alias("__lost"))

    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = docs.select(*cols(kept_columns), k1.alias("__k1"), k2.alias("__k2")).join(lost, ["__k1", "__k2"], "left")
    n_lost = F.coalesce(F.size("__lost"), F.lit(0))

    def kept(lines: Column) -> Column:
        # The runs between lost positions: linear in the number of lines, however many are lost.
        def run(i: Column) -> Column:
            start = F.when(i == 0, F.lit(0)).otherwise(F.get("__lost", i - 1) + 1)
            end = F.when(i == n_lost, F.size(lines)).otherwise(F.get("__lost", i))
            return F.slice(lines, start + 1, end - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n_lost), run)), "\n")

    bound = F.transform(F.array(_lines(F.col(text))), lambda x: F.struct(F.size(x).alias("n"), F.when(n_lost > 0, kept(x)).alias("t")))
    whole = whole.withColumn("__r", F.get(bound, F.lit(0)))
    new_text = F.coalesce(F.col("__r.t"), F.col(text), F.lit(""))
    return whole.select(
        *[new_text.alias(c) if c == text else col for c, col in zip(kept_columns, cols(kept_columns))],
        F.col("__r.n").cast("bigint").alias("n_lines"), n_lost.cast("bigint").alias("n_dropped"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""


@query("op7_line_dedup", ORACLE)
def op7_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
