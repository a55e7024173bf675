"""Exact dedup by content-defined chunk recipes.

A normalised text is cut where its own bytes say so, once, and the pieces are stored. Chunk texts are moved
once, to prove that no two different chunks share an identifier; afterwards texts are compared
by their ordered identifier lists ("recipes"), which are about fifty times shorter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import SPACE, query, table

#: Bytes that may end a chunk, by rule; two in a row make a boundary. Between them may stand the first bytes of a character
#: of two or three, which are nearly the same all over many scripts and tell nothing.
_EDGE = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0xC0) if c % 8 == 3) + "]"
_LEAD = r"(?:[\xC2-\xDF]|[\xE0-\xEF][\x80-\xBF])?"


def chunks(text: Column, least: int = 256, most: int = 2048) -> Column:
    """Pieces of ``least`` to ``most`` bytes ending at a boundary, a byte written as the character of its number (U+0000 to U+00FF); joined they are the UTF-8 of ``text``."""
    # Bytes of ASCII are their own characters.
    units = F.when(F.length(text) == F.octet_length(text), text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1"))
    rule = rf"(?s).{{{least},{most - 4}}}?(?:{_EDGE}{_LEAD}{_EDGE}|\z)|.{{1,{most}}}"
    return F.regexp_extract_all(units, F.lit(rule), F.lit(0))


def exact_dedup(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 256, most: int = 2048,
    hash_bits: int = 64, listed_clashes: int = 10_000,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without ASCII white space. The row with the most code points
    in its original text stays, then the smallest ``doc_id`` (null last). Null text counts as
    empty; empty texts form one group. Rows that repeat both id and length are all ``kept``. An
    empty table gives no rows; other columns are ignored. No text is cut or capped.

    ``hash_bits`` shortens the chunk hash (tests force clashes with it). Clashing hashes keep
    their chunk text as part of the identifier; beyond ``listed_clashes`` every chunk does.
    """
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE + "+", "")

    def code(chunk: Column) -> Column:
        full = F.xxhash64(chunk)
        return full if hash_bits == 64 else F.pmod(full, F.lit(1 << hash_bits))

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"), bare.alias("bare"),
    ).select("doc_id", "n", F.sha2("bare", 256).alias("text_sha256"), chunks(F.col("bare"), least, most).alias("pieces"))
    rows = stage_table(rows, "exact-chunks")
    pieces = rows.select(F.explode("pieces").alias("c"))
    dictionary = pieces.select(code(F.col("c")).alias("h"), "c").distinct()
    clashing = dictionary.groupBy("h").count().filter("count > 1").select("h")
    clashes = [r.h for r in clashing.limit(listed_clashes + 1).collect()]

    if not clashes:
        recipe = F.transform("pieces", code)
    else:
        listed = F.array(*[F.lit(h) for h in clashes])
        unsure = (lambda h: F.lit(True)) if len(clashes) > listed_clashes else (lambda h: F.array_contains(listed, h))
        recipe = F.transform("pieces", lambda c: F.struct(code(c).alias("h"), F.when(unsure(code(c)), c).alias("c")))
    rows = rows.select("doc_id", "n", "text_sha256", recipe.alias("recipe"))

    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")))
    groups = rows.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size"))
    # The extra key makes both sides shuffle for the join, so that adaptive execution can split a hot group.
    groups = groups.withColumn("r", F.xxhash64("recipe"))
    rows = rows.withColumn("r", F.xxhash64("recipe"))
    joined = rows.join(groups, ["r", "recipe"])
    kept = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n") == -F.col("best.n"))
    return joined.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS s
  FROM documents),
g AS (SELECT s, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY s)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.s AS text_sha256 FROM d JOIN g ON d.s = g.s
"""


@query("op8_exact_dedup", ORACLE)
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))
