"""Mix sources by a time-varying curriculum.

Each class of sources has a weight that changes over training progress 0..1, given at knots
and linear between them. Its integral is the class's share of the mix. Within a source,
documents stand in a fixed pseudo-random order; the words before a document, as a fraction of
the source's demand, are turned into a training position by inverting the integral. Sorting
by position gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cols, query, table

#: From equal weights to 9:3:1; the integrals are 5, 2 and 1.
KNOTS = ((0.0, (1.0, 1.0, 1.0)), (1.0, (9.0, 3.0, 1.0)))
#: Hex digits of the order key that cut a source into cells: 4,096 cells however large the source.
CELL_DIGITS = 3


def integrals(knots) -> list[float]:
    """The area under each class's weight."""
    pairs = list(zip(knots, knots[1:]))
    return [sum((t1 - t0) * (a[j] + b[j]) / 2 for (t0, a), (t1, b) in pairs) for j in range(len(knots[0][1]))]


def position_of(share: Column, cls: Column, knots) -> Column:
    """Progress at which a class has met ``share`` (0..1) of its demand; beyond 1 the share itself."""
    areas, out = integrals(knots), share
    for j, area in enumerate(areas):
        done, found = 0.0, share
        for (t0, a), (t1, b) in zip(knots, knots[1:]):
            step = (t1 - t0) * (a[j] + b[j]) / 2
            need = share * F.lit(area) - F.lit(done)
            slope = (b[j] - a[j]) / (t1 - t0)
            inside = F.lit(t0) + F.lit(2.0) * need / (F.lit(a[j]) + F.sqrt(F.lit(a[j] * a[j]) + F.lit(2.0 * slope) * need))
            found = F.when((share * F.lit(area) >= F.lit(done)) & (share < 1.0), F.when(need <= 0, F.lit(t0)).otherwise(inside)).otherwise(found)
            done += step
        out = F.when(cls == j, found).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """``__s, cls, source_size, target`` from one row per source (``__s``, ``source_size``).

    Shares ``budget`` times all sizes by weight; a target stops at ``cap`` times its source's size and
    the excess goes to the others by weight. Sorted by cap per weight, the capped sources are those whose
    cap is below the level that the rest would reach, so one pass over the rows per source is enough.
    """
    everything = Window.orderBy("__s")
    ranked = sizes.withColumn("cls", (F.row_number().over(everything) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("cls")))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "__s")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (F.lit(float(budget)) * total - before) / rest
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("open", F.when(F.col("limit") / F.col("weight") > F.col("level"), F.col("level")))
    shared = F.max("open").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("shared", shared).select(
        "__s", "cls", "source_size", F.when(F.col("open").isNull(), F.col("limit")).otherwise(F.col("weight") * F.col("shared")).alias("target"))


def curriculum_mix(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
    knots=KNOTS, budget: float = 1.5, cap: float = 2.0, carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, position, passes``.

    ``size`` is the number of words (null text: 0). Sources are put into the classes of ``knots`` in
    turn, by code point, a null source last. ``taken`` counts the words the mix takes, repeats included:
    whole passes over a source while its demand lasts, then the documents in order until it is met, so
    a source's sum is its rounded target and no document exceeds ``cap`` rounded up passes. ``passes`` lists
    (pass, words, position) of the passes that take words; ``position`` is that of the first pass, above 1
    if the document is not reached. Rows that repeat an id share an order key and are told apart by
    text; equal rows are interchangeable. An empty table gives no rows; ``carry`` names
    columns to keep, as the fields of one more column ``carried``.
    """
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    rows = docs.select(
        *([F.struct(*cols(carry)).alias("carried")] if carry else []), F.col(doc_id).alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))).alias("__s"),
        key.alias("__h"), F.substring(key, 1, CELL_DIGITS).alias("__cell"), F.xxhash64(F.col(text)).alias("__t"))

    cells = rows.groupBy("__s", "__cell").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("__s").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("__s", "__cell", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    sizes = rows.groupBy("__s").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, integrals(knots), budget, cap)
    cells = cells.join(targets, "__s")

    inside = Window.partitionBy("__s", "__cell").orderBy("__h", "doc_id", "__t").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cells, ["__s", "__cell"])
    placed = placed.withColumn("start", F.col("start") + F.col("offset")).withColumn("demand", F.round("target").cast("bigint"))
    s, d, size = F.col("source_size"), F.col("demand"), F.col("size")
    full = F.when(s > 0, F.floor(d / s)).otherwise(F.lit(0)).cast("bigint")

    def one(k: Column) -> Column:
        at = k * s + F.col("start")
        share = F.when(d > 0, at / d).otherwise(F.lit(1.0))
        words = F.greatest(F.lit(0), F.least(size, d - at))
        return F.struct(k.alias("pass"), words.alias("words"), position_of(share, F.col("cls"), knots).alias("position"))

    tries = F.transform(F.sequence(F.lit(0).cast("bigint"), full), one)
    placed = placed.withColumn("tries", tries)
    return placed.select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("tries", F.lit(0).cast("bigint"), lambda sum_, p: sum_ + p["words"]).alias("taken"),
        F.get("tries", F.lit(0))["position"].alias("position"), F.filter("tries", lambda p: p["words"] > 0).alias("passes"),
        *(["carried"] if carry else []))


def training_order(mix: DataFrame) -> DataFrame:
    """One row per pass of a document, range-sorted by training position."""
    return mix.withColumn("p", F.explode("passes")).select(
        *[c for c in mix.columns if c not in ("passes", "position")], F.col("p.pass").alias("pass"),
        F.col("p.words").alias("words"), F.col("p.position").alias("position")).orderBy("position", "doc_id", "pass")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
    md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
g AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY s),
o AS (SELECT *, 2.0 * source_size AS lim, coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
  (sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest, (sum(source_size) OVER ())::DOUBLE AS total FROM g),
l AS (SELECT *, (1.5::DOUBLE * total - before) / rest AS lev FROM o),
t AS (SELECT s, source_size, CASE WHEN lim::DOUBLE / w > lev THEN w * max(CASE WHEN lim::DOUBLE / w > lev THEN lev END) OVER () ELSE lim::DOUBLE END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS dem,
  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.s ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a0
  FROM d JOIN t ON d.s = t.s)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(greatest(0, least(size, dem - a0)) + greatest(0, least(size, dem - a0 - source_size)) AS BIGINT) AS taken FROM p
"""


@query("op4_curriculum_mix", ORACLE)
def op4_curriculum_mix(spark, sf_dir):
    """In training order; a document's first pass decides its place."""
    mix = curriculum_mix(table(spark, sf_dir, "documents"))
    return mix.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken")
