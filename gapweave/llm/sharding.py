"""Sharding by vector bin packing: bytes, tokens and rows are balanced together."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cols, hash_pair, query, table

RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
DIMENSIONS = ("bytes", "tokens", "n_rows")


def place(items: np.ndarray, residual: np.ndarray, first: int = 0) -> np.ndarray:
    """Bin of each item (rows of ``items``), placed in the given order; ``residual`` is used up.

    Both are in units of a shard's capacity. An item goes where its dot product with the residual
    capacity is highest among the shards that hold it; if none does, where it overflows least.
    Ties go to the next shard from ``first`` on.
    """
    turn = np.roll(np.arange(len(residual)), -first)
    left = residual[turn]
    out = np.empty(len(items), dtype=np.int64)
    for i, item in enumerate(items):
        after = (left - item).min(axis=1)
        fits = after >= 0
        score = np.where(fits, left @ item, -1.0) if fits.any() else after
        b = int(score.argmax())
        left[b] -= item
        out[i] = turn[b]
    residual[turn] = left
    return out


def vector_shards(
    docs: DataFrame, n_shards: int = 24, text: str = "text", doc_id: str = "doc_id", carry: Sequence[str] = (),
    whole_share: float = 0.5, large_share: float = 1 / 64, lot_groups: int = 20_000, cell_rows: int = 50_000,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and ``carry``.

    Groups of equal texts (null counts as empty) stay together. A group above ``whole_share`` of a shard in
    any dimension is split by id into pieces of ``large_share``. Groups above ``large_share`` (at most
    ``3 * n_shards / large_share`` of them, however large the table) are placed first, on the driver. The
    others are dealt by hash into lots of about ``lot_groups``, each placed in one task within its part of the
    capacity that the large ones left, largest group first. ``law`` is ``bytes``: sizes come out near equal, as do
    tokens and rows. Slots number a shard from 0 in cells of about ``cell_rows``. Repeated rows are rows
    of one group; an empty table gives no rows. ``carry`` names further columns to keep; those named like a
    column of the result are replaced by it.
    """
    kept = [c for c in carry if c not in RESULT]
    body = F.coalesce(F.col(text), F.lit(""))
    g1, g2 = hash_pair(body)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 8).cast("bigint").alias("size"),
        F.regexp_count(body, F.lit(WORD)).cast("bigint").alias("tokens"), F.crc32(body.cast("binary")).alias("text_crc32"), g1.alias("g1"), g2.alias("g2"),
        *([F.struct(*cols(kept)).alias("carried")] if kept else []))
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")]
    groups = rows.groupBy("g1", "g2").agg(*sums)

    total = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS], F.count("*").alias("groups")).first()
    capacity = np.array([max(total[d] or 0, 1) / n_shards for d in DIMENSIONS])
    largest = F.greatest(*[F.col(d) / F.lit(float(c)) for d, c in zip(DIMENSIONS, capacity)])
    groups = groups.withColumn("share", largest)
    large = groups.filter(F.col("share") > large_share).select(
        "g1", "g2", F.when(F.col("share") > whole_share, F.ceil(F.col("share") / large_share)).otherwise(1).cast("int").alias("pieces"))
    # At most 3 * n_shards / large_share rows: safe to broadcast.
    rows = rows.join(F.broadcast(large), ["g1", "g2"], "left").withColumn(
        "piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(0).cast("int")).drop("pieces")

    pieces = rows.join(F.broadcast(large.select("g1", "g2")), ["g1", "g2"], "left_semi").groupBy("g1", "g2", "piece").agg(*sums).collect()
    pieces.sort(key=lambda r: (-max(r[d] / c for d, c in zip(DIMENSIONS, capacity)), r.g1, r.g2, r.piece))
    residual = np.ones((n_shards, len(DIMENSIONS)))
    bins = place(np.array([[r[d] for d in DIMENSIONS] for r in pieces], dtype=float).reshape(-1, 3) / capacity, residual)
    spark = docs.sparkSession
    fixed = spark.createDataFrame([(r.g1, r.g2, r.piece, int(b)) for r, b in zip(pieces, bins)], "g1 long, g2 long, piece int, shard int")

    lots = max(1, -(-total["groups"] // lot_groups))
    room = np.maximum(residual, 0.0)

    def place_lot(lot: pd.DataFrame) -> pd.DataFrame:
        size = lot[list(DIMENSIONS)].to_numpy(dtype=float)
        whole = np.maximum(size.sum(axis=0), 1.0)
        share = room / np.maximum(room.sum(axis=0), 1e-12)
        scaled = size / (whole / len(room))
        order = np.lexsort((lot["g2"], lot["g1"], -scaled.max(axis=1)))
        bins = np.empty(len(lot), dtype=np.int64)
        bins[order] = place(scaled[order], share * len(room), int(lot["lot"].iloc[0]) % len(room))
        return pd.DataFrame({"g1": lot["g1"], "g2": lot["g2"], "piece": 0, "shard": bins})

    small = groups.filter(F.col("share") <= large_share).withColumn("lot", F.pmod(F.xxhash64("g1", "g2"), F.lit(lots)))
    dealt = small.groupBy("lot").applyInPandas(place_lot, "g1 long, g2 long, piece int, shard int")
    placed = rows.join(dealt.unionByName(fixed), ["g1", "g2", "piece"])

    cells = max(1, -(-total["n_rows"] // cell_rows) if total["n_rows"] else 1)
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "g1")
    numbered = placed.withColumn("n", F.row_number().over(within)).join(offsets, ["shard", "cell"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *(["carried.*"] if kept else []))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, ordered by slot within each file."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@query("op10_vector_sharding")
def op10_vector_sharding(spark, sf_dir):
    return vector_shards(table(spark, sf_dir, "documents"))
