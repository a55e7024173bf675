"""Sinks for ``foreachBatch`` that survive a repeated batch.

A micro-batch that failed, or whose end was not recorded, runs again under the same id. Every sink keeps what it writes
for a batch in that batch's own folder and replaces the folder, so a repetition changes nothing; what a batch needs of earlier ones it
reads from their folders. Nothing is held by the driver between batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clock import effective_clock
from ..operators.history import latest_by
from ..operators.running import ID_SLICE
from ..sources.feeds import packet_error

Sink = Callable[[DataFrame, int], None]


def _folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, if anything was written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_sink(path: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Sink:
    """Each batch once, after ``prepare``; read the whole with ``spark.read.parquet(path)``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(_folder(path, batch_id))

    return write


def clock_sink(path: str, id_col: str = "id", slice_rows: int = ID_SLICE) -> Sink:
    """Packets with ``now_ms``, the receipt clock over all batches, below ``path/facts``; batches arrive in tape order.

    The highest clock so far is one row per batch below ``path/clock``, written after the batch's facts from what they say. A batch starts from the
    row of the one before it, so a restart, also in the middle of a batch, goes on where the facts end.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _read(spark, _folder(f"{path}/clock", batch_id - 1)) if batch_id else None
        start = before.first()["now_ms"] if before is not None else None
        clocked = effective_clock(batch, id_col, slice_rows)
        if start is not None:
            clocked = clocked.withColumn("now_ms", F.greatest("now_ms", F.lit(start)))
        facts = _folder(f"{path}/facts", batch_id)
        clocked.write.mode("overwrite").parquet(facts)
        highest = spark.read.schema(clocked.schema).parquet(facts).agg(F.max("now_ms").alias("now_ms"))
        highest = highest.withColumn("now_ms", F.coalesce("now_ms", F.lit(start).cast("bigint")))
        highest.coalesce(1).write.mode("overwrite").parquet(_folder(f"{path}/clock", batch_id))

    return write


def upsert_sink(path: str, keys: Sequence[str], order: str = "raw_id", compact_every: int = 20) -> Sink:
    """A table of the newest row per key; late rows, which are older than what is stored, change nothing.

    A batch adds its own newest rows. Every ``compact_every`` batches the table so far becomes its new base, named by the last batch in
    it; ``read_latest`` merges the newest base with the batches after it, so reading costs what changed lately and not the whole history.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_by(batch, keys, order).write.mode("overwrite").parquet(_folder(f"{path}/delta", batch_id))
        if batch_id % compact_every == compact_every - 1:
            whole = read_latest(batch.sparkSession, path, keys, order, batch_id)
            whole.write.mode("overwrite").parquet(f"{path.rstrip('/')}/base/up_to={batch_id}")

    return write


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], order: str = "raw_id", up_to: int | None = None) -> DataFrame:
    """The newest row per key of an ``upsert_sink``, after batch ``up_to`` or after all."""
    deltas, base = spark.read.parquet(f"{path}/delta"), _read(spark, f"{path}/base")
    if up_to is not None:
        deltas = deltas.filter(F.col("batch_id") <= up_to)
    newest = None
    if base is not None:
        # A base of this very batch is left from an earlier try.
        newest = base.filter(F.lit(True) if up_to is None else F.col("up_to") < up_to).agg(F.max("up_to")).first()[0]
    rows = deltas.drop("batch_id")
    if newest is not None:
        rows = deltas.filter(F.col("batch_id") > newest).drop("batch_id").unionByName(base.filter(F.col("up_to") == newest).drop("up_to"))
    return latest_by(rows, keys, order)


def judged_sink(path: str) -> Sink:
    """Packets of a tape, sound and malformed ones apart, in one pass and one write: ``path/batch_id=.../sound=true`` and ``false``, with ``error``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumn("error", packet_error(F.col("kind"), F.col("payload")))
        judged.withColumn("sound", F.col("error").isNull()).write.mode("overwrite").partitionBy("sound").parquet(_folder(path, batch_id))

    return write
