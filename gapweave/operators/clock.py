"""Receipt clock and acceptance of source times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import ID_SLICE, highest, id_slices, running


def effective_clock(tape: DataFrame, id_col: str = "id", slice_rows: int = ID_SLICE) -> DataFrame:
    """Add ``now_ms``: the receipt clock, never moving backward along the tape.

    The maximum runs over the whole tape, so it is taken per id slice and
    carried across slices; no task sees more than ``slice_rows`` rows.
    """
    return running(tape, [], [id_col], {"now_ms": highest(F.col("received_ms"))}, id_slices(id_col, slice_rows))


def accept_newer(
    ticks: DataFrame,
    keys: Sequence[str],
    clock: str = "received_ms",
    order: Sequence[str] = ("id",),
    tolerance_ms: int = 5_000,
    source_always_present: bool = False,
    slice_rows: int = ID_SLICE,
) -> DataFrame:
    """Add ``verdict``: ACCEPTED, CLOCK_ERROR (source ahead of receipt) or DELAYED.

    A tick is delayed when its source time is below the last accepted one. The
    accepted time is a running maximum, except that a tick without source time
    restarts it at its own receipt time; such ticks therefore open segments.
    """
    source, keys, order = F.col("source_ms"), list(keys), list(order)
    ahead = source.isNotNull() & (source > F.col(clock) + F.lit(tolerance_ms))
    stored = F.when(source.isNull(), F.col(clock)).when(~ahead, source)
    slices = id_slices(order[0], slice_rows)
    df, segment_keys = ticks, keys
    if not source_always_present:
        df = running(df, keys, order, {"__seg": highest(F.when(source.isNull(), F.struct(*order)))}, slices)
        df = df.withColumn("__seg", F.coalesce(F.to_json("__seg"), F.lit("-")))
        segment_keys = keys + ["__seg"]
    df = running(df, segment_keys, order, {"__held": highest(stored, inclusive=False)}, slices, restart=not source_always_present)
    verdict = (
        F.when(ahead, "CLOCK_ERROR")
        .when(source.isNotNull() & (source < F.col("__held")), "DELAYED")
        .otherwise("ACCEPTED")
    )
    return df.withColumn("verdict", verdict).drop("__seg", "__held")


def acceptance_counts(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accepted, delayed and clock-error counts per key."""
    count = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0))
    return judged.groupBy(*keys).agg(
        count("ACCEPTED").alias("accepted"),
        count("DELAYED").alias("delayed"),
        count("CLOCK_ERROR").alias("clock_errors"),
    )
