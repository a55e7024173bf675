"""Running aggregates that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(id)`` puts all rows of a key into one
task. One market may hold a third of the tape, so every unbounded running
value here is computed in two steps:

1. inside a *slice* of the order column (``key``, ``order div width``), by an
   ordinary window, so no task ever holds more than one slice of one key;
2. across slices, from one summary row per (key, slice) that is aggregated
   map-side, scanned by a small window and joined back.

The result equals the plain window for every supported kind.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage_table

SLICE = "__slice"
_KEY = "__keys"
#: rows of one key per task when the order column is a dense receipt id
ID_SLICE = 1_000_000


@dataclasses.dataclass(frozen=True)
class Run:
    """One running value: ``kind`` is last, first, max, min, sum or count."""

    kind: str
    value: Column
    inclusive: bool = True


def last(value: Column, inclusive: bool = True) -> Run:
    return Run("last", value, inclusive)


def first(value: Column, inclusive: bool = True) -> Run:
    return Run("first", value, inclusive)


def highest(value: Column, inclusive: bool = True) -> Run:
    return Run("max", value, inclusive)


def lowest(value: Column, inclusive: bool = True) -> Run:
    return Run("min", value, inclusive)


def total(value: Column, inclusive: bool = True) -> Run:
    return Run("sum", value, inclusive)


def _over(kind: str, value: Column) -> Column:
    return {
        "last": lambda: F.last(value, ignorenulls=True),
        "first": lambda: F.first(value, ignorenulls=True),
        "max": lambda: F.max(value),
        "min": lambda: F.min(value),
        "sum": lambda: F.sum(value),
    }[kind]()


def _summary(kind: str, value: Column, order: Column, reverse: bool) -> Column:
    present = F.when(value.isNotNull(), order)
    newest, oldest = (F.min_by, F.max_by) if reverse else (F.max_by, F.min_by)
    if kind == "last":
        return newest(value, present)
    if kind == "first":
        return oldest(value, present)
    return {"max": F.max, "min": F.min, "sum": F.sum}[kind](value)


def _combine(kind: str, local: Column, carried: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carried)
    if kind == "first":
        return F.coalesce(carried, local)
    if kind == "max":
        return F.greatest(local, carried)
    if kind == "min":
        return F.least(local, carried)
    return F.when(local.isNull(), carried).otherwise(local + F.coalesce(carried, F.lit(0)))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Mapping[str, Run],
    slice_by: Column | str | None,
    reverse: bool = False,
    restart: bool = False,
    beside: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add one running column per spec, in ``order`` within ``keys``.

    ``slice_by`` must never decrease along ``order``; ``None`` uses one plain
    window, for groups whose size is bounded by construction. A string names a
    slice column ``df`` already has. ``reverse`` scans from the end, turning ``last``
    into "nearest following". Null keys are a group of their own, as in a window.

    The rows are read twice, once for the slices' summaries. ``restart`` stores them
    first: for an input that is itself computed, so that stacked running values read
    each stage twice and not the base 2, 4, 8 times. ``beside`` are window functions
    without a frame, such as ``lead``, over the rows of a slice: they need no second sort.
    """
    keys, order = list(keys), list(order)
    asc = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]

    def frame(partition: list[str], spec: Run):
        return Window.partitionBy(*partition).orderBy(*asc).rowsBetween(
            Window.unboundedPreceding, 0 if spec.inclusive else -1
        )

    def nearby(partition: list[str]) -> list[Column]:
        return [c.over(Window.partitionBy(*partition).orderBy(*asc)).alias(n) for n, c in (beside or {}).items()]

    if slice_by is None:
        return df.select(
            "*", *[_over(s.kind, s.value).over(frame(keys, s)).alias(n) for n, s in specs.items()], *nearby(keys)
        )

    if restart:
        df = stage_table(df, "running")
    named = isinstance(slice_by, str)
    cut = slice_by if named else SLICE
    sliced = df if named else df.withColumn(SLICE, slice_by)
    # A struct of the keys is never null itself, so that the join below matches null keys.
    whole = [_KEY] if keys else []
    if keys:
        sliced = sliced.withColumn(_KEY, F.struct(*keys))
    cell = whole + [cut]
    local = sliced.select(
        "*", *[_over(s.kind, s.value).over(frame(cell, s)).alias(f"__l_{n}") for n, s in specs.items()], *nearby(cell)
    )
    position = F.struct(*order)
    summary = sliced.groupBy(*cell).agg(
        *[_summary(s.kind, s.value, position, reverse).alias(f"__t_{n}") for n, s in specs.items()]
    )
    before = (
        Window.partitionBy(*whole)
        .orderBy(F.col(cut).desc() if reverse else F.col(cut).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = summary.select(
        *cell, *[_over(s.kind, F.col(f"__t_{n}")).over(before).alias(f"__c_{n}") for n, s in specs.items()]
    )
    joined = local.join(carried, cell, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_combine(s.kind, F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n, s in specs.items()],
        *(beside or {}),
    )


def id_slices(column: str = "id", width: int = ID_SLICE) -> Column:
    """Slices of a dense receipt id: at most ``width`` rows of a key per slice."""
    return F.floor(F.col(column) / F.lit(width))


def time_slices(column: str, width_ms: int) -> Column:
    return F.floor(F.col(column) / F.lit(width_ms))


def with_halo(df: DataFrame, time: str, width_ms: int, lookback_ms: int) -> DataFrame:
    """Copy each row into the later slices that may look back at it.

    For frames of bounded length: a window over (key, ``__slice``) then sees
    everything within ``lookback_ms``; keep ``__own`` rows afterwards. With a
    width of several lookbacks only the tail of a slice is copied.
    """
    own = F.floor(F.col(time) / F.lit(width_ms))
    reach = F.floor((F.col(time) + F.lit(lookback_ms)) / F.lit(width_ms))
    return df.withColumn("__own_slice", own).withColumn(
        SLICE, F.explode(F.sequence(own, reach))
    ).withColumn("__own", F.col(SLICE) == F.col("__own_slice")).drop("__own_slice")
