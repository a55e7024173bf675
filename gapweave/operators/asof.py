"""As-of join: the newest right row at or before each left row, per key.

Both sides are unioned and swept once, so the cost is one shuffle of left plus
right; nothing is paired inside a key, and ``running`` splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import Run, running

_TS, _TAG, _SEQ, _LEFT, _RIGHT = "__ts", "__tag", "__seq", "__left", "__right"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    right_order: Sequence[str] = (),
    tolerance: float | None = None,
    direction: str = "backward",
    strict: bool = False,
    slice_width: float | None = None,
    prefix: str = "",
    restart: bool = False,
) -> DataFrame:
    """Left rows plus ``prefix + value`` columns of the matching right row.

    ``direction`` is ``backward`` (latest at or before) or ``forward`` (earliest
    at or after); ``strict`` excludes equal times. ``right_order`` breaks ties
    between right rows of the same time: the highest wins going backward, the
    lowest going forward. ``tolerance`` nulls matches further away. ``restart`` as in ``running``,
    for joins on the result of another.
    """
    on = list(on)
    backward = direction == "backward"
    # A right row of equal time is swept before the left row unless strict.
    right_tag = 2 if backward == strict else 0
    values = list(dict.fromkeys(values))
    payload = F.struct(F.col(right_ts).alias("__at"), *[F.col(v).alias(v) for v in values])
    seq = F.struct(*[F.col(c) for c in right_order]) if right_order else F.lit(0)
    r = right.filter(F.col(right_ts).isNotNull())
    for key in on:
        r = r.filter(F.col(key).isNotNull())
    r = r.select(*on, F.col(right_ts).alias(_TS), F.lit(right_tag).alias(_TAG), seq.alias(_SEQ), payload.alias(_RIGHT))
    l = left.select(*on, F.col(left_ts).alias(_TS), F.lit(1).alias(_TAG), F.struct("*").alias(_LEFT))
    both = l.unionByName(r, allowMissingColumns=True)
    swept = running(
        both,
        on,
        [_TS, _TAG, _SEQ],
        {"__match": Run("last", F.col(_RIGHT))},
        None if slice_width is None else F.floor(F.col(_TS) / F.lit(slice_width)),
        reverse=not backward,
        restart=restart,
    ).filter(F.col(_LEFT).isNotNull())
    hit = F.col("__match")
    if tolerance is not None:
        hit = F.when(F.abs(F.col(_TS) - hit["__at"]) <= F.lit(tolerance), hit)
    swept = swept.withColumn("__match", hit)
    return swept.select(f"{_LEFT}.*", *[F.col("__match")[v].alias(prefix + v) for v in values])
