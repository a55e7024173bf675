"""Option-surface figures around one strike: call spreads, local volatility, skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_probability

#: implied volatilities outside this open interval are not used (fixed values)
IV_RANGE = (0.0001, 5.0)
NEAREST = 3


def iv_usable(iv: Column) -> Column:
    return F.coalesce((iv > IV_RANGE[0]) & (iv < IV_RANGE[1]), F.lit(False))


def strike_neighborhood(points: DataFrame, contracts: DataFrame, on: Sequence[str], strike: str = "strike_or_threshold") -> DataFrame:
    """Contracts around each point's strike, within one option snapshot.

    Adds ``below`` and ``above`` (nearest strictly lower and higher strikes) and
    ``near``, the three contracts of usable volatility closest to the strike; of equal ones the lowest ``pos`` counts.
    The listing bounds a snapshot, so its contracts become one array, which every point of the snapshot reads; points and contracts are never paired.
    """
    on = list(on)
    listed = contracts.filter(F.col("strike").isNotNull()).groupBy(*on).agg(
        F.collect_list(F.struct("strike", "pos", "bid", "ask", "mark", "iv")).alias("__listed"))
    rows = points.join(listed, on, "left")
    quote = lambda c: F.struct(c["strike"].alias("strike"), c["bid"].alias("bid"), c["ask"].alias("ask"), c["mark"].alias("mark"))
    # Ordered by strike away from the point, then by position.
    lower = F.transform(F.filter("__listed", lambda c: c["strike"] < F.col(strike)), lambda c: F.struct(-c["strike"], c["pos"], quote(c).alias("q")))
    upper = F.transform(F.filter("__listed", lambda c: c["strike"] > F.col(strike)), lambda c: F.struct(c["strike"], c["pos"], quote(c).alias("q")))
    ranked = F.array_sort(F.transform(F.filter("__listed", lambda c: iv_usable(c["iv"])), lambda c: F.struct(
        F.abs(c["strike"] - F.col(strike)).alias("distance"), c["pos"].alias("pos"), c["strike"].alias("strike"), c["iv"].alias("iv"))))
    empty = F.array().cast("array<struct<distance:double,pos:int,strike:double,iv:double>>")
    return rows.withColumns({
        "below": F.array_min(lower)["q"], "above": F.array_min(upper)["q"], "near": F.coalesce(F.slice(ranked, 1, NEAREST), empty)}).drop("__listed")


def quote_mid(c: Column) -> Column:
    """Mid of an uncrossed two-sided quote; the mark only where a side is missing."""
    both = c["bid"].isNotNull() & c["ask"].isNotNull()
    fair = (c["bid"] >= 0) & (c["bid"] <= c["ask"])
    return F.when(both, F.when(fair, (c["bid"] + c["ask"]) / 2)).when(c["mark"] >= 0, c["mark"])


def finite_spread(below: Column, above: Column) -> dict[str, Column]:
    """Call-spread probability of finishing above, its width, completeness and error."""
    present = below.isNotNull() & above.isNotNull()
    low, high = quote_mid(below), quote_mid(above)
    width = above["strike"] - below["strike"]
    raw = (low - high) / width
    error = (
        F.when(low.isNull() | high.isNull(), "MISSING_OR_CROSSED_OPTION_QUOTES")
        .when(as_probability(raw).isNull(), "INVALID_CALL_SPREAD")
    )
    complete = (below["bid"].isNotNull() & below["ask"].isNotNull() & above["bid"].isNotNull() & above["ask"].isNotNull())
    return {
        "present": present,
        "error": F.when(present, error),
        "probability": F.when(present, as_probability(raw)),
        "width": F.when(present, width),
        "complete": F.when(present, complete),
        "center": F.when(present, (below["strike"] + above["strike"]) / 2),
    }


def local_iv(near: Column) -> Column:
    """Inverse-distance mean volatility of the nearest contracts (distance at least one)."""
    weight = lambda c: 1 / F.greatest(F.lit(1.0), c["distance"])
    zero = F.lit(0.0)
    top = F.aggregate(near, zero, lambda acc, c: acc + c["iv"] * weight(c))
    bottom = F.aggregate(near, zero, lambda acc, c: acc + weight(c))
    return F.when(F.size(near) > 0, top / bottom)


def nearest_iv(near: Column) -> Column:
    """Volatility of the closest strike, the lower one when two are equally close."""
    by_strike = F.array_sort(F.transform(near, lambda c: F.struct(c["distance"].alias("d"), c["strike"].alias("k"), c["pos"].alias("p"), c["iv"].alias("iv"))))
    return F.when(F.size(near) > 0, by_strike[0]["iv"])


def iv_skew(near: Column) -> Column:
    """Volatility difference per log strike across the nearest contracts."""
    by_strike = F.array_sort(F.transform(near, lambda c: F.struct(c["strike"].alias("k"), c["distance"].alias("d"), c["pos"].alias("p"), c["iv"].alias("iv"))))
    low, high = by_strike[0], F.element_at(by_strike, -1)
    return F.when(
        (F.size(near) > 1) & (high["k"] > low["k"]) & (low["k"] > 0), (high["iv"] - low["iv"]) / F.ln(high["k"] / low["k"]))
