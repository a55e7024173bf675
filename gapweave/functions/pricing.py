"""Closed-form probability and option-value columns, all zero carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import as_probability

# --- fixed values -----------------------------------------------------------------
YEAR_MS = 365 * 86_400_000            # pricing year
THESIS_YEAR_SECONDS = 365.25 * 86_400  # year of the realized-volatility figures
# Hart's rational approximation of the normal tail as published by West (2005).
TAIL_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
ROOT_TWO_PI = 2.506628274631
# -----------------------------------------------------------------------------------


def _horner(coefficients, z: Column) -> Column:
    value = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        value = value * z + F.lit(coefficient)
    return value


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, absolute error about 2e-16.

    ``x`` is mentioned some twenty times; give it a plain column. The ``with_*``
    helpers below store their scores as columns first for that reason.
    """
    z = F.abs(x)
    density = F.exp(-z * z / 2)
    fraction = z + 0.65
    for k in (4, 3, 2, 1):
        fraction = z + F.lit(float(k)) / fraction
    near = _horner(TAIL_NUMERATOR, z) / _horner(TAIL_DENOMINATOR, z)
    tail = density * F.when(z < 7.07106781186547, near).otherwise(1 / fraction / ROOT_TWO_PI)
    return F.when(x > 0, 1.0).otherwise(0.0) + F.when(x > 0, -1.0).otherwise(1.0) * tail


def _usable(*cols: Column) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < F.lit(float("inf")))
    return ok


def with_terminal_probability(
    df: DataFrame, out: str, spot: Column, strike: Column, sigma: Column, years: Column, direction: Column
) -> DataFrame:
    """Add P(finish beyond the strike) of a lognormal price; null for unusable inputs."""
    d2 = (F.ln(spot / strike) - sigma * sigma * years / 2) / (sigma * F.sqrt(years))
    score = F.when(direction == "up", d2).when(direction == "down", -d2)
    staged = df.withColumn("__z", F.when(_usable(spot, strike, sigma, years), score))
    return staged.withColumn(out, F.when(F.col("__z").isNotNull(), normal_cdf(F.col("__z")))).drop("__z")


def with_touch_probability(
    df: DataFrame, out: str, spot: Column, strike: Column, sigma: Column, years: Column, direction: Column
) -> DataFrame:
    """Add P(path touches the barrier) by reflection; 1 when already beyond it."""
    up = direction == "up"
    distance = F.abs(F.ln(strike / spot))
    drift = sigma * sigma / 2 * F.when(up, 1).otherwise(-1)
    scale = sigma * F.sqrt(years)
    ok = _usable(spot, strike, sigma, years) & direction.isin("up", "down")
    staged = df.withColumns({
        "__a": F.when(ok, (-distance - drift * years) / scale),
        "__b": F.when(ok, (-distance + drift * years) / scale),
        "__x": F.when(ok, -2 * drift * distance / (sigma * sigma)),
        "__beyond": ok & ((up & (spot >= strike)) | (~up & (spot <= strike))),
    })
    staged = staged.withColumn("__na", normal_cdf(F.col("__a"))).withColumn("__nb", normal_cdf(F.col("__b")))
    reflected = F.col("__na") + F.exp("__x") * F.col("__nb")
    value = F.when(F.col("__beyond"), 1.0).when(
        F.col("__x") <= 700, F.least(F.lit(1.0), F.greatest(F.lit(0.0), reflected)))
    return staged.withColumn(out, value).drop("__a", "__b", "__x", "__beyond", "__na", "__nb")


def with_option_value(df: DataFrame, out: str, spot: Column, strike: Column, iv: Column, years: Column, put: Column) -> DataFrame:
    """Add the Black-Scholes value at zero rate; intrinsic once the time is used up, null before where ``iv`` is not positive.

    A put is priced by parity, so that two distribution values serve both kinds.
    """
    scale = iv * F.sqrt(years)
    d1 = (F.ln(spot / strike) + iv * iv * years / 2) / scale
    open_ = (years > 0) & (iv > 0)
    staged = df.withColumn("__d1", F.when(open_, d1)).withColumn("__d2", F.when(open_, d1 - scale))
    staged = staged.withColumn("__n1", normal_cdf(F.col("__d1"))).withColumn("__n2", normal_cdf(F.col("__d2")))
    intrinsic = F.greatest(F.lit(0.0), F.when(put, strike - spot).otherwise(spot - strike))
    live = spot * F.col("__n1") - strike * F.col("__n2") + F.when(put, strike - spot).otherwise(0.0)
    return staged.withColumn(out, F.when(years <= 0, intrinsic).otherwise(live)).drop("__d1", "__d2", "__n1", "__n2")


def gap_pp(pm: Column, opt: Column) -> Column:
    return (as_probability(pm) - as_probability(opt)) * 100


def relative_gap(pm: Column, opt: Column) -> Column:
    p, q = as_probability(pm), as_probability(opt)
    return F.when(q > 0, F.abs(p - q) / q)


def gap_side(pm: Column, opt: Column) -> Column:
    gap = as_probability(pm) - as_probability(opt)
    return F.when(gap > 0, "CHEAP").when(gap < 0, "RICH").when(gap == 0, "EVEN")


def observation_valid(gap: Column, state: Column, flags: Column) -> Column:
    """Usable for dynamics, episodes and curves."""
    return gap.isNotNull() & F.coalesce(state.isin("OK", "PROXY"), F.lit(False)) & ~F.coalesce(
        F.array_contains(flags, "WIDE_PM_BOOK"), F.lit(False)
    )
