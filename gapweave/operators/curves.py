"""Neighbouring-strike structure of comparable propositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import SLICE, last, running, total

#: propositions are comparable when all of these agree
CURVE_KEY = (
    "asset", "expiry", "event_type", "direction", "window_start", "settlement_source", "threshold_inclusive",
)
_ORDER = ["strike_or_threshold", "event_id"]
TOLERANCE = 1e-6


def curve_nodes(rows: DataFrame, keys: Sequence[str] = CURVE_KEY, strike_slice: float = 100.0) -> DataFrame:
    """Valid rows of curves with two or more nodes, numbered by strike.

    Adds ``curve_id``, ``node_no``, ``nodes`` and the neighbour structs ``lower`` and
    ``upper``. Slices of the strike axis keep a large curve out of one task.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys]
    df = rows.filter("valid").withColumn("curve_id", F.concat_ws("|", *parts))
    df = df.withColumn(SLICE, F.floor(F.col("strike_or_threshold") / F.lit(strike_slice)))
    node = F.struct("event_id", "strike_or_threshold", "pm_yes", "opt_yes", "gap_pp", "side")
    df = running(df, ["curve_id"], _ORDER, {"lower": last(node, inclusive=False), "node_no": total(F.lit(1))}, SLICE)
    df = running(df, ["curve_id"], _ORDER, {"upper": last(node, inclusive=False)}, SLICE, reverse=True, restart=True)
    sizes = rows.filter("valid").withColumn("curve_id", F.concat_ws("|", *parts)).groupBy("curve_id").agg(
        F.count("*").alias("nodes"))
    return df.join(sizes.filter("nodes >= 2"), "curve_id").drop(SLICE)


def curve_groups(nodes: DataFrame, keys: Sequence[str] = CURVE_KEY) -> DataFrame:
    """One row per curve with its ordered nodes as an array.

    The array is the shape of the report; its length is the number of strikes
    listed for one asset and expiry.
    """
    node = F.struct("strike_or_threshold", "event_id", "pm_yes", "opt_yes", "gap_pp", "relative_gap")
    kind = F.when(F.col("event_type") == "touch", "touch_probability").otherwise("terminal_probability")
    return nodes.groupBy("curve_id", *keys).agg(F.array_sort(F.collect_list(node)).alias("nodes")).withColumn(
        "curve_type", kind)


def monotonicity_violations(nodes: DataFrame) -> DataFrame:
    """Adjacent strikes whose probability moves the wrong way, per leg."""
    sign = F.when(F.col("direction") == "up", -1).otherwise(1)
    wrong = lambda leg: F.when(
        sign * (F.col(f"upper.{leg}") - F.col(leg)) < -TOLERANCE, F.lit(leg))
    return nodes.select(
        "curve_id", F.col("event_id").alias("lower_event"), F.col("upper.event_id").alias("upper_event"),
        F.explode(F.array_compact(F.array(wrong("pm_yes"), wrong("opt_yes")))).alias("source"))


def gap_extrema(nodes: DataFrame) -> DataFrame:
    """Middle nodes where the gap difference changes sign."""
    rise, fall = F.col("gap_pp") - F.col("lower.gap_pp"), F.col("upper.gap_pp") - F.col("gap_pp")
    return nodes.filter(rise * fall < 0).select("curve_id", "event_id", "strike_or_threshold", "gap_pp")


def side_clusters(nodes: DataFrame, strike_slice: float = 100.0) -> DataFrame:
    """Members of maximal runs of one side, two or longer."""
    differs = F.when(F.col("lower.side").isNull() | (F.col("lower.side") != F.col("side")), 1).otherwise(0)
    runs = running(nodes, ["curve_id"], _ORDER, {"cluster_no": total(differs)},
                   F.floor(F.col("strike_or_threshold") / F.lit(strike_slice)), restart=True)
    sizes = runs.groupBy("curve_id", "cluster_no").agg(F.count("*").alias("size")).filter("size >= 2")
    return runs.join(sizes, ["curve_id", "cluster_no"]).select(
        "curve_id", "cluster_no", "size", "event_id", "side", "strike_or_threshold")
