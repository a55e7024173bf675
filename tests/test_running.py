"""Sliced running values and as-of joins equal their plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from gapweave.operators.asof import asof_join
from gapweave.operators.clock import accept_newer, effective_clock
from gapweave.operators.running import first, highest, id_slices, last, lowest, running, total


def _ticks(n=400, seed=5):
    rng = random.Random(seed)
    rows, clock = [], 1_000_000
    for i in range(n):
        clock += rng.choice([0, 0, 500, 4000, -3000])
        source = rng.choice([None, clock - 9000, clock - 1000, clock, clock + 4000, clock + 9000])
        # one hot key holds most of the rows
        rows.append((i, "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", None]), clock, source, rng.choice([None, rng.random()])))
    return rows


@pytest.fixture(scope="module")
def ticks(spark):
    return spark.createDataFrame(_ticks(), "id bigint, key string, received_ms bigint, source_ms bigint, v double")


@pytest.mark.parametrize("reverse", [False, True])
def test_slices_equal_one_window(ticks, reverse):
    specs = {"a": last(F.col("v")), "b": last(F.col("v"), inclusive=False), "c": first(F.col("v")), "d": highest(F.col("v")),
             "e": lowest(F.col("v"), inclusive=False), "f": total(F.lit(1))}
    one = running(ticks, ["key"], ["id"], specs, None, reverse)
    many = running(ticks, ["key"], ["id"], specs, id_slices("id", 7), reverse)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def _scans(df):
    """File scans of a plan, from its text."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_stacked_values_read_each_stage_twice(spark, ticks, tmp_path):
    from gapweave.operators import curves, episodes, legs

    ticks.write.parquet(str(tmp_path / "ticks"))
    t = spark.read.parquet(str(tmp_path / "ticks"))
    obs = t.select(
        F.col("key").alias("event_id"), F.col("id").alias("raw_id"), F.col("received_ms").alias("now_ms"), F.lit("m").alias("mapping_hash"),
        F.lit(None).cast("bigint").alias("expiry"), F.lit(0.5).alias("pm_yes"), F.lit(0.4).alias("opt_yes"), (F.col("v") * 20 - 10).alias("gap_pp"), F.col("v").isNotNull().alias("valid"))
    assert _scans(episodes.gap_episodes(obs, slice_rows=50)) <= 2
    books = t.select("id", F.lit(0).alias("message_no"), F.lit(0).alias("change_no"), F.col("key").alias("token"), "received_ms", "source_ms", F.lit(True).alias("bid_set"),
                     F.lit(True).alias("ask_set"), F.col("v").alias("bid"), F.col("v").alias("ask"), F.lit(None).cast("string").alias("depth"))
    assert _scans(legs.book_state(books, slice_rows=50)) <= 2
    nodes = t.filter("v IS NOT NULL").select(
        F.col("id").cast("string").alias("event_id"), "key", F.col("v").alias("strike_or_threshold"), F.lit(0.5).alias("pm_yes"), F.lit(0.4).alias("opt_yes"), F.lit(1.0).alias("gap_pp"),
        F.lit("RICH").alias("side"), F.lit(True).alias("valid"))
    clusters = curves.side_clusters(curves.curve_nodes(nodes, ["key"], 0.1), 0.1)
    assert _scans(clusters) <= 4 and clusters.count() > 0


def test_clock_never_moves_backward(ticks):
    rows = effective_clock(ticks, slice_rows=11).orderBy("id").collect()
    best = 0
    for r in rows:
        best = max(best, r.received_ms)
        assert r.now_ms == best


@pytest.mark.parametrize("width", [5, 1000])
def test_acceptance_equals_the_fold(ticks, width):
    got = {r.id: r.verdict for r in accept_newer(ticks, ["key"], slice_rows=width).collect()}
    held = {}
    for i, key, now, source, _ in _ticks():
        if source is None:
            held[key], want = now, "ACCEPTED"
        elif source > now + 5000:
            want = "CLOCK_ERROR"
        elif key in held and source < held[key]:
            want = "DELAYED"
        else:
            held[key], want = source, "ACCEPTED"
        assert got[i] == want, i


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
@pytest.mark.parametrize("width", [None, 13])
def test_asof_equals_brute_force(spark, direction, strict, width):
    rng = random.Random(3)
    left = [(i, rng.choice("ab"), rng.randrange(60)) for i in range(80)]
    right = [(i, rng.choice("ab"), rng.randrange(60)) for i in range(30)]
    l = spark.createDataFrame(left, "id bigint, k string, t bigint")
    r = spark.createDataFrame(right, "rid bigint, k string, u bigint")
    got = {x.id: x.rid for x in asof_join(l, r, ["k"], "t", "u", ["rid"], ["rid"], tolerance=9, direction=direction,
                                          strict=strict, slice_width=width).collect()}
    for i, k, t in left:
        if direction == "backward":
            fits = [(u, j) for j, kk, u in right if kk == k and (u < t or (u == t and not strict))]
            best = max(fits, default=None)
        else:
            fits = [(u, j) for j, kk, u in right if kk == k and (u > t or (u == t and not strict))]
            best = min(fits, default=None)
        want = best[1] if best and abs(best[0] - t) <= 9 else None
        assert got[i] == want
