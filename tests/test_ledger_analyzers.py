"""Ledger walks, analyzers and volatility against direct computation; streams against batch."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.config import Config
from gapweave.operators import analyzers as A
from gapweave.operators import episodes, ledger, thesis
from gapweave.operators.clock import accept_newer
from gapweave.streaming import stateful
from tests.test_observations import SCHEMA, _episode_rows, frame, row
from tests.test_running import _ticks

FILLS = ("run_id string, wallet_id string, instrument string, ledger_id bigint, timestamp_ms bigint, side string, quantity double, multiplier int, "
         "bid double, ask double, fees double, slippage double, total_debit double, realized_pnl double, reason string, flat_after boolean")


def _fills(seed, n=400):
    rng, rows = random.Random(seed), []
    for i in range(n):
        side = rng.choice(["BUY", "BUY", "SELL"])
        price = rng.uniform(5, 15)
        q = float(rng.choice([1, 2, 5]))
        rows.append((rng.choice(["r1", "r2"]), "w", rng.choice("xy"), i, i * 1000, side, q, 100, price * 0.99, price * 1.01, 1.3, 0.7,
                     price * q * 101 if side == "BUY" else None, 3.0 if side == "SELL" else None, "why", False))
    return rows


def _lots(rows):
    lots, out = {}, {}
    for run, _, ins, i, _, side, q, mult, bid, ask, fees, slip, debit, pnl, _, _ in rows:
        lot = lots.setdefault((run, ins), np.zeros(6))
        units, mid, half = q * mult, (bid + ask) / 2, (ask - bid) / 2
        if side == "BUY":
            lot += np.array([q, units * mid, units * half, fees, slip, debit])
            continue
        if lot[0] < 1e-9 or lot[0] < q - 1e-9:
            out[i] = None
            continue
        part = lot * min(1.0, q / lot[0])
        lot -= part
        out[i] = (units * mid - part[1], units * half + part[2], fees + part[3], slip + part[4], part[5])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lots_equal_the_walk(spark, seed):
    rows = _fills(seed)
    want = _lots(rows)
    got = ledger.closed_lot_attribution(spark.createDataFrame(rows, FILLS)).collect()
    assert {r.ledger_id for r in got} == set(want)
    for r in got:
        expect = want[r.ledger_id]
        assert (r.status == "missing_entry") == (expect is None)
        if expect:
            assert (r.mid_move_pnl, r.spread_cost, r.fees, r.slippage, r.invested) == pytest.approx(expect, rel=1e-9, abs=1e-7)


def test_a_lot_trimmed_a_thousand_times_keeps_its_amounts(spark):
    """Buy one, sell half, 1,200 times and never flat; the plain loop is the measure, in one slice and in many."""
    rows = []
    for i in range(1200):
        rows += [("r1", "w", "x", 2 * i, 2000 * i, "BUY", 1.0, 100, 9.9 + i % 7, 10.1 + i % 7, 1.3, 0.7, 1010.0 + i, None, "why", False),
                 ("r1", "w", "x", 2 * i + 1, 2000 * i + 1000, "SELL", None, 100, 10.9, 11.1, 1.1, 0.2, None, 3.0, "why", False)]
    position, out = 0.0, []
    for r in rows:
        q = r[6] if r[5] == "BUY" else position / 2
        position += q if r[5] == "BUY" else -q
        out.append((*r[:6], q, *r[7:]))
    want = _lots(out)
    for slice_rows in (1_000_000, 100):
        got = ledger.closed_lot_attribution(spark.createDataFrame(out, FILLS), slice_rows=slice_rows).collect()
        assert {r.ledger_id for r in got} == set(want) and all(r.status != "missing_entry" for r in got)
        for r in got:
            assert (r.mid_move_pnl, r.spread_cost, r.fees, r.slippage, r.invested) == pytest.approx(want[r.ledger_id], rel=1e-9, abs=1e-7)
            assert r.opened_at == 0 and r.entries == r.ledger_id // 2 + 1


def test_fills_after_the_review_time_do_not_count(spark):
    rows = spark.createDataFrame(_fills(1), FILLS)
    assert ledger.closed_lot_attribution(rows, now_ms=100_000).agg(F.max("ledger_id")).first()[0] <= 100


def test_covariance_distance_equals_numpy(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(64, 4)), rng.normal(size=(64, 4)) @ np.diag([1, 2, 0.5, 1])
    za, zb = (a - a.mean(0)) / a.std(0), (b - a.mean(0)) / a.std(0)
    ca, cb = np.cov(za, rowvar=False) + np.eye(4) * 1e-3, np.cov(zb, rowvar=False) + np.eye(4) * 1e-3
    want = math.sqrt((np.log(np.linalg.eigvals(np.linalg.solve(ca, cb)).real) ** 2).sum())
    data = [("m", k, i, *map(float, m[i])) for k, m in ((0, a), (1, b)) for i in range(64)]
    df = spark.createDataFrame(data, "event_id string, current int, pos int, pm_yes double, opt_yes double, gap_pp double, spot double")
    z = A.baseline_standardize(df)
    assert A.covariances(z).select(A.spd_distance("ca", "cb")).first()[0] == pytest.approx(want)
    same = z.filter("current = 0")
    twin = same.unionByName(same.withColumn("current", F.lit(1)))
    score = A.wasserstein_score(A.sliced_wasserstein(twin)).first().score
    assert score == pytest.approx(0, abs=1e-12)
    assert A.wasserstein_score(A.sliced_wasserstein(z)).first().score > 0.05
    assert A.covariances(twin).select(A.spd_distance("ca", "cb")).first()[0] == pytest.approx(0, abs=1e-9)


def test_planted_lag_gives_the_direction(spark):
    rng = np.random.default_rng(8)
    steps = rng.normal(size=200) * 0.01
    pm, opt, spot = np.cumsum(steps), np.cumsum(np.roll(steps, 1)), 100 + np.cumsum(rng.normal(size=200))
    data = [("m", i * 15_000, float(pm[i]), float(opt[i]), float(spot[i]), i * 15_000, i) for i in range(200)]
    grid = spark.createDataFrame(data, "event_id string, timestamp bigint, pm_yes double, opt_yes double, spot double, opt_timestamp bigint, raw_id bigint")
    verdict = {r.scale: r.direction for r in A.lead_lag(grid, Config()).collect()}
    assert verdict[15.0] == "PM_LEADS_OPT" and verdict[5.0] == "INSUFFICIENT"


def test_motifs_keep_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (3.0, 1.0, 2.0), (2.0, 1.0, 2.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(A.ordinal_motif(*map(F.col, "abc"))).collect()] == ["ties:0,1", "ordinal:120", "ties:-1,1"]


def test_realized_vol_walk(spark):
    rng, rows, t = random.Random(2), [], 0
    for i in range(300):
        t += rng.choice([5_000, 20_000, 20_000, 55_000])
        rows.append(row(i, t, spot=100 * math.exp(rng.gauss(0, 0.01))))
    now = rows[-1][4]
    kept = []
    for r in rows:
        if r[4] < now - 3_600_000:
            continue
        if kept and r[4] - kept[-1][0] > 120_000:
            kept = []
        if not kept or r[4] - kept[-1][0] >= 60_000:
            kept.append((r[4], r[7]))
    logs = np.diff(np.log([s for _, s in kept]))
    want = logs.std(ddof=1) * math.sqrt(365.25 * 86400 / ((kept[-1][0] - kept[0][0]) / 1000 / len(logs)))
    got = thesis.realized_vol(frame(spark, rows), now).first()
    assert got.samples == len(kept) and got.realized_vol == pytest.approx(want)


def _run_stream(spark, parts, transform, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = transform(spark.readStream.schema(part.schema).parquet(source))
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


def test_streamed_episodes_equal_batch(spark, tmp_path):
    rows = _episode_rows(9, 240)
    parts = [frame(spark, rows[i:i + 80]) for i in (0, 80, 160)]
    got = _run_stream(spark, parts, stateful.gap_episodes, tmp_path)
    columns = ["event_id", "raw_id", "start_before", "start_after", "close_reason"]
    want = episodes.gap_episodes(spark.createDataFrame(rows, SCHEMA)).select(*columns)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.collect()))


def test_streamed_acceptance_equals_batch(spark, tmp_path):
    schema = "id bigint, key string, received_ms bigint, source_ms bigint, v double"
    rows = _ticks(150)
    parts = [spark.createDataFrame(rows[i:i + 50], schema) for i in (0, 50, 100)]
    got = _run_stream(spark, parts, lambda s: stateful.accept_newer(s, ["key"]), tmp_path)
    want = accept_newer(spark.createDataFrame(rows, schema), ["key"])
    assert sorted(map(tuple, got.select("id", "verdict").collect())) == sorted(map(tuple, want.select("id", "verdict").collect()))
