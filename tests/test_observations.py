"""Dynamics, episodes, curves: folds on small fixtures and stated properties."""

import random

import pytest
from pyspark.sql import functions as F

from gapweave.config import Config
from gapweave.operators import curves, dynamics, episodes

SCHEMA = ("event_id string, asset string, mapping_hash string, raw_id bigint, now_ms bigint, pm_yes double, opt_yes double, spot double, "
          "gap_pp double, relative_gap double, expiry bigint, valid boolean, source_state string, trigger_kind string, opt_timestamp bigint")


def row(i, t, p=0.6, q=0.4, valid=True, mapping="map", expiry=10**12, key="m", spot=100.0):
    gap = 100 * (p - q) if valid else None
    rel = abs(p - q) / q if valid and q else None
    return (key, "BTC", mapping, i, int(t), p, q, spot, gap, rel, expiry, valid, "OK" if valid else "STALE", "pm", int(t))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_velocity_and_travel_of_a_steady_rise(spark):
    rows = [row(t + 1, t * 1000, 0.5 + t * 0.001, 0.4 + t * 0.0001) for t in range(32)]
    last = dynamics.dynamics(frame(spark, rows)).orderBy(F.col("raw_id").desc()).first()
    assert last.pm_travel == pytest.approx(10 / 11)
    assert last.velocity_pp_s == pytest.approx(0.09)
    assert last.trend == "OPENING FAST"
    assert last.change_30.reference_raw_id == 2


def _dynamics_fold(rows, config):
    """Direct walk with one anchor per second, as the operator is specified."""
    out, history = {}, []
    for r in rows:
        rid, now, pm, opt, spot, gap, valid = r[3], r[4], r[5], r[6], r[7], r[8], r[11]
        change, velocity, accel = {}, None, None
        if valid:
            for h in dynamics.HORIZONS:
                past = next((a for a in reversed(history) if a["t"] <= now - h * 1000 and a["valid"]), None)
                if past and now - h * 1000 - past["t"] <= max(1000, h * 200):
                    change[h] = (gap - past["gap"], (now - past["t"]) / 1000, past["id"])
            used = next((change[h] for h in (30, 15, 5, 1) if h in change), None)
            if used:
                velocity = used[0] / used[1]
                prior = next((a for a in reversed(history) if a["v"] is not None and now - a["t"] >= 1000), None)
                if prior:
                    accel = (velocity - prior["v"]) / ((now - prior["t"]) / 1000)
        out[rid] = ({h: c[2] for h, c in change.items()}, velocity, accel)
        anchor = dict(t=now, valid=valid, gap=gap, id=rid, v=velocity)
        if history and history[-1]["t"] // 1000 == now // 1000:
            history[-1] = anchor
        else:
            history.append(anchor)
        history = [a for a in history if now - a["t"] <= 7_200_000]
    return out


def test_dynamics_equal_the_walk_across_slices(spark):
    rng, rows, t = random.Random(11), [], 0
    for i in range(500):
        t += rng.choice([100, 400, 1500, 4000, 30_000, 600_000])
        rows.append(row(i, t, rng.random(), rng.random(), rng.random() > 0.1))
    want = _dynamics_fold(rows, Config())
    for r in dynamics.dynamics(frame(spark, rows)).collect():
        refs = {h: r[f"change_{h}"].reference_raw_id for h in dynamics.HORIZONS if r[f"change_{h}"]}
        assert refs == want[r.raw_id][0]
        for got, expect in ((r.velocity_pp_s, want[r.raw_id][1]), (r.acceleration_pp_s2, want[r.raw_id][2])):
            assert (got is None) == (expect is None) and (got is None or got == pytest.approx(expect))


def test_future_rows_change_nothing_earlier(spark):
    rows = [row(t + 1, t * 1000, 0.5 + t * 0.001) for t in range(40)]
    columns = ["raw_id", "velocity_pp_s", "trend"]
    short = dynamics.dynamics(frame(spark, rows[:20])).select(*columns).orderBy("raw_id").collect()
    whole = dynamics.dynamics(frame(spark, rows)).select(*columns).orderBy("raw_id").limit(20).collect()
    assert short == whole


def _episode_fold(rows, config):
    active, out = {}, []
    for r in rows:
        key, mapping, rid, now, gap, expiry, valid = r[0], r[2], r[3], r[4], r[8], r[10], r[11]
        ep = active.get(key)
        before, reason = ep and ep[0], None
        if ep:
            if ep[2] != mapping:
                reason = "MAPPING_CHANGED"
            elif expiry <= now:
                reason = "EXPIRED"
            elif not valid:
                reason = "DATA_GAP"
            elif ep[1] * gap < 0:
                reason = "REVERSAL"
            elif abs(gap) <= config.close_gap_pp:
                reason = "CONVERGENCE"
            if reason:
                del active[key]
        if valid and key not in active and abs(gap) >= config.open_gap_pp:
            active[key] = (rid, gap, mapping)
        out.append((key, rid, before, active.get(key, (None,))[0], reason))
    return out


def _episode_rows(seed, n=300):
    rng, rows = random.Random(seed), []
    for i in range(n):
        p = 0.5 + rng.choice([-0.08, -0.045, -0.02, -0.005, 0, 0.005, 0.02, 0.045, 0.08])
        rows.append(row(i, i * 1000, p, 0.5, rng.random() > 0.15, rng.choice(["a", "a", "a", "b"]) if rng.random() < 0.2 else "a",
                        rng.choice([10**12, 10**12, i * 1000]), rng.choice("xy")))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_episodes_equal_the_fold(spark, seed):
    rows = _episode_rows(seed)
    got = [tuple(r) for r in episodes.gap_episodes(frame(spark, rows), Config(), slice_rows=17).select(
        "event_id", "raw_id", "start_before", "start_after", "close_reason").collect()]
    assert sorted(got, key=lambda r: r[1]) == _episode_fold(rows, Config())


def test_lifecycle_states_and_reversal(spark):
    rows = [row(1, 0, 0.45, 0.4), row(2, 1000, 0.50, 0.4), row(3, 2000, 0.399, 0.4)]
    rev = episodes.episode_revisions(episodes.gap_episodes(frame(spark, rows))).orderBy("raw_id").collect()
    assert [r.state for r in rev] == ["NEW", "PEAK", "CLOSED"]
    assert rev[2].close_reason == "REVERSAL" and rev[2].max_abs_gap_pp == pytest.approx(10)
    assert episodes.episode_summary(episodes.episode_revisions(episodes.gap_episodes(frame(spark, rows)))).count() == 1


def test_outage_is_not_convergence(spark):
    rows = [row(1, 0), row(2, 1000, valid=False)]
    reasons = [r.close_reason for r in episodes.gap_episodes(frame(spark, rows)).collect() if r.close_reason]
    assert reasons == ["DATA_GAP"]


def test_native_jumps_keep_subsecond_order_and_clear_on_breaks(spark):
    rows = [row(1, 0, 0.4, 0.4), row(2, 100, 0.41, 0.4), row(3, 700, 0.41, 0.41)]
    jumps = dynamics.native_jumps(frame(spark, rows))
    assert sorted((j.timestamp, j.leg) for j in jumps.collect()) == [(100, "pm"), (700, "opt")]
    broken = frame(spark, rows + [row(4, 1000, valid=False)])
    assert dynamics.live_jumps(broken, dynamics.native_jumps(broken), 2000).count() == 0
    assert dynamics.live_jumps(frame(spark, rows), jumps, 2000).count() == 2


def test_curve_monotonicity_and_kinds(spark):
    def nodes(types):
        data = [(str(i), "BTC", 1, kind, "up", 100.0 + i * 10, p, q, 100 * (p - q), "CHEAP" if p > q else "RICH" if p < q else "EVEN", True)
                for i, (kind, p, q) in enumerate(zip(types, (0.6, 0.7, 0.2), (0.6, 0.5, 0.4)))]
        df = spark.createDataFrame(data, "event_id string, asset string, expiry bigint, event_type string, direction string, "
                                         "strike_or_threshold double, pm_yes double, opt_yes double, gap_pp double, side string, valid boolean")
        return curves.curve_nodes(df.withColumns({"window_start": F.lit(None).cast("bigint"), "settlement_source": F.lit("c"),
                                                  "threshold_inclusive": F.lit(None).cast("boolean"), "relative_gap": F.lit(0.0)}), strike_slice=10.0)

    assert curves.monotonicity_violations(nodes(["terminal"] * 3)).count() == 1
    assert nodes(["terminal", "touch", "terminal"]).count() == 2
