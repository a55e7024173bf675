"""Registered queries: evidence, candidates, theses and stress scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PolicyConfig
from ..functions import pricing as P
from ..functions.pricing import THESIS_YEAR_SECONDS
from ..operators import dynamics, history
from ..operators import thesis as T
from .fixtures import CONFIG, DAY, SCALE, START, observations, r6, table
from .q_observe import ncdf
from .registry import query, view

NOW = START + 30 * DAY
B = SCALE * 1000


@query("realized_vol", f"""WITH RECURSIVE a AS (SELECT event_id, now_ms, spot, row_number() OVER (PARTITION BY event_id ORDER BY now_ms, raw_id) AS n FROM usable WHERE now_ms >= {NOW - 3600 * B}),
w AS (SELECT event_id, n, now_ms AS held_at, [now_ms] AS times, [spot] AS kept FROM a WHERE n = 1 UNION ALL
 SELECT a.event_id, a.n, CASE WHEN a.now_ms - held_at > {120 * B} OR a.now_ms - held_at >= {60 * B} THEN a.now_ms ELSE held_at END,
  CASE WHEN a.now_ms - held_at > {120 * B} THEN [a.now_ms] WHEN a.now_ms - held_at >= {60 * B} THEN list_append(times, a.now_ms) ELSE times END,
  CASE WHEN a.now_ms - held_at > {120 * B} THEN [a.spot] WHEN a.now_ms - held_at >= {60 * B} THEN list_append(kept, a.spot) ELSE kept END
 FROM w JOIN a ON a.event_id = w.event_id AND a.n = w.n + 1),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC) = 1),
r AS (SELECT event_id, unnest(range(1, len(kept))) AS i, times, kept FROM f)
SELECT f.event_id, CAST(len(f.kept) AS BIGINT) AS samples, CASE WHEN len(f.kept) >= 11 THEN round(v * sqrt({THESIS_YEAR_SECONDS} / ((f.times[-1] - f.times[1]) / {B}::DOUBLE / (len(f.kept) - 1))), 6) + 0.0 END AS realized_vol
FROM f LEFT JOIN (SELECT event_id, stddev_samp(ln(kept[i + 1] / kept[i])) AS v FROM r GROUP BY event_id) g USING (event_id)""")
def realized_vol(spark, d):
    """Hourly realized volatility of the per-second anchors; the sample spacing is order-dependent."""
    v = T.realized_vol(observations(spark, d), NOW, CONFIG)
    return v.select("event_id", "samples", r6(F.col("realized_vol")).alias("realized_vol"))


def _return_sql(s: int) -> str:
    past = f"(SELECT struct_pack(t := max(now_ms), s := arg_max(spot, raw_id)) FROM usable u WHERE u.event_id = l.event_id AND u.now_ms <= {NOW - s * B} AND u.now_ms >= {NOW - 3660 * B})"
    return f"CASE WHEN {NOW - s * B} - {past}.t <= {60 * B} THEN round(l.spot / {past}.s - 1, 6) + 0.0 END AS return_{s}"


view("usable", f"""SELECT o.* FROM (SELECT *, max(raw_id) OVER (PARTITION BY event_id, mapping_hash, now_ms // {B}) AS newest FROM obs WHERE now_ms <= {NOW}) o
 JOIN (SELECT event_id, arg_max(mapping_hash, raw_id) AS now_mapped FROM obs WHERE now_ms <= {NOW} GROUP BY event_id) m USING (event_id)
 WHERE raw_id = newest AND mapping_hash IS NOT DISTINCT FROM now_mapped AND source_state = 'PROXY' AND spot > 0""")


@query("spot_returns", f"SELECT event_id, {', '.join(_return_sql(s) for s in T.RETURN_SECONDS)} FROM (SELECT event_id, arg_max(spot, raw_id) AS spot FROM obs WHERE now_ms <= {NOW} GROUP BY event_id) l")
def spot_returns(spark, d):
    r = dynamics.asof_returns(observations(spark, d), NOW, T.RETURN_SECONDS, T.RETURN_TOLERANCE_S, CONFIG)
    return r.select("event_id", *[r6(F.col(c)).alias(c) for c in r.columns[1:]])


view("daily", "SELECT o_custkey % 30 AS a, o_orderdate AS session, max(o_totalprice) AS close FROM orders GROUP BY 1, 2")


@query("session_returns", """SELECT 'A' || a AS asset, round(spot / nullif(c1, 0) - 1, 6) + 0.0 AS return_1, round(spot / nullif(c5, 0) - 1, 6) + 0.0 AS return_5, round(spot / nullif(c20, 0) - 1, 6) + 0.0 AS return_20 FROM (
 SELECT a, 100000.0 + a * 10 AS spot, max(CASE WHEN n = 2 THEN close END) AS c1, max(CASE WHEN n = 6 THEN close END) AS c5, max(CASE WHEN n = 21 THEN close END) AS c20
 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY session DESC) AS n FROM daily) GROUP BY a)""")
def session_returns(spark, d):
    o = table(spark, d, "orders").withColumn("a", F.col("o_custkey") % 30)
    asset = F.concat(F.lit("A"), F.col("a")).alias("asset")
    daily = o.groupBy(asset, F.col("o_orderdate").alias("session")).agg(F.max("o_totalprice").alias("close"))
    spots = o.select(asset, (F.col("a") * 10 + 100_000.0).alias("spot")).distinct()
    s = T.session_returns(daily, spots)
    return s.select("asset", *[r6(F.col(c)).alias(c) for c in s.columns[1:]])


_WALLETS = ("SW", "EVENT_SYNC", "LEAD_LAG", "COVARIANCE", "TOPOLOGY", "ORDINAL_MMD", "MARTINGALE")
_WALLET_SQL = "CASE o_custkey % 7 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WALLETS)) + " END"
view("signal_rows", f"""SELECT o_orderkey, {_WALLET_SQL} AS wallet, CASE WHEN o_orderstatus = 'P' THEN 'insufficient_data' ELSE 'ok' END AS status, o_totalprice / 500000 AS score,
  (o_totalprice % 1000) / 1000 AS u, o_orderkey % 6 AS triggers FROM orders""")


@query("signal_qualifies", """SELECT o_orderkey, wallet, coalesce(status = 'ok' AND CASE wallet WHEN 'SW' THEN score >= 0.25 WHEN 'COVARIANCE' THEN score >= 0.5 WHEN 'TOPOLOGY' THEN score >= 0.1 WHEN 'ORDINAL_MMD' THEN score >= 0.05
   WHEN 'LEAD_LAG' THEN u < 0.5 AND score >= 0.15 WHEN 'EVENT_SYNC' THEN triggers >= 3 AND u >= 0.4 AND u > score ELSE u > 0.5 AND score * 12 >= 10 END, false) AS qualifies FROM signal_rows""")
def signal_qualifies(spark, d):
    o = table(spark, d, "orders")
    wallet = F.element_at(F.array(*[F.lit(w) for w in _WALLETS]), (F.col("o_custkey") % 7 + 1).cast("int"))
    score, u = F.col("o_totalprice") / 500_000, (F.col("o_totalprice") % 1000) / 1000
    s = o.select(
        "o_orderkey", wallet.alias("wallet"), F.when(F.col("o_orderstatus") == "P", "insufficient_data").otherwise("ok").alias("status"),
        F.when(wallet == "MARTINGALE", score * 12).otherwise(score).alias("raw_score"),
        F.array(F.struct(F.lit(60.0).alias("scale"), F.when(u < 0.5, "PM_LEADS_OPT").otherwise("AMBIGUOUS").alias("direction"), score.alias("strength"))).alias("scales"),
        F.array(F.struct(F.lit(60.0).alias("window_seconds"), (F.col("o_orderkey") % 6).alias("pm_triggers"), u.alias("pm_probability"), score.alias("opt_probability"))).alias("windows"),
        (u > 0.5).alias("valid_e_process"))
    return T.signal_qualifies(s).select("o_orderkey", "wallet", "qualifies")


# Latest rows of comparable propositions: one per part, fresh or stale by size.
view("latest_rows", f"""
SELECT *, (pm_yes - opt_yes) * 100 AS gap_pp, (pm_yes - opt_yes) * 100 IS NOT NULL AND state = 'PROXY' AND age BETWEEN 0 AND 59999 AND NOT wide AND NOT indicative AS peer FROM (
SELECT p_partkey, p_brand, p_partkey % 3 AS g, 'e' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS event_id, p_retailprice AS k, 0.3 + p_size / CAST(100 AS DOUBLE) AS pm_yes, 0.2 + (p_partkey % 40) / CAST(100 AS DOUBLE) AS opt_yes,
  CASE WHEN p_size % 9 = 0 THEN 'STALE' ELSE 'PROXY' END AS state, CAST(p_size % 13 AS BIGINT) * 6000 AS age, p_size % 11 = 0 AS wide, p_size % 7 = 0 AS indicative,
  CASE WHEN p_partkey % 10 > 0 THEN (p_partkey % 21 - 10) / CAST(10 AS DOUBLE) END AS m_pm, (p_partkey % 5) / CAST(10 AS DOUBLE) AS m_opt, p_size / CAST(2000 AS DOUBLE) AS half FROM part)""")
view("evidence_rows", """
SELECT r.*, (SELECT list(x.gap ORDER BY x.d, x.k) FROM (SELECT abs(p.k - r.k) AS d, p.k, arg_min(p.gap_pp, p.event_id) AS gap FROM latest_rows p WHERE p.p_brand = r.p_brand AND p.g = r.g AND p.peer AND p.k <> r.k GROUP BY p.k ORDER BY d, p.k LIMIT 2) x) AS near
FROM latest_rows r""")
view("evidence", """
SELECT *, CASE WHEN m_pm IS NULL THEN 'NEED_PM_MOVEMENT_HISTORY' WHEN abs(m_pm) < 0.1 OR m_pm * gap_pp <= 0 THEN 'NEED_PM_MOVE_IN_GAP_DIRECTION' WHEN abs(m_pm) / (abs(m_pm) + abs(m_opt)) < 0.6 THEN 'CONVENTIONAL_REPRICING_DOMINATES'
  WHEN abs(gap_pp) <= 100 * ((pm_yes + half) - (pm_yes - half)) THEN 'GAP_WITHIN_PM_SPREAD' WHEN coalesce(len(near), 0) < 2 OR near[1] * gap_pp <= 0 OR near[2] * gap_pp <= 0 THEN 'NEED_TWO_AGREEING_NEIGHBORS' ELSE 'SUPPORTED' END AS evidence FROM evidence_rows""")


def latest_rows(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    pm, opt = size / F.lit(100.0) + 0.3, k % 40 / F.lit(100.0) + 0.2
    half = size / F.lit(2000.0)
    return table(spark, d, "part").select(
        F.concat(F.lit("e"), F.lpad(k.cast("string"), 9, "0")).alias("event_id"), F.col("p_brand").alias("asset"), F.lit(START).alias("expiry"),
        F.concat(F.lit("t"), k % 3).alias("event_type"), F.lit("up").alias("direction"), F.lit(None).cast("bigint").alias("window_start"),
        F.lit(None).cast("string").alias("settlement_source"), F.lit(None).cast("boolean").alias("threshold_inclusive"), F.col("p_retailprice").alias("strike_or_threshold"),
        pm.alias("pm_yes"), opt.alias("opt_yes"), ((pm - opt) * 100).alias("gap_pp"), (pm - half).alias("pm_bid"), (pm + half).alias("pm_ask"),
        F.when(size % 9 == 0, "STALE").otherwise("PROXY").alias("source_state"), (F.lit(NOW) - (size % 13).cast("bigint") * 6000).alias("now_ms"),
        F.when(size % 11 == 0, F.array(F.lit("WIDE_PM_BOOK"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
        F.when(size % 7 == 0, "gamma_indicative").otherwise("clob_mid").alias("pm_source"), (k % 50).alias("mapping_ref"),
        F.when(k % 10 > 0, F.struct(((k % 21 - 10) / F.lit(10.0)).alias("pm_pp"), (k % 5 / F.lit(10.0)).alias("opt_pp"))).alias("move"))


@query("entry_evidence", "SELECT event_id, evidence FROM evidence")
def entry_evidence(spark, d):
    return T.entry_evidence(latest_rows(spark, d), NOW, strike_slice=20.0).select("event_id", "evidence")


@query("entry_candidates", f"""SELECT wallet, event_id, asset, CAST(trade AS INTEGER) AS trade_direction, CAST(row_number() OVER (PARTITION BY wallet ORDER BY abs(gap_pp) DESC, event_id) AS BIGINT) AS rank FROM (
 SELECT s.wallet, e.event_id, e.p_brand AS asset, e.gap_pp, CASE WHEN e.gap_pp > 0 THEN 1 ELSE -1 END AS trade FROM evidence e JOIN (
   SELECT {_WALLET_SQL} AS wallet, 'e' || lpad(CAST(min(o_custkey) AS VARCHAR), 9, '0') AS event_id, o_orderkey % 60 AS ref, o_orderkey % 400 AS age, o_custkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL) s USING (event_id)
 WHERE s.age * 1000 <= 180000 AND e.p_partkey % 50 <= s.ref AND e.state = 'PROXY' AND e.age < 60000 AND NOT e.wide AND NOT e.indicative AND e.evidence = 'SUPPORTED' AND e.p_partkey % 7 > 0 AND e.pm_yes BETWEEN 0.02 AND 0.98 AND e.opt_yes BETWEEN 0.02 AND 0.98
  AND abs(e.gap_pp) >= 0.75 AND NOT (s.wallet = 'SW' AND e.p_brand IN (SELECT 'Brand#' || n_nationkey FROM nation WHERE n_regionkey = 1)))""")
def entry_candidates(spark, d):
    o = table(spark, d, "orders")
    wallet = F.element_at(F.array(*[F.lit(w) for w in _WALLETS]), (F.col("o_custkey") % 7 + 1).cast("int"))
    signals = o.select(
        wallet.alias("wallet"), F.concat(F.lit("e"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("event_id"), (F.lit(NOW) - F.col("o_orderkey") % 400 * 1000).alias("signal_ms"),
        (F.col("o_orderkey") % 60).alias("signal_raw_id"), (F.col("o_orderstatus") != "P").alias("qualifies")).distinct()
    held = table(spark, d, "nation").filter("n_regionkey = 1").select(F.lit("SW").alias("wallet"), F.concat(F.lit("Brand#"), "n_nationkey").alias("asset"))
    theses = table(spark, d, "part").select(F.concat(F.lit("e"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("event_id"), (F.col("p_partkey") % 7 > 0).alias("eligible"))
    c = T.entry_candidates(T.entry_evidence(latest_rows(spark, d), NOW, strike_slice=20.0), signals, NOW, held, theses)
    return c.select("wallet", "event_id", "asset", "trade_direction", "rank")


# ------------------------------------------------------------------- theses ----------
view("thesis_rows", f"""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'STALE' ELSE 'PROXY' END AS state, (o_custkey % 100 - 50) / CAST(5 AS DOUBLE) AS gap, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END AS dir, CASE WHEN o_custkey % 17 > 0 THEN 900.0 + o_custkey % 90 END AS spot,
  900.0 + o_orderkey % 100 AS strike, CASE WHEN o_orderkey % 19 > 0 THEN 0.2 + (o_orderkey % 50) / CAST(100 AS DOUBLE) END AS iv, CASE WHEN o_orderkey % 3 > 0 THEN 0.05 + (o_custkey % 40) / CAST(100 AS DOUBLE) END AS rv,
  CASE WHEN o_orderkey % 5 > 0 THEN (o_custkey % 9 - 4) / CAST(1000 AS DOUBLE) END AS r300, CASE WHEN o_orderkey % 7 > 0 THEN (o_custkey % 7 - 3) / CAST(1000 AS DOUBLE) END AS r900, CASE WHEN o_orderkey % 2 > 0 THEN 0.01 END AS r3600,
  {NOW} + CAST(o_custkey % 300 AS BIGINT) * 60000 AS expiry, o_custkey % 3 = 0 AS equity, o_orderkey % 4 > 0 AS open, o_orderkey % 6 > 0 AS known, {NOW} + CAST(o_orderkey % 10 - 5 AS BIGINT) * 86400000 AS earnings, o_orderkey % 29 = 0 AS split FROM orders""")
view("theses", f"""
SELECT *, concat_ws(',', CASE WHEN state = 'STALE' THEN 'COMPARISON_NOT_USABLE' END, CASE WHEN spot IS NULL OR iv IS NULL THEN 'SPOT_OR_VOLATILITY_MISSING' END,
  CASE WHEN (r300 IS NOT NULL)::INT + (r900 IS NOT NULL)::INT + (r3600 IS NOT NULL)::INT < 2 THEN 'NEED_PRICE_HISTORY' WHEN coalesce(r300, 0) * d < -0.001 AND coalesce(r900, 0) * d < -0.001 THEN 'OPPOSES_5M_AND_15M_MOVES' END,
  CASE WHEN rv > 0 AND iv > 2 * rv THEN 'PREMIUM_EXPENSIVE_VERSUS_REALIZED' END, CASE WHEN (expiry - {NOW}) / 3600000.0 < 2 THEN 'CUTOFF_WITHIN_TWO_HOURS' END, CASE WHEN equity AND NOT open THEN 'SESSION_CLOSED' END,
  CASE WHEN equity AND NOT known THEN 'EARNINGS_CALENDAR_UNAVAILABLE' END, CASE WHEN equity AND earnings BETWEEN {NOW - DAY} AND expiry + {DAY} THEN 'EARNINGS_OVERLAP_EVENT' END, CASE WHEN equity AND split THEN 'SPLIT_IN_REFERENCE_WINDOW' END) AS reasons
FROM (SELECT *, CASE WHEN gap * dir > 0 THEN 1 ELSE -1 END AS d FROM thesis_rows)""")


def theses(spark, d):
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(
        o, k, F.when(F.col("o_orderstatus") == "P", "STALE").otherwise("PROXY").alias("source_state"), ((k % 100 - 50) / F.lit(5.0)).alias("gap_pp"), F.when(k % 2 == 0, "up").otherwise("down").alias("direction"),
        F.when(k % 17 > 0, k % 90 + 900.0).alias("spot"), (o % 100 + 900.0).alias("strike_or_threshold"), F.when(o % 19 > 0, o % 50 / F.lit(100.0) + 0.2).alias("local_iv"), F.lit(None).cast("double").alias("iv"),
        F.when(o % 3 > 0, k % 40 / F.lit(100.0) + 0.05).alias("realized_vol"), F.when(o % 5 > 0, (k % 9 - 4) / F.lit(1000.0)).alias("return_300"), F.when(o % 7 > 0, (k % 7 - 3) / F.lit(1000.0)).alias("return_900"),
        F.when(o % 2 > 0, 0.01).alias("return_3600"), (F.lit(NOW) + k % 300 * 60_000).alias("expiry"), (k % 3 == 0).alias("is_equity"), F.when(o % 4 > 0, "OPEN").otherwise("CLOSED").alias("market_state"),
        F.when(o % 6 > 0, "AVAILABLE").otherwise("UNKNOWN").alias("catalyst_status"), F.array(F.lit(NOW) + (o % 10 - 5) * DAY).alias("earnings_dates"), (o % 29 == 0).alias("corporate_action"))
    return T.underlying_thesis(rows, NOW)


@query("underlying_thesis", "SELECT o_orderkey, reasons, reasons = '' AS eligible, CASE WHEN d > 0 THEN 'bullish' ELSE 'bearish' END AS proposed_direction, round(100 * (strike / spot - 1), 6) + 0.0 AS threshold_distance_pct FROM theses")
def underlying_thesis(spark, d):
    t = theses(spark, d)
    return t.select("o_orderkey", F.concat_ws(",", "rejection_reasons").alias("reasons"), "eligible", "proposed_direction", r6(F.col("threshold_distance_pct")).alias("threshold_distance_pct"))


_Y = THESIS_YEAR_SECONDS


def _value(s: str, y: str, n: str) -> str:
    """SQL stages of the option value at spot ``s`` and ``y`` years, named by ``n``."""
    return f"(ln({s} / strike) + 0.5 * iv * iv * {y}) / (iv * sqrt({y})) AS {n}1, (ln({s} / strike) - 0.5 * iv * iv * {y}) / (iv * sqrt({y})) AS {n}2"


view("stress", f"""
SELECT *, spot * exp(m * sigma) AS sspot, greatest(0, years - horizon / {_Y}) AS y2 FROM (
 SELECT *, least(iv, CASE WHEN rv > 0 THEN rv ELSE iv END) * sqrt(horizon / {_Y}) AS sigma FROM (
  SELECT o_orderkey, spot, CASE WHEN o_orderkey % 8 = 3 THEN 0.45::DOUBLE ELSE iv END AS iv, rv, strike, o_orderkey % 2 = 0 AS put, 10.0 + o_custkey % 30 AS bid, (10.0 + o_custkey % 30) * 1.03 AS ask, 1.0 + o_orderkey % 4 AS q, (expiry + 86400000 - {NOW}) / 1000.0 / {_Y} AS years, least(3600.0, (expiry + 86400000 - {NOW}) / 1000.0) AS horizon FROM theses WHERE spot > 0 AND (iv > 0 OR o_orderkey % 8 = 3)))
 , (VALUES ('down_one_sigma', -1), ('flat_spot', 0), ('up_one_sigma', 1)) x(scenario, m)""")
view("stress_v", f"""
SELECT *, spot * {ncdf('a1')} - strike * {ncdf('a2')} + CASE WHEN put THEN strike - spot ELSE 0 END AS v0, CASE WHEN y2 <= 0 THEN greatest(0, CASE WHEN put THEN strike - sspot ELSE sspot - strike END)
   ELSE sspot * {ncdf('b1')} - strike * {ncdf('b2')} + CASE WHEN put THEN strike - sspot ELSE 0 END END AS v1 FROM (SELECT *, {_value('spot', 'years', 'a')}, {_value('sspot', 'y2', 'b')} FROM stress)""")
view("stress_pnl", """
SELECT *, (sp - sp * (10 + 5 * sp * q * 100 / 10000) / 10000) * q * 100 * 0.999 - q * 0.65 - ((ask + ask * (10 + 5 * ask * q * 100 / 10000) / 10000) * q * 100 * 1.001 + q * 0.65) AS net_pnl FROM (
 SELECT *, greatest(0, greatest(0, (bid + ask) / 2 + v1 - v0) - (ask - bid) / 2) AS sp FROM stress_v)""")


def scenarios(spark, d):
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    bid = k % 30 + 10.0
    t = theses(spark, d).withColumns({
        "strike": F.col("strike_or_threshold"), "put": o % 2 == 0, "bid": bid, "ask": bid * 1.03, "quantity": o % 4 + 1.0, "multiplier": F.lit(100), "expiry": F.col("expiry") + DAY,
        "quote_iv": F.when(o % 8 == 3, 0.45)})
    return T.expression_scenarios(t, NOW)


@query("expression_scenarios", "SELECT o_orderkey, scenario, round(sspot, 5) + 0.0 AS spot, round(net_pnl, 3) + 0.0 AS net_pnl, CAST(NULL AS VARCHAR) AS expression_reason FROM stress_pnl UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 'CANNOT_PRICE_SCENARIOS' FROM theses WHERE o_orderkey NOT IN (SELECT o_orderkey FROM stress)")
def expression_scenarios(spark, d):
    return scenarios(spark, d).select("o_orderkey", "scenario", r6(F.col("scenario_spot"), 5).alias("spot"), r6(F.col("net_pnl"), 3).alias("net_pnl"), "expression_reason")


@query("favorable_move_loses", "SELECT o_orderkey, max(CASE WHEN scenario = CASE WHEN put THEN 'down_one_sigma' ELSE 'up_one_sigma' END THEN net_pnl END) <= 0 AS favorable_move_loses FROM theses LEFT JOIN (SELECT o_orderkey, scenario, put, net_pnl FROM stress_pnl) p USING (o_orderkey) GROUP BY o_orderkey")
def favorable_move_loses(spark, d):
    return T.favorable_move_loses(scenarios(spark, d), ["o_orderkey"])


# Exchange sessions: the days on which orders were placed, 14:30 to 21:00 UTC, on weekends to 17:00.
view("sessions", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, epoch_us(o_orderdate) // 1000 + 52200000 AS open_ms, epoch_us(o_orderdate) // 1000 + CASE WHEN isodow(o_orderdate) < 6 THEN 75600000 ELSE 61200000 END AS close_ms FROM orders")


@query("equity_context", """SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM sessions s WHERE s.open_ms <= t AND t < s.close_ms) THEN 'OPEN' ELSE 'CLOSED' END AS market_state,
  (SELECT count(*) FROM sessions s WHERE s.day >= CAST(make_timestamp((t - 20 * 86400000) * 1000) - INTERVAL 5 HOUR AS DATE) AND s.open_ms <= t) AS required_sessions, c_custkey % 3 = 0 AND EXISTS (SELECT 1 FROM sessions s WHERE s.day = CAST(make_timestamp((t - 5 * 86400000) * 1000) AS DATE)) AS corporate_action
 FROM (SELECT c_custkey, 883612800000 + CAST(c_custkey % 60 AS BIGINT) * 86400000 + CAST(c_custkey % 24 AS BIGINT) * 3600000 AS t FROM customer)""")
def equity_context(spark, d):
    """Session state of stock snapshots in the winter of 1998 against a calendar table."""
    day = F.col("o_orderdate").cast("timestamp")
    sessions = table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias("session_date"), (F.unix_millis(day) + 52_200_000).alias("open_ms"), (F.unix_millis(day) + F.when(F.weekday("o_orderdate") < 5, 75_600_000).otherwise(61_200_000)).alias("close_ms")).distinct()
    k = F.col("c_custkey")
    snaps = table(spark, d, "customer").select("c_custkey", (F.lit(883_612_800_000) + k % 60 * DAY + k % 24 * 3_600_000).alias("now_ms"))
    split_day = F.to_date(F.timestamp_millis(F.col("now_ms") - 5 * DAY))
    snaps = snaps.withColumn("start_ms", F.col("now_ms") - 20 * DAY).withColumn("splits", F.array(F.struct(
        split_day.alias("session"), F.when(k % 3 == 0, 2.0).otherwise(0.0).alias("ratio"))))
    x = T.equity_context(snaps, sessions, "c_custkey")
    return x.select("c_custkey", "market_state", F.size("required_sessions").cast("bigint").alias("required_sessions"), "corporate_action")
