"""Registered queries: clocks, rolling features, episodes and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing as P
from ..operators import clock, curves, dynamics, episodes
from ..operators.asof import asof_join
from ..session import stage_table
from .fixtures import CONFIG, SCALE, SLICE_ROWS, observations, r6, table, ticks
from .registry import query, view

# ----------------------------------------------------------------- flagship ----------


@query("top_gaps_by_market", """
SELECT event_id, raw_id, now_ms, round(pm_yes, 6) + 0.0 AS pm_yes, round(opt_yes, 6) + 0.0 AS opt_yes,
       round(gap_pp, 6) + 0.0 AS gap_pp, side, gap_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(gap_pp) DESC, raw_id) AS gap_rank FROM obs WHERE valid)
WHERE gap_rank <= 10
""")
def top_gaps_by_market(spark, d):
    """The ten widest usable gaps of each market (a top-k report)."""
    from pyspark.sql.window import Window

    o = observations(spark, d).filter("valid")
    # row_number <= k is pushed below the shuffle as a partial top-k by Catalyst.
    w = Window.partitionBy("event_id").orderBy(F.abs("gap_pp").desc(), "raw_id")
    return o.withColumn("gap_rank", F.row_number().over(w).cast("bigint")).filter("gap_rank <= 10").select(
        "event_id", "raw_id", "now_ms", r6(F.col("pm_yes")).alias("pm_yes"), r6(F.col("opt_yes")).alias("opt_yes"),
        r6(F.col("gap_pp")).alias("gap_pp"), "side", "gap_rank")


# ------------------------------------------------------------------- clocks ----------
# The receipt clock runs backward on purpose: each packet is up to 14 s x 600 early.
JITTER = "received_ms - ((id * 104729) % 14000) * 600"


@query("effective_clock", f"""
SELECT id, {JITTER} AS received_ms,
       max({JITTER}) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now_ms FROM ticks
""")
def effective_clock(spark, d):
    t = ticks(spark, d).select("id", F.expr(JITTER).alias("received_ms"))
    return clock.effective_clock(t, slice_rows=SLICE_ROWS)


@query("accept_newer", f"""
SELECT id, market, CASE WHEN source_ms > received_ms + {5000 * SCALE} THEN 'CLOCK_ERROR'
       WHEN source_ms < max(CASE WHEN source_ms <= received_ms + {5000 * SCALE} THEN source_ms END)
            OVER (PARTITION BY market ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'DELAYED'
       ELSE 'ACCEPTED' END AS verdict FROM ticks
""")
def accept_newer(spark, d):
    t = ticks(spark, d)
    return clock.accept_newer(t, ["market"], tolerance_ms=CONFIG.scaled(CONFIG.clock_tolerance_ms),
                              source_always_present=True, slice_rows=SLICE_ROWS).select("id", "market", "verdict")


view("null_ticks", "SELECT * REPLACE (CASE WHEN kind = 'timer' THEN NULL ELSE source_ms END AS source_ms) FROM ticks")


@query("accept_newer_unstamped", f"""
SELECT market, count(*) FILTER (WHERE verdict = 'ACCEPTED') AS accepted,
       count(*) FILTER (WHERE verdict = 'DELAYED') AS delayed,
       count(*) FILTER (WHERE verdict = 'CLOCK_ERROR') AS clock_errors FROM (
  SELECT market, CASE WHEN source_ms > received_ms + {5000 * SCALE} THEN 'CLOCK_ERROR'
       WHEN source_ms < max(CASE WHEN source_ms IS NULL THEN received_ms
                                 WHEN source_ms <= received_ms + {5000 * SCALE} THEN source_ms END)
            OVER (PARTITION BY market, seg ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'DELAYED'
       ELSE 'ACCEPTED' END AS verdict FROM (
    SELECT *, max(CASE WHEN source_ms IS NULL THEN id END) OVER (PARTITION BY market ORDER BY id) AS seg FROM null_ticks))
GROUP BY market
""")
def accept_newer_unstamped(spark, d):
    """Acceptance where timer packets carry no source time and restart the comparison."""
    t = ticks(spark, d).withColumn("source_ms", F.when(F.col("kind") != "timer", F.col("source_ms")))
    judged = clock.accept_newer(t, ["market"], tolerance_ms=CONFIG.scaled(CONFIG.clock_tolerance_ms), slice_rows=SLICE_ROWS)
    return clock.acceptance_counts(judged, ["market"])


@query("asof_join", """
SELECT l.id, l.market, r.id AS spot_id, round(r.value, 6) + 0.0 AS spot
FROM (SELECT * FROM ticks WHERE kind = 'pm') l
ASOF LEFT JOIN (SELECT * FROM ticks WHERE kind = 'spot') r ON l.market = r.market AND l.received_ms >= r.received_ms
""")
def asof_spot(spark, d):
    """The newest spot packet at or before each prediction-market packet."""
    t = ticks(spark, d)
    spots = t.filter("kind = 'spot'").select("market", "received_ms", F.col("id").alias("spot_id"), F.col("value").alias("spot"))
    books = t.filter("kind = 'pm'").select("id", "market", "received_ms")
    hit = asof_join(books, spots, ["market"], "received_ms", "received_ms", ["spot_id", "spot"], ["spot_id"],
                    slice_width=5 * 86_400_000)
    return hit.select("id", "market", "spot_id", r6(F.col("spot")).alias("spot"))


# ----------------------------------------------------------------- dynamics ----------
B = SCALE * 1000
view("anchored", f"""
SELECT *, lead(now_ms // {B}) OVER (PARTITION BY event_id, mapping_hash ORDER BY raw_id) IS DISTINCT FROM now_ms // {B} AS is_anchor
FROM obs""")
view("valid_anchors", "SELECT * FROM anchored WHERE is_anchor AND valid")
_H = dynamics.HORIZONS


def _horizon_sql() -> str:
    columns, joins = [], []
    for h in _H:
        tol = max(1000, h * 200) * SCALE
        ok = f"o.valid AND o.now_ms - {h * B} - a{h}.now_ms <= {tol}"
        columns.append(f"CASE WHEN {ok} THEN o.gap_pp - a{h}.gap_pp END AS gap_{h}, "
                       f"CASE WHEN {ok} THEN 100.0 * (o.pm_yes - a{h}.pm_yes) END AS pm_{h}, "
                       f"CASE WHEN {ok} THEN 100.0 * (o.opt_yes - a{h}.opt_yes) END AS opt_{h}, "
                       f"CASE WHEN {ok} THEN (o.now_ms - a{h}.now_ms) / CAST({B} AS DOUBLE) END AS sec_{h}, "
                       f"CASE WHEN {ok} THEN a{h}.raw_id END AS ref_{h}")
        joins.append(f"ASOF LEFT JOIN valid_anchors a{h} ON o.event_id = a{h}.event_id AND "
                     f"o.mapping_hash = a{h}.mapping_hash AND o.now_ms - {h * B} >= a{h}.now_ms")
    return f"SELECT o.*, {', '.join(columns)} FROM anchored o {' '.join(joins)}"


view("changes", _horizon_sql())


@query("second_anchors", "SELECT event_id, mapping_hash, raw_id, is_anchor FROM anchored")
def second_anchors(spark, d):
    return dynamics.second_anchors(observations(spark, d), CONFIG).select("event_id", "mapping_hash", "raw_id", "is_anchor")


@query("horizon_changes", "SELECT raw_id, event_id, " + ", ".join(
    f"round(gap_{h}, 6) + 0.0 AS gap_{h}, round(pm_{h}, 6) + 0.0 AS pm_{h}, round(opt_{h}, 6) + 0.0 AS opt_{h}, "
    f"round(sec_{h}, 6) + 0.0 AS sec_{h}, ref_{h}" for h in _H) + " FROM changes")
def horizon_changes(spark, d):
    c = dynamics.horizon_changes(observations(spark, d), CONFIG)
    fields = []
    for h in _H:
        s = F.col(f"change_{h}")
        fields += [r6(s["gap_pp"]).alias(f"gap_{h}"), r6(s["pm_pp"]).alias(f"pm_{h}"), r6(s["opt_pp"]).alias(f"opt_{h}"),
                   r6(s["actual_seconds"]).alias(f"sec_{h}"), s["reference_raw_id"].alias(f"ref_{h}")]
    return c.select("raw_id", "event_id", *fields)


_diag = lambda f: "coalesce(" + ", ".join(f"{f}_{h}" for h in dynamics.DIAGNOSTIC) + ")"
# All parts of one diagnostic come from the same horizon, so the first present one decides.
view("moved", f"""
SELECT *, {_diag('gap')} AS d_gap, {_diag('pm')} AS d_pm, {_diag('opt')} AS d_opt, {_diag('sec')} AS d_sec,
       {_diag('gap')} / {_diag('sec')} AS velocity_pp_s FROM changes""")
view("dynamics_rows", f"""
SELECT m.*, CASE WHEN abs(d_pm) + abs(d_opt) > 0 THEN abs(d_pm) / (abs(d_pm) + abs(d_opt)) END AS pm_travel,
  CASE WHEN abs(d_pm) + abs(d_opt) > 0 THEN abs(d_opt) / (abs(d_pm) + abs(d_opt)) END AS opt_travel,
  CASE WHEN m.now_ms - v.now_ms <= {7200 * B} THEN
    (m.velocity_pp_s - v.velocity_pp_s) / ((m.now_ms - v.now_ms) / CAST({B} AS DOUBLE)) END AS acceleration_pp_s2,
  CASE WHEN m.velocity_pp_s IS NOT NULL AND m.now_ms - v.now_ms <= {7200 * B} AND v.spot <> 0 AND m.spot <> 0
       THEN m.spot / v.spot - 1 END AS spot_return,
  CASE WHEN d_gap IS NULL THEN 'INSUFFICIENT' WHEN (m.gap_pp - d_gap) * m.gap_pp < 0 THEN 'REVERSING'
       WHEN abs(abs(m.gap_pp) - abs(m.gap_pp - d_gap)) <= 0.02 THEN 'STABLE'
       ELSE (CASE WHEN abs(m.gap_pp) - abs(m.gap_pp - d_gap) > 0 THEN 'OPENING' ELSE 'CLOSING' END) ||
            (CASE WHEN abs((abs(m.gap_pp) - abs(m.gap_pp - d_gap)) / d_sec) >= 0.05 THEN ' FAST' ELSE '' END) END AS trend
FROM moved m ASOF LEFT JOIN (SELECT event_id, mapping_hash, now_ms, velocity_pp_s, spot FROM moved
                             WHERE is_anchor AND velocity_pp_s IS NOT NULL) v
  ON m.event_id = v.event_id AND m.mapping_hash = v.mapping_hash AND m.now_ms - {B} >= v.now_ms""")


def _dynamics(spark, d):
    return dynamics.dynamics(observations(spark, d), CONFIG)


@query("velocity_travel", """SELECT raw_id, round(velocity_pp_s, 6) + 0.0 AS velocity_pp_s, round(d_sec, 6) + 0.0 AS diagnostic_seconds,
 round(d_pm, 6) + 0.0 AS pm_change_pp, round(d_opt, 6) + 0.0 AS opt_change_pp,
 round(pm_travel, 6) + 0.0 AS pm_travel, round(opt_travel, 6) + 0.0 AS opt_travel FROM dynamics_rows""")
def velocity_travel(spark, d):
    rows = dynamics.horizon_changes(observations(spark, d), CONFIG, dynamics.DIAGNOSTIC)
    names = ("velocity_pp_s", "diagnostic_seconds", "pm_change_pp", "opt_change_pp", "pm_travel", "opt_travel")
    return dynamics.movement(rows, CONFIG).select("raw_id", *[r6(F.col(n)).alias(n) for n in names])


@query("acceleration_spot_return", """SELECT raw_id, round(acceleration_pp_s2, 6) + 0.0 AS acceleration_pp_s2,
 round(spot_return, 6) + 0.0 AS spot_return FROM dynamics_rows""")
def acceleration_spot_return(spark, d):
    return _dynamics(spark, d).select("raw_id", r6(F.col("acceleration_pp_s2")).alias("acceleration_pp_s2"),
                                      r6(F.col("spot_return")).alias("spot_return"))


@query("trend_label", "SELECT event_id, trend, count(*) AS observations FROM dynamics_rows GROUP BY 1, 2")
def trend_label(spark, d):
    return _dynamics(spark, d).groupBy("event_id", "trend").agg(F.count("*").alias("observations"))


view("jump_prev", """
SELECT *, lag(valid) OVER k AS p_valid, lag(pm_yes) OVER k AS p_pm, lag(opt_yes) OVER k AS p_opt, lag(spot) OVER k AS p_spot,
  coalesce(max(CASE WHEN NOT valid THEN raw_id END) OVER (PARTITION BY event_id, mapping_hash ORDER BY raw_id), -1) AS segment
FROM obs WINDOW k AS (PARTITION BY event_id, mapping_hash ORDER BY raw_id)""")
view("jumps", """
SELECT * FROM (
 SELECT event_id, mapping_hash, raw_id, now_ms AS "timestamp", trigger_kind, segment, leg,
   CASE leg WHEN 'pm' THEN 100.0 * (pm_yes - p_pm) WHEN 'opt' THEN 100.0 * (opt_yes - p_opt)
            ELSE CASE WHEN spot > 0 AND p_spot > 0 THEN ln(spot / p_spot) END END AS change
 FROM jump_prev, (VALUES ('pm'), ('opt'), ('spot')) l(leg) WHERE valid AND p_valid)
WHERE abs(change) >= CASE leg WHEN 'spot' THEN 0.0025 ELSE 0.25 END""")


@query("native_jumps", """SELECT event_id, mapping_hash, raw_id, "timestamp", trigger_kind, segment, leg,
 round(change, 6) + 0.0 AS change FROM jumps""")
def native_jumps(spark, d):
    j = dynamics.native_jumps(observations(spark, d), CONFIG, slice_rows=SLICE_ROWS)
    return j.withColumn("change", r6(F.col("change")))


# ----------------------------------------------------------------- episodes ----------
view("ep_flags", """
SELECT *, coalesce(p_map <> mapping_hash, false) AS changed, expiry <= now_ms AS expired,
       coalesce(p_map <> mapping_hash, false) OR expiry <= now_ms OR NOT valid AS stop
FROM (SELECT *, lag(mapping_hash) OVER (PARTITION BY event_id ORDER BY raw_id) AS p_map FROM obs)""")
view("ep_marks", """
SELECT *,
  max(CASE WHEN valid AND gap_pp >= 4 THEN raw_id END) OVER b AS open_up, max(CASE WHEN stop OR gap_pp <= 1 THEN raw_id END) OVER b AS break_up,
  max(CASE WHEN valid AND gap_pp <= -4 THEN raw_id END) OVER b AS open_dn, max(CASE WHEN stop OR gap_pp >= -1 THEN raw_id END) OVER b AS break_dn
FROM ep_flags WINDOW b AS (PARTITION BY event_id ORDER BY raw_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
view("ep_sign", """
SELECT *, coalesce(sign_before IS NOT NULL AND (stop OR gap_pp * sign_before <= 1), false) AS closing FROM (
 SELECT *, CASE WHEN open_up >= coalesce(break_up, -1) THEN 1 WHEN open_dn >= coalesce(break_dn, -1) THEN -1 END AS sign_before FROM ep_marks)""")
view("ep", """
SELECT *, CASE WHEN starting THEN raw_id WHEN NOT closing THEN start_before END AS start_after FROM (
 SELECT *, CASE WHEN sign_before IS NOT NULL THEN max(CASE WHEN starting THEN raw_id END) OVER (PARTITION BY event_id ORDER BY raw_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS start_before,
   CASE WHEN closing THEN CASE WHEN changed THEN 'MAPPING_CHANGED' WHEN expired THEN 'EXPIRED' WHEN NOT valid THEN 'DATA_GAP'
        WHEN gap_pp * sign_before < 0 THEN 'REVERSAL' ELSE 'CONVERGENCE' END END AS close_reason
 FROM (SELECT *, coalesce(valid AND abs(gap_pp) >= 4 AND (sign_before IS NULL OR closing), false) AS starting FROM ep_sign))""")
view("ep_member", """
SELECT *, first_value(now_ms) OVER e AS opened_at, first_value(gap_pp) OVER e AS opening_gap_pp,
  first_value(relative_gap) OVER e AS opening_relative_gap, first_value(spot) OVER e AS opening_spot,
  max(abs(gap_pp)) OVER e AS max_abs_gap_pp, max(relative_gap) OVER e AS max_relative_gap, min(gap_pp) OVER e AS min_gap_after_open,
  lag(abs(gap_pp)) OVER e AS p_size, max(abs(gap_pp)) OVER (PARTITION BY event_id, start_after ORDER BY raw_id
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_peak,
  coalesce(abs(pm_yes - lag(pm_yes) OVER e) * 100, 0) AS pm_step, coalesce(abs(opt_yes - lag(opt_yes) OVER e) * 100, 0) AS opt_step
FROM ep WHERE start_after IS NOT NULL WINDOW e AS (PARTITION BY event_id, start_after ORDER BY raw_id)""")
view("ep_rev", """
SELECT 'gap-' || event_id || '-' || start_after AS gap_event_id, event_id, asset, raw_id, start_after AS opening_raw_id, opened_at,
  now_ms AS "timestamp", opening_gap_pp, opening_relative_gap, max_abs_gap_pp, max_relative_gap,
  max(CASE WHEN p_peak IS NULL OR abs(gap_pp) > p_peak THEN now_ms END) OVER e - opened_at AS time_to_max_ms,
  min_gap_after_open, now_ms - opened_at AS duration_ms,
  raw_id = start_after AS only_opened, CASE WHEN raw_id = start_after THEN 'NEW' WHEN abs(gap_pp) > p_peak THEN 'PEAK' WHEN abs(gap_pp) > p_size THEN 'WIDENING' ELSE 'CONVERGING' END AS state,
  sum(pm_step) OVER e AS pm_distance_pp, sum(opt_step) OVER e AS opt_distance_pp,
  CASE WHEN raw_id <> start_after AND spot <> 0 AND opening_spot <> 0 THEN spot / opening_spot - 1 END AS spot_move,
  CAST(NULL AS BIGINT) AS closing_time, CAST(NULL AS DOUBLE) AS closing_gap, CAST(NULL AS VARCHAR) AS close_reason
FROM ep_member WINDOW e AS (PARTITION BY event_id, start_after ORDER BY raw_id)""")
view("ep_all", """
SELECT * FROM ep_rev UNION ALL BY NAME
SELECT r.* EXCLUDE (newest) REPLACE (c.raw_id AS raw_id, c.now_ms AS "timestamp", c.now_ms - r.opened_at AS duration_ms,
  CASE WHEN c.close_reason = 'EXPIRED' THEN 'EXPIRED' ELSE 'CLOSED' END AS state, c.now_ms AS closing_time,
  c.gap_pp AS closing_gap, c.close_reason AS close_reason)
FROM (SELECT *, row_number() OVER (PARTITION BY gap_event_id ORDER BY raw_id DESC) AS newest FROM ep_rev) r
JOIN ep c ON c.event_id = r.event_id AND c.start_before = r.opening_raw_id AND c.close_reason IS NOT NULL WHERE r.newest = 1""")


@query("gap_episodes", "SELECT event_id, raw_id, start_before, start_after, close_reason FROM ep")
def gap_episodes(spark, d):
    obs = stage_table(observations(spark, d), "observations")
    return episodes.gap_episodes(obs, CONFIG, SLICE_ROWS).select(
        "event_id", "raw_id", "start_before", "start_after", "close_reason")


_REV_SQL = """SELECT gap_event_id, event_id, raw_id, opened_at, "timestamp", state, close_reason, closing_time, duration_ms, time_to_max_ms,
 round(opening_gap_pp, 6) + 0.0 AS opening_gap_pp, round(max_abs_gap_pp, 6) + 0.0 AS max_abs_gap_pp,
 round(opening_relative_gap, 6) + 0.0 AS opening_relative_gap, round(max_relative_gap, 6) + 0.0 AS max_relative_gap,
 round(min_gap_after_open, 6) + 0.0 AS min_gap_after_open, round(closing_gap, 6) + 0.0 AS closing_gap,
 round(pm_distance_pp, 5) + 0.0 AS pm_distance_pp, round(opt_distance_pp, 5) + 0.0 AS opt_distance_pp,
 round(CASE WHEN only_opened THEN CAST(0 AS DOUBLE) WHEN pm_distance_pp + opt_distance_pp > 0 THEN pm_distance_pp / (pm_distance_pp + opt_distance_pp) END, 6) + 0.0 AS pm_travel,
 round(spot_move, 6) + 0.0 AS spot_move FROM """


def _revision_columns(df):
    plain = ("gap_event_id", "event_id", "raw_id", "opened_at", "timestamp", "state", "close_reason", "closing_time",
             "duration_ms", "time_to_max_ms")
    rounded = ("opening_gap_pp", "max_abs_gap_pp", "opening_relative_gap", "max_relative_gap", "min_gap_after_open",
               "closing_gap", "spot_move")
    return df.select(
        *plain, *[r6(F.col(c)).alias(c) for c in rounded],
        r6(F.col("pm_distance_pp"), 5).alias("pm_distance_pp"), r6(F.col("opt_distance_pp"), 5).alias("opt_distance_pp"),
        r6(F.col("pm_travel")).alias("pm_travel"))


def _revisions(spark, d):
    """Revisions over two stage tables: the observations and their episode marks."""
    obs = stage_table(observations(spark, d), "observations")
    return episodes.episode_revisions(stage_table(episodes.gap_episodes(obs, CONFIG, SLICE_ROWS), "episodes"), SLICE_ROWS)


@query("episode_revisions", _REV_SQL + "ep_all")
def episode_revisions(spark, d):
    return _revision_columns(_revisions(spark, d))


@query("episode_summary", _REV_SQL + "(SELECT *, row_number() OVER (PARTITION BY gap_event_id ORDER BY raw_id DESC) AS newest FROM ep_all) WHERE newest = 1")
def episode_summary(spark, d):
    return _revision_columns(episodes.episode_summary(_revisions(spark, d)))


# ------------------------------------------------------------------- curves ----------
view("strikes", """
SELECT p_brand AS asset, 1735689600000 + CAST(p_size % 2 AS BIGINT) * 86400000 AS expiry,
  CASE WHEN p_type < 'M' THEN 'touch' ELSE 'terminal' END AS event_type,
  CASE WHEN length(p_type) % 2 = 0 THEN 'up' ELSE 'down' END AS direction,
  CAST(NULL AS BIGINT) AS window_start, 'coinbase' AS settlement_source, p_type, 'e' || p_partkey AS event_id,
  p_retailprice AS strike_or_threshold, p_size / CAST(50 AS DOUBLE) AS pm_yes,
  ((p_partkey * 7919) % 1000) / CAST(1000 AS DOUBLE) AS opt_yes
FROM part""")
view("curve_rows", """
SELECT *, asset || '|' || expiry || '|' || event_type || '|' || direction || '|~|coinbase|~' AS curve_id,
  (pm_yes - opt_yes) * 100 AS gap_pp, CASE WHEN pm_yes > opt_yes THEN 'CHEAP' WHEN pm_yes < opt_yes THEN 'RICH' ELSE 'EVEN' END AS side
FROM strikes""")
view("nodes", """
SELECT * FROM (SELECT *, row_number() OVER g AS node_no, count(*) OVER (PARTITION BY curve_id) AS nodes,
  lag(event_id) OVER g AS lo_id, lead(event_id) OVER g AS up_id, lag(gap_pp) OVER g AS lo_gap, lead(gap_pp) OVER g AS up_gap,
  lead(pm_yes) OVER g AS up_pm, lead(opt_yes) OVER g AS up_opt, lag(side) OVER g AS lo_side
FROM curve_rows WINDOW g AS (PARTITION BY curve_id ORDER BY strike_or_threshold, event_id)) WHERE nodes >= 2""")


def strikes(spark, d):
    p = table(spark, d, "part")
    pm, opt = F.col("p_size") / F.lit(50.0), ((F.col("p_partkey") * 7919) % 1000) / F.lit(1000.0)
    return p.select(
        F.col("p_brand").alias("asset"),
        (F.lit(1735689600000) + (F.col("p_size") % 2).cast("bigint") * 86_400_000).alias("expiry"),
        F.when(F.col("p_type") < "M", "touch").otherwise("terminal").alias("event_type"),
        F.when(F.length("p_type") % 2 == 0, "up").otherwise("down").alias("direction"),
        F.lit(None).cast("bigint").alias("window_start"), F.lit("coinbase").alias("settlement_source"),
        F.lit(None).cast("boolean").alias("threshold_inclusive"),
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("event_id"),
        F.col("p_retailprice").alias("strike_or_threshold"), pm.alias("pm_yes"), opt.alias("opt_yes"),
        P.gap_pp(pm, opt).alias("gap_pp"), P.relative_gap(pm, opt).alias("relative_gap"),
        P.gap_side(pm, opt).alias("side"), F.lit(True).alias("valid"))


def _nodes(spark, d):
    return curves.curve_nodes(strikes(spark, d), strike_slice=25.0)


@query("curve_groups", """SELECT curve_id, CASE WHEN event_type = 'touch' THEN 'touch_probability' ELSE 'terminal_probability' END AS curve_type,
 any_value(nodes) AS nodes, string_agg(event_id, ',' ORDER BY node_no) AS members FROM nodes GROUP BY curve_id, event_type""")
def curve_groups(spark, d):
    g = curves.curve_groups(_nodes(spark, d))
    return g.select("curve_id", "curve_type", F.size("nodes").cast("bigint").alias("nodes"),
                    F.concat_ws(",", "nodes.event_id").alias("members"))


@query("curve_nodes", """SELECT curve_id, event_id, node_no, nodes, lo_id, up_id FROM nodes""")
def curve_nodes(spark, d):
    return _nodes(spark, d).select("curve_id", "event_id", F.col("node_no").cast("bigint").alias("node_no"), "nodes",
                                   F.col("lower.event_id").alias("lo_id"), F.col("upper.event_id").alias("up_id"))


@query("monotonicity_violations", """SELECT curve_id, event_id AS lower_event, up_id AS upper_event, source FROM nodes,
 (VALUES ('pm_yes'), ('opt_yes')) s(source) WHERE (CASE WHEN direction = 'up' THEN -1 ELSE 1 END) *
 (CASE source WHEN 'pm_yes' THEN up_pm - pm_yes ELSE up_opt - opt_yes END) < -1e-6""")
def monotonicity_violations(spark, d):
    return curves.monotonicity_violations(_nodes(spark, d))


@query("gap_extrema", """SELECT curve_id, event_id, strike_or_threshold, round(gap_pp, 6) + 0.0 AS gap_pp FROM nodes
 WHERE (gap_pp - lo_gap) * (up_gap - gap_pp) < 0""")
def gap_extrema(spark, d):
    return curves.gap_extrema(_nodes(spark, d)).withColumn("gap_pp", r6(F.col("gap_pp")))


@query("side_clusters", """SELECT curve_id, cluster_no, size, event_id, side FROM (
 SELECT *, count(*) OVER (PARTITION BY curve_id, cluster_no) AS size FROM (
  SELECT *, CAST(sum(CASE WHEN lo_side IS NULL OR lo_side <> side THEN 1 ELSE 0 END) OVER
   (PARTITION BY curve_id ORDER BY strike_or_threshold, event_id) AS BIGINT) AS cluster_no FROM nodes)) WHERE size >= 2""")
def side_clusters(spark, d):
    return curves.side_clusters(_nodes(spark, d), 25.0).select("curve_id", "cluster_no", "size", "event_id", "side")
