"""Registered queries: as-of grids and the statistical analyzers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import pricing as P
from ..operators import analyzers as A
from ..operators import dynamics
from ..operators.running import id_slices, last, running
from ..session import stage_table
from .fixtures import CONFIG, DAY, SCALE, SLICE_ROWS, START, observations, r6, ticks
from .registry import query, view

NOW = START + 30 * DAY
STEP = CONFIG.ms(CONFIG.analysis_grid_seconds)
END = NOW // STEP * STEP
POINTS = CONFIG.grid_points
N = CONFIG.analysis_window

# Four markets over all packets. An outage packet observes like any other; in the fourth market it makes its observation invalid, which breaks
# that market's grid, so that its scopes report insufficient data.
view("gobs", """
SELECT market AS event_id, 'map' AS mapping_hash, id AS raw_id, received_ms AS now_ms, pm_yes, opt_yes, spot, opt_ms AS opt_timestamp,
  (pm_yes - opt_yes) * 100 AS gap_pp, pm_yes IS NOT NULL AND opt_yes IS NOT NULL AND NOT (kind = 'outage' AND market = 'g3') AS valid FROM (
 SELECT 'g' || (user_id % 4) AS market, id, received_ms, kind,
  last_value(CASE WHEN kind = 'pm' AND value <= 500 THEN value / 500 END IGNORE NULLS) OVER w AS pm_yes,
  last_value(CASE WHEN kind = 'opt' AND value <= 500 THEN value / 500 END IGNORE NULLS) OVER w AS opt_yes,
  last_value(CASE WHEN kind = 'opt' AND value <= 500 THEN received_ms END IGNORE NULLS) OVER w AS opt_ms,
  last_value(CASE WHEN kind = 'spot' AND value > 0 THEN value END IGNORE NULLS) OVER w AS spot
 FROM ticks WINDOW w AS (PARTITION BY user_id % 4 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")


def grid_observations(spark, d):
    t = ticks(spark, d).withColumn("event_id", F.concat(F.lit("g"), F.col("user_id") % 4))
    p = F.when(F.col("value") <= 500, F.col("value") / 500)
    legs = running(t, ["event_id"], ["id"], {
        "pm_yes": last(F.when(F.col("kind") == "pm", p)),
        "opt": last(F.when((F.col("kind") == "opt") & p.isNotNull(), F.struct(p.alias("yes"), F.col("received_ms").alias("ms")))),
        "spot": last(F.when((F.col("kind") == "spot") & (F.col("value") > 0), F.col("value")))}, id_slices("id", SLICE_ROWS))
    opt = F.col("opt.yes")
    return legs.select("event_id", F.lit("map").alias("mapping_hash"), F.col("id").alias("raw_id"), F.col("received_ms").alias("now_ms"),
                       "pm_yes", opt.alias("opt_yes"), "spot", F.col("opt.ms").alias("opt_timestamp"), P.gap_pp(F.col("pm_yes"), opt).alias("gap_pp"),
                       (F.col("pm_yes").isNotNull() & opt.isNotNull() & ~((F.col("kind") == "outage") & (F.col("event_id") == "g3"))).alias("valid"))


def _grid_view(obs: str) -> str:
    return f"""
SELECT event_id, "timestamp", pm_yes, opt_yes, gap_pp, spot, opt_timestamp, raw_id FROM (
 SELECT *, max(CASE WHEN NOT good THEN "timestamp" END) OVER (PARTITION BY event_id) AS broken FROM (
  SELECT t.event_id, t."timestamp", a.* EXCLUDE (event_id, mapping_hash), coalesce(a.valid AND t."timestamp" - a.now_ms <= {STEP} AND a.spot <> 0, false) AS good
  FROM (SELECT event_id, mapping_hash, unnest(range({END - (POINTS - 1) * STEP}, {END + 1}, {STEP})) AS "timestamp" FROM (
      SELECT event_id, arg_max(mapping_hash, raw_id) AS mapping_hash FROM {obs} WHERE now_ms <= {NOW} GROUP BY 1)) t
  ASOF LEFT JOIN (SELECT event_id, mapping_hash, now_ms, pm_yes, opt_yes, gap_pp, spot, opt_timestamp, raw_id, valid FROM {obs}
     QUALIFY raw_id = max(raw_id) OVER (PARTITION BY event_id, mapping_hash, now_ms // {SCALE * 1000})) a
   ON t.event_id = a.event_id AND t.mapping_hash = a.mapping_hash AND t."timestamp" >= a.now_ms))
WHERE broken IS NULL OR "timestamp" > broken"""


view("grid", _grid_view("gobs"))
view("outage_grid", _grid_view("obs"))
_GRID_SQL = 'SELECT event_id, "timestamp", round(pm_yes, 6) + 0.0 AS pm_yes, round(opt_yes, 6) + 0.0 AS opt_yes, round(gap_pp, 6) + 0.0 AS gap_pp, spot, raw_id FROM '


def grid(spark, d):
    return stage_table(dynamics.asof_grid(grid_observations(spark, d), NOW, CONFIG), "grid")


def _grid_columns(g):
    return g.select("event_id", "timestamp", *[r6(F.col(c)).alias(c) for c in ("pm_yes", "opt_yes", "gap_pp")], "spot", "raw_id")


@query("asof_grid", _GRID_SQL + "grid")
def asof_grid(spark, d):
    return _grid_columns(dynamics.asof_grid(grid_observations(spark, d), NOW, CONFIG))


@query("asof_grid_outages", _GRID_SQL + "outage_grid")
def asof_grid_outages(spark, d):
    """The same grid over all packets: outages leave only the points after the last one."""
    return _grid_columns(dynamics.asof_grid(observations(spark, d), NOW, CONFIG))


view("windows", f"""
SELECT *, CAST(rn <= {N} AS INTEGER) AS current, CASE WHEN rn <= {N} THEN {N} - rn ELSE {2 * N} - rn END AS pos FROM (
 SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY "timestamp" DESC) AS rn, count(*) OVER (PARTITION BY event_id) AS total FROM grid)
WHERE rn <= {2 * N} AND total >= {2 * N}""")
_Z = ", ".join(
    f"({f} - avg({f}) FILTER (WHERE current = 0) OVER s) / (CASE WHEN stddev_pop({f}) FILTER (WHERE current = 0) OVER s > 1e-10 "
    f"THEN stddev_pop({f}) FILTER (WHERE current = 0) OVER s ELSE 1 END) AS z{i}" for i, f in enumerate(A.FEATURES))
view("zrows", f"SELECT *, {_Z} FROM windows WINDOW s AS (PARTITION BY event_id)")


def windows(spark, d):
    return A.split_windows(grid(spark, d), N)


def standardized(spark, d):
    return A.baseline_standardize(windows(spark, d))


@query("baseline_standardize", 'SELECT event_id, "timestamp", current, CAST(pos AS INTEGER) AS pos, ' + ", ".join(f"round(z{i}, 6) + 0.0 AS z{i}" for i in range(4)) + " FROM zrows")
def baseline_standardize(spark, d):
    return standardized(spark, d).select("event_id", "timestamp", "current", "pos", *[r6(F.col("z")[i]).alias(f"z{i}") for i in range(4)])


_GOLD, _SILVER = (math.sqrt(5) - 1) / 2, math.sqrt(2) - 1
view("raw_directions", f"""
SELECT i + 4 AS direction, j, sqrt(-2 * ln((0.5::DOUBLE + k * {_GOLD!r}::DOUBLE) % 1)) * cos(2 * pi() * ((0.5::DOUBLE + k * {_SILVER!r}::DOUBLE) % 1)) AS w
FROM (SELECT i, j, i * 4 + j + 1 AS k FROM range(64) a(i) CROSS JOIN range(4) b(j))""")
view("directions", """
SELECT direction, j, w / sqrt(sum(w * w) OVER (PARTITION BY direction)) AS w FROM raw_directions
UNION ALL SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END FROM range(4) a(i) CROSS JOIN range(4) b(j)""")
view("zlong", " UNION ALL ".join(f"SELECT event_id, current, pos, {i} AS j, z{i} AS z FROM zrows" for i in range(4)))
view("sw", """
SELECT event_id, direction, avg(abs(a - b)) AS distance FROM (
 SELECT event_id, direction, rk, max(CASE WHEN current = 0 THEN projection END) AS a, max(CASE WHEN current = 1 THEN projection END) AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id, direction, current ORDER BY projection) AS rk FROM (
   SELECT event_id, current, pos, direction, sum(z * w) AS projection FROM zlong JOIN directions USING (j) GROUP BY ALL)) GROUP BY ALL) GROUP BY ALL""")


@query("sliced_wasserstein", "SELECT event_id, CAST(direction AS INTEGER) AS direction, round(distance, 6) + 0.0 AS distance FROM sw")
def sliced_wasserstein(spark, d):
    return A.sliced_wasserstein(standardized(spark, d)).select("event_id", "direction", r6(F.col("distance")).alias("distance"))


@query("wasserstein_score", """SELECT event_id, round(avg(distance), 6) + 0.0 AS score, string_agg(CAST(direction AS VARCHAR), ',' ORDER BY distance DESC) FILTER (WHERE n <= 3) AS top
 FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY distance DESC) AS n FROM sw) GROUP BY event_id""")
def wasserstein_score(spark, d):
    s = A.wasserstein_score(A.sliced_wasserstein(standardized(spark, d)))
    return s.select("event_id", r6(F.col("score")).alias("score"), F.array_join(F.transform("top", lambda t: t["direction"].cast("string")), ",").alias("top"))


_COV = lambda k, i, j: f"covar_samp(z{i}, z{j}) FILTER (WHERE current = {k}) {'+ 0.001' if i == j else ''}"
view("covs", "SELECT event_id, " + ", ".join(f"{_COV(k, i, j)} AS c{k}_{i}_{j}" for k in (0, 1) for i in range(4) for j in range(i, 4)) + " FROM zrows GROUP BY event_id")
_PAIRS = [(i, j) for i in range(4) for j in range(i)]
_CHANGE = lambda i, j: f"c1_{j}_{i} / sqrt(c1_{i}_{i} * c1_{j}_{j}) - c0_{j}_{i} / sqrt(c0_{i}_{i} * c0_{j}_{j})"


@query("correlation_changes", " UNION ALL ".join(
    f"SELECT event_id, '{A.FEATURES[i]}' AS first, '{A.FEATURES[j]}' AS second, round({_CHANGE(i, j)}, 6) + 0.0 AS correlation_change FROM covs" for i, j in _PAIRS))
def correlation_changes(spark, d):
    c = A.correlation_changes(A.covariances(standardized(spark, d)))
    return c.withColumn("correlation_change", r6(F.col("correlation_change")))


@query("covariance_distance")
def covariance_distance(spark, d):
    """Affine-invariant covariance distance; the eigen step has no SQL form (tested against a direct computation)."""
    m = A.covariances(standardized(spark, d))
    return m.select("event_id", r6(A.spd_distance("ca", "cb")).alias("score"))


view("motif_rows", """
SELECT event_id, current, CASE WHEN a = b OR b = c OR a = c THEN 'ties:' || CAST(sign(b - a) AS INTEGER) || ',' || CAST(sign(c - b) AS INTEGER)
  ELSE 'ordinal:' || CASE WHEN a < b AND b < c THEN '012' WHEN a < c AND c < b THEN '021' WHEN b < a AND a < c THEN '102' WHEN b < c AND c < a THEN '120'
   WHEN c < a AND a < b THEN '201' ELSE '210' END END AS motif FROM (
 SELECT event_id, current, gap_pp AS a, lead(gap_pp) OVER m AS b, lead(gap_pp, 2) OVER m AS c FROM windows WINDOW m AS (PARTITION BY event_id, current ORDER BY pos)) WHERE c IS NOT NULL""")
view("motifs", f"""
SELECT event_id, motif, count(*) FILTER (WHERE current = 0) / CAST({N - 2} AS DOUBLE) AS baseline, count(*) FILTER (WHERE current = 1) / CAST({N - 2} AS DOUBLE) AS now
FROM motif_rows GROUP BY ALL""")


@query("ordinal_mmd", "SELECT event_id, motif, round(baseline, 6) + 0.0 AS baseline, round(now, 6) + 0.0 AS current, round(now - baseline, 6) + 0.0 AS change FROM motifs")
def ordinal_mmd(spark, d):
    m = A.ordinal_mmd(windows(spark, d))
    return m.select("event_id", "motif", *[r6(F.col(c)).alias(c) for c in ("baseline", "current", "change")])


view("steps", """
SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY "timestamp") - 1 AS i FROM (
 SELECT event_id, "timestamp", pm_yes - lag(pm_yes) OVER t AS p, opt_yes - lag(opt_yes) OVER t AS q,
  ln(greatest(spot, 1e-10)) - lag(ln(greatest(spot, 1e-10))) OVER t AS s FROM grid WINDOW t AS (PARTITION BY event_id ORDER BY "timestamp")) WHERE p IS NOT NULL""")
view("res", """
SELECT *, p - (regr_intercept(p, s) OVER e + regr_slope(p, s) OVER e * s) AS rp, q - (regr_intercept(q, s) OVER e + regr_slope(q, s) OVER e * s) AS rq
FROM steps WINDOW e AS (PARTITION BY event_id)""")
view("lagged", " UNION ALL ".join(
    f"SELECT * FROM (SELECT event_id, CAST({s} AS DOUBLE) AS scale, {A.lag_points(s, CONFIG)} AS lag, i, p, q, s, rp, rq, " + ", ".join(
        f"lead({c}, {A.lag_points(s, CONFIG)}) OVER l AS {c}_later" for c in ("p", "q", "rp", "rq"))
    + " FROM res WINDOW l AS (PARTITION BY event_id ORDER BY i)) WHERE p_later IS NOT NULL" for s in CONFIG.analysis_scales))
_C = lambda x, y: f"CASE WHEN count(*) >= 8 THEN corr({x}, {y}) END"  # noqa: E731  (fewer pairs than eight have no correlation)


@query("lag_correlations", "SELECT event_id, scale, CAST(lag AS INTEGER) AS lag, count(*) AS pairs, " + ", ".join(
    f"round({_C(x, y)}, 6) + 0.0 AS {n}" for n, x, y in (
        ("pm_to_opt", "p", "q_later"), ("opt_to_pm", "q", "p_later"), ("residual_pm_to_opt", "rp", "rq_later"),
        ("residual_opt_to_pm", "rq", "rp_later"), ("spot_to_pm", "s", "p_later"), ("spot_to_opt", "s", "q_later"))) + " FROM lagged GROUP BY ALL")
def lag_correlations(spark, d):
    c = A.lag_correlations(A.lag_pairs(A.increments(grid(spark, d)), CONFIG))
    return c.select("event_id", "scale", "lag", "pairs", *[r6(F.col(x)).alias(x) for x in c.columns[4:]])


view("draws", f"""
SELECT event_id, scale, rep, CAST(floor(((0.5::DOUBLE + (rep * 1009 + slot // block + 1) * {_GOLD!r}::DOUBLE) % 1) * greatest(1, n - block + 1)) AS BIGINT) + slot % block AS i
FROM (SELECT event_id, scale, n, greatest(2, CAST(floor(sqrt(n)) AS BIGINT)) AS block, rep, unnest(range(n)) AS slot
  FROM (SELECT event_id, scale, count(*) AS n FROM lagged GROUP BY ALL) CROSS JOIN range(99) r(rep))""")
view("boot", """
SELECT event_id, scale, quantile_cont(diff, 0.025) AS low, quantile_cont(diff, 0.975) AS high FROM (
 SELECT event_id, scale, rep, corr(p, q_later) - corr(q, p_later) AS diff FROM draws JOIN lagged USING (event_id, scale, i) GROUP BY ALL) GROUP BY ALL""")
view("cadence", f"""
SELECT event_id, median(g) / {SCALE * 1000}::DOUBLE AS cadence FROM (SELECT event_id, opt_timestamp - lag(opt_timestamp) OVER (PARTITION BY event_id ORDER BY opt_timestamp) AS g
 FROM (SELECT DISTINCT event_id, opt_timestamp FROM grid)) GROUP BY event_id""")


# Scopes: the four markets, a short one (100 points of the first) and one without samples.
SHORT = 100
view("sgrid", f"""SELECT * FROM grid UNION ALL SELECT 'short', * EXCLUDE (event_id) FROM grid WHERE event_id = 'g0' AND "timestamp" > {END - SHORT * STEP}""")
view("scopes", "SELECT 'g' || n AS event_id FROM range(4) r(n) UNION ALL SELECT 'short' UNION ALL SELECT 'none'")


def scoped_grid(spark, d):
    g = grid(spark, d)
    return g.unionByName(g.filter((F.col("event_id") == "g0") & (F.col("timestamp") > END - SHORT * STEP)).withColumn("event_id", F.lit("short")))


def scopes(spark):
    return spark.createDataFrame([(f"g{i}",) for i in range(4)] + [("short",), ("none",)], "event_id string")


view("lag_base", f"""
SELECT s.event_id, x.scale, coalesce(n, 0) AS n, l.pairs, l.f, l.r, b.low, b.high, coalesce(n, 0) < {2 * N} OR x.scale < greatest(15, coalesce(c.cadence, 'inf'::DOUBLE)) OR coalesce(l.pairs, 0) < 24 OR l.f IS NULL OR l.r IS NULL AS thin
FROM scopes s JOIN (VALUES {', '.join(f"({float(x)}::DOUBLE)" for x in CONFIG.analysis_scales)}) x(scale) ON true LEFT JOIN (SELECT event_id, count(*) AS n FROM sgrid GROUP BY 1) g USING (event_id)
 LEFT JOIN (SELECT event_id, scale, count(*) AS pairs, corr(p, q_later) AS f, corr(q, p_later) AS r FROM lagged GROUP BY ALL) l ON l.event_id = s.event_id AND l.scale = x.scale
 LEFT JOIN boot b ON b.event_id = s.event_id AND b.scale = x.scale LEFT JOIN cadence c ON c.event_id = s.event_id""")
view("verdicts", "SELECT *, CASE WHEN thin THEN 'INSUFFICIENT' WHEN low > 0 AND f > 0.2 THEN 'PM_LEADS_OPT' WHEN high < 0 AND r > 0.2 THEN 'OPT_LEADS_PM' ELSE 'AMBIGUOUS' END AS direction FROM lag_base")


@query("lead_lag", """SELECT event_id, scale, CASE WHEN NOT thin THEN round(low, 5) + 0.0 END AS low, CASE WHEN NOT thin THEN round(high, 5) + 0.0 END AS high, CASE WHEN NOT thin THEN round(f - r, 6) + 0.0 END AS strength, direction FROM verdicts""")
def lead_lag(spark, d):
    """Every scope and scale, also those without enough samples."""
    r = A.lead_lag(scoped_grid(spark, d), CONFIG, scopes(spark))
    return r.select("event_id", "scale", r6(F.col("low"), 5).alias("low"), r6(F.col("high"), 5).alias("high"), r6(F.col("strength")).alias("strength"), "direction")


@query("sync_windows", """SELECT event_id, scale AS window_seconds FROM (SELECT *, direction IN ('PM_LEADS_OPT', 'OPT_LEADS_PM') AS useful, max(direction IN ('PM_LEADS_OPT', 'OPT_LEADS_PM')) OVER (PARTITION BY event_id) AS any_useful FROM verdicts)
 WHERE CASE WHEN any_useful THEN useful ELSE scale >= 15 END""")
def sync_windows(spark, d):
    return A.sync_windows(A.lead_lag(scoped_grid(spark, d), CONFIG, scopes(spark)), CONFIG)


view("gjumps", """
SELECT event_id, "timestamp", leg FROM (SELECT event_id, "timestamp", abs(pm_yes - lag(pm_yes) OVER t) >= 0.0025 AS pm, abs(opt_yes - lag(opt_yes) OVER t) >= 0.0025 AS opt,
  abs(ln(greatest(spot, 1e-10)) - lag(ln(greatest(spot, 1e-10))) OVER t) >= 0.0025 AS spot FROM windows WINDOW t AS (PARTITION BY event_id ORDER BY "timestamp"))
UNPIVOT (hit FOR leg IN (pm, opt, spot)) WHERE hit""")


def _sync_sql(jumps: str, ends: str, spans: str | None = None) -> str:
    spans = spans or "SELECT * FROM (VALUES " + ", ".join(f"({float(s)}::DOUBLE)" for s in CONFIG.analysis_scales) + ") w(window_seconds)"
    on = "w.event_id = e.event_id" if "event_id" in spans else "true"
    return f"""WITH e AS ({ends}), w AS ({spans}), s AS (SELECT e.event_id, e."end", w.window_seconds, w.window_seconds * {SCALE * 1000} AS reach FROM e JOIN w ON {on}),
 q AS (SELECT * FROM (VALUES ('pm', 'opt'), ('opt', 'pm'), ('spot', 'pm'), ('spot', 'opt')) p(leg, second)),
 c AS (SELECT event_id, window_seconds, leg, second, count(*) AS triggers, CAST(sum(CASE WHEN follower <= t + reach THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM (
  SELECT j.event_id, j."timestamp" AS t, j.leg, q.second, s.window_seconds, s.reach, s."end",
   (SELECT min(f."timestamp") FROM {jumps} f WHERE f.event_id = j.event_id AND f.leg = q.second AND f."timestamp" > j."timestamp") AS follower
  FROM {jumps} j JOIN q ON q.leg = j.leg JOIN s ON s.event_id = j.event_id) WHERE t + reach <= "end" GROUP BY ALL)
SELECT s.event_id, s.window_seconds, q.leg || '_then_' || q.second AS sequence, coalesce(triggers, 0) AS triggers, coalesce(hits, 0) AS hits, CASE WHEN triggers > 0 THEN round(hits / CAST(triggers AS DOUBLE), 6) + 0.0 END AS probability
 FROM s JOIN q ON true LEFT JOIN c ON c.event_id = s.event_id AND c.window_seconds = s.window_seconds AND c.leg = q.leg AND c.second = q.second"""


def _sync_columns(s):
    return s.select("event_id", "window_seconds", "sequence", "triggers", "hits", r6(F.col("probability")).alias("probability"))


@query("event_sync_grid", _sync_sql("gjumps", 'SELECT event_id, max("timestamp") AS "end" FROM windows GROUP BY event_id'))
def event_sync_grid(spark, d):
    w = windows(spark, d)
    ends = w.groupBy("event_id").agg(F.max("timestamp").alias("end"))
    return _sync_columns(A.event_sync(A.grid_jumps(w, CONFIG), ends, CONFIG.analysis_scales, CONFIG))


view("live", f"""
SELECT j.event_id, j."timestamp", j.leg FROM jumps j JOIN (SELECT event_id, mapping_hash, coalesce(max(CASE WHEN NOT valid THEN raw_id END), -1) AS brk FROM obs WHERE now_ms <= {NOW} GROUP BY ALL) b
 USING (event_id, mapping_hash) WHERE j.segment = b.brk AND j."timestamp" BETWEEN {NOW - 7200 * SCALE * 1000} AND {NOW}""")


@query("event_sync_native", _sync_sql("live", f'SELECT DISTINCT event_id, {NOW} AS "end" FROM obs'))
def event_sync_native(spark, d):
    """Coincidences of native jumps still on record at the end of the tape."""
    obs = stage_table(observations(spark, d), "observations")
    jumps = dynamics.live_jumps(obs, dynamics.native_jumps(obs, CONFIG, slice_rows=SLICE_ROWS), NOW, CONFIG)
    ends = obs.select("event_id").distinct().withColumn("end", F.lit(NOW))
    return _sync_columns(A.event_sync(jumps.select("event_id", "timestamp", "leg"), ends, CONFIG.analysis_scales, CONFIG, slice_ms=10 * DAY))


# One curve of three aligned strikes; another with a short strike, which cannot be compared; two strikes are too few.
CURVES = {"c3": ("g0", "g1", "g2"), "broken": ("g3", "short", "g1"), "pair": ("g2", "g3"), "gone": ("g0", "g1", "none")}
view("edges", """
SELECT *, distance <= scale AS edge FROM (SELECT a.current, a.event_id AS a, b.event_id AS b, sqrt(greatest(0, 2 * (1 - least(1, greatest(-1, corr(a.gap_pp, b.gap_pp)))))) AS distance
 FROM windows a JOIN windows b ON a."timestamp" = b."timestamp" AND a.current = b.current AND a.event_id < b.event_id WHERE a.event_id IN ('g0', 'g1', 'g2') AND b.event_id IN ('g0', 'g1', 'g2') GROUP BY ALL), (VALUES (0.4::DOUBLE), (0.8::DOUBLE), (1.2::DOUBLE), (1.6::DOUBLE)) s(scale)""")


def _aligned(spark, d):
    members = spark.createDataFrame([(e, c) for c, own in CURVES.items() for e in own], "event_id string, curve_id string")
    return A.aligned_curves(scoped_grid(spark, d), members, CONFIG)


def _edges(spark, d):
    return A.curve_edges(windows(spark, d).join(_aligned(spark, d), "event_id"))


@query("strike_topology", """SELECT scale, CASE WHEN sum(greatest(ea, eb)) > 0 THEN round(sum(CAST(ea <> eb AS INTEGER)) / CAST(sum(greatest(ea, eb)) AS DOUBLE), 6) + 0.0 ELSE 0.0::DOUBLE END AS edge_jaccard_distance FROM (
 SELECT scale, a, b, max(CASE WHEN current = 0 AND edge THEN 1 ELSE 0 END) AS ea, max(CASE WHEN current = 1 AND edge THEN 1 ELSE 0 END) AS eb FROM edges GROUP BY ALL) GROUP BY scale""")
def strike_topology(spark, d):
    return A.edge_jaccard(_edges(spark, d)).select("scale", r6(F.col("edge_jaccard_distance")).alias("edge_jaccard_distance"))


@query("curve_components", """WITH RECURSIVE reach(current, scale, node, other) AS (
  SELECT current, scale, a, a FROM edges UNION SELECT current, scale, b, b FROM edges
  UNION SELECT r.current, r.scale, r.node, CASE WHEN e.a = r.other THEN e.b ELSE e.a END FROM reach r JOIN edges e ON e.current = r.current AND e.scale = r.scale AND e.edge AND r.other IN (e.a, e.b))
 SELECT current, scale, node AS event_id, min(other) AS component FROM reach GROUP BY ALL""")
def curve_components(spark, d):
    return A.curve_components(_edges(spark, d)).drop("curve_id")


@query("topology_score", """SELECT round(avg(d), 6) + 0.0 AS score FROM (SELECT scale, CASE WHEN sum(greatest(ea, eb)) > 0 THEN sum(CAST(ea <> eb AS INTEGER)) / CAST(sum(greatest(ea, eb)) AS DOUBLE) ELSE 0.0::DOUBLE END AS d FROM (
 SELECT scale, a, b, max(CASE WHEN current = 0 AND edge THEN 1 ELSE 0 END) AS ea, max(CASE WHEN current = 1 AND edge THEN 1 ELSE 0 END) AS eb FROM edges GROUP BY ALL) GROUP BY scale) HAVING count(*) > 0""")
def topology_score(spark, d):
    return A.topology_score(A.edge_jaccard(_edges(spark, d))).select(r6(F.col("score")).alias("score"))


@query("new_clusters", """WITH RECURSIVE reach(current, scale, node, other) AS (
  SELECT current, scale, a, a FROM edges UNION SELECT current, scale, b, b FROM edges
  UNION SELECT r.current, r.scale, r.node, CASE WHEN e.a = r.other THEN e.b ELSE e.a END FROM reach r JOIN edges e ON e.current = r.current AND e.scale = r.scale AND e.edge AND r.other IN (e.a, e.b)),
 sets AS (SELECT DISTINCT current, scale, members FROM (SELECT current, scale, node, string_agg(other, ',' ORDER BY other) AS members FROM reach GROUP BY ALL))
 SELECT scale, members FROM sets s WHERE current = 1 AND members LIKE '%,%' AND NOT EXISTS (SELECT 1 FROM sets t WHERE t.current = 0 AND t.scale = s.scale AND t.members = s.members)""")
def new_clusters(spark, d):
    return A.new_clusters(A.curve_components(_edges(spark, d))).select("scale", F.concat_ws(",", "members").alias("members"))


@query("analyzer_status", f"""SELECT s.event_id, algo_name, CASE WHEN algo_name = 'sequential_martingale' THEN 'disabled' WHEN algo_name = 'event_sync' THEN CASE WHEN s.event_id IN ('g0', 'g1', 'none') THEN 'ok' ELSE 'insufficient_data' END
   WHEN coalesce(n, 0) >= {2 * N} AND (algo_name <> 'topology' OR s.event_id IN ('g0', 'g1', 'g2')) THEN 'ok' ELSE 'insufficient_data' END AS status, coalesce(n, 0) AS observations,
  CASE algo_name WHEN 'sliced_wasserstein' THEN (SELECT round(avg(distance), 6) + 0.0 FROM sw WHERE sw.event_id = s.event_id)
   WHEN 'ordinal_mmd' THEN (SELECT round(sum((now - baseline) * (now - baseline)), 6) + 0.0 FROM motifs WHERE motifs.event_id = s.event_id) END AS score
 FROM scopes s LEFT JOIN (SELECT event_id, count(*) AS n FROM sgrid GROUP BY event_id) g USING (event_id), (VALUES {', '.join(f"('{n}')" for n in A.FAMILIES)}) a(algo_name)""")
def analyzer_status(spark, d):
    """The analyzer registry with the two scores plain SQL can express: full, short and empty scopes, with and without jumps."""
    g = scoped_grid(spark, d)
    w = A.split_windows(grid(spark, d), N)
    sw = A.wasserstein_score(A.sliced_wasserstein(A.baseline_standardize(w))).select("event_id", "score")
    mmd = A.ordinal_mmd(w).groupBy("event_id").agg(F.sum(F.col("change") * F.col("change")).alias("score"))
    native = spark.createDataFrame([("g0",), ("g1",), ("g1",), ("none",)], "event_id string")
    s = A.analyzer_status(g, {"sliced_wasserstein": sw, "ordinal_mmd": mmd}, CONFIG, scopes(spark), native, _aligned(spark, d))
    return s.select("event_id", "algo_name", "status", "observations", r6(F.col("score")).alias("score"))
