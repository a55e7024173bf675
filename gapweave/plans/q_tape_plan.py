"""Registered query: observations of a raw packet tape, and the packets behind each of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, legs, tape_plan
from ..sources import feeds
from .fixtures import CONFIG, DAY, SCALE, SLICE_ROWS, START, dealt, observations, r6, ticks
from .q_observe import ncdf
from .q_sources import _SRC, health_rows, spot_packets
from .registry import CHECKS, query, view

# What each packet of ``events`` is: books by token, spots and summaries of BTC, equity chains of TSLA (with a spot for the former
# spot packets), and control packets: listings, mappings, dismissals, sessions and timers.
view("rawtape", """
SELECT id, received_ms, value, user_id % 8 AS n, CASE WHEN user_id % 8 < 4 THEN 'BTC' ELSE 'TSLA' END AS asset, CASE kind WHEN 'pm' THEN 'pm' WHEN 'outage' THEN 'history' WHEN 'opt' THEN 'options'
  WHEN 'spot' THEN CASE WHEN user_id % 8 < 4 THEN 'spot' ELSE 'options' END ELSE CASE user_id % 5 WHEN 0 THEN 'catalog' WHEN 1 THEN 'mapping' WHEN 2 THEN CASE WHEN id % 3 = 0 THEN 'dismiss' ELSE 'timer' END WHEN 3 THEN CASE WHEN id % 50 = 0 THEN 'session' ELSE 'timer' END ELSE 'timer' END END AS kind,
  kind = 'spot' AS spotted, kind = 'outage' AND id % 7 = 0 AS malformed FROM ticks""")


def raw_tape(spark, d):
    """``events`` as raw packets with payloads."""
    t, n = dealt(ticks(spark, d), "id"), F.col("user_id") % 8
    u, v, was = F.col("user_id") % 5, F.col("value"), F.col("kind")
    crypto = n < 4
    control = (F.when(u == 0, "catalog").when(u == 1, "mapping").when(u == 2, F.when(F.col("id") % 3 == 0, "dismiss").otherwise("timer"))
               .when(u == 3, F.when(F.col("id") % 50 == 0, "session").otherwise("timer")).otherwise("timer"))
    kind = (F.when(was == "outage", "history").when(was == "opt", "options").when(was == "spot", F.when(crypto, "spot").otherwise("options"))
            .when(was == "pm", "pm").otherwise(control))
    event = F.concat(F.lit("m"), n)
    level = lambda p: F.array(F.struct(p.alias("price"), F.lit("9").alias("size")))
    book = F.struct(F.lit("book").alias("event_type"), F.concat(F.lit("t"), n).alias("asset_id"), level(F.round(v / 500 - 0.02, 6).cast("string")).alias("bids"), level(F.round(v / 500 + 0.02, 6).cast("string")).alias("asks"))
    call = lambda k, bid: F.struct(F.lit(f"BTC-10FEB24-{k}-C").alias("instrument_name"), F.lit(950.0).alias("underlying_price"), F.lit(bid).alias("bid_price"), F.lit(bid).alias("ask_price"), F.lit(bid).alias("mark_price"), F.lit(50.0).alias("mark_iv"))
    summary = F.struct(F.array(call(900, 0.1), call(1000, 0.05)).alias("result"))
    stock = lambda k, bid: F.struct(F.lit(f"c{k}").alias("instrument"), F.lit(float(k)).alias("strike"), F.lit(bid).alias("bid"), F.lit(bid).alias("ask"), F.lit(bid).alias("mark"), F.lit(0.5).alias("iv"))
    equity = F.struct(
        F.array(F.struct(F.lit(1_707_598_800_000).alias("expiry"), F.array(stock(900, 90.0), stock(1000, 40.0)).alias("calls"))).alias("chains"),
        F.when(was == "spot", v + 850).alias("spot"), F.struct(F.lit("OPEN").alias("market_state")).alias("underlying_context"))
    title = lambda i: f"Will Bitcoin close above $9{i}0 on February 10?" if i < 4 else f"Will Tesla (TSLA) close above $9{i}0 on February 10?"
    market = lambda i: F.struct(
        F.lit(f"m{i}").alias("id"), F.lit(title(i)).alias("question"), F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"), F.array(F.lit(f"t{i}"), F.lit(f"x{i}")).alias("clobTokenIds"),
        F.array(F.round(v / 500, 6).cast("string"), F.lit("0")).alias("outcomePrices"), F.lit("2024-02-10T08:00:00Z").alias("endDate"))
    mapping = F.struct(
        event.alias("event_id"), F.lit("t").alias("event_text"), F.when(crypto, "BTC").otherwise("TSLA").alias("asset"), F.lit("terminal").alias("event_type"),
        F.when(F.col("id") % 2 == 0, "down").otherwise("up").alias("direction"), F.lit("950").alias("strike_or_threshold"), F.lit("2024-02-10T08:00:00Z").alias("expiry"),
        F.concat(F.lit("t"), n).alias("yes_token"), F.lit("VERIFIED").alias("mapping_review"))
    payload = (
        F.when(F.col("k") == "pm", F.to_json(book)).when(F.col("k") == "spot", F.to_json(F.struct((v / 2 + 850).alias("price"))))
        .when((F.col("k") == "options") & crypto, F.to_json(summary)).when(F.col("k") == "options", F.to_json(equity))
        .when((F.col("k") == "history") & (F.col("id") % 7 == 0), F.lit('{"candles": []}')).when(F.col("k") == "history", F.lit('{"start_ms": 1704067200000, "candles": []}'))
        .when(F.col("k") == "catalog", F.to_json(F.struct(F.array(*[market(i) for i in range(8)]).alias("markets"))))
        .when(F.col("k") == "mapping", F.to_json(mapping)).when(F.col("k") == "dismiss", F.to_json(F.struct(event.alias("event_id"))))
        .when(F.col("k") == "session", F.to_json(F.struct(F.struct((v / 1000 + 0.01).alias("max_pm_spread")).alias("config")))).otherwise("{}"))
    return t.withColumn("k", kind).select(
        "id", "received_ms", F.col("k").alias("kind"), F.when((F.col("k") == "options") & ~crypto, "yahoo").when(F.col("k") == "options", "deribit").otherwise("feed").alias("source"),
        F.when(F.col("k").isin("spot", "options", "history"), F.when(crypto, "BTC").otherwise("TSLA")).when(F.col("k").isin("mapping", "dismiss"), event).alias("subject"),
        F.lit(None).cast("bigint").alias("source_ms"), payload.alias("payload"))


view("decisions", "SELECT 'm' || n AS event_id, id, kind, CASE WHEN id % 2 = 0 THEN 'down' ELSE 'up' END AS direction FROM rawtape WHERE kind IN ('mapping', 'dismiss')")
view("concerned", """
SELECT r.id AS raw_id, r.kind, r.received_ms, 'm' || e.n AS event_id, 't' || e.n AS token, e.n, CASE WHEN e.n < 4 THEN 'BTC' ELSE 'TSLA' END AS asset
FROM rawtape r JOIN (SELECT * FROM range(8) x(n)) e ON CASE WHEN r.kind IN ('pm', 'mapping') THEN r.n = e.n WHEN r.kind IN ('spot', 'options', 'history') THEN r.asset = CASE WHEN e.n < 4 THEN 'BTC' ELSE 'TSLA' END ELSE r.kind IN ('catalog', 'timer') END
WHERE NOT r.malformed""")


# The legs behind each observation and the session's threshold, then gate, model, flags and gap by their definitions. Option expiries: the summary's
# is the propositions' own, so a strike between its two is a call spread; the equity chain's is 13 hours later, so its volatility counts.
view("tape_legs", f"""
SELECT c.raw_id, c.event_id, c.kind, c.received_ms AS now_ms, c.asset, d.id IS NOT NULL AS mapped, CASE WHEN d.id IS NOT NULL THEN d.direction ELSE 'up' END AS direction,
  CASE WHEN d.id IS NOT NULL THEN 950.0 ELSE 900.0 + 10 * c.n END AS k, d.id AS mapping_ref, w.id AS catalog_ref, b.id AS book_ref, o.id AS options_ref, s.id AS spot_ref,
  (b.id IS NULL OR c.received_ms - b.received_ms > {90_000 * SCALE}) AND w.value <= 500 AS fb, w.received_ms AS listed_ms, round(w.value / 500, 6) AS listed,
  b.received_ms AS book_ms, CASE WHEN round(b.value / 500 - 0.02, 6) BETWEEN 0 AND 1 THEN round(b.value / 500 - 0.02, 6) END AS bid, CASE WHEN round(b.value / 500 + 0.02, 6) BETWEEN 0 AND 1 THEN round(b.value / 500 + 0.02, 6) END AS ask,
  o.received_ms AS options_ms, s.received_ms AS spot_ms, CASE c.asset WHEN 'BTC' THEN s.value / 2 + 850 ELSE s.value + 850 END AS spot,
  coalesce(CASE WHEN z.value / 1000 + 0.01 <= 1 THEN z.value / 1000 + 0.01 END, 0.1) AS wide
 FROM concerned c ASOF LEFT JOIN decisions d ON c.event_id = d.event_id AND c.raw_id >= d.id
 ASOF LEFT JOIN (SELECT id, value, received_ms FROM rawtape WHERE kind = 'catalog') w ON c.raw_id >= w.id
 ASOF LEFT JOIN (SELECT id, n, value, received_ms FROM rawtape WHERE kind = 'pm') b ON c.n = b.n AND c.raw_id >= b.id
 ASOF LEFT JOIN (SELECT id, asset, received_ms FROM rawtape WHERE kind = 'options') o ON c.asset = o.asset AND c.raw_id >= o.id
 ASOF LEFT JOIN (SELECT id, asset, value, received_ms FROM rawtape WHERE spotted) s ON c.asset = s.asset AND c.raw_id >= s.id
 ASOF LEFT JOIN (SELECT id, value FROM rawtape WHERE kind = 'session') z ON c.raw_id >= z.id
 WHERE coalesce(d.kind, '') <> 'dismiss' AND (d.id IS NOT NULL OR w.id IS NOT NULL)""")
_EXPIRY = 1_707_552_000_000
view("tape_gate", f"""
SELECT *, CASE WHEN {_EXPIRY} <= now_ms THEN 'ENDED:EVENT_CUTOFF_PASSED' WHEN pm_yes IS NULL THEN 'WAIT:MISSING_PM'
  WHEN NOT now_ms - pm_ms BETWEEN 0 AND CASE WHEN fb THEN {240_000 * SCALE} ELSE {90_000 * SCALE} END THEN 'STALE:PM_AGE_LIMIT'
  WHEN options_ref IS NULL THEN 'WAIT:MISSING_OPTIONS' WHEN NOT now_ms - options_ms BETWEEN 0 AND CASE asset WHEN 'TSLA' THEN {120_000 * SCALE} ELSE {45_000 * SCALE} END THEN 'STALE:OPTIONS_AGE_LIMIT'
  WHEN spot IS NULL THEN 'WAIT:MISSING_SPOT' WHEN NOT now_ms - spot_ms BETWEEN 0 AND CASE asset WHEN 'TSLA' THEN {120_000 * SCALE} ELSE {30_000 * SCALE} END THEN 'STALE:SPOT_AGE_LIMIT' END AS gate
FROM (SELECT *, CASE WHEN fb THEN listed ELSE (bid + ask) / 2 END AS pm_yes, CASE WHEN fb THEN listed_ms ELSE book_ms END AS pm_ms,
  asset = 'BTC' AND k > 900 AND k < 1000 AS digital, 0.5 AS iv, ({_EXPIRY} - now_ms) / 31536000000.0::DOUBLE AS years FROM tape_legs)""")
view("tape_priced", f"""
SELECT *, CASE WHEN gate IS NULL THEN CASE WHEN digital THEN CASE direction WHEN 'up' THEN 0.475 ELSE 0.525 END ELSE {ncdf('d2')} END END AS q
FROM (SELECT *, CASE WHEN gate IS NULL THEN CASE direction WHEN 'up' THEN 1 ELSE -1 END * (ln(spot / k) - iv * iv * years / 2) / (iv * sqrt(years)) END AS d2 FROM tape_gate)""")


@query("observe_from_tape", """SELECT raw_id, event_id, kind, direction, mapping_ref, catalog_ref, CASE WHEN fb THEN catalog_ref ELSE book_ref END AS pm_ref, options_ref, spot_ref,
  coalesce(split_part(gate, ':', 1), 'PROXY') AS source_state, CASE WHEN gate IS NULL THEN CASE WHEN digital THEN 'SPREAD' ELSE 'IV' END END AS method,
  CASE WHEN gate IS NULL THEN CASE WHEN digital AND q BETWEEN 0.01 AND 0.99 THEN 'MEDIUM' ELSE 'LOW' END ELSE 'UNAVAILABLE' END AS model_confidence,
  round(pm_yes, 6) + 0.0 AS pm_yes, round(q, 6) + 0.0 AS opt_yes, round((pm_yes - q) * 100, 5) + 0.0 AS gap_pp,
  concat_ws(',', split_part(gate, ':', 2), CASE WHEN gate IS NULL AND NOT mapped THEN 'UNVERIFIED_SETTLEMENT_SEMANTICS' END,
   CASE WHEN gate IS NULL AND asset = 'TSLA' THEN 'YAHOO_DELAY_UNKNOWN,EQUITY_SESSION_CLOSE_PROXY,AMERICAN_OPTION_PROXY,ZERO_DIVIDEND_PROXY,OVERNIGHT_JUMP_MODEL_LIMIT' END,
   CASE WHEN gate IS NULL AND fb THEN 'INDICATIVE_PM_TIMESTAMP_IS_RETRIEVAL' END, CASE WHEN gate IS NULL AND NOT coalesce(fb, false) AND coalesce(ask, 0) - coalesce(bid, 0) > wide THEN 'WIDE_PM_BOOK' END,
   CASE WHEN gate IS NULL AND digital THEN 'FINITE_SPREAD_REPLICATION_ERROR' END, CASE WHEN gate IS NULL AND digital AND 100 / spot > 0.05 THEN 'SPARSE_STRIKES' END,
   CASE WHEN gate IS NULL AND digital AND abs(950 - k) > 1 THEN 'ASYMMETRIC_STRIKE_BRACKET' END, CASE WHEN gate IS NULL AND NOT digital THEN 'FLAT_IV_MODEL' END,
   CASE WHEN gate IS NULL AND asset = 'TSLA' THEN 'EXPIRY_IV_PROXY' END, CASE WHEN q < 0.01 OR q > 0.99 THEN 'EXTREME_TAIL_MODEL_SENSITIVITY' END, CASE WHEN q IN (0, 1) THEN 'MODEL_ENDPOINT' END) AS quality_flags
 FROM tape_priced""")
def observe_from_tape(spark, d):
    """The whole chain from raw packets: state, flags, probabilities and gap of each observation, and the packets it rests on."""
    o = tape_plan.observe_from_tape(raw_tape(spark, d), CONFIG, SLICE_ROWS)
    refs = {"mapping": "mapping_ref", "catalog": "catalog_ref", "pm": "pm_ref", "options": "options_ref", "spot": "spot_ref"}
    return o.select("raw_id", "event_id", "kind", "direction", *[F.col("input_refs")[k].alias(name) for k, name in refs.items()], "source_state", "method", "model_confidence",
                    r6(F.col("pm_yes")).alias("pm_yes"), r6(F.col("opt_yes")).alias("opt_yes"), r6(F.col("gap_pp"), 5).alias("gap_pp"), F.concat_ws(",", "quality_flags").alias("quality_flags"))


@query("tape_errors", "SELECT id, kind, 'MISSING_START_MS' AS error FROM rawtape WHERE malformed")
def tape_errors(spark, d):
    """The packets that the plan sets aside, with what is wrong with them: its second result, which needs none of its stages."""
    return feeds.quarantine(raw_tape(spark, d))[1].select("id", "kind", "error")


# The whole state on day 12: propositions of four strikes per asset, of which the valid ones are curves.
_AT = START + 12 * DAY
_LIMIT = f"(CASE WHEN source = 'catalog' THEN 360000 WHEN source LIKE 'history:%' THEN 600000 WHEN source LIKE 'yahoo%' THEN 120000 ELSE 90000 END) * {SCALE}"
view("newest", f"SELECT *, CASE WHEN event_id < 'm4' THEN 'BTC' ELSE 'TSLA' END AS of_asset FROM obs WHERE now_ms <= {_AT} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY raw_id DESC) = 1")


@query("engine_snapshot", f"""SELECT 'observation' AS part, event_id AS key, raw_id, source_state AS state, round(gap_pp, 6) + 0.0 AS value FROM newest
 UNION ALL SELECT 'source', source, raw_id, CASE WHEN state = 'OK' AND {_AT} - seen > {_LIMIT} THEN 'STALE' ELSE state END, CAST({_AT} - seen AS DOUBLE) FROM (
   SELECT source, arg_max(state, id) AS state, arg_max(received_ms, id) AS seen, max(id) AS raw_id FROM (
    SELECT *, {_SRC} AS source, CASE WHEN kind IN ('outage', 'timer') THEN 'ERROR' ELSE 'OK' END AS state FROM ticks WHERE received_ms <= {_AT}) GROUP BY source)
 UNION ALL SELECT 'spot', asset, max(raw_id), arg_max(timestamp_origin, raw_id), round(arg_max(price, raw_id), 6) + 0.0 FROM ({CHECKS['spot_state']}) s
   WHERE raw_id IN (SELECT id FROM ticks WHERE received_ms <= {_AT}) GROUP BY asset
 UNION ALL SELECT 'curve', of_asset || '|9|terminal|up|~|~|~', max(raw_id), 'terminal_probability', CAST(count(*) AS DOUBLE) FROM newest WHERE valid GROUP BY of_asset HAVING count(*) >= 2""")
def engine_snapshot(spark, d):
    """Observations, feeds, spots and curves as they stood on day 12."""
    n = F.expr("CAST(substr(event_id, 2) AS INT)")
    obs = observations(spark, d).withColumns({
        "asset": F.when(n < 4, "BTC").otherwise("TSLA"), "expiry": F.lit(9), "event_type": F.lit("terminal"), "direction": F.lit("up"), "window_start": F.lit(None).cast("bigint"),
        "settlement_source": F.lit(None).cast("string"), "threshold_inclusive": F.lit(None).cast("boolean"), "strike_or_threshold": n * 10.0})
    spots = legs.spot_state(spot_packets(spark, d), CONFIG.scaled(5000), SLICE_ROWS)
    out = history.engine_snapshot(obs, health_rows(spark, d), spots, _AT, CONFIG)
    return out.withColumn("value", r6(F.col("value")))
