"""Registered queries: closed forms, quality gate and full observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import costs as C
from ..functions import pricing as P
from ..operators import observe as O
from ..operators import surface as SF
from ..session import stage_table
from .fixtures import CONFIG, DAY, SCALE, SLICE_ROWS, START, observations, r6, table, ticks
from .registry import CHECKS, query, view


# ------------------------------------------------------------- closed forms ----------
def ncdf(x: str) -> str:
    """The normal distribution function of a SQL column, same rational form."""
    z = f"abs({x})"

    def horner(cs):
        text = repr(cs[0]) + "::DOUBLE"
        for c in cs[1:]:
            text = f"({text} * {z} + {c!r}::DOUBLE)"
        return text

    e = f"exp(-{z} * {z} / 2)"
    near = f"{e} * {horner(P.TAIL_NUMERATOR)} / {horner(P.TAIL_DENOMINATOR)}"
    far = f"({z} + 0.65)"
    for k in (4, 3, 2, 1):
        far = f"({z} + {k} / {far})"
    tail = f"(CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < 7.07106781186547 THEN {near} ELSE {e} / {far} / 2.506628274631 END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


view("gbm", """
SELECT p_partkey, 850.0 + p_size * 4 AS spot, p_retailprice AS strike, CASE WHEN p_size % 11 = 0 THEN 0 ELSE p_size / CAST(60 AS DOUBLE) END AS sigma,
  (p_partkey % 37) / CAST(24 AS DOUBLE) AS years, CASE p_partkey % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE CASE WHEN p_size % 2 = 0 THEN 'up' ELSE 'flat' END END AS direction FROM part""")
view("gbm_ok", "SELECT *, spot > 0 AND strike > 0 AND sigma > 0 AND years > 0 AND direction <> 'flat' AS ok FROM gbm")


def gbm(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", (size * 4 + 850.0).alias("spot"), F.col("p_retailprice").alias("strike"),
        F.when(size % 11 == 0, 0.0).otherwise(size / F.lit(60.0)).alias("sigma"), ((k % 37) / F.lit(24.0)).alias("years"),
        F.when(k % 3 == 0, "up").when(k % 3 == 1, "down").otherwise(F.when(size % 2 == 0, "up").otherwise("flat")).alias("direction"))


@query("normal_cdf", f"SELECT vec_id, i, round({ncdf('x')}, 9) + 0.0 AS p FROM (SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) * 20 AS x FROM embeddings)")
def normal_cdf(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", "i", r6(P.normal_cdf(F.col("v").cast("double") * 20), 9).alias("p"))


_GBM = ("spot", "strike", "sigma", "years", "direction")


@query("terminal_probability", f"""SELECT p_partkey, CASE WHEN ok THEN round({ncdf('d')}, 7) + 0.0 END AS probability FROM (
 SELECT *, CASE WHEN ok THEN CASE direction WHEN 'up' THEN 1 ELSE -1 END * (ln(spot / strike) - sigma * sigma * years / 2) / (sigma * sqrt(years)) END AS d FROM gbm_ok)""")
def terminal_probability(spark, d):
    g = P.with_terminal_probability(gbm(spark, d), "probability", *map(F.col, _GBM))
    return g.select("p_partkey", r6(F.col("probability"), 7).alias("probability"))


@query("touch_probability", f"""SELECT p_partkey, CASE WHEN NOT ok THEN NULL WHEN beyond THEN 1.0::DOUBLE WHEN ex <= 700 THEN
  round(least(1.0, greatest(0.0, {ncdf('a')} + exp(ex) * {ncdf('b')})), 7) + 0.0 END AS probability FROM (
 SELECT *, (-dist - drift * years) / scale AS a, (-dist + drift * years) / scale AS b FROM (
  SELECT *, (direction = 'up' AND spot >= strike) OR (direction = 'down' AND spot <= strike) AS beyond, -2 * drift * dist / (sigma * sigma) AS ex FROM (
   SELECT *, abs(ln(strike / spot)) AS dist, sigma * sigma / 2 * CASE direction WHEN 'up' THEN 1 ELSE -1 END AS drift, sigma * sqrt(years) AS scale FROM gbm_ok)))""")
def touch_probability(spark, d):
    g = P.with_touch_probability(gbm(spark, d), "probability", *map(F.col, _GBM))
    return g.select("p_partkey", r6(F.col("probability"), 7).alias("probability"))


@query("option_value", f"""SELECT p_partkey, CASE WHEN years <= 0 THEN round(greatest(0.0, CASE WHEN put THEN strike - spot ELSE spot - strike END)::DOUBLE, 5) + 0.0
  WHEN scale IS NULL THEN NULL WHEN put THEN round(strike * {ncdf('m2')} - spot * {ncdf('m1')}, 5) + 0.0 ELSE round(spot * {ncdf('d1')} - strike * {ncdf('d2')}, 5) + 0.0 END AS premium FROM (
 SELECT *, -d1 AS m1, -d2 AS m2 FROM (SELECT *, d1 - scale AS d2 FROM (
  SELECT *, (ln(spot / strike) + 0.5 * sigma * sigma * years) / scale AS d1 FROM (
   SELECT *, CASE WHEN sigma > 0 AND years > 0 THEN sigma * sqrt(years) END AS scale, p_partkey % 2 = 0 AS put FROM gbm))))""")
def option_value(spark, d):
    """Every part; null where there is no volatility and time is left."""
    g = P.with_option_value(gbm(spark, d), "v", F.col("spot"), F.col("strike"), F.col("sigma"), F.col("years"), F.col("p_partkey") % 2 == 0)
    return g.select("p_partkey", r6(F.col("v"), 5).alias("premium"))


@query("option_value_all", CHECKS["option_value"])
def option_value_all(spark, d):
    """``option_value`` under its earlier name."""
    return option_value(spark, d)


@query("discrepancy", """SELECT p_partkey, round((pm - opt) * 100, 6) + 0.0 AS gap_pp, CASE WHEN opt > 0 THEN round(abs(pm - opt) / opt, 6) + 0.0 END AS relative_gap,
 CASE WHEN pm > opt THEN 'CHEAP' WHEN pm < opt THEN 'RICH' WHEN pm = opt THEN 'EVEN' END AS side FROM (
 SELECT p_partkey, CASE WHEN p_size <= 40 THEN p_size / CAST(40 AS DOUBLE) END AS pm, (p_partkey % 11) / CAST(10 AS DOUBLE) AS opt FROM part)""")
def discrepancy(spark, d):
    """Gap of two probabilities; values outside 0..1 have none."""
    pm, opt = F.col("p_size") / F.lit(40.0), (F.col("p_partkey") % 11) / F.lit(10.0)
    return table(spark, d, "part").select(
        "p_partkey", r6(P.gap_pp(pm, opt)).alias("gap_pp"), r6(P.relative_gap(pm, opt)).alias("relative_gap"), P.gap_side(pm, opt).alias("side"))


view("cost_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS mid, CASE WHEN l_linenumber % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS side, l_quantity AS quantity,
  CASE WHEN l_suppkey % 2 = 0 THEN 100 ELSE 1 END AS multiplier, l_suppkey % 2 = 0 AS is_option, abs(l_discount) / 10 AS half FROM lineitem""")
view("cost_filled", """
SELECT *, greatest(0.0, CASE side WHEN 'BUY' THEN price + slip ELSE price - slip END) AS fill FROM (
 SELECT *, price * (10 + 5 * price * quantity * multiplier / 10000) / 10000 AS slip FROM (
  SELECT *, mid * CASE side WHEN 'BUY' THEN 1 + half ELSE 1 - half END AS price FROM cost_rows))""")


@query("trade_costs", """SELECT l_orderkey, l_linenumber, side, round(fill, 4) + 0.0 AS fill_price, round(abs(fill - price) * quantity * multiplier, 2) + 0.0 AS slippage,
 round(fees, 2) + 0.0 AS fees, CASE side WHEN 'BUY' THEN round(fill * quantity * multiplier + fees, 1) + 0.0 END AS total_debit,
 CASE side WHEN 'SELL' THEN round(fill * quantity * multiplier - fees, 1) + 0.0 END AS net_credit FROM (
  SELECT *, fill * quantity * multiplier / 1000 + CASE WHEN is_option THEN quantity * 0.65 ELSE 0 END AS fees FROM cost_filled)""")
def trade_costs(spark, d):
    li = table(spark, d, "lineitem")
    mid, half = F.col("l_extendedprice") / F.col("l_quantity"), F.abs("l_discount") / 10
    side = F.when(F.col("l_linenumber") % 2 == 1, "BUY").otherwise("SELL")
    option = F.col("l_suppkey") % 2 == 0
    cost = C.trade_costs(mid * (1 - half), mid * (1 + half), side, F.col("l_quantity"), F.when(option, 100).otherwise(1), option)
    digits = {"fill_price": 4, "slippage": 2, "fees": 2, "total_debit": 1, "net_credit": 1}
    return li.select("l_orderkey", "l_linenumber", side.alias("side"), *[r6(cost[n], k).alias(n) for n, k in digits.items()])


@query("observation_valid", "SELECT event_id, source_state, valid, count(*) AS n FROM obs GROUP BY ALL")
def observation_valid(spark, d):
    return observations(spark, d).groupBy("event_id", "source_state", "valid").agg(F.count("*").alias("n"))


# --------------------------------------------------- packets of the full engine ------
X40, X70 = START + 40 * DAY, START + 70 * DAY
view("props", f"""
SELECT 'm' || n AS event_id, CASE WHEN n < 4 THEN 'BTC' ELSE 'TSLA' END AS asset, 't' || n AS yes_token, CASE WHEN n % 4 = 3 THEN 'touch' ELSE 'terminal' END AS event_type,
  CASE WHEN n % 2 = 0 OR n = 7 THEN 'up' ELSE 'down' END AS direction, 906.0::DOUBLE + 10 * n AS strike_or_threshold,
  CASE n % 4 WHEN 0 THEN {X40} WHEN 1 THEN {X40 - DAY} WHEN 2 THEN {START + 15 * DAY} ELSE {X40 - DAY // 2} END AS expiry,
  CASE n WHEN 4 THEN 'VERIFIED' WHEN 6 THEN 'MISMATCH' ELSE 'UNVERIFIED' END AS mapping_review, CASE WHEN n % 2 = 0 THEN 'Coinbase' END AS settlement_source,
  CASE WHEN n % 4 = 3 THEN {START} END AS window_start
FROM (SELECT DISTINCT CAST(user_id % 8 AS BIGINT) AS n FROM ticks)""")
view("tape", """
SELECT id AS raw_id, received_ms AS now_ms, received_ms, CASE kind WHEN 'opt' THEN 'options' WHEN 'outage' THEN 'history' WHEN 'timer' THEN 'catalog' ELSE kind END AS kind,
  CASE kind WHEN 'pm' THEN 't' || (user_id % 8) WHEN 'timer' THEN market ELSE CASE WHEN user_id % 8 < 4 THEN 'BTC' ELSE 'TSLA' END END AS subject, value, user_id
FROM ticks""")


def propositions(spark, d):
    """Eight propositions over two assets, one per market of the tape."""
    n = F.col("n")
    base = ticks(spark, d).select((F.col("user_id") % 8).alias("n")).distinct()
    when4 = lambda *v: F.when(n % 4 == 0, v[0]).when(n % 4 == 1, v[1]).when(n % 4 == 2, v[2]).otherwise(v[3])
    L = lambda v: F.lit(v).cast("bigint")  # noqa: E731,N806
    return base.select(
        F.concat(F.lit("m"), n).alias("event_id"), F.when(n < 4, "BTC").otherwise("TSLA").alias("asset"), F.concat(F.lit("t"), n).alias("yes_token"),
        F.when(n % 4 == 3, "touch").otherwise("terminal").alias("event_type"), F.when((n % 2 == 0) | (n == 7), "up").otherwise("down").alias("direction"),
        (F.lit(906.0) + n * 10).alias("strike_or_threshold"), when4(L(X40), L(X40 - DAY), L(START + 15 * DAY), L(X40 - DAY // 2)).alias("expiry"),
        F.when(n == 4, "VERIFIED").when(n == 6, "MISMATCH").otherwise("UNVERIFIED").alias("mapping_review"),
        F.when(n % 2 == 0, "Coinbase").alias("settlement_source"), F.when(n % 4 == 3, L(START)).alias("window_start"))


def tape(spark, d):
    t, u = ticks(spark, d), F.col("user_id")
    asset = F.when(u % 8 < 4, "BTC").otherwise("TSLA")
    kind = F.col("kind")
    return t.select(
        F.col("id").alias("raw_id"), F.col("received_ms").alias("now_ms"), "received_ms",
        F.when(kind == "opt", "options").when(kind == "outage", "history").when(kind == "timer", "catalog").otherwise(kind).alias("kind"),
        F.when(kind == "pm", F.concat(F.lit("t"), u % 8)).when(kind == "timer", F.col("market")).otherwise(asset).alias("subject"), "value", "user_id")


@query("trigger_fanout", """SELECT t.raw_id, t.kind, p.event_id FROM tape t JOIN props p ON CASE t.kind WHEN 'pm' THEN p.yes_token = t.subject
  WHEN 'catalog' THEN true ELSE p.asset = t.subject END""")
def trigger_fanout(spark, d):
    t = tape(spark, d).select("raw_id", "kind", "subject")
    return O.trigger_fanout(t, propositions(spark, d)).select("raw_id", "kind", "event_id")


@query("session_config_asof", """SELECT t.raw_id, s.raw_id AS session_ref, round(s.value / 100 + 1, 6) + 0.0 AS open_gap_pp FROM tape t
 ASOF LEFT JOIN (SELECT * FROM tape WHERE kind = 'catalog' AND value > 150) s ON t.raw_id >= s.raw_id""")
def session_config_asof(spark, d):
    """Opening threshold in force at each packet; wide catalog packets act as session starts."""
    t = tape(spark, d)
    sessions = t.filter("kind = 'catalog' AND value > 150").select(
        F.col("raw_id").alias("session_raw_id"), F.col("raw_id").alias("session_ref"), (F.col("value") / 100 + 1).alias("open_gap_pp"))
    rows = O.session_config_asof(t.select("raw_id"), sessions, ["session_ref", "open_gap_pp"], SLICE_ROWS)
    return rows.withColumn("open_gap_pp", r6(F.col("open_gap_pp")))


view("w_books", """SELECT subject AS yes_token, raw_id, received_ms, received_ms - (raw_id % 50) * 60000 AS source_ms, CASE WHEN value / 500 BETWEEN 0.03 AND 1 THEN value / 500 - 0.02 END AS bid,
  value / 500 + 0.02 AS ask, user_id % 20 = 0 AS crossed, CASE WHEN user_id % 20 > 0 AND value / 500 BETWEEN 0.03 AND 1 THEN value / 500 END AS yes FROM tape WHERE kind = 'pm'""")
view("w_catalog", "SELECT subject AS event_id, raw_id, received_ms, CASE WHEN value <= 500 AND user_id % 5 > 0 THEN value / 500 END AS pm_indicative FROM tape WHERE kind = 'catalog'")
view("w_spots", """SELECT subject AS asset, raw_id, 850 + value / 2 AS price, received_ms - (raw_id % 40) * 60000 AS source_ms, CASE subject WHEN 'BTC' THEN 'coinbase' ELSE 'yahoo' END AS venue,
  CASE WHEN subject = 'TSLA' THEN CASE WHEN user_id % 10 = 7 THEN 'CLOSED' ELSE 'OPEN' END END AS market_state FROM tape WHERE kind = 'spot'""")
view("w_histories", f"""SELECT subject AS asset, {START} AS window_start, raw_id, received_ms, 860 + value / 4 AS low, 930 + value / 6 AS high, value < 10 AS error FROM tape WHERE kind = 'history'""")
view("w_snapshots", f"""SELECT subject AS asset, x.expiry, raw_id, CASE subject WHEN 'BTC' THEN 'deribit' ELSE 'yahoo' END AS venue, received_ms, received_ms - (raw_id % 30) * 60000 AS source_ms,
  950.0::DOUBLE AS forward, value FROM tape, (VALUES (CAST({X40} AS BIGINT), 1), (CAST({X70} AS BIGINT), 0)) x(expiry, need) WHERE kind = 'options' AND (need = 0 OR user_id % 3 > 0)""")
view("w_brands", "SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part")
view("w_contracts", """SELECT s.raw_id AS id, s.expiry, b.n AS pos, CAST(896 + b.n * 4 AS DOUBLE) AS strike, m - 0.5 AS bid, CASE WHEN b.n % 6 > 0 THEN m + 0.5 END AS ask, m AS mark,
  CASE WHEN b.n % 7 > 0 THEN 0.2 + b.n / CAST(100 AS DOUBLE) END AS iv
 FROM w_snapshots s JOIN w_brands b ON true, LATERAL (SELECT greatest(0, 1000 - (896 + b.n * 4)) * (0.3 + s.value / 400) + 5 AS m)""")


def legs_of(spark, d):
    """Leg states of the packet tape, as the source readers would deliver them."""
    t, v, u = tape(spark, d), F.col("value"), F.col("user_id")
    late = lambda m: F.col("received_ms") - (F.col("raw_id") % m) * 60_000
    of = lambda kind: t.filter(F.col("kind") == kind)
    fair = (v / 500).between(0.03, 1)
    books = of("pm").select(
        F.col("subject").alias("yes_token"), "raw_id", "received_ms", late(50).alias("source_ms"), F.when(fair, v / 500 - 0.02).alias("bid"),
        (v / 500 + 0.02).alias("ask"), (u % 20 == 0).alias("crossed"), F.when((u % 20 > 0) & fair, v / 500).alias("yes"),
        F.lit("source").alias("timestamp_origin"))
    catalog = of("catalog").select(
        F.col("subject").alias("event_id"), "raw_id", "received_ms", F.when((v <= 500) & (u % 5 > 0), v / 500).alias("pm_indicative"))
    equity = F.col("subject") == "TSLA"
    spots = of("spot").select(
        F.col("subject").alias("asset"), "raw_id", "received_ms", (v / 2 + 850).alias("price"), late(40).alias("source_ms"),
        F.when(equity, "yahoo").otherwise("coinbase").alias("venue"),
        F.when(equity, F.when(u % 10 == 7, "CLOSED").otherwise("OPEN")).alias("market_state"))
    histories = of("history").select(
        F.col("subject").alias("asset"), F.lit(START).alias("window_start"), "raw_id", "received_ms", (v / 4 + 860).alias("low"),
        (v / 6 + 930).alias("high"), (v < 10).alias("error"))
    expiries = F.when(u % 3 > 0, F.array(F.lit(X40), F.lit(X70))).otherwise(F.array(F.lit(X70)))
    snapshots = of("options").select(
        F.col("subject").alias("asset"), F.explode(expiries).alias("expiry"), "raw_id", F.when(equity, "yahoo").otherwise("deribit").alias("venue"),
        "received_ms", late(30).alias("source_ms"), F.lit(950.0).alias("forward"), "value")
    n = F.col("n")
    # 25 brands: the list of strikes each snapshot quotes.
    strikes_ = table(spark, d, "part").select(F.expr("substr(p_brand, 7)").cast("int").alias("n")).distinct().select(
        "n", F.explode(F.array(F.lit("BTC"), F.lit("TSLA"))).alias("asset"))
    mid = F.greatest(F.lit(0), 1000 - (896 + n * 4)) * (0.3 + v / 400) + 5
    contracts = snapshots.join(strikes_, "asset").select(
        F.col("raw_id").alias("id"), "expiry", n.alias("pos"), (n * 4 + 896.0).alias("strike"), (mid - 0.5).alias("bid"),
        F.when(n % 6 > 0, mid + 0.5).alias("ask"), mid.alias("mark"), F.when(n % 7 > 0, 0.2 + n / F.lit(100.0)).alias("iv"))
    return books, catalog, spots, snapshots, contracts, histories


view("w_trig", """SELECT t.raw_id, t.now_ms, t.kind, p.* FROM tape t JOIN props p ON CASE t.kind WHEN 'pm' THEN p.yes_token = t.subject
  WHEN 'catalog' THEN true ELSE p.asset = t.subject END""")
view("w_pm", f"""
SELECT *, CASE WHEN fb THEN c_yes ELSE b_yes END AS pm_yes, CASE WHEN fb THEN NULL ELSE b_bid END AS pm_bid, CASE WHEN fb THEN NULL ELSE b_ask END AS pm_ask,
  CASE WHEN fb THEN false ELSE coalesce(b_crossed, false) END AS pm_crossed, CASE WHEN fb THEN c_ms ELSE b_ms END AS pm_timestamp, CASE WHEN fb THEN c_ref ELSE b_ref END AS pm_ref,
  CASE WHEN fb THEN 'gamma_indicative' WHEN b_ref IS NOT NULL THEN 'clob_mid' END AS pm_source FROM (
 SELECT t.*, b.yes AS b_yes, b.bid AS b_bid, b.ask AS b_ask, b.crossed AS b_crossed, b.source_ms AS b_ms, b.raw_id AS b_ref, c.pm_indicative AS c_yes, c.received_ms AS c_ms, c.raw_id AS c_ref,
  (b.raw_id IS NULL OR t.now_ms - b.source_ms > {90_000 * SCALE}) AND c.pm_indicative IS NOT NULL AS fb
 FROM w_trig t ASOF LEFT JOIN w_books b ON t.yes_token = b.yes_token AND t.raw_id >= b.raw_id ASOF LEFT JOIN w_catalog c ON t.event_id = c.event_id AND t.raw_id >= c.raw_id)""")
view("w_seen", "SELECT asset, expiry, min(raw_id) AS first_seen FROM w_snapshots GROUP BY 1, 2")
view("w_cover", """
SELECT p.*, (SELECT min(s.expiry) FROM w_seen s WHERE s.asset = p.asset AND s.expiry >= p.expiry AND s.first_seen <= p.raw_id) AS opt_expiry FROM w_pm p""")
view("w_all", """
SELECT c.*, s.raw_id AS options_ref, s.venue AS opt_venue, s.received_ms AS options_received_ms, s.source_ms AS opt_timestamp,
  x.price AS spot, x.source_ms AS spot_timestamp, x.venue AS spot_venue, x.market_state, x.raw_id AS spot_ref,
  h.low, h.high, h.error, h.received_ms AS h_ms, h.raw_id AS history_ref, coalesce(s.venue = 'yahoo' AND x.market_state = 'CLOSED', false) AS closed
FROM w_cover c ASOF LEFT JOIN w_snapshots s ON c.asset = s.asset AND c.opt_expiry = s.expiry AND c.raw_id >= s.raw_id
 ASOF LEFT JOIN w_spots x ON c.asset = x.asset AND c.raw_id >= x.raw_id
 ASOF LEFT JOIN w_histories h ON c.asset = h.asset AND c.window_start = h.window_start AND c.raw_id >= h.raw_id""")


def assembled(spark, d):
    books, catalog, spots, snapshots, contracts, histories = legs_of(spark, d)
    triggers = tape(spark, d).filter("kind = 'catalog'").select("raw_id", "now_ms", "kind", "subject")
    return propositions(spark, d), books, catalog, spots, snapshots, contracts, histories, triggers


def without_contracts(spark, d):
    """The same legs for queries that read no strikes: which surface covers does not depend on its contracts."""
    events, books, catalog, spots, snapshots, _, histories, triggers = assembled(spark, d)
    return events, books, catalog, spots, snapshots, None, histories, triggers


@query("pm_leg", "SELECT raw_id, event_id, pm_source, pm_ref, pm_timestamp, pm_crossed, round(pm_yes, 6) + 0.0 AS pm_yes FROM w_pm")
def pm_leg(spark, d):
    rows = O.assemble_legs(*without_contracts(spark, d), config=CONFIG, slice_rows=SLICE_ROWS)
    return rows.select("raw_id", "event_id", "pm_source", "pm_ref", "pm_timestamp", "pm_crossed", r6(F.col("pm_yes")).alias("pm_yes"))


@query("covering_surface", "SELECT raw_id, event_id, opt_expiry, options_ref, opt_venue, opt_timestamp FROM w_all")
def covering_surface(spark, d):
    rows = O.assemble_legs(*without_contracts(spark, d), config=CONFIG, slice_rows=SLICE_ROWS)
    return rows.select("raw_id", "event_id", "opt_expiry", "options_ref", "opt_venue", "opt_timestamp")


view("w_points", "SELECT s.raw_id AS options_ref, min(s.expiry) AS opt_expiry, p.event_id, p.strike_or_threshold AS k FROM w_snapshots s JOIN props p ON p.asset = s.asset AND s.expiry >= p.expiry GROUP BY 1, 3, 4")
view("w_bracket", """
SELECT p.options_ref, p.opt_expiry, p.event_id, p.k,
  arg_max({'s': c.strike, 'b': c.bid, 'a': c.ask, 'm': c.mark}, c.strike) FILTER (WHERE c.strike < p.k) AS lo,
  arg_min({'s': c.strike, 'b': c.bid, 'a': c.ask, 'm': c.mark}, c.strike) FILTER (WHERE c.strike > p.k) AS hi
FROM w_points p JOIN w_contracts c ON c.id = p.options_ref AND c.expiry = p.opt_expiry GROUP BY ALL""")
view("w_near", """
SELECT options_ref, opt_expiry, event_id, sum(iv * w) / sum(w) AS iv, arg_min(iv, dist * 1000 + rk) AS local_iv, count(*) AS n,
  CASE WHEN count(*) > 1 AND max(strike) > min(strike) THEN (arg_max(iv, strike) - arg_min(iv, strike)) / ln(max(strike) / min(strike)) END AS skew
FROM (SELECT *, 1 / greatest(1, dist) AS w, row_number() OVER (PARTITION BY options_ref, opt_expiry, event_id ORDER BY dist, pos) AS rk FROM (
  SELECT p.*, c.strike, c.pos, c.iv, abs(c.strike - p.k) AS dist FROM w_points p JOIN w_contracts c ON c.id = p.options_ref AND c.expiry = p.opt_expiry WHERE c.iv > 0.0001 AND c.iv < 5))
WHERE rk <= 3 GROUP BY ALL""")


def _mid(c):
    return f"CASE WHEN {c}.b IS NOT NULL AND {c}.a IS NOT NULL THEN CASE WHEN {c}.b >= 0 AND {c}.b <= {c}.a THEN ({c}.b + {c}.a) / 2 END WHEN {c}.m >= 0 THEN {c}.m END"


view("w_spread", f"""
SELECT *, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN l IS NULL OR h IS NULL THEN 'MISSING_OR_CROSSED_OPTION_QUOTES'
    WHEN NOT ((l - h) / width BETWEEN 0 AND 1) THEN 'INVALID_CALL_SPREAD' END END AS err, CASE WHEN (l - h) / width BETWEEN 0 AND 1 THEN (l - h) / width END AS q
FROM (SELECT *, {_mid('lo')} AS l, {_mid('hi')} AS h, hi.s - lo.s AS width, (hi.s + lo.s) / 2 AS center,
  lo.b IS NOT NULL AND lo.a IS NOT NULL AND hi.b IS NOT NULL AND hi.a IS NOT NULL AS complete FROM w_bracket)""")


def _neighborhood(spark, d):
    events, _, _, _, snapshots, contracts, _, _ = assembled(spark, d)
    rows = O.surface_rows(snapshots, contracts, events).filter("surface IS NOT NULL")
    return rows.select(F.col("surface.ref").alias("options_ref"), F.col("surface.expiry").alias("opt_expiry"), "event_id",
                       "surface.below", "surface.above", "surface.near")


_POINT = "options_ref, opt_expiry, event_id"


@query("finite_spread", f"SELECT {_POINT}, err AS error, round(q, 6) + 0.0 AS probability, width, complete FROM w_spread")
def finite_spread(spark, d):
    s = SF.finite_spread(F.col("below"), F.col("above"))
    return _neighborhood(spark, d).select(*_POINT.split(", "), s["error"].alias("error"), r6(s["probability"]).alias("probability"),
                                          s["width"].alias("width"), s["complete"].alias("complete"))


@query("local_iv", f"SELECT {_POINT}, round(iv, 6) + 0.0 AS iv, round(local_iv, 6) + 0.0 AS local_iv FROM w_near")
def local_iv(spark, d):
    return _neighborhood(spark, d).select(*_POINT.split(", "), r6(SF.local_iv(F.col("near"))).alias("iv"), r6(SF.nearest_iv(F.col("near"))).alias("local_iv"))


@query("iv_skew", f"SELECT {_POINT}, round(skew, 5) + 0.0 AS skew FROM w_near")
def iv_skew(spark, d):
    return _neighborhood(spark, d).select(*_POINT.split(", "), r6(SF.iv_skew(F.col("near")), 5).alias("skew"))


_AGE = lambda at, limit: f"coalesce(a.now_ms - {at} BETWEEN 0 AND {limit}, false)"
_OPT_LIMIT = f"CASE opt_venue WHEN 'yahoo' THEN {120_000 * SCALE} ELSE {45_000 * SCALE} END"
view("w_gate", f"""
SELECT a.*, CASE WHEN mapping_review = 'MISMATCH' THEN 'MISMATCH:OPERATOR_REJECTED_MAPPING' WHEN expiry <= now_ms THEN 'ENDED:EVENT_CUTOFF_PASSED'
  WHEN pm_crossed THEN 'BAD_QUOTE:CROSSED_PM_BOOK' WHEN coalesce(pm_yes BETWEEN 0 AND 1, false) = false THEN 'WAIT:MISSING_PM'
  WHEN NOT {_AGE('pm_timestamp', f"CASE pm_source WHEN 'gamma_indicative' THEN {240_000 * SCALE} ELSE {90_000 * SCALE} END")} THEN 'STALE:PM_AGE_LIMIT'
  WHEN options_ref IS NULL THEN 'WAIT:MISSING_OPTIONS'
  WHEN NOT {_AGE('options_received_ms', _OPT_LIMIT)} OR NOT {_AGE('opt_timestamp', _OPT_LIMIT)} THEN 'STALE:OPTIONS_AGE_LIMIT'
  WHEN NOT (opt_expiry - expiry BETWEEN 0 AND 259200000) THEN 'CUTOFF:OPTION_EXPIRY_DOES_NOT_COVER_EVENT'
  WHEN spot IS NULL OR spot <= 0 THEN 'WAIT:MISSING_SPOT'
  WHEN NOT {_AGE('spot_timestamp', f"CASE spot_venue WHEN 'yahoo' THEN {120_000 * SCALE} ELSE {30_000 * SCALE} END")} AND NOT closed THEN 'STALE:SPOT_AGE_LIMIT' END AS gate
FROM w_all a""")
view("w_model", f"""
SELECT *, CASE WHEN gate IS NOT NULL THEN NULL WHEN digital THEN CASE WHEN err IS NOT NULL THEN 'BAD_QUOTE:' || err END WHEN iv IS NULL THEN 'WAIT:MISSING_IMPLIED_VOLATILITY'
  WHEN event_type = 'touch' AND (window_start IS NULL OR window_start > now_ms) THEN 'HISTORY:UNKNOWN_OR_FUTURE_PATH_WINDOW'
  WHEN event_type = 'touch' AND (history_ref IS NULL OR error OR now_ms - h_ms > {360_000 * SCALE}) THEN 'HISTORY:MISSING_COMPLETE_CURRENT_PATH'
  WHEN event_type = 'touch' AND CASE direction WHEN 'up' THEN high >= strike_or_threshold ELSE low <= strike_or_threshold END
    THEN 'VERIFY_HIT:REFERENCE_HISTORY_CROSSED_BARRIER_CHECK_RULES' END AS model,
  (expiry - now_ms) / 31536000000.0::DOUBLE AS years FROM (
 SELECT g.*, s.err, s.q AS dq, s.width, s.center, s.complete, n.iv, g.opt_expiry - g.expiry AS off, coalesce(g.opt_expiry = g.expiry AND g.event_type = 'terminal' AND s.lo IS NOT NULL AND s.hi IS NOT NULL, false) AS digital
 FROM w_gate g LEFT JOIN w_spread s ON s.options_ref = g.options_ref AND s.opt_expiry = g.opt_expiry AND s.event_id = g.event_id
 LEFT JOIN w_near n ON n.options_ref = g.options_ref AND n.opt_expiry = g.opt_expiry AND n.event_id = g.event_id)""")
view("w_terms", """
SELECT *, CASE direction WHEN 'up' THEN 1 ELSE -1 END * (ln(spot / strike_or_threshold) - iv * iv * years / 2) / (iv * sqrt(years)) AS d2,
  (-dist - drift * years) / (iv * sqrt(years)) AS ta, (-dist + drift * years) / (iv * sqrt(years)) AS tb, -2 * drift * dist / (iv * iv) AS tx,
  (direction = 'up' AND spot >= strike_or_threshold) OR (direction = 'down' AND spot <= strike_or_threshold) AS beyond
FROM (SELECT *, abs(ln(strike_or_threshold / spot)) AS dist, iv * iv / 2 * CASE direction WHEN 'up' THEN 1 ELSE -1 END AS drift FROM w_model WHERE gate IS NULL AND model IS NULL)""")
view("w_q", f"""
SELECT raw_id, event_id, CASE WHEN digital THEN CASE direction WHEN 'up' THEN dq ELSE 1 - dq END WHEN event_type = 'touch' THEN
   CASE WHEN beyond THEN 1.0 WHEN tx <= 700 THEN least(1.0, greatest(0.0, {ncdf('ta')} + exp(tx) * {ncdf('tb')})) END ELSE {ncdf('d2')} END AS q FROM w_terms""")
view("w_obs", """
SELECT m.*, w.q, gate IS NULL AND model IS NULL AS priced, CASE WHEN gate IS NULL AND NOT digital AND iv IS NOT NULL THEN true ELSE false END AS modeled
FROM w_model m LEFT JOIN w_q w ON w.raw_id = m.raw_id AND w.event_id = m.event_id""")
view("w_rows", f"""
SELECT *, coalesce(split_part(gate, ':', 1), split_part(model, ':', 1), CASE WHEN priced AND q IS NULL THEN 'MODEL_LIMIT' WHEN closed THEN 'CLOSED' WHEN quality_flags = '' THEN 'OK' ELSE 'PROXY' END) AS source_state
FROM (SELECT *, concat_ws(',', split_part(gate, ':', 2),
  CASE WHEN gate IS NULL AND mapping_review <> 'VERIFIED' THEN 'UNVERIFIED_SETTLEMENT_SEMANTICS' END,
  CASE WHEN gate IS NULL AND settlement_source IS NOT NULL AND lower(settlement_source) <> spot_venue THEN 'REFERENCE_SOURCE_PROXY' END,
  CASE WHEN gate IS NULL AND opt_venue = 'yahoo' THEN '{','.join(O.EQUITY_FLAGS)}' END,
  CASE WHEN gate IS NULL AND closed THEN 'MARKET_CLOSED_LAST_SESSION_PRICES' END,
  CASE WHEN gate IS NULL AND pm_source = 'gamma_indicative' THEN 'INDICATIVE_PM_TIMESTAMP_IS_RETRIEVAL' END,
  CASE WHEN gate IS NULL AND coalesce(pm_ask, 0) - coalesce(pm_bid, 0) > 0.1 THEN 'WIDE_PM_BOOK' END,
  CASE WHEN digital AND model IS NOT NULL THEN split_part(model, ':', 2) END,
  CASE WHEN digital AND priced THEN 'FINITE_SPREAD_REPLICATION_ERROR' END,
  CASE WHEN digital AND priced AND width / spot > 0.05 THEN 'SPARSE_STRIKES' END,
  CASE WHEN digital AND priced AND abs(center - strike_or_threshold) > width * 0.01 THEN 'ASYMMETRIC_STRIKE_BRACKET' END,
  CASE WHEN modeled THEN 'FLAT_IV_MODEL' END, CASE WHEN NOT digital AND model IS NOT NULL THEN split_part(model, ':', 2) END,
  CASE WHEN priced AND NOT digital AND event_type = 'touch' THEN 'PATH_HISTORY_REFERENCE_PROXY' END,
  CASE WHEN priced AND NOT digital AND off <> 0 THEN 'EXPIRY_IV_PROXY' END,
  CASE WHEN priced AND q IS NULL THEN 'INVALID_TRANSFORM' END,
  CASE WHEN priced AND (q < 0.01 OR q > 0.99) THEN 'EXTREME_TAIL_MODEL_SENSITIVITY' END,
  CASE WHEN priced AND q IN (0, 1) THEN 'MODEL_ENDPOINT' END) AS quality_flags FROM w_obs)""")


def full_observations(spark, d):
    return O.observe(*assembled(spark, d), config=CONFIG, slice_rows=SLICE_ROWS)


def stored_observations(spark, d, *columns):
    """Columns of the observations as stored facts; conditions on them then act on columns, not on the pricing expressions."""
    return stage_table(full_observations(spark, d).select(*columns), "observations")


@query("observe", """SELECT raw_id, event_id, kind, source_state, quality_flags,
  CASE WHEN digital AND priced THEN CASE WHEN complete THEN 'SPREAD' ELSE 'MID' END WHEN modeled THEN CASE event_type WHEN 'touch' THEN 'TOUCH' ELSE 'IV' END END AS method,
  CASE WHEN priced AND (q < 0.01 OR q > 0.99) THEN 'LOW' WHEN digital AND priced THEN 'MEDIUM' WHEN modeled THEN 'LOW' ELSE 'UNAVAILABLE' END AS model_confidence,
  round(pm_yes, 6) + 0.0 AS pm_yes, round(q, 6) + 0.0 AS opt_yes, round(CASE WHEN pm_yes BETWEEN 0 AND 1 THEN (pm_yes - q) * 100 END, 5) + 0.0 AS gap_pp,
  concat_ws(',', 'catalog=' || c_ref, 'pm=' || pm_ref, 'options=' || options_ref, 'spot=' || spot_ref, 'history=' || history_ref) AS input_refs FROM w_rows""")
def observe(spark, d):
    """Every observation of the packet tape with state, flags, method, probability and provenance."""
    o = full_observations(spark, d)
    refs = F.array_join(F.transform(F.map_entries("input_refs"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return o.select("raw_id", "event_id", "kind", "source_state", F.concat_ws(",", "quality_flags").alias("quality_flags"), "method", "model_confidence",
                    r6(F.col("pm_yes")).alias("pm_yes"), r6(F.col("opt_yes")).alias("opt_yes"), r6(F.col("gap_pp"), 5).alias("gap_pp"), refs.alias("input_refs"))


@query("quality_gate", "SELECT event_id, source_state, count(*) AS n FROM w_rows GROUP BY ALL")
def quality_gate(spark, d):
    """How often each proposition is usable, and why not."""
    return full_observations(spark, d).groupBy("event_id", "source_state").agg(F.count("*").alias("n"))


@query("quality_flags", "SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(quality_flags, ',')) AS flag FROM w_rows) GROUP BY flag")
def quality_flags(spark, d):
    return stored_observations(spark, d, "quality_flags").select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("implied_probability", """SELECT event_id, CASE WHEN digital THEN CASE WHEN complete THEN 'SPREAD' ELSE 'MID' END WHEN event_type = 'touch' THEN 'TOUCH' ELSE 'IV' END AS method,
  count(*) AS n, round(avg(q), 6) + 0.0 AS mean_opt, round(min(q), 6) + 0.0 AS min_opt, round(max(q), 6) + 0.0 AS max_opt FROM w_rows WHERE q IS NOT NULL GROUP BY 1, 2""")
def implied_probability(spark, d):
    o = stored_observations(spark, d, "event_id", "method", "opt_yes").filter("opt_yes IS NOT NULL")
    return o.groupBy("event_id", "method").agg(
        F.count("*").alias("n"), r6(F.avg("opt_yes")).alias("mean_opt"), r6(F.min("opt_yes")).alias("min_opt"), r6(F.max("opt_yes")).alias("max_opt"))
