"""Registered queries: tape questions and ledger analytics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PolicyConfig
from ..functions.costs import trade_costs
from ..operators import episodes, history
from ..operators import ledger as L
from ..session import stage_table
from .fixtures import CONFIG, DAY, SCALE, SLICE_ROWS, START, observations, r6, table, ticks
from .q_dynamics import _revisions, strikes
from .registry import query, view

_OBS = 'event_id, raw_id, now_ms, source_state, round(gap_pp, 6) + 0.0 AS gap_pp'


def _obs_columns(df):
    return df.select("event_id", "raw_id", "now_ms", "source_state", r6(F.col("gap_pp")).alias("gap_pp"))


# -------------------------------------------------------------- tape queries ---------
@query("history", f"SELECT {_OBS} FROM (SELECT * FROM obs WHERE event_id = 'm3' AND now_ms BETWEEN {START + 5 * DAY} AND {START + 25 * DAY} AND raw_id > 2000 ORDER BY raw_id LIMIT 500)")
def history_page(spark, d):
    """One forward page of 500 rows, the page size of the API."""
    return _obs_columns(history.history(observations(spark, d), "m3", START + 5 * DAY, START + 25 * DAY, 500, after=2000))


@query("history_tail", f"SELECT {_OBS} FROM (SELECT * FROM obs WHERE raw_id < 9000 ORDER BY raw_id DESC LIMIT 300)")
def history_tail(spark, d):
    return _obs_columns(history.history(observations(spark, d), limit=300, before=9000, tail=True))


@query("latest_by", f"SELECT {_OBS}, mapping_hash FROM obs QUALIFY row_number() OVER (PARTITION BY event_id, mapping_hash ORDER BY raw_id DESC) = 1")
def latest_by(spark, d):
    o = history.latest_by(observations(spark, d), ["event_id", "mapping_hash"])
    return o.select("event_id", "raw_id", "now_ms", "source_state", r6(F.col("gap_pp")).alias("gap_pp"), "mapping_hash")


@query("tape_stats", """SELECT 'raw' AS "table", count(*) AS rows, min(received_ms) AS first_ms, max(received_ms) AS last_ms FROM ticks
 UNION ALL SELECT 'observations', count(*), min(now_ms), max(now_ms) FROM obs WHERE valid""")
def tape_stats(spark, d):
    return history.tape_stats(raw=ticks(spark, d), observations=observations(spark, d).filter("valid").withColumnRenamed("now_ms", "received_ms"))


@query("episode_slice", f"""SELECT {', '.join('o.' + c if i < 4 else 'round(o.gap_pp, 6) + 0.0 AS gap_pp' for i, c in enumerate(['event_id', 'raw_id', 'now_ms', 'source_state', 'gap']))}, gap_event_id
 FROM obs o JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gap_event_id ORDER BY raw_id DESC) AS newest FROM ep_all) WHERE newest = 1 AND close_reason = 'REVERSAL'
   ORDER BY duration_ms DESC, gap_event_id LIMIT 1) e ON o.event_id = e.event_id AND o.now_ms BETWEEN e.opened_at AND coalesce(e.closing_time, 9223372036854775807)""")
def episode_slice(spark, d):
    """All rows of the longest episode that ended in a reversal."""
    obs = stage_table(observations(spark, d), "observations")
    rev = episodes.episode_revisions(stage_table(episodes.gap_episodes(obs, CONFIG, SLICE_ROWS), "episodes"), SLICE_ROWS)
    one = episodes.episode_summary(rev).filter("close_reason = 'REVERSAL'").orderBy(F.col("duration_ms").desc(), "gap_event_id").limit(1)
    return history.episode_slice(obs, one).select("event_id", "raw_id", "now_ms", "source_state", r6(F.col("gap_pp")).alias("gap_pp"), "gap_event_id")


view("altered", "SELECT *, CASE WHEN trigger_kind = 'pm' AND spot > 150 THEN gap_pp + 1 ELSE gap_pp END AS gap2, CASE WHEN trigger_kind = 'opt' AND spot > 180 THEN 'OK' ELSE source_state END AS state2 FROM obs")


def _compared(spark, d):
    """Stored observations of two versions, some of them altered, against their recomputation."""
    fresh = observations(spark, d).withColumns({
        "version": F.concat(F.lit("1."), F.col("raw_id") % 2, F.lit(".0")), "input_refs": F.create_map(F.lit("pm"), F.col("raw_id"), F.lit("spot"), F.col("raw_id") - 1)})
    wide = lambda kind, level: (F.col("trigger_kind") == kind) & (F.col("spot") > level)
    stored = stage_table(fresh.withColumn("gap_pp", F.when(wide("pm", 150), F.col("gap_pp") + 1).otherwise(F.col("gap_pp"))).withColumn(
        "source_state", F.when(wide("opt", 180), "OK").otherwise(F.col("source_state"))).withColumn(
        "input_refs", F.when(F.col("raw_id") % 9 == 0, F.create_map(F.lit("spot"), F.col("raw_id") - 1, F.lit("pm"), F.col("raw_id") + F.when(F.col("raw_id") % 27 == 0, 1).otherwise(0)))
        .otherwise(F.col("input_refs"))), "stored")
    return history.verify_recompute(stored, fresh, ["raw_id", "event_id"], ["source_state", "pm_yes", "opt_yes", "gap_pp", "side", "input_refs"], ["version"])


_FIELDS = "concat_ws(',', CASE WHEN state2 IS DISTINCT FROM source_state THEN 'source_state' END, CASE WHEN gap2 IS DISTINCT FROM gap_pp THEN 'gap_pp' END, CASE WHEN raw_id % 27 = 0 THEN 'input_refs' END)"


@query("verify_recompute", f"""SELECT '1.' || (raw_id % 2) || '.0' AS version, count(*) AS checked, count(*) FILTER (WHERE {_FIELDS} <> '') AS mismatches,
  count(*) FILTER (WHERE {_FIELDS} <> '') = 0 AS ok FROM altered GROUP BY 1""")
def verify_recompute(spark, d):
    return history.verification_report(_compared(spark, d), F.col("version"))


@query("first_mismatches", f"SELECT raw_id, event_id, {_FIELDS} AS fields FROM altered WHERE {_FIELDS} <> '' ORDER BY raw_id LIMIT 20")
def first_mismatches(spark, d):
    return history.first_mismatches(_compared(spark, d), ["raw_id", "event_id"]).withColumn("fields", F.concat_ws(",", "fields")).drop("version")


@query("state_snapshot", f"SELECT {_OBS} FROM obs WHERE now_ms <= {START + 12 * DAY} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY raw_id DESC) = 1")
def state_snapshot(spark, d):
    return _obs_columns(history.state_snapshot(observations(spark, d), START + 12 * DAY))


view("board", """SELECT 'e' || p_partkey AS event_id, CASE p_size % 3 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' ELSE 'TSLA' END AS asset, p_name AS event_text,
 CASE WHEN p_size % 2 = 0 THEN 'touch' ELSE 'terminal' END AS event_type, p_retailprice AS strike_or_threshold, CAST(p_size AS BIGINT) AS expiry,
 CASE WHEN p_size % 5 > 0 THEN (p_size - 25) / CAST(4 AS DOUBLE) END AS gap_pp FROM part""")


def board(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        F.concat(F.lit("e"), "p_partkey").alias("event_id"), F.when(size % 3 == 0, "BTC").when(size % 3 == 1, "ETH").otherwise("TSLA").alias("asset"),
        F.col("p_name").alias("event_text"), F.when(size % 2 == 0, "touch").otherwise("terminal").alias("event_type"),
        F.col("p_retailprice").alias("strike_or_threshold"), size.cast("bigint").alias("expiry"), F.when(size % 5 > 0, (size - 25) / F.lit(4.0)).alias("gap_pp"),
        F.lit(None).cast("double").alias("relative_gap"), F.array().cast("array<string>").alias("quality_flags"))


@query("monitor_view", """SELECT event_id, asset, event_type, expiry, gap_pp, coalesce(abs(gap_pp) >= 4, false) AS highlight FROM board WHERE asset IN ('BTC', 'ETH') AND event_type = 'touch'
  AND lower(concat_ws(' ', asset, event_text, event_id)) LIKE '%red%' ORDER BY gap_pp IS NULL, abs(coalesce(gap_pp, 0)) DESC, event_id LIMIT 25 OFFSET 25""")
def monitor_view(spark, d):
    """Second monitor page of crypto touch events whose text mentions a word."""
    return history.monitor_view(board(spark, d), "crypto", "touch", "red", "gap", page=1, size=25).select(
        "event_id", "asset", "event_type", "expiry", "gap_pp", "highlight")


@query("strike_selector", "SELECT count(*) AS matches, min(event_id) AS event_id, count(*) > 1 AS ambiguous FROM board WHERE asset = 'ETH' AND strike_or_threshold = 950")
def strike_selector(spark, d):
    return history.strike_selector(board(spark, d), F.lit("eth-950"))


# -------------------------------------------------------------------- fills ----------
view("fill_rows", """
SELECT ((((date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 200000 + l_orderkey) * 8 + l_linenumber) * 100000 + l_partkey) * 2000 + l_suppkey) AS ledger_id,
  'r' || (o_custkey % 8) AS run_id, 'w' || (o_custkey % 4) AS wallet_id, 'i' || (l_partkey % 50) AS instrument, l_partkey % 50 AS ino, l_linenumber, l_quantity, o_orderpriority AS reason,
  epoch_us(l_shipdate) // 1000 + l_linenumber * 1000 AS ts, l_extendedprice / l_quantity AS price, abs(l_discount) / 20 AS half, abs(l_tax) * 10 AS fees
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")


def fill_rows(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("bigint")
    ledger = (((day * 200_000 + F.col("l_orderkey")) * 8 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 2_000 + F.col("l_suppkey")
    c = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return j.select(
        ledger.alias("ledger_id"), c("r", F.col("o_custkey") % 8).alias("run_id"), c("w", F.col("o_custkey") % 4).alias("wallet_id"),
        c("i", F.col("l_partkey") % 50).alias("instrument"), (F.col("l_partkey") % 50).alias("ino"), "l_linenumber", "l_quantity", F.col("o_orderpriority").alias("reason"),
        (F.unix_millis(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 1000).alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.abs("l_discount") / 20).alias("half"), (F.abs("l_tax") * 10).alias("fees"))


def _priced(f):
    """Quotes, slippage and cash of a fill row with side, quantity and multiplier."""
    units, slip = F.col("quantity") * F.col("multiplier"), F.col("price") / 1000
    f = f.withColumns({"bid": F.col("price") * (1 - F.col("half")), "ask": F.col("price") * (1 + F.col("half")), "slippage": slip * units})
    gross = F.when(F.col("side") == "BUY", F.col("ask") + slip).otherwise(F.col("bid") - slip) * units
    f = f.withColumn("gross_premium", gross)
    return f.withColumns({
        "total_debit": F.when(F.col("side") == "BUY", F.col("gross_premium") + F.col("fees")),
        "net_credit": F.when(F.col("side") == "SELL", F.col("gross_premium") - F.col("fees"))})


_PRICED = """SELECT *, price * (1 - half) AS bid, price * (1 + half) AS ask, price / 1000 * (quantity * multiplier) AS slippage,
  CASE side WHEN 'BUY' THEN price * (1 + half) + price / 1000 ELSE price * (1 - half) - price / 1000 END * (quantity * multiplier) AS gross_premium FROM """
view("fills", f"""SELECT *, CASE side WHEN 'BUY' THEN gross_premium + fees END AS total_debit, CASE side WHEN 'SELL' THEN gross_premium - fees END AS net_credit FROM ({_PRICED} (
  SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS side, l_quantity AS quantity, CASE WHEN ino % 2 = 0 THEN 100 ELSE 1 END AS multiplier FROM fill_rows))""")


def raw_fills(spark, d):
    """Fills with sides by line parity: partial closes and sales without an entry."""
    f = fill_rows(spark, d).withColumns({
        "side": F.when(F.col("l_linenumber") % 2 == 1, "BUY").otherwise("SELL"), "quantity": F.col("l_quantity"),
        "multiplier": F.when(F.col("ino") % 2 == 0, 100).otherwise(1)})
    return _priced(f).withColumns({"timestamp_ms": F.col("ts"), "submit_ms": F.col("ts") - 1000, "realized_pnl": F.col("net_credit") / 20,
                                   "flat_after": F.lit(True)})


@query("closed_lot_attribution", """WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, instrument ORDER BY ledger_id) AS n FROM fills),
 walk AS (
  SELECT run_id, instrument, n, ledger_id, side, CASE WHEN side = 'SELL' THEN 'missing_entry' END AS status, CASE WHEN side = 'BUY' THEN quantity ELSE 0 END AS q,
    CASE WHEN side = 'BUY' THEN (quantity * multiplier) * ((bid + ask) / 2) ELSE 0 END AS m, CASE WHEN side = 'BUY' THEN total_debit ELSE 0 END AS dbt, CAST(NULL AS DOUBLE) AS mid_move, CAST(NULL AS DOUBLE) AS invested FROM ranked WHERE n = 1
  UNION ALL
  SELECT run_id, instrument, n, ledger_id, side, status, CASE WHEN nq < 1e-9 THEN 0 ELSE nq END, CASE WHEN nq < 1e-9 THEN 0 ELSE nm END, CASE WHEN nq < 1e-9 THEN 0 ELSE nd END, mid_move, invested FROM (
   SELECT r.run_id, r.instrument, r.n, r.ledger_id, r.side, CASE WHEN r.side = 'SELL' THEN CASE WHEN w.q < r.quantity - 1e-9 OR w.q = 0 THEN 'missing_entry' ELSE 'unreconciled' END END AS status,
    CASE WHEN r.side = 'BUY' THEN w.q + r.quantity WHEN w.q < r.quantity - 1e-9 OR w.q = 0 THEN w.q ELSE w.q * (1 - least(1, r.quantity / w.q)) END AS nq,
    CASE WHEN r.side = 'BUY' THEN w.m + (r.quantity * r.multiplier) * ((r.bid + r.ask) / 2) WHEN w.q < r.quantity - 1e-9 OR w.q = 0 THEN w.m ELSE w.m * (1 - least(1, r.quantity / w.q)) END AS nm,
    CASE WHEN r.side = 'BUY' THEN w.dbt + r.total_debit WHEN w.q < r.quantity - 1e-9 OR w.q = 0 THEN w.dbt ELSE w.dbt * (1 - least(1, r.quantity / w.q)) END AS nd,
    CASE WHEN r.side = 'SELL' AND w.q >= r.quantity - 1e-9 AND w.q > 0 THEN (r.quantity * r.multiplier) * ((r.bid + r.ask) / 2) - w.m * least(1, r.quantity / w.q) END AS mid_move,
    CASE WHEN r.side = 'SELL' AND w.q >= r.quantity - 1e-9 AND w.q > 0 THEN w.dbt * least(1, r.quantity / w.q) END AS invested
   FROM walk w JOIN ranked r ON r.run_id = w.run_id AND r.instrument = w.instrument AND r.n = w.n + 1))
 SELECT run_id, instrument, ledger_id, status, round(mid_move + 0.00001, 3) + 0.0 AS mid_move_pnl, round(invested + 0.00001, 3) + 0.0 AS invested FROM walk WHERE side = 'SELL'""")
def closed_lot_attribution(spark, d):
    """Every sale against its average-cost lot, with partial closes and missing entries."""
    c = L.closed_lot_attribution(raw_fills(spark, d))
    # The tiny shift keeps sums that end on half a thousandth off the rounding border.
    return c.select("run_id", "instrument", "ledger_id", "status", r6(F.col("mid_move_pnl") + 0.00001, 3).alias("mid_move_pnl"), r6(F.col("invested") + 0.00001, 3).alias("invested"))


# Round trips: every second fill of a (run, instrument) sells what the previous one bought.
view("trip_rows", f"""SELECT *, CASE side WHEN 'BUY' THEN gross_premium + fees END AS total_debit, CASE side WHEN 'SELL' THEN gross_premium - fees END AS net_credit FROM ({_PRICED} (
  SELECT *, CASE WHEN n % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN n % 2 = 1 THEN l_quantity ELSE lag(l_quantity) OVER k END AS quantity, CASE WHEN ino % 2 = 0 THEN 100 ELSE 1 END AS multiplier
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, instrument ORDER BY ledger_id) AS n FROM fill_rows) WINDOW k AS (PARTITION BY run_id, instrument ORDER BY ledger_id)))""")
view("trips", """SELECT *, CASE side WHEN 'SELL' THEN net_credit - lag(total_debit) OVER k END AS realized_pnl FROM trip_rows WINDOW k AS (PARTITION BY run_id, instrument ORDER BY ledger_id)""")
view("closes", """SELECT *, price * quantity * multiplier - lag(price * quantity * multiplier) OVER k AS mid_move, half * price * quantity * multiplier + lag(half * price * quantity * multiplier) OVER k AS spread_cost,
  fees + lag(fees) OVER k AS all_fees, slippage + lag(slippage) OVER k AS all_slip, ts - lag(ts) OVER k AS held_ms FROM trips WINDOW k AS (PARTITION BY run_id, instrument ORDER BY ledger_id)
 QUALIFY side = 'SELL'""")


def round_trips(spark, d):
    k = Window.partitionBy("run_id", "instrument").orderBy("ledger_id")
    f = fill_rows(spark, d).withColumn("n", F.row_number().over(k))
    buy = F.col("n") % 2 == 1
    f = f.withColumns({"side": F.when(buy, "BUY").otherwise("SELL"), "quantity": F.when(buy, F.col("l_quantity")).otherwise(F.lag("l_quantity").over(k)),
                       "multiplier": F.when(F.col("ino") % 2 == 0, 100).otherwise(1)})
    f = _priced(f)
    pnl = F.when(F.col("side") == "SELL", F.col("net_credit") - F.lag("total_debit").over(k))
    return f.withColumns({"timestamp_ms": F.col("ts"), "submit_ms": F.col("ts") - 1000, "realized_pnl": pnl, "flat_after": F.lit(True)})


def _closes(spark, d):
    return L.closed_lot_attribution(round_trips(spark, d))


_MONEY = ("net_pnl", "mid_move_pnl", "spread_cost", "fees", "slippage", "long_hold_pnl")


# The sums beside the reconciled closes of each exit reason.
@query("attribution_summary", """SELECT s.* EXCLUDE (overall), exit_reasons FROM (SELECT grouping(wallet_id) AS overall,
  wallet_id, round(sum(realized_pnl), 1) + 0.0 AS net_pnl, round(sum(mid_move), 1) + 0.0 AS mid_move_pnl, round(sum(spread_cost), 1) + 0.0 AS spread_cost,
  round(sum(all_fees), 1) + 0.0 AS fees, round(sum(all_slip), 1) + 0.0 AS slippage, round(sum(CASE WHEN held_ms > 7200000 THEN realized_pnl ELSE 0 END), 1) + 0.0 AS long_hold_pnl,
  count(*) AS closes, CAST(0 AS BIGINT) AS unreconciled, count(*) FILTER (WHERE held_ms > 7200000) AS over_two_hours FROM closes GROUP BY ROLLUP (wallet_id)) s
 LEFT JOIN (SELECT overall, wallet_id, CAST(to_json(list({'exit_reason': reason, 'closes': n} ORDER BY reason NULLS FIRST)) AS VARCHAR) AS exit_reasons FROM (
   SELECT grouping(wallet_id) AS overall, wallet_id, reason, count(*) AS n FROM closes GROUP BY GROUPING SETS ((wallet_id, reason), (reason))) GROUP BY overall, wallet_id) r
  ON s.overall = r.overall AND s.wallet_id IS NOT DISTINCT FROM r.wallet_id""")
def attribution_summary(spark, d):
    s = L.attribution_summary(_closes(spark, d))
    reasons = F.to_json("exit_reasons", {"ignoreNullFields": "false"}).alias("exit_reasons")
    return s.select("wallet_id", *[r6(F.col(c), 1).alias(c) for c in _MONEY], "closes", "unreconciled", "over_two_hours", reasons)


@query("exit_reasons", "SELECT wallet_id, reason AS exit_reason, count(*) AS closes FROM closes GROUP BY ALL")
def exit_reasons(spark, d):
    return L.exit_reasons(_closes(spark, d))


@query("shared_entries", """SELECT a.wallet_id AS first_wallet, b.wallet_id AS second_wallet, count(*) AS shared_entries FROM
 (SELECT DISTINCT wallet_id, instrument, quantity, (ts - 1000) // 15000 AS bucket FROM fills WHERE side = 'BUY') a JOIN
 (SELECT DISTINCT wallet_id, instrument, quantity, (ts - 1000) // 15000 AS bucket FROM fills WHERE side = 'BUY') b USING (instrument, quantity, bucket)
 WHERE a.wallet_id < b.wallet_id GROUP BY ALL""")
def shared_entries(spark, d):
    return L.shared_entries(raw_fills(spark, d))


_BRAKE_AT = 978_307_200_000  # 2001-01-01


@query("loss_feedback", f"""SELECT wallet_id, run_id, count(*) AS recent, round(sum(realized_pnl), 1) + 0.0 AS recent_net_pnl, max(ledger_id) AS last_close_id,
  CASE WHEN losing THEN 0.5 ELSE 1.0 END::DOUBLE AS size_multiplier, {_BRAKE_AT} >= CASE WHEN losing THEN last_ms + 3600000 ELSE 0 END AS entry_allowed FROM (
 SELECT *, sum(CASE WHEN nn <= 3 AND realized_pnl < 0 THEN 1 ELSE 0 END) OVER g = 3 OR (count(*) OVER g = 5 AND sum(realized_pnl) OVER g < 0) AS losing, arg_max(ts, ledger_id) OVER g AS last_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY wallet_id, run_id ORDER BY ledger_id DESC) AS nn FROM closes WHERE ts <= {_BRAKE_AT}) WHERE nn <= 5 WINDOW g AS (PARTITION BY wallet_id, run_id)) GROUP BY ALL""")
def loss_feedback(spark, d):
    f = L.loss_feedback(_closes(spark, d), _BRAKE_AT)
    return f.select("wallet_id", "run_id", "recent", r6(F.col("recent_net_pnl"), 1).alias("recent_net_pnl"), "last_close_id", "size_multiplier", "entry_allowed")


@query("half_spread_cost", "SELECT run_id, round(sum((ask - bid) / 2 * quantity * multiplier), 1) + 0.0 AS spread_paid FROM fills GROUP BY run_id")
def half_spread_cost(spark, d):
    return L.half_spread_cost(raw_fills(spark, d)).withColumn("spread_paid", r6(F.col("spread_paid"), 1))


@query("ledger_history", "SELECT ledger_id, run_id, side, instrument FROM fills WHERE run_id = 'r3' ORDER BY ledger_id DESC LIMIT 1000")
def ledger_history(spark, d):
    return L.ledger_history(raw_fills(spark, d), "r3", 1000).select("ledger_id", "run_id", "side", "instrument")


_MARK_AT = 1_000_000_000_000
view("marks", f"SELECT 'i' || (p_partkey % 50) AS instrument, p_partkey AS mark_id, {_MARK_AT} - CAST(p_size AS BIGINT) * 2000 AS mark_ms, p_retailprice AS bid FROM part")


@query("wallet_metrics", f"""SELECT f.run_id, round(100000 + flow, 0) + 0.0 AS cash, round(realized, 0) + 0.0 AS realized_pnl, trades, closed_positions, winners, round(mv, 0) + 0.0 AS market_value, round(100000 + flow + mv, 0) + 0.0 AS equity,
  open_positions, stale_marks, round(winners / CAST(closed_positions AS DOUBLE), 6) + 0.0 AS win_rate, round(gp / gl, 5) + 0.0 AS profit_factor FROM (
 SELECT run_id, sum(CASE side WHEN 'BUY' THEN -total_debit ELSE net_credit END) AS flow, sum(CASE side WHEN 'SELL' THEN realized_pnl ELSE 0 END) AS realized, count(*) AS trades, count(*) FILTER (WHERE side = 'SELL') AS closed_positions,
  count(*) FILTER (WHERE side = 'SELL' AND realized_pnl > 0) AS winners, sum(CASE WHEN realized_pnl > 0 THEN realized_pnl ELSE 0 END) AS gp, -sum(CASE WHEN realized_pnl < 0 THEN realized_pnl ELSE 0 END) AS gl FROM trips GROUP BY run_id) f
 JOIN (SELECT run_id, sum(q * multiplier * m.bid) AS mv, count(*) AS open_positions, count(*) FILTER (WHERE {_MARK_AT} - m.mark_ms > 45000) AS stale_marks FROM (
   SELECT run_id, instrument, any_value(multiplier) AS multiplier, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) AS q FROM trips GROUP BY ALL HAVING q > 1e-9) p
  JOIN (SELECT * FROM marks QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY mark_ms DESC, mark_id DESC) = 1) m USING (instrument) GROUP BY run_id) v USING (run_id)
 UNION ALL SELECT 'r-new', 100000.0, 0.0, 0, 0, 0, 0.0, 100000.0, 0, 0, NULL, NULL""")
def wallet_metrics(spark, d):
    t = round_trips(spark, d)
    k = Window.partitionBy("run_id", "instrument").orderBy("ledger_id")
    t = t.withColumn("cost_delta", F.when(F.col("side") == "BUY", F.col("total_debit")).otherwise(-F.lag("total_debit").over(k)))
    marks = table(spark, d, "part").select(F.concat(F.lit("i"), F.col("p_partkey") % 50).alias("instrument"), F.col("p_partkey").alias("mark_id"),
                                           (F.lit(_MARK_AT) - F.col("p_size").cast("bigint") * 2000).alias("mark_ms"), F.col("p_retailprice").alias("bid"))
    m = L.wallet_metrics(t, marks, _MARK_AT, runs=t.select("run_id").union(spark.range(1).select(F.lit("r-new"))))
    return m.select("run_id", *[r6(F.col(c), 0).alias(c) for c in ("cash", "realized_pnl", "market_value", "equity")], "trades", "closed_positions", "winners",
                    "open_positions", "stale_marks", r6(F.col("win_rate")).alias("win_rate"), r6(F.col("profit_factor"), 5).alias("profit_factor"))


# ------------------------------------------------------------------- equity ----------
view("points", "SELECT o_orderkey AS id, 'r' || (o_custkey % 8) AS run_id, epoch_us(o_orderdate) // 1000 AS timestamp_ms, o_totalprice AS equity FROM orders")
view("runs", "SELECT 'r' || n AS run_id, 790000000000 + n * 10000000000 AS opened_at, CAST(100000 + n * 1000 AS DOUBLE) AS starting_balance FROM (SELECT DISTINCT o_custkey % 8 AS n FROM orders)")
_EQ_AT = 1_000_000_000_000


def equity_points(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("r"), F.col("o_custkey") % 8).alias("run_id"),
                                            F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp_ms"), F.col("o_totalprice").alias("equity"))


def runs(spark, d):
    n = F.col("n")
    return table(spark, d, "orders").select((F.col("o_custkey") % 8).alias("n")).distinct().select(
        F.concat(F.lit("r"), n).alias("run_id"), (F.lit(790_000_000_000) + n * 10_000_000_000).alias("opened_at"), (n * 1000 + 100_000.0).alias("starting_balance"))


view("curve", f"""
SELECT run_id, arg_max(timestamp_ms, id) AS timestamp_ms, arg_max(equity, id) AS equity FROM (SELECT p.*, timestamp_ms // greatest(1, ({_EQ_AT} - opened_at) // 480) AS bucket FROM points p JOIN runs USING (run_id)
  WHERE timestamp_ms BETWEEN opened_at AND {_EQ_AT}) GROUP BY run_id, bucket UNION ALL SELECT run_id, opened_at, starting_balance FROM runs UNION ALL SELECT run_id, {_EQ_AT}, starting_balance * 1.5 FROM runs WHERE run_id > 'r4'""")


def live_equity(spark, d):
    return runs(spark, d).filter("run_id > 'r4'").select("run_id", (F.col("starting_balance") * 1.5).alias("equity"))


@query("equity_curve", "SELECT run_id, timestamp_ms, round(equity, 2) + 0.0 AS equity FROM curve")
def equity_curve(spark, d):
    return L.equity_curve(equity_points(spark, d), runs(spark, d), _EQ_AT, live=live_equity(spark, d)).withColumn("equity", r6(F.col("equity"), 2))


@query("return_curve", "SELECT run_id, timestamp_ms, round((c.equity / starting_balance - 1) * 100, 5) + 0.0 AS return_pct FROM curve c JOIN runs USING (run_id)")
def return_curve(spark, d):
    r = runs(spark, d)
    return L.return_curve(L.equity_curve(equity_points(spark, d), r, _EQ_AT, live=live_equity(spark, d)), r).select("run_id", "timestamp_ms", r6(F.col("return_pct"), 5).alias("return_pct"))


@query("curve_at", "SELECT run_id, max(timestamp_ms) AS timestamp_ms FROM curve WHERE timestamp_ms <= 900000000000 GROUP BY run_id")
def curve_at(spark, d):
    return L.curve_at(L.equity_curve(equity_points(spark, d), runs(spark, d), _EQ_AT, live=live_equity(spark, d)), 900_000_000_000).select("run_id", "timestamp_ms")


@query("drawdown", """SELECT id, run_id, round(peak, 2) + 0.0 AS peak, round((peak - equity) / peak, 6) + 0.0 AS drawdown,
  round(max((peak - equity) / peak) OVER (PARTITION BY run_id ORDER BY timestamp_ms, id), 6) + 0.0 AS max_drawdown, day_open_equity FROM (
 SELECT *, max(equity) OVER (PARTITION BY run_id ORDER BY timestamp_ms, id) AS peak, first_value(equity) OVER (PARTITION BY run_id, timestamp_ms // 86400000 ORDER BY timestamp_ms, id) AS day_open_equity FROM points)""")
def drawdown(spark, d):
    w = L.drawdown(equity_points(spark, d), 200 * DAY)
    return w.select("id", "run_id", r6(F.col("peak"), 2).alias("peak"), r6(F.col("drawdown")).alias("drawdown"), r6(F.col("max_drawdown")).alias("max_drawdown"), "day_open_equity")


# ------------------------------------------------------- quotes and decisions --------
view("quote_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN 'spot' ELSE 'option' END AS kind, CASE WHEN l_suppkey % 2 = 0 THEN 'yahoo' ELSE 'deribit' END AS venue, l_extendedprice AS price,
  CASE WHEN l_tax <> 0 THEN l_extendedprice * (1 - l_discount) END AS bid, l_extendedprice * (1 + l_discount - 0.01) AS ask, CASE WHEN l_suppkey % 2 = 1 AND l_linenumber % 3 > 0 THEN l_quantity END AS fwd,
  CASE WHEN l_linenumber % 3 > 0 THEN l_quantity * 1000 END AS expiry, l_partkey % 60 * 1000 AS age, CASE WHEN l_suppkey % 10 = 4 THEN 'CLOSED' ELSE 'OPEN' END AS market_state FROM lineitem""")


@query("executable_quotes", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(b, 4) + 0.0 AS bid, round(a, 4) + 0.0 AS ask, CAST(CASE WHEN kind = 'option' AND venue = 'yahoo' THEN 100 ELSE 1 END AS INTEGER) AS multiplier,
  CASE WHEN kind = 'option' AND bid IS NULL THEN 'OPTION_NEEDS_BOTH_SIDES' WHEN b < 0 OR a <= 0 OR b > a THEN 'INVALID_OR_CROSSED' WHEN age > 45000 THEN 'STALE_OR_NOT_YET_AVAILABLE' WHEN expiry IS NOT NULL AND 20000 >= expiry THEN 'EXPIRED_NEEDS_SETTLEMENT'
   WHEN market_state = 'CLOSED' THEN 'SESSION_CLOSED' END AS reject_reason FROM (
 SELECT *, CASE WHEN kind = 'spot' AND bid IS NULL THEN price * 0.998 ELSE bid * coalesce(fwd, 1) END AS b, CASE WHEN kind = 'spot' AND bid IS NULL THEN price * 1.002 ELSE ask * coalesce(fwd, 1) END AS a FROM quote_rows)""")
def executable_quotes(spark, d):
    li, ln = table(spark, d, "lineitem"), F.col("l_linenumber")
    spot, even = ln % 3 == 0, F.col("l_suppkey") % 2 == 0
    received = F.lit(20_000) - F.col("l_partkey") % 60 * 1000
    q = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(spot, "spot").otherwise("option").alias("kind"), F.when(even, "yahoo").otherwise("deribit").alias("venue"),
        F.col("l_extendedprice").alias("price"), F.when(F.col("l_tax") != 0, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("bid"),
        (F.col("l_extendedprice") * (1 + F.col("l_discount") - 0.01)).alias("ask"), F.when(~even & ~spot, F.col("l_quantity")).alias("coin_forward"),
        F.when(~spot, F.col("l_quantity") * 1000).cast("bigint").alias("expiry"), received.alias("received_ms"), received.alias("source_ms"),
        F.when(F.col("l_suppkey") % 10 == 4, "CLOSED").otherwise("OPEN").alias("market_state"))
    x = L.executable_quotes(q, F.lit(20_000))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.col("bid"), 4).alias("bid"), r6(F.col("ask"), 4).alias("ask"), "multiplier", "reject_reason")


view("listed", """SELECT p_brand AS asset, 'o' || p_partkey AS instrument, 100 + CAST(p_size % 5 AS BIGINT) AS expiry, p_retailprice AS contract_strike, p_size / CAST(2 AS DOUBLE) AS bid, p_size / CAST(2 AS DOUBLE) * 1.02 AS ask,
  CASE WHEN p_size % 2 = 0 THEN 100 ELSE 1 END AS multiplier, CASE WHEN p_partkey % 4 = 0 THEN 'put' ELSE 'call' END AS option_type, CASE WHEN p_partkey % 13 = 0 THEN 'SESSION_CLOSED' END AS reject_reason, p_partkey % 11 = 0 AS crossed FROM part""")
view("wanted_all", "SELECT 'Brand#' || (n_nationkey + 1) AS asset, CAST(100 + n_regionkey % 4 AS BIGINT) AS cutoff, 910.0 + n_nationkey * 3 AS strike FROM nation")
view("nearby", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset, expiry ORDER BY abs(contract_strike - strike), instrument) AS strike_rank FROM (
 SELECT *, dense_rank() OVER (PARTITION BY asset ORDER BY expiry) AS expiry_rank FROM listed JOIN wanted_all USING (asset) WHERE expiry >= cutoff) WHERE expiry_rank <= 2)""")


def _listing(spark, d):
    size = F.col("p_size")
    contracts = table(spark, d, "part").select(
        F.col("p_brand").alias("asset"), F.concat(F.lit("o"), "p_partkey").alias("instrument"), (F.lit(100) + size % 5).cast("bigint").alias("expiry"),
        F.col("p_retailprice").alias("contract_strike"), (size / F.lit(2.0)).alias("bid"), (size / F.lit(2.0) * 1.02).alias("ask"), F.when(size % 2 == 0, 100).otherwise(1).alias("multiplier"))
    targets = table(spark, d, "nation").select(
        F.concat(F.lit("Brand#"), F.col("n_nationkey") + 1).alias("asset"), (F.lit(100) + F.col("n_regionkey") % 4).cast("bigint").alias("cutoff"),
        (F.col("n_nationkey") * 3 + 910.0).alias("strike"))
    return contracts, targets


@query("nearby_instruments", "SELECT asset, instrument, expiry, CAST(expiry_rank AS INTEGER) AS expiry_rank, CAST(strike_rank AS INTEGER) AS strike_rank FROM nearby WHERE strike_rank <= 24")
def nearby_instruments(spark, d):
    """Two nearest expiries and 24 nearest strikes of each asset, the listing the ticket shows."""
    return L.nearby_instruments(*_listing(spark, d), ["asset"]).select("asset", "instrument", "expiry", "expiry_rank", "strike_rank")


view("quoted", "SELECT l.* REPLACE (CASE WHEN crossed THEN ask - 1 - bid ELSE ask END AS ask) FROM listed l")
view("expr_near", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset, expiry ORDER BY abs(contract_strike - strike), instrument) AS strike_rank FROM (
 SELECT *, dense_rank() OVER (PARTITION BY asset ORDER BY expiry) AS expiry_rank FROM quoted JOIN wanted_all USING (asset) WHERE expiry >= cutoff AND bid <= ask AND ask > 0 AND reject_reason IS NULL
  AND option_type = CASE WHEN strike < 950 THEN 'call' ELSE 'put' END) WHERE expiry_rank <= 2)""")
view("expr_q", "SELECT *, least(10000, floor(5000 / (ask * multiplier * 1.01 + 0.65))) AS quantity FROM expr_near WHERE strike_rank <= 5 AND bid > 0 AND (ask - bid) / ask <= 0.06")
view("expr_cost", """SELECT *, (ask + ask * (10 + 5 * ask * quantity * multiplier / 10000) / 10000) * quantity * multiplier * 1.001 + quantity * 0.65 AS debit,
  (bid - bid * (10 + 5 * bid * quantity * multiplier / 10000) / 10000) * quantity * multiplier * 0.999 - quantity * 0.65 AS credit FROM expr_q WHERE quantity >= 1""")


@query("cheapest_expression", """SELECT asset, instrument, CAST(quantity AS DOUBLE) AS quantity, round(drag, 6) + 0.0 AS drag FROM (
 SELECT *, row_number() OVER (PARTITION BY asset ORDER BY round(drag, 12), expiry, abs(contract_strike - strike), instrument) AS n FROM (SELECT *, (debit - credit) / debit AS drag FROM expr_cost) WHERE debit <= 5000 AND drag <= 0.05) WHERE n = 1""")
def cheapest_expression(spark, d):
    contracts, targets = _listing(spark, d)
    k = F.regexp_extract("instrument", "[0-9]+", 0).cast("int")
    contracts = contracts.withColumns({
        "option_type": F.when(k % 4 == 0, "put").otherwise("call"), "reject_reason": F.when(k % 13 == 0, "SESSION_CLOSED"),
        "ask": F.when(k % 11 == 0, F.col("ask") - 1 - F.col("bid")).otherwise(F.col("ask"))})
    targets = targets.withColumn("trade_direction", F.when(F.col("strike") < 950, 1).otherwise(-1))
    x = L.cheapest_expression(contracts, targets, ["asset"], F.lit(5000.0))
    return x.select("asset", "instrument", F.col("quantity").cast("double").alias("quantity"), r6(F.col("drag")).alias("drag"))


view("planned", "SELECT c_custkey AS order_id, 'm' || (c_custkey % 8) AS instrument, {s} + (CAST(c_custkey AS BIGINT) * 7919 % 2592) * 1000000 AS decision_ms FROM customer".replace("{s}", str(START)))
view("tquotes", "SELECT market AS instrument, id AS quote_id, received_ms, value AS bid, CASE WHEN user_id % 10 = 0 THEN value - 1 ELSE value + 1 END AS ask FROM ticks WHERE kind = 'pm'")
view("clockpts", "SELECT DISTINCT received_ms AS point_ms, true AS packet FROM ticks UNION SELECT decision_ms, false FROM planned")
view("planfill", f"""
SELECT *, fill_ms - CASE WHEN (SELECT count(*) FROM ticks t WHERE t.received_ms = fill_ms) > 0 THEN 0 ELSE 1 END AS seen FROM (
 SELECT p.*, c.point_ms AS fill_ms FROM planned p ASOF LEFT JOIN (SELECT DISTINCT point_ms FROM clockpts) c ON p.decision_ms + {1000 * SCALE} <= c.point_ms)""")


@query("order_quote_asof", f"""SELECT f.order_id, f.fill_ms, q.quote_id, CASE WHEN fill_ms IS NULL THEN 'BEYOND_TAPE' WHEN fill_ms - decision_ms > {30_000 * SCALE} THEN 'ORDER_EXPIRED' WHEN q.quote_id IS NULL THEN 'NO_QUOTE'
  WHEN q.bid < 0 OR q.ask <= 0 OR q.bid > q.ask THEN 'INVALID_OR_CROSSED' WHEN fill_ms - q.received_ms > {45_000 * SCALE} THEN 'STALE_QUOTE' END AS reject_reason
 FROM planfill f ASOF LEFT JOIN tquotes q ON f.instrument = q.instrument AND f.seen >= q.received_ms""")
def order_quote_asof(spark, d):
    """Planned orders of ``customer`` filled on the packet tape."""
    k, t = F.col("c_custkey"), ticks(spark, d)
    orders = table(spark, d, "customer").select(k.alias("order_id"), F.concat(F.lit("m"), k % 8).alias("instrument"), (F.lit(START) + (k * 7919 % 2592) * 1_000_000).alias("decision_ms"))
    quotes = t.filter("kind = 'pm'").select(F.col("market").alias("instrument"), F.col("id").alias("quote_id"), "received_ms", F.col("value").alias("bid"),
                                            F.when(F.col("user_id") % 10 == 0, F.col("value") - 1).otherwise(F.col("value") + 1).alias("ask"))
    x = L.order_quote_asof(orders, quotes, t.select(F.col("received_ms").alias("now_ms")), time_scale=SCALE, slice_ms=10 * DAY)
    return x.select("order_id", "fill_ms", "quote_id", "reject_reason")


view("held", f"""SELECT o_orderkey AS position_id, 'm' || (o_custkey % 8) AS event_id, {START + 30 * DAY} - (o_custkey % 200) * 30000 AS opened_at, {START + 30 * DAY} + (o_custkey % 90) * 60000 AS expiry,
  1.0 + o_orderkey % 5 AS quantity, 1000 + o_totalprice / 1000 AS entry_cost, 200.0 + o_custkey % 100 AS bid, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS pdir FROM orders""")


@query("exit_signals", f"""SELECT position_id, round(quantity * bid / entry_cost - 1, 6) + 0.0 AS premium_return, CASE WHEN {START + 30 * DAY} - opened_at >= 3600000 THEN 'MAXIMUM_HOLDING_TIME'
   WHEN h.expiry - {START + 30 * DAY} < 1800000 THEN 'EXIT_BEFORE_EXPIRY' WHEN quantity * bid / entry_cost - 1 <= -0.2 THEN 'PREMIUM_STOP_LOSS' WHEN quantity * bid / entry_cost - 1 >= 0.3 THEN 'PREMIUM_TAKE_PROFIT'
   WHEN fresh AND abs(gap_pp) <= 0.2 THEN 'GAP_CONVERGED' WHEN fresh AND gap_pp * pdir < 0 THEN 'DIRECTION_REVERSED' END AS exit_reason
 FROM held h LEFT JOIN (SELECT event_id, gap_pp, gap_pp IS NOT NULL AND {START + 30 * DAY} - now_ms < {60_000 * SCALE} AS fresh FROM obs QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY raw_id DESC) = 1) o USING (event_id)""")
def exit_signals(spark, d):
    now = START + 30 * DAY
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    held = table(spark, d, "orders").select(
        o.alias("position_id"), F.concat(F.lit("m"), k % 8).alias("event_id"), (F.lit(now) - k % 200 * 30_000).alias("opened_at"), (F.lit(now) + k % 90 * 60_000).alias("expiry"),
        (o % 5 + 1.0).alias("quantity"), F.lit(1).alias("multiplier"), (F.col("o_totalprice") / 1000 + 1000).alias("entry_cost"), (k % 100 + 200.0).alias("bid"),
        F.when(o % 2 == 0, 1).otherwise(-1).alias("position_direction"))
    latest = history.latest_by(observations(spark, d), ["event_id"]).withColumn("direction", F.lit("up"))
    x = L.exit_signals(held, latest, now, PolicyConfig(fresh_row_ms=60_000 * SCALE))
    return x.select("position_id", r6(F.col("premium_return")).alias("premium_return"), "exit_reason")


@query("risk_screen", """SELECT o_orderkey, CASE WHEN n = 5 THEN concat_ws(',', 'UNKNOWN_RUN', CASE WHEN side = 'SELL' AND q > coalesce(hq, 0) + 1e-9 THEN 'NO_SHORTING' END) ELSE concat_ws(',', CASE WHEN n = 7 THEN 'BANKRUPT' END, CASE WHEN side = 'SELL' AND q > coalesce(hq, 0) + 1e-9 THEN 'NO_SHORTING' END, CASE WHEN side = 'BUY' AND n = 6 THEN 'STALE_MARKS' END,
  CASE WHEN side = 'BUY' AND n / CAST(20 AS DOUBLE) >= 0.25 THEN 'DRAWDOWN_LIMIT' END, CASE WHEN side = 'BUY' AND eq < 2000000 * 0.9 THEN 'DAILY_LOSS_LIMIT' END, CASE WHEN side = 'BUY' AND debit > 100000 * (n + 1) THEN 'INSUFFICIENT_CASH' END,
  CASE WHEN side = 'BUY' AND debit > eq * 0.1 THEN 'TRADE_PERCENTAGE' END, CASE WHEN side = 'BUY' AND coalesce(hv, 0) + debit > eq * 0.25 THEN 'POSITION_PERCENTAGE' END, CASE WHEN side = 'BUY' AND 500000 + debit > eq THEN 'GROSS_EXPOSURE' END,
  CASE WHEN side = 'BUY' AND hq IS NULL AND n + 5 >= 10 THEN 'CONCURRENT_POSITIONS' END) END AS reasons FROM (
 SELECT o_orderkey, o_custkey % 8 AS n, CASE WHEN o_orderkey % 3 > 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(o_orderkey % 50 AS DOUBLE) AS q, o_totalprice AS debit, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 40 AS DOUBLE) END AS hq,
  CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 2 END AS hv, 600000.0 + 250000 * (o_custkey % 8) AS eq FROM orders)""")
def risk_screen(spark, d):
    k, o = F.col("o_custkey") % 8, F.col("o_orderkey")
    orders = table(spark, d, "orders").select(
        "o_orderkey", k.alias("run_id"), F.when(o % 3 > 0, "BUY").otherwise("SELL").alias("side"), (o % 50).cast("double").alias("quantity"), F.col("o_totalprice").alias("total_debit"),
        F.when(o % 4 > 0, (o % 40).cast("double")).alias("held_quantity"), F.when(o % 4 > 0, F.col("o_totalprice") / 2).alias("held_value"))
    n = F.col("run_id")
    metrics = orders.select("run_id").distinct().filter("run_id <> 5").select(
        "run_id", (n == 7).alias("bankrupt"), F.when(n == 6, 1).otherwise(0).alias("stale_marks"), (n / F.lit(20.0)).alias("max_drawdown"), F.lit(2_000_000.0).alias("day_open_equity"),
        (n * 250_000 + 600_000.0).alias("equity"), ((n + 1) * 100_000.0).alias("cash"), F.lit(500_000.0).alias("market_value"), (n + 5).alias("open_positions"))
    return L.risk_screen(orders, metrics).select("o_orderkey", F.concat_ws(",", "reasons").alias("reasons"))


view("options_held", f"""SELECT c_custkey AS position_id, 'm' || (c_custkey % 8) AS asset, {START} + (c_custkey * 104729 % 2592) * 1000000 AS expiry, 50.0 + c_custkey % 100 AS strike, CASE WHEN c_custkey % 2 = 0 THEN 'put' ELSE 'call' END AS option_type, 1.0 + c_custkey % 3 AS quantity, c_acctbal AS entry_cost FROM customer""")
view("prints", "SELECT market AS asset, id AS raw_id, received_ms, value AS price FROM ticks WHERE kind = 'spot'")


@query("settlement_value", f"""SELECT position_id, ref AS reference_raw_id, CASE WHEN price IS NOT NULL THEN round(greatest(0, CASE option_type WHEN 'put' THEN strike - price ELSE price - strike END) * quantity * 100, 4) + 0.0 END AS payout,
  CASE WHEN price IS NOT NULL THEN round(greatest(0, CASE option_type WHEN 'put' THEN strike - price ELSE price - strike END) * quantity * 100 - entry_cost, 4) + 0.0 END AS realized_pnl FROM (
 SELECT h.*, CASE WHEN f.raw_id IS NOT NULL AND (b.raw_id IS NULL OR f.received_ms - h.expiry < h.expiry - b.received_ms) THEN f.raw_id ELSE b.raw_id END AS ref,
   CASE WHEN f.raw_id IS NOT NULL AND (b.raw_id IS NULL OR f.received_ms - h.expiry < h.expiry - b.received_ms) THEN f.price ELSE b.price END AS price
 FROM options_held h LEFT JOIN (SELECT position_id, p.* FROM options_held h ASOF JOIN prints p ON h.asset = p.asset AND h.expiry >= p.received_ms WHERE h.expiry - p.received_ms <= {60_000 * SCALE}) b USING (position_id)
  LEFT JOIN (SELECT position_id, p.* FROM options_held h ASOF JOIN prints p ON h.asset = p.asset AND h.expiry <= p.received_ms WHERE p.received_ms - h.expiry <= {60_000 * SCALE}) f USING (position_id))""")
def settlement_value(spark, d):
    k, t = F.col("c_custkey"), ticks(spark, d)
    positions = table(spark, d, "customer").select(
        k.alias("position_id"), F.concat(F.lit("m"), k % 8).alias("asset"), (F.lit(START) + (k * 104729 % 2592) * 1_000_000).alias("expiry"), (k % 100 + 50.0).alias("strike"),
        F.when(k % 2 == 0, "put").otherwise("call").alias("option_type"), (k % 3 + 1.0).alias("quantity"), F.lit(100).alias("multiplier"), F.col("c_acctbal").alias("entry_cost"),
        F.lit("option").alias("kind"))
    prints = t.filter("kind = 'spot'").select(F.col("market").alias("asset"), F.col("id").alias("raw_id"), "received_ms", F.col("value").alias("price"))
    x = L.settlement_value(positions, prints, START + 31 * DAY, 60_000 * SCALE, 10 * DAY)
    return x.select("position_id", "reference_raw_id", r6(F.col("payout"), 4).alias("payout"), r6(F.col("realized_pnl"), 4).alias("realized_pnl"))


@query("recording_gaps", """SELECT p AS start, timestamp_ms AS "end", timestamp_ms - p AS duration_ms FROM (SELECT *, lag(timestamp_ms) OVER (ORDER BY timestamp_ms, id) AS p FROM ticks2)
 WHERE timestamp_ms - p > 600000 ORDER BY timestamp_ms DESC LIMIT 20""")
def recording_gaps(spark, d):
    """The newest 20 holes longer than ten minutes in the receipt times of all packets."""
    from ..operators.dynamics import recording_gaps as gaps

    return gaps(ticks(spark, d).select("id", F.col("received_ms").alias("timestamp_ms")), 600_000, 20, 5 * DAY)


view("ticks2", "SELECT id, received_ms AS timestamp_ms FROM ticks")
