"""Driver tables read as domain inputs.

The driver tables hold no market data, so each domain input is a deterministic
projection of one of them. The sub-selects registered here repeat the same
projection for the check SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import pricing as P
from ..functions.scalars import as_probability
from ..operators.running import id_slices, last, running
from .registry import view

#: one reference second stands for ten minutes of the ``events`` table
SCALE = 600
CONFIG = Config(time_scale=SCALE)
#: rows of one market per task; small so that the local checks cross slices
SLICE_ROWS = 2_500
DAY = 86_400_000
START = 1_704_067_200_000  # 2024-01-01T00:00:00Z, first day of ``events``


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows of a compact table over all tasks, before packets many times their size are made of them and unpacked."""
    return rows.repartition(key)


def r6(col: Column, digits: int = 6) -> Column:
    return F.round(col, digits) + F.lit(0.0)


KIND = {"view": "pm", "click": "opt", "purchase": "spot", "error": "outage", "signup": "timer"}

view("ticks", """
SELECT event_id AS id, 'm' || CAST(user_id % 8 AS VARCHAR) AS market, user_id,
       CASE event_type WHEN 'view' THEN 'pm' WHEN 'click' THEN 'opt' WHEN 'purchase' THEN 'spot'
                       WHEN 'error' THEN 'outage' WHEN 'signup' THEN 'timer' END AS kind,
       value, epoch_us(ts) // 1000 AS received_ms,
       epoch_us(ts) // 1000 + ((event_id * 7919) % 14000 - 8000) * 600 AS source_ms, props AS payload
FROM events
""")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a packet tape: 8 markets, five packet kinds."""
    e = table(spark, sf_dir, "events")
    received = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.create_map(*[F.lit(x) for pair in KIND.items() for x in pair])[F.col("event_type")]
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")).alias("market"),
        "user_id",
        kind.alias("kind"),
        "value",
        received.alias("received_ms"),
        (received + ((F.col("event_id") * 7919) % 14000 - 8000) * SCALE).alias("source_ms"),
        F.col("props").alias("payload"),
    )


# Observations: the newest PM, OPT and spot value of the market at every packet.
# The mapping goes A -> B -> A over the month; market m5 expires on day 20.
view("obs", f"""
SELECT *, state_ok AND gap_pp IS NOT NULL AND NOT list_contains(quality_flags, 'WIDE_PM_BOOK') AS valid FROM (
SELECT market AS event_id, id AS raw_id, received_ms AS now_ms, kind AS trigger_kind,
       'A' || substr(market, 2) AS asset, mapping_hash, expiry,
       pm_yes, opt_yes, spot, opt_ms AS opt_timestamp, pm_bid, pm_ask,
       CASE WHEN kind = 'outage' THEN 'STALE' WHEN pm_yes IS NULL OR opt_yes IS NULL THEN 'WAIT' ELSE 'PROXY' END AS source_state,
       NOT (kind = 'outage' OR pm_yes IS NULL OR opt_yes IS NULL) AS state_ok,
       CASE WHEN pm_ask - pm_bid > 0.1 THEN ['UNVERIFIED_SETTLEMENT_SEMANTICS', 'WIDE_PM_BOOK']
            ELSE ['UNVERIFIED_SETTLEMENT_SEMANTICS'] END AS quality_flags,
       CASE WHEN kind <> 'outage' THEN (pm_yes - opt_yes) * 100 END AS gap_pp,
       CASE WHEN kind <> 'outage' AND opt_yes > 0 THEN abs(pm_yes - opt_yes) / opt_yes END AS relative_gap,
       CASE WHEN kind <> 'outage' THEN CASE WHEN pm_yes > opt_yes THEN 'CHEAP' WHEN pm_yes < opt_yes THEN 'RICH'
            WHEN pm_yes = opt_yes THEN 'EVEN' END END AS side
FROM (
  SELECT *,
    last_value(CASE WHEN kind = 'pm' AND value <= 500 THEN value / 500 END IGNORE NULLS) OVER w AS pm_yes,
    last_value(CASE WHEN kind = 'pm' AND value <= 500 THEN value / 500 - value / 6000 END IGNORE NULLS) OVER w AS pm_bid,
    last_value(CASE WHEN kind = 'pm' AND value <= 500 THEN value / 500 + value / 6000 END IGNORE NULLS) OVER w AS pm_ask,
    last_value(CASE WHEN kind = 'opt' AND value <= 500 THEN value / 500 END IGNORE NULLS) OVER w AS opt_yes,
    last_value(CASE WHEN kind = 'opt' AND value <= 500 THEN received_ms END IGNORE NULLS) OVER w AS opt_ms,
    last_value(CASE WHEN kind = 'spot' AND value > 0 THEN value END IGNORE NULLS) OVER w AS spot,
    CASE WHEN received_ms < {START + 10 * DAY} THEN 'map-a' WHEN received_ms < {START + 20 * DAY} THEN 'map-b' ELSE 'map-a' END AS mapping_hash,
    CASE WHEN market = 'm5' THEN {START + 20 * DAY} ELSE {START + 400 * DAY} END AS expiry
  FROM ticks
  WINDOW w AS (PARTITION BY market ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
))
""")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per packet of ``ticks``; see the ``obs`` sub-select."""
    t = ticks(spark, sf_dir)
    p = as_probability(F.col("value") / 500)
    pm = F.when((F.col("kind") == "pm") & p.isNotNull(), F.struct(
        p.alias("yes"), (p - F.col("value") / 6000).alias("bid"), (p + F.col("value") / 6000).alias("ask")))
    opt = F.when((F.col("kind") == "opt") & p.isNotNull(), F.struct(p.alias("yes"), F.col("received_ms").alias("ms")))
    spot = F.when((F.col("kind") == "spot") & (F.col("value") > 0), F.col("value"))
    legs = running(t, ["market"], ["id"], {"pm": last(pm), "opt": last(opt), "spot": last(spot)},
                   id_slices("id", SLICE_ROWS))
    outage = F.col("kind") == "outage"
    pm_yes, opt_yes = F.col("pm.yes"), F.col("opt.yes")
    shown = lambda c: F.when(~outage, c)
    now = F.col("received_ms")
    o = legs.select(
        F.col("market").alias("event_id"),
        F.col("id").alias("raw_id"),
        now.alias("now_ms"),
        F.col("kind").alias("trigger_kind"),
        F.concat(F.lit("A"), F.expr("substr(market, 2)")).alias("asset"),
        F.when(now < START + 10 * DAY, "map-a").when(now < START + 20 * DAY, "map-b").otherwise("map-a").alias("mapping_hash"),
        F.when(F.col("market") == "m5", F.lit(START + 20 * DAY)).otherwise(F.lit(START + 400 * DAY)).alias("expiry"),
        pm_yes.alias("pm_yes"), opt_yes.alias("opt_yes"), "spot", F.col("opt.ms").alias("opt_timestamp"),
        F.col("pm.bid").alias("pm_bid"), F.col("pm.ask").alias("pm_ask"),
        F.when(outage, "STALE").when(pm_yes.isNull() | opt_yes.isNull(), "WAIT").otherwise("PROXY").alias("source_state"),
        F.array_compact(F.array(
            F.lit("UNVERIFIED_SETTLEMENT_SEMANTICS"),
            F.when(F.col("pm.ask") - F.col("pm.bid") > CONFIG.max_pm_spread, "WIDE_PM_BOOK"),
        )).alias("quality_flags"),
        shown(P.gap_pp(pm_yes, opt_yes)).alias("gap_pp"),
        shown(P.relative_gap(pm_yes, opt_yes)).alias("relative_gap"),
        shown(P.gap_side(pm_yes, opt_yes)).alias("side"),
    )
    return o.withColumn("valid", P.observation_valid(F.col("gap_pp"), F.col("source_state"), F.col("quality_flags")))
