"""State of the quoted legs along the tape: books, spots, surfaces, path history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_epoch_ms, to_number
from .clock import accept_newer
from .running import id_slices, last, running

DAY_MS = 86_400_000
_BOOK_ORDER = ["id", "message_no", "change_no"]


def book_state(changes: DataFrame, tolerance_ms: int = 5_000, slice_rows: int = 1_000_000,
               source_always_present: bool = False) -> DataFrame:
    """Top of book after every accepted change of ``explode_books``.

    A full book sets both sides; an increment sets the sides it names and
    leaves depth unverified. Crossed books have no mid. ``depth`` is there if ``changes`` have it.
    """
    judged = accept_newer(changes, ["token"], order=_BOOK_ORDER, tolerance_ms=tolerance_ms,
                          source_always_present=source_always_present, slice_rows=slice_rows)
    side = lambda name: last(F.when(F.col(f"{name}_set"), F.struct(F.col(name).alias("v"))))
    rows = running(judged.filter("verdict = 'ACCEPTED'"), ["token"], _BOOK_ORDER,
                   {"__bid": side("bid"), "__ask": side("ask")}, id_slices("id", slice_rows), restart=True)
    bid, ask = F.col("__bid.v"), F.col("__ask.v")
    crossed = F.coalesce(bid > ask, F.lit(False))
    return rows.select(
        "token", F.col("id").alias("raw_id"), "message_no", "change_no", "received_ms",
        F.coalesce("source_ms", "received_ms").alias("source_ms"),
        F.when(F.col("source_ms").isNull(), "receipt").otherwise("source").alias("timestamp_origin"),
        bid.alias("bid"), ask.alias("ask"), *[c for c in ("depth",) if c in changes.columns], crossed.alias("crossed"),
        F.when(~crossed, (bid + ask) / 2).alias("yes"))


def stamped_ticks(ticks: DataFrame) -> DataFrame:
    """Spot packets with a positive ``price``, by their payload, and their source time."""
    return ticks.withColumns({
        "price": to_number(F.get_json_object("payload", "$.price")),
        "source_ms": F.coalesce(F.nullif(to_epoch_ms(F.get_json_object("payload", "$.timestamp")), F.lit(0)), F.col("source_ms")),
    }).filter(F.col("price") > 0)


def accepted_spots(judged: DataFrame) -> DataFrame:
    return judged.filter("verdict = 'ACCEPTED'").select(
        F.col("subject").alias("asset"), F.col("id").alias("raw_id"), "price", F.col("now_ms").alias("received_ms"),
        F.coalesce("source_ms", "now_ms").alias("source_ms"), F.col("source").alias("venue"),
        F.when(F.col("source_ms").isNull(), "receipt").otherwise("source").alias("timestamp_origin"))


def spot_state(ticks: DataFrame, tolerance_ms: int = 5_000, slice_rows: int = 1_000_000,
               source_always_present: bool = False) -> DataFrame:
    """Accepted positive prices per asset, judged on the effective clock ``now_ms``."""
    return accepted_spots(accept_newer(stamped_ticks(ticks), ["subject"], clock="now_ms", tolerance_ms=tolerance_ms, slice_rows=slice_rows,
                                       source_always_present=source_always_present))


def surface_snapshots(chain: DataFrame) -> DataFrame:
    """One row per (asset, expiry, packet) of exploded contracts, of either kind of chain.

    A surface has the source time of its packet, else its receipt time. Only calls count as its contracts; an expiry of a
    summary without calls is no surface, one of an equity chain is.
    """
    from_chain = "market_state" in chain.columns
    call = F.col("option_type") == "call"
    forward = F.col("forward") if "forward" in chain.columns else F.lit(None).cast("double")
    rows = chain if from_chain else chain.filter(call)
    return rows.withColumn("__f", forward).groupBy("asset", "expiry", F.col("id").alias("raw_id")).agg(
        F.min("venue").alias("venue"), F.min("received_ms").alias("received_ms"),
        F.min(F.coalesce("packet_source_ms", "received_ms")).alias("source_ms"),
        F.sum(F.when(call, 1).otherwise(0)).cast("bigint").alias("contracts"),
        F.min_by("__f", F.when(call & (F.col("__f") != 0), F.col("pos"))).alias("forward"),
        *([F.min("market_state").alias("market_state")] if from_chain else []))


def accepted_chains(packets: DataFrame, tolerance_ms: int = 5_000, slice_rows: int = 1_000_000) -> DataFrame:
    """The option packets (id, subject, received_ms, source_ms, ...) that may change surfaces.

    Per asset, by their own source times against receipt; packets without one are accepted.
    """
    judged = accept_newer(packets, ["subject"], tolerance_ms=tolerance_ms, slice_rows=slice_rows)
    return judged.filter("verdict = 'ACCEPTED'").drop("verdict")


def chain_spots(chain: DataFrame) -> DataFrame:
    """The spot that an equity-chain packet carries, in the shape of ``spot_state``; it passes no further acceptance."""
    return chain.filter(F.col("spot").isNotNull()).groupBy("asset", F.col("id").alias("raw_id")).agg(
        F.min("spot").alias("price"), F.min("received_ms").alias("received_ms"), F.min("spot_source_ms").alias("__s"),
        F.min("venue").alias("venue"), F.min("market_state").alias("market_state")).select(
        "asset", "raw_id", "price", "received_ms", F.coalesce(F.nullif("__s", F.lit(0)), "received_ms").alias("source_ms"), "venue",
        F.when(F.coalesce("__s", F.lit(0)) != 0, "source").otherwise("retrieval_unknown_delay").alias("timestamp_origin"), "market_state")


def surface_state(snapshots: DataFrame, at_ms: int | None = None) -> DataFrame:
    """Newest snapshot per (asset, expiry).

    An expiry is dropped once its asset receives a packet more than a day later.
    """
    seen = snapshots if at_ms is None else snapshots.filter(F.col("received_ms") <= at_ms)
    newest = seen.groupBy("asset", "expiry").agg(
        F.max_by(F.struct(*[c for c in seen.columns if c not in ("asset", "expiry")]), "raw_id").alias("s"))
    clock = seen.groupBy("asset").agg(F.max_by("received_ms", "raw_id").alias("__at"))
    return newest.join(clock, "asset").filter(F.col("expiry") >= F.col("__at") - DAY_MS).select("asset", "expiry", "s.*")


def path_history(packets: DataFrame) -> DataFrame:
    """Low and high of each history packet's window, null unless coverage is complete.

    ``packets``: id, subject, received_ms, start_ms, candles array<struct<sec,low,high>>;
    for exchange sessions also sessions, required_sessions and corporate_action,
    with session_calendar set.
    """
    inside = F.filter("candles", lambda c: (c["sec"] * 1000).between(F.col("start_ms"), F.col("received_ms")))
    df = packets.withColumn("__c", inside)
    numeric = ~F.exists("__c", lambda c: c["low"].isNull() | c["high"].isNull())
    some = F.size("__c") > 0
    first_day, end_day = F.floor(F.col("start_ms") / DAY_MS), F.floor(F.col("received_ms") / DAY_MS)
    required = F.when(end_day > first_day, F.sequence(first_day, end_day - 1)).otherwise(F.array().cast("array<bigint>"))
    days = F.transform("__c", lambda c: F.floor(c["sec"] / 86_400))
    daily = (F.col("start_ms") % DAY_MS == 0) & (F.size(F.array_except(required, days)) == 0)
    sessions = (
        (F.size("__c") == F.size(F.coalesce("sessions", F.array().cast("array<string>"))))
        & (F.size(F.array_except(F.coalesce("required_sessions", F.array().cast("array<string>")),
                                 F.coalesce("sessions", F.array().cast("array<string>")))) == 0)
        & ~F.coalesce("corporate_action", F.lit(False))
    )
    good = some & numeric & F.when(F.col("session_calendar").isNotNull(), sessions).otherwise(daily)
    kept = lambda pick, field: F.when(good, pick(F.transform("__c", lambda c: c[field])))
    return df.select(
        F.col("subject").alias("asset"), F.col("start_ms").alias("window_start"), F.col("id").alias("raw_id"), "received_ms",
        kept(F.array_min, "low").alias("low"), kept(F.array_max, "high").alias("high"), (~good).alias("error"),
        F.when(F.col("session_calendar").isNotNull(), "regular_sessions").otherwise("daily").alias("source"))
