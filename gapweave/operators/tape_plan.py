"""One plan from raw tape packets to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import to_number
from ..session import stage_table
from ..sources import feeds
from . import events as EV
from . import legs
from . import observe as O
from .running import ID_SLICE, Run, highest, id_slices, last, running

SEMANTICS = (
    "event_text", "asset", "expiry", "event_type", "direction", "strike_or_threshold", "yes_token", "window_start", "settlement_source",
    "threshold_inclusive", "mapping_review", "mapping_hash")


def mapping_packets(packets: DataFrame) -> DataFrame:
    """The valid operator mappings of ``mapping`` packets, typed, with ``mapping_raw_id``."""
    fields = ", ".join(f"{name}:string" for name in EV.MAPPING_FIELDS)
    typed = EV.validate_mapping(packets.select(F.col("id").alias("mapping_raw_id"), F.from_json("payload", f"struct<{fields}>").alias("m")).select("mapping_raw_id", "m.*"))
    return typed.filter(F.size("reject_reasons") == 0)


def history_packets(packets: DataFrame) -> DataFrame:
    """``history`` packets in the shape ``legs.path_history`` reads."""
    body = F.from_json("payload", "struct<start_ms:bigint,candles:array<array<string>>,session_calendar:string,sessions:array<string>,required_sessions:array<string>,corporate_action:boolean>")
    candle = lambda c: F.struct(
        F.get(c, F.lit(0)).try_cast("bigint").alias("sec"), to_number(F.get(c, F.lit(1))).alias("low"), to_number(F.get(c, F.lit(2))).alias("high"))
    return packets.select("id", "subject", "received_ms", body.alias("b")).select(
        "id", "subject", "received_ms", "b.start_ms", F.transform("b.candles", candle).alias("candles"), "b.session_calendar", "b.sessions",
        "b.required_sessions", "b.corporate_action")


def proposition_versions(listings: DataFrame, mappings: DataFrame, dismissals: DataFrame, slice_rows: int = ID_SLICE) -> DataFrame:
    """Propositions with the stretch of the tape they hold for: packets from ``valid_from`` up to before ``valid_to``.

    A mapped, active listing holds from its packet on; an operator's mapping replaces its meaning and survives later listings;
    a dismissal ends it until it is mapped again. Listings that change nothing but price and volume open no new version.
    ``dismissals``: event_id, mapping_raw_id.
    """
    usable = (F.col("event_type") != "unmapped") & F.col("active")
    listed = listings.select("event_id", F.col("catalog_raw_id").alias("at"), F.struct(
        usable.alias("usable"), *SEMANTICS, F.lit(None).cast("bigint").alias("mapping_raw_id")).alias("c"))
    mapped = mappings.select("event_id", F.col("mapping_raw_id").alias("at"), F.struct(
        F.lit(True).alias("usable"), *[F.col(n) for n in SEMANTICS], "mapping_raw_id").alias("d"))
    nothing = [F.lit(None).cast(mappings.schema[n].dataType).alias(n) for n in SEMANTICS]
    dropped = dismissals.select("event_id", F.col("mapping_raw_id").alias("at"), F.struct(
        F.lit(False).alias("usable"), *nothing, "mapping_raw_id").alias("d"))
    rows = listed.unionByName(mapped.unionByName(dropped), allowMissingColumns=True)
    cut = id_slices("at", slice_rows)
    rows = running(rows, ["event_id"], ["at"], {"listing": last(F.col("c")), "decision": last(F.col("d"))}, cut, restart=True)
    names = ["usable", *SEMANTICS, "mapping_raw_id"]
    pick = [F.when(F.col("decision").isNotNull(), F.col(f"decision.{n}")).otherwise(F.col(f"listing.{n}")).alias(n) for n in names]
    rows = rows.select("event_id", "at", F.struct(*pick).alias("p")).withColumn("meaning", F.sha2(F.to_json("p"), 256))
    rows = running(rows, ["event_id"], ["at"], {"before": last(F.col("meaning"), inclusive=False)}, cut, restart=True)
    changes = rows.filter(~F.col("meaning").eqNullSafe(F.col("before"))).select("event_id", "at", "p")
    changes = running(changes, ["event_id"], ["at"], {"next": Run("last", F.col("at"), inclusive=False)}, cut, reverse=True, restart=True)
    return changes.filter("p.usable").select(
        "event_id", F.col("at").alias("valid_from"), F.coalesce("next", F.lit(2**63 - 1)).alias("valid_to"), *[F.col(f"p.{n}") for n in (*SEMANTICS, "mapping_raw_id")])


#: Types of the thresholds a session may name, with the values each may have.
_WHOLE, _SHARE = "bigint", "double"
_THRESHOLDS = {n: (_SHARE, lambda v: (v > 0) & (v <= 1)) if n == "max_pm_spread" else (_WHOLE, lambda v: v >= 0) if n == "max_expiry_offset_hours" else (_WHOLE, lambda v: v >= 1)
               for n in O.Limits.NAMES}


def session_thresholds(payload: Column) -> Column:
    """The thresholds that a session packet names, as one struct; those it does not name, or that may not be so, are null."""
    told = F.from_json(F.get_json_object(payload, "$.config"), ", ".join(f"{n} {kind}" for n, (kind, _) in _THRESHOLDS.items()))
    return F.struct(*[F.when(fits(told[n]), told[n]).alias(n) for n, (_, fits) in _THRESHOLDS.items()])


def observe_tape(tape: DataFrame, config: Config = Config(), slice_rows: int = ID_SLICE) -> tuple[DataFrame, DataFrame]:
    """Priced observations of a raw tape, and its malformed packets with their ``error``.

    ``tape``: id, received_ms, kind, source, subject, source_ms, payload. Malformed packets change nothing. Books, spots and option packets
    pass acceptance; an equity chain also brings its spot. Every proposition is observed while one of its versions holds, by the thresholds
    of the session the packet belongs to (those the session leaves open are ``config``'s), and ``input_refs`` names the packets behind each observation,
    the operator's mapping included. How many propositions are worth observing is a question of its own (``select_events``).

    A packet meets the versions in force at its place on the tape only (``version_fanout``); what their legs were before is one row per version
    (``leg_starts``). Rows swept grow with the observations, however many versions the tape holds. The sweep and the pricing run when
    the observations are read: store them before reading them more than once.
    """
    sound, errors = feeds.quarantine(tape)
    specs = {"now_ms": highest(F.col("received_ms")), "thresholds": last(F.when(F.col("kind") == "session", session_thresholds(F.col("payload"))))}
    sound = stage_table(running(sound, [], ["id"], specs, id_slices("id", slice_rows), restart=True), "tape")
    of = lambda *kinds: sound.filter(F.col("kind").isin(*kinds))
    top = sound.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    tolerance = config.scaled(config.clock_tolerance_ms)

    listings = EV.infer_event(feeds.explode_catalog(of("catalog")))
    listings = stage_table(listings.select("event_id", "catalog_raw_id", "catalog_received_ms", "pm_indicative", "active", *SEMANTICS), "listings")
    mappings = mapping_packets(of("mapping"))
    dismissals = of("dismiss").select(F.get_json_object("payload", "$.event_id").alias("event_id"), F.col("id").alias("mapping_raw_id"))
    versions = stage_table(proposition_versions(listings, mappings, dismissals, slice_rows), "versions")

    quotes = stage_table(feeds.explode_books(of("pm")).drop("depth"), "book-changes")
    books = legs.book_state(quotes, tolerance, slice_rows).withColumnRenamed("token", "yes_token")
    options = of("options")
    accepted = stage_table(legs.accepted_chains(options, tolerance, slice_rows), "accepted-chains")
    summary = feeds.explode_chain(accepted.filter("source <> 'yahoo'"))
    equity = feeds.explode_equity_chain(accepted.filter("source = 'yahoo'"))
    shared = ["id", "asset", "venue", "received_ms", "packet_source_ms", "expiry", "pos", "option_type", "strike", "bid", "ask", "mark", "iv"]
    contracts = summary.select(*shared, "forward").unionByName(equity.select(*shared), allowMissingColumns=True)
    snapshots = legs.surface_snapshots(summary).unionByName(legs.surface_snapshots(equity).drop("market_state"))
    spots = legs.spot_state(of("spot"), tolerance, slice_rows).unionByName(legs.chain_spots(equity), allowMissingColumns=True)
    histories = legs.path_history(history_packets(of("history")))
    refreshed = listings.select("event_id", F.col("catalog_raw_id").alias("raw_id"), F.col("catalog_received_ms").alias("received_ms"), "pm_indicative")
    bare = lambda df, subject: df.select(F.col("id").alias("raw_id"), "now_ms", "kind", subject.alias("subject"))
    unused = options.join(snapshots.select(F.col("raw_id").alias("id")).distinct(), "id", "left_anti")
    triggers = bare(of("catalog", "timer"), F.lit(None).cast("string")).unionByName(bare(unused, F.col("subject"))).unionByName(
        bare(of("mapping"), F.get_json_object("payload", "$.event_id")))

    changes = stage_table(O.leg_rows(books.drop("timestamp_origin"), refreshed, spots.drop("timestamp_origin"), histories, triggers), "leg-changes")
    snapshots, contracts = stage_table(snapshots, "snapshots"), stage_table(contracts, "contracts")
    packets = changes.unionByName(O.option_packets(snapshots), allowMissingColumns=True)
    # The thresholds join the packets, which are fewer and narrower than the observations made of them.
    packets = packets.join(sound.select(F.col("id").alias("raw_id"), "thresholds"), "raw_id")
    fanned = stage_table(O.version_fanout(packets, versions, top, slice_rows), "fanned")
    chained = F.col("__all").isNotNull()
    # The sweep reads its rows twice; most of them are stored already, so only the others are stored for it.
    covered = O.covering_rows(fanned.filter(chained), contracts).unionByName(
        O.leg_starts(versions, changes, snapshots, contracts, slice_rows), allowMissingColumns=True)
    rows = fanned.filter(~chained).drop("__all").unionByName(stage_table(covered, "covered"), allowMissingColumns=True)
    rows = rows.withColumn("__event", F.col("event_id")).withColumn("event_id", F.concat_ws("@", "event_id", "valid_from"))
    swept = O.sweep_legs(rows, slice_rows, restart=False)
    # The spot of an equity chain is the same packet as its options.
    own_spot = (F.col("kind") == "spot") & (F.col("spot_leg.venue") == "yahoo") & (F.col("spot_leg.ref") == F.col("raw_id"))
    swept = swept.withColumn("event_id", F.col("__event")).withColumn("kind", F.when(own_spot, "options").otherwise(F.col("kind"))).drop("__event")

    limits = O.Limits(config, "thresholds")
    out = O.price_observation(O.flat_legs(O.pm_leg(swept, limits)), limits)
    refs = {"catalog": "catalog_ref", "mapping": "mapping_raw_id", "pm": "pm_ref", "options": "options_ref", "spot": "spot_ref", "history": "history_ref"}
    named = F.create_map(*[x for name, column in refs.items() for x in (F.lit(name), F.col(column))])
    out = out.withColumn("input_refs", F.map_filter(named, lambda k, v: v.isNotNull())).drop("valid_from", "valid_to", "thresholds")
    return out, errors


def observe_from_tape(tape: DataFrame, config: Config = Config(), slice_rows: int = ID_SLICE) -> DataFrame:
    """The observations of ``observe_tape``."""
    return observe_tape(tape, config, slice_rows)[0]
