"""From packets to observations: fan-out, as-of legs, quality gate, implied probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import pricing as P
from ..functions.scalars import as_probability
from . import surface as SF
from .asof import asof_join
from .running import ID_SLICE, SLICE, highest, id_slices, last, running

# --- fixed values: which packets re-observe which propositions ----------------------
BY_ASSET = ("spot", "options", "history")
BY_TOKEN = ("pm",)
BY_EVENT = ("mapping", "listing")
ALL_EVENTS = ("catalog", "timer")
# --------------------------------------------------------------------------------------


class Limits:
    """Thresholds as columns: those of a config, or where a struct ``column`` of the rows names them, the row's own."""

    #: the thresholds that pricing reads
    NAMES = ("yahoo_seconds", "pm_max_age_ms", "gamma_max_age_ms", "options_max_age_ms", "spot_max_age_ms", "history_max_age_ms",
             "max_expiry_offset_hours", "max_pm_spread", "time_scale")

    def __init__(self, config: Config = Config(), column: str | None = None) -> None:
        self.config, self.column = config, column

    def value(self, name: str) -> Column:
        fixed = F.lit(getattr(self.config, name))
        return fixed if self.column is None else F.coalesce(F.col(self.column)[name], fixed)

    def age(self, name: str) -> Column:
        """A length of time in tape milliseconds."""
        return self.value(name) * self.value("time_scale")

    def equity_age(self) -> Column:
        return F.greatest(self.value("yahoo_seconds") * 2000, F.lit(90_000)) * self.value("time_scale")


def _limits(config: Config | Limits) -> Limits:
    return config if isinstance(config, Limits) else Limits(config)


def _scoped(tape: DataFrame, salts: int) -> DataFrame:
    """Packets with the key space and the key by which propositions are found; a salt where all are concerned."""
    kind = F.col("kind")
    scope = (F.when(kind.isin(*BY_ASSET), "asset").when(kind.isin(*BY_TOKEN), "token")
             .when(kind.isin(*BY_EVENT), "event").when(kind.isin(*ALL_EVENTS), "all"))
    key = F.when(scope == "all", F.pmod("raw_id", F.lit(salts)).cast("string")).otherwise(F.col("subject"))
    return tape.withColumn("__scope", scope).withColumn("__key", key)


def _keyed(scope: str, key: Column) -> Column:
    return F.struct(F.lit(scope).alias("__scope"), key.alias("__key"))


def _own_keys() -> Column:
    return F.array(_keyed("asset", F.col("asset")), _keyed("token", F.col("yes_token")), _keyed("event", F.col("event_id")))


def _salt_keys(salts: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: _keyed("all", i.cast("string")))


def trigger_fanout(tape: DataFrame, events: DataFrame, salts: int = 16) -> DataFrame:
    """One row per (packet, proposition it re-observes).

    ``tape``: raw_id, kind, subject (asset, token or event id) and pass-through
    columns. Every packet class is one key space of a single equi-join; the key
    of packets that concern all propositions is salted, so that it spreads over
    ``salts`` partitions when the proposition set is too large to broadcast.
    """
    keys = events.withColumn("__k", F.explode(F.concat(_own_keys(), _salt_keys(salts))))
    keys = keys.select("__k.*", *events.columns).filter(F.col("__key").isNotNull())
    return _scoped(tape, salts).join(keys, ["__scope", "__key"]).drop("__scope", "__key", "subject")


def version_fanout(packets: DataFrame, versions: DataFrame, top: int, slice_rows: int = ID_SLICE, salts: int = 16) -> DataFrame:
    """One row per packet and version in force that it concerns: an interval join by tape position.

    ``packets``: raw_id, seq, kind, subject and pass-through columns; ``versions``: event_id, valid_from, valid_to, asset, yes_token, ...;
    ``top`` is the highest id of the tape. Versions are entered in the slices of the tape that they cover, once per key and proposition, so a
    packet meets only propositions alive around it. Which version of them holds is one sweep in tape order over packets and version changes;
    packets and versions are never paired.
    """
    cut = lambda c: F.floor(c / F.lit(slice_rows))
    covered = F.sequence(cut(F.col("valid_from")), F.least(cut(F.col("valid_to") - 1), F.lit(top // slice_rows)))
    alive = versions.filter(F.col("valid_from") <= top).select("event_id", "asset", "yes_token", F.explode(covered).alias(SLICE))
    own = alive.select("event_id", SLICE, F.explode(_own_keys()).alias("__k"))
    everyone = alive.select("event_id", SLICE).distinct().select("event_id", SLICE, F.explode(_salt_keys(salts)).alias("__k"))
    keys = own.unionByName(everyone).select("event_id", SLICE, "__k.*").filter(F.col("__key").isNotNull()).distinct()
    rows = _scoped(packets, salts).withColumn(SLICE, cut(F.col("raw_id"))).join(keys, ["__scope", "__key", SLICE])

    said = F.struct(*[F.col(c) for c in versions.columns if c != "event_id"])
    begins = versions.select("event_id", F.col("valid_from").alias("raw_id"), F.lit(-1).alias("seq"), said.alias("__v"))
    ends = versions.filter(F.col("valid_to") <= top).select("event_id", F.col("valid_to").alias("raw_id"), F.lit(-2).alias("seq"))
    marks = begins.unionByName(ends, allowMissingColumns=True).withColumn("__mark", F.lit(True)).withColumn(SLICE, cut(F.col("raw_id")))
    both = rows.unionByName(marks, allowMissingColumns=True)
    swept = running(both, ["event_id"], ["raw_id", "seq"], {"__now": last(F.when(F.col("__mark"), F.struct("__v")))}, SLICE, restart=True)
    holds = F.col("__now.__v")
    fits = F.when(F.col("__scope") == "asset", holds["asset"] == F.col("subject")).when(F.col("__scope") == "token", holds["yes_token"] == F.col("subject")).otherwise(F.lit(True))
    return swept.filter(F.col("__mark").isNull() & holds.isNotNull() & fits).select(*packets.drop("subject").columns, "event_id", "__now.__v.*")


def session_config_asof(packets: DataFrame, sessions: DataFrame, values: list[str], slice_rows: int = ID_SLICE) -> DataFrame:
    """The session settings in force at each packet (as of the tape position)."""
    return asof_join(packets, sessions, [], "raw_id", "session_raw_id", values, slice_width=slice_rows)


# --- fixed order of the rows of one packet: listings first, then its state changes ---
_SEQUENCE = {"listing": 0, "history": 1, "options": 2, "spot": 3, "pm": 4}
# --------------------------------------------------------------------------------------


def leg_rows(books: DataFrame, listings: DataFrame, spots: DataFrame, histories: DataFrame, triggers: DataFrame) -> DataFrame:
    """State changes and bare triggers as one packet-shaped frame.

    Each row names what it concerns (``kind``, ``subject``) and carries one leg as
    a struct. Listings refresh the indicative price without an observation of
    their own; ``triggers`` (catalog, timer, mapping, unusable options) carry none.
    """
    def part(df: DataFrame, kind: str, subject: str) -> DataFrame:
        # The effective clock where the state carries it, else receipt time.
        now = "now_ms" if "now_ms" in df.columns else "received_ms"
        skip = {"raw_id", subject, "now_ms"}
        leg = F.struct(F.col("raw_id").alias("ref"), *[c for c in df.columns if c not in skip])
        return df.select("raw_id", F.col(now).alias("now_ms"), F.lit(kind).alias("kind"), F.col(subject).alias("subject"),
                         F.lit(_SEQUENCE[kind]).alias("seq"), leg.alias(kind))

    if "message_no" in books.columns:
        # Several changes of a token in one packet are one observation of its last state.
        at = F.struct("message_no", "change_no")
        books = books.groupBy("raw_id", "yes_token").agg(
            F.max_by(F.struct(*[c for c in books.columns if c not in ("raw_id", "yes_token", "message_no", "change_no", "depth")]), at).alias("b")
        ).select("raw_id", "yes_token", "b.*")
    bare = triggers.select("raw_id", "now_ms", "kind", "subject", F.lit(5).alias("seq"))
    parts = [part(books, "pm", "yes_token"), part(listings, "listing", "event_id"), part(spots, "spot", "asset"),
             part(histories, "history", "asset"), bare]
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows


def surface_rows(snapshots: DataFrame, contracts: DataFrame | None, events: DataFrame) -> DataFrame:
    """Option packets per proposition: the nearest covering expiry and, with ``contracts``, its strike neighbourhood.

    Of the expiries in one packet only the smallest at or after the event's can
    ever cover it, so each (packet, proposition) keeps one.
    """
    rows = trigger_fanout(option_packets(snapshots), events)
    return covering_rows(rows, contracts)


def option_packets(snapshots: DataFrame) -> DataFrame:
    """A packet per asset and option packet, with its expiries in ``__all``."""
    per_packet = snapshots.groupBy("asset", "raw_id").agg(
        F.first("received_ms").alias("now_ms"),
        F.array_sort(F.collect_list(F.struct("expiry", "venue", "received_ms", "source_ms", "forward"))).alias("__all"))
    return per_packet.withColumn("kind", F.lit("options")).withColumn("seq", F.lit(_SEQUENCE["options"])).withColumnRenamed("asset", "subject")


def covering_rows(rows: DataFrame, contracts: DataFrame | None) -> DataFrame:
    """Option packets of propositions with ``surface``: the nearest covering expiry of ``__all`` and its strike neighbourhood."""
    covering = F.filter("__all", lambda s: s["expiry"] >= F.col("expiry"))
    rows = rows.withColumn("__s", F.get(covering, F.lit(0))).withColumn("__expiry", F.col("__s.expiry")).drop("__all")
    return _with_surface(rows, contracts)


def _with_surface(rows: DataFrame, contracts: DataFrame | None, packet: str = "raw_id") -> DataFrame:
    told = [(-F.col("__expiry")).alias("nearness"), F.col(packet).alias("ref"), F.col("__expiry").alias("expiry"), "__s.venue",
            "__s.received_ms", "__s.source_ms", "__s.forward"]
    if contracts is None:
        return rows.withColumn("surface", F.when(F.col("__expiry").isNotNull(), F.struct(*told))).drop("__s", "__expiry")
    calls = contracts.filter("option_type = 'call'") if "option_type" in contracts.columns else contracts
    listed = calls.select(F.col("id").alias(packet), F.col("expiry").alias("__expiry"), "pos", "strike", "bid", "ask", "mark", "iv")
    uncovered = rows.filter(F.col("__expiry").isNull())
    rows = SF.strike_neighborhood(rows.filter(F.col("__expiry").isNotNull()), listed, [packet, "__expiry"])
    rows = rows.withColumn("surface", F.struct(*told, "below", "above", "near")).drop("below", "above", "near").unionByName(uncovered, allowMissingColumns=True)
    return rows.drop("__s", "__expiry")


def leg_starts(versions: DataFrame, changes: DataFrame, snapshots: DataFrame, contracts: DataFrame, slice_rows: int = ID_SLICE) -> DataFrame:
    """A row of kind ``start`` per version with the state its legs had just before it: one as-of join per leg, over versions only.

    ``changes`` are the rows of ``leg_rows``.
    """
    rows = versions.withColumn("raw_id", F.col("valid_from"))
    for kind, on in (("pm", ["yes_token"]), ("listing", ["event_id"]), ("spot", ["asset"]), ("history", ["asset", "window_start"])):
        state = changes.filter(F.col("kind") == kind).select(F.col("raw_id").alias("__at"), F.col("subject").alias(on[0]), kind)
        state = state.withColumn("window_start", F.col("history.window_start")) if kind == "history" else state
        rows = asof_join(rows, state, on, "raw_id", "__at", [kind], strict=True, slice_width=slice_rows, restart=True)
    # Of the expiries seen before the version, the smallest that covers it; of that, the newest snapshot.
    seen = snapshots.groupBy("asset", F.col("expiry").alias("__expiry")).agg(F.min("raw_id").alias("__first"))
    nearest = versions.select("event_id", "valid_from", "asset", "expiry").join(seen, "asset").filter(
        (F.col("__expiry") >= F.col("expiry")) & (F.col("__first") < F.col("valid_from"))).groupBy("event_id", "valid_from").agg(F.min("__expiry").alias("__expiry"))
    rows = rows.join(nearest, ["event_id", "valid_from"], "left")
    told = snapshots.select("asset", F.col("expiry").alias("__expiry"), F.col("raw_id").alias("__packet"), F.struct("venue", "received_ms", "source_ms", "forward").alias("__s"))
    rows = asof_join(rows, told, ["asset", "__expiry"], "raw_id", "__packet", ["__s", "__packet"], strict=True, slice_width=slice_rows, restart=True)
    rows = _with_surface(rows, contracts, "__packet").drop("__packet")
    return rows.withColumns({"kind": F.lit("start"), "seq": F.lit(-1)})


def sweep_legs(rows: DataFrame, slice_rows: int = ID_SLICE, restart: bool = True) -> DataFrame:
    """The newest state of every leg at each packet of each proposition.

    Every change of a leg is itself a packet of the propositions it concerns, so
    all as-of lookups are one sweep per proposition in tape order: one shuffle
    for any number of legs. The surface kept is the newest of the smallest
    covering expiry seen so far. ``restart`` as in ``running``.
    """
    rows = rows.withColumn(SLICE, id_slices("raw_id", slice_rows))
    order = ["raw_id", "seq"]
    matching = F.when(F.col("history.window_start") == F.col("window_start"), F.col("history"))
    swept = running(rows, ["event_id"], order, {
        "book": last(F.col("pm")), "indicative": last(F.col("listing")), "spot_leg": last(F.col("spot")),
        "path": last(matching), "covering": highest(F.col("surface"))}, SLICE, restart=restart, beside={"__next": F.lead("raw_id")})
    swept = swept.filter(
        (F.col("__next").isNull() | (F.col("__next") != F.col("raw_id"))) & ~F.col("kind").isin("listing", "start"))
    return swept.drop("pm", "listing", "spot", "history", "surface", "seq", SLICE, "__next")


def pm_leg(swept: DataFrame, config: Config | Limits = Config()) -> DataFrame:
    """The prediction-market side of each observation.

    The book's mid counts while a book exists and is within its age limit, even
    if crossed; otherwise the catalog's indicative price, where there is one.
    """
    b, c = F.col("book"), F.col("indicative")
    too_old = b.isNull() | (F.col("now_ms") - b["source_ms"] > _limits(config).age("pm_max_age_ms"))
    swept = swept.withColumn("__f", F.coalesce(too_old & c["pm_indicative"].isNotNull(), F.lit(False)))
    choose = lambda indicative, book: F.when(F.col("__f"), indicative).otherwise(book)
    nothing = F.lit(None).cast("double")
    return swept.withColumns({
        "pm_yes": choose(c["pm_indicative"], b["yes"]),
        "pm_bid": choose(nothing, b["bid"]),
        "pm_ask": choose(nothing, b["ask"]),
        "pm_crossed": choose(F.lit(False), F.coalesce(b["crossed"], F.lit(False))),
        "pm_timestamp": choose(c["received_ms"], b["source_ms"]),
        "pm_ref": choose(c["ref"], b["ref"]),
        "pm_source": choose(F.lit("gamma_indicative"), F.when(b.isNotNull(), "clob_mid")),
        "catalog_ref": c["ref"],
    }).drop("__f", "book", "indicative")


def flat_legs(rows: DataFrame) -> DataFrame:
    """Surface, spot and path structs as the flat columns the pricing reads."""
    o, s, h = F.col("covering"), F.col("spot_leg"), F.col("path")
    strikes = [n for n in ("below", "above", "near") if n in rows.schema["covering"].dataType.names]
    return rows.withColumns({
        **{n: o[n] for n in strikes},
        "opt_expiry": o["expiry"], "options_ref": o["ref"], "opt_venue": o["venue"], "options_received_ms": o["received_ms"],
        "opt_timestamp": o["source_ms"], "forward": o["forward"],
        "spot": s["price"], "spot_timestamp": s["source_ms"], "spot_venue": s["venue"], "market_state": s["market_state"],
        "spot_ref": s["ref"], "history_low": h["low"], "history_high": h["high"], "history_error": h["error"],
        "history_received_ms": h["received_ms"], "history_ref": h["ref"],
    }).drop("covering", "spot_leg", "path")


def quality_gate(config: Config | Limits = Config()) -> tuple[Column, Column]:
    """(state, flag) of the first failing check, both null when all pass."""
    c, now = F.col, F.col("now_ms")
    age_ok = lambda at, limit: F.coalesce((now - at).between(F.lit(0), limit), F.lit(False))
    limits = _limits(config)
    equity = F.coalesce(c("opt_venue") == "yahoo", F.lit(False))
    pm_limit = F.when(c("pm_source") == "gamma_indicative", limits.age("gamma_max_age_ms")).otherwise(limits.age("pm_max_age_ms"))
    opt_limit = F.when(equity, limits.equity_age()).otherwise(limits.age("options_max_age_ms"))
    spot_limit = F.when(c("spot_venue") == "yahoo", limits.equity_age()).otherwise(limits.age("spot_max_age_ms"))
    offset = c("opt_expiry") - c("expiry")
    cascade = [
        (c("mapping_review") == "MISMATCH", "MISMATCH", "OPERATOR_REJECTED_MAPPING"),
        (F.coalesce("expiry", F.lit(0)) <= now, "ENDED", "EVENT_CUTOFF_PASSED"),
        (c("pm_crossed"), "BAD_QUOTE", "CROSSED_PM_BOOK"),
        (as_probability(c("pm_yes")).isNull(), "WAIT", "MISSING_PM"),
        (~age_ok(c("pm_timestamp"), pm_limit), "STALE", "PM_AGE_LIMIT"),
        (c("options_ref").isNull(), "WAIT", "MISSING_OPTIONS"),
        (~age_ok(c("options_received_ms"), opt_limit) | ~age_ok(F.coalesce("opt_timestamp", "options_received_ms"), opt_limit),
         "STALE", "OPTIONS_AGE_LIMIT"),
        (~offset.between(F.lit(0), limits.value("max_expiry_offset_hours") * 3_600_000), "CUTOFF", "OPTION_EXPIRY_DOES_NOT_COVER_EVENT"),
        (c("spot").isNull() | (c("spot") <= 0), "WAIT", "MISSING_SPOT"),
        (~age_ok(c("spot_timestamp"), spot_limit) & ~market_closed(), "STALE", "SPOT_AGE_LIMIT"),
    ]
    pick = lambda i: F.coalesce(*[F.when(row[0], F.lit(row[i])) for row in cascade])
    return pick(1), pick(2)


def market_closed() -> Column:
    return F.coalesce((F.col("opt_venue") == "yahoo") & (F.col("market_state") == "CLOSED"), F.lit(False))


EQUITY_FLAGS = (
    "YAHOO_DELAY_UNKNOWN", "EQUITY_SESSION_CLOSE_PROXY", "AMERICAN_OPTION_PROXY", "ZERO_DIVIDEND_PROXY",
    "OVERNIGHT_JUMP_MODEL_LIMIT",
)


def price_observation(rows: DataFrame, config: Config | Limits = Config()) -> DataFrame:
    """State, flags, method, confidence and implied probability of assembled rows.

    ``rows`` hold the proposition, its legs and the strike neighbourhood. The
    gate decides first; then an exact-expiry terminal proposition uses the call
    spread, a touch proposition the barrier formula over its path history, and
    any other the flat-volatility terminal formula.
    """
    c = F.col
    state, flag = quality_gate(config)
    rows = rows.withColumn("__gate", state).withColumn("__gate_flag", flag)
    spread = SF.finite_spread(c("below"), c("above"))
    offset = c("opt_expiry") - c("expiry")
    exact = (offset == 0) & (c("event_type") == "terminal")
    up, touch = c("direction") == "up", c("event_type") == "touch"
    rows = rows.withColumns({
        "__offset": offset,
        "__digital": F.coalesce(exact & spread["present"], F.lit(False)),
        "__digital_error": spread["error"], "__digital_q": spread["probability"], "__width": spread["width"],
        "__complete": spread["complete"], "__center": spread["center"], "iv": SF.local_iv(c("near")),
        "local_iv": SF.nearest_iv(c("near")), "local_iv_skew": SF.iv_skew(c("near")),
        "pm_spread": c("pm_ask") - c("pm_bid"),
    })
    digital, passed = c("__digital"), c("__gate").isNull()
    window_missing = c("window_start").isNull() | (c("window_start") > c("now_ms"))
    path_missing = (c("history_ref").isNull() | F.coalesce("history_error", F.lit(True))
                    | (c("now_ms") - c("history_received_ms") > _limits(config).age("history_max_age_ms")))
    crossed = F.when(up, c("history_high") >= c("strike_or_threshold")).otherwise(c("history_low") <= c("strike_or_threshold"))
    # One reason per row, in the order the checks apply after the gate.
    model_state = (
        F.when(digital & c("__digital_error").isNotNull(), F.struct(F.lit("BAD_QUOTE").alias("state"), c("__digital_error").alias("flag")))
        .when(~digital & c("iv").isNull(), F.struct(F.lit("WAIT").alias("state"), F.lit("MISSING_IMPLIED_VOLATILITY").alias("flag")))
        .when(~digital & touch & window_missing, F.struct(F.lit("HISTORY").alias("state"), F.lit("UNKNOWN_OR_FUTURE_PATH_WINDOW").alias("flag")))
        .when(~digital & touch & path_missing, F.struct(F.lit("HISTORY").alias("state"), F.lit("MISSING_COMPLETE_CURRENT_PATH").alias("flag")))
        .when(~digital & touch & crossed, F.struct(F.lit("VERIFY_HIT").alias("state"), F.lit("REFERENCE_HISTORY_CROSSED_BARRIER_CHECK_RULES").alias("flag")))
    )
    years = (c("expiry") - c("now_ms")) / F.lit(float(P.YEAR_MS))
    args = (c("spot"), c("strike_or_threshold"), c("iv"), c("__years"), c("direction"))
    rows = P.with_terminal_probability(rows.withColumn("__years", years), "__terminal", *args)
    rows = P.with_touch_probability(rows, "__touch", *args)
    model_q = F.when(touch, c("__touch")).otherwise(c("__terminal"))
    digital_q = F.when(up, c("__digital_q")).otherwise(1 - c("__digital_q"))
    rows = rows.withColumn("__model", F.when(passed, model_state)).withColumn(
        "__q", F.when(passed & c("__model").isNull(), as_probability(F.when(digital, digital_q).otherwise(model_q))))
    priced = passed & c("__model").isNull()
    limit_hit = priced & c("__q").isNull()
    modeled = passed & ~digital & c("iv").isNotNull()
    tail = priced & ((c("__q") < 0.01) | (c("__q") > 0.99))
    venue = F.lower(F.coalesce("settlement_source", F.lit("")))
    wide = F.coalesce("pm_ask", F.lit(0.0)) - F.coalesce("pm_bid", F.lit(0.0)) > _limits(config).value("max_pm_spread")
    equity = F.coalesce(c("opt_venue") == "yahoo", F.lit(False))
    flags = F.array_compact(F.array(
        c("__gate_flag"),
        F.when(passed & ~F.coalesce(c("mapping_review") == "VERIFIED", F.lit(False)), "UNVERIFIED_SETTLEMENT_SEMANTICS"),
        F.when(passed & (venue != "") & (venue != F.lower(F.coalesce("spot_venue", F.lit("")))), "REFERENCE_SOURCE_PROXY"),
        *[F.when(passed & equity, name) for name in EQUITY_FLAGS],
        F.when(passed & market_closed(), "MARKET_CLOSED_LAST_SESSION_PRICES"),
        F.when(passed & (c("pm_source") == "gamma_indicative"), "INDICATIVE_PM_TIMESTAMP_IS_RETRIEVAL"),
        F.when(passed & wide, "WIDE_PM_BOOK"),
        F.when(digital, c("__model.flag")),
        F.when(passed & digital & c("__model").isNull(), "FINITE_SPREAD_REPLICATION_ERROR"),
        F.when(priced & digital & (c("__width") / c("spot") > 0.05), "SPARSE_STRIKES"),
        F.when(priced & digital & (F.abs(c("__center") - c("strike_or_threshold")) > c("__width") * 0.01), "ASYMMETRIC_STRIKE_BRACKET"),
        F.when(modeled, "FLAT_IV_MODEL"),
        F.when(~digital, c("__model.flag")),
        F.when(priced & ~digital & touch, "PATH_HISTORY_REFERENCE_PROXY"),
        F.when(priced & ~digital & (c("__offset") != 0), "EXPIRY_IV_PROXY"),
        F.when(limit_hit, "INVALID_TRANSFORM"),
        F.when(tail, "EXTREME_TAIL_MODEL_SENSITIVITY"),
        F.when(priced & c("__q").isin(0.0, 1.0), "MODEL_ENDPOINT"),
    ))
    spread_ok = passed & digital & c("__model").isNull()
    rows = rows.withColumns({
        "quality_flags": flags,
        "source_state": F.coalesce(
            c("__gate"), c("__model.state"), F.when(limit_hit, "MODEL_LIMIT"), F.when(market_closed(), "CLOSED"),
            F.when(F.size(flags) > 0, "PROXY").otherwise("OK")),
        "method": F.when(spread_ok, F.when(c("__complete"), "SPREAD").otherwise("MID"))
        .when(modeled, F.when(touch, "TOUCH").otherwise("IV")),
        "model_confidence": F.when(tail, "LOW").when(spread_ok, "MEDIUM").when(modeled, "LOW").otherwise("UNAVAILABLE"),
        "opt_yes": c("__q"),
        "gap_pp": P.gap_pp(c("pm_yes"), c("__q")),
        "relative_gap": P.relative_gap(c("pm_yes"), c("__q")),
        "side": P.gap_side(c("pm_yes"), c("__q")),
    })
    rows = rows.withColumn("valid", P.observation_valid(c("gap_pp"), c("source_state"), c("quality_flags")))
    return rows.drop(*[n for n in rows.columns if n.startswith("__")], "below", "above", "near")


def assemble_legs(
    events: DataFrame, books: DataFrame, listings: DataFrame, spots: DataFrame, snapshots: DataFrame, contracts: DataFrame | None,
    histories: DataFrame, triggers: DataFrame, config: Config = Config(), slice_rows: int = ID_SLICE,
) -> DataFrame:
    """Observation rows with every leg attached, not priced yet; without ``contracts`` the surfaces carry no strikes."""
    fanned = trigger_fanout(leg_rows(books, listings, spots, histories, triggers), events)
    rows = fanned.unionByName(surface_rows(snapshots, contracts, events), allowMissingColumns=True)
    return flat_legs(pm_leg(sweep_legs(rows, slice_rows), config))


def observe(*legs: DataFrame, config: Config = Config(), slice_rows: int = ID_SLICE) -> DataFrame:
    """Priced observations of every packet; arguments as ``assemble_legs``.

    Provenance of all legs is kept in ``input_refs``. Store the result before
    filtering on priced columns: a condition on a computed column would be pushed
    down and repeat the whole pricing expression.
    """
    rows = price_observation(assemble_legs(*legs, config=config, slice_rows=slice_rows), config)
    refs = F.map_filter(F.create_map(
        F.lit("catalog"), F.col("catalog_ref"), F.lit("pm"), F.col("pm_ref"), F.lit("options"), F.col("options_ref"),
        F.lit("spot"), F.col("spot_ref"), F.lit("history"), F.col("history_ref")), lambda k, v: v.isNotNull())
    return rows.withColumn("input_refs", refs)
