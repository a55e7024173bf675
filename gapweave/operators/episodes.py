"""Gap episodes: hysteresis sessions of one sign, computed with running positions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .running import SLICE, first, highest, id_slices, last, lowest, running, total

_ORDER = ["raw_id"]


def gap_episodes(obs: DataFrame, config: Config = Config(), slice_rows: int = 1_000_000) -> DataFrame:
    """Add the episode state around every observation.

    ``start_before`` / ``start_after`` are the opening packets of the episode
    that is active before and after the row, ``close_reason`` says why the row
    closed the earlier one. A positive episode is active while the newest
    opening (gap >= open) is newer than the newest break (gap <= close, invalid,
    mapping change or expiry); negative episodes mirror it. Openings on a row
    that also changes the mapping or expires come after its break.
    """
    df = obs.withColumn(SLICE, id_slices("raw_id", slice_rows))
    # "-" stands for a missing hash so that null differs from a value only.
    mapping = F.coalesce("mapping_hash", F.lit("-"))
    earlier = F.struct(mapping.alias("mapping"), "pm_yes", "opt_yes", "gap_pp")
    df = running(df, ["event_id"], _ORDER, {"previous": last(earlier, inclusive=False)}, SLICE)
    df = df.withColumn("__mapping", F.col("previous.mapping"))
    changed = F.col("__mapping").isNotNull() & (F.col("__mapping") != mapping)
    expired = F.coalesce(F.col("expiry") <= F.col("now_ms"), F.lit(False))
    gap, row_id = F.col("gap_pp"), F.col("raw_id")
    df = df.withColumn("__hard", changed | expired).withColumn("__changed", changed).withColumn("__expired", expired)
    stop = F.col("__hard") | ~F.col("valid")

    def opens(sign: int) -> Column:
        return F.col("valid") & (gap * sign >= config.open_gap_pp)

    def breaks(sign: int) -> Column:
        return stop | (gap * sign <= config.close_gap_pp)

    specs = {}
    for name, sign in (("up", 1), ("dn", -1)):
        opening, breaking = F.when(opens(sign), row_id), F.when(breaks(sign), row_id)
        specs[f"__open_{name}"] = highest(opening, inclusive=False)
        specs[f"__break_{name}"] = highest(breaking, inclusive=False)
    df = running(df, ["event_id"], _ORDER, specs, SLICE, restart=True)

    def active_before(name: str) -> Column:
        return F.coalesce(F.col(f"__open_{name}") >= F.coalesce(F.col(f"__break_{name}"), F.lit(-1)), F.lit(False))

    sign_before = F.when(active_before("up"), 1).when(active_before("dn"), -1)
    df = df.withColumn("__sign", sign_before)
    closing = F.col("__sign").isNotNull() & (stop | (gap * F.col("__sign") <= config.close_gap_pp))
    df = df.withColumn("__closing", F.coalesce(closing, F.lit(False)))
    starting = F.col("valid") & (F.abs(gap) >= config.open_gap_pp) & (F.col("__sign").isNull() | F.col("__closing"))
    df = running(df.withColumn("__starting", starting), ["event_id"], _ORDER,
                 {"__start_prev": highest(F.when(F.col("__starting"), row_id), inclusive=False)}, SLICE, restart=True)
    reason = F.when(
        F.col("__closing"),
        F.when(F.col("__changed"), "MAPPING_CHANGED")
        .when(F.col("__expired"), "EXPIRED")
        .when(~F.col("valid"), "DATA_GAP")
        .when(gap * F.col("__sign") < 0, "REVERSAL")
        .otherwise("CONVERGENCE"),
    )
    before = F.when(F.col("__sign").isNotNull(), F.col("__start_prev"))
    after = F.when(F.col("__starting"), row_id).when(~F.col("__closing"), before)
    return df.select(
        *obs.columns, "previous", before.alias("start_before"), after.alias("start_after"), reason.alias("close_reason"))


def episode_revisions(rows: DataFrame, slice_rows: int = 1_000_000) -> DataFrame:
    """Every revision of every episode: NEW, PEAK, WIDENING, CONVERGING, CLOSED, EXPIRED.

    ``rows`` is the result of ``gap_episodes``, best written as a stage table first.

    Lifecycle figures are running values over the episode's rows; the closing
    revision repeats the last figures and adds time, gap and reason of the close.
    """
    gap, size = F.col("gap_pp"), F.abs(F.col("gap_pp"))
    # A row belongs to the episode it closes and to the one it continues or opens.
    roles = F.array_compact(F.array(
        F.when(F.col("close_reason").isNotNull(), F.struct(F.col("start_before").alias("opening_raw_id"), F.lit(True).alias("close"))),
        F.when(F.col("start_after").isNotNull(), F.struct(F.col("start_after").alias("opening_raw_id"), F.lit(False).alias("close"))),
    ))
    slim = ["event_id", "asset", "mapping_hash", "raw_id", "now_ms", "pm_yes", "opt_yes", "gap_pp", "relative_gap", "spot",
            "previous", "close_reason"]
    members = rows.select(*slim, F.explode(roles).alias("__role")).select(*slim, "__role.*").withColumn(
        SLICE, id_slices("raw_id", slice_rows))
    inside, is_new = ~F.col("close"), F.col("raw_id") == F.col("opening_raw_id")
    mine = lambda c: F.when(inside, c)
    step = lambda leg: F.when(
        inside & ~is_new, F.abs(F.col(leg) - F.col(f"previous.{leg}")) * 100).otherwise(0.0)
    members = running(members, ["event_id", "opening_raw_id"], _ORDER, {
        "__open": first(F.struct("now_ms", "gap_pp", "relative_gap", "spot", "mapping_hash")),
        "__before": highest(mine(size), inclusive=False),
        # equal sizes keep the earliest time
        "__peak": highest(mine(F.struct(size.alias("size"), (-F.col("now_ms")).alias("ms")))),
        "max_relative_gap": highest(mine(F.col("relative_gap"))),
        "min_gap_after_open": lowest(mine(gap)),
        "pm_distance_pp": total(step("pm_yes")),
        "opt_distance_pp": total(step("opt_yes")),
        "__spot": last(mine(F.struct("spot", is_new.alias("new")))),
    }, SLICE, restart=True)
    distance = F.col("pm_distance_pp") + F.col("opt_distance_pp")
    only_opened = F.col("__spot.new")
    share = lambda c: F.when(only_opened, 0.0).when(distance > 0, F.col(c) / distance)
    has_spot = (F.col("__spot.spot") != 0) & (F.col("__open.spot") != 0)
    closed = lambda c: F.when(F.col("close"), c)
    return members.select(
        F.concat(F.lit("gap-"), "event_id", F.lit("-"), F.col("opening_raw_id").cast("string")).alias("gap_event_id"),
        "event_id", "asset", F.col("__open.mapping_hash").alias("mapping_hash"), "raw_id", "opening_raw_id",
        F.col("__open.now_ms").alias("opened_at"), F.col("now_ms").alias("timestamp"),
        F.col("__open.gap_pp").alias("opening_gap_pp"), F.col("__open.relative_gap").alias("opening_relative_gap"),
        F.col("__peak.size").alias("max_abs_gap_pp"), "max_relative_gap",
        (-F.col("__peak.ms") - F.col("__open.now_ms")).alias("time_to_max_ms"), "min_gap_after_open",
        (F.col("now_ms") - F.col("__open.now_ms")).alias("duration_ms"),
        F.when(F.col("close"), F.when(F.col("close_reason") == "EXPIRED", "EXPIRED").otherwise("CLOSED"))
        .when(is_new, "NEW").when(size > F.col("__before"), "PEAK")
        .when(size > F.abs(F.col("previous.gap_pp")), "WIDENING").otherwise("CONVERGING").alias("state"),
        "pm_distance_pp", "opt_distance_pp", share("pm_distance_pp").alias("pm_travel"),
        share("opt_distance_pp").alias("opt_travel"),
        F.when(~only_opened & has_spot, F.col("__spot.spot") / F.col("__open.spot") - 1).alias("spot_move"),
        closed(F.col("now_ms")).alias("closing_time"), closed(gap).alias("closing_gap"),
        closed(F.col("close_reason")).alias("close_reason"),
    )


def latest_revision(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key (a map-side combined aggregate, no window)."""
    return revisions.groupBy(*keys).agg(
        F.max_by(F.struct(*[c for c in revisions.columns if c not in keys]), "raw_id").alias("__row")
    ).select(*keys, "__row.*").select(*revisions.columns)


def episode_summary(revisions: DataFrame) -> DataFrame:
    """Latest revision per gap event."""
    return latest_revision(revisions, ["gap_event_id"])
