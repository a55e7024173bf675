"""Rolling features of observations: anchors, multi-horizon changes, jumps, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from .asof import asof_join
from .running import SLICE, highest, id_slices, last, running, with_halo

KEY = ("event_id", "mapping_hash")
# --- fixed values: horizons in seconds, and the order in which one is diagnostic ---
HORIZONS = (1, 5, 15, 30, 60, 300, 900)
DIAGNOSTIC = (30, 15, 5, 1)
RETENTION_SECONDS = 7_200
# ------------------------------------------------------------------------------------


def tolerance_ms(seconds: int, config: Config) -> int:
    return config.scaled(max(1000, seconds * 200))


def second_anchors(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """Add ``is_anchor``: the row is the last of its (event, mapping, second)."""
    bucket = F.floor(F.col("now_ms") / F.lit(config.ms(1)))
    newest = F.max("raw_id").over(Window.partitionBy(*KEY, bucket))
    return obs.withColumn("is_anchor", F.col("raw_id") == newest)


def _halo_rows(obs: DataFrame, config: Config, lookback_s: int) -> DataFrame:
    """Rows with their look-back copies and the anchor flag, partitioned by (key, slice)."""
    bucket_ms, lookback = config.ms(1), config.ms(lookback_s)
    cut = with_halo(obs, "now_ms", 6 * lookback, lookback)
    bucket = F.floor(F.col("now_ms") / F.lit(bucket_ms))
    following = F.lead(bucket).over(Window.partitionBy(*KEY, SLICE).orderBy("raw_id"))
    return cut.withColumn("is_anchor", following.isNull() | (following != bucket))


def _reference(payload: Column, when: Column, offset_ms: int) -> Column:
    """Newest marked payload at least ``offset_ms`` old (a growing frame, linear cost)."""
    frame = Window.partitionBy(*KEY, SLICE).orderBy("now_ms").rangeBetween(Window.unboundedPreceding, -offset_ms)
    return F.last(F.when(when, payload), ignorenulls=True).over(frame)


def _change(name: str, seconds: int, config: Config) -> Column:
    past = F.col(name)
    age = F.col("now_ms") - past["now_ms"]
    found = F.col("valid") & past.isNotNull() & (age - config.ms(seconds) <= tolerance_ms(seconds, config))
    return F.when(
        found,
        F.struct(
            (F.col("gap_pp") - past["gap_pp"]).alias("gap_pp"),
            (F.lit(100.0) * (F.col("pm_yes") - past["pm_yes"])).alias("pm_pp"),
            (F.lit(100.0) * (F.col("opt_yes") - past["opt_yes"])).alias("opt_pp"),
            (age / config.ms(1)).alias("actual_seconds"),
            past["raw_id"].alias("reference_raw_id"),
        ),
    )


_PAST = ("now_ms", "gap_pp", "pm_yes", "opt_yes", "raw_id")


def horizon_changes(obs: DataFrame, config: Config = Config(), horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Add one ``change_<h>`` struct per horizon, against the newest valid anchor that old.

    Changes are GAP, PM and OPT percentage points, the seconds really elapsed
    and the reference packet. Look-back is bounded, so hot events are cut into
    time slices with a halo; all horizons share one shuffle.
    """
    rows = _halo_rows(obs, config, int(max(horizons) * 1.2) + 2)
    return _with_changes(rows, config, horizons).filter("__own").drop(SLICE, "__own")


def _with_changes(rows: DataFrame, config: Config, horizons: tuple[int, ...]) -> DataFrame:
    payload = F.struct(*_PAST)
    usable = F.col("is_anchor") & F.col("valid")
    kept = rows.columns
    rows = rows.select(
        "*", *[_reference(payload, usable, config.ms(h)).alias(f"__p{h}") for h in horizons]
    )
    return rows.select(*kept, *[_change(f"__p{h}", h, config).alias(f"change_{h}") for h in horizons])


def movement(rows: DataFrame, config: Config) -> DataFrame:
    """Velocity, travel shares and the widening of the diagnostic horizon."""
    diag = F.coalesce(*[F.col(f"change_{h}") for h in DIAGNOSTIC])
    travel = F.abs(diag["pm_pp"]) + F.abs(diag["opt_pp"])
    return rows.withColumn("__d", diag).select(
        *rows.columns,
        (F.col("__d.gap_pp") / F.col("__d.actual_seconds")).alias("velocity_pp_s"),
        F.col("__d.actual_seconds").alias("diagnostic_seconds"),
        F.col("__d.pm_pp").alias("pm_change_pp"),
        F.col("__d.opt_pp").alias("opt_change_pp"),
        F.when(travel > 0, F.abs(diag["pm_pp"]) / travel).alias("pm_travel"),
        F.when(travel > 0, F.abs(diag["opt_pp"]) / travel).alias("opt_travel"),
        (F.col("gap_pp") - F.col("__d.gap_pp")).alias("previous_gap_pp"),
    )


def trend_label(gap: Column, previous_gap: Column, seconds: Column, config: Config) -> Column:
    """REVERSING, STABLE, or OPENING / CLOSING with FAST above the speed limit."""
    widening = F.abs(gap) - F.abs(previous_gap)
    fast = F.abs(widening / seconds) >= config.fast_pp_per_second
    word = F.when(widening > 0, F.lit("OPENING")).otherwise(F.lit("CLOSING"))
    return (
        F.when(previous_gap.isNull(), "INSUFFICIENT")
        .when(previous_gap * gap < 0, "REVERSING")
        .when(F.abs(widening) <= config.stable_pp, "STABLE")
        .otherwise(F.concat(word, F.when(fast, F.lit(" FAST")).otherwise(F.lit(""))))
    )


def dynamics(obs: DataFrame, config: Config = Config(), horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """All rolling features of an observation in one shuffle.

    Anchors, horizon changes, velocity and travel, acceleration and spot return
    against the newest anchor with a velocity (at least a second old, at most
    two hours), and the trend label.
    """
    reach = RETENTION_SECONDS + max(int(max(horizons) * 1.2), 36) + 2
    rows = movement(_with_changes(_halo_rows(obs, config, reach), config, horizons), config)
    past = F.struct("now_ms", "velocity_pp_s", "spot")
    moving = F.col("is_anchor") & F.col("velocity_pp_s").isNotNull()
    rows = rows.withColumn("__v", _reference(past, moving, config.ms(1)))
    elapsed = F.col("now_ms") - F.col("__v.now_ms")
    has = F.col("velocity_pp_s").isNotNull() & (elapsed <= config.ms(RETENTION_SECONDS))
    rows = rows.withColumn(
        "acceleration_pp_s2",
        F.when(has, (F.col("velocity_pp_s") - F.col("__v.velocity_pp_s")) / (elapsed / config.ms(1))),
    ).withColumn(
        "spot_return",
        F.when(has & (F.col("__v.spot") != 0) & (F.col("spot") != 0), F.col("spot") / F.col("__v.spot") - 1),
    ).withColumn(
        "trend", trend_label(F.col("gap_pp"), F.col("previous_gap_pp"), F.col("diagnostic_seconds"), config)
    )
    return rows.filter("__own").drop(SLICE, "__own", "__v", "previous_gap_pp")


def native_jumps(
    obs: DataFrame, config: Config = Config(), indicative: Column | None = None, slice_rows: int = 1_000_000
) -> DataFrame:
    """Jumps of a leg between consecutive timed rows of an (event, mapping).

    A row that is invalid or indicative breaks timing: no change is taken across
    it and ``segment`` (the packet of the last break) moves on, so earlier jumps
    no longer count at analysis time.
    """
    timed = F.col("valid") if indicative is None else F.col("valid") & ~indicative
    df = obs.withColumn("__timed", timed)
    seen = F.struct("__timed", "pm_yes", "opt_yes", "spot")
    df = running(
        df, KEY, ["raw_id"],
        {"__prev": last(seen, inclusive=False), "segment": highest(F.when(~F.col("__timed"), F.col("raw_id")))},
        id_slices("raw_id", slice_rows),
    ).filter(F.col("__timed") & F.col("__prev.__timed"))
    return jump_legs(df, config)


def jump_legs(df: DataFrame, config: Config = Config()) -> DataFrame:
    """The legs of timed rows that moved by their limit or more against ``__prev``, the timed row before."""
    prev = F.col("__prev")
    spot_ok = (F.col("spot") > 0) & (prev["spot"] > 0)
    leg = lambda name, change, limit: F.struct(
        F.lit(name).alias("leg"), change.alias("change"), F.lit(float(limit)).alias("limit"))
    df = df.withColumn("__leg", F.explode(F.array(
        leg("pm", F.lit(100.0) * (F.col("pm_yes") - prev["pm_yes"]), config.event_jump_pp),
        leg("opt", F.lit(100.0) * (F.col("opt_yes") - prev["opt_yes"]), config.event_jump_pp),
        leg("spot", F.when(spot_ok, F.ln(F.col("spot") / prev["spot"])), config.spot_jump_return),
    ))).filter(F.abs(F.col("__leg.change")) >= F.col("__leg.limit"))
    return df.select(
        *KEY, "raw_id", F.col("now_ms").alias("timestamp"), "trigger_kind",
        F.coalesce("segment", F.lit(-1)).alias("segment"), "__leg.leg", "__leg.change",
    )


def live_jumps(obs: DataFrame, jumps: DataFrame, now_ms: int, config: Config = Config(),
               indicative: Column | None = None) -> DataFrame:
    """Jumps still on record at ``now_ms``: after the last break, at most two hours old."""
    timed = F.col("valid") if indicative is None else F.col("valid") & ~indicative
    breaks = obs.filter(F.col("now_ms") <= now_ms).groupBy(*KEY).agg(
        F.coalesce(F.max(F.when(~timed, F.col("raw_id"))), F.lit(-1)).alias("__break"))
    recent = jumps.filter(F.col("timestamp").between(now_ms - config.ms(RETENTION_SECONDS), now_ms))
    return recent.join(breaks, list(KEY)).filter(F.col("segment") == F.col("__break")).drop("__break")


def asof_grid(obs: DataFrame, now_ms: int, config: Config = Config(), points: int | None = None) -> DataFrame:
    """Regular causal samples of every event up to ``now_ms``.

    A point takes the newest anchor at most one step old; it must be valid and
    have a spot price. Only points after the last failing one remain: an outage
    is never bridged.
    """
    step = config.ms(config.analysis_grid_seconds)
    points = points or config.grid_points
    end = now_ms // step * step
    begin = end - (points - 1) * step
    recent = obs.filter(F.col("now_ms").between(begin - step, end))
    anchors = second_anchors(recent, config).filter("is_anchor").drop("is_anchor")
    current = obs.filter(F.col("now_ms") <= now_ms).groupBy("event_id").agg(
        F.max_by("mapping_hash", "raw_id").alias("mapping_hash"))
    targets = current.select(
        *KEY, F.explode(F.sequence(F.lit(begin), F.lit(end), F.lit(step))).alias("timestamp"))
    values = ["valid", "pm_yes", "opt_yes", "gap_pp", "spot", "opt_timestamp", "raw_id"]
    # At most one anchor per second and two hours of grid: the group is bounded.
    hit = asof_join(targets, anchors, KEY, "timestamp", "now_ms", values, ["raw_id"], tolerance=step)
    good = F.coalesce(F.col("valid") & (F.col("spot") != 0), F.lit(False))
    whole = Window.partitionBy(*KEY)
    broken = F.max(F.when(~good, F.col("timestamp"))).over(whole)
    return hit.withColumn("__broken", broken).filter(
        F.col("__broken").isNull() | (F.col("timestamp") > F.col("__broken"))).drop("__broken", "valid")


def usable_anchors(obs: DataFrame, now_ms: int, span_s: float, config: Config = Config()) -> DataFrame:
    """Rows with a usable spot among the per-second anchors of the last ``span_s`` seconds, of each event's current mapping.

    The anchor of a second is chosen before its usability is looked at: a second that ends in an unusable row has none.
    """
    current = obs.filter(F.col("now_ms") <= now_ms).groupBy("event_id").agg(F.max_by("mapping_hash", "raw_id").alias("__mapping"))
    begin = (now_ms - config.ms(span_s)) // config.ms(1) * config.ms(1)
    anchors = second_anchors(obs.filter(F.col("now_ms").between(begin, now_ms)), config).filter("is_anchor").drop("is_anchor")
    rows = anchors.join(current, "event_id").filter(F.col("mapping_hash").eqNullSafe(F.col("__mapping"))).drop("__mapping")
    return rows.filter((F.col("now_ms") >= now_ms - config.ms(span_s)) & F.col("source_state").isin("OK", "PROXY") & (F.col("spot") > 0))


def asof_returns(obs: DataFrame, now_ms: int, seconds: tuple[int, ...], tolerance_s: int,
                 config: Config = Config()) -> DataFrame:
    """Spot returns per event over several look-backs, from the usable anchors of its current mapping at ``now_ms``."""
    usable = usable_anchors(obs, now_ms, max(seconds) + tolerance_s, config)
    at = lambda s: F.max_by(
        F.struct("now_ms", "spot"),
        F.when(F.col("now_ms") <= now_ms - config.ms(s), F.struct("now_ms", "raw_id")))
    latest = obs.filter(F.col("now_ms") <= now_ms).groupBy("event_id").agg(
        F.max_by("spot", "raw_id").alias("__spot"))
    past = usable.groupBy("event_id").agg(*[at(s).alias(f"__p{s}") for s in seconds])
    fresh = lambda s: F.lit(now_ms - config.ms(s)) - F.col(f"__p{s}.now_ms") <= config.ms(tolerance_s)
    return latest.join(past, "event_id", "left").select(
        "event_id",
        *[F.when(fresh(s) & (F.col("__spot") > 0), F.col("__spot") / F.col(f"__p{s}.spot") - 1).alias(f"return_{s}")
          for s in seconds],
    )


def recording_gaps(points: DataFrame, limit_ms: int = 90_000, newest: int = 20,
                   slice_width_ms: int = 86_400_000) -> DataFrame:
    """Newest holes between consecutive points of one recorded series."""
    df = running(points, [], ["timestamp_ms", "id"], {"__prev": last(F.col("timestamp_ms"), inclusive=False)},
                 F.floor(F.col("timestamp_ms") / F.lit(slice_width_ms)))
    return df.select(
        F.col("__prev").alias("start"), F.col("timestamp_ms").alias("end"),
        (F.col("timestamp_ms") - F.col("__prev")).alias("duration_ms"),
    ).filter(F.col("duration_ms") > limit_ms).orderBy(F.col("end").desc()).limit(newest)
