"""Questions to the recorded tape: pages, latest rows, slices, verification, monitor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import CRYPTO_ASSETS
from ..sources.feeds import feed_health
from .curves import curve_groups, curve_nodes

MAX_PAGE = 10_000


def history(
    obs: DataFrame, event_id: str | None = None, start: int = 0, end: int | None = None, limit: int = 500,
    after: int | None = None, before: int | None = None, tail: bool = False, id_col: str = "raw_id", time: str = "now_ms",
) -> DataFrame:
    """One keyset page of at most ``MAX_PAGE`` rows in id order; ``tail`` takes the newest rows of the range."""
    if not 0 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be within 0..{MAX_PAGE}; read on with after or before")
    df = obs.filter(F.col(time) >= start)
    if event_id is not None:
        df = df.filter(F.col("event_id") == event_id)
    if end is not None:
        df = df.filter(F.col(time) <= end)
    if after is not None:
        df = df.filter(F.col(id_col) > after)
    if before is not None:
        df = df.filter(F.col(id_col) < before)
    if not tail:
        return df.orderBy(id_col, "event_id").limit(limit)
    return df.orderBy(F.col(id_col).desc(), F.col("event_id").desc()).limit(limit).orderBy(id_col, "event_id")


def latest_by(df: DataFrame, keys: Sequence[str], order: str = "raw_id") -> DataFrame:
    """Newest row per key, by a map-side combined aggregate."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def tape_stats(**tables: DataFrame) -> DataFrame:
    """True row counts and receipt span per table (each with a ``received_ms`` column)."""
    parts = [df.agg(F.count("*").alias("rows"), F.min("received_ms").alias("first_ms"), F.max("received_ms").alias("last_ms"))
             .select(F.lit(name).alias("table"), "*") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def episode_slice(obs: DataFrame, episode: DataFrame) -> DataFrame:
    """Rows of one episode's time span; ``episode`` is its summary row."""
    span = episode.select(
        "event_id", F.col("opened_at").alias("__from"), F.coalesce("closing_time", F.lit(2**63 - 1)).alias("__to"), "gap_event_id")
    return obs.join(span, "event_id").filter(F.col("now_ms").between(F.col("__from"), F.col("__to"))).drop("__from", "__to")


def verify_recompute(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Each stored row against its recomputation, with the names of differing fields.

    Rows present on one side only differ in ``missing_stored`` or ``missing_recomputed``. Map columns are equal when their
    entries are. ``carry`` names columns to keep of the stored row, else of the recomputed one.
    """
    keys = list(keys)

    def side(df: DataFrame, name: str) -> DataFrame:
        plain = [F.array_sort(F.map_entries(c)).alias(c) if dict(df.dtypes)[c].startswith("map") else F.col(c) for c in columns]
        return df.select(*keys, F.struct(*plain).alias(name), F.struct(F.lit(1).alias("__one"), *carry).alias(f"{name}_carry"))

    # A hash-partitioned full join.
    both = side(stored, "s").join(side(recomputed, "r"), keys, "full")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns]))
    fields = (F.when(F.col("s").isNull(), F.array(F.lit("missing_stored"))).when(F.col("r").isNull(), F.array(F.lit("missing_recomputed")))
              .otherwise(differs))
    return both.select(*keys, *[F.coalesce(f"s_carry.{c}", f"r_carry.{c}").alias(c) for c in carry], fields.alias("fields"))


def verification_report(compared: DataFrame, by: Column) -> DataFrame:
    """Checked and mismatching rows per version."""
    wrong = F.size("fields") > 0
    return compared.groupBy(by.alias("version")).agg(
        F.count("*").alias("checked"), F.sum(wrong.cast("int")).alias("mismatches"), (F.sum(wrong.cast("int")) == 0).alias("ok"))


def first_mismatches(compared: DataFrame, keys: Sequence[str], limit: int = 20) -> DataFrame:
    """The first mismatching rows in key order (a report of at most ``limit`` rows)."""
    return compared.filter(F.size("fields") > 0).orderBy(*keys).limit(limit)


def state_snapshot(obs: DataFrame, now_ms: int) -> DataFrame:
    """Latest observation per event known at ``now_ms``."""
    return latest_by(obs.filter(F.col("now_ms") <= now_ms), ["event_id"])


def engine_snapshot(obs: DataFrame, health: DataFrame, spots: DataFrame, now_ms: int, config: Config = Config()) -> DataFrame:
    """Everything known at ``now_ms``, one row per thing: ``part, key, raw_id, state, value``.

    ``observation``: the newest row of an event, its state and gap. ``source``: a feed's state with staleness, and its age in ms.
    ``spot``: the newest accepted price of an asset and where its time comes from. ``curve``: comparable propositions among the newest rows, the kind of curve
    and its number of nodes; ``raw_id`` is its newest packet. ``spots`` are the rows of ``legs.spot_state``.
    """
    latest = state_snapshot(obs, now_ms)
    row = lambda part, key, raw_id, state, value: [
        F.lit(part).alias("part"), key.alias("key"), raw_id.alias("raw_id"), state.alias("state"), value.cast("double").alias("value")]
    c = F.col
    quoted = latest_by(spots.filter(c("received_ms") <= now_ms), ["asset"])
    nodes = curve_nodes(latest)
    newest = nodes.groupBy("curve_id").agg(F.max("raw_id").alias("raw_id"))
    groups = curve_groups(nodes).join(newest, "curve_id")
    return (
        latest.select(*row("observation", c("event_id"), c("raw_id"), c("source_state"), c("gap_pp")))
        .unionByName(feed_health(health, now_ms, config).select(*row("source", c("source"), c("raw_id"), c("state"), c("age_ms"))))
        .unionByName(quoted.select(*row("spot", c("asset"), c("raw_id"), c("timestamp_origin"), c("price"))))
        .unionByName(groups.select(*row("curve", c("curve_id"), c("raw_id"), c("curve_type"), F.size("nodes")))))


def monitor_view(
    latest: DataFrame, asset_class: str = "all", mode: str = "all", search: str = "", sort: str = "gap", page: int = 0,
    size: int = 50, cutoff: float = 4.0,
) -> DataFrame:
    """One page of the monitor table, rows without a gap last."""
    df = latest
    if asset_class != "all":
        crypto = F.col("asset").isin(*CRYPTO_ASSETS)
        df = df.filter(crypto if asset_class == "crypto" else ~crypto)
    modes = {
        "usable": F.col("gap_pp").isNotNull(), "blocked": F.col("gap_pp").isNull(),
        "tail": F.array_contains("quality_flags", "EXTREME_TAIL_MODEL_SENSITIVITY"),
    }
    if mode != "all":
        df = df.filter(modes[mode] if mode in modes else F.col("event_type") == mode)
    if search:
        text = F.lower(F.concat_ws(" ", *[c for c in ("asset", "event_text", "event_id") if c in df.columns]))
        df = df.filter(text.contains(search.lower()))
    order = {
        "rel": F.coalesce("relative_gap", F.lit(-1.0)).desc(), "end": F.col("expiry").asc(), "asset": F.col("asset").asc(),
        "gap": F.abs(F.coalesce("gap_pp", F.lit(0.0))).desc(),
    }[sort]
    marked = df.withColumn("highlight", F.coalesce(F.abs("gap_pp") >= cutoff, F.lit(False)))
    return marked.orderBy(F.col("gap_pp").isNull(), order, "event_id").offset(page * size).limit(size)


def strike_selector(latest: DataFrame, selector: Column) -> DataFrame:
    """Events a selector names, as an id or as ASSET-STRIKE, and whether it is ambiguous."""
    strike = F.col("strike_or_threshold")
    plain = F.when(strike == F.floor(strike), strike.cast("bigint").cast("string")).otherwise(strike.cast("string"))
    label = F.upper(F.concat("asset", F.lit("-"), plain))
    hits = latest.filter((F.col("event_id") == selector) | (label == F.upper(selector)))
    return hits.agg(F.count("*").alias("matches"), F.min("event_id").alias("event_id")).withColumn("ambiguous", F.col("matches") > 1)
