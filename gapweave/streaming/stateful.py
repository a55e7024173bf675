"""Streaming forms of the stateful operators.

Each micro-batch is grouped by key with its state; rows of a key are folded in
tape order, so a stream over any split of the tape emits what the batch
operator computes over the whole. Stateless operators (book, chain and catalog
unpacking, quarantine) take streaming frames unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config
from ..operators.dynamics import jump_legs
from ..operators.legs import accepted_spots, stamped_ticks
from ..sources.feeds import health_limit_ms

Step = Callable[[tuple | None, tuple], tuple[tuple | None, tuple]]
#: rows of a key that are folded and returned at once
PIECE_ROWS = 20_000


def fold_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], state_schema: str, out: str, step: Callable) -> DataFrame:
    """Input rows plus the columns ``out`` that ``step(state, row)`` returns, per key in order.

    ``step`` gets the state tuple (or None) and a row, and returns the new state
    and the tuple of output values.
    """
    keys, order = list(keys), list(order)
    names = [f.split()[0] for f in out.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + out
    columns = df.columns + names

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        places = np.lexsort([rows[c].to_numpy() for c in reversed(order)])
        held = state.get if state.exists else None
        # What a row becomes takes many times its own memory, so that only a piece of the rows is turned at once.
        for start in range(0, len(rows), PIECE_ROWS):
            piece = rows.take(places[start:start + PIECE_ROWS])
            results = []
            for row in piece.itertuples(index=False):
                held, values = step(held, row)
                results.append(values)
            added = pd.DataFrame(results, columns=names, index=piece.index).astype(object)
            yield pd.concat([piece, added.where(added.notna(), None)], axis=1)[columns]
        if held is None:
            state.remove()
        else:
            state.update(held)

    return df.groupBy(*keys).applyInPandasWithState(
        walk, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def _absent(value) -> bool:
    return value is None or value != value


def accept_newer(ticks: DataFrame, keys: Sequence[str], clock: str = "received_ms", order: Sequence[str] = ("id",),
                 tolerance_ms: int = 5_000) -> DataFrame:
    """Stream with ``verdict``; the state is the source time last accepted."""

    def step(held, row):
        source, now = row.source_ms, getattr(row, clock)
        if _absent(source):
            return (int(now),), ("ACCEPTED",)
        if source > now + tolerance_ms:
            return held, ("CLOCK_ERROR",)
        if held is not None and source < held[0]:
            return held, ("DELAYED",)
        return (int(source),), ("ACCEPTED",)

    return fold_stream(ticks, keys, order, "held bigint", "verdict string", step)


def accepted_books(changes: DataFrame, order: Sequence[str] = ("id", "message_no", "change_no"), tolerance_ms: int = 5_000) -> DataFrame:
    """Stream of book changes to the top of book after each accepted one: acceptance and both sides in one state per token."""

    def step(held, row):
        at, bid, ask = held or (None, None, None)
        source, now = row.source_ms, row.received_ms
        if not _absent(source) and source > now + tolerance_ms:
            return held, (False, None, None, None, None)
        if not _absent(source) and at is not None and source < at:
            return held, (False, None, None, None, None)
        at = int(now if _absent(source) else source)
        bid = (None if _absent(row.bid) else row.bid) if row.bid_set else bid
        ask = (None if _absent(row.ask) else row.ask) if row.ask_set else ask
        whole = bid is not None and ask is not None
        crossed = whole and bid > ask
        return (at, bid, ask), (True, bid, ask, crossed, (bid + ask) / 2 if whole and not crossed else None)

    out = fold_stream(changes, ["token"], order, "at bigint, bid double, ask double",
                      "accepted boolean, top_bid double, top_ask double, crossed boolean, yes double", step)
    return out.filter("accepted").drop("accepted")


def spot_state(ticks: DataFrame, tolerance_ms: int = 5_000) -> DataFrame:
    """Stream of spot packets with ``now_ms`` to accepted prices per asset."""
    judged = accept_newer(stamped_ticks(ticks), ["subject"], clock="now_ms", tolerance_ms=tolerance_ms)
    return accepted_spots(judged)


def native_jumps(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """Stream of observations to the jumps of their legs; the state of an (event, mapping) is its previous row and last break."""

    def step(held, row):
        timed, pm, opt, spot, segment = held or (False, None, None, None, None)
        values = tuple(None if _absent(v) else float(v) for v in (row.pm_yes, row.opt_yes, row.spot))
        if not row.valid:
            return (False, *values, int(row.raw_id)), (False, None, None, None, int(row.raw_id))
        return (True, *values, segment), (timed, pm, opt, spot, segment)

    rows = fold_stream(obs, ["event_id", "mapping_hash"], ["raw_id"], "timed boolean, pm double, opt double, spot double, segment bigint",
                       "prev_timed boolean, prev_pm double, prev_opt double, prev_spot double, segment bigint", step)
    prev = F.struct(F.col("prev_pm").alias("pm_yes"), F.col("prev_opt").alias("opt_yes"), F.col("prev_spot").alias("spot"))
    return jump_legs(rows.filter("prev_timed").withColumn("__prev", prev), config)


def feed_silences(health: DataFrame, config: Config = Config(), delay: str = "0 seconds") -> DataFrame:
    """Stream of health rows (id, source, state, now_ms) to ``source, raw_id, stale_ms``: an OK source that says nothing for its limit.

    A timer per source, in event time, emits the row when the clock of the other feeds has passed the limit, without a packet of the silent one.
    """
    timed = health.withColumn("limit_ms", health_limit_ms(F.col("source"), config)).withColumn("at", F.timestamp_millis("now_ms")).withWatermark("at", delay)

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        found = []
        if state.hasTimedOut:
            found.append((key[0], held[0], held[1] + held[2]))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("id", kind="stable")
            for row in rows.itertuples(index=False):
                if held is not None and row.now_ms > held[1] + held[2]:
                    found.append((key[0], held[0], held[1] + held[2]))
                held = (int(row.id), int(row.now_ms), int(row.limit_ms)) if row.state == "OK" else None
            if held is None:
                if state.exists:
                    state.remove()
            else:
                state.update(held)
                due, mark = held[1] + held[2], state.getCurrentWatermarkMs()
                state.setTimeoutTimestamp(max(due, mark + 1))
        yield pd.DataFrame(found, columns=["source", "raw_id", "stale_ms"])

    return timed.groupBy("source").applyInPandasWithState(
        walk, "source string, raw_id bigint, stale_ms bigint", "raw_id bigint, now_ms bigint, limit_ms bigint", "append", GroupStateTimeout.EventTimeTimeout)


def book_state(changes: DataFrame, order: Sequence[str] = ("id", "message_no", "change_no")) -> DataFrame:
    """Stream of accepted book changes with the token's top of book after each."""

    def step(held, row):
        bid, ask = held or (None, None)
        bid = (None if _absent(row.bid) else row.bid) if row.bid_set else bid
        ask = (None if _absent(row.ask) else row.ask) if row.ask_set else ask
        whole = bid is not None and ask is not None
        crossed = whole and bid > ask
        return (bid, ask), (bid, ask, crossed, (bid + ask) / 2 if whole and not crossed else None)

    return fold_stream(changes, ["token"], order, "bid double, ask double",
                       "top_bid double, top_ask double, crossed boolean, yes double", step)


def gap_episodes(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """Stream of observations with ``start_before``, ``start_after`` and ``close_reason``."""

    def step(held, row):
        mapping, start, sign = held or (None, None, None)
        hash_now = "-" if _absent(row.mapping_hash) else row.mapping_hash
        gap = row.gap_pp if row.valid else None
        before, reason = start, None
        if start is not None:
            if mapping != hash_now:
                reason = "MAPPING_CHANGED"
            elif not _absent(row.expiry) and row.expiry <= row.now_ms:
                reason = "EXPIRED"
            elif gap is None:
                reason = "DATA_GAP"
            elif gap * sign < 0:
                reason = "REVERSAL"
            elif gap * sign <= config.close_gap_pp:
                reason = "CONVERGENCE"
            if reason:
                start, sign = None, None
        if start is None and gap is not None and abs(gap) >= config.open_gap_pp:
            start, sign = int(row.raw_id), 1 if gap > 0 else -1
        return (hash_now, start, sign), (before, start, reason)

    return fold_stream(obs, ["event_id"], ["raw_id"], "mapping string, start bigint, sign int",
                       "start_before bigint, start_after bigint, close_reason string", step)


def latest_by(df: DataFrame, keys: Sequence[str], order: str = "raw_id") -> DataFrame:
    """Newest row per key of a stream (use update or complete output)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")
