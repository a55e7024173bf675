"""Registered queries: the streaming operators over a tape that grows between two runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import facts, feeds
from ..streaming import sinks, stateful
from .fixtures import CONFIG, DAY, SCALE, SLICE_ROWS, START, observations, r6, ticks
from .q_dynamics import JITTER
from .q_sources import book_packets, damaged_packets, health_rows, spot_packets
from .registry import CHECKS, query


def _halves(spark: SparkSession, rows: DataFrame, time: str, source: str):
    """Write the first half of ``rows`` to ``source``, then the second, and open a stream over what is there each time."""
    middle = START + 15 * DAY
    for part in (F.col(time) < middle, F.col(time) >= middle):
        rows.filter(part).write.mode("append").parquet(source)
        yield spark.readStream.schema(rows.schema).parquet(source)


def replay_into(spark: SparkSession, rows: DataFrame, time: str, sink: sinks.Sink) -> None:
    """Feed both halves of ``rows`` to a ``foreachBatch`` sink. The second batch fails after it was written, and runs again from the checkpoint."""
    source, state = (scratch_path(spark, n) for n in ("stream-in", "stream-state"))
    failures = []

    def unreliable(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        if batch_id == 1 and not failures:
            failures.append(batch_id)
            raise RuntimeError("lost after writing")

    for stream in _halves(spark, rows, time, source):
        for attempt in range(2):
            run = stream.writeStream.foreachBatch(unreliable).option("checkpointLocation", state).trigger(availableNow=True).start()
            try:
                run.awaitTermination()
                break
            except StreamingQueryException as e:
                if attempt or "lost after writing" not in str(e):
                    raise


def replay_as_stream(spark: SparkSession, rows: DataFrame, time: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Feed the first half of ``rows``, stop, append the rest, resume from the checkpoint."""
    source, sink, state = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    for rows_so_far in _halves(spark, rows, time, source):
        stream = transform(rows_so_far)
        schema = stream.schema
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(sink)


@query("stream_gap_episodes", CHECKS["gap_episodes"])
def stream_gap_episodes(spark, d):
    """Episodes of a stream that is stopped and resumed, equal to the batch result."""
    obs = observations(spark, d).select("event_id", "raw_id", "now_ms", "mapping_hash", "expiry", "gap_pp", "valid")
    out = replay_as_stream(spark, obs, "now_ms", lambda s: stateful.gap_episodes(s, CONFIG))
    return out.select("event_id", "raw_id", "start_before", "start_after", "close_reason")


@query("stream_accept_newer", CHECKS["accept_newer"])
def stream_accept_newer(spark, d):
    t = ticks(spark, d).select("id", "market", "received_ms", "source_ms")
    out = replay_as_stream(spark, t, "received_ms", lambda s: stateful.accept_newer(s, ["market"], tolerance_ms=5000 * SCALE))
    return out.select("id", "market", "verdict")


@query("stream_book_state", CHECKS["book_state"])
def stream_book_state(spark, d):
    """Book packets of a resumed stream to the top of book after every accepted change."""
    def books(packets: DataFrame) -> DataFrame:
        changes = feeds.explode_books(packets).withColumn("has_depth", F.col("depth").isNotNull())
        changes = changes.select("id", "message_no", "change_no", "token", "received_ms", "source_ms", "bid_set", "bid", "ask_set", "ask", "has_depth")
        return stateful.accepted_books(changes, tolerance_ms=5000 * SCALE)

    out = replay_as_stream(spark, book_packets(spark, d), "received_ms", books)
    return out.select("token", F.col("id").alias("raw_id"), F.coalesce("source_ms", "received_ms").alias("source_ms"), r6(F.col("top_bid")).alias("bid"),
                      r6(F.col("top_ask")).alias("ask"), r6(F.col("yes")).alias("yes"), "crossed", "has_depth")


@query("stream_spot_state", CHECKS["spot_state"])
def stream_spot_state(spark, d):
    out = replay_as_stream(spark, spot_packets(spark, d), "now_ms", lambda s: stateful.spot_state(s, 5000 * SCALE))
    return out.select("asset", "raw_id", "price", "source_ms", "timestamp_origin")


@query("stream_native_jumps", CHECKS["native_jumps"])
def stream_native_jumps(spark, d):
    obs = observations(spark, d).select("event_id", "mapping_hash", "raw_id", "now_ms", "trigger_kind", "valid", "pm_yes", "opt_yes", "spot")
    out = replay_as_stream(spark, obs, "now_ms", lambda s: stateful.native_jumps(s, CONFIG))
    return out.withColumn("change", r6(F.col("change")))


@query("stream_feed_silences", CHECKS["feed_silences"])
def stream_feed_silences(spark, d):
    """Silent feeds, told by timers while the others go on."""
    return replay_as_stream(spark, health_rows(spark, d, "user_id"), "now_ms", lambda s: stateful.feed_silences(s, CONFIG))


@query("stream_effective_clock", CHECKS["effective_clock"])
def stream_effective_clock(spark, d):
    """The receipt clock over batches, one of which is repeated after a failure."""
    t, path = ticks(spark, d), scratch_path(spark, "stream-clock")
    rows = t.select("id", F.expr(JITTER).alias("received_ms"), F.col("received_ms").alias("at"))
    replay_into(spark, rows, "at", sinks.clock_sink(path, slice_rows=SLICE_ROWS))
    return spark.read.parquet(f"{path}/facts").select("id", "received_ms", "now_ms")


@query("stream_latest_by", CHECKS["latest_by"])
def stream_latest_by(spark, d):
    """The newest observation of every proposition and mapping, kept up to date by batches."""
    path, keys = scratch_path(spark, "stream-latest"), ["event_id", "mapping_hash"]
    obs = observations(spark, d).select("event_id", "mapping_hash", "raw_id", "now_ms", "source_state", "gap_pp")
    replay_into(spark, obs, "now_ms", sinks.upsert_sink(path, keys, compact_every=2))
    o = sinks.read_latest(spark, path, keys)
    return o.select("event_id", "raw_id", "now_ms", "source_state", r6(F.col("gap_pp")).alias("gap_pp"), "mapping_hash")


@query("stream_quarantine", CHECKS["quarantine"])
def stream_quarantine(spark, d):
    """Sound and malformed packets of a stream, written apart in one pass."""
    path = scratch_path(spark, "stream-judged")
    replay_into(spark, damaged_packets(spark, d), "received_ms", sinks.judged_sink(path))
    return spark.read.parquet(path).select("id", "kind", "error")


@query("stream_facts", "SELECT event_id, raw_id, now_ms FROM obs")
def stream_facts(spark, d):
    """Observations as facts, each once, although a batch was written twice."""
    path = scratch_path(spark, "stream-facts")
    replay_into(spark, observations(spark, d).select("event_id", "raw_id", "now_ms"), "now_ms", facts.facts_sink(path))
    return facts.read_facts(spark, path).select("event_id", "raw_id", "now_ms")
