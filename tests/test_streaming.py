"""Streams that stop, fail and go on, against batch results over the same rows."""

import pytest
from pyspark.sql import functions as F

from gapweave.config import Config
from gapweave.operators.clock import effective_clock
from gapweave.session import scratch_path
from gapweave.sources import feeds
from gapweave.streaming import sinks, stateful


def batches(spark, rows, schema, sink, fail=()):
    """Hand each list of rows to the sink as a batch; batches in ``fail`` are written, lost and written again."""
    for i, part in enumerate(rows):
        for _ in range(2 if i in fail else 1):
            sink(spark.createDataFrame(part, schema), i)


@pytest.mark.parametrize("fail", [(), (1, 3)])
def test_clock_over_batches_equals_the_whole_tape(spark, fail):
    received = [5, 3, 9, 1, 2, 8, 30, 4, 4, 31]
    tape = [(i, r) for i, r in enumerate(received)]
    path = scratch_path(spark, "clock")
    parts = [tape[:3], tape[3:6], [], tape[6:7], tape[7:]]
    batches(spark, parts, "id bigint, received_ms bigint", sinks.clock_sink(path), fail)
    got = spark.read.parquet(f"{path}/facts").select("id", "now_ms").orderBy("id").collect()
    want = effective_clock(spark.createDataFrame(tape, "id bigint, received_ms bigint")).select("id", "now_ms").orderBy("id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


@pytest.mark.parametrize("compact_every", [1, 2, 50])
def test_upsert_keeps_the_newest_row_whatever_is_late_or_repeated(spark, compact_every):
    parts = [[("a", 1, "x"), ("b", 5, "y")], [("a", 4, "z"), ("c", 2, "q")], [("a", 3, "late"), ("b", 6, "w")], [("c", 1, "late")]]
    path = scratch_path(spark, "upsert")
    batches(spark, parts, "k string, raw_id bigint, v string", sinks.upsert_sink(path, ["k"], compact_every=compact_every), fail=(0, 1, 2, 3))
    got = sorted(tuple(r) for r in sinks.read_latest(spark, path, ["k"]).collect())
    assert got == [("a", 4, "z"), ("b", 6, "w"), ("c", 2, "q")]
    after = sorted(tuple(r) for r in sinks.read_latest(spark, path, ["k"], up_to=0).collect()) if compact_every == 50 else None
    assert after in (None, [("a", 1, "x"), ("b", 5, "y")])


def test_judged_sink_keeps_every_packet_once(spark):
    parts = [[(1, "spot", '{"price": 1}'), (2, "spot", "12.5")], [(3, "pm", "[null]"), (4, "timer", "{}")]]
    path = scratch_path(spark, "judged")
    batches(spark, parts, "id bigint, kind string, payload string", sinks.judged_sink(path), fail=(1,))
    rows = {r.id: (r.sound == "true", r.error) for r in spark.read.parquet(path).collect()}
    assert {i for i, (sound, _) in rows.items() if sound} == {1, 4} and all((error is None) == sound for sound, error in rows.values()) and len(rows) == 4


def test_silent_feed_becomes_stale_without_a_packet(spark):
    """Feed a is well and falls silent; only b goes on. c fails before, so its silence is no news."""
    config = Config()
    rows = [(1, "spot:a", "OK", 0), (2, "spot:c", "ERROR", 5), (3, "spot:b", "OK", 10), (4, "spot:b", "OK", 80_000), (5, "spot:b", "OK", 160_000), (6, "spot:b", "OK", 400_000), (7, "spot:b", "OK", 410_000)]
    rows = [(i, f, s, 1_000_000 + t) for i, f, s, t in rows]  # nothing comes before the watermark's start
    source, sink, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    schema = "id bigint, source string, state string, now_ms bigint"
    for part in (rows[:3], rows[3:5], rows[5:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        out = stateful.feed_silences(spark.readStream.schema(schema).parquet(source), config)
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(sink).collect())
    want = sorted(tuple(r) for r in feeds.feed_silences(spark.createDataFrame(rows, schema), config).collect())
    assert got == want == [("spot:a", 1, 1_090_000), ("spot:b", 5, 1_250_000)]


def test_state_of_jumps_is_a_row_per_key(spark):
    """10 keys, 400 rows in four batches: the state store holds ten rows however long the stream is."""
    schema = "event_id string, mapping_hash string, raw_id bigint, now_ms bigint, trigger_kind string, valid boolean, pm_yes double, opt_yes double, spot double"
    source, state = scratch_path(spark, "in"), scratch_path(spark, "state")
    for part in range(4):
        spark.range(part * 100, part * 100 + 100).select(
            F.concat(F.lit("e"), F.col("id") % 10).alias("event_id"), F.lit("m").alias("mapping_hash"), F.col("id").alias("raw_id"), (F.col("id") * 1000).alias("now_ms"), F.lit("pm").alias("trigger_kind"),
            F.lit(True).alias("valid"), (F.col("id") % 7 / 10).alias("pm_yes"), F.lit(0.5).alias("opt_yes"), F.lit(100.0).alias("spot")).write.mode("append").parquet(source)
        run = stateful.native_jumps(spark.readStream.schema(schema).parquet(source)).writeStream.format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 10
