"""The append-only packet tape: Parquet partitioned by receipt date and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAPE_SCHEMA = (
    "id bigint, received_ms bigint, monotonic_ns bigint, source string, subject string, source_ms bigint, "
    "payload string, sha256 string, session string, received_date date, kind string"
)


def sealed(packets: DataFrame) -> DataFrame:
    """Packets with the payload digest and the partition date added."""
    return packets.withColumn("sha256", F.sha2("payload", 256)).withColumn(
        "received_date", F.to_date(F.timestamp_millis("received_ms")))


def append_tape(packets: DataFrame, path: str) -> None:
    """Append packets; earlier files are never rewritten.

    Rows are sorted by id inside each file so that Parquet statistics prune id
    ranges; the sort is local and needs no shuffle.
    """
    sealed(packets).sortWithinPartitions("received_date", "kind", "id").write.mode("append").partitionBy(
        "received_date", "kind").parquet(path)


def scan_tape(
    spark: SparkSession, path: str, after: int = 0, until_ms: int | None = None, kinds: tuple[str, ...] = (),
    through: int | None = None,
) -> DataFrame:
    """Packets with ``id > after``, up to a receipt time and an id boundary.

    All conditions reach the scan: dates and kinds prune partitions, ids and
    receipt times prune row groups. Sort by id only where the order is needed.
    """
    df = spark.read.schema(TAPE_SCHEMA).parquet(path).filter(F.col("id") > after)
    if through is not None:
        df = df.filter(F.col("id") <= through)
    if until_ms is not None:
        date = F.to_date(F.timestamp_millis(F.lit(until_ms)))
        df = df.filter((F.col("received_ms") <= until_ms) & (F.col("received_date") <= date))
    if kinds:
        df = df.filter(F.col("kind").isin(*kinds))
    return df


def stream_tape(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The tape as a stream of newly appended files."""
    return spark.readStream.schema(TAPE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tape_integrity(tape: DataFrame) -> DataFrame:
    """Packets whose payload no longer matches its digest."""
    return tape.filter(F.sha2("payload", 256) != F.col("sha256")).select("id", "kind", "received_ms", "sha256")


def integrity_counts(tape: DataFrame) -> DataFrame:
    """Checked and mismatching packets per kind."""
    wrong = F.when(F.sha2("payload", 256) != F.col("sha256"), 1).otherwise(0)
    return tape.groupBy("kind").agg(F.count("*").alias("checked"), F.sum(wrong).alias("mismatches"))


def raw_lookup(rows: DataFrame, tape: DataFrame, refs: str = "input_refs") -> DataFrame:
    """Raw packets behind each row's ``input_refs`` map (role -> packet id).

    A plain equi-join on the packet id: AQE splits a packet many rows refer to.
    """
    exploded = rows.select("event_id", F.col("raw_id").alias("observed_at"), F.explode(refs).alias("role", "id"))
    return exploded.join(tape, "id").select(
        "event_id", "observed_at", "role", "id", "kind", "source", "received_ms", "payload")
