"""Derived facts: append-only Parquet keyed by the packet that caused them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import CALCULATION_VERSION, FEATURE_VERSION


def write_facts(df: DataFrame, path: str, time: str = "now_ms") -> None:
    """Append facts with their version columns, partitioned by day."""
    df.withColumns({
        "calculation_version": F.lit(CALCULATION_VERSION),
        "feature_version": F.lit(FEATURE_VERSION),
        "fact_date": F.to_date(F.timestamp_millis(time)),
    }).write.mode("append").partitionBy("fact_date").parquet(path)


def read_facts(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def facts_sink(path: str, time: str = "now_ms"):
    """``foreachBatch`` function that appends each micro-batch once.

    A repeated batch (after a restart) replaces its own folder, so facts are
    never written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumns({
            "calculation_version": F.lit(CALCULATION_VERSION),
            "feature_version": F.lit(FEATURE_VERSION),
            "fact_date": F.to_date(F.timestamp_millis(time)),
        }).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
