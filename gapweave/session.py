"""Session defaults and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Settings every query needs.
#: - A stage whose generated method is too long for the JVM compiler runs several
#:   times slower than without fusion; such stages fall back to plain codegen.
#: - In Spark 4.1 a union of equally partitioned sides reports their partitioning
#:   although adaptive execution may coalesce the sides differently; a grouping
#:   above it then returned split groups (seen with 4.1.2). Keep it off.
RUNTIME_CONF = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.unionOutputPartitioning": "false",
}


def require_runtime_conf(spark: SparkSession) -> None:
    """Apply ``RUNTIME_CONF`` to a session made elsewhere; absent settings are skipped."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)


def build_session(app: str = "gapweave", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **RUNTIME_CONF,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and stage tables.

    Reads ``spark.checkpoint.dir``. Only a local master may leave it unset; then a fresh temporary folder is chosen and
    kept for the session, since every task runs on this machine. On a cluster that would scatter the files, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage where several branches read one result: the branches then
    scan a column-pruned file set that outlives a lost executor, instead of
    recomputing the chain of windows below.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
