"""Shared pieces: tables, the ASCII white-space class, native text keys, row keys."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as a character class and as the characters themselves
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its DuckDB text, if any."""

    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cols(names: Sequence[str]) -> list[Column]:
    """Columns by their plain names, dots and all."""
    return [F.col(f"`{n}`") for n in names]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the faster form and equal where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def hash_pair(*cols: Column) -> tuple[Column, Column]:
    """128 bits of two differently seeded 64-bit hashes; equal for equal values, nulls included."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(7919), *reversed(cols))


def append_columns(df: DataFrame, fields: Sequence[T.StructField], start: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """All columns of ``df``, except those named like ``fields``, and ``fields`` computed batch by batch.

    ``start`` runs once per task and returns the function from a record batch to the new arrays; the other
    columns pass through as they are.
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *compute(b)], names=names)

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, *fields]))


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """The values of a text column, nulls as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def in_task(spark: SparkSession, work: Callable[[], object]):
    """The result of ``work()``, run in one task: training on a bounded sample stays off the driver, on one core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work())], pa.binary())], names=["made"])

    return pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(run, "made binary").first()["made"])
