"""Plans that keep their cost a row and their tasks when the tables grow."""

import os
import re

import pytest
from pyspark.sql import functions as F

from gapweave import plans
from gapweave.functions import scalars as S

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def _nodes(df):
    """The nodes of a plan with all their expressions, from the top."""
    spark = df.sparkSession
    old = {k: spark.conf.get(k) for k in ("spark.sql.maxPlanStringLength", "spark.sql.debug.maxToStringFields")}
    for k in old:
        spark.conf.set(k, 100_000_000)
    try:
        return df._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _dealt_before_unpacking(nodes):
    unpack = max(i for i, n in enumerate(nodes) if "Generate" in n)
    return any("REPARTITION_BY_COL" in n for n in nodes[unpack:])


@needs_tables
def test_listings_are_dealt_out_and_read_once(spark):
    nodes = _nodes(plans.QUERIES["infer_event"](spark, SF))
    assert _dealt_before_unpacking(nodes)
    assert sum(len(re.findall("RLIKE|regexp_extract", n)) for n in nodes) <= 90


def test_months_by_name(spark):
    rows = [(m.upper() if i % 2 else m, i) for i, m in enumerate(S.MONTHS, start=1)] + [("smarch", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "m string, n int").withColumn("got", S.month_number(F.col("m")))
    assert [r.got for r in df.collect()] == [n for _, n in rows]
    assert df.schema["got"].dataType.simpleString() == "int"


@needs_tables
def test_books_are_dealt_out_and_parsed_once(spark):
    nodes = _nodes(plans.QUERIES["explode_books"](spark, SF))
    assert _dealt_before_unpacking(nodes)
    # Two sides of a full book, two quoted ones, and the time stamp.
    assert len(re.findall("RLIKE", nodes[0])) <= 4 and sum(len(re.findall("RLIKE", n)) for n in nodes) <= 16


def test_a_level_without_a_price_is_skipped(spark):
    from gapweave.sources import feeds

    book = ('{"event_type":"book","asset_id":"t","timestamp":"1704067200000","bids":[{"price":"x"},{"price":"0.4"},{"price":"1.5"},{"price":"0.3"}],'
            '"asks":[{"price":"0_0.7"},{"price":null},{"price":"0.6"}]}')
    raw = spark.createDataFrame([(1, 5, None, book), (2, 6, None, book.replace("0.4", "y").replace("0.3", "z"))], "id bigint, received_ms bigint, source_ms bigint, payload string")
    rows = feeds.explode_books(raw).orderBy("id").collect()
    assert [(r.bid, r.ask, len(r.depth.bids), len(r.depth.asks)) for r in rows] == [(0.4, 0.6, 4, 3), (None, 0.6, 4, 3)]
    assert {r.source_ms for r in rows} == {1_704_067_200_000}


@needs_tables
def test_the_tape_plan_sweeps_wide_rows_once(spark, monkeypatch):
    from gapweave.operators import observe, running, tape_plan

    scans, real = [], running.stage_table

    def counted(df, name, partition_by=()):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return real(df, name, partition_by)

    for module in (running, tape_plan):
        monkeypatch.setattr(module, "stage_table", counted)
    nodes = _nodes(plans.QUERIES["observe_from_tape"](spark, SF))
    # No stage reads another over and over, and what is left sweeps and prices without a further exchange of the swept rows.
    assert max(scans) <= 16
    sweep = max(i for i, n in enumerate(nodes) if "Window [" in n and "lead(" in n)
    assert not any("Exchange hashpartitioning" in n for n in nodes[:sweep] if "__slice" not in n)
    assert sum("Exchange" in n for n in nodes) <= 4
