"""Shapes of plans and results at the points the third review named."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave import plans
from gapweave.operators import ledger, surface, thesis
from gapweave.streaming import stateful
from tests.test_ledger_analyzers import FILLS, _fills


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lots_deal_the_fills_out_once(spark):
    plan = _plan(ledger.closed_lot_attribution(spark.createDataFrame(_fills(1), FILLS)))
    assert plan.count("Exchange ") == 1 and "parquet" not in plan.lower()


def test_fills_that_share_an_id_count_once_each(spark):
    rows = [("r1", "w", "x", i, 1000 * i, side, q, 1, 9.0, 11.0, 0.0, 0.0, 11.0 * q, None, "why", False)
            for i, side, q in [(1, "BUY", 2.0), (2, "BUY", 2.0), (3, "SELL", 1.0), (3, "SELL", 1.0)]]
    got = ledger.closed_lot_attribution(spark.createDataFrame(rows, FILLS)).collect()
    assert [(r.status, r.invested, r.entries) for r in got] == [("unreconciled", 11.0, 2)] * 2


def test_the_calendar_and_not_the_days_of_snapshots_is_sent_round(spark):
    snaps = spark.range(3).select(F.col("id").alias("snapshot_id"), (F.lit(30 * 86_400_000) + F.col("id")).alias("now_ms"), F.lit(0).cast("bigint").alias("start_ms"),
                                  F.array(F.struct(F.to_date(F.lit("1970-01-05")).alias("session"), F.lit(2.0).alias("ratio"))).alias("splits"))
    day = F.col("id") * 86_400_000
    sessions = spark.range(1000).select(F.to_date(F.timestamp_millis(day)).alias("session_date"), (day + 52_200_000).alias("open_ms"), (day + 75_600_000).alias("close_ms"))
    got = thesis.equity_context(snaps, sessions)
    join = next(line for line in _plan(got).splitlines() if "Join" in line and "[session_date" in line)
    assert "BuildRight" in join
    assert [(r.market_state, len(r.required_sessions), r.corporate_action) for r in got.collect()] == [("CLOSED", 30, True)] * 3


def test_wallet_metrics_reads_the_fills_once(spark):
    fills = spark.createDataFrame(_fills(2), FILLS).withColumns({"net_credit": F.lit(5.0), "gross_premium": F.lit(5.0), "cost_delta": F.lit(1.0),
                                                                "total_debit": F.coalesce("total_debit", F.lit(0.0))})
    marks = spark.createDataFrame([("x", 1, 100, 2.0), ("y", 2, 100, 3.0)], "instrument string, mark_id bigint, mark_ms bigint, bid double")
    got = ledger.wallet_metrics(fills, marks, 200)
    assert _plan(got).count("Scan ExistingRDD[run_id") == 1
    held = {}
    for r in _fills(2):
        held[r[0], r[2]] = held.get((r[0], r[2]), 0.0) + (r[6] if r[5] == "BUY" else -r[6])
    want = {run: sum(q * 100 * {"x": 2.0, "y": 3.0}[i] for (o, i), q in held.items() if o == run and q > 1e-9) for run in ("r1", "r2")}
    assert {r.run_id: r.market_value for r in got.collect()} == want


def test_a_book_whose_best_bid_is_no_price_keeps_its_next_level(spark, tmp_path):
    """Values above 600, which only large tables have: the first level is above 1, the second may be valid."""
    duckdb = pytest.importorskip("duckdb")
    at = datetime.datetime(2024, 1, 5)
    rows = [(i, at + datetime.timedelta(minutes=i), 8, kind, value, '{"k": 1}') for i, (kind, value) in enumerate(
        (kind, value) for kind in ("view", "click", "purchase", "error", "signup") for value in (3.0, 590.0, 599.99, 600.0, 603.0, 606.5, 780.0))]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(
        str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(plans.check_sql()["explode_books"]).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r) for r in plans.QUERIES["explode_books"](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[columns.index("bid")] for r in got if r[0] == 4 and r[columns.index("is_book")]} == {0.995}


def test_strikes_around_a_point_need_no_window_over_the_contracts(spark):
    rng = random.Random(4)
    listed = [(s, pos, float(rng.choice([None, *range(90, 110)]) or "nan") if rng.random() < 0.9 else None, rng.uniform(0, 5), rng.uniform(5, 9), 4.0,
               rng.choice([None, 0.3, 0.4, 7.0])) for s in range(3) for pos in range(12)]
    listed = [(s, pos, None if k != k else k, *rest) for s, pos, k, *rest in listed]
    points = [(s, n, float(rng.randrange(88, 112))) for s in range(4) for n in range(6)]
    got = surface.strike_neighborhood(
        spark.createDataFrame(points, "snap int, n int, strike_or_threshold double"),
        spark.createDataFrame(listed, "snap int, pos int, strike double, bid double, ask double, mark double, iv double"), ["snap"])
    assert "Window" not in _plan(got)
    rows = got.collect()
    assert len(rows) == len(points)
    for r in rows:
        mine = [c for c in listed if c[0] == r.snap and c[2] is not None]
        x = r.strike_or_threshold
        low = min((c for c in mine if c[2] < x), key=lambda c: (-c[2], c[1]), default=None)
        high = min((c for c in mine if c[2] > x), key=lambda c: (c[2], c[1]), default=None)
        near = sorted((abs(c[2] - x), c[1], c[2], c[6]) for c in mine if c[6] is not None and c[6] < 5)[:3]
        assert (r.below and tuple(r.below)) == (low and tuple(low[2:6]))
        assert (r.above and tuple(r.above)) == (high and tuple(high[2:6]))
        assert [tuple(c) for c in r.near] == near


class _State:
    exists, get = False, None

    def update(self, held):
        self.exists, self.get = True, held


class _Frame:
    """Stands for a streaming frame and keeps the function that a key's rows go through."""

    columns = ["key", "id", "value"]
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("id", T.LongType()), T.StructField("value", T.LongType())])

    def groupBy(self, *keys):
        return self

    def applyInPandasWithState(self, walk, *rest):
        return walk


def test_a_stream_returns_the_rows_of_a_key_in_pieces():
    walk = stateful.fold_stream(_Frame(), ["key"], ["id"], "n bigint", "before bigint", lambda held, row: (((held or (0,))[0] + row.value,), (held and held[0],)))
    ids = list(range(45_000))
    random.Random(1).shuffle(ids)
    batches = [pd.DataFrame({"key": "k", "id": part, "value": part}) for part in (ids[:30_000], ids[30_000:])]
    state = _State()
    pieces = list(walk(("k",), iter(batches), state))
    assert max(map(len, pieces)) <= 20_000
    rows = pd.concat(pieces)
    assert list(rows["id"]) == sorted(ids) and state.get == (sum(ids),)
    assert list(rows["before"])[:4] == [None, 0, 1, 3]
