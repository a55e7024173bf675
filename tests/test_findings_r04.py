"""Results at the point the fourth review named."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gapweave import plans
from gapweave.operators import ledger

SF = "/root/testdata/sf0.001"
CLOSED = "wallet_id string, status string, exit_reason string, held_ms bigint, net_pnl double, mid_move_pnl double, spread_cost double, fees double, slippage double"


def _summary(rows):
    """The review's own summary of closes, as a plain loop."""
    valid = [r for r in rows if r[1] == "ok"]
    long = [r for r in valid if r[3] > 7_200_000]
    return (*[sum((r[n] for r in valid), 0.0) for n in range(4, 9)], len(valid), len(rows) - len(valid), len(long), sum((r[4] for r in long), 0.0)), Counter(r[2] for r in valid)


def _closes():
    names = [None, "STOP", "TARGET", "a, \"b\" = c"]
    rows = [(f"w{i % 3}", "unreconciled" if i % 11 == 5 else "ok", names[i * i % 7 % 4], 7_190_000 + i * 1000, float(i % 9 - 4), i / 4, 0.5, 0.25, 0.125) for i in range(90)]
    rows += [(f"w{i % 2}", "missing_entry", *[None] * 7) for i in range(5)] + [("lost", "missing_entry", *[None] * 7)]
    # A reason that only a close which does not reconcile has, and closes without a wallet.
    return rows + [("w1", "unreconciled", "ONLY_HERE", 1, 1.0, 1.0, 0.5, 0.25, 0.125), (None, "ok", "STOP", 1, 2.0, 3.0, 0.5, 0.25, 0.25)]


def _flat(row):
    return (*[row[c] for c in ("net_pnl", "mid_move_pnl", "spread_cost", "fees", "slippage", "closes", "unreconciled", "over_two_hours", "long_hold_pnl")],), [
        tuple(x) for x in row.exit_reasons]


def test_the_summary_counts_the_closes_of_each_exit_reason(spark):
    rows = _closes()
    got = ledger.attribution_summary(spark.createDataFrame(rows, CLOSED).repartition(5)).collect()
    groups = [rows, *[[r for r in rows if r[0] == w] for w in ("w0", "w1", "w2", "lost", None)]]
    want = [(sums, sorted(reasons.items(), key=lambda x: (x[0] is not None, x[0] or ""))) for sums, reasons in map(_summary, groups)]
    assert sorted(map(repr, map(_flat, got))) == sorted(map(repr, want))
    assert sorted(str(r.wallet_id) for r in got) == ["None", "None", "lost", "w0", "w1", "w2"]


def test_the_summary_has_totals_without_any_close(spark):
    got = ledger.attribution_summary(spark.createDataFrame([], CLOSED)).collect()
    assert [(r.wallet_id, *_flat(r)) for r in got] == [(None, (0.0, 0.0, 0.0, 0.0, 0.0, 0, 0, 0, 0.0), [])]


def _sql(con, folder):
    for t in ("lineitem", "orders"):
        con.execute(f"create or replace view {t} as select * from '{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}'")
    cursor = con.execute(plans.check_sql()["attribution_summary"])
    names = [c[0] for c in cursor.description]
    return names, sorted(map(repr, cursor.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_the_query_equals_its_sql_also_where_orders_have_no_reason(spark, tmp_path):
    con = pytest.importorskip("duckdb").connect()
    odd = str(tmp_path)
    reason = F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 3 == 1, 'so, "said" é\\').otherwise(F.col("o_orderpriority"))
    spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_orderpriority", reason).write.parquet(f"{odd}/orders.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{odd}/lineitem.parquet")
    for folder in (SF, odd):
        names, want = _sql(con, folder)
        got = plans.QUERIES["attribution_summary"](spark, folder)
        assert "exit_reasons" in names and sorted(names) == sorted(got.columns)
        assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == want
