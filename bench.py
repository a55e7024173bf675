"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gapweave import plans  # noqa: E402
from gapweave.session import build_session  # noqa: E402

HEADLINE = (
    "top_gaps_by_market", "effective_clock", "accept_newer", "asof_join", "horizon_changes", "trend_label", "native_jumps",
    "gap_episodes", "episode_summary", "curve_nodes", "side_clusters", "infer_event", "book_state", "observe", "asof_grid",
    "sliced_wasserstein", "lead_lag", "verify_recompute", "closed_lot_attribution", "wallet_metrics", "drawdown", "entry_evidence",
    "expression_scenarios", "tape_integrity", "observe_from_tape",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.log.level": "ERROR", "spark.checkpoint.dir": folder})
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executors outside the measurement
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
