"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chronoweave.functions.kernels import drop_workspace  # noqa: E402
from chronoweave.plans import load_all  # noqa: E402
from chronoweave.session import local_session  # noqa: E402

QUERIES = [
    "block_stub_matching", "spine_report", "spine_fidelity_slice", "column_ks", "column_shape_errors", "causal_features",
    "customer_history_features", "strict_past_neighbors", "constraint_violations", "rank_preserving_calibration",
    "customer_activity_probability", "edge_and_event_overlap", "block_pair_timestamp_ks", "chronological_split", "text_copy_rates",
    "temporal_block_model", "rewired_edges", "structured_two_sample_test",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or QUERIES
    registry = load_all()
    spark = local_session("bench", cpus, os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # starts the executors
    times: dict[str, float] = {}
    for name in only:
        start = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}
    if "block_stub_matching" in times:
        # generation plus exact verification, against 7,641.2 events/s published for the generation alone
        out["events_generated"] = events
        out["events_per_second"] = round(events / times["block_stub_matching"], 1)
    drop_workspace(spark)
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
