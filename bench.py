"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores. Every query is
written to Spark's ``noop`` sink, so all of its columns and rows are produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flow_features_by_class", "flow_features_by_spi", "sa_groups", "packet_owners", "session_parameters",
    "retransmit_interval", "risk_assessment", "findings", "compliance", "exposure_signals", "all_anomalies",
    "gateway_reconcile", "fleet_summary", "job_diff", "analysis_sessions", "analysis_digests", "cef_lines",
)


def main() -> None:
    from culvert import catalog
    from culvert.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "culvert-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executors before timing
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name:28s} {took[name]:8.2f}s", file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
