"""Compare registered queries with their SQL: ``python tests/run_checks.py [sf] [name-prefix ...]``."""

import os
import sys
import warnings

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
warnings.filterwarnings("ignore")


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    from culvert import catalog
    from culvert.plans.compare import check
    from culvert.session import build_session

    for domain in catalog.DOMAINS:
        if os.path.exists(os.path.join(ROOT, "culvert", "catalog", f"{domain}.py")):
            __import__(f"culvert.catalog.{domain}")
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
                       "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, query in catalog.QUERIES.items():
        if wanted and not any(name.startswith(w) or query.__module__.endswith("." + w) for w in wanted):
            continue
        try:
            verdict, n, took = check(spark, f"/root/testdata/sf{sf}", query, catalog.ORACLE.get(name))
        except Exception as exc:  # keep going: one summary for all queries
            verdict, n, took = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", 0, 0.0
        bad += verdict not in ("ok", "rows-only")
        print(f"{name:34s} {n:8d} rows {took:6.2f}s  {verdict}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
