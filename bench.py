"""Times the headline queries: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
tables and cores. Each query is run once to warm up and then timed; its rows are
written to Spark's no-op sink, so that all of them are made.
"""

from __future__ import annotations

import json
import os
import time

from linkspark.registry import QUERIES
from linkspark.session import session

HEADLINES = [
    "fan_in_hubs",
    "rapid_layering",
    "convergence_48h",
    "call_before_transfer",
    "call_transfer_correlation",
    "nearest_ipdr",
    "episodes",
    "account_stats",
    "entity_timeline",
    "risk_leaderboard",
    "graph_edges",
    "upsert_latest",
    "doc_classify",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINES:
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
