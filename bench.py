"""Runs the headline queries once warm and prints one JSON line; BENCH_SF_DIR and BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import time

from tidemark.plans.queries import queries
from tidemark.session import session

HEADLINE = [
    "conversion_horizon", "commercial_transition", "feature_adoption", "locked_feature_signal", "paid_retention_horizon", "product_paid_computed", "rating_snapshot",
    "support_monthly", "support_summary", "website_monthly", "dedup_exact", "dq_contiguity", "dq_overlap", "dq_coverage", "dq_interval_count", "dq_summary",
    "ml_dataset", "paid_time_clipped", "average_precision", "session_gap", "dq_verdicts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="8g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    every, took = queries(), {}
    every[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler
    for name in HEADLINE:
        start = time.time()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
