"""Benchmark the headline queries.

Runs each query over the tables in $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and prints one JSON line. Every query is executed in
full through the no-op sink (nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans.registry import all_queries  # noqa: E402
from tessera.session import build_session, drop_cuts  # noqa: E402

HEADLINE = [
    "A1_flow_payment_by_statement_month",
    "J1_stock_eos_by_statement_month",
    "A6_quantile_bins_credit_limit_payment",
    "A23_metrics_overall_and_by_risk_segment",
    "A24_compare_rounds_overall",
    "A27_A30_monthly_summary",
    "F5_F8_scored_answers",
    "A43_J3_majority_vote",
    "W4_cumulative_tokens_per_run",
    "W3_merge_consecutive_messages",
    "D5_T4_bm25_top10_paragraphs",
    "D5_T4_bm25_top10_chunks",
    "D6_T5_vector_top3",
    "D9_find_on_page",
    "ST1_assemble_deltas_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app_name="tessera-bench", shuffle_partitions=max(8, cpus * 2),
                          extra_conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                                      "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m"})
    queries = all_queries()
    # warm-up: JVM class loading and the first parquet footer reads are not query time
    queries[names[0]].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        queries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "spark": spark.version}))
    drop_cuts(spark)
    spark.stop()


if __name__ == "__main__":
    main()
