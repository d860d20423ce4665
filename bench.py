"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written to the ``noop`` sink: once to warm up, then timed
``BENCH_RUNS`` times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clientlens.session import build_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = [
    "F2_customer_profile_history", "F3_search_products", "F6_transaction_alerts", "F7_compliance_check_full",
    "F10_sar_drafts", "J1_convert_currency_pairs", "J2_regulatory_limits", "J3_suitable_products",
    "E2_recommendation_plan", "J4_assess_suitability", "J5_screen_names", "J6_check_pep", "J7_map_risks_to_controls",
    "J9_compare_products", "J10_semantic_match", "A1_customer_risk_score", "A4_portfolio_allocation", "A5_portfolio_risk",
    "A8_rcsa_summary", "A9_kri_status", "W1_transaction_profile", "W2_top_n_per_group", "S1_mask_text",
    "S3_extract_entities", "S4_compare_documents", "S8_residual_risk", "S9_extract_tables", "S14_detect_pii_finance",
    "H1_vector_search", "H3_text_search", "G1_entity_neighbourhood", "G2_find_paths", "SK2_to_audit_json",
    "A10_audit_usage", "T3_assemble_threads", "ST2_alerts_sliding", "ST3_rate_limit", "ST4_ttl_repeats",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        times = []
        for run in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
            if run or not runs:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name:40s} {seconds[name]:7.3f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
