"""Runs the headline plans and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose input and cores; names given as arguments choose plans."""

import json
import os
import sys
import time

from pitchloom.plans import registry
from pitchloom.session import session

HEADLINE = [
    "e04_recent_form", "d06_head_to_head", "e06_rolling_goals", "e01_cadence", "c17_canonical_results", "c18_merged_status", "n01_live_state", "g01_greedy_dedupe", "d15_score_slates", "d12_calibration_by_band", "l07_walk_forward_priors",
    "d02_team_profiles", "d01_moving_strength", "d01_elo", "i07_heuristic_blend", "h22_dixon_coles", "j16_presentation_guard", "k06_coverage", "k01_optimised_ticket", "m05_strategy_summary", "g06_fixture_clusters",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    plans = registry.queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # the session is up
    took = {}
    for name in names:
        began = time.time()
        plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
