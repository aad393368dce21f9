"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's full plan is executed with the ``noop`` sink (every row is
produced, nothing is collected to the driver).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_pipeline",        # C18: the clean stage
    "county_profile",        # G01: flagship
    "equity_gap",            # X07
    "policy_quadrant",       # X08
    "null_profile",          # Q01
    "describe",              # Q11
    "fill_group_mode",       # C11
    "correlation_matrix",    # G06
    "cramers_v",             # A04
    "ks_two_sample",         # A01
    "ecdf",                  # W06
    "apply_scenario",        # X01
    "scenario_saving",       # X02
    "scenario_summary",      # X05
    "delta_shap",            # X04
    "ridge_pipeline",        # M05
    "gbt_regressor_30",      # M02, 30 rounds of depth 5 without early stop
    "shap_values",           # X03
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [k for k in sys.argv[1:] if not k.startswith("-")]
    from hearthlens.plans.registry import load_all
    from hearthlens.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="hearthlens-bench")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hearthlens-bench-"))
    reg = load_all()

    def run(key):
        if key == "gbt_regressor_30":
            from hearthlens.plans.q_ml import REGRESSOR
            return reg["gbt_regressor"].run(spark, sf_dir, params=replace(REGRESSOR, rounds=30, depth=5, patience=None))
        return reg[key].run(spark, sf_dir)

    # warm-up: JVM, parquet footers, code paths (not timed)
    reg["county_profile"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in only or HEADLINE:
        t0 = time.time()
        df = run(key)
        df.write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
