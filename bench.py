"""Headline timings. Prints one JSON line.

``profile_*`` and ``end_to_end`` start from the source tables; the other queries run on the profile
facts that a session computes once, which is how they are used.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from varve.plans import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

COLD = {"profile_exact": "R1_profile_rows", "profile_sketch": "R3_sketch_profile", "end_to_end_psi": "C8_psi_worst"}
SHARED = [
    "S0_readiness_score", "S9_action_list", "I3_preprocessing_checklist", "D14_all_metrics", "C0_verdict",
    "C8h_psi_heatmap", "C12_overview_matrix", "I7_model_action", "G9_signals", "H3_theme_facts", "V1_card_validation",
    "D7x_ks_exact", "D9x_psi_categorical_exact", "M1_windowed_profile",
]


def timed(fn) -> float:
    start = time.perf_counter()
    fn().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times = {}
    for label, name in COLD.items():
        registry.forget()
        times[label] = timed(lambda: registry.QUERIES[name](spark, SF_DIR))
    for name in SHARED:
        times[name] = timed(lambda: registry.QUERIES[name](spark, SF_DIR))
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
