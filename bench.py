"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line. Best of two runs after a warm-up scan."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tabloom.queries import REGISTRY, registry
from tabloom.session import tune

HEADLINES = [
    "n02_distribution", "a05_grouped_sum", "a05c_grouped_median", "a07_numeric_moments", "a08b_quantiles_by_selection", "a15_correlation_matrix",
    "a17_duplicate_rows", "a20_potential_targets", "a26_join_unique", "a31_histogram", "j01_join_inner", "j01_join_outer", "j02_match_stats_outer",
    "j08_exact_size", "d06_detect_joins", "d10_infer_relationships", "w04_forward_fill", "c06_outliers", "c09_clean_all", "h25_json_field_profile",
    "s05b_json_records_flat", "n09_detailed_summary", "m05_assemble",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = tune(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g")).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    registry.spread_tables = True  # every table of the bench is one file with one row group
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            # every output column is computed and nothing is brought to the driver
            REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
