"""Time the headline operations and print one JSON line.

Eleven operations, from reading a CSV to comparing models; every one runs
over the whole table.  The value is the sum of the median warm times.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # several readers per file, as on a cluster with many splits
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "1m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def operations(spark: SparkSession) -> dict:
    from tablescope.functions.session import scratch_path
    from tablescope.operators import clean, corr, modeling, profile, quality, stats
    from tablescope.sources import csv, sinks

    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    path = sinks.save(lineitem, scratch_path(spark, "bench") + ".csv", "csv")
    found = profile.column_profile(lineitem)
    totals = profile.quality_totals(lineitem, found)
    targets, _ = profile.target_profiles(lineitem, found)

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    return {
        "csv_read": lambda: run(csv.read_csv_typed(spark, path)),
        "dataset_profile": lambda: quality.dataset_profile(lineitem)["warnings"].collect(),
        "dataset_profile_csv": lambda: quality.dataset_profile(csv.read_csv_typed(spark, path))["warnings"].collect(),
        "quality_plan": lambda: [f.collect() for f in quality.cleaning_plan(lineitem).values()],
        "cleaning_apply": lambda: run(
            clean.clean(lineitem, zero_as_missing=["l_tax"], drop_duplicate_rows=True, missing="smart_fill")[0]
        ),
        "quality_warnings": lambda: quality.quality_warnings(found, totals, targets).collect(),
        "statistics": lambda: stats.describe(lineitem).collect(),
        "correlation_pair": lambda: corr.correlation(lineitem, "l_quantity", "l_extendedprice").collect(),
        "correlation_matrix": lambda: corr.correlation_matrix(lineitem).collect(),
        "feature_ranking": lambda: corr.rank_features(lineitem, "l_extendedprice").collect(),
        "model_compare": lambda: modeling.compare_models(
            lineitem, "l_returnflag", features=["l_quantity", "l_extendedprice", "l_discount", "l_linestatus"],
            num_trees=10, max_depth=5,
        )["metrics"].collect(),
    }


def main() -> None:
    spark = session()
    times = {}
    for name, run in operations(spark).items():
        run()  # warm-up
        taken = []
        for _ in range(RUNS):
            begin = time.perf_counter()
            run()
            taken.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(taken), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "sum of median warm times", "value": round(sum(times.values()), 3), "unit": "sec",
             "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
