"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with warm seconds, the median of three runs after a first one."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from wavelake.plans import catalog

HEADLINES = ["window_features", "signal_statistics", "rolling_rms", "zero_crossing_rate", "continuous_events", "interval_scores", "correlation_pearson", "outliers_iqr", "train_test_split", "fft_magnitude", "spectral_values", "butterworth_lowpass", "median_filter", "mfcc"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, cold = {}, {}
    for name in HEADLINES:
        runs = []
        for _ in range(4):
            began = time.time()
            catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        cold[name], seconds[name] = round(runs[0], 3), round(median(runs[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "cold": cold, "sf": sf}))


if __name__ == "__main__":
    main()
