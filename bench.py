"""Time the headline queries; prints one JSON line.

Folder in ``BENCH_SF_DIR``, cores in ``BENCH_CPUS``, runs per query in ``BENCH_RUNS``.
A run computes the whole result and throws it away; the reported time is the median of
the runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from workload import registry  # noqa: E402

HEADLINE = [
    "column_profile",
    "dataset_stats",
    "iqr_outlier_counts",
    "detect_column_duplicates",
    "detect_inconsistencies",
    "detect_spelling_errors",
    "similar_pairs",
    "quality_score",
    "quality_score_lineitem",
    "impute_context_mode",
    "impute_knn",
    "adaptive_outliers",
    "auto_clean",
    "extract_patterns",
    "redact_sensitive",
    "html_elements",
    "word_boxes_to_blocks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begun = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    times = {}
    for name in names:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline query seconds, sum of medians",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
