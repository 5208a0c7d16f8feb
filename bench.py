"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The first query runs once untimed to warm the JVM and the Python workers; then every query
is timed once.  Results are produced in full (written to the no-op sink), nothing is pruned.
"""

import json
import os
import sys
import time

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import load  # noqa: E402
from monthloom.session import get_spark  # noqa: E402

HEADLINE = (
    "outlook_univariate",
    "outlook_sarima",
    "outlook_features",
    "reindex_calendar",
    "classify_filter",
    "clean_all",
    "change_counts",
    "temporal_features",
    "split_label",
    "encode_and_scale",
    "join_features",
    "hw_fit",
    "ar_fit",
    "tune_search",
    "metrics_summary",
    "permutation_importance",
    "regress_forecast",
    "gbt_fit_full",
    "recursive_forecast_full",
)


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    load()
    from checks.registry import RAW as queries  # rounding is only there for comparisons

    times = {}
    for name in [names[0], *names]:
        spark.catalog.clearCache()  # nothing is read from what an earlier query has kept
        t = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()
