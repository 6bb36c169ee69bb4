"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (all rows are
computed, nothing is collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stratocast.plans import catalog  # noqa: E402
from stratocast.session import build_session  # noqa: E402
from stratocast.sources import tables  # noqa: E402

HEADLINE = [
    "rain_rate_by_month_hour",
    "wn_lags",
    "wn_label_next24",
    "wn_interpolate",
    "wn_autocorr",
    "wn_sequences",
    "wn_latest_features",
    "wn_dedup_first",
    "prj_final_columns",
    "prj_humidity",
    "qc_range_counts",
    "qc_time_gaps",
    "jn_variables",
    "jn_code_lookup",
    "jn_gazetteer",
    "src_hourly_payload",
    "src_daily_payload",
    "ag_describe",
    "ag_monthly_quartiles",
    "ag_corr_target",
    "ml_split_80_20",
    "ml_ts_folds",
    "ml_minmax",
    "ml_roc_auc",
    "ml_pr_curve",
    "ml_threshold_sweep",
    "ml_calibration",
    "ml_regression_metrics",
    "ml_rain_scores",
    "str_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus), driver_memory="16g")
    catalog.load_all()
    # warm-up: JVM class loading and code generation, not timed
    catalog.QUERIES["sc_date_parts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        tables.forget_derived()  # every query pays for its own intermediate tables
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_total_sec",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
