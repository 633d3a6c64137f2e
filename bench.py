"""Benchmark of the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` (default 8), materialising the full result with the
no-op sink; ``$BENCH_RUNS`` timed runs per query (default 3), median kept.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a2_daily_grouping_sets",      # grouping-sets daily roll-up (all + countries)
    "j1_gap_fill_null",            # calendar completion
    "w5_training_matrix",          # flagship: roll-up → fill → RANGE windows → trim
    "m17_decompose_additive",      # interpolation + centred MA + phase means
    "m18_baseline_forecasts",      # baselines at every rolling-origin cutoff
    "j6_lookup_requests",          # request validation + forecast-table lookup
    "m6_model_cv",                 # rolling-origin backtest of the forecaster
    "m25_masked_vs_raw",           # backtest with / without outlier masks
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    os.environ["BENCH_CPUS"] = cpus
    from revcast import plans
    from revcast.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in plans.QUERIES]
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            df = plans.QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        rows[name] = plans.QUERIES[name](spark, sf_dir).count()
    extra = {}
    if "m6_model_cv" in names:
        t0 = time.perf_counter()
        from revcast.operators import backtest as bt
        from revcast.plans.q_forecast import series_y
        s = series_y(spark, sf_dir, checkpoint=True)
        n_fits = bt.cv_cutoffs(s).count()
        extra["cv_fits"] = n_fits
        extra["cv_fits_per_sec"] = round(n_fits / times["m6_model_cv"], 1)
        extra["cv_setup_sec"] = round(time.perf_counter() - t0, 3)
    if "m25_masked_vs_raw" in names:
        m = plans.QUERIES["m25_masked_vs_raw"](spark, sf_dir)
        m = m.where("series_id = 'all'").collect()
        extra["all_series_backtest"] = {r["mask"]: {"mae": round(r["mae"], 2), "mape": round(r["mape"], 4)}
                                        for r in m}
    out = {
        "metric": "headline_query_seconds_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": int(cpus),
        "runs": runs,
        **extra,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
